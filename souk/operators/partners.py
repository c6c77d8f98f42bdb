"""Listings without a model: the line of a collaboration in their title, else the group of
a description in it. Phrases are met by equi-joins of a title's runs of words, once for
each distinct title and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators.titles import positions

_NONE = "array<string>"


def named(rows: DataFrame, phrases: DataFrame, longest: int = 6) -> DataFrame:
    """title, product_type, slug of the longest phrase that counts, the leftmost of equals.

    ``rows``: title, product_type, tokens (of a collaboration: the words before brands are
    taken out). ``phrases``: phrase, slug, only_types (null or empty: all), except_types,
    stops; a phrase doesn't count in other types, nor if one of its stops follows, when a
    shorter one at the same word may. ``longest``: words of the longest phrase.
    """
    met = positions(rows, "tokens", "title", "product_type", "tokens", longest=longest).join(phrases, "phrase")
    all_types, none = F.size(F.coalesce("only_types", F.array().cast(_NONE))) == 0, F.array().cast(_NONE)
    applies = (all_types | F.array_contains(F.coalesce("only_types", none), F.col("product_type"))) & ~F.array_contains(F.coalesce("except_types", none), F.col("product_type"))
    stopped = F.coalesce(F.array_contains(F.coalesce("stops", none), F.get("tokens", F.col("start") + F.col("n"))), F.lit(False))
    return met.filter(applies & ~stopped).groupBy("title", "product_type").agg(F.max_by("slug", F.struct("n", -F.col("start"), "slug")).alias("slug"))


def clashes(phrases: DataFrame, types: list[str]) -> DataFrame:
    """phrase, product_type, slugs: phrases that name more than one slug of a type, which
    would leave a title's group open."""
    every = F.array(*map(F.lit, types))
    only = F.when(F.size(F.coalesce("only_types", F.array().cast(_NONE))) > 0, F.col("only_types")).otherwise(every)
    rows = phrases.select("phrase", "slug", F.explode(F.array_except(only, F.coalesce("except_types", F.array().cast(_NONE)))).alias("product_type"))
    return rows.groupBy("phrase", "product_type").agg(F.sort_array(F.collect_set("slug")).alias("slugs")).filter("size(slugs) > 1")


def system_lines(placed: DataFrame, groups: DataFrame, found: DataFrame, names: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """(placements, groups) once the listings with method none went to ``found``.

    ``placed``: listing_id, brand_id, title, product_type, slug, method. ``groups``:
    brand_id, product_type, slug, name, status, source, retired_at. ``names``: slug, name. A
    group that is missing is made, a retired one comes back, and one that a person ignored
    stays empty: its listings stay without a model.
    """
    key = ["brand_id", "product_type", "slug"]
    ignored = groups.filter("status = 'ignored'").select(*key, F.lit(True).alias("_ignored"))
    offered = placed.filter("method = 'none'").select("listing_id", "brand_id", "title", "product_type").join(found, ["title", "product_type"])
    taken = offered.join(ignored, key, "left").filter("_ignored is null").select("listing_id", *key)
    out = placed.join(taken.select("listing_id", F.col("slug").alias("_to")), "listing_id", "left")
    out = out.withColumns({"slug": F.coalesce("_to", "slug"), "method": F.when(F.col("_to").isNotNull(), method).otherwise(F.col("method"))}).drop("_to")
    wanted = taken.select(*key).distinct().join(names.groupBy("slug").agg(F.min("name").alias("_name")), "slug", "left")
    both = groups.withColumn("_held", F.lit(True)).join(wanted.withColumn("_wanted", F.lit(True)), key, "full")
    made = F.col("_held").isNull()
    lines = both.withColumns({
        "name": F.when(F.col("_wanted"), F.coalesce("_name", "name")).otherwise(F.col("name")), "status": F.when(made, "auto").otherwise(F.col("status")),
        "source": F.when(made, "system").otherwise(F.col("source")), "retired_at": F.when(F.col("_wanted").isNull(), F.col("retired_at")),
    })
    return out, lines.select(*groups.columns)
