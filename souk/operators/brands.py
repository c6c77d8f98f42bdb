"""Brands and the names that listings give them: candidates, mappings, unmatched names,
titles that name another brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import brand_key, casefolded
from souk.operators.fuzzy import similar
from souk.sources.scratch import stored

#: Least scores of a mapping to verify and to keep, least likeness of a name.
VERIFIED, CANDIDATE, LIKE = 0.95, 0.75, 92.0
#: Letters of the pieces by which names and titles meet.
PIECE = 3


def merged(found: DataFrame) -> DataFrame:
    """brand_id, name, listings: the names that several searches for a brand found, each with
    the largest of its counts."""
    return found.groupBy("brand_id", "name").agg(F.max("listings").alias("listings"))


def upsert_mappings(held: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """The mappings after a pass. ``held``: brand_id, name, listings, score, verified,
    rejected_at, method, updated_at, one row a brand and name. ``scored``: brand_id, name,
    listings, score, one row each.

    A name that scores enough is added, verified if it scores high; one that is held takes the
    new numbers and is never unverified; a rejected one stays as it is. Others stay."""
    new = scored.filter(F.col("score") >= CANDIDATE).select("brand_id", "name", F.col("listings").alias("_listings"), F.col("score").alias("_score"), F.lit(True).alias("_new"))
    both = held.withColumn("_held", F.lit(True)).join(new, ["brand_id", "name"], "full")
    takes = F.col("_new").isNotNull() & F.col("rejected_at").isNull()
    fresh = lambda new, old: F.when(takes, new).otherwise(F.col(old)).alias(old)
    return both.select(
        "brand_id", "name", fresh(F.col("_listings"), "listings"), fresh(F.col("_score"), "score"),
        fresh(F.coalesce("verified", F.lit(False)) | (F.col("_score") >= VERIFIED), "verified"),
        "rejected_at", F.when(F.col("_held").isNull(), "auto").otherwise(F.col("method")).alias("method"), fresh(now, "updated_at"),
    )


def mapping_summary(brands: DataFrame, after: DataFrame, scored: DataFrame) -> DataFrame:
    """brands, verified, review (names that score enough and aren't rejected), unresolved
    (brands without such a name)."""
    kept = scored.filter(F.col("score") >= CANDIDATE).join(after.filter("rejected_at is null").select("brand_id", "name"), ["brand_id", "name"], "left_semi")
    sums = kept.groupBy("brand_id").agg(F.count_if(F.col("score") >= VERIFIED).alias("v"), F.count_if(F.col("score") < VERIFIED).alias("r"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return brands.select("brand_id").distinct().join(sums, "brand_id", "left").agg(F.count("*").alias("brands"), count("v").alias("verified"), count("r").alias("review"), F.count_if(F.col("v").isNull()).alias("unresolved"))


def resolve(raw: DataFrame, names: DataFrame, suggest: float = LIKE) -> DataFrame:
    """raw, brand_id, suggested, score of each distinct raw name: the brand one of whose names
    has the same key, else the one with the name most like it, if alike enough; one between
    ``suggest`` and that is a suggestion alone. ``names``: brand_id, name (its own, its aliases,
    its verified mappings). Of several brands the least id counts; a null name is no name, and
    one without a letter or digit is like none."""
    keys = names.withColumn("term", brand_key(F.col("name"))).filter("term <> ''").groupBy("term").agg(F.min("brand_id").alias("suggested"))
    raws = raw.select("raw").distinct().filter("raw is not null").withColumn("text", brand_key(F.col("raw")))
    exact = stored(raws.join(keys.withColumnRenamed("term", "text"), "text", "left"), "resolved")
    unknown = exact.filter("suggested is null").select("raw", "text")
    near = similar(unknown, keys, [], suggest, off=None).join(keys, "term")
    best = near.groupBy("text").agg(F.min_by(F.struct("suggested", "score"), F.struct(-F.col("score"), "suggested")).alias("m")).select("text", "m.*")
    found = exact.filter("suggested is not null").select("raw", "suggested", F.lit(100.0).alias("score")).unionByName(unknown.join(best, "text", "left").select("raw", "suggested", "score"))
    return found.select("raw", F.when(F.col("score") >= LIKE, F.col("suggested")).alias("brand_id"), "suggested", "score")


def count_unmatched(held: DataFrame, seen: DataFrame) -> DataFrame:
    """The counters of unmatched names after ``seen`` (raw, suggested, score, at; a row an
    occurrence): occurrences add up, the first moment stays, the latest row gives the
    suggestion (of one moment, the one of the higher score, then the larger suggestion).
    ``held``: raw, key, occurrences, suggested, score, first_seen, last_seen."""
    last = lambda c: F.max_by(c, F.struct("at", F.coalesce("score", F.lit(-1.0)), F.coalesce("suggested", F.lit(-1))))
    new = seen.filter("raw is not null").groupBy("raw").agg(F.count("*").alias("_n"), last("suggested").alias("_suggested"), last("score").alias("_score"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    both = held.join(new, "raw", "full")
    came = F.col("_n").isNotNull()
    return both.select(
        "raw", F.coalesce("key", brand_key(F.col("raw"))).alias("key"), (F.coalesce("occurrences", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("occurrences"),
        F.when(came, F.col("_suggested")).otherwise(F.col("suggested")).alias("suggested"), F.when(came, F.col("_score")).otherwise(F.col("score")).alias("score"),
        F.coalesce("first_seen", "_first").alias("first_seen"), F.coalesce("_last", "last_seen").alias("last_seen"),
    )


def _pieces(text: Column, n: int) -> Column:
    """The pieces of ``n`` letters of a text, each once."""
    spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n))))


def _all_pieces(text: Column) -> Column:
    return F.concat(*(_pieces(text, n) for n in range(1, PIECE + 1)))


def named_brands(titles: DataFrame, names: DataFrame) -> DataFrame:
    """title, brands: of each distinct title that holds a name, whose names it holds, case
    aside, anywhere in it. A name is posted under that one of its pieces which the fewest titles hold,
    so a title is read against the names of its rare pieces and never against all."""
    texts = stored(titles.select("title").distinct().filter("title is not null").select("title", casefolded(F.col("title")).alias("_text")), "titles")
    known = names.select("brand_id", casefolded(F.col("name")).alias("_name")).filter("_name <> '' and brand_id is not null").distinct()
    of_names = known.select("_name").distinct()
    size = F.when(F.length("_name") >= PIECE, _pieces(F.col("_name"), PIECE)).otherwise(F.array("_name"))
    pieces = of_names.select("_name", F.explode(size).alias("_piece"))
    held = texts.select("title", "_text", F.explode(_all_pieces(F.col("_text"))).alias("_piece"))
    common = held.join(pieces.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("_n"))
    posted = pieces.join(common, "_piece").groupBy("_name").agg(F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
    hits = held.join(posted, "_piece").filter(F.contains("_text", "_name")).select("title", "_name")
    return hits.join(known, "_name").groupBy("title").agg(F.array_sort(F.collect_set("brand_id")).alias("brands"))


def wrong_brand(listings: DataFrame, names: DataFrame) -> DataFrame:
    """Adds wrong_brand: the title holds a name of another brand and none of its own. Without a
    brand of its own any name counts. ``names``: brand_id, name; empty names name nothing; a
    null title names none."""
    found = named_brands(listings, names)
    own = F.coalesce(F.array_contains("_brands", F.col("brand_id")), F.lit(False))
    rows = listings.join(found.select("title", F.col("brands").alias("_brands")), "title", "left")
    return rows.withColumn("wrong_brand", F.col("_brands").isNotNull() & ~own).drop("_brands")
