"""Gold labels against placements: the grammar of labels, spellings of names, and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exprs import half_up, ratio
from souk.functions.text import fold, singular
from souk.operators.components import classes

#: What a verdict on a phrase can be.
VERDICTS = ("model", "not_model", "duplicate", "borderline")


def gold(value: Column) -> Column:
    """kind (none, descriptor, model), descriptor, line, leaf, error. ``line > version`` has a
    leaf of its own; without one the line is the leaf; a side without a name is an error."""
    text = F.trim(F.coalesce(value, F.lit("")))
    head = F.lower(text)
    none, described = head == "none", head.startswith("descriptor")
    line = F.trim(F.substring_index(text, ">", 1))
    leaf = F.when(text.contains(">"), F.trim(F.substring(text, F.instr(text, ">") + 1, F.length(text)))).otherwise(line)
    bad = ~none & ~described & ((line == "") | (leaf == ""))
    model = ~none & ~described & ~bad
    detail = F.when(text.contains(":"), F.nullif(F.trim(F.substring(head, F.instr(head, ":") + 1, F.length(head))), F.lit("")))
    return F.struct(
        F.when(none, "none").when(described, "descriptor").when(model, "model").alias("kind"), F.when(described, detail).alias("descriptor"),
        F.when(model, line).alias("line"), F.when(model, leaf).alias("leaf"), F.when(bad, F.concat(F.lit("Bad gold_model "), text)).alias("error"),
    )


def verdict(value: Column) -> Column:
    """kind, detail, error. A duplicate names what it is one of."""
    text = F.trim(F.coalesce(value, F.lit("")))
    kind = F.lower(F.trim(F.substring_index(text, ":", 1)))
    detail = F.when(text.contains(":"), F.trim(F.substring(text, F.instr(text, ":") + 1, F.length(text)))).otherwise("")
    error = F.when(~kind.isin(*VERDICTS), F.concat(F.lit("Bad phrase verdict "), text)).when((kind == "duplicate") & (detail == ""), "A duplicate verdict names its canonical model: duplicate:<name>")
    return F.struct(F.when(error.isNull(), kind).alias("kind"), F.when(error.isNull(), detail).alias("detail"), error.alias("error"))


def name_keys(name: Column) -> Column:
    """Keys that don't depend on blanks, hyphens or plurals: folded letters, and singular words, joined."""
    tokens = F.regexp_extract_all(fold(F.coalesce(name, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))
    return F.array_remove(F.array_distinct(F.array(F.array_join(tokens, ""), F.array_join(F.transform(tokens, singular), ""))), "")


def spellings(canon: DataFrame) -> DataFrame:
    """key, keys: all keys of a name, of each of its keys. ``canon``: canon, aliases (an array).
    Names that share a spelling, directly or over others, are one name."""
    names = F.flatten(F.transform(F.concat(F.array("canon"), F.coalesce("aliases", F.array().cast("array<string>"))), name_keys))
    rows = canon.select(F.array_sort(F.array_distinct(names)).alias("own")).filter("size(own) > 0")
    found = classes(rows.select(F.element_at("own", 1).alias("a"), F.explode("own").alias("b")))
    whole = found.groupBy("class").agg(F.array_sort(F.collect_set("id")).alias("keys"))
    return found.join(whole, "class").select(F.col("id").alias("key"), "keys")


def expanded(rows: DataFrame, name: str, out: str, canon: DataFrame, by: str) -> DataFrame:
    """Adds ``out``: the keys of a name, or all of its class if one of them is known."""
    own = rows.select(by, F.explode(name_keys(F.col(name))).alias("key")).join(canon, "key").groupBy(by).agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("_more"))
    return rows.join(own, by, "left").withColumn(out, F.array_distinct(F.concat(name_keys(F.col(name)), F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def judged(labels: DataFrame, placements: DataFrame, canon: DataFrame) -> DataFrame:
    """A row for each label: listing_id, gold_type, kind, found (the placement's kind), lenient
    (the line is right), strict (the version is), type_right, error. ``labels``: listing_id,
    gold_type, gold_model. ``placements``: listing_id, product_type, kind, line_names and
    leaf_names (names and aliases of the line and of the group)."""
    rows = labels.select("listing_id", "gold_type", gold(F.col("gold_model")).alias("g")).select("listing_id", "gold_type", "g.*")
    rows = expanded(expanded(rows, "line", "_line", canon, "listing_id"), "leaf", "_leaf", canon, "listing_id")
    keys = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), name_keys)))
    placed = placements.select("listing_id", "product_type", F.col("kind").alias("found"), keys("line_names").alias("_lines"), keys("leaf_names").alias("_leaves"))
    out = rows.join(placed, "listing_id", "left")
    both = F.coalesce((F.col("kind") == "model") & (F.col("found") == "model"), F.lit(False))
    right = lambda a, b: both & F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return out.select("listing_id", "gold_type", "kind", "found", right("_line", "_lines").alias("lenient"), right("_leaf", "_leaves").alias("strict"), F.coalesce(F.col("gold_type") == F.col("product_type"), F.lit(False)).alias("type_right"), "error")


def shares(rows: DataFrame, *by: str) -> DataFrame:
    """Of judged labels: precision (right lines of those placed as models), recall (of those
    labelled models), the strict share, the precision of none, and right types."""
    model, placed = F.col("kind") == "model", F.col("found") == "model"
    part = lambda a, b: half_up(ratio(F.count_if(a), F.count_if(b)), 6)
    return rows.filter("error is null").groupBy(*by).agg(
        F.count("*").alias("labels"), part(F.col("lenient"), placed).alias("precision"), part(F.col("lenient"), model).alias("recall"), part(F.col("strict"), placed).alias("strict"),
        part((F.col("found") == "none") & (F.col("kind") == "none"), F.col("found") == "none").alias("none_precision"), part(F.col("type_right"), F.lit(True)).alias("types"),
    )
