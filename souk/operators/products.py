"""The product type of a listing: its category first, the words of its title where a
category is mixed, and the models known of a brand where both leave it open.

A taxonomy is configuration: ``types`` maps a type to its (section, family). The rules of
categories and departments are tables, met by equi-joins: category or department, fixed
(the one type) or any (an array of types) with fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.titles import one_entry, search

#: Where contradictions go; the department whose rule holds for unknown ones.
REVIEW, UNKNOWN = "review", "unknown"


def with_rule(listings: DataFrame, categories: DataFrame, departments: DataFrame, path: str = "category_path") -> DataFrame:
    """Adds fixed, any, fallback and known: the rule of the whole path, else of its
    department, else of unknown departments."""
    rule = F.struct("fixed", "any", "fallback")
    whole = categories.select(F.col("category").alias("_path"), rule.alias("_whole"))
    part = departments.select(F.col("department").alias("_department"), rule.alias("_part"))
    rest = departments.filter(F.col("department") == UNKNOWN).select(rule.alias("_rest"))
    said = F.lower(F.trim(F.coalesce(path, F.lit(""))))
    out = listings.withColumn("_path", said).withColumn("_department", F.split_part("_path", F.lit("."), F.lit(1)))
    out = out.join(whole, "_path", "left").join(part, "_department", "left").join(F.broadcast(rest.limit(1)), F.lit(True), "left")  # one row
    chosen = F.coalesce("_whole", "_part", "_rest")
    return out.withColumns({"fixed": chosen["fixed"], "any": F.coalesce(chosen["any"], F.array().cast("array<string>")), "fallback": chosen["fallback"], "known": F.col("_whole").isNotNull()}).drop("_path", "_department", "_whole", "_part", "_rest")


def candidates(types: dict[str, tuple[str, str]]) -> Column:
    """The types a mixed category leaves: its own list, else those that the title names."""
    real = lambda c: F.filter(c, lambda t: t.isin(*types))
    return F.when(F.size("any") > 0, F.col("any")).when(F.size(real("strong")) > 0, real("strong")).otherwise(real("weak"))


def classify(rows: DataFrame, types: dict[str, tuple[str, str]], inferred: str | None = None) -> DataFrame:
    """Adds product_type and method. ``rows``: the rule's columns, and the types that a
    title names, ``strong`` and ``weak``. ``inferred``: the column with the type that known
    models suggest."""
    of = lambda i: F.create_map(*(F.lit(x) for name, pair in types.items() for x in (name, pair[i])))
    section, family = (lambda t: F.try_element_at(of(0), t)), (lambda t: F.try_element_at(of(1), t))
    strong = F.filter("strong", lambda t: t.isin(*types))
    fixed, open_to = F.col("fixed"), candidates(types)
    kin = F.exists(strong, lambda t: (family(t) == family(fixed)) | (section(t) == section(fixed)))
    agrees = (F.size(strong) == 0) | F.array_contains(strong, fixed) | F.array_contains("weak", fixed) | F.coalesce(kin, F.lit(False))
    named = F.get(F.filter(open_to, lambda t: F.array_contains(strong, t)), F.lit(0))
    hinted = F.get(F.filter(open_to, lambda t: F.array_contains(F.col("weak"), t)), F.lit(0))
    fallback = F.coalesce("fallback", F.lit(REVIEW))
    same = F.coalesce(F.exists(strong, lambda t: section(t) == section(fallback)), F.lit(False))
    decision = lambda kind, method: F.struct(kind.alias("product_type"), F.lit(method).alias("method"))
    out = F.when(fixed.isNotNull() & agrees, decision(fixed, "category")).when(fixed.isNotNull(), decision(F.lit(REVIEW), "conflict")).when(named.isNotNull(), decision(named, "title"))
    out = out.when((F.size(strong) > 0) & (F.size("any") > 0) & ~same, decision(F.lit(REVIEW), "conflict")).when(hinted.isNotNull(), decision(hinted, "weak"))
    if inferred:
        out = out.when((F.size(open_to) > 0) & F.col(inferred).isNotNull(), decision(F.col(inferred), "model"))
    return rows.withColumn("_d", out.otherwise(decision(fallback, "fallback"))).withColumns({"product_type": F.col("_d.product_type"), "method": F.col("_d.method")}).drop("_d")


def infer(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """title, inferred. ``rows``: title, candidates, tokens, one for each title and list of
    candidates. ``dictionary``: as ``titles.match`` reads it, with infer (its model tells the
    type) and weight. A model that tells the type comes first, then the heaviest, then the
    one that covers most words, then the order of the candidates."""
    entries = dictionary.select("key", "infer", "weight").distinct()
    each = rows.select("title", "tokens", F.col("candidates").alias("_c"), F.posexplode("candidates").alias("_at", "product_type"))
    met = search(each.select("title", "product_type", "tokens").distinct(), one_entry(dictionary)).select("title", "product_type", F.col("m.key").alias("key"), "covered")
    rank = F.struct(~F.col("infer"), -F.col("weight"), -F.col("covered"), F.col("_at"))
    found = each.drop("tokens").join(met, ["title", "product_type"]).join(entries, "key")
    return found.groupBy("title", F.col("_c").alias("candidates")).agg(F.min_by("product_type", rank).alias("inferred"))


def product_types(rows: DataFrame, types: dict[str, tuple[str, str]], dictionary: DataFrame) -> DataFrame:
    """Category and title first; only what they leave to the fallback is looked up among the
    known models. ``rows``: the rule's columns, title, tokens, strong and weak."""
    first = classify(rows, types).withColumn("candidates", candidates(types))
    left = first.filter("method = 'fallback' and size(candidates) > 0").select("title", "candidates", "tokens").distinct()
    again = first.join(infer(left, dictionary), ["title", "candidates"], "left").withColumn("inferred", F.when(F.col("method") == "fallback", F.col("inferred")))
    return classify(again.drop("product_type", "method"), types, "inferred").drop("inferred", "candidates")


def unknown_categories(rows: DataFrame, path: str = "category_path") -> DataFrame:
    """How many listings have each category without a rule of its own."""
    return rows.filter(~F.col("known")).groupBy(F.coalesce(path, F.lit("—")).alias("category")).agg(F.count("*").alias("n"))
