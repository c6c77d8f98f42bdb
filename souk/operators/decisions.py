"""What people decide about groups, as tables of decisions applied to tables of groups.

``groups``: group_id, brand_id, product_type, slug, name, aliases (array), parent_id,
status, source, retired_at. ``overrides``: listing_id, group_id. A decision that isn't
valid changes nothing. The decisions of one table are taken at once: a group that one of
them merges away can't be the target of another of the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.payloads import merged_names


def usable(status: str = "status", retired: str = "retired_at") -> Column:
    """Neither ignored nor retired."""
    return (F.col(status) != "ignored") & F.col(retired).isNull()


def editable(slug: str = "slug") -> Column:
    """A group that people may change: in use, and not one of the system's own."""
    return usable() & ~F.col(slug).startswith("_")


def merge(groups: DataFrame, overrides: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, overrides) after ``merges``: source_id, target_id; a source has one target.

    Within a brand and type. The target takes the source's name and aliases and is
    confirmed; what stood under the source comes under the target (or its parent), placed
    listings follow, and the source stays as a tombstone, so that its phrase isn't mined again.
    """
    side = lambda p: groups.filter(editable()).select(*(F.col(c).alias(f"{p}_{n}") for c, n in (("group_id", "id"), ("brand_id", "brand"), ("product_type", "type"), ("name", "name"), ("aliases", "aliases"), ("parent_id", "parent"))))
    asked = merges.groupBy("source_id").agg(F.min("target_id").alias("target_id")).filter("source_id <> target_id")
    both = asked.join(side("source"), "source_id").join(side("target"), "target_id").filter("source_brand = target_brand and source_type = target_type")
    good = both.join(both.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")
    line = F.coalesce("target_parent", "target_id")
    moved = good.select("source_id", "target_id", F.when(line != F.col("source_id"), line).alias("line"))
    given = good.groupBy("target_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("source_id", F.concat(F.array("source_name"), F.coalesce("source_aliases", F.array().cast("array<string>"))).alias("names")))), lambda x: x["names"])).alias("_given"))
    out = groups.join(given, F.col("group_id") == F.col("target_id"), "left").drop("target_id")
    out = out.join(moved.select(F.col("source_id").alias("parent_id"), F.lit(True).alias("_freed"), F.col("line").alias("_line")), "parent_id", "left")
    out = out.join(moved.select(F.col("source_id").alias("group_id"), F.lit(True).alias("_gone")), "group_id", "left")
    out = out.withColumns({
        "aliases": F.when(F.col("_given").isNotNull(), merged_names(F.col("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.col("_given"))).otherwise(F.col("aliases")),
        "status": F.when(F.col("_gone"), "ignored").when(F.col("_given").isNotNull(), "confirmed").otherwise(F.col("status")),
        "parent_id": F.when(F.col("_gone"), None).when(F.col("_freed"), F.col("_line")).otherwise(F.col("parent_id")),
    })
    held = overrides.join(moved.select(F.col("source_id").alias("group_id"), "target_id"), "group_id", "left").select("listing_id", F.coalesce("target_id", "group_id").alias("group_id"))
    return out.select(*groups.columns), held


def split(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """``groups`` with the lines that ``splits`` (source_id, slug, name, as_version) make of
    phrases; ``slug`` is the phrase's, null if none of its words is of a model.

    A version comes under its source's line, but never under one of the system's own
    groups. A phrase that a group in use has is taken; one of an ignored or retired group
    is free, and that group comes back. New groups have no id yet: the table's writer gives it.
    """
    key = ["brand_id", "product_type", "slug"]
    source = groups.filter(usable()).select(F.col("group_id").alias("source_id"), "brand_id", "product_type", F.coalesce("parent_id", "group_id").alias("_line"), (~F.col("slug").startswith("_")).alias("_own"))
    asked = splits.filter("slug is not null and slug <> ''").join(source, "source_id").withColumn("_parent", F.when(F.col("as_version") & F.col("_own"), F.col("_line")))
    asked = asked.groupBy(*key).agg(F.min_by(F.struct(F.trim("name").alias("name"), F.col("_parent").alias("parent")), F.struct("source_id", "name")).alias("_s"))
    out = groups.withColumn("_held", F.lit(True)).join(asked, key, "full")
    free = F.coalesce(F.col("_s").isNotNull() & (F.col("_held").isNull() | ~usable()), F.lit(False))
    return out.withColumns({
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")), "name": F.when(free, F.col("_s.name")).otherwise(F.col("name")), "parent_id": F.when(free, F.col("_s.parent")).otherwise(F.col("parent_id")),
        "source": F.when(free, "user").otherwise(F.col("source")), "retired_at": F.when(~free, F.col("retired_at")), "status": F.when(free, "confirmed").otherwise(F.col("status")),
    }).select(*groups.columns)


def block(groups: DataFrame, blocked: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, blocked phrases) once the groups of ``ids`` (group_id) were found to be no
    models. ``blocked``: brand_id, phrase. What stood under them stands by itself."""
    gone = ids.select("group_id").distinct().join(groups.filter(editable()), "group_id")
    said = gone.select("brand_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    mark = gone.select("group_id", F.lit(True).alias("_gone"))
    out = groups.join(mark, "group_id", "left").join(mark.select(F.col("group_id").alias("parent_id"), F.col("_gone").alias("_freed")), "parent_id", "left")
    out = out.withColumns({"status": F.when(F.col("_gone"), "ignored").otherwise(F.col("status")), "parent_id": F.when(F.col("_gone") | F.col("_freed"), None).otherwise(F.col("parent_id"))})
    return out.select(*groups.columns), blocked.select("brand_id", "phrase").unionByName(said).distinct()


def move(groups: DataFrame, overrides: DataFrame, listings: DataFrame, moves: DataFrame) -> DataFrame:
    """``overrides`` after ``moves``: listing_id, group_id (null: the rules place it again),
    at; the last one counts. ``listings``: listing_id, brand_id. A listing goes only to a
    group in use of its own brand."""
    last = moves.groupBy("listing_id").agg(F.max_by("group_id", "at").alias("_to"))
    target = groups.filter(usable()).select(F.col("group_id").alias("_to"), F.col("brand_id").alias("_brand"))
    asked = last.join(listings.select("listing_id", "brand_id"), "listing_id").join(target, "_to", "left")
    good = asked.filter("_to is null or _brand = brand_id").select("listing_id", "_to", F.lit(True).alias("_asked"))
    both = overrides.join(good, "listing_id", "full")
    return both.select("listing_id", F.when(F.col("_asked"), F.col("_to")).otherwise(F.col("group_id")).alias("group_id")).filter("group_id is not null")


def apply_parents(groups: DataFrame, parents: DataFrame) -> DataFrame:
    """``groups`` under the parents that people gave: ``parents`` (group_id, parent_id, null:
    none). A parent is another group of the type, a line itself, and not ignored."""
    over = groups.filter("parent_id is null and status <> 'ignored'").select(F.col("group_id").alias("_to"), F.col("product_type").alias("_type"))
    asked = parents.groupBy("group_id").agg(F.min("parent_id").alias("_to")).withColumn("_asked", F.lit(True))
    out = groups.join(asked, "group_id", "left").join(over, "_to", "left")
    valid = F.col("_asked") & (F.col("_to").isNull() | ((F.col("_to") != F.col("group_id")) & (F.col("_type") == F.col("product_type"))))
    return out.withColumn("parent_id", F.when(F.coalesce(valid, F.lit(False)), F.col("_to")).otherwise(F.col("parent_id"))).select(*groups.columns)


def pinned(groups: DataFrame, overrides: DataFrame, parents: DataFrame) -> DataFrame:
    """group_id of all groups that people's rules point at; none of them is retired. Lines
    of a version that wasn't mined belong to them."""
    derived = (F.col("status") == "auto") & F.col("source").isin("mined", "system")
    lines = groups.filter((F.col("status") != "ignored") & ~derived).select(F.col("parent_id").alias("group_id"))
    ids = overrides.select("group_id").unionByName(parents.select("group_id")).unionByName(parents.select(F.col("parent_id").alias("group_id"))).unionByName(lines)
    return ids.filter("group_id is not null").distinct().join(groups.select("group_id"), "group_id", "left_semi")


def idle_seeds(groups: DataFrame, seeds: DataFrame, needed: DataFrame, pins: DataFrame) -> DataFrame:
    """group_id of confirmed seeds of any type in a type where no title names them.
    ``seeds``: slug; ``needed``: slug, product_type; ``pins``: group_id."""
    rows = groups.filter("source = 'seed' and status = 'confirmed'").join(seeds.select("slug").distinct(), "slug", "left_semi")
    return rows.join(needed.select("slug", "product_type"), ["slug", "product_type"], "left_anti").join(pins, "group_id", "left_anti").select("group_id")
