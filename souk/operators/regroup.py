"""Groups that stay the same from one mining pass to the next.

A pass places listings by the known groups, mines the rest for phrases, and gives each
phrase its group: one that it had before (by slug, alias or another spelling), one whose
listings it took over, or a new one. Ids are made of what a group was created as and the
pass's number, so a pass that runs again gives the same ids, and nothing counts rows.

Groups: group_id, product_type, slug, phrase (its words), aliases, status (auto, confirmed,
ignored), source (mined, seed, user), parent_id, support, retired. Placements: listing_id,
group_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.text import words
from souk.operators.grouping import SELLERS, longest_match, mine, runs_of
from souk.operators.groups import parents
from souk.sources.scratch import stored

GROUPS = "group_id string, product_type string, slug string, phrase string, aliases array<string>, status string, source string, parent_id string, support long, retired boolean"
#: Share of a new group's listings that it must have from the old one; share
#: of its sellers that use a phrase by itself, under which it is a part of longer names.
TAKEN, FRAGMENT = 0.5, 0.5
NONE = "_none"


def derived() -> Column:
    """Found by mining, and confirmed by nobody."""
    return (F.col("source") == "mined") & (F.col("status") == "auto")


def slug_of(phrase: Column) -> Column:
    return F.replace(phrase, F.lit(" "), F.lit("-"))


def new_id(generation: int) -> Column:
    return F.concat("product_type", F.lit(":"), "slug", F.lit(f"@{generation}"))


def claims(edges: DataFrame, share: float = TAKEN) -> DataFrame:
    """new, old: which new group keeps the id of which old one. ``edges``: new, old, n (listings
    that went from one to the other), used (all of the new). The outcome is that of going
    through new groups from the largest down, each taking the old one it has most listings of
    and that is still free, as long as these are ``share`` of its own.

    It is found in rounds: an edge is taken when it is the best left of its new group, and no
    larger new group has an edge to its old one. The largest group's best edge always is such
    an edge, so rounds end; those that don't compete are all taken in the first.
    """
    left = stored(edges.filter(F.col("n") >= share * F.col("used")).select("new", "old", "n", "used"), "edges")
    found = left.limit(0).select("new", "old", "n")
    first = lambda side, *order: F.row_number().over(Window.partitionBy(side).orderBy(*order))
    while not left.isEmpty():
        ranked = left.withColumns({"_a": first("new", F.desc("n"), F.col("old")), "_b": first("old", F.desc("used"), F.col("new"))})
        won = stored(ranked.filter("_a = 1 and _b = 1").select("new", "old", "n"), "won")
        found = found.unionByName(won)
        left = stored(left.join(won.select("new"), "new", "left_anti").join(won.select("old"), "old", "left_anti"), "edges")
    return found


def reuse(phrases: DataFrame, groups: DataFrame) -> DataFrame:
    """``phrases`` with the group each keeps (group_id, null: none) and ``made``: whether a
    group is to be made for it. ``groups``: all of the types. A phrase looks for a mined group
    of its slug; if no group at all has that slug, for one that it is an alias of, then for
    one of another spelling of it. A group that several phrases want goes to the first."""
    slug = slug_of(F.col("phrase"))
    rows = phrases.withColumn("slug", slug)
    mined = groups.filter(derived())
    taken = groups.select("product_type", "slug", F.lit(True).alias("_taken")).distinct()
    rows = stored(rows.join(taken, ["product_type", "slug"], "left"), "asked")
    by_slug = rows.join(mined.select("product_type", "slug", "group_id"), ["product_type", "slug"]).withColumn("_kind", F.lit(0))
    free = rows.filter("_taken is null")
    alias = mined.select("product_type", "group_id", F.explode("aliases").alias("phrase"))
    by_alias = free.join(alias, ["product_type", "phrase"]).withColumn("_kind", F.lit(1))
    spelt = free.select("*", F.posexplode("variants").alias("_at", "_form"))
    by_form = spelt.join(mined.select("product_type", F.col("slug").alias("_slug"), "group_id"), (spelt.product_type == mined.product_type) & (slug_of(F.col("_form")) == F.col("_slug"))).select(spelt.product_type, "phrase", "place", "group_id", (F.col("_at") + 2).alias("_kind"))
    wanted = [df.select("product_type", "phrase", "place", "group_id", "_kind") for df in (by_slug, by_alias, by_form)]
    best = wanted[0].unionByName(wanted[1]).unionByName(wanted[2])
    best = best.groupBy("product_type", "phrase", "place").agg(F.min(F.struct("_kind", "group_id")).alias("_b")).select("product_type", "phrase", "place", "_b.group_id")
    kept = best.groupBy("product_type", "group_id").agg(F.min_by("phrase", F.struct("place", "phrase")).alias("phrase"))
    out = rows.join(kept, ["product_type", "phrase"], "left")
    return out.withColumn("made", F.col("group_id").isNull() & F.col("_taken").isNull()).drop("_taken")


def merged(*lists: Column) -> Column:
    """Aliases in order, each once."""
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists))))


def named(groups: DataFrame) -> DataFrame:
    """A dictionary for ``longest_match``: the group's id in the place of the model."""
    return groups.select("product_type", "phrase", "aliases", "group_id")


def placed_by(titles: DataFrame, groups: DataFrame) -> DataFrame:
    """listing_id, group_id of the longest name or alias in each title."""
    entries = groups.select("product_type", "group_id", F.explode(merged(F.array("phrase"), F.col("aliases"))).alias("phrase"))
    one = entries.groupBy("product_type", "phrase").agg(F.min("group_id").alias("group_id"))
    known = one.select("product_type", F.col("phrase"), F.array().cast("array<string>").alias("variants"), "group_id")
    found = longest_match(titles, known).select("product_type", "listing_id", F.col("model").alias("phrase"))
    return found.join(one, ["product_type", "phrase"]).select("listing_id", "group_id")


def regroup(titles: DataFrame, groups: DataFrame, placed: DataFrame, generation: int, sellers: int = SELLERS, keep_sellers: int | None = None, scope: DataFrame | None = None, modifiers: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The groups and placements after a pass. ``titles``: listing_id, product_type, seller,
    title. ``scope`` (listing_id): a pass over what is new alone; live groups then are known,
    and only phrases that a title of the scope has are mined."""
    groups, titles = stored(groups, "groups"), stored(titles.select("listing_id", "product_type", "seller", "title"), "titles")
    known = groups.filter((~derived() | (F.lit(scope is not None) & ~F.col("retired"))) & (F.col("slug") != NONE))
    told = stored(placed_by(titles, known.filter("status <> 'ignored'")), "told")
    rest = titles.join(told.select("listing_id"), "listing_id", "left_anti")
    live = groups.filter(derived() & ~F.col("retired") & F.col("parent_id").isNull())
    phrases = mine(rest, sellers=sellers, keep=live.select("product_type", "phrase"), keep_sellers=keep_sellers)
    names = known.select("product_type", F.explode(merged(F.array("phrase"), F.col("aliases"))).alias("phrase"))
    phrases = phrases.join(names, ["product_type", "phrase"], "left_anti")
    if scope is not None:
        seen = runs_of(rest.join(scope.select("listing_id"), "listing_id", "left_semi"), "product_type").select("product_type", "phrase").distinct()
        phrases = phrases.join(seen, ["product_type", "phrase"], "left_semi")
    found = stored(reuse(phrases, groups), "reuse").filter("made or group_id is not null")
    old = groups.select("group_id", F.col("phrase").alias("_was"), F.col("aliases").alias("_aliases"), "status", "source")
    own = found.join(old, "group_id", "left").withColumn("_was", F.when(F.col("_was") != F.col("phrase"), F.col("_was")))
    mined = own.select(
        F.coalesce("group_id", new_id(generation)).alias("group_id"), "product_type", "slug", "phrase",
        F.array_remove(merged(F.col("_aliases"), F.array("_was"), F.col("variants")), F.col("phrase")).alias("aliases"),
        F.coalesce("status", F.lit("auto")).alias("status"), F.coalesce("source", F.lit("mined")).alias("source"),
        F.col("sellers").alias("support"), (F.col("own_sellers") < FRAGMENT * F.col("sellers")).alias("fragment"), F.col("made"),
    )
    mined = stored(mined, "mined")
    now = stored(told.unionByName(placed_by(rest, mined)), "placed")
    renamed = stored(_inherited(mined, groups, placed, now), "inherited")
    mined = stored(_renamed(mined, groups, renamed), "renamed")
    lines = known.filter("parent_id is null and status <> 'ignored' and not retired").select("product_type", F.col("phrase").alias("line"), F.col("group_id").alias("_line")).unionByName(mined.filter("not fragment").select("product_type", F.col("phrase").alias("line"), F.col("group_id").alias("_line")))
    mined = stored(_under(mined, lines, modifiers), "parents")
    now = now.join(renamed.select(F.col("new").alias("group_id"), "old"), "group_id", "left").select("listing_id", F.coalesce("old", "group_id").alias("group_id"))
    now = stored(now, "placed")
    rest_of = groups.join(mined.select("group_id"), "group_id", "left_anti")
    used = now.select("group_id").distinct().withColumn("_used", F.lit(True))
    out = rest_of.unionByName(mined.withColumn("retired", F.lit(False)).select(*groups.columns)).join(used, "group_id", "left")
    out = out.withColumn("retired", F.when(derived(), F.col("_used").isNull()).otherwise(F.col("retired"))).select(*groups.columns)
    none = titles.join(now, "listing_id", "left").select("listing_id", F.coalesce("group_id", F.concat("product_type", F.lit(f":{NONE}"))).alias("group_id"))
    return stored(out, "groups"), stored(none, "placements")


def _inherited(mined: DataFrame, groups: DataFrame, placed: DataFrame, now: DataFrame) -> DataFrame:
    """new, old: ids that new groups take over from mined groups which no listing has any more."""
    used = now.groupBy("group_id").agg(F.count("*").alias("used"))
    gone = groups.filter(derived()).join(used.select("group_id"), "group_id", "left_anti").join(mined.select("group_id"), "group_id", "left_anti").select("product_type", F.col("group_id").alias("old"))
    moved = now.join(mined.filter("made").select("group_id", "product_type"), "group_id").withColumnRenamed("group_id", "new")
    moved = moved.join(placed.select("listing_id", F.col("group_id").alias("old")), "listing_id").join(gone, ["product_type", "old"])
    edges = moved.groupBy("new", "old").agg(F.count("*").alias("n")).join(used.withColumnRenamed("group_id", "new"), "new")
    return claims(edges)


def _renamed(mined: DataFrame, groups: DataFrame, renamed: DataFrame) -> DataFrame:
    """New groups that took an id over keep the old names as aliases."""
    old = groups.select(F.col("group_id").alias("old"), F.col("phrase").alias("_was"), F.col("aliases").alias("_old"))
    out = mined.join(renamed.select(F.col("new").alias("group_id"), "old"), "group_id", "left").join(old, "old", "left")
    aliases = F.array_remove(merged(F.col("_old"), F.array("_was"), F.col("aliases")), F.col("phrase"))
    return out.withColumns({"aliases": F.when(F.col("old").isNull(), F.col("aliases")).otherwise(aliases), "group_id": F.coalesce("old", "group_id")}).drop("old", "_was", "_old")


def _under(mined: DataFrame, lines: DataFrame, modifiers: tuple[str, ...]) -> DataFrame:
    """Adds parent_id: the line that begins a group's phrase, or that line's own parent. A
    phrase that mostly is a part of longer names is no line."""
    one = lines.groupBy("product_type", "line").agg(F.min("_line").alias("_line"))
    found = parents(mined.select("product_type", "phrase"), one, "product_type", modifiers).withColumnRenamed("parent", "line").join(one, ["product_type", "line"])
    first = mined.join(found.select("product_type", "phrase", F.col("_line").alias("_p")), ["product_type", "phrase"], "left").withColumn("_p", F.when(F.col("_p") != F.col("group_id"), F.col("_p")))
    above = first.select(F.col("group_id").alias("_p"), F.col("_p").alias("_pp")).filter("_pp is not null")
    return first.join(above, "_p", "left").withColumn("parent_id", F.coalesce("_pp", "_p")).drop("_p", "_pp")


def version_name(version: Column, phrase: Column, name: Column) -> Column:
    """The name of a version around that of its line: words before it with a capital, what
    follows as it is, numbers in capitals."""
    at = F.instr(F.concat(F.lit(" "), version, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
    before = F.initcap(F.trim(F.substring(version, F.lit(1), F.greatest(at - 1, F.lit(0)))))
    after = F.split(F.trim(F.substring(version, at + F.length(phrase), F.length(version))), " ")
    rest = F.array_join(F.transform(after, lambda t: F.when(t.startswith("#"), F.upper(t)).otherwise(t)), " ")
    whole = F.trim(F.regexp_replace(F.concat_ws(" ", before, name, rest), " +", " "))
    return F.when(at > 0, whole).otherwise(F.initcap(version))


def on_demand(wanted: DataFrame, groups: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """Versions of lines that titles name. ``wanted``: listing_id, product_type, version (its
    words), parent_id. Distinct versions that no group has are made, with ids that depend on
    nothing else; retired ones come back; where the version is ignored the listing is placed
    nowhere. Returns the groups and listing_id, group_id (null: nowhere).

    Two phases in one plan: keys first, then the join back, so a version that a third of all
    listings have is one row of the join's other side."""
    rows = wanted.withColumn("slug", slug_of(F.col("version")))
    keys = rows.groupBy("product_type", "slug").agg(F.min("version").alias("phrase"), F.min("parent_id").alias("parent_id"))
    have = groups.select("product_type", "slug", "group_id", "status").withColumn("_have", F.lit(True))
    missing = keys.join(have, ["product_type", "slug"], "left_anti")
    made = missing.select(
        new_id(generation).alias("group_id"), "product_type", "slug", "phrase", F.array("phrase").alias("aliases"), F.lit("auto").alias("status"),
        F.lit("mined").alias("source"), "parent_id", F.lit(None).cast("long").alias("support"), F.lit(False).alias("retired"),
    )
    again = keys.select("product_type", "slug", F.lit(True).alias("_again"))
    held = groups.join(again, ["product_type", "slug"], "left").withColumn("retired", F.col("retired") & ~(F.coalesce("_again", F.lit(False)) & (F.col("status") != "ignored")))
    after = stored(held.select(*groups.columns).unionByName(made.select(*groups.columns)), "groups")
    target = after.filter("status <> 'ignored'").select("product_type", "slug", "group_id")
    return after, rows.join(target, ["product_type", "slug"], "left").select("listing_id", "group_id")


def sow(groups: DataFrame, seeds: DataFrame, generation: int) -> DataFrame:
    """Groups with the seeds in them. ``seeds``: product_type, name, aliases, parent (a name or
    null). A mined group of the seed's slug becomes the seed and keeps its id; a retired seed
    comes back; aliases that a seed has gained are added, none is taken away; an ignored group
    stays ignored. A parent counts if it has none itself."""
    phrase = F.array_join(words(F.col("name")), " ")
    new = seeds.select("product_type", phrase.alias("_phrase"), slug_of(phrase).alias("slug"), F.col("aliases").alias("_more"), F.col("parent").alias("_parent"))
    new = new.groupBy("product_type", "slug").agg(F.min("_phrase").alias("_phrase"), F.array_distinct(F.flatten(F.collect_list("_more"))).alias("_more"), F.min("_parent").alias("_parent"))
    both = groups.join(new, ["product_type", "slug"], "full")
    seeded, mined, fresh = F.col("_phrase").isNotNull(), derived(), F.col("group_id").isNull()
    takes = seeded & (F.coalesce(mined, F.lit(True)) | fresh)
    kept = seeded & (F.col("source") == "seed") & (F.col("status") != "ignored")
    names = F.array_remove(merged(F.col("_more"), F.col("aliases"), F.array("phrase")), F.col("_phrase"))
    out = both.select(
        F.coalesce("group_id", new_id(generation)).alias("group_id"), "product_type", "slug", F.when(takes, F.col("_phrase")).otherwise(F.col("phrase")).alias("phrase"),
        F.when(fresh, F.array_remove(F.col("_more"), F.col("_phrase"))).when(takes | kept, names).otherwise(F.col("aliases")).alias("aliases"),
        F.when(takes, "confirmed").otherwise(F.col("status")).alias("status"), F.when(takes, "seed").otherwise(F.col("source")).alias("source"),
        F.when(~takes, F.col("parent_id")).alias("parent_id"), "support", F.when(takes | kept, F.lit(False)).otherwise(F.col("retired")).alias("retired"),
        F.when(takes, F.array_join(words(F.col("_parent")), " ")).alias("_parent"),
    )
    out = stored(out, "sown")
    tops = out.filter("parent_id is null and _parent is null").groupBy("product_type", F.col("phrase").alias("_parent")).agg(F.min("group_id").alias("_above"))
    return out.join(tops, ["product_type", "_parent"], "left").withColumn("parent_id", F.coalesce("parent_id", F.when(F.col("_above") != F.col("group_id"), F.col("_above")))).select(*groups.columns)
