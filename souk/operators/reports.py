"""Reports over placements, lines, runs and scans. Every function is an aggregate or a
join of aggregates; lists for people (a top, examples) are cut in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import half_up, ratio
from souk.operators.evaluation import wilson

#: Kinds that are no model; margin by which a share's interval may miss its goal.
NO_MODEL, MARGIN = ("none", "descriptor", "review"), 0.05


def part(some: Column, all_: Column) -> Column:
    """A share, four places; null of nothing."""
    return half_up(ratio(some, all_), 4)


def rank_lines(placed: DataFrame) -> DataFrame:
    """product_type, line, sales, listings, place of the lines of models, versions included."""
    counted = placed.filter("kind = 'model'").groupBy("product_type", "line").agg(F.count_if("sold").alias("sales"), F.count("*").alias("listings"))
    order = Window.orderBy(F.desc("sales"), F.desc("listings"), "product_type", "line")  # a row for each line
    return counted.withColumn("place", F.row_number().over(order))


def phrase_metrics(lines: DataFrame, verdicts: DataFrame, top: int) -> DataFrame:
    """Of the first ``top`` lines: shares that are garbage, and garbage or duplicates, by
    lines and by sales. ``verdicts``: product_type, line, verdict."""
    rows = lines.filter(F.col("place") <= top).join(verdicts, ["product_type", "line"], "left")
    bad, twice = F.col("verdict") == "not_model", F.coalesce(F.col("verdict").isin("not_model", "duplicate"), F.lit(False))
    total, sold = F.count("*"), F.sum("sales")
    by_sales = lambda test: F.sum(F.when(test, F.col("sales")).otherwise(0))
    return rows.agg(total.alias("lines"), sold.alias("sales"), F.count_if(F.col("verdict").isNull()).alias("unlabeled"), part(F.count_if(bad), total).alias("garbage_lines"), part(by_sales(bad), sold).alias("garbage_sales"), part(F.count_if(twice), total).alias("garbage_dup_lines"), part(by_sales(twice), sold).alias("garbage_dup_sales"))


def weighted_draws(lines: DataFrame, size: int, step: float = 0.6180339887498949) -> DataFrame:
    """``size`` draws of lines with replacement in proportion to their sales. Draw i falls
    at the fraction of i * ``step`` of the sales, so a run can be repeated anywhere. Lines
    are aggregates, and draws a small table: each meets the one interval it falls into."""
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lines.filter("sales > 0").withColumn("high", F.sum("sales").over(order)).withColumn("low", F.col("high") - F.col("sales"))
    total = lines.agg(F.sum("sales").cast("double").alias("total"))
    draws = lines.sparkSession.range(1, size + 1).join(F.broadcast(total)).withColumn("at", F.floor((F.col("id") * step - F.floor(F.col("id") * step)) * F.col("total")))
    return F.broadcast(draws).join(upto, (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select(F.col("id").alias("draw"), *lines.columns)


def extrapolate(lines: DataFrame, verdicts: DataFrame, placed: DataFrame, after: int, size: int) -> DataFrame:
    """Garbage share of all sales: labelled sales of the head, and the share of garbage
    among weighted draws of the tail times the tail's sales."""
    head = lines.filter(F.col("place") <= after).join(verdicts, ["product_type", "line"], "left")
    first = head.agg(F.coalesce(F.sum("sales"), F.lit(0)).alias("head_sales"), F.coalesce(F.sum(F.when(F.col("verdict") == "not_model", F.col("sales"))), F.lit(0)).alias("head_garbage_sales"))
    tail = lines.filter(F.col("place") > after)
    rest = tail.agg(F.coalesce(F.sum("sales"), F.lit(0)).alias("tail_sales"))
    drawn = weighted_draws(tail, size).join(verdicts, ["product_type", "line"]).agg(F.coalesce(ratio(F.count_if(F.col("verdict") == "not_model"), F.count("*")), F.lit(0.0)).alias("tail_share"))
    sold = placed.agg(F.count_if("sold").alias("all_sales"))
    one = first.join(F.broadcast(rest)).join(F.broadcast(drawn)).join(F.broadcast(sold))
    garbage = F.round(F.col("head_garbage_sales") + F.col("tail_share") * F.col("tail_sales"))
    return one.select("head_sales", "head_garbage_sales", "tail_sales", half_up(F.col("tail_share"), 4).alias("tail_garbage_share"), part(garbage, F.col("head_sales") + F.col("tail_sales")).alias("garbage_share_of_model_sales"), part(garbage, F.col("all_sales")).alias("garbage_share_of_all_sales"))


def watched(placed: DataFrame, watches: DataFrame) -> DataFrame:
    """Sales of each watched partner by where they were placed. ``watches``: name, designer;
    a listing counts once for a partner however many of its designers match."""
    met = placed.filter("sold").select("listing_id", "kind", F.explode("designers").alias("designer")).join(F.broadcast(watches), "designer").select("name", "listing_id", "kind").distinct()
    bare = F.count_if(F.col("kind").isin("none", "descriptor"))
    return met.groupBy("name").agg(F.count("*").alias("sales"), bare.alias("none_sales"), part(bare, F.count("*")).alias("none_share"), F.count_if(F.col("kind") == "model").alias("model_sales"))


def coverage(placed: DataFrame) -> DataFrame:
    """Listings and sales by placement: the kind where it is no model, else the group's status."""
    status = F.when(F.col("kind").isin(*NO_MODEL), F.col("kind")).otherwise(F.col("group_status"))
    rows = placed.groupBy(status.alias("status")).agg(F.count("*").alias("listings"), F.count_if("sold").alias("sales"))
    whole = Window.partitionBy()  # a row for each status
    sold = F.sum("sales").over(whole)
    return rows.select("status", "listings", "sales", part(F.col("listings"), F.sum("listings").over(whole)).alias("listings_share"), part(F.col("sales"), sold).alias("sales_share"), part(F.sum(F.when(F.col("status") == "none", F.col("sales")).otherwise(0)).over(whole), sold).alias("no_model_share"), part(F.sum(F.when(F.col("status").isin("none", "review"), F.col("sales")).otherwise(0)).over(whole), sold).alias("no_model_or_review_share"))


def group_tally(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """By status and source: groups, those without listings, those without sales. Groups
    that no listing has count, too."""
    used = placed.groupBy("group_id").agg(F.count("*").alias("used"), F.count_if("sold").alias("sold"))
    rows = groups.join(used, "group_id", "left")
    return rows.groupBy("group_status", "source").agg(F.count("*").alias("groups"), F.count_if(F.col("used").isNull()).alias("empty"), F.count_if(F.coalesce("sold", F.lit(0)) == 0).alias("without_sales"))


def history(current: DataFrame, scratch: DataFrame) -> DataFrame:
    """Agreement of two passes: share of listings in the same group, and automatic groups of
    either. Both: listing_id, product_type, slug, group_status."""
    both = current.select("listing_id", F.struct("product_type", "slug").alias("a")).join(scratch.select("listing_id", F.struct("product_type", "slug").alias("b")), "listing_id", "left")
    same = both.agg(part(F.count_if(F.col("a").eqNullSafe(F.col("b"))), F.count("*")).alias("assignment_agreement"))
    auto = lambda rows, name: rows.filter("group_status = 'auto'").select("product_type", "slug").distinct().withColumn(name, F.lit(True))
    merged = auto(current, "mine").join(auto(scratch, "theirs"), ["product_type", "slug"], "full")
    counts = merged.agg(F.count("mine").alias("current_auto"), F.count("theirs").alias("scratch_auto"), F.count_if(F.col("mine") & F.col("theirs")).alias("in_both"))
    return same.join(F.broadcast(counts))


def lost(baseline: DataFrame, current: DataFrame, present: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Model groups of the baseline that are gone and whose sales have no model now.
    ``present``: product_type, slug of the live groups."""
    gone = baseline.filter("kind = 'model' and sold").join(present, ["product_type", "slug"], "left_anti")
    now = current.filter(F.col("kind").isin(*NO_MODEL)).select("listing_id")
    rows = gone.join(now, "listing_id", "left_semi").groupBy("product_type", "slug").agg(F.count("*").alias("lost_sales"))
    return rows.join(verdicts, ["product_type", "slug"], "left").select("product_type", "slug", "lost_sales", F.coalesce("verdict", F.lit("unlabeled")).alias("status"))


def codesigners(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Listings and sales of each designer beside the brand, with its class."""
    named = placed.select("sold", F.explode(F.array_distinct("designers")).alias("designer")).groupBy("designer").agg(F.count("*").alias("listings"), F.count_if("sold").alias("sales"))
    return named.join(classes, "designer", "left").select("designer", "listings", "sales", F.coalesce("class", F.lit("unlabeled")).alias("class"))


def agreement(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """One row: keys labelled in both, those that agree, the share with its interval, and
    the first five disagreements in the order of the key."""
    both = first.select(key, F.col(label).alias("a")).join(second.select(key, F.col(label).alias("b")), key)
    same = both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
    odd = both.filter("a <> b").orderBy(key).limit(5).agg(F.concat_ws(",", F.sort_array(F.collect_list(key))).alias("examples"))
    low, high = wilson(F.col("agreed"), F.col("n"))
    return same.join(F.broadcast(odd)).select("n", "agreed", part(F.col("agreed"), F.col("n")).alias("share"), low.alias("low"), high.alias("high"), "examples")


def check_targets(values: DataFrame) -> DataFrame:
    """Adds ``passed``. ``values``: metric, bound (min or max), goal, point, and n where it
    is a share, whose interval may miss the goal by ``MARGIN``."""
    low, high = wilson(F.round(F.col("point") * F.col("n")), F.col("n"))
    at_least = (F.col("point") >= F.col("goal")) & (F.col("n").isNull() | (low.cast("double") >= F.col("goal") - MARGIN))
    at_most = (F.col("point") <= F.col("goal")) & (F.col("n").isNull() | (high.cast("double") <= F.col("goal") + MARGIN))
    return values.withColumn("passed", F.coalesce(F.when(F.col("bound") == "min", at_least).otherwise(at_most), F.lit(False)))


#: States of a task that is over; ratios of a whole and of a usable collection.
DONE, COMPLETE, USABLE = ("done", "skipped", "truncated"), 0.98, 0.70


def run_state(tasks: DataFrame) -> DataFrame:
    """Of each run: tasks, those over, brands all of whose tasks are over, hits, the run's
    status, mean coverage and how it is spread."""
    over = F.col("status").isin(*DONE)
    brands = tasks.filter("brand_id is not null").groupBy("run_id", "brand_id").agg(F.bool_and(over).alias("whole")).groupBy("run_id").agg(F.count("*").alias("brands"), F.count_if("whole").alias("brands_completed"))
    failed, cut, good = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "truncated"), F.count_if(F.col("status").isin("done", "skipped"))
    c = F.col("coverage")
    rows = tasks.groupBy("run_id").agg(
        F.count("*").alias("tasks"), F.count_if(over).alias("tasks_done"), F.sum("hits").alias("hits"),
        F.when((failed > 0) & (good + cut == 0), "failed").when(failed + cut > 0, "partial").otherwise("completed").alias("status"),
        half_up(F.avg(c), 4).alias("coverage_avg"), F.count_if((c >= USABLE) & (c < COMPLETE)).alias("partial"), F.count_if(c < USABLE).alias("poor"), cut.alias("truncated"), F.count_if(F.col("expected_source") == "estimated").alias("estimated"),
    )
    return rows.join(brands, "run_id", "left")


def brand_coverage(tasks: DataFrame) -> DataFrame:
    return tasks.filter("brand_id is not null and coverage is not null").groupBy("run_id", "brand_id").agg(half_up(F.avg("coverage"), 4).alias("coverage"))


def task_coverage(expected: Column, collected: Column, truncated: Column) -> Column:
    """ratio (at most 1) and status of a collection; nothing expected is skipped."""
    share = F.least(ratio(collected, expected), F.lit(1.0))
    status = F.when(expected == 0, "skipped").when((share >= COMPLETE) & ~truncated, "complete").when(share >= USABLE, "partial").otherwise("poor")
    return F.struct(half_up(share, 4).alias("ratio"), status.alias("status"))


def eta(tasks: DataFrame, fetched: str, elapsed: str, least: int = 10) -> DataFrame:
    """Of each run the seconds left at its speed so far; a lower bound while a task that
    isn't over doesn't know what to expect. Columns ``fetched`` and ``elapsed`` are of the run."""
    open_ = ~F.col("status").isin(*DONE, "failed")
    left = F.greatest(F.coalesce("expected", F.lit(0)) - F.col("hits"), F.lit(0))
    rows = tasks.groupBy("run_id").agg(F.sum("expected").alias("hits_expected"), F.count_if(open_).alias("open"), F.count_if(open_ & F.col("expected").isNull()).alias("unknown"), F.sum(F.when(open_, left)).alias("remaining"), F.max(fetched).alias("_got"), F.max(elapsed).alias("_took"))
    speed = F.when(F.col("_took") >= least, F.col("_got") / F.col("_took").cast("double")).otherwise(0.0)
    blind = (speed <= 0) | (F.col("open") == F.col("unknown"))
    seconds = F.when(F.col("open") == 0, F.lit(0).cast("long")).when(blind, None).otherwise(F.bround(F.col("remaining") / speed).cast("long"))
    return rows.select("run_id", "hits_expected", half_up(speed, 4).alias("hits_per_second"), seconds.alias("eta_seconds"), ((F.col("open") > 0) & (F.col("unknown") > 0)).alias("is_lower_bound"))


def pooled(rows: DataFrame, *by: str) -> DataFrame:
    """Sold over cohort of all rows together."""
    return rows.groupBy(*by).agg(half_up(ratio(F.sum("p30_sold"), F.sum("p30_cohort")), 6).alias("rate"))


def forward(then_active: DataFrame, sold_later: Column, least: int = 5) -> DataFrame:
    """Of each scope the share of what was on sale that sold afterwards; null of too few."""
    return then_active.groupBy("scope_key").agg(F.count("*").alias("active"), F.when(F.count("*") >= least, half_up(ratio(F.count_if(sold_later), F.count("*")), 6)).alias("forward"))


def covered(first_sales: DataFrame, months: DataFrame, upto: Column) -> DataFrame:
    """Each month of a range against the span of the data: missing, or the days that are
    covered, and how many brands start after the first covered month."""
    span = first_sales.agg(F.min("first").alias("data_from"))
    start = F.trunc(F.greatest(F.col("_first_month"), F.col("data_from")), "MM")
    first_month = months.agg(F.min("month").alias("_first_month"))
    late = first_sales.join(F.broadcast(span)).join(F.broadcast(first_month)).agg(F.count_if(F.trunc("first", "MM") > start).alias("late_brands"))
    rows = months.join(F.broadcast(span)).join(F.broadcast(late)).withColumns({"data_to": upto, "end": F.last_day("month")})
    missing = (F.col("end") < F.col("data_from")) | (F.col("month") > F.col("data_to"))
    first = F.when(F.col("month") == F.trunc("data_from", "MM"), F.dayofmonth("data_from")).otherwise(1)
    last = F.when(F.col("month") == F.trunc("data_to", "MM"), F.dayofmonth("data_to")).otherwise(F.dayofmonth("end"))
    part_ = (first > 1) | (last < F.dayofmonth("end"))
    state = F.when(missing, "missing").when(part_, "partial").otherwise("whole")
    return rows.select("month", state.alias("state"), F.when(state == "partial", first).alias("from_day"), F.when(state == "partial", last).alias("to_day"), "late_brands")


def partners(placed: DataFrame, names: DataFrame) -> DataFrame:
    """Of each partner: listings whose designers name it, those without a place and their
    sales, kinds, and the five newest titles."""
    met = placed.select("listing_id", "sold", "kind", "title", F.explode("designers").alias("designer")).join(F.broadcast(names), "designer").dropDuplicates(["partner", "listing_id"])
    bare = F.col("kind").isin("none", "descriptor")
    newest = F.slice(F.sort_array(F.collect_list(F.struct("listing_id", "title")), asc=False), 1, 5)
    place = Window.partitionBy("partner").orderBy(F.desc("listing_id"))
    top = met.withColumn("_n", F.row_number().over(place)).filter("_n <= 5").groupBy("partner").agg(F.concat_ws(" | ", newest["title"]).alias("examples"))
    counted = met.groupBy("partner").agg(F.count("*").alias("listings"), F.count_if(bare).alias("unplaced"), F.count_if(bare & F.col("sold")).alias("unplaced_sales"), F.count_if(F.col("kind") == "model").alias("models"))
    return counted.join(top, "partner")


def brand_report(placed: DataFrame, top: int) -> DataFrame:
    """Of each brand: shares by kind, titles of more than one type, and its first groups."""
    kinds = placed.groupBy("brand_id").agg(F.count("*").alias("listings"), part(F.count_if(F.col("kind") == "model"), F.count("*")).alias("model_share"), part(F.count_if(F.col("kind") == "none"), F.count("*")).alias("none_share"))
    mixed = placed.groupBy("brand_id", "title").agg((F.count_distinct("product_type") > 1).alias("mixed")).groupBy("brand_id").agg(F.count_if("mixed").alias("mixed_titles"))
    groups = placed.filter("kind = 'model'").groupBy("brand_id", "title").agg(F.count("*").alias("n"))
    place = Window.partitionBy("brand_id").orderBy(F.desc("n"), "title")
    first = groups.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top).groupBy("brand_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]), " | ").alias("first_groups"))
    return kinds.join(mixed, "brand_id").join(first, "brand_id", "left")


def majority_scope(placed: DataFrame) -> DataFrame:
    """The most frequent brand and type of each model, the smallest on a tie."""
    seen = placed.groupBy("title", "brand_id", "product_type").agg(F.count("*").alias("n"))
    return seen.groupBy("title").agg(F.min_by(F.struct("brand_id", "product_type"), F.struct(-F.col("n"), "brand_id", "product_type")).alias("s")).select("title", "s.*")


def scan_targets(brands: DataFrame, mappings: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """Brands to scan, with their names at the source and the moment to read from: five
    minutes before the last scan, 24 hours back at most. ``mappings``: brand_id, name,
    verified, rejected, subbrand."""
    usable = mappings.filter("verified and not rejected").join(brands.select("brand_id", "include_subbrands"), "brand_id").filter("include_subbrands or not subbrand")
    names = usable.groupBy("brand_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))
    since = F.greatest(F.col("scanned_to") - F.expr("INTERVAL '5' MINUTE"), now - F.expr("INTERVAL '24' HOUR"))
    return brands.join(names, "brand_id").join(scanned, "brand_id", "left").select("brand_id", "names", F.coalesce(since, now - F.expr("INTERVAL '24' HOUR")).alias("since"))


def changed_between(hits: DataFrame, since: Column, until: Column) -> DataFrame:
    """Hits created or repriced in (since, until], each once."""
    inside = lambda c: (F.col(c) > since) & (F.col(c) <= until)
    return hits.filter(inside("created") | inside("repriced")).dropDuplicates(["id"])


def run_tasks(brands: DataFrame, watermarks: DataFrame, full: bool = False) -> DataFrame:
    """Tasks of a run: of each mapped brand a whole scan of what is active and an incremental
    one of what is sold, from two hours before its watermark; unmapped brands give a warning."""
    kinds = F.explode(F.array(F.lit("active"), F.lit("sold"))).alias("index_type")
    tasks = brands.select("brand_id", "mapped", kinds).join(watermarks, ["brand_id", "index_type"], "left")
    bound = F.when((F.col("index_type") == "sold") & F.lit(not full), F.col("watermark") - F.expr("INTERVAL '2' HOUR"))
    return tasks.select("brand_id", "index_type", F.when(F.col("mapped"), bound).alias("after"), F.when(F.col("mapped"), "pending").otherwise("skipped").alias("status"))


def months_of(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL '1' MONTH"))


def first_sales(listings: DataFrame) -> DataFrame:
    return listings.filter("status = 'sold' and sold_at is not null").groupBy("brand_id").agg(F.min(F.col("sold_at").cast("date")).alias("first"))

