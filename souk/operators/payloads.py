"""Raw payloads: paths, lists, what must not be kept, market fields; and rewrites of
stored rows by the current rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import clean, looks_replica
from souk.operators.ingest import flag, money, rating, timestamp

#: Keys that tell who or where a person is; a key that does so inside a seller.
PERSONAL = ("username", "seller_username", "seller_id", "email", "latitude", "longitude", "coordinates", "address", "city", "state", "postal_code", "postcode", "zip", "zipcode")
OWNERS = ("seller", "user")


def each(payload: Column, array: str, path: str) -> Column:
    """The texts at ``path`` of each element of the array at ``array``; empty ones dropped."""
    found = F.try_variant_get(F.try_parse_json(payload), array, "array<variant>")
    return strings(F.transform(found, lambda x: F.try_variant_get(x, path, "string")))


def strings(values: Column) -> Column:
    """Cleaned texts without empty ones; nothing for null."""
    return F.coalesce(F.filter(F.transform(values, clean), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def last_text(values: Column) -> Column:
    """The last element of a list."""
    return clean(F.try_element_at(values, F.lit(-1)))


def first_value(payload: Column, *paths: str, default: str | None = None) -> Column:
    """The first path with a value that isn't empty, else the default."""
    parsed = F.try_parse_json(payload)
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(parsed, p, "string")), F.lit("")) for p in paths), F.lit(default))


def category_path(raw: Column, category: Column, subcategory: Column) -> Column:
    """``department.subcategory`` in lower case, from whichever field has it."""
    dotted = lambda c: F.when(c.contains("."), c)
    joined = F.when(category.isNotNull() & subcategory.isNotNull() & ~F.coalesce(subcategory.contains(" "), F.lit(False)), F.concat_ws(".", category, subcategory))
    return F.lower(F.nullif(F.coalesce(dotted(raw), dotted(subcategory), joined, raw, category), F.lit("")))


def count_of(value: Column) -> Column:
    """A whole number of at least 0, else null."""
    number = value.try_cast("bigint")
    return F.when(number >= 0, number)


def amounts(payload: Column, path: str) -> Column:
    """The positive amounts of a list."""
    found = F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")
    return F.filter(F.transform(found, lambda x: money(F.try_variant_get(x, "$", "string"))), lambda x: x > 0)


def market_fields(hits: DataFrame, payload: str = "payload", price: str = "price", rate: str = "fx_rate") -> DataFrame:
    """Columns of one hit: the first price and how often it fell on the way to ``price``
    (earlier prices are listed oldest first), amounts in USD by ``rate`` (null: they are),
    flags, ratings and counts."""
    text = lambda *paths: first_value(F.col(payload), *paths)
    usd = lambda c: F.coalesce(F.round(c * F.col(rate), 2), c).cast("decimal(14,2)")
    amount = lambda *paths: F.when(money(text(*paths)) >= 0, money(text(*paths)))
    drops = F.coalesce(amounts(F.col(payload), "$.price_drops"), F.array().cast("array<decimal(14,2)>"))
    way = F.concat(drops, F.array(F.col(price).cast("decimal(14,2)")))
    fell = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.size(way) - 1), lambda i: (i > 0) & (F.get(way, i) < F.get(way, i - 1))), lambda x: x))
    return hits.withColumns({
        "price_initial": usd(F.get(way, F.lit(0))), "price_drop_count": fell, "price_updated_at": timestamp(text("$.price_updated_at")), "ship_domestic": usd(amount("$.shipping.us.amount")),
        "makeoffer": flag(text("$.makeoffer")), "department": F.nullif(F.substr(text("$.department"), F.lit(1), F.lit(32)), F.lit("")), "seller_rating_avg": rating(text("$.user.rating")), "seller_rating_count": count_of(text("$.user.ratings")), "seller_trusted": flag(text("$.user.trusted")),
    })


def pseudonym(name: Column, salt: str | None, mode: str = "hashed") -> Column:
    """Who a seller is, as settings allow: nothing, a salted hash, or the name. Blanks are
    collapsed and case doesn't count."""
    if mode not in ("none", "hashed", "plain"):
        raise ValueError("mode must be none, hashed or plain")
    known = F.nullif(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(""))
    if mode == "none":
        return F.lit(None).cast("string")
    return known if mode == "plain" else F.sha2(F.concat(known, F.lit("\0"), F.lit(salt or "")), 256)


def scrub(value: object, inside: tuple[str, ...] = ()) -> object:
    """A JSON value without personal keys; of a location only its country code stays."""
    if isinstance(value, list):
        return [scrub(x, inside) for x in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, item in value.items():
        name = key.casefold()
        if name == "location":
            place = " ".join(item.split()) if isinstance(item, str) else ""
            if len(place) == 2:
                out[key] = place.upper()
        elif name not in PERSONAL and not (name == "id" and any(o in inside for o in OWNERS)):
            out[key] = scrub(item, (*inside, name))
    return out


def without_persons(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads of any depth without what tells who or where a person is; no JSON, no
    payload. The nesting has no bound, which built-in functions can't follow, so this is a
    Python map over Arrow batches."""
    def clean_one(text: str | None) -> str | None:
        try:
            return json.dumps(scrub(json.loads(text)), separators=(",", ":"), ensure_ascii=False) if text else None
        except ValueError:
            return None

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(clean_one)

    return rows.withColumn(payload, F.pandas_udf(work, "string")(payload))


def reflag(listings: DataFrame, mark: str = "possible_replica") -> DataFrame:
    """Takes a mark off where today's rule no longer finds it; never adds it. Adds ``cleared``."""
    gone = F.array_contains("flags", mark) & ~F.coalesce(looks_replica(F.col("title"), F.col("description"), F.col("brand")), F.lit(False))
    return listings.withColumn("cleared", gone).withColumn("flags", F.when(gone, F.array_remove("flags", mark)).otherwise(F.col("flags")))


def backfill(listings: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Columns filled from the payload where they are still null."""
    return listings.withColumns({name: F.coalesce(name, value) for name, value in fields.items()})


def import_sheet(held: DataFrame, sheet: DataFrame, *key: str) -> DataFrame:
    """Rows of a filled sheet whose keys are new; keys held are never replaced, and of equal
    keys in the sheet one is taken, the least."""
    value = [c for c in held.columns if c not in key]
    fresh = sheet.groupBy(*key).agg(F.min(F.struct(*value)).alias("_v")).select(*key, "_v.*")
    return held.unionByName(fresh.join(held.select(*key), list(key), "left_anti").select(*held.columns))


def upsert_counts(held: DataFrame, batch: DataFrame, key: str, price: str, order: str) -> DataFrame:
    """inserted, updated and repriced of a batch; of repeated keys the last counts."""
    last = batch.groupBy(key).agg(F.max_by(price, order).alias("_new"))
    both = last.join(held.select(key, F.col(price).alias("_old"), F.lit(True).alias("_held")), key, "left")
    return both.agg(F.count_if(F.col("_held").isNull()).alias("inserted"), F.count_if(F.col("_held")).alias("updated"), F.count_if(F.col("_held") & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("repriced"))


def merged_names(name: Column, *lists: Column) -> Column:
    """The distinct texts of all lists in order, without the name itself and empty ones."""
    return F.array_remove(F.array_distinct(strings(F.concat(*lists))), name)


def contains_run(longer: Column, shorter: Column) -> Column:
    """Whether an array is a run inside a longer one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(longer) - F.size(shorter) + 1, F.lit(1)))
    return (F.size(shorter) < F.size(longer)) & F.exists(starts, lambda i: F.slice(longer, i, F.size(shorter)) == shorter)


def covered_mask(tokens: Column, words: list[str], phrases: list[list[str]]) -> Column:
    """For each token whether it is a forbidden word or part of a forbidden phrase."""
    hit = lambda i: F.coalesce(F.get(tokens, i).isin(words), F.lit(False))
    def inside(i: Column) -> Column:
        out = hit(i)
        for p in phrases:
            for k in range(len(p)):
                out = out | (F.slice(tokens, F.greatest(i - k + 1, F.lit(1)), F.lit(len(p))) == F.array(*map(F.lit, p))) & (i >= k)
        return out

    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), inside)).otherwise(F.array().cast("array<boolean>"))


def splits_into(tokens: Column, words: list[str], phrases: list[list[str]]) -> Column:
    """Whether tokens split wholly into generic words and phrases: the places that can be
    reached from the start, one after another."""
    pieces = [[w] for w in words] + phrases
    def step(reached: Column, i: Column) -> Column:
        new = F.lit(False)
        for p in pieces:
            new = new | (F.array_contains(reached, i - len(p)) & (i >= len(p)) & (F.slice(tokens, F.greatest(i - len(p) + 1, F.lit(1)), F.lit(len(p))) == F.array(*map(F.lit, p))))
        return F.when(new, F.array_append(reached, i)).otherwise(reached)

    reached = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit(0)), step)
    return (F.size(tokens) > 0) & F.array_contains(reached, F.size(tokens))
