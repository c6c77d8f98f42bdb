"""From titles to models: words that name no model are taken out, what is left is looked
up in a dictionary as written, glued, or with a typo corrected, and placed.

Phrases are found by equi-joins of a title's runs of words with phrase tables, once for
each distinct title; what then has to be decided from left to right (which hits stand,
which neighbours are glued) is a fold over one title's few hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import article_code, words
from souk.sources.scratch import stored

#: Words of the longest phrase; letters and likeness that a typo's word needs.
LONGEST, FUZZY_LETTERS, FUZZY_SCORE = 4, 5, 90.0
SIZE_MARKERS, SIZE_LETTERS = ("size", "sz"), ("xxs", "xs", "s", "m", "l", "xl", "xxl")
ATTACHED_SIZE = r"^(?:size|sz|eu|us|uk|it|fr|jp|w|l)\d+(?:\.\d+)?$|^\d+(?:\.\d+)?(?:eu|us|uk|it|fr|jp|cm|mm)$"
NUMERIC = r"^(?:(?:19|20)\d{2}|(?:ss|fw|aw|sp|fa|pf)\d{2,4}|.*\..*|[1-9]\d)$"


def positions(rows: DataFrame, tokens: str, *keep: str, longest: int = LONGEST) -> DataFrame:
    """The runs of a title's words with their start (from 0) and number of words."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase")))).otherwise(F.array().cast("array<struct<start:int,n:int,phrase:string>>"))))
    return rows.select(*keep, F.explode(runs).alias("r")).select(*keep, "r.*")


def cover(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``rows``: title, tokens. Takes out, from left to right, the longest phrase at each
    place. ``phrases``: phrase, kind, of, rank; of equal phrases the least rank counts.
    Adds ``hits`` (kind, of, in order)."""
    one = phrases.groupBy("phrase").agg(F.min_by(F.struct("kind", "of"), "rank").alias("what"))
    met = positions(rows, "tokens", "title").join(one, "phrase").groupBy("title", "start").agg(F.max_by(F.struct("n", "what"), "n").alias("h"))
    found = met.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("start", F.col("h.n").alias("n"), F.col("h.what.kind").alias("kind"), F.col("h.what.of").alias("of")))).alias("found"))
    none = F.array().cast("array<struct<start:int,n:int,kind:string,of:string>>")
    stands = F.aggregate("found", F.struct(F.lit(0).alias("free"), none.alias("hits")), lambda s, h: F.when(h["start"] >= s["free"], F.struct((h["start"] + h["n"]).alias("free"), F.array_append(s["hits"], h).alias("hits"))).otherwise(s))
    out = rows.join(found, "title", "left").withColumn("hits", F.coalesce(F.when(F.col("found").isNotNull(), stands["hits"]), none)).drop("found")
    kept = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~F.exists("hits", lambda h: (x["i"] >= h["start"]) & (x["i"] < h["start"] + h["n"])))
    return out.withColumn("tokens", F.transform(kept, lambda x: x["t"]))


def without_sizes(tokens: Column) -> Column:
    """Attached sizes go, and markers with the size that follows them."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("marked"))
    value = lambda t: t.isin(*SIZE_LETTERS) | t.rlike(r"^\d")
    def step(s: Column, t: Column) -> Column:
        marker, attached = t.isin(*SIZE_MARKERS), t.rlike(ATTACHED_SIZE)
        goes = attached | marker | (s["marked"] & value(t))
        return F.struct(F.when(goes, s["out"]).otherwise(F.array_append(s["out"], t)).alias("out"), (marker & ~(s["marked"] & value(t)) & ~attached).alias("marked"))

    return F.aggregate(tokens, start, step)["out"]


def normalize(titles: DataFrame, brand: DataFrame, lexicon: DataFrame) -> DataFrame:
    """title, tokens (of a model's name), strong and weak (types named in the title), for
    each distinct title. Both tables as ``cover`` reads them; a lexicon's kinds are strong,
    weak (``of``: the type), color, noise and stop."""
    base = titles.select("title").distinct().withColumn("tokens", words(F.col("title")))
    bare = cover(base, brand).drop("hits").withColumn("tokens", without_sizes(F.col("tokens")))
    done = cover(stored(bare, "bare"), lexicon)
    of = lambda kind: F.array_distinct(F.transform(F.filter("hits", lambda h: h["kind"] == kind), lambda h: h["of"]))
    model = F.filter("tokens", lambda t: ~t.rlike(NUMERIC) & ~article_code(t))
    return done.select("title", model.alias("tokens"), of("strong").alias("strong"), of("weak").alias("weak"))


def _best(rows: DataFrame, dictionary: DataFrame, tokens: str) -> DataFrame:
    """Of each title and type the best phrase: most words, confirmed, least key, leftmost."""
    met = positions(rows, tokens, "title", "product_type").join(dictionary, ["product_type", "phrase"])
    rank = F.struct("n", "confirmed", -F.col("key"), -F.col("start"))
    return met.groupBy("title", "product_type").agg(F.max_by(F.struct("key", "start", "n"), rank).alias("m"))


def glued(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``joined`` and ``widths``: neighbours that together are a confirmed one-word
    name are one word, from left to right."""
    solid = dictionary.filter("confirmed and phrase not like '% %'").select("product_type", F.col("phrase").alias("pair")).distinct()
    pairs = rows.filter("size(tokens) > 1").select("title", "product_type", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat(F.element_at("tokens", i), F.element_at("tokens", i + 1)))).alias("at", "pair"))
    spots = pairs.join(solid, ["product_type", "pair"]).groupBy("title", "product_type").agg(F.collect_set("at").alias("spots"))
    start = F.struct(F.array().cast("array<string>").alias("words"), F.array().cast("array<int>").alias("widths"), F.lit(-1).alias("done"))
    def step(s: Column, x: Column) -> Column:
        pair = F.coalesce(F.array_contains("spots", x["i"]), F.lit(False))
        word = F.when(pair, F.concat(x["t"], F.coalesce(F.get("tokens", x["i"] + 1), F.lit("")))).otherwise(x["t"])
        return F.when(x["i"] <= s["done"], s).otherwise(F.struct(F.array_append(s["words"], word).alias("words"), F.array_append(s["widths"], F.when(pair, 2).otherwise(1)).alias("widths"), (x["i"] + pair.cast("int")).alias("done")))

    held = F.aggregate(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), start, step)
    return rows.join(spots, ["title", "product_type"], "left").withColumn("_g", held).withColumns({"joined": F.col("_g.words"), "widths": F.col("_g.widths")}).drop("_g", "spots")


def corrected(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` with words one slip away from a word of the dictionary put right. Words of
    nearly the same spelling meet by what is left of both when one letter is dropped, so no
    word is held against a whole vocabulary; two words of over 20 letters that are two slips
    apart don't meet."""
    usable = lambda c: (F.length(c) >= FUZZY_LETTERS) & ~F.col(c).rlike(r"^\d+$")
    keys = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))
    vocabulary = dictionary.select("product_type", F.explode(F.split("phrase", " ")).alias("known")).distinct().filter(usable("known"))
    asked = rows.select("product_type", F.explode("tokens").alias("word")).distinct().filter(usable("word"))
    met = asked.withColumn("k", F.explode(keys("word"))).join(vocabulary.withColumn("k", F.explode(keys("known"))), ["product_type", "k"])
    a, b = F.length("word"), F.length("known")
    common = F.when(F.col("word") == F.col("known"), a).when(a == b, a - 1).otherwise(F.least(a, b))
    near = met.filter(F.abs(a - b) <= 1).withColumn("score", 200.0 * common / (a + b)).filter(F.col("score") >= FUZZY_SCORE)
    right = near.groupBy("product_type", "word").agg(F.max_by("known", F.struct("score", "known")).alias("right"))
    each = rows.select("title", "product_type", F.posexplode("tokens").alias("at", "word")).join(right, ["product_type", "word"], "left")
    return each.groupBy("title", "product_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))), lambda x: x["w"]).alias("tokens"))


def one_entry(dictionary: DataFrame) -> DataFrame:
    """Of equal phrases of a type a confirmed model's stays, then the one of the least key."""
    return dictionary.groupBy("product_type", "phrase").agg(F.min_by(F.struct("key", "confirmed", "parent"), F.struct(~F.col("confirmed"), "key")).alias("e")).select("product_type", "phrase", "e.*")


def search(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """title, product_type, used (the words searched), m (key, start, n in them), covered
    (words of the title). A glued match counts only if it covers more words than the one as
    written. ``dictionary``: one entry for each phrase of a type."""
    by = ["title", "product_type"]
    both = stored(glued(rows, dictionary), "glued")
    plain = _best(both, dictionary, "tokens").withColumnRenamed("m", "p")
    joined = _best(both.filter("size(joined) < size(tokens)"), dictionary, "joined").withColumnRenamed("m", "g")
    out = both.join(plain, by, "left").join(joined, by, "left").filter("p is not null or g is not null")
    width = F.aggregate(F.slice("widths", F.col("g.start") + 1, F.col("g.n")), F.lit(0), lambda s, x: s + x)
    wins = F.col("g").isNotNull() & (F.col("p").isNull() | (width > F.col("p.n")))
    pick = lambda a, b: F.when(wins, a).otherwise(b)
    return out.select(*by, pick(F.col("joined"), F.col("tokens")).alias("used"), pick(F.col("g"), F.col("p")).alias("m"), pick(width, F.col("p.n")).alias("covered"))


def match(rows: DataFrame, dictionary: DataFrame, protected: tuple[str, ...] = (), versions: tuple[str, ...] = ()) -> DataFrame:
    """title, product_type, key, matched, fuzzy, version. ``rows``: title, product_type,
    tokens. ``dictionary``: product_type, phrase, key, confirmed, parent."""
    dictionary, by = one_entry(dictionary), ["title", "product_type"]
    rows = stored(rows.select(*by, "tokens"), "asked")
    written = stored(search(rows, dictionary).withColumn("fuzzy", F.lit(False)), "written")
    rest = rows.join(written.select(*by), by, "left_anti")
    misspelt = search(corrected(rest, dictionary), dictionary).withColumn("fuzzy", F.lit(True))
    found = written.unionByName(misspelt).join(dictionary.select("key", "parent").distinct(), F.col("m.key") == F.col("key")).drop("key")
    start, n = F.col("m.start"), F.col("m.n")
    before = F.filter(F.slice("used", F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2))), lambda t: t.isin(*protected) if protected else F.lit(False))
    after = F.get("used", start + n)
    number = F.when((after.isin(*versions) if versions else F.lit(False)) | after.rlike("^#."), after)
    own = F.slice("used", start + 1, n)
    version = F.when(F.col("parent").isNull() & ((F.size(before) > 0) | number.isNotNull()), F.array_join(F.concat(before, own, F.array_compact(F.array(number))), " "))
    return found.select(*by, F.col("m.key").alias("key"), F.array_join(own, " ").alias("matched"), "fuzzy", version.alias("version"))


def place(listings: DataFrame, matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """listing_id, key, version, method: a person's decision first, then nothing for what is
    under review, then the dictionary, then none. ``overrides``: listing_id, key."""
    out = listings.join(overrides.withColumnRenamed("key", "_own"), "listing_id", "left").join(matches, ["title", "product_type"], "left")
    method = F.when(F.col("_own").isNotNull(), "override").when(F.col("product_type") == "review", "review").when(F.col("key").isNull(), "none").when(F.col("fuzzy"), "fuzzy").otherwise("phrase")
    dictionary = method.isin("phrase", "fuzzy")
    return out.select("listing_id", F.when(method == "override", F.col("_own")).when(dictionary, F.col("key")).alias("key"), F.when(dictionary, F.col("version")).alias("version"), method.alias("method"))
