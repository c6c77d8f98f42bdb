"""Pieces of the DuckDB SQL that checks the queries."""

from __future__ import annotations

from souk.sources.listings import LISTINGS_SQL

NOW = "TIMESTAMP '1998-06-01'"

SCOPED_SQL = (
    LISTINGS_SQL
    + """, scoped AS (
  SELECT *, 'brand' AS level, 'brand:' || brand_id AS scope_key FROM listings
  UNION ALL SELECT *, 'type', 'type:' || brand_id || ':' || product_type FROM listings
  UNION ALL SELECT *, 'line', 'line:' || brand_id || ':' || product_type || ':' || line FROM listings
  UNION ALL SELECT *, 'model', 'model:' || brand_id || ':' || product_type || ':' || model FROM listings
)"""
)
PRICE = "coalesce(nullif(sold_price, 0), price)"
DAYS = "greatest(epoch(sold_at - listed_at) / 86400.0, 0)"


def sold(days: int) -> str:
    return f"(status = 'sold' AND sold_at <= {NOW} AND sold_at >= {NOW} - INTERVAL {days} DAY)"


def up(x: str, places: int) -> str:
    """Half up, as a double."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,8)), {places}) AS DOUBLE)"


def even(x: str, places: int) -> str:
    """Half even, as a double."""
    n, step = f"CAST(CAST({x} AS DECIMAL(24,8)) * 100000000 AS BIGINT)", 10 ** (8 - places)
    return f"(({n} // {step} + CASE WHEN {n} % {step} > {step // 2} OR ({n} % {step} = {step // 2} AND ({n} // {step}) % 2 = 1) THEN 1 ELSE 0 END) / {10**places}.0)"


def over(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def quantile(x: str, q: float = 0.5, places: int = 2, where: str = "") -> str:
    return up(f"quantile_cont(CAST({x} AS DOUBLE), {q})" + (f" FILTER (WHERE {where})" if where else ""), places)


def query(body: str, scoped: bool = True, more: str = "") -> str:
    return f"WITH {SCOPED_SQL if scoped else LISTINGS_SQL}{', ' + more if more else ''}\n{body}"


#: One letter, a hyphen and three letters or more, unless the hyphens go on, as one word. Twice, since
#: neighbours share what parts them.
_HYPHENED = r"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}''’]|(?:^|[^\p{{L}}\p{{N}}])[''’]+)(\p{{L}})-(\p{{L}}{{3,}}(?:[''’][\p{{L}}\p{{N}}]+)*)($|-$|-[^\p{{L}}\p{{N}}]|[^\p{{L}}\p{{N}}-])', '\1\2\3\4', 'g')"


def words(x: str) -> str:
    """The list of folded, singular tokens of a text."""
    whole = _HYPHENED.format(x=_HYPHENED.format(x=x))
    found = rf"regexp_extract_all({whole}, '\d+\.\d+|#\d+|[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"
    folded = f"list_transform({found}, lambda t: replace(replace(replace(strip_accents(lower(t)), '''', ''), '’', ''), 'ß', 'ss'))"
    return rf"""flatten(list_transform({folded}, lambda t: CASE
  WHEN contains(t, '.') THEN [regexp_replace(t, '\.0+$', '')]
  WHEN regexp_matches(t, '^[a-z]{{3,}}\d$') THEN [t[:-2], t[-1:]]
  WHEN NOT regexp_matches(t, '^\p{{L}}{{4,}}$') THEN [t]
  WHEN length(t) >= 5 AND t LIKE '%ies' THEN [t[:-4] || 'y']
  WHEN regexp_matches(t, '(ss|sh|ch|x)es$') THEN [t[:-3]]
  WHEN regexp_matches(t, '[^suio]s$') THEN [t[:-2]] ELSE [t] END))"""


def ngrams(tokens: str, longest: int = 3) -> str:
    """All runs of 1 .. ``longest`` tokens, joined by blanks, the short ones first."""
    runs = (f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i : i + {n - 1}], ' '))" for n in range(1, longest + 1))
    return f"flatten([{', '.join(runs)}])"


#: Joins a phrase's support s to that of its parts, the words but the last (h) and but the first (t).
PARTS = """LEFT JOIN support h ON h.product_type = s.product_type AND s.n_words > 1 AND h.phrase = array_to_string(string_split(s.phrase, ' ')[: s.n_words - 1], ' ')
LEFT JOIN support t ON t.product_type = s.product_type AND s.n_words > 1 AND t.phrase = array_to_string(string_split(s.phrase, ' ')[2 :], ' ')
WHERE s.sellers >= coalesce(0.5 * h.sellers, 0) AND s.sellers >= coalesce(0.5 * t.sellers, 0)"""


def support(name: str) -> str:
    """CTEs from ``titles`` (product_type, listing_id, seller, title) to the support of each run of words."""
    return f"""split AS (SELECT product_type, listing_id, seller, {words("title")} AS w FROM titles),
runs AS MATERIALIZED (SELECT product_type, listing_id, seller, unnest(list_distinct({ngrams("w")})) AS phrase FROM split),
{name} AS MATERIALIZED (SELECT product_type, phrase, count(*) AS listings, count(DISTINCT seller) AS sellers, CAST(len(string_split(phrase, ' ')) AS INT) AS n_words FROM runs GROUP BY product_type, phrase)"""


def mined(sellers: int, limit: int = 1000) -> str:
    """CTEs from ``titles`` to ``mined``: the phrases that name models, by lengths from the longest down."""

    def level(n: int) -> str:
        longer = " UNION ALL ".join(f"SELECT product_type, phrase FROM level{k}" for k in range(n + 1, 4)) or "SELECT product_type, phrase FROM candidates WHERE false"
        return f"""covered{n} AS (SELECT DISTINCT product_type, listing_id, unnest({ngrams("parts", n)}) AS phrase FROM (SELECT g.product_type, listing_id, string_split(phrase, ' ') AS parts FROM grams g JOIN ({longer}) USING (product_type, phrase))),
level{n} AS MATERIALIZED (SELECT c.product_type, c.phrase, c.sellers, c.n_words, count(DISTINCT g.seller) AS own FROM candidates c JOIN grams g ON g.product_type = c.product_type AND g.phrase = c.phrase
  ANTI JOIN covered{n} v ON v.product_type = g.product_type AND v.listing_id = g.listing_id AND v.phrase = g.phrase WHERE c.n_words = {n} GROUP BY ALL HAVING count(DISTINCT g.seller) >= {sellers})"""

    return rf"""{support("counted")},
support AS MATERIALIZED (SELECT * FROM counted WHERE NOT regexp_matches(phrase, '(^| )(\d+( |$)|#)') AND CASE WHEN n_words = 1 THEN length(phrase) >= 3 ELSE length(string_split(phrase, ' ')[1]) >= 2 AND length(string_split(phrase, ' ')[-1]) >= 2 END),
candidates AS MATERIALIZED (SELECT s.* FROM support s {PARTS} AND s.sellers >= {sellers}),
grams AS MATERIALIZED (SELECT r.* FROM runs r SEMI JOIN candidates c ON c.product_type = r.product_type AND c.phrase = r.phrase),
{level(3)}, {level(2)}, {level(1)},
accepted AS (SELECT *, replace(phrase, ' ', '') AS glued FROM (FROM level3 UNION ALL FROM level2 UNION ALL FROM level1)),
winners AS (SELECT product_type, glued, max(struct_pack(s := sellers, n := n_words, p := phrase)) AS m, sum(own) AS own FROM accepted GROUP BY product_type, glued),
forms AS (SELECT s.product_type, s.phrase, m.p AS winner, m.n AS n_words, m.s AS most, own FROM support s JOIN winners w ON w.product_type = s.product_type AND w.glued = replace(s.phrase, ' ', '')),
seen AS (SELECT f.product_type, winner, count(DISTINCT listing_id) AS listings, count(DISTINCT seller) AS sellers FROM forms f JOIN runs r ON r.product_type = f.product_type AND r.phrase = f.phrase GROUP BY f.product_type, winner),
named AS (SELECT product_type, winner, n_words, most, own, list_sort(coalesce(list(phrase) FILTER (phrase <> winner), [])) AS variants FROM forms GROUP BY product_type, winner, n_words, most, own),
mined AS (SELECT product_type, winner AS phrase, CAST(least(own, sellers) AS BIGINT) AS own_sellers, listings, sellers, n_words, variants, CAST(row_number() OVER (PARTITION BY product_type ORDER BY most DESC, winner) AS INT) AS place
  FROM named JOIN seen USING (product_type, winner) QUALIFY place <= {limit})"""
