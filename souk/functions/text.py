"""Text rules as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks copies and lots.
REPLICA = r"(?i)\b(rep|replica|1:1|unauthorized|dhgate)\b"
INSPIRED_BY = r"(?i)\binspired\s+by\b"
LOT = r"(?i)\b(bundle|lot of|x\s?\d+|set of|read description)\b"
#: A token, fixed: a decimal, a number with #, one letter with a hyphen and three letters or
#: more (unless the hyphens go on), or letters and digits with inner apostrophes.
WORD = r"\d+\.\d+|#\d+|(?<![\p{L}\p{N}])\p{L}-\p{L}{3,}(?:['’][\p{L}\p{N}]+)*(?![\p{L}\p{N}]|-[\p{L}\p{N}])|[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
#: Letter sizes, and US sizes of EU footwear: fixed values.
LETTER_SIZES = {"XXS": "XXS", "XS": "XS", "S": "S", "SMALL": "S", "M": "M", "MEDIUM": "M", "L": "L", "LARGE": "L", "XL": "XL", "XXL": "XXL", "2XL": "XXL", "OS": "OS", "ONE SIZE": "OS", "ONE SIZE FITS ALL": "OS"}
EU_FOOTWEAR = {35: "3", 36: "4", 37: "5", 38: "6", 39: "7", 40: "7.5", 41: "8.5", 42: "9", 43: "10", 44: "11", 45: "12", 46: "13", 47: "14", 48: "15"}


def clean(value: Column) -> Column:
    """Blanks collapsed; empty as null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def _marks() -> str:
    """The characters that combine with the one before, as a class of ranges."""
    found = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    starts = [c for c, before in zip(found, [None, *found], strict=False) if before is None or c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], None], strict=True) if after is None or c != after - 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


_MARKS = _marks()


_BEYOND_ASCII = r"[^\x00-\x7F]"


def _decomposed(value: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), value, F.lit(True))


def _casefolded(value: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), value, F.lit(True))


def decomposed(value: Column) -> Column:
    """Compatibility decomposition (NFKD), by the Unicode library that Spark ships."""
    return F.when(value.rlike(_BEYOND_ASCII), _decomposed(value)).otherwise(value)


def casefolded(value: Column) -> Column:
    """Full case folding."""
    return F.when(value.rlike(_BEYOND_ASCII), _casefolded(value)).otherwise(F.lower(value))


def fold(value: Column) -> Column:
    """Decomposed (NFKD), combining marks dropped, case folded, apostrophes dropped."""
    whole = F.translate(_casefolded(F.regexp_replace(_decomposed(value), _MARKS, "")), "'’", "")
    return F.when(value.rlike(_BEYOND_ASCII), whole).otherwise(F.translate(F.lower(value), "'", ""))


def brand_key(value: Column) -> Column:
    """A brand's name as compared: decomposed, a to z and digits alone."""
    return F.regexp_replace(F.lower(F.regexp_replace(decomposed(value), r"[^\x00-\x7F]+", "")), "[^a-z0-9]+", "")


#: Plurals: a fixed table of (ending, letters to cut, letters to add, least length); the first that fits.
PLURALS = ((r"ies", 3, "y", 5), (r"(?:ss|sh|ch|x)es", 2, "", 4), (r"(?<![suio])s", 1, "", 4))


def singular(token: Column) -> Column:
    """Plurals to singulars; tokens with anything but letters stay."""
    out = F.when(~token.rlike(r"^\p{L}{4,}$"), token)
    for ending, cut, add, least in PLURALS:
        fits = token.rlike(f"{ending}$") & (F.length(token) >= least)
        out = out.when(fits, F.concat(F.substr(token, F.lit(1), F.length(token) - cut), F.lit(add)))
    return out.otherwise(token)


def words(value: Column) -> Column:
    """Folded, singular tokens. Of a decimal with nothing behind its point the whole number
    stays; a word with one digit at its end is two tokens."""
    def parts(norm: Column) -> Column:
        split = F.array(F.regexp_extract(norm, r"^([a-z]{3,})(\d)$", 1), F.regexp_extract(norm, r"^([a-z]{3,})(\d)$", 2))
        return F.when(norm.contains("."), F.array(F.regexp_replace(norm, r"\.0+$", ""))).when(norm.rlike(r"^[a-z]{3,}\d$"), split).otherwise(F.array(singular(norm)))

    # folded in a step of its own: a lambda computes its argument anew at each mention
    folded = F.transform(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), lambda t: F.replace(fold(t), F.lit("-"), F.lit("")))
    return F.flatten(F.transform(folded, parts))


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """All runs of 1 .. ``longest`` tokens, joined by blanks."""
    def run(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))

    runs = [run(n) for n in range(1, longest + 1)]
    empty = F.array().cast("array<string>")
    return F.concat(*(F.when(F.size(tokens) >= n, r).otherwise(empty) for n, r in enumerate(runs, 1)))


def looks_replica(title: Column, description: Column, brand: Column) -> Column:
    """Marks of a copy; "replica" doesn't count for the brand with a line so called."""
    found = F.transform(F.regexp_extract_all(F.concat(title, F.lit("\n"), F.coalesce(description, F.lit(""))), F.lit(REPLICA), F.lit(1)), F.lower)
    left = F.when(F.lower(brand).contains("margiela"), F.array_remove(found, "replica")).otherwise(found)
    return (F.size(left) > 0) | title.rlike(INSPIRED_BY)


def article_code(token: Column) -> Column:
    """At least six letters and digits that switch at least twice."""
    switches = F.regexp_count(token, F.lit(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])"))
    return (F.length(F.regexp_replace(token, "[^a-z0-9]", "")) >= 6) & (switches >= 2)


def slug(value: Column) -> Column:
    return F.trim(F.regexp_replace(fold(value), "[^a-z0-9]+", "-"), F.lit("-"))


#: How a number of a size is read: rules of (what the size says, shift), the first that fits.
SHIFTS = (("UK", 1), ("JP|CM", -18), ("", 0))
#: Categories whose sizes are numbers: (category, least, most, prefix).
NUMBERED = (("bottom|pant", 28, 40, "W"), ("foot|shoe|sneaker", 3, 18, "US "))


def normal_size(value: Column, category: Column) -> Column:
    """Letters by a table; waists 28 to 40; footwear as US 3 to 18."""
    said = F.trim(F.regexp_replace(F.upper(value), r"\s+", " "))
    letters = F.create_map(*(F.lit(x) for pair in LETTER_SIZES.items() for x in pair))
    european = F.create_map(*(x for k, v in EU_FOOTWEAR.items() for x in (F.lit(k), F.lit(v).cast("decimal(6,1)"))))
    first = F.nullif(F.regexp_extract(said, r"\d+(?:\.5)?", 0), F.lit("")).cast("decimal(6,1)")
    shoe = F.when(said.contains("EU"), F.try_element_at(european, F.floor(first).cast("int")))
    for says, by in SHIFTS:
        shoe = shoe.when(said.rlike(says), first + by)
    out = F.when(F.try_element_at(letters, said).isNotNull(), F.try_element_at(letters, said))
    for (kinds, least, most, prefix), read in zip(NUMBERED, (F.floor(first), shoe), strict=True):
        shown = F.concat(F.lit(prefix), F.regexp_replace(read.cast("decimal(6,1)").cast("string"), r"\.0$", ""))
        out = out.when(F.lower(F.coalesce(category, F.lit(""))).rlike(kinds), F.when(read.between(least, most), shown))
    return out


def cell(value: Column, kind: str) -> Column:
    """A cell of an exported sheet: null empty, booleans 1 and 0, text that a
    spreadsheet would run is quoted."""
    if kind == "boolean":
        return F.coalesce(F.when(value, "1").otherwise("0"), F.lit(""))
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^[=+\-@\t\r]") & F.lit(kind == "string"), F.concat(F.lit("'"), text)).otherwise(text), F.lit(""))


def typo(a: Column, b: Column) -> Column:
    """"spelling" if equal without blanks, "typo" one edit apart that is no digit's."""
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    same = F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" "))
    return F.when(same, "spelling").when((F.levenshtein(a, b) <= 1) & (digits(a) == digits(b)), "typo")


def redact(value: Column) -> Column:
    """Secrets in text: mail addresses, bearer tokens, key=value of secret keys."""
    out = F.regexp_replace(value, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[mail]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[\w.~+/-]+=*", "Bearer [secret]")
    return F.regexp_replace(out, r"(?i)\b(api[_-]?key|token|secret|password)\s*[=:]\s*[^\s,;]+", "$1=[secret]")
