"""Rules that tables have to keep, each a plan that returns the rows that break it.

A rule is a row of a list, not code of its own: keys, references, bounds, values, filled
columns, parents without a cycle, phrases that one table alone may hold. What comes back names
the rule, the table and the row, so that a set of tables is refused with all its faults.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.sources.scratch import stored


@dataclass(frozen=True)
class Rule:
    """``table``: whose rows are looked at. ``row``: the columns that name a row."""

    name: str
    table: str
    row: tuple[str, ...]

    def broken(self, tables: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def found(self, rows: DataFrame, detail: Column) -> DataFrame:
        named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.row))
        return rows.select(F.lit(self.name).alias("rule"), F.lit(self.table).alias("table_name"), named.alias("row"), detail.cast("string").alias("detail"))


@dataclass(frozen=True)
class Key(Rule):
    """No two rows have the same ``columns``; a row of nulls alone is no key."""

    columns: tuple[str, ...] = ()

    def broken(self, tables):
        rows = tables[self.table].filter(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in self.columns)))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in self.columns]
        twice = rows.groupBy(*self.columns).agg(F.count("*").alias("_n")).filter("_n > 1")
        return self.found(rows.alias("l").join(twice.alias("r"), same).select("l.*", "_n"), F.concat(F.col("_n").cast("string"), F.lit(" rows")))


@dataclass(frozen=True)
class Reference(Rule):
    """``columns`` that aren't null are a row's ``there`` of table ``to``."""

    columns: tuple[str, ...] = ()
    to: str = ""
    there: tuple[str, ...] = ()

    def broken(self, tables):
        known = tables[self.to].select(*(F.col(t).alias(c) for t, c in zip(self.there, self.columns, strict=True))).distinct()
        return self.found(tables[self.table].dropna(subset=list(self.columns)).join(known, list(self.columns), "left_anti"), F.concat_ws(":", *(F.col(c).cast("string") for c in self.columns)))


@dataclass(frozen=True)
class Bounds(Rule):
    """``column`` is null or lies between ``low`` and ``high``, both included."""

    column: str = ""
    low: float = 0.0
    high: float = 0.0

    def broken(self, tables):
        return self.found(tables[self.table].filter(~F.col(self.column).between(self.low, self.high)), F.col(self.column))


@dataclass(frozen=True)
class Values(Rule):
    """``column`` is null or one of ``allowed``."""

    column: str = ""
    allowed: tuple[str, ...] = ()

    def broken(self, tables):
        return self.found(tables[self.table].filter(~F.col(self.column).isin(*self.allowed)), F.col(self.column))


@dataclass(frozen=True)
class Filled(Rule):
    """``column`` holds something besides blanks."""

    column: str = ""

    def broken(self, tables):
        return self.found(tables[self.table].filter(F.trim(F.coalesce(F.col(self.column).cast("string"), F.lit(""))) == ""), F.lit(self.column))


@dataclass(frozen=True)
class Acyclic(Rule):
    """From every row its ``parent``s lead to a row without one (or one that isn't there, which
    is a reference's matter). Every round doubles how far a row looks up, so a chain of n
    rows takes log n rounds; what still has somebody above it then never ends."""

    ident: str = ""
    parent: str = ""

    def broken(self, tables):
        rows = tables[self.table]
        known = rows.select(F.col(self.ident).alias("_up")).distinct()
        up = rows.select(F.col(self.ident).alias("_id"), F.col(self.parent).alias("_up")).filter("_up is not null").join(known, "_up", "left_semi").distinct()
        up = stored(up, "parents")
        for _ in range(max(1, up.count()).bit_length()):
            above = up.select(F.col("_id").alias("_up"), F.col("_up").alias("_far"))
            up = stored(up.join(above, "_up").select("_id", F.col("_far").alias("_up")).distinct(), "parents")
        endless = up.select(F.col("_id").alias(self.ident)).distinct()
        return self.found(rows.join(endless, self.ident, "left_semi"), F.col(self.parent))


@dataclass(frozen=True)
class Exclusive(Rule):
    """No ``column`` of ``table`` is in ``other`` of ``others``, whatever its case."""

    column: str = ""
    others: str = ""
    other: str = ""

    def broken(self, tables):
        taken = tables[self.others].select(F.lower(self.other).alias("_p")).distinct()
        return self.found(tables[self.table].withColumn("_p", F.lower(self.column)).join(taken, "_p", "left_semi"), F.col("_p"))


def violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """rule, table_name, row, detail of every row that breaks a rule; none: all are kept."""
    return reduce(DataFrame.unionByName, (r.broken(tables) for r in rules))
