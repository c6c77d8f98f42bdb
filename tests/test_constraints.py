"""Each rule names its row; clean tables break none."""

from __future__ import annotations

from souk.operators import constraints as C

RULES = [
    C.Key("key", "types", ("id",), columns=("id",)), C.Reference("ref", "seeds", ("name",), columns=("type",), to="types", there=("id",)), C.Bounds("bounds", "types", ("id",), column="ratio", low=0, high=1),
    C.Values("values", "seeds", ("name",), column="status", allowed=("on", "off")), C.Filled("filled", "seeds", ("name",), column="name"), C.Acyclic("acyclic", "types", ("id",), ident="id", parent="parent"),
    C.Exclusive("exclusive", "seeds", ("name",), column="name", others="types", other="id"),
]


def found(spark, types, seeds):
    tables = {"types": spark.createDataFrame(types, "id string, parent string, ratio double"), "seeds": spark.createDataFrame(seeds, "name string, type string, status string")}
    return sorted((r.rule, r.row, r.detail) for r in C.violations(tables, RULES).collect())


def test_clean_tables_break_nothing(spark):
    assert found(spark, [("bag", None, 0.5), ("tote", "bag", 1.0), ("mini", "tote", None), ("gone", "elsewhere", 0.0)], [("x", "bag", "on"), ("y", None, None)]) == []
    assert found(spark, [], []) == []


def test_each_fault_is_named(spark):
    types = [("bag", None, 0.5), ("bag", None, 1.5), ("a", "b", 0.1), ("b", "c", 0.1), ("c", "a", 0.1), ("under", "c", 0.1), ("self", "self", 0.1), ("fine", "bag", 0.1)]
    seeds = [("x", "hat", "on"), ("Bag", "bag", "odd"), ("  ", "bag", "off")]
    assert found(spark, types, seeds) == [
        ("acyclic", "a", "b"), ("acyclic", "b", "c"), ("acyclic", "c", "a"), ("acyclic", "self", "self"), ("acyclic", "under", "c"), ("bounds", "bag", "1.5"),
        ("exclusive", "Bag", "bag"), ("filled", "  ", "name"), ("key", "bag", "2 rows"), ("key", "bag", "2 rows"), ("ref", "x", "hat"), ("values", "Bag", "odd"),
    ]
