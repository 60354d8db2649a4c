import math
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colonnade.errors import QueryError
from colonnade.plans.expression import And, Compare, Not, Or, parse, parse_filter, referenced_columns
from colonnade.plans.predicate import compile_predicate, evaluate, where
from colonnade.types import spark_schema

COLUMNS = [("i", "int"), ("f", "float"), ("s", "string"), ("b", "boolean"), ("d", "date")]
KINDS = dict(COLUMNS)
DAY = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3)]
ROWS = [
    {"i": i, "f": f, "s": s, "b": b, "d": d}
    for i, f, s, b, d in [
        (1, 1.0, "a", True, DAY[0]), (2, 2.5, "B", False, DAY[1]), (30, -1.5, "é", None, None), (31, None, None, True, DAY[2]),
        (None, 30.5, "z", False, DAY[0]), (None, None, None, None, None), (-5, 0.0, "", True, DAY[2]), (2**62, 1e300, "null", False, DAY[1]),
    ]
]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("name = 'Alice'", Compare("name", "=", "Alice")),
        ('name = "Bob"', Compare("name", "=", "Bob")),
        ("age > 25", Compare("age", ">", 25)),
        ("score >= 90", Compare("score", ">=", 90)),
        ("status != 'active'", Compare("status", "!=", "active")),
        ("score > 3.14", Compare("score", ">", 3.14)),
        ("temp < -10", Compare("temp", "<", -10)),
        ("name = NULL", Compare("name", "=", None)),
        ("NOT active = true", Not(Compare("active", "=", True))),
        ("a = 1 OR b = 2 AND c = 3", Or(Compare("a", "=", 1), And(Compare("b", "=", 2), Compare("c", "=", 3)))),
        ("(a = 1 or b = 2) and c = 3", And(Or(Compare("a", "=", 1), Compare("b", "=", 2)), Compare("c", "=", 3))),
    ],
)
def test_parse(text, wanted):
    assert parse(text) == wanted


@pytest.mark.parametrize("text", ["name = 'Alice", "name =", "name 'Alice'", "", "a = 1 b", "(a = 1", "null = 1", "a = b", "a ~ 1", "= 1"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_fallback_and_columns():
    assert parse_filter("status=active") == Compare("status", "=", "active")
    assert parse_filter("status=act ive") == Compare("status", "=", "act ive")
    assert parse_filter("n=null x") == Compare("n", "=", "null x")
    with pytest.raises(QueryError):
        parse_filter("nothing")
    assert referenced_columns(parse("NOT a = 1 AND (b > 2 OR a < 3)")) == {"a", "b"}


literals = st.one_of(st.none(), st.booleans(), st.sampled_from([0, 1, 2, 30, 31, -5, 2**62]), st.sampled_from([1.0, 2.5, 30.5, -1.5, 1e300, math.inf]), st.sampled_from(["a", "B", "é", "null", "", "2024-01-02T00:00:00Z", "2024-01-02"]))
leaves = st.builds(Compare, st.sampled_from(list(KINDS)), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), literals)
trees = st.recursive(leaves, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x), st.builds(Not, x)), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(trees, min_size=8, max_size=8))
def test_compiled_agrees_with_plain(spark, expressions):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], spark_schema(COLUMNS))
    columns = []
    for k, e in enumerate(expressions):
        columns += [compile_predicate(df.schema, e).alias(f"p{k}"), compile_predicate(df.schema, e, True).alias(f"n{k}")]
    for row, found in zip(ROWS, df.select(*columns).collect(), strict=True):
        for k, e in enumerate(expressions):
            wanted = evaluate(e, row, KINDS)
            assert bool(found[f"p{k}"]) == wanted, (str(e), row)
            assert bool(found[f"n{k}"]) == (not wanted), (str(e), row)


def test_arrays_and_names(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [1, None])], "id long, a array<long>")
    assert [r.id for r in where(df, Compare("a", "=", [1, 2])).collect()] == [1]
    assert [r.id for r in where(df, Not(Compare("a", "=", [1, 2]))).collect()] == [2, 3]
    assert [r.id for r in where(df, Compare("a", "=", None)).collect()] == [2]
    assert where(df, Compare("a", ">", [0])).count() == 0
    for name in ("A", "missing"):
        with pytest.raises(QueryError):
            where(df, f"{name} = 1")


def test_filters_reach_the_scan(spark, sf):
    df = where(spark.read.parquet(f"{sf}/lineitem.parquet"), "NOT l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "IsNull(l_quantity))" in text and "EqualTo(l_retu" in text
    assert "l_tax" not in text
