import math

import pytest
from pyspark.sql import functions as F

from colonnade.errors import InsertError, NotNullViolation, PrimaryKeyViolation, QueryError, SchemaError, TypeMismatch, UniqueViolation
from colonnade.operators import aggregate as agg
from colonnade.operators import constraints as con
from colonnade.operators import mutate, query, stats
from colonnade.operators import vector_search as vs
from colonnade.operators.constraints import Constraints
from colonnade.operators.join import inner_join, parse_on
from colonnade.plans.explain import estimate
from colonnade.plans.expression import parse


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Alice", 30, True), (2, "Bob", 25, False), (3, "Charlie", 35, True), (4, "Alice", 30, True), (5, "Eve", 28, None)], "id long, name string, age long, active boolean")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_query(people):
    assert ids(query.query(people, "name = 'Alice'")) == [1, 4]
    assert ids(query.query(people, "name != 'Alice' AND active != true")) == [2, 5]
    assert query.query(people, "age >= 28", ["name"], 2, ["id"]).collect() == [("Alice",), ("Charlie",)]
    assert query.query(people, columns=["age", "id"]).columns == ["age", "id"]
    assert query.query(people, limit=0).count() == 0
    with pytest.raises(QueryError):
        query.query(people, columns=["nope"])
    lines = list(query.as_table(people.columns, people.collect(), page=2))
    assert "NULL" in lines[-2] and lines[-1] == "(5 rows)" and list(query.as_table(["a"], [])) == ["a", "-", "(0 rows)"]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 90.5, [1]), (2, 85.0, None), (3, None, [None]), (4, 92.3, []), (5, 78.1, [2])], "id long, score double, a array<long>")
    r = agg.aggregate(df, "score", "count, sum,avg,min,max").first()
    assert (r["count"], r["min"], r["max"]) == (4, 78.1, 92.3)
    assert math.isclose(r["sum"], 345.9) and math.isclose(r["avg"], 345.9 / 4)
    assert agg.aggregate(df, "a", ["count"]).first()[0] == 4
    empty = agg.aggregate(df, "id", ["count", "sum", "avg", "min"], "id > 99").first()
    assert tuple(empty) == (0, 0.0, 0.0, None)
    assert agg.aggregate(spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "x long"), "x", "sum").first()[0] == float(2**64)
    for column, function in (("a", "sum"), ("a", "min"), ("score", "median"), ("nope", "count")):
        with pytest.raises(QueryError):
            agg.aggregate(df, column, function)


def test_join(spark):
    left = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, None), (4, "null")], "id long, k string")
    right = spark.createDataFrame([(101, 1, 9.99), (102, 2, 19.99), (103, 1, 4.99), (104, 9, 1.0)], "oid long, uid long, amount double")
    out = inner_join(left, right, *parse_on("id = uid"))
    assert out.columns == ["left_id", "left_k", "right_oid", "right_uid", "right_amount"] and out.count() == 3
    assert inner_join(left, left, "k", "k").count() == 4
    assert inner_join(left, left, "k", "k", null_as_text=True).count() == 6
    arrays = spark.createDataFrame([([1],)], "a array<long>")
    assert inner_join(arrays, arrays, "a", "a").count() == 0
    with pytest.raises(QueryError):
        inner_join(left, right, "k", "uid")
    for bad in ("id", "=x", "a="):
        with pytest.raises(QueryError):
            parse_on(bad)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.707, 0.707, 0.0]), (4, None), (5, [1.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [2.0, None, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r.id for r in vs.top_k(df, "v", [1, 0, 0], 3, order=["id"]).collect()] == [1, 7, 3]
    found = {r.id: r.similarity for r in vs.score(df, "v", [1.0, 0.0, 0.0]).collect()}
    assert set(found) == {1, 2, 3, 6, 7} and found[6] == 0.0 and math.isclose(found[3], 0.5**0.5, rel_tol=1e-6)
    assert [(r.id, r.distance) for r in vs.search(df, "v", [0.0, 0.0, 0.0], 2, "euclidean", ["id"], ["id"]).collect()] == [(6, 0.0), (3, pytest.approx(0.99985, abs=1e-4))]
    assert all(r.similarity == 0.0 for r in vs.score(df, "v", [0, 0, 0]).collect())
    wide = spark.createDataFrame([(1, [0.5] * 200)], "id long, v array<float>")
    assert vs.score(wide, "v", [1.0] * 200).first().similarity == pytest.approx(1.0)
    for vector, metric, column in (([], "cosine", "v"), ([1.0], "dot", "v"), ([1.0], "cosine", "id")):
        with pytest.raises(QueryError):
            vs.top_k(df, column, vector, 1, metric)
    with pytest.raises(QueryError):
        vs.parse_vector("[1, true]")


def test_ann_recall(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vs.CellIndex.fit(df, "embedding")
    index.save(df, str(tmp_path / "index"))
    index, cells = vs.CellIndex.load(spark, str(tmp_path / "index"))
    assert cells.count() == df.count()
    hits = 0
    queries = [r for r in df.where("vec_id % 50 = 0").collect()]
    for r in queries:
        exact = {x.vec_id for x in vs.top_k(df, "embedding", r.embedding, 10, order=["vec_id"]).collect()}
        hits += len(exact & {x.vec_id for x in index.search(cells, r.embedding, 10, order=["vec_id"]).collect()})
    assert hits / (10 * len(queries)) >= 0.9


def test_index_search_of_other_lengths_and_large_k(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0 + i % 3]) for i in range(60)] + [(100 + i, [1.0, float(i)]) for i in range(5)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vs.CellIndex.fit(df, "v", cells=8)
    cells = index.assign(df)
    ids = lambda out: [r.id for r in out.collect()]
    for vector, k in (([1.0, 2.0], 3), ([1.0, 2.0], 9), ([1.0], 2), ([1.0, 1.0, 1.0], 60), ([1.0, 1.0, 1.0], 70)):
        assert ids(index.search(cells, vector, k, probes=1, order=["id"])) == ids(vs.top_k(df, "v", vector, k, order=["id"]))
    assert len(ids(index.search(cells, [1.0, 1.0, 1.0], 30, probes=1, order=["id"]))) == 30


def test_constraints_and_mutations(people):
    rules = Constraints("id", ["name"], ["age"], {"active": False})
    base = people.where("id <> 4")
    out = mutate.insert(base, [{"id": 9, "name": "Zed", "age": 1}, {"id": 10, "name": None, "age": 2, "active": None}], rules)
    assert {r.id: r.active for r in out.collect()} == {1: True, 2: False, 3: True, 5: None, 9: False, 10: None}
    for row, error in (
        ({"id": 1, "name": "X", "age": 1}, PrimaryKeyViolation), ({"id": None, "name": "X", "age": 1}, PrimaryKeyViolation), ({"id": 9, "name": "Bob", "age": 1}, UniqueViolation),
        ({"id": 9, "name": "X", "age": None}, NotNullViolation), ({"id": 9, "name": "X"}, InsertError), ({"id": 9, "name": "X", "age": 1, "zip": 1}, InsertError), ({"id": 9, "name": "X", "age": "1"}, TypeMismatch),
        ({"id": True, "name": "X", "age": 1}, TypeMismatch),
    ):
        with pytest.raises(error):
            mutate.insert(base, [row], rules)
    with pytest.raises(PrimaryKeyViolation):
        mutate.insert(base, [{"id": 9, "name": "X", "age": 1}, {"id": 9, "name": "Y", "age": 1}], rules)
    assert ids(mutate.delete(people, "active = true")) == [2, 5]
    changed = mutate.update(base, "age > 28 OR active = null", {"age": 0}, rules)
    assert {r.id: r.age for r in changed.collect()} == {1: 0, 2: 25, 3: 0, 5: 0}
    with pytest.raises(PrimaryKeyViolation):
        mutate.update(base, "age > 0", {"id": 7}, rules)
    with pytest.raises(UniqueViolation):
        mutate.update(base, "age > 28", {"name": "Q"}, rules)
    with pytest.raises(NotNullViolation):
        mutate.update(base, "id = 1", {"age": None}, rules)
    with pytest.raises(UniqueViolation):
        con.check(people, rules)
    grown = mutate.add_column(people, "email", "string")
    assert grown.columns[-1] == "email" and grown.where("email is not null").count() == 0
    for name, kind in (("age", "int"), ("x", "object")):
        with pytest.raises(SchemaError):
            mutate.add_column(people, name, kind)


def test_stats_and_estimates(people):
    found = stats.collect_stats(people)
    assert found["age"] == {"row_count": 5, "null_count": 0, "distinct_count": 4, "min": 25, "max": 35, "valid": True}
    assert found["active"]["null_count"] == 1 and found["active"]["min"] is None
    share = lambda text, s=found: estimate(parse(text), 100, s).share
    assert share("age <= 30") == pytest.approx(0.5) and share("age = 26") == pytest.approx(0.25) and share("age = 99") == 0.0
    assert share("age < 30") + share("age >= 30") == pytest.approx(1.0) and share("age > 35") == 0.0 and share("age >= 25") == pytest.approx(1.0)
    assert share("active = null") == pytest.approx(0.2) and share("active != null") == pytest.approx(0.8) and share("active > null") == 0.0
    assert share("age <= 30 AND id <= 3") == pytest.approx(0.25) and share("age <= 30 OR id <= 3") == pytest.approx(0.75) and share("NOT age <= 30") == pytest.approx(0.5)
    assert share("name > 'B'") is None and share("age = 1", {}) is None and share("age = 1 AND name > 'B'") is None
    tree = estimate(parse("age > 30 AND NOT (name = 'Bob' OR id = 3)"), 5, found, {"age": "sorted"})
    lines = str(tree).splitlines()
    assert lines[0].startswith("AND: about") and "age > 30" in lines[1] and lines[1].endswith("files laid out by sorted") and lines[2].strip().startswith("NOT: about")


def test_join_on_text(spark):
    left = spark.createDataFrame([(1, 1.0, "1"), (2, 2.5, "x"), (3, None, None), (4, 1e7, "null")], "n long, f double, s string")
    pairs = lambda a, b: sorted((r[0], r[3]) for r in inner_join(left, left, a, b, as_text=True).collect())
    assert pairs("n", "s") == [(1, 1)] and pairs("f", "n") == [(1, 1)]
    assert pairs("f", "s") == [(1, 1), (3, 3), (3, 4)]
    times = spark.sql("SELECT timestamp'2024-01-02 03:04:05.5' AS t, '2024-01-02T03:04:05.5Z' AS s, array(1) AS a")
    assert inner_join(times, times, "t", "s", as_text=True).count() == 1
    assert inner_join(times, times, "a", "s", as_text=True).count() == 0


def test_vectors_of_32_bits(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.1])], "id long, v array<double>")
    found = vs.top_k_f32(df, "v", [0.1, 0.2], 2, ["id"])
    assert dict(found.dtypes)["similarity"] == "float"
    assert [r.id for r in found.collect()] == [1, 2] and found.first().similarity == 1.0


def test_join_as_text_uses_all_cores(spark, tmp_path):
    """Two small files with few keys make a large result: its rows come from as many tasks as there are cores."""
    for name, n in (("l", 40), ("r", 4_000)):
        spark.range(n).selectExpr("id", "id % 3 AS k").coalesce(1).write.parquet(str(tmp_path / name))
    l, r = (spark.read.parquet(str(tmp_path / name)) for name in "lr")  # noqa: E741
    for a, b in ((l, r), (r, l)):
        out = inner_join(a.withColumn("k", F.col("k").cast("double")), b, "k", "k", as_text=True)
        assert out.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
        assert out.count() == sum(len(range(k, 40, 3)) * len(range(k, 4_000, 3)) for k in range(3))
