from colonnade.plans.predicate import where
from colonnade.store import Table
from colonnade.streaming import append_stream


def test_append_stream(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string").repartition(2).write.parquet(source)
    table = Table.create(spark, str(tmp_path / "t"), [("id", "int"), ("name", "string")])
    stream = where(spark.readStream.schema("id long, name string").parquet(source), "name != 'a'")
    append_stream(stream, table.root, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r.id for r in Table.open(spark, table.root).df.collect()) == [2, 3]


def test_repeated_batches(spark, tmp_path):
    table = Table.create(spark, str(tmp_path / "t"), [("id", "int")])
    batch = spark.range(3)
    for number, rows in ((0, 3), (0, 3), (1, 6), (0, 6)):
        Table.open(spark, table.root).append(batch, ("stream", number))
        assert Table.open(spark, table.root).row_count == rows
    assert Table.open(spark, table.root).append(batch, ("other", 0)) == 3
