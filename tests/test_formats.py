import copy
import json
import os
import subprocess
import sys

import pytest

from colonnade.errors import ColonnadeError, InsertError, NotNullViolation, PrimaryKeyViolation, StorageError, TypeMismatch, UniqueViolation, ValidationError
from colonnade.operators.constraints import Constraints
from colonnade.sources import binary, datasource, files
from colonnade.sources.document import Document, from_frame, parse_document, sorted_keys, to_frame, to_json

ALL = {
    "version": "1.0",
    "columns": [{"name": n, "type": t} for n, t in (("i", "int"), ("f", "float"), ("s", "string"), ("b", "boolean"), ("d", "date"), ("ai", "array<int>"), ("af", "array<float>"), ("as_", "array<string>"))],
    "rowCount": 2,
    "data": {"i": [42, None], "f": [3, None], "s": ["hé", None], "b": [True, None], "d": ["2024-01-01T00:00:00Z", None], "ai": [[1, None, 3], None], "af": [[1.5, None], None], "as_": [["a", None], None]},
    "meta": {"primaryKey": "i"},
    "indexes": {"s": {"type": "hash", "columnType": "string", "map": {"hé": [0], "null": [1]}}, "f": {"type": "sorted", "rowMap": {}}},
    "extensions": {"custom": 1, "nested": {"a": [1]}},
    "lsn": 42,
}


def changed(**more):
    doc = copy.deepcopy(ALL)
    doc["data"]["i"] = [42, 7]
    for path, v in more.items():
        at = doc
        *way, last = path.split("__")
        for p in way:
            at = at[p]
        if v is KeyError:
            del at[last]
        else:
            at[last] = v
    return doc


def test_accepts():
    doc = parse_document(changed())
    assert doc.row_count == 2 and doc.lsn == 42 and doc.indexes == {"s": "hash", "f": "sorted"} and doc.extensions == ALL["extensions"]
    assert parse_document(json.loads(to_json(doc))).data == doc.data
    assert parse_document(json.loads(to_json(doc, True))).rules == doc.rules


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ([], ValidationError), (changed(version=KeyError), ValidationError), (changed(version=1.0), ValidationError), (changed(version="2.0"), ValidationError),
        (changed(columns=[]), ValidationError), (changed(columns={}), ValidationError), (changed(columns=ALL["columns"] + ALL["columns"][:1]), ValidationError),
        (changed(columns=[{"name": "i", "type": "object"}]), ValidationError), (changed(data__i=KeyError), ValidationError), (changed(data__zz=[1, 2]), ValidationError),
        (changed(rowCount=3), ValidationError), (changed(rowCount=KeyError), ValidationError), (changed(data=KeyError), ValidationError), (changed(data__i=[1]), ValidationError),
        (changed(data__i=["1", 2]), TypeMismatch), (changed(data__i=[2**63, 1]), TypeMismatch), (changed(data__i=[True, 1]), TypeMismatch), (changed(data__b=[1, None]), TypeMismatch), (changed(data__ai=[["x"], None]), TypeMismatch),
        (changed(data__d=["2024-01-01T00:00:00", None]), TypeMismatch), (changed(data__d=["2024-01-01", None]), TypeMismatch), (changed(data__d=["2024-02-30T00:00:00Z", None]), TypeMismatch),
        (ALL, PrimaryKeyViolation), (changed(data__i=[1, 1]), PrimaryKeyViolation), (changed(meta={"primaryKey": "zz"}), ValidationError),
        (changed(data__s=["a", "a"], meta={"uniqueColumns": ["s"]}), UniqueViolation), (changed(meta={"notNullColumns": ["s"]}), NotNullViolation), (changed(meta={"defaults": {"i": "x"}}), TypeMismatch),
        (changed(indexes={"ai": {"type": "hash", "map": {}}}), ValidationError), (changed(indexes={"s": {"type": "hash", "map": {"a": [9]}}}), ValidationError),
    ],
)
def test_rejects(raw, error):
    with pytest.raises(error):
        parse_document(raw)


def test_binary_round_trip():
    doc = parse_document(changed(meta={"primaryKey": "i", "uniqueColumns": ["s"], "notNullColumns": ["i"], "defaults": {"b": False}}))
    back = binary.decode(binary.encode(doc))
    assert back == doc
    assert binary.decode_compressed(binary.encode_compressed(doc)) == doc
    some = binary.decode(binary.encode(doc), {"s", "ai"})
    assert [c for c, _ in some.columns] == ["s", "ai"] and some.data["ai"] == doc.data["ai"] and some.lsn == 42
    empty = Document([("id", "int"), ("name", "string")], {"id": [], "name": []})
    assert binary.decode(binary.encode(empty)) == empty
    assert sorted_keys(Document([("n", "int")], {"n": [9, 10, 2, None]}), "n") == ["null", "2", "9", "10"]


def test_binary_errors():
    raw = binary.encode(parse_document(changed()))
    for bad in (b"XXXX" + raw[4:], raw[:-5], raw[:20], raw[:4] + b"\x09" + raw[5:]):
        with pytest.raises(ColonnadeError):
            binary.decode(bad)
    with pytest.raises(StorageError):
        binary.decode_compressed(b"VTFz" + b"junk")
    with pytest.raises(StorageError):
        binary.encode(Document([("s", "string")], {"s": ["x" * 70_000]}))


def test_version_1():
    raw = b"VTFb\x01" + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\x02\x00id\x00" + b"\x01\x02\x00id" + b"\x00" + (5).to_bytes(8, "little") + (6).to_bytes(8, "little")
    doc = binary.decode(raw)
    assert doc.data == {"id": [5, 6]} and doc.rules.primary_key == "id" and doc.lsn == 0


def test_files_and_log(tmp_path):
    doc = Document([("id", "int"), ("name", "string")], {"id": [1], "name": ["a"]}, Constraints("id", defaults={"name": "x"}))
    for form in ("json", "binary", "compressed"):
        path = str(tmp_path / form)
        files.save(doc, path, form)
        assert files.load(path) == doc
    path = str(tmp_path / "json")
    entries = [
        {"op": "insert", "row": {"id": 2}}, {"op": "insert_batch", "rows": [{"id": 3, "name": "c"}, {"id": 4, "name": None}]},
        {"op": "txn_begin", "txn_id": "t1"}, {"op": "delete", "filter": "id = 1", "pk_values": [1]}, {"op": "txn_commit", "txn_id": "t1"},
        {"op": "update", "filter": "", "pk_values": [2, 99], "values": {"name": "u"}}, {"op": "update_legacy", "indices": [1], "values": {"name": "l"}}, {"op": "delete_legacy", "indices": [2]},
        {"op": "add_column", "name": "e", "col_type": "float"}, {"op": "create_index", "column": "id", "index_type": "hash"},
        {"op": "txn_begin", "txn_id": "t2"}, {"op": "delete", "filter": "", "pk_values": [2]},
    ]
    files.append_log(path, entries)
    now = files.load(path)
    assert now.data == {"id": [2, 3], "name": ["u", "l"], "e": [None, None]} and now.indexes == {"id": "hash"} and now.lsn == 8
    with open(files.log_path(path), "a") as f:
        f.write('{"op":"delete","filter":"","pk_values":[3]}\tdeadbeef\nnot json\n')
    with pytest.warns(UserWarning):
        assert len(files.read_log(path)) == len(entries)
    files.save(now, path)
    assert files.load(path).data == now.data  # the spent log is gone
    with pytest.raises(InsertError):
        files.insert_rows(now, [{"id": 9, "zz": 1}])
    files.insert_rows(files.load(str(tmp_path / "binary")), [{"id": 5}])
    with open(files.log_path(path), "w") as f:
        f.write('{"op":"insert","row":{"id":8,"name":"n","e":1}}\n')
    assert files.load(path).data["e"] == [None, None, 1.0]


def test_frames_and_source(spark, tmp_path):
    doc = parse_document(changed())
    df = to_frame(spark, doc)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "boolean", "timestamp", "array<bigint>", "array<double>", "array<string>"]
    assert from_frame(df, doc.columns).data == doc.data
    empty = Document([("id", "int")], {"id": []})
    assert to_frame(spark, empty).count() == 0
    datasource.register(spark)
    path = str(tmp_path / "one")
    files.save(doc, path)
    read = spark.read.format("colonnade").load(path)
    assert read.schema == df.schema and read.collect() == df.collect()
    df.select("i", "s", "d").repartition(2).write.format("colonnade").option("form", "json").mode("append").save(str(tmp_path / "many"))
    back = spark.read.format("colonnade").load(str(tmp_path / "many"))
    assert sorted(back.collect()) == sorted(df.select("i", "s", "d").collect(), key=lambda r: r[0])


def test_overwrite_and_attempts(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(3).selectExpr("id", "timestamp_micros(id + 1704110400250000) AS t").repartition(2)
    for _ in range(2):
        df.write.format("colonnade").option("form", "json").mode("overwrite").save(path)
    read = lambda: spark.read.format("colonnade").load(path)
    assert read().count() == 3
    df.write.format("colonnade").mode("append").save(path)
    assert read().count() == 6 and read().select("id").distinct().count() == 3
    assert spark.read.format("colonnade").option("columns", "t").load(path).columns == ["t"]
    writer = datasource._Writer(path, df.schema, "json", False)
    batch = df.coalesce(1).toArrow().to_batches()
    kept, _retried = writer.write(iter(batch)), writer.write(iter(batch))
    writer.commit([kept])  # of two attempts at a task one counts
    assert read().count() == 9 and not [n for n in os.listdir(path) if n.startswith("_")]
    writer = datasource._Writer(path, df.schema, "json", False)
    writer.write(iter(batch))
    writer.abort([])
    assert read().count() == 9


ZONES = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from colonnade.sources import datasource, files
from colonnade.sources.document import from_frame
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", sys.argv[3]).getOrCreate()
datasource.register(spark)
df = spark.sql("SELECT timestamp_micros(1704110400250000) AS t, timestamp_micros(1710055800000001) AS u")
doc = from_frame(df, [("t", "date"), ("u", "date")])
assert doc.data == {"t": ["2024-01-01T12:00:00.25Z"], "u": ["2024-03-10T07:30:00.000001Z"]}, doc.data
df.write.format("colonnade").option("form", "json").mode("overwrite").save(sys.argv[2])
back = spark.read.format("colonnade").load(sys.argv[2])
micros = lambda d: d.selectExpr("unix_micros(t)", "unix_micros(u)").collect()
assert micros(back) == micros(df), (micros(back), micros(df))
"""


@pytest.mark.parametrize(("system", "session"), [("America/New_York", "UTC"), ("UTC", "Asia/Kolkata")])
def test_times_in_other_zones(tmp_path, system, session):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", ZONES, root, str(tmp_path / "z"), session], env=os.environ | {"TZ": system}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_documents_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """A task writes documents of a bounded size, all of its rows in their order; one without rows writes an empty document."""
    path = str(tmp_path / "out")
    os.makedirs(path)
    df = spark.range(1_000).selectExpr("id", "if(id % 3 = 0, null, repeat('t', 40)) AS s").coalesce(1)
    batches = df.toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(datasource, "DOCUMENT_ROWS", 300)
    for most, least in ((1 << 20, 4), (4_000, 8)):
        monkeypatch.setattr(datasource, "DOCUMENT_BYTES", most)
        writer = datasource._Writer(path, df.schema, "binary", True)
        done = writer.write(iter(batches))
        docs = [files.load(f"{writer.own}/{f}") for f in done.files]
        assert len(docs) >= least and max(d.row_count for d in docs) <= 300
        assert [v for d in docs for v in d.data["id"]] == list(range(1_000))
        writer.commit([done])
        assert len(os.listdir(path)) == len(docs) + len([n for n in os.listdir(path) if n.endswith(".lock")])
    writer = datasource._Writer(path, df.schema, "binary", True)
    assert [files.load(f"{writer.own}/{f}").row_count for f in writer.write(iter([])).files] == [0]
