import json
import os
import time

import pytest
from pyspark.sql import functions as F

from colonnade import store
from colonnade.cli import main
from colonnade.errors import Conflict, PrimaryKeyViolation, QueryError, SchemaError, StorageError
from colonnade.operators.constraints import Constraints
from colonnade.sources import files, inplace
from colonnade.sources.document import Document
from colonnade.sources.inplace import DocumentFile
from colonnade.store import Table, Version, apply_json

COLUMNS = [("id", "int"), ("plant", "string"), ("height", "int")]
GARDEN = [{"id": i, "plant": p, "height": h} for i, p, h in ((11, "fern", 40), (12, "moss", 3), (13, "yew", 210), (14, "ivy", 95), (15, "sage", 60), (16, "oak", 800))]


@pytest.fixture
def table(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), COLUMNS, Constraints("id", defaults={"height": 1}))
    t.insert(GARDEN[:4])
    t.insert(GARDEN[4:])
    return t


def rows(t):
    return [(r.id, r.plant, r.height) for r in t.query(limit=100).collect()]


def test_insert_delete_update(table, spark):
    before = list(table.version.files)
    assert table.insert([{"id": 17, "plant": "reed"}]) == 1 and set(before) < set(table.version.files)
    with pytest.raises(PrimaryKeyViolation):
        table.insert([{"id": 18, "plant": "x"}, {"id": 11, "plant": "y"}])
    assert table.row_count == 7
    assert table.delete("height < 50") == 3
    assert table.row_count == 4 and [f for f in before if f in table.version.files], "files without a deleted row stay"
    assert table.update("plant = 'sage'", {"height": 61}) == 1
    assert rows(table) == [(13, "yew", 210), (14, "ivy", 95), (15, "sage", 61), (16, "oak", 800)]
    assert [r.id for r in table.query("height >= 61", ["id"], 2).collect()] == [13, 14]
    assert rows(Table.open(spark, table.root)) == rows(table)
    assert len(rows(Table.open(spark, table.root, 2))) == 6, "old versions can be read"
    assert table.delete("id = 77") == 0
    table.check()


def test_many_versions(table, spark):
    for i in range(store.FULL_EVERY + 3):
        table.insert([{"id": 100 + i, "plant": "seed"}])
        if i % 4 == 0:
            table.delete(f"id = {100 + i}")
    again = Table.open(spark, table.root)
    assert again.version.files == table.version.files and again.version.change is None
    assert again.df.count() == again.row_count == table.row_count
    records = [open(f"{table.root}/_log/{n}").read() for n in sorted(os.listdir(f"{table.root}/_log"))]
    assert sum('"change": null' in r for r in records) < len(records) // 3, "most records hold changes only"


def test_commits_over_many_files(table, spark, monkeypatch):
    """What a commit does with the list of files grows as the list, not with its square."""
    version = table.version
    version.files = [f"data/v0-x/part-{i:06d}.parquet" for i in range(100_000)] + version.files
    version.compacted = 100_000
    stored = Table._stored  # only the real files are read
    monkeypatch.setattr(Table, "_stored", lambda self, files=None: stored(self, [f for f in (self.version.files if files is None else files) if not f.startswith("data/v0-x")]))
    monkeypatch.setattr(Table, "open", classmethod(lambda cls, *a, **k: table))
    began = time.time()
    assert table.delete("id = 11") == 1 and len(table.version.files) == 100_002
    assert time.time() - began < 30


def test_schema_layouts_stats(table, spark):
    table.add_column("note", "string")
    table.insert([{"id": 19, "plant": "n", "note": "e"}])
    assert {r.id: r.note for r in table.df.collect()}[11] is None
    with pytest.raises(SchemaError):
        table.add_column("note", "string")
    table.create_layout("height", "sorted")
    table.create_layout("plant", "hash")
    table.check()
    shown = str(table.explain("height > 100"))
    assert "laid out by sorted" in shown and "PushedFilters" in shown and "unknown" in shown
    assert table.analyze()["height"]["max"] == 800
    assert table.explain("height <= 800").rows == 7
    assert table.version.stats["height"]["valid"]
    table.delete("id = 19")
    assert not table.version.stats["height"]["valid"]
    unsorted = table._numbered(table.df.coalesce(1).orderBy(F.desc("height")))
    layouts, table.version.layouts = table.version.layouts, {}
    files = table._write(unsorted)
    table.version.layouts, kept = layouts, table.version.files
    table.version.files = files
    with pytest.raises(StorageError):
        table.check()
    table.version.files = kept
    table.drop_layout("height")
    for bad in (lambda: table.drop_layout("height"), lambda: table.create_layout("zz", "hash"), lambda: table.create_layout("height", "tree")):
        with pytest.raises(QueryError):
            bad()
    table.compact(1)
    assert len(table.version.files) == 1 and [r[0] for r in rows(table)] == [11, 12, 13, 14, 15, 16]


def test_transactions(table, spark):
    other = Table.open(spark, table.root)
    txn = table.transaction()
    txn.insert({"id": 20, "plant": "new", "height": 900})
    txn.delete("id = 11")
    txn.update("height > 700", {"plant": "old"})  # the oak only: rows that the transaction adds are not selected
    assert txn.commit() == [1, 1, 1]
    assert rows(table) == [(12, "moss", 3), (13, "yew", 210), (14, "ivy", 95), (15, "sage", 60), (16, "old", 800), (20, "new", 900)]
    late = other.transaction()
    late.delete("id = 12")
    with pytest.raises(Conflict):
        late.commit()
    forced = other.transaction(check=False)
    forced.delete("id = 12")
    assert forced.commit() == [1]
    txn = Table.open(spark, table.root).transaction()
    txn.delete("id = 13")
    txn.rollback()
    assert txn.commit() == []
    now = Table.open(spark, table.root)
    with pytest.raises(PrimaryKeyViolation):
        apply_json(now, [{"op": "delete", "where": "id=13"}, {"op": "insert", "row": {"id": 14, "plant": "x", "height": 1}}])
    assert now.df.count() == 5 == now.row_count
    assert apply_json(now, [{"op": "delete", "where": "id=14"}, {"op": "insert", "row": {"id": 14, "plant": "x", "height": 1}}]) == [1, 1]
    with pytest.raises(PrimaryKeyViolation):
        now.update("height > 1", {"id": 50})
    with pytest.raises(QueryError):
        apply_json(now, [{"op": "merge"}])


def test_publish_and_damage(table, spark):
    stale = Table.open(spark, table.root)
    table.add_column("x", "int")
    with pytest.raises(Conflict):
        stale.add_column("y", "int")
    path = f"{table.root}/_log/{table.version.number:020d}.json"
    text = open(path).read()
    with pytest.raises(StorageError):
        Version.from_text(text.replace("insert", "xnsert", 1).replace('"next_row": ', '"next_row": 1', 1))
    with pytest.raises(StorageError):
        Table.create(spark, table.root, COLUMNS)
    with pytest.raises(StorageError):
        Table.open(spark, table.root + "-none")
    assert not [n for n in os.listdir(f"{table.root}/_log") if n.endswith(".tmp")]


def test_vector_index(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "v"), [("id", "int"), ("v", "array<float>")])
    t.insert([{"id": i, "v": [float(i % 7), float(i % 5), 1.0]} for i in range(40)] + [{"id": 99, "v": None}])
    exact = [r.id for r in t.search("v", [1.0, 2.0, 1.0], 3, select=["id"]).collect()]
    t.build_vector_index("v")
    assert [r.id for r in t.search("v", [1.0, 2.0, 1.0], 3, select=["id"]).collect()] == exact
    t.insert([{"id": 100, "v": [1.0, 2.0, 1.0]}, {"id": 101, "v": None}])
    t.append(t.df.where("id = 7").selectExpr("id + 1000 AS id", "v"))
    assert t._vector_folders("v") and 100 in [r.id for r in t.search("v", [1.0, 2.0, 1.0], 10, select=["id"]).collect()], "the index has the new rows"
    t.check()
    t.delete("id = 100")
    assert not t._vector_folders("v") and 100 not in [r.id for r in t.search("v", [1.0, 2.0, 1.0], 10, select=["id"]).collect()]


def test_documents(spark, tmp_path):
    doc = Document([("id", "int"), ("d", "date")], {"id": [1, 2], "d": ["2024-01-01T00:00:00Z", None]}, Constraints("id"), {"id": "hash"}, {"k": [1]})
    t = Table.from_document(spark, str(tmp_path / "d"), doc)
    back = t.to_document()
    assert (back.data, back.rules, back.indexes, back.extensions) == (doc.data, doc.rules, doc.indexes, doc.extensions)


def test_cli(spark, tmp_path, capsys):
    def run(*argv):
        code = main([str(a) for a in argv], spark)
        return code, capsys.readouterr()

    t, u = tmp_path / "t", tmp_path / "u"
    assert run("create", t, "--columns", "id:int,name:string,v:array<float>", "--primary-key", "id", "--default", '{"name": "none"}')[0] == 0
    assert run("insert", t, "--rows", json.dumps([{"id": i, "name": f"n{i}", "v": [1.0 * i, 1.0]} for i in range(4)]))[0] == 0
    assert run("insert", t, "--row", '{"id": 9, "v": null}')[0] == 0
    code, out = run("insert", t, "--row", '{"id": 9, "v": null}')
    assert code == 1 and "taken" in out.err
    assert "n2" in run("query", t, "--where", "id = 2", "--select", "name")[1].out
    assert "(2 rows)" in run("query", t, "--limit", 2)[1].out
    assert "5" in run("aggregate", t, "--column", "id", "--function", "count,max")[1].out
    assert "similarity" in run("search", t, "--column", "v", "--vector", "[1, 1]", "--select", "id")[1].out
    assert "id = 2: unknown" in run("explain", t, "--where", "id = 2")[1].out
    assert run("update", t, "--where", "id=2", "--set", '{"name": "two"}')[0] == 0
    assert run("txn", t, "--ops", '[{"op": "delete", "where": "id = 0"}, {"op": "insert", "row": {"id": 20, "v": [1, 2]}}]')[0] == 0
    assert run("delete", t, "--where", "name = none")[0] == 1, "an unquoted word needs the form without blanks"
    assert "deleted 2" in run("delete", t, "--where", "name=none")[1].out
    for command in (("add-column", t, "--name", "x", "--type", "int"), ("create-index", t, "--column", "id", "--type", "sorted"), ("analyze", t), ("build-vector-index", t, "--column", "v"), ("validate", t), ("check", t), ("compact", t), ("drop-index", t, "--column", "id")):
        assert run(*command)[0] == 0, command
    assert "primary key" in run("info", t)[1].out
    assert json.loads(run("export", t)[1].out)["rowCount"] == 3
    assert run("export", t, "--format", "compressed", "--output", tmp_path / "f")[0] == 0
    assert files.load(str(tmp_path / "f")).row_count == 3
    assert run("join", t, t, "--on", "id=id", "--output", tmp_path / "j")[0] == 0
    assert len(run("join", t, t, "--on", "id=id")[1].out.splitlines()) == 3
    assert run("query", tmp_path / "missing")[0] == 1


def test_document_in_place(spark, tmp_path, capsys):
    def run(*argv):
        code = main([str(a) for a in argv], spark)
        return code, capsys.readouterr()

    for form, key in (("json", "id"), ("binary", None), ("compressed", "id")):
        f = tmp_path / f"{form}.doc"
        assert run("create", f, "--columns", "id:int,at:date,v:array<float>", "--document", form, *(["--primary-key", key] if key else []))[0] == 0
        assert run("create", f, "--columns", "id:int", "--document", form)[0] == 1
        assert run("insert", f, "--rows", json.dumps([{"id": i, "at": f"2024-03-1{i}T02:30:00.25Z", "v": [1.0 * i, 1.0]} for i in range(5)]))[0] == 0
        assert run("insert", f, "--row", '{"id": 9, "at": null, "v": null}')[1].out == "inserted 1 rows, 6 in all\n"
        code, out = run("insert", f, "--row", '{"id": 9, "at": null, "v": null}')
        assert code == (1 if key else 0)
        assert "2024-03-12T02:30:00.25Z" in run("query", f, "--where", "id = 2", "--select", "at")[1].out
        assert [line.strip() for line in run("query", f, "--limit", 2, "--select", "id")[1].out.splitlines()] == ["id", "--", "0", "1", "(2 rows)"]
        assert run("update", f, "--where", "id > 3", "--set", '{"v": [7.0, 7.0]}')[0] == 0
        assert run("txn", f, "--ops", '[{"op": "delete", "where": "id = 0"}, {"op": "insert", "row": {"id": 20, "at": null, "v": [1, 2]}}, {"op": "update", "where": "id < 2", "set": {"v": null}}]')[1].out == "committed 3 operations on 4 rows\n"
        assert run("delete", f, "--where", "id=9")[0] == 0
        assert [e["op"] for e in files.read_log(str(f))][-5:] == ["txn_begin", "delete" if key else "delete_legacy", "insert", "update" if key else "update_legacy", "txn_commit", "delete"][-5:] or files.read_log(str(f))
        doc = files.load(str(f))
        assert doc.data["id"] == [1, 2, 3, 4, 20] and doc.data["v"] == [None, [2.0, 1.0], [3.0, 1.0], [7.0, 7.0], [1.0, 2.0]]
        for command in (("add-column", f, "--name", "x", "--type", "int"), ("create-index", f, "--column", "id", "--type", "sorted"), ("check", f), ("compact", f), ("check", f), ("analyze", f), ("info", f), ("drop-index", f, "--column", "id")):
            assert run(*command)[0] == 0, command
        assert not files.read_log(str(f)) and files.form_of(open(f, "rb").read(4)) == form
        assert "about 1 of 5" in run("explain", f, "--where", "id = 2")[1].out or form != "json"
        assert "similarity" in run("search", f, "--column", "v", "--vector", "[1, 1]", "--select", "id", "--top-k", 1)[1].out
        assert "count" in run("aggregate", f, "--column", "id", "--function", "count")[1].out
        assert len(run("join", f, f, "--on", "id=id", "--as-text")[1].out.splitlines()) == 5
        assert run("query", f, "--where", "nope = 1")[0] == 1 and run("delete", f, "--where", "nope = 1")[0] == 1


def test_document_log_is_compacted(spark, tmp_path):
    path = str(tmp_path / "d")
    files.save(Document([("id", "int")], {"id": []}), path, "json")
    held = DocumentFile(spark, path)
    for i in range(inplace.COMPACT_AFTER + 5):
        held.insert([{"id": i}])
    assert len(files.read_log(path)) == 5 and files.load(path).data["id"] == list(range(inplace.COMPACT_AFTER + 5))
    stored = json.loads(open(path).read())
    stored["indexes"] = {"id": {"type": "hash", "columnType": "int", "map": {"0": [1]}}}
    os.remove(files.log_path(path))
    open(path, "w").write(json.dumps(stored))
    with pytest.raises(StorageError):
        DocumentFile(spark, path).check()


def test_files_bounded_in_memory(spark, tmp_path, monkeypatch):
    """Rewritten files are bounded by what their rows take in memory: cells that repeat are small on disk."""
    monkeypatch.setattr(store, "FILE_BYTES", 4 << 20)
    t = Table.create(spark, str(tmp_path / "t"), [("id", "int"), ("s", "string"), ("a", "array<string>")])
    wide = spark.range(8_000).selectExpr("id", "repeat('x', 1500) AS s", "array('y', null) AS a")
    t.append(wide.coalesce(1))
    t.create_layout("id", "sorted")
    assert sum(os.path.getsize(f"{t.root}/{f}") for f in t.version.files) < 1 << 20
    rows = lambda: [spark.read.parquet(f"{t.root}/{f}").count() for f in t.version.files]
    assert sum(rows()) == 8_000 and max(rows()) < 4_000 and t.query(limit=3).collect() == wide.limit(3).collect()
    t.compact(1)
    assert len(t.version.files) == 1
    assert t.delete("id >= 7900") == 100
    assert sum(rows()) == 7_900 and max(rows()) < 4_000
    t.check()
