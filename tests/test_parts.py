import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from colonnade import queries
from colonnade.errors import PrimaryKeyViolation, StorageError, ValidationError
from colonnade.operators.constraints import Constraints
from colonnade.sources import files, parts
from colonnade.sources.document import Document, from_frame, to_frame, to_json
from colonnade.types import NAMES

KINDS = [(f"c {k}", k) for k in NAMES]


@pytest.fixture()
def small(monkeypatch):
    """Marks, chunks and blocks of a few rows, so that all of them meet in small tables. Tasks of a local run are forked with them."""
    for name, n in (("MARK", 8), ("CHUNK_ROWS", 16), ("BLOCK", 61)):
        monkeypatch.setattr(parts, name, n)


def odd_document(n):
    rng = random.Random(n)
    texts = ["", "é\"\\", "\\", '],"data":{"x":[1,', "a,b", "\n\t", "x" * 90, "日本", "null"]
    plain = {
        "int": lambda: rng.choice([0, -1, 2**63 - 1, -(2**63), rng.randrange(1000)]), "float": lambda: rng.choice([0.0, -1.5, 1e300, rng.random()]), "string": lambda: rng.choice(texts),
        "boolean": lambda: rng.random() < 0.5, "date": lambda: rng.choice(["2024-02-29T23:59:59Z", "1969-12-31T00:00:00.000001Z", "0002-01-01T00:00:00Z"]),
    }
    cell = lambda kind: [None if rng.random() < 0.2 else plain[kind[6:-1]]() for _ in range(rng.randrange(4))] if kind.startswith("array<") else plain[kind]()
    return Document(KINDS, {c: [None if rng.random() < 0.2 else cell(kind) for _ in range(n)] for c, kind in KINDS}, Constraints(), extensions={"data": {"a": [1, 2]}, "n": [[], {}]}, lsn=3)


@pytest.mark.parametrize("form", files.FORMS)
@pytest.mark.parametrize("n", [0, 1, 8, 203])
def test_same_as_whole(spark, tmp_path, small, form, n):
    """Documents of parts are those that are written as a whole, and are read the same."""
    doc, path, whole = odd_document(n), str(tmp_path / "parts"), str(tmp_path / "whole")
    df = to_frame(spark, doc).repartition(3) if n else to_frame(spark, doc)
    df = df.localCheckpoint() if n else df
    parts.save_frame(df, path, KINDS, form, extensions=doc.extensions, lsn=3)
    expected = from_frame(df, KINDS, extensions=doc.extensions, lsn=3)
    assert files.load(path) == expected
    files.save(expected, whole, form)
    with open(path, "rb") as a, open(whole, "rb") as b:
        assert form == "compressed" or a.read() == b.read()
    assert os.listdir(tmp_path) and not [x for x in os.listdir(tmp_path) if ".parts-" in x]
    read = parts.load_frame(spark, path)
    assert read.schema == df.schema and read.collect() == to_frame(spark, expected).collect()
    assert parts.load_frame(spark, path, {"c date", "c array<string>"}).collect() == to_frame(spark, expected).select("`c date`", "`c array<string>`").collect()


def test_json_of_others(spark, tmp_path, small):
    """Indentation, other orders of members, spaces between cells, indexes, and a log."""
    doc, path = odd_document(50), str(tmp_path / "one")
    doc.indexes = {"c string": "hash", "c int": "sorted"}
    raw = json.loads(to_json(doc))
    expected = to_frame(spark, doc).collect()
    for text in (to_json(doc, True), json.dumps(dict(reversed(raw.items()))), json.dumps(raw, ensure_ascii=True, separators=(" , ", " : "))):
        with open(path, "w") as f:
            f.write(text)
        assert parts.load_frame(spark, path).collect() == expected
    files.append_log(path, [{"op": "delete_legacy", "indices": [0]}])
    assert parts.load_frame(spark, path).collect() == expected[1:]


def test_refusals(spark, tmp_path, small):
    path = str(tmp_path / "one")
    doc = Document([("id", "int"), ("s", "string")], {"id": [1, 2, 1], "s": ["a", "b", "c"]}, Constraints("id"))
    files.save(doc, path, "json")
    with pytest.raises(PrimaryKeyViolation):
        parts.load_frame(spark, path)
    raw = json.loads(to_json(doc)) | {"rowCount": 2, "meta": {}}
    with open(path, "w") as f:
        json.dump(raw, f)
    with pytest.raises(ValidationError):
        parts.load_frame(spark, path)
    with open(path, "w") as f:
        json.dump(raw | {"rowCount": 3, "data": {"id": [1, 2, "3"], "s": ["a", "b", "c"]}}, f)
    with pytest.raises(Exception, match="TypeMismatch"):
        parts.load_frame(spark, path).collect()
    files.save(doc, path)
    with open(path, "rb") as f:
        content = f.read()
    for cut in (3, 20, 40, len(content) - 3):
        with open(path, "wb") as f:
            f.write(content[:cut])
        with pytest.raises(StorageError):
            parts.load_frame(spark, path).collect()
    with pytest.raises(StorageError):
        parts.save_frame(spark.sql("SELECT repeat('x', 70000) AS s"), path, [("s", "string")])
    files.save(doc, path)
    held = parts.load_frame(spark, path)
    files.save(Document(doc.columns, {"id": [1], "s": ["q"]}), path)
    with pytest.raises(Exception, match="has changed"):
        held.collect()


def test_no_whole_table_on_the_driver(spark, sf, monkeypatch):
    """The document queries neither collect the rows nor build a document of them."""

    def refuse(*_, **__):
        raise AssertionError("the driver holds all rows")

    for name in ("from_frame", "to_frame"):
        monkeypatch.setattr(queries, name, refuse)
    monkeypatch.setattr(files, "load", refuse)
    monkeypatch.setattr(files, "save", refuse)
    monkeypatch.setattr(parts, "to_frame", refuse)
    n = queries.table(spark, sf, "orders").count()
    for name in ("document_json", "document_binary", "document_compressed", "document_columns"):
        assert queries.QUERIES[name](spark, sf).count() == n


def test_string_cells_of_slices():
    column = pa.array(["zz", "a", None, "bcd", "q"])[1:4]
    assert parts._string_cells(column) == b"\x01\x00a\x00\x00\x03\x00bcd"
    assert parts._strings(b"\x01\x00a\x00\x00\x03\x00bcd", 3, np.array([False, True, False])).to_pylist() == ["a", None, "bcd"]
