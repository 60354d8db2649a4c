"""Document files of any number of rows, written from and read into DataFrames.

Writing: each task appends the columns of its rows, a chunk at a time, to one file of parts beside the
document; the driver then copies the parts into the document, column by column and in the order of the
tasks, so it holds a block at a time. Reading: the driver steps over the file in blocks and notes where
every ``MARK``-th cell of a column begins; tasks decode the cells between marks. The document's folder is
one that driver and executors share. A frame reads the file when it is used, and fails if the file has
changed since. What is parsed on the driver as a whole is all of a JSON document but its cells.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError, TypeMismatch
from ..operators import constraints as con
from ..operators.constraints import Constraints
from ..operators.query import in_utc
from ..types import NAMES, accepts, parse_date, spark_schema
from . import binary
from .document import ARROW, VERSION, Document, meta_of, parse_document, to_frame
from .files import FORMS, form_of, load, locked, log_path, published, read_log

#: Cells between two noted places of a column; a multiple of 8, so that bits can be read from each.
MARK = 8_192
#: Bounds of a chunk, in rows and in bytes of the file.
CHUNK_ROWS, CHUNK_BYTES = 131_072, 32 << 20
#: Bytes that the driver holds of a file at a time.
BLOCK = 4 << 20


# -- writing ---------------------------------------------------------------------------------


def _string_cells(column: pa.Array) -> bytes:
    """Strings behind their lengths, nulls as empty ones."""
    full = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(full.buffers()[1], np.int64, len(full) + 1, full.offset * 8)
    sizes = np.diff(offsets)
    if len(sizes) and sizes.max() >= 1 << 16:
        raise StorageError("a string is too long for the binary format")
    out = np.empty(int(offsets[-1] - offsets[0]) + 2 * len(sizes), np.uint8)
    at = offsets[:-1] - offsets[0] + 2 * np.arange(len(sizes))
    text = np.ones(len(out), bool)
    text[at] = text[at + 1] = False
    out[at], out[at + 1] = sizes & 255, sizes >> 8
    out[text] = np.frombuffer(full.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return out.tobytes()


def _flags(column: pa.Array) -> bytes:
    """Booleans as bits."""
    return np.packbits(np.asarray(column), bitorder="little").tobytes()


def _cells(column: pa.Array, kind: str, form: str) -> bytes:
    """The cells of a chunk as they stand in a document; times come as text."""
    if form == "json":
        return json.dumps(column.to_pylist(), ensure_ascii=False, separators=(",", ":"))[1:-1].encode()
    if kind == "int":
        return np.asarray(pc.fill_null(column.cast(pa.int64()), 0)).astype("<i8").tobytes()
    if kind == "float":
        return np.asarray(pc.fill_null(column.cast(pa.float64()), 0.0)).astype("<f8").tobytes()
    if kind == "boolean":
        return _flags(pc.fill_null(column, False))
    if kind.startswith("array<"):
        return binary.array_cells(column.to_pylist(), kind)
    return _string_cells(column)


def _write_parts(df: DataFrame, columns: list[tuple[str, str]], folder: str, form: str) -> list[tuple[str, list[tuple[int, list[tuple[int, int, int, int]]]]]]:
    """By task, in their order: its file, and by chunk the rows and for each column where its nulls begin, its cells begin and end, and a zero."""

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        index, wrong, held, rows, size = [], None, [], 0, 0
        with open(path, "wb") as f:

            def flush():
                table = pa.Table.from_batches(held).combine_chunks()
                places = []
                for i, (_, kind) in enumerate(columns):
                    column = table.column(i).chunk(0)
                    start = f.tell()
                    if form != "json":
                        f.write(_flags(column.is_null()))
                    cells = f.tell()
                    f.write(_cells(column, kind, form))
                    places.append((start, cells, f.tell(), 0))
                index.append((table.num_rows, places))

            try:
                for batch in batches:
                    # a batch of long cells is cut, so that a chunk keeps its bound
                    step = max(1, int(batch.num_rows * min(1.0, CHUNK_BYTES / max(batch.nbytes, 1))))
                    for at in range(0, batch.num_rows, step):
                        part = batch.slice(at, step)
                        held.append(part)
                        rows, size = rows + part.num_rows, size + part.nbytes
                        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                            flush()
                            held, rows, size = [], 0, 0
                if rows:
                    flush()
            except StorageError as e:
                wrong = str(e)
                for _ in batches:
                    pass
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "path": [path], "index": [json.dumps(index)], "wrong": [wrong]}, pa.schema([("task", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("wrong", pa.string())]))

    found = sorted(df.mapInArrow(write, "task int, path string, index string, wrong string").collect())
    for r in found:
        if r["wrong"]:
            raise StorageError(r["wrong"])
    return [(r["path"], json.loads(r["index"])) for r in found]


def _blocks(f: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    f.seek(start)
    while start < end:
        block = f.read(min(BLOCK, end - start))
        if not block:
            raise StorageError("the file ends too early")
        start += len(block)
        yield block


class _Bits:
    """Bits of chunks of any number of rows, put together without gaps."""

    def __init__(self, out: BinaryIO):
        self.out, self.rest = out, np.zeros(0, np.uint8)

    def add(self, packed: bytes, n: int) -> None:
        bits = np.concatenate([self.rest, np.unpackbits(np.frombuffer(packed, np.uint8), count=n, bitorder="little")])
        whole = len(bits) // 8 * 8
        self.out.write(np.packbits(bits[:whole], bitorder="little").tobytes())
        self.rest = bits[whole:]

    def end(self) -> None:
        self.out.write(np.packbits(self.rest, bitorder="little").tobytes())


def _assemble(out: BinaryIO, parts: list, doc: Document, n: int, form: str) -> None:
    """The parts as a document; ``doc`` has its fields and no cells."""

    def each(i: int) -> Iterator[tuple[BinaryIO, int, int, int, int]]:
        for path, index in parts:
            with open(path, "rb") as f:
                for rows, places in index:
                    yield f, rows, *places[i][:3]

    if form == "json":
        fields = {"version": VERSION, "columns": [{"name": c, "type": t} for c, t in doc.columns], "rowCount": n}
        dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        out.write((dump(fields)[:-1] + ',"data":{').encode())
        for i, (name, _) in enumerate(doc.columns):
            out.write(f"{',' if i else ''}{dump(name)}:[".encode())
            for k, (f, _rows, _start, cells, end) in enumerate(each(i)):
                if k:
                    out.write(b",")
                for block in _blocks(f, cells, end):
                    out.write(block)
            out.write(b"]")
        out.write(("}," + dump({"meta": meta_of(doc.rules), "indexes": {}, "extensions": doc.extensions, "lsn": doc.lsn})[1:]).encode())
        return
    out.write(binary.head(doc, n))
    for i, (_, kind) in enumerate(doc.columns):
        nulls = _Bits(out)
        for f, rows, start, cells, _end in each(i):
            f.seek(start)
            nulls.add(f.read(cells - start), rows)
        nulls.end()
        flags = _Bits(out)
        for f, rows, _start, cells, end in each(i):
            if kind == "boolean":
                f.seek(cells)
                flags.add(f.read(end - cells), rows)
            else:
                for block in _blocks(f, cells, end):
                    out.write(block)
        if kind == "boolean":
            flags.end()
    out.write(binary.tail(doc))


def save_frame(df: DataFrame, path: str, columns: list[tuple[str, str]], form: str = "binary", rules: Constraints | None = None, extensions: object = None, lsn: int = 0) -> None:
    """Write a whole DataFrame as one document, its rows in their order; the log beside it is then spent. Indexes are not stored."""
    if form not in FORMS:
        raise StorageError(f"unknown format '{form}'")
    if bad := [c for c, kind in columns if kind not in NAMES]:
        raise StorageError(f"column '{bad[0]}' has no type of a document")
    doc = Document(columns, {c: [] for c, _ in columns}, rules or Constraints(), extensions={} if extensions is None else extensions, lsn=lsn)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    parts = []
    try:
        parts = _write_parts(in_utc(df.select(*[F.col(f"`{c}`") for c, _ in columns])), columns, folder, form)
        n = sum(rows for _, index in parts for rows, _ in index)
        with locked(path), published(path) as f:
            if form == "compressed":
                f.write(binary.MAGIC_COMPRESSED)
                with zstandard.ZstdCompressor(level=binary.ZSTD_LEVEL).stream_writer(f, closefd=False) as packed:
                    _assemble(packed, parts, doc, n, form)
            else:
                _assemble(f, parts, doc, n, form)
    finally:
        if os.path.isdir(folder):
            for name in os.listdir(folder):
                os.remove(f"{folder}/{name}")
            os.rmdir(folder)


# -- reading ---------------------------------------------------------------------------------


@dataclass
class _Place:
    """Where a column's cells are: of fixed width from ``cells`` on, else between ``marks``, which end with the end of the last cell."""

    nulls: int = 0
    cells: int = 0
    marks: list[int] = field(default_factory=list)
    count: int = 0


class _Stepper:
    """Reads a binary document in blocks and steps over its cells. It is the source of a ``binary.Reader``."""

    def __init__(self, f: BinaryIO):
        self.f, self.block, self.base, self.at = f, b"", f.tell(), 0
        self.size = os.fstat(f.fileno()).st_size

    @property
    def place(self) -> int:
        return self.base + self.at

    def _fill(self, n: int) -> None:
        self.block = self.block[self.at :] + self.f.read(max(BLOCK, n))
        self.base, self.at = self.base + self.at, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.block):
            self._fill(n)
            if n > len(self.block):
                raise StorageError("the file ends too early")
        self.at += n
        return self.block[self.at - n : self.at]

    def jump(self, n: int) -> None:
        if self.at + n <= len(self.block):
            self.at += n
            return
        to = self.place + n
        if to > self.size:
            raise StorageError("the file ends too early")
        self.f.seek(to)
        self.block, self.base, self.at = b"", to, 0

    def strings(self, n: int) -> None:
        while n:
            block, at, last = self.block, self.at, len(self.block) - 2
            while n and at <= last:
                to = at + 2 + (block[at] | block[at + 1] << 8)
                if to > last + 2:
                    break
                at, n = to, n - 1
            self.at = at
            if n:
                before = len(block) - at
                self._fill(0)
                if len(self.block) == before:
                    raise StorageError("the file ends too early")


def _binary_places(f: BinaryIO, only: set[str] | None) -> tuple[Document, int, dict[str, _Place]]:
    step = _Stepper(f)
    r = binary.Reader(step)
    version, columns, n, rules = binary.read_head(r)
    places = {}
    for name, kind in columns:
        p = _Place(step.place, count=n)
        if not kind.startswith("array<"):
            step.jump((n + 7) // 8)
        p.cells = step.place
        if kind in ("int", "float"):
            step.jump(8 * n)
        elif kind == "boolean":
            step.jump((n + 7) // 8)
        else:
            if kind.startswith("array<"):
                step.jump((n + 7) // 8)
            done = 0
            with open(f.name, "rb") as again:
                again.seek(p.nulls)
                while done < n:
                    k = min(MARK, n - done)
                    p.marks.append(step.place)
                    if kind == "string" or kind == "date":
                        step.strings(k)
                    else:
                        bits = np.unpackbits(np.frombuffer(again.read((k + 7) // 8), np.uint8), count=k, bitorder="little")
                        for null in bits.tolist():
                            size = r.number("<I")
                            if not null:
                                step.jump((size + 7) // 8)
                                if kind in ("array<int>", "array<float>"):
                                    step.jump(8 * size)
                                elif kind == "array<string>":
                                    step.strings(size)
                    done += k
            p.marks.append(step.place)
        if only is None or name in only:
            places[name] = p
    doc = Document([c for c in columns if c[0] in places], {c: [] for c in places}, rules)
    if version == binary.VERSION_2:
        binary.read_tail(r, doc)
    return doc, n, places


_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*\Z', re.DOTALL)
_OPEN, _CLOSE, _COMMA = 1, 2, 3
_SIGNS = np.zeros(256, np.uint8)
for _c, _s in ((b"{", _OPEN), (b"[", _OPEN), (b"}", _CLOSE), (b"]", _CLOSE), (b",", _COMMA)):
    _SIGNS[_c[0]] = _s
#: Depths of the data object's members, and of what they hold.
_MEMBERS = 2


class _Unusual(Exception):
    """A document that only the reader of whole documents tells right."""


def _signs(f: BinaryIO) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: its place, its bytes, and where brackets and commas outside strings are, which they are, and the depth behind each."""
    base, inside, odd, depth = f.tell(), 0, False, 0
    while block := f.read(BLOCK):
        b = np.frombuffer(block, np.uint8)
        quotes = b == ord('"')
        slashes = np.flatnonzero(b == ord("\\"))
        if odd or len(slashes):
            after = []  # characters behind an odd number of backslashes
            first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            last = np.append(first[1:], len(slashes)) - 1 if len(slashes) else first
            starts, ends = slashes[first], slashes[last]
            length = ends - starts + 1
            if odd and len(starts) and starts[0] == 0:
                length[0] += 1
            elif odd:
                after.append(np.array([0]))
            after.append(ends[length % 2 == 1] + 1)
            escaped = np.concatenate(after)
            odd = bool(len(escaped) and escaped[-1] == len(b))
            quotes[escaped[escaped < len(b)]] = False
        within = (np.cumsum(quotes, dtype=np.uint8) + np.uint8(inside)) & 1
        inside = int(within[-1])
        found = _SIGNS[b]
        found[within == 1] = 0
        at = np.flatnonzero(found)
        signs = found[at]
        depths = depth + np.cumsum((signs == _OPEN).astype(np.int64) - (signs == _CLOSE))
        depth = int(depths[-1]) if len(at) else depth
        yield base, block, at, signs, depths
        base += len(block)


def _json_places(f: BinaryIO) -> tuple[Document, int, dict[str, _Place]]:
    frame, columns = [], {}  # the text outside the columns' cells
    in_data, now = False, None  # the column whose cells are passed
    for base, block, at, signs, depths in _signs(f):
        kept = 0  # from here on the block is not yet in the frame
        commas = at[(signs == _COMMA) & (depths == _MEMBERS + 1)]
        heads = ((signs == _OPEN) & (depths <= _MEMBERS + 1)) | ((signs == _CLOSE) & (depths <= _MEMBERS))
        seen = 0
        for i in np.flatnonzero(heads).tolist():
            place, opens, depth = int(at[i]), signs[i] == _OPEN, int(depths[i])
            if now is not None:  # only the end of its cells can come
                seen = _pass(now, commas, seen, place, base)
                now.marks.append(base + place)
                now, kept = None, place
            elif opens and depth in (_MEMBERS, _MEMBERS + 1) and (depth == _MEMBERS or in_data):
                frame.append(block[kept:place])
                kept = place
                key = _KEY.search(b"".join(frame[-3:]))
                name = json.loads(key[1]) if key else None
                if depth == _MEMBERS:
                    if name == "data" and (columns or block[place] != ord("{")):
                        raise _Unusual
                    in_data = name == "data"
                elif block[place] == ord("[") and name is not None and name not in columns:
                    now = columns[name] = _Place(marks=[base + place + 1], count=1)
                    frame.append(b"[")
                    seen = int(np.searchsorted(commas, place))
                else:
                    raise _Unusual
            elif not opens and depth == _MEMBERS - 1:
                in_data = False
        if now is not None:
            _pass(now, commas, seen, len(block), base)
        else:
            frame.append(block[kept:])
    raw = json.loads(b"".join(frame))
    for p in columns.values():
        if p.count == 1 and not any(x.strip() for x in _blocks(f, p.marks[0], p.marks[-1])):
            p.count = 0
    doc = parse_document(raw, {c: p.count for c, p in columns.items()})
    return doc, raw["rowCount"], columns


def _pass(p: _Place, commas: np.ndarray, seen: int, end: int, base: int) -> int:
    """Count a column's cells up to ``end`` and note every ``MARK``-th."""
    to = int(np.searchsorted(commas, end))
    first = (-p.count) % MARK  # commas before that of the next mark: the cell behind it has a multiple of MARK before it
    p.marks += (commas[seen:to][first::MARK] + base + 1).tolist()
    p.count += to - seen
    return to


def _as_arrow(cells: list, name: str, kind: str) -> pa.Array:
    """Checked JSON cells."""
    kinds = {"int": {int}, "float": {int, float}, "boolean": {bool}}.get(kind, {str})
    plain = set(map(type, cells)) <= kinds | {type(None)}
    if kind == "date" and plain and (times := _plain_times(pa.array(cells, pa.string()))) is not None:
        return times
    if kind.startswith("array<") or kind == "date" or not plain:
        for i, v in enumerate(cells):
            if not accepts(v, kind):
                raise TypeMismatch(name, i, kind, type(v).__name__)
    if kind == "date":
        cells = [None if v is None else parse_date(v) for v in cells]
    elif kind == "float":
        cells = [None if v is None else float(v) for v in cells]
    elif kind == "array<float>":
        cells = [None if v is None else [None if e is None else float(e) for e in v] for v in cells]
    try:
        return pa.array(cells, _type(kind))
    except OverflowError as e:
        raise TypeMismatch(name, 0, kind, "int") from e


def _type(kind: str) -> pa.DataType:
    return pa.list_(ARROW[kind[6:-1]]) if kind.startswith("array<") else ARROW[kind]


_PLAIN_TIME = r"^([1-9]\d{3}|0[1-9]\d\d|00[1-9]\d|000[1-9])-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$"


def _plain_times(texts: pa.Array) -> pa.Array | None:
    """Times from text, where all are written the usual way."""
    if pc.all(pc.match_substring_regex(texts, _PLAIN_TIME), min_count=0).as_py():
        try:
            return texts.cast(ARROW["date"])
        except pa.ArrowInvalid:
            pass
    return None


def _times(texts: pa.Array) -> pa.Array:
    """Times from text; what is none is null, as it is for a whole document."""
    found = _plain_times(texts)
    return found if found is not None else pa.array([None if v is None else parse_date(v) for v in texts.to_pylist()], ARROW["date"])


def _strings(raw: bytes, n: int, nulls: np.ndarray) -> pa.Array:
    starts, at = np.empty(n, np.int64), 0
    for i in range(n):
        starts[i] = at
        at += 2 + (raw[at] | raw[at + 1] << 8)
    b = np.frombuffer(raw, np.uint8)
    sizes = b[starts].astype(np.int64) | b[starts + 1].astype(np.int64) << 8
    text = np.ones(len(b), bool)
    text[starts] = text[starts + 1] = False
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = pa.Array.from_buffers(pa.large_binary(), n, [_valid(nulls), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b[text].tobytes())])
    try:
        return found.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid as e:
        raise StorageError("a string is not UTF-8") from e


def _valid(nulls: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())


def _span(f: BinaryIO, start: int, end: int) -> bytes:
    f.seek(start)
    raw = f.read(end - start)
    if len(raw) < end - start:
        raise StorageError("the file ends too early")
    return raw


def _decode(f: BinaryIO, name: str, kind: str, p: tuple[int, int, int, int], first: int, n: int, form: str) -> pa.Array:
    """``n`` cells of a column from row ``first`` on."""
    nulls_at, cells_at, start, end = p
    if form == "json":
        try:
            return _as_arrow(_exactly(json.loads(b"[" + _span(f, start, end).rstrip(b", \t\r\n") + b"]"), n), name, kind)
        except ValueError as e:
            raise StorageError(f"not a JSON document: {e}") from e
    bits = lambda at: np.unpackbits(np.frombuffer(_span(f, at + first // 8, at + (first + n + 7) // 8), np.uint8), count=n, bitorder="little").astype(bool)
    nulls = bits(nulls_at)
    if kind in ("int", "float"):
        raw = _span(f, cells_at + 8 * first, cells_at + 8 * (first + n))
        return pa.Array.from_buffers(_type(kind), n, [_valid(nulls), pa.py_buffer(raw)])
    if kind == "boolean":
        return pa.array(bits(cells_at), mask=nulls)
    raw = _span(f, start, end)
    if kind.startswith("array<"):
        return pa.array(binary.Reader(raw).arrays(nulls.tolist(), kind), _type(kind))
    texts = _strings(raw, n, nulls)
    return _times(texts) if kind == "date" else texts


def _exactly(cells: list, n: int) -> list:
    if len(cells) != n:
        raise StorageError(f"{len(cells)} cells stand where {n} should")
    return cells


def _stamp(path: str) -> tuple[int, int]:
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns


def _unpack(path: str) -> str:
    """A compressed document, unpacked beside it in blocks: the tasks read parts of it."""
    with open(path, "rb") as f, tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(path)), prefix=f"{os.path.basename(path)}.unpacked-", delete=False) as out:
        os.fchmod(out.fileno(), 0o644)
        fcntl.flock(f, fcntl.LOCK_SH)
        f.seek(len(binary.MAGIC_COMPRESSED))
        try:
            zstandard.ZstdDecompressor().copy_stream(f, out)
        except zstandard.ZstdError as e:
            raise StorageError(f"broken compressed file: {e}") from e
    return out.name


def load_frame(spark: SparkSession, path: str, only: Iterable[str] | None = None) -> DataFrame:
    """A document's rows in their order, of all columns or those in ``only``. With a log beside it, it is read as a whole.

    A compressed document is unpacked beside itself; the unpacked file can go when the frame's rows have been read. The rules of a JSON document
    are checked here and its cells when they are read.
    """
    only = None if only is None else set(only)
    if os.path.exists(log_path(path)) and read_log(path):
        return _chosen(to_frame(spark, load(path)), only)
    with open(path, "rb") as f:
        fcntl.flock(f, fcntl.LOCK_SH)
        form = form_of(f.read(4))
        if form == "compressed":
            path = _unpack(path)
        stamp = _stamp(path)
    with open(path, "rb") as f:
        try:
            doc, n, places = _json_places(f) if form == "json" else _binary_places(f, only)
        except _Unusual:
            return _chosen(to_frame(spark, load(path)), only)
        except ValueError as e:
            raise StorageError(f"neither a binary nor a JSON document: {e}") from e
    frame = _frame(spark, path, stamp, form, doc.columns, n, places)
    if form == "json":
        con.check(frame, doc.rules)
    return _chosen(frame, only)


def _chosen(df: DataFrame, only: set[str] | None) -> DataFrame:
    return df if only is None else df.select(*[F.col(f"`{c}`") for c in df.columns if c in only])


def _frame(spark: SparkSession, path: str, stamp: tuple[int, int], form: str, columns: list[tuple[str, str]], n: int, places: dict[str, _Place]) -> DataFrame:
    schema = spark_schema(columns)
    if not n:
        return spark.createDataFrame([], schema)
    marks = max(1, min(CHUNK_ROWS, CHUNK_BYTES * n // stamp[0]) // MARK)  # a chunk's
    chunks = -(-n // (marks * MARK))
    found = [
        [(p.nulls, p.cells, p.marks[k * marks], p.marks[min((k + 1) * marks, len(p.marks) - 1)]) if p.marks else (p.nulls, p.cells, 0, 0) for p in (places[c] for c, _ in columns)]
        for k in range(chunks)
    ]

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if _stamp(path) != stamp:
                    raise StorageError(f"{path} has changed since the frame was made")
                first = k * marks * MARK
                rows = min(marks * MARK, n - first)
                with open(path, "rb") as f:
                    arrays = [_decode(f, c, kind, p, first, rows, form) for (c, kind), p in zip(columns, found[k], strict=True)]
                yield from pa.Table.from_arrays(arrays, [c for c, _ in columns]).to_batches(10_000)

    return spark.range(0, chunks, 1, chunks).mapInArrow(read, schema)
