"""The binary form of a document, versions 1 and 2, and its zstd wrapping."""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

from ..errors import StorageError
from ..operators.constraints import Constraints
from ..types import NAMES
from .document import INDEX_KINDS, Document, index_map, sorted_keys

# Fixed values of the file format.
MAGIC = b"VTFb"
MAGIC_COMPRESSED = b"VTFz"
VERSION_1, VERSION_2 = 1, 2
ZSTD_LEVEL = 3


def _text(value: str, width: str = "<H") -> bytes:
    raw = value.encode()
    if len(raw) >= 1 << (8 * struct.calcsize(width)):
        raise StorageError("a string is too long for the binary format")
    return struct.pack(width, len(raw)) + raw


def _bits(flags: list[bool]) -> bytes:
    return np.packbits(np.array(flags, bool), bitorder="little").tobytes()


def _plain(cells: list, kind: str) -> bytes:
    if kind == "int":
        return np.array([0 if v is None else v for v in cells], "<i8").tobytes()
    if kind == "float":
        return np.array([0.0 if v is None else v for v in cells], "<f8").tobytes()
    if kind == "boolean":
        return _bits([bool(v) for v in cells])
    return b"".join(_text(v or "") for v in cells)


def _column(cells: list, kind: str) -> bytes:
    nulls = _bits([v is None for v in cells])
    if not kind.startswith("array<"):
        return nulls + _plain(cells, kind)
    return nulls + array_cells(cells, kind)


def array_cells(cells: list, kind: str) -> bytes:
    """An array column behind its nulls."""
    out = []
    for v in cells:
        out.append(struct.pack("<I", len(v or [])))
        if v is not None:
            out += [_bits([e is None for e in v]), _plain(v, kind[6:-1])]
    return b"".join(out)


def encode(doc: Document) -> bytes:
    """Version 2."""
    return b"".join([head(doc, doc.row_count), *(_column(doc.data[n], t) for n, t in doc.columns), tail(doc)])


def head(doc: Document, n: int) -> bytes:
    """What stands before the columns of ``n`` rows."""
    out = [MAGIC, bytes([VERSION_2]), struct.pack("<II", len(doc.columns), n)]
    out += [_text(n) + bytes([NAMES.index(t)]) for n, t in doc.columns]
    out.append(b"\x01" + _text(doc.rules.primary_key) if doc.rules.primary_key else b"\x00")
    return b"".join(out)


def tail(doc: Document) -> bytes:
    """What stands behind the columns."""
    out = []
    for names in (doc.rules.unique, doc.rules.not_null):
        out += [struct.pack("<I", len(names)), *map(_text, names)]
    out.append(_text(json.dumps(doc.rules.defaults, ensure_ascii=False), "<I"))
    out.append(struct.pack("<I", len(doc.indexes)))
    kinds = dict(doc.columns)
    for c, kind in doc.indexes.items():
        places, keys = index_map(doc, c), sorted_keys(doc, c) if kind == "sorted" else []
        out += [_text(c), bytes([INDEX_KINDS.index(kind), NAMES.index(kinds[c])]), struct.pack("<I", len(places))]
        out += [_text(k) + struct.pack(f"<I{len(r)}I", len(r), *r) for k, r in places.items()]
        out += [struct.pack("<I", len(keys)), *map(_text, keys)]
    out += [struct.pack("<Q", doc.lsn), _text(json.dumps(doc.extensions, ensure_ascii=False), "<I")]
    return b"".join(out)


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise StorageError("the file ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]


class Reader:
    """Values from bytes, or from a source whose ``take`` gives them."""

    def __init__(self, source):
        self.take = (_Bytes(source) if isinstance(source, bytes) else source).take

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self, width: str = "<H") -> str:
        try:
            return self.take(self.number(width)).decode()
        except UnicodeDecodeError as e:
            raise StorageError("a string is not UTF-8") from e

    def bits(self, n: int) -> list[bool]:
        return np.unpackbits(np.frombuffer(self.take((n + 7) // 8), np.uint8), count=n, bitorder="little").astype(bool).tolist()

    def plain(self, n: int, kind: str) -> list:
        if kind in ("int", "float"):
            return np.frombuffer(self.take(8 * n), "<i8" if kind == "int" else "<f8").tolist()
        if kind == "boolean":
            return self.bits(n)
        return [self.text() for _ in range(n)]

    def column(self, n: int, kind: str) -> list:
        nulls = self.bits(n)
        if not kind.startswith("array<"):
            return [None if null else v for null, v in zip(nulls, self.plain(n, kind), strict=True)]
        return self.arrays(nulls, kind)

    def arrays(self, nulls: list[bool], kind: str) -> list:
        out = []
        for null in nulls:
            size = self.number("<I")
            if null:
                out.append(None)
                continue
            inner = self.bits(size)
            out.append([None if x else v for x, v in zip(inner, self.plain(size, kind[6:-1]), strict=True)])
        return out

    def skip(self, n: int, kind: str) -> None:
        """Step over a column without building its values."""
        nulls = self.bits(n)
        if kind.startswith("array<"):
            for null in nulls:
                size = self.number("<I")
                if not null:
                    self.take((size + 7) // 8)
                    self._skip_plain(size, kind[6:-1])
        else:
            self._skip_plain(n, kind)

    def _skip_plain(self, n: int, kind: str) -> None:
        if kind in ("int", "float"):
            self.take(8 * n)
        elif kind == "boolean":
            self.take((n + 7) // 8)
        else:
            for _ in range(n):
                self.take(self.number("<H"))


def read_head(r: Reader) -> tuple[int, list[tuple[str, str]], int, Constraints]:
    """Version, columns, rows and the primary key."""
    if r.take(4) != MAGIC:
        raise StorageError("not a binary table file")
    version = r.number("<B")
    if version not in (VERSION_1, VERSION_2):
        raise StorageError(f"unknown binary version {version}")
    n_columns, n = r.number("<I"), r.number("<I")
    columns = []
    for _ in range(n_columns):
        name, kind = r.text(), r.number("<B")
        if kind >= len(NAMES):
            raise StorageError(f"unknown type byte {kind}")
        columns.append((name, NAMES[kind]))
    return version, columns, n, Constraints(r.text() if r.number("<B") else None)


def read_tail(r: Reader, doc: Document) -> None:
    """What stands behind the columns, into the document."""
    rules = doc.rules
    rules.unique = [r.text() for _ in range(r.number("<I"))]
    rules.not_null = [r.text() for _ in range(r.number("<I"))]
    rules.defaults = json.loads(r.text("<I"))
    for _ in range(r.number("<I")):
        column, kind = r.text(), r.number("<B")
        if kind >= len(INDEX_KINDS):
            raise StorageError(f"unknown index type byte {kind}")
        r.number("<B")
        for _ in range(r.number("<I")):
            r.text()
            r.take(4 * r.number("<I"))
        for _ in range(r.number("<I")):
            r.text()
        if column in doc.data:
            doc.indexes[column] = INDEX_KINDS[kind]
    doc.lsn = r.number("<Q")
    doc.extensions = json.loads(r.text("<I"))


def decode(raw: bytes, only: set[str] | None = None) -> Document:
    """A document; with ``only``, other columns are stepped over and left out."""
    r = Reader(raw)
    version, columns, n, rules = read_head(r)
    data = {}
    for name, kind in columns:
        if only is None or name in only:
            data[name] = r.column(n, kind)
        else:
            r.skip(n, kind)
    doc = Document([c for c in columns if c[0] in data], data, rules)
    if version == VERSION_2:
        read_tail(r, doc)
    return doc


def encode_compressed(doc: Document) -> bytes:
    return MAGIC_COMPRESSED + zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(encode(doc))


def decode_compressed(raw: bytes, only: set[str] | None = None) -> Document:
    if raw[:4] != MAGIC_COMPRESSED:
        raise StorageError("not a compressed table file")
    try:
        return decode(zstandard.ZstdDecompressor().decompressobj().decompress(raw[4:]), only)
    except zstandard.ZstdError as e:
        raise StorageError(f"broken compressed file: {e}") from e
