"""``spark.read.format("colonnade")``: document files as a data source, one partition a file."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..types import kind_of, spark_schema


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.names = paths, schema.fieldNames()

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from .document import to_arrow
        from .files import load

        yield from to_arrow(load(partition.path, only=set(self.names))).select(self.names).to_batches()


#: Bounds of a document that a task writes: its rows, and their bytes in Arrow.
DOCUMENT_ROWS, DOCUMENT_BYTES = 131_072, 32 << 20


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _cells(column: pa.ChunkedArray | pa.Array, kind: str) -> list:
    """An Arrow column as the JSON values of a document; times are told in UTC to the microsecond."""
    if kind != "date":
        return column.to_pylist()
    micros = column.cast(pa.timestamp("us")).to_pylist()  # without zone: the UTC clock
    return [None if v is None else v.isoformat(timespec="microseconds").rstrip("0").rstrip(".") + "Z" for v in micros]


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows in their order, in groups of a document's bounds; a single batch of long cells is cut."""
    held, rows, size = [], 0, 0
    for batch in batches:
        step = max(1, int(min(batch.num_rows, DOCUMENT_ROWS) * min(1.0, DOCUMENT_BYTES / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if held and (rows + part.num_rows > DOCUMENT_ROWS or size + part.nbytes > DOCUMENT_BYTES):
                yield held
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
    if held:
        yield held


class _Writer(DataSourceArrowWriter):
    """Each task writes the rows of its partition as documents of a bounded size into a folder of the job's own; without rows, as an empty one.

    On commit the files of the successful attempts are moved beside the others, or take their place
    on overwrite; what other attempts have written goes with the job's folder.
    """

    def __init__(self, path: str, schema: StructType, form: str, overwrite: bool):
        self.path, self.form, self.overwrite = path, form, overwrite
        self.columns = [(f.name, kind_of(f.dataType)) for f in schema]
        self.own = f"{path}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.own, exist_ok=True)
        files: list[str] = []
        for batches in _bounded(iterator):
            files.append(self._document(batches))
        return _Written(files or [self._document([])])

    def _document(self, batches: list[pa.RecordBatch]) -> str:
        from ..operators.constraints import Constraints
        from .document import Document, check_rules
        from .files import save

        cells: dict[str, list] = {n: [] for n, _ in self.columns}
        for batch in batches:
            for i, (n, kind) in enumerate(self.columns):
                cells[n] += _cells(batch.column(i), kind)
        check_rules(self.columns, cells, Constraints())
        file = f"part-{uuid.uuid4().hex}"
        save(Document(self.columns, cells), f"{self.own}/{file}", self.form)
        return file

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        before = _documents(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                for file in m.files:
                    os.replace(f"{self.own}/{file}", f"{self.path}/{file}")
        for old in before:
            for name in (old, f"{old}.wal", f"{old}.lock"):
                if os.path.exists(name):
                    os.remove(name)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


def _documents(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path] if os.path.exists(path) else []
    return sorted(f"{path}/{n}" for n in os.listdir(path) if not n.startswith(("_", ".")) and not n.endswith((".lock", ".wal")))


class DocumentSource(DataSource):
    """Options: ``path`` (a file or folder that all machines share), ``columns`` (names to read, by comma) and, for writing, ``form`` (json, binary or compressed)."""

    @classmethod
    def name(cls) -> str:
        return "colonnade"

    def schema(self) -> StructType:
        from ..errors import QueryError
        from .files import load

        columns = load(_documents(self.options["path"])[0]).columns
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if missing := [c for c in wanted if c not in dict(columns)]:
            raise QueryError(f"column '{missing[0]}' does not exist")
        return spark_schema([(c, dict(columns)[c]) for c in wanted] if wanted else columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_documents(self.options["path"]), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, self.options.get("form", "binary"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
