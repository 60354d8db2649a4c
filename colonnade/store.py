"""Versioned tables: Parquet data files and a log of commits.

``root/_log/<version>.json`` holds a version's schema, constraints, layouts and statistics, and its
files: all of them in every ``FULL_EVERY``-th record, else those added and dropped since the version
before; its CRC-32 stands behind a tab. A commit is published by exclusive creation, so of two
writers that read the same version one gets ``Conflict``. Inserts add files and rewrite nothing;
deletes and updates rewrite only files that hold a selected row; add-column is a change of the
schema alone. A hidden column keeps the order of insertion, which limits follow.

Publishing is atomic on POSIX file systems (a link to a complete file) and on Hadoop file systems
whose create without overwrite is.
"""

from __future__ import annotations

import functools
import json
import os
import time
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Conflict, PrimaryKeyViolation, QueryError, SchemaError, StorageError
from .operators import aggregate as agg
from .operators import constraints as con
from .operators import mutate, query, stats, vector_search
from .operators.constraints import Constraints
from .plans.explain import Estimate, estimate
from .plans.expression import Expression, parse_filter
from .plans.predicate import compile_predicate, named
from .types import NAMES, accepts, spark_schema

ROW = "__row"
#: Parts of a data file's name below the root: data, folder, file.
FILE_PARTS = 3
LAYOUTS = ("hash", "sorted")
#: Records between two that list all files.
FULL_EVERY = 20
#: Rewriting aims at files of so many bytes in memory, where a task sorts them, and compaction comes by itself when a commit leaves so many files smaller than that on average.
FILE_BYTES, SMALL_FILES = 512 << 20, 200
#: Bytes of a row beside its cells where it is sorted: its length, nulls, and a pointer with its prefix in an array that doubles.
ROW_BYTES = 48


class _Files:
    """The few file operations that a log needs, on local paths or through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.local = "://" not in root and not root.startswith("file:")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = f"{self.root}/{folder}"
        if self.local:
            return sorted(os.listdir(path)) if os.path.isdir(path) else []
        p, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        path = f"{self.root}/{name}"
        if self.local:
            with open(path, encoding="utf-8") as f:
                return f.read()
        return self.spark.read.text(path, wholetext=True).first()[0]

    def create(self, name: str, content: str) -> bool:
        """Publish a file unless it exists."""
        path = f"{self.root}/{name}"
        if not self.local:
            p, fs = self._hadoop(path)
            try:
                out = fs.create(p, False)
            except Exception as e:  # py4j wraps the exists error
                if fs.exists(p):
                    return False
                raise StorageError(str(e)) from e
            out.write(bytearray(content.encode()))
            out.close()
            return True
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, path)
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True


@dataclass
class Version:
    number: int
    columns: list[tuple[str, str]]
    rules: Constraints
    files: list[str] = field(default_factory=list)
    row_count: int = 0
    next_row: int = 0
    layouts: dict[str, str] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)
    extensions: object = field(default_factory=dict)
    ops: list[str] = field(default_factory=list)
    #: Files of the last compaction; what came later counts towards the next.
    compacted: int = 0
    #: By stream, its last batch that is in the table.
    batches: dict[str, int] = field(default_factory=dict)
    #: Where not all files are listed: those added and dropped since the version before.
    change: tuple[list[str], list[str]] | None = None

    def to_text(self, old: Version | None = None) -> str:
        fields = self.__dict__ | {"rules": self.rules.__dict__}
        if old is not None and self.number % FULL_EVERY:
            before, now = set(old.files), set(self.files)
            fields |= {"files": [], "change": ([f for f in self.files if f not in before], [f for f in old.files if f not in now])}
        body = json.dumps(fields, ensure_ascii=False)
        return f"{body}\t{zlib.crc32(body.encode()):08x}"

    @classmethod
    def from_text(cls, text: str) -> Version:
        body, tab, check = text.rpartition("\t")
        if not tab or f"{zlib.crc32(body.encode()):08x}" != check.strip():
            raise StorageError("a commit record is damaged")
        raw = json.loads(body)
        raw["columns"] = [tuple(c) for c in raw["columns"]]
        raw["rules"] = Constraints(**raw["rules"])
        return cls(**raw)

    @classmethod
    def read(cls, files: _Files, number: int) -> Version:
        """A version with all its files, from its record and those back to the last full one."""
        found = cls.from_text(files.read(_log_name(number)))
        changes, at = [], found
        while at.change is not None:
            changes.append(at.change)
            at = cls.from_text(files.read(_log_name(at.number - 1)))
        listed = dict.fromkeys(at.files)
        for added, dropped in reversed(changes):
            for f in dropped:
                listed.pop(f, None)
            listed |= dict.fromkeys(added)
        found.files, found.change = list(listed), None
        return found


def _log_name(number: int) -> str:
    return f"_log/{number:020d}.json"


class Table:
    def __init__(self, spark: SparkSession, root: str, version: Version):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self._files = _Files(spark, root)

    # -- opening -----------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, columns: list[tuple[str, str]], rules: Constraints | None = None, extensions: object = None) -> Table:
        rules = rules or Constraints()
        kinds = dict(columns)
        if not columns or len(kinds) < len(columns) or any(k not in NAMES for k in kinds.values()) or ROW in kinds:
            raise SchemaError("columns need distinct names and known types")
        for c in [*([rules.primary_key] if rules.primary_key else []), *rules.unique, *rules.not_null, *rules.defaults]:
            if c not in kinds:
                raise SchemaError(f"a constraint names the unknown column '{c}'")
        for c, v in rules.defaults.items():
            if not accepts(v, kinds[c]):
                raise SchemaError(f"the default of '{c}' has the wrong type")
        first = Version(0, columns, rules, extensions={} if extensions is None else extensions, ops=["create"])
        if not _Files(spark, root).create(_log_name(0), first.to_text()):
            raise StorageError(f"a table exists at {root}")
        return cls(spark, root, first)

    @classmethod
    def open(cls, spark: SparkSession, root: str, number: int | None = None) -> Table:
        files = _Files(spark, root)
        if number is None:
            names = [n for n in files.names("_log") if n.endswith(".json")]
            if not names:
                raise StorageError(f"there is no table at {root}")
            number = int(names[-1].split(".")[0])
        return cls(spark, root, Version.read(files, number))

    @classmethod
    def from_document(cls, spark: SparkSession, root: str, doc) -> Table:
        """A new table with a document's rows, constraints and index hints."""
        from .sources.document import to_frame

        table = cls.create(spark, root, doc.columns, doc.rules, doc.extensions)
        if doc.row_count:
            table.append(to_frame(spark, doc))
        for c, kind in doc.indexes.items():
            table.create_layout(c, kind)
        return table

    # -- reading -----------------------------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return spark_schema(self.version.columns)

    def _stored(self, files: list[str] | None = None) -> DataFrame:
        files = self.version.files if files is None else files
        schema = T.StructType([*self.schema.fields, T.StructField(ROW, T.LongType(), True)])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    @property
    def df(self) -> DataFrame:
        return self._stored().drop(ROW)

    @property
    def row_count(self) -> int:
        return self.version.row_count

    def describe(self) -> list[str]:
        return [f"version {self.version.number}", f"files {len(self.version.files)}"]

    def query(self, condition: str | Expression | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Filter, then the first ``limit`` rows in insertion order, then project."""
        return query.query(self._stored(), condition, columns or self.schema.fieldNames(), limit, [ROW])

    def aggregate(self, column: str, functions: list[str] | str, condition: str | None = None) -> DataFrame:
        return agg.aggregate(self.df, column, functions, condition)

    def search(self, column: str, vector: list[float], k: int = 5, metric: str = "cosine", select: list[str] | None = None) -> DataFrame:
        """Through the column's vector index if there is one and the metric is cosine, else exact."""
        if metric == "cosine" and self._vector_folders(column):
            index, cells = self._vector_index(column)
            found = index.search(cells, vector, k, order=[ROW])
        else:
            found = vector_search.top_k(self._stored(), column, vector, k, metric, [ROW])
        score = vector_search.METRICS[metric]
        return found.select(*[named(found.schema, c) for c in select or self.schema.fieldNames()], score)

    def _vector_folders(self, column: str) -> list[str]:
        return [f for f in self.version.layouts.get(f"vector:{column}", "").split("|") if f]

    def _vector_index(self, column: str) -> tuple[vector_search.CellIndex, DataFrame]:
        first, *more = (f"{self.root}/{f}" for f in self._vector_folders(column))
        return vector_search.CellIndex.load(self.spark, first, more)

    def explain(self, condition: str) -> Estimate:
        """What the filter is expected to select, and Spark's plan for it; nothing is run."""
        e = parse_filter(condition)
        valid = {c: s for c, s in self.version.stats.items() if s.get("valid")}
        found = estimate(e, self.version.row_count, valid, {c: k for c, k in self.version.layouts.items() if k in LAYOUTS})
        found.physical = self.df.where(compile_predicate(self.schema, e))._jdf.queryExecution().executedPlan().toString()
        return found

    # -- writing -----------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> list[str]:
        folder = f"data/v{self.version.number + 1}-{uuid.uuid4().hex}"
        for c, kind in self.version.layouts.items():
            if kind == "sorted":  # tight bounds per row group
                df = df.sortWithinPartitions(c)
                break
        writer = df.write
        for c, kind in self.version.layouts.items():
            if kind == "hash":
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{folder}")
        return [f"{folder}/{n}" for n in self._files.names(folder) if n.endswith(".parquet")]

    def _publish(self, op: str, **changes) -> None:
        old = self.version
        fields = {k: v for k, v in old.__dict__.items() if k not in ("number", "ops")}
        if "files" in changes or "columns" in changes:
            fields["stats"] = {c: s | {"valid": False} for c, s in old.stats.items()}
            fields["layouts"] = {c: k for c, k in old.layouts.items() if not c.startswith("vector:")}
        new = Version(number=old.number + 1, ops=op if isinstance(op, list) else [op], **(fields | changes))
        if not self._files.create(_log_name(new.number), new.to_text(old)):
            names = self._files.names("_log")
            raise Conflict(old.number, int([n for n in names if n.endswith(".json")][-1].split(".")[0]))
        self.version = new
        if "files" in changes and op != "compact" and len(new.files) >= SMALL_FILES + 2 * new.compacted and self._bytes() < len(new.files) * FILE_BYTES // 4:
            self.compact()

    def _numbered(self, new: DataFrame) -> DataFrame:
        """New rows with places after all others; unique, and in order within what one task holds."""
        return new.withColumn(ROW, F.monotonically_increasing_id() + F.lit(self.version.next_row))

    def _added(self, new: DataFrame) -> tuple[list[str], int, int]:
        files = self._write(self._numbered(new))
        found = self._stored(files).agg(F.count(F.lit(1)).alias("n"), F.max(ROW).alias("last")).first() if files else {"n": 0, "last": None}
        return files, found["n"], self.version.next_row if found["last"] is None else found["last"] + 1

    def append(self, new: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Insert a DataFrame of the table's columns, missing ones from defaults; all or nothing.

        ``batch`` names a stream and the number of its batch: one that the table has already is not inserted again. Vector
        indexes get the new rows, in the same commit.
        """
        if batch and self.version.batches.get(batch[0], -1) >= batch[1]:
            return 0
        new = mutate.fill_defaults(new, self.schema, self.version.rules.defaults)
        for f in self.schema:
            if new.schema[f.name].dataType != f.dataType:
                raise QueryError(f"column '{f.name}' is {new.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        con.check_new(self.df, new, self.version.rules)
        files, n, next_row = self._added(new)
        layouts = dict(self.version.layouts)
        for name, folders in layouts.items():
            if name.startswith("vector:") and n:
                column = name.removeprefix("vector:")
                folder = f"index/{column}-{uuid.uuid4().hex}"
                index, _ = self._vector_index(column)
                index.write_cells(self._stored(files), f"{self.root}/{folder}", n)
                layouts[name] = f"{folders}|{folder}"
        batches = self.version.batches | ({batch[0]: batch[1]} if batch else {})
        self._publish("insert", files=[*self.version.files, *files], row_count=self.version.row_count + n, next_row=next_row, layouts=layouts, batches=batches)
        return n

    def insert(self, rows: list[dict]) -> int:
        """Insert JSON rows; all or nothing."""
        return self.append(mutate.rows_frame(self.spark, self.schema, rows, self.version.rules).coalesce(1))

    def delete(self, condition: str | Expression) -> int:
        txn = Transaction(self)
        txn.delete(condition)
        return txn.commit()[0]

    def update(self, condition: str | Expression, values: dict) -> int:
        txn = Transaction(self)
        txn.update(condition, values)
        return txn.commit()[0]

    def add_column(self, name: str, kind: str) -> None:
        if name in self.schema.fieldNames() or name == ROW:
            raise SchemaError(f"column '{name}' exists")
        if kind not in NAMES:
            raise SchemaError(f"unknown type '{kind}'")
        self._publish("add_column", columns=[*self.version.columns, (name, kind)])

    def create_layout(self, column: str, kind: str) -> None:
        """Ask for files laid out for lookups on a column: sorted within files, or with bloom filters; the newest hint of a column counts."""
        field_ = self.schema[column] if column in self.schema.fieldNames() else None
        if field_ is None or isinstance(field_.dataType, T.ArrayType):
            raise QueryError(f"column '{column}' cannot have an index")
        if kind not in LAYOUTS:
            raise QueryError(f"unknown index type '{kind}'")
        self._publish("create_index", layouts={**self.version.layouts, column: kind})
        if self.version.files:
            self.compact()

    def drop_layout(self, column: str) -> None:
        if column not in self.version.layouts:
            raise QueryError(f"column '{column}' has no index")
        self._publish("drop_index", layouts={c: k for c, k in self.version.layouts.items() if c != column})

    def build_vector_index(self, column: str) -> None:
        """An index of this version's vectors. Inserts add to it; other changes of rows or columns drop it."""
        index = vector_search.CellIndex.fit(self._stored(), column)
        folder = f"index/{column}-{uuid.uuid4().hex}"
        index.save(self._stored(), f"{self.root}/{folder}")
        self._publish("vector_index", layouts={**self.version.layouts, f"vector:{column}": folder})

    def analyze(self) -> dict[str, dict]:
        found = stats.collect_stats(self.df)
        self._publish("analyze", stats=found)
        return found

    def check(self) -> None:
        """Run all constraints, the row count and the layouts over the stored rows."""
        con.check(self.df, self.version.rules)
        n = self.df.count()
        if n != self.version.row_count:
            raise StorageError(f"the table holds {n} rows, its log says {self.version.row_count}")
        ordered = [c for c, kind in self.version.layouts.items() if kind == "sorted"][:1]  # files are sorted by the first
        for name in self.version.layouts:
            if name.startswith("vector:"):
                column = name.removeprefix("vector:")
                _, cells = self._vector_index(column)
                wanted = self.df.where(named(self.schema, column).isNotNull()).count()
                if cells.count() != wanted:
                    raise StorageError(f"the vector index of '{column}' does not hold the column's {wanted} vectors")
        if ordered and self.version.files and (file := _first_unsorted(self._stored(), ordered[0])):
            raise StorageError(f"{file} is not sorted by '{ordered[0]}'")

    def _bytes(self) -> int:
        """Bytes of the stored files, by Spark's own listing."""
        return int(str(self._stored()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if self.version.files else 0

    def _spread(self, df: DataFrame, least: int = 1) -> DataFrame:
        """Rows in ranges of insertion order of ``FILE_BYTES`` in memory at most, told by the cells: on disk, repeated ones take next to nothing."""
        sizes = [F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else _array_bytes(f) for f in df.schema if isinstance(f.dataType, (T.StringType, T.ArrayType))]
        wide = functools.reduce(Column.__add__, [F.coalesce(x, F.lit(0)).cast("long") for x in sizes], F.lit(ROW_BYTES + 8 * len(df.columns)).cast("long"))
        held = df.agg(F.sum(wide)).first()[0] or 0
        return df.repartitionByRange(max(least, -(-held // FILE_BYTES)), ROW)

    def compact(self, files: int | None = None) -> None:
        """Rewrite all rows into ``files`` files, or as many as their bytes in memory need, in insertion order within each."""
        stored = self._stored()
        written = []
        if self.version.files:
            spread = stored.repartitionByRange(files, ROW) if files else self._spread(stored)
            written = self._write(spread.sortWithinPartitions(ROW))
        kept = {"stats": self.version.stats, "layouts": self.version.layouts}
        self._publish("compact", files=written, compacted=len(written), **kept)

    def transaction(self, check: bool = True) -> Transaction:
        return Transaction(self, check)

    def to_document(self):
        from .sources.document import from_frame

        v = self.version
        layouts = {c: k for c, k in v.layouts.items() if k in LAYOUTS}
        return from_frame(self._stored().orderBy(ROW), v.columns, v.rules, indexes=layouts, extensions=v.extensions, lsn=v.number, stats={})


class Transaction:
    """Operations that become one commit. Filters select rows of the version that was read, never rows the transaction adds."""

    def __init__(self, table: Table, check: bool = True):
        self.table, self.check_version, self.ops = table, check, []
        self.read = table.version.number if isinstance(table, Table) else None

    def insert(self, rows: dict | list[dict]) -> None:
        self.ops.append(("insert", rows if isinstance(rows, list) else [rows]))

    def delete(self, condition: str | Expression) -> None:
        self.ops.append(("delete", parse_filter(condition) if isinstance(condition, str) else condition))

    def update(self, condition: str | Expression, values: dict) -> None:
        self.ops.append(("update", parse_filter(condition) if isinstance(condition, str) else condition, values))

    def rollback(self) -> None:
        self.ops = []

    def commit(self) -> list[int]:
        """Apply everything or nothing; the rows touched by each operation."""
        table = self.table
        if self.check_version:
            current = Table.open(table.spark, table.root).version.number
            if current != self.read:
                raise Conflict(self.read, current)
        else:
            table.version = Table.open(table.spark, table.root).version
        if not self.ops:
            return []
        version, schema, rules = table.version, table.schema, table.version.rules
        filters = [(i, op) for i, op in enumerate(self.ops) if op[0] != "insert"]
        flags: dict[int, Column] = {i: F.coalesce(compile_predicate(schema, op[1]), F.lit(False)) for i, op in filters}
        touched, hit_files, lost = [0] * len(self.ops), set(), 0
        if filters and version.files:
            some = functools.reduce(Column.__or__, flags.values())  # reaches the scan, which skips files by their bounds
            goes = functools.reduce(Column.__or__, [flags[i] for i, op in filters if op[0] == "delete"], F.lit(False))
            flagged = table._stored().where(some).select(F.input_file_name().alias("file"), goes.cast("int").alias("gone"), *[f.cast("int").alias(f"f{i}") for i, f in flags.items()])
            found = flagged.groupBy("file").agg(F.sum("gone").alias("gone"), *[F.sum(f"f{i}").alias(f"f{i}") for i in flags]).collect()  # one row a file that is hit
            for r in found:
                hit_files.add("/".join(unquote(r["file"]).split("/")[-FILE_PARTS:]))
                lost += r["gone"]
                for i in flags:
                    touched[i] += r[f"f{i}"]
        hit = [f for f in version.files if f in hit_files]
        if len(hit) < len(hit_files):
            raise StorageError("a file that Spark read is not in the table's log")
        old = table._stored(hit)
        for i, f in flags.items():
            old = old.withColumn(f"__f{i}", f)
        removed, checked = F.lit(False), set()
        for i, op in filters:
            if op[0] == "delete":
                removed = removed | F.col(f"__f{i}")
            else:
                typed = mutate.assignments(schema, op[2], rules)
                if rules.primary_key in typed and touched[i] > 1:
                    raise PrimaryKeyViolation(rules.primary_key, typed[rules.primary_key])
                checked |= set(typed)
                gone = removed
                for c, v in typed.items():
                    old = old.withColumn(c, F.when(F.col(f"__f{i}") & ~gone, F.lit(v).cast(schema[c].dataType)).otherwise(named(schema, c)))
        rest = old.where(~removed).select(*schema.fieldNames(), ROW)
        added = [r for op in self.ops if op[0] == "insert" for r in op[1]]
        for i, op in enumerate(self.ops):
            if op[0] == "insert":
                touched[i] = len(op[1])
        untouched = table._stored([f for f in version.files if f not in hit_files])
        if added:
            new = mutate.rows_frame(table.spark, schema, added, rules).coalesce(1)
            con.check_new(untouched.unionByName(rest).drop(ROW), new, rules)
        keys = Constraints(rules.primary_key if rules.primary_key in checked else None, [c for c in rules.unique if c in checked])
        if keys.primary_key or keys.unique:
            con.check(untouched.unionByName(rest).drop(ROW), keys)
        files = [f for f in version.files if f not in hit_files]
        if hit:
            ordered = "sorted" in version.layouts.values()  # a task sorts what it writes, so it gets no more than fits
            files += table._write(table._spread(rest, len(hit)) if ordered else rest)
        next_row, total = version.next_row, version.row_count - lost
        if added:
            more, n, next_row = table._added(new)
            files, total = files + more, total + n
        table._publish([op[0] for op in self.ops], files=files, row_count=total, next_row=next_row)
        return touched


def _array_bytes(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType.elementType, T.StringType):
        return F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    return F.size(c) * 8


def _first_unsorted(stored: DataFrame, column: str) -> str | None:
    """A file in which a value is followed by a smaller one; nulls come first. Each task looks at its own rows, in their order."""
    c = named(stored.schema, column)

    def look(batches):
        import pyarrow as pa

        last: dict[str, object] = {}
        for batch in batches:
            for file, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                before = last.get(file)
                if before is not None and (v is None or v < before):
                    yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])
                    return
                last[file] = v

    found = stored.select(F.input_file_name(), c).mapInArrow(look, "file string").first()
    return found[0] if found else None


def apply_json(table: Table, ops: list[dict]) -> list[int]:
    """A transaction from JSON operations: insert with row, delete with where, update with where and set. ``table`` may be a document in place."""
    txn = table.transaction() if isinstance(table, Table) else Transaction(table)
    for i, op in enumerate(ops):
        kind = op.get("op") if isinstance(op, dict) else None
        if kind == "insert" and isinstance(op.get("row"), dict):
            txn.insert(op["row"])
        elif kind == "delete" and isinstance(op.get("where"), str):
            txn.delete(op["where"])
        elif kind == "update" and isinstance(op.get("where"), str) and isinstance(op.get("set"), dict):
            txn.update(op["where"], op["set"])
        else:
            raise QueryError(f"operation {i} is not an insert, delete or update with its fields")
    return txn.commit() if isinstance(table, Table) else table.change(txn.ops, together=True)


def elapsed(since: float) -> str:
    return f"{(time.time() - since) * 1000:.0f} ms"
