"""What the operators share: the shared folder, Arrow tasks, range buckets, text blocks, hashing in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20
#: Rows of a batch between Spark and Python, where the session has Spark's own default of 10,000.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own_dir: list[str] = []  # used only where the session names no shared folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``, else under the context's checkpoint folder.

    All folders of an application lie in one named after it, which can be deleted when its results have been read. Where neither is set, a local run gets a folder of its own, and a cluster an error: its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="colonnade-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/colonnade/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and lost executors cost no rework."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not at the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as tell it from all columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def give_back() -> None:
    """Return a Python worker's free memory to the system; workers outlive their tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a batch of Spark's default 10,000 rows holds tens of MB on both sides. A bound that the session chose itself stays."""
    if int(spark.conf.get(_BATCH, "10000")) == 10_000:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in small batches; a worker gives its memory back when a task ends."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending cut values of a long column, nulls least, from one aggregate; the driver holds n values.

    A value that fills several ranges by itself is listed as often.
    """
    if n < 2:
        return []
    fractions = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(_long(column), fractions, max(10_000, 20 * n))).first()[0]
    return sorted(found or [])


def _long(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def _below(x: Column, bounds: list[int], equal: bool) -> Column:
    """How many of the ascending bounds are less than x, or equal; a binary search by built-in functions."""
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        bound = F.get(listed, at + by - 1)
        return F.when((at + by <= len(bounds)) & ((bound <= x) if equal else (bound < x)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def range_bucket(column: str, tie: str, bounds: list[int]) -> Column:
    """Number of the range that holds a row; rows of a value that fills several ranges are split by ``tie``, an evenly spread long."""
    if not bounds:
        return F.lit(0)
    x = _long(column)
    first, last = _below(x, bounds, False), _below(x, bounds, True)
    share = F.least(F.col(tie).cast("double") / 2.0**64 + 0.5, F.lit(1 - 2.0**-40))
    return (first + F.when(last > first, 1 + F.floor(share * (last - first))).otherwise(0)).cast("int")


def starts_of(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """(group, before): for one row a group, the sum of the sizes of all smaller groups; groups are ranges or partitions, so the driver may hold them."""
    rows, total = [], 0
    for r in sizes.orderBy(group).collect():  # one row a range
        rows.append((r[group], total))
        total += r[size]
    return sizes.sparkSession.createDataFrame(rows, f"{group} int, before long")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets); a null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if pa.types.is_string(array.type):
        array = array.cast(pa.large_string())
    elif pa.types.is_binary(array.type):
        array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null("" if pa.types.is_large_string(array.type) else b"")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(array) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(array) else np.zeros(1, np.int64))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold at most ``most`` bytes together, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 modulo 2**64, and those of its inverse; kept until the task ends."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[0] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of codes[j] * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of codes[start:end] for each pair; equal content gives equal hashes wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def byte_codes(data: np.ndarray, seed: int = 7) -> np.ndarray:
    """A random odd 64-bit code per byte value."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)[data] | np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat Spark DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    out = []
    for part in ddl.split(","):
        name, kind = part.split()
        out.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(out)
