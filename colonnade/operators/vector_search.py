"""Nearest vectors: exact top-k, and an inverted-file index with exact distances in the probed cells."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.vector import cosine_similarity, euclidean_distance
from ..plans.predicate import named
from ..types import kind_of

METRICS = {"cosine": "similarity", "euclidean": "distance"}
#: Vectors on which the index's cells are fitted, or so many a cell if that is more; and the most cells.
FIT_ROWS, FIT_ROWS_A_CELL, MAX_CELLS = 20_000, 25, 4096
#: Rows of a cell that one file holds.
FILE_ROWS = 1_000_000
#: Recall that probing aims at, and the sample's queries that it is measured with.
RECALL, CALIBRATION_QUERIES = 0.95, 200


def parse_vector(text: str) -> list[float]:
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if not isinstance(found, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in found):
        raise QueryError("a vector is a JSON array of numbers")
    return [float(x) for x in found]


def score(df: DataFrame, column: str, vector: Sequence[float], metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """``df`` with a score column for each vector of the query's length; other rows are left out."""
    if metric not in METRICS:
        raise QueryError(f"unknown metric '{metric}'")
    if not len(vector):
        raise QueryError("the query vector is empty")
    c = named(df.schema, column)
    if kind_of(df.schema[column].dataType) not in ("array<float>", "array<int>"):
        raise QueryError(f"column '{column}' holds no vectors")
    s = cosine_similarity(c, vector) if metric == "cosine" else euclidean_distance(c, vector)
    return df.where(F.size(c) == len(vector)).withColumn(METRICS[metric], s if digits is None else F.round(s, digits))


def top_k(df: DataFrame, column: str, vector: Sequence[float], k: int = 5, metric: str = "cosine", order: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The ``k`` best rows, best first, ties by ``order``: each task keeps k rows, nothing is sorted as a whole."""
    out = score(df, column, vector, metric, digits)
    best = F.col(METRICS[metric])
    return out.orderBy(best.desc() if metric == "cosine" else best.asc(), *[named(df.schema, c) for c in order or []]).limit(k)


def search(df: DataFrame, column: str, vector: Sequence[float], k: int = 5, metric: str = "cosine", select: list[str] | None = None, order: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``top_k`` with chosen columns and the score."""
    out = top_k(df, column, vector, k, metric, order, digits)
    return out.select(*[named(out.schema, c) for c in select], METRICS[metric]) if select else out


def top_k_f32(df: DataFrame, column: str, vector: Sequence[float], k: int = 5, order: list[str] | None = None) -> DataFrame:
    """``top_k`` by cosine for a query of 32-bit floats; computed in doubles, the similarity is rounded to 32 bits."""
    out = top_k(df, column, [float(x) for x in np.asarray(vector, np.float32)], k, "cosine", order)
    return out.withColumn("similarity", F.col("similarity").cast("float"))


class CellIndex:
    """Every vector in the cell of its nearest centre, by cosine. Centres are fitted on a bounded sample.

    The number of cells that a search probes is the least that finds ``RECALL`` of the sample's own
    ten nearest neighbours, so it follows how clustered the vectors are. Tables of cells are Parquet partitioned by cell, so a search reads the probed cells only.
    """

    def __init__(self, centres: np.ndarray, column: str, default_probes: int | None = None, rows: int | None = None):
        self.centres, self.column, self.rows = centres, column, rows
        self.default_probes = default_probes or len(centres)

    @classmethod
    def fit(cls, df: DataFrame, column: str, cells: int | None = None, rounds: int = 8, seed: int = 7) -> CellIndex:
        c = named(df.schema, column)
        some = df.where(c.isNotNull()).select(c.alias("v"))
        n = some.count()
        if not n:
            raise QueryError("there are no vectors to index")
        cells = cells or max(1, min(MAX_CELLS, int(math.sqrt(n))))
        most = max(FIT_ROWS, FIT_ROWS_A_CELL * cells)
        rows = some.sample(min(1.0, 1.5 * most / n), seed=seed).limit(most).toArrow().column("v").to_pylist() or [some.first()["v"]]
        width = max(map(len, rows))
        x = np.array([[e or 0.0 for e in r] for r in rows if len(r) == width], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cells = min(cells, len(x))
        rng = np.random.default_rng(seed)
        centres = x[rng.permutation(len(x))[:cells]]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        return cls(centres, column, cls._calibrate(x, centres, rng), n)

    @staticmethod
    def _calibrate(x: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> int:
        q = x[rng.permutation(len(x))[:CALIBRATION_QUERIES]]
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
        rank = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell, for each query
        needed = np.sort(np.take_along_axis(rank, (x @ centres.T).argmax(1)[near], 1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with its cell; null vectors are left out, other lengths go to cell -1."""
        centres = self.centres

        @F.arrow_udf("int")
        def cell(vectors: pa.Array) -> pa.Array:
            fit = pc.equal(pc.list_value_length(vectors), centres.shape[1]).to_numpy(zero_copy_only=False).astype(bool)
            out = np.full(len(vectors), -1, np.int32)
            own = np.flatnonzero(fit)
            flat = vectors.filter(pa.array(fit)).flatten().cast(pa.float64()).fill_null(0.0)
            x = np.nan_to_num(flat.to_numpy(zero_copy_only=False)).reshape(len(own), centres.shape[1])
            for lo in range(0, len(own), 1024):  # vectors x centres
                out[own[lo : lo + 1024]] = (x[lo : lo + 1024] @ centres.T).argmax(1)
            return pa.array(out)

        c = named(df.schema, self.column)
        return df.where(c.isNotNull()).withColumn("cell", cell(c))

    def write_cells(self, df: DataFrame, path: str, rows: int) -> None:
        """The assigned table of about ``rows`` rows as Parquet by cell; a cell of many rows is split over tasks and files."""
        ways = max(1, -(-rows // (len(self.centres) * FILE_ROWS)))
        split = F.pmod(F.xxhash64(named(df.schema, self.column)), F.lit(ways))
        self.assign(df).repartition("cell", split).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(path)

    def save(self, df: DataFrame, path: str) -> None:
        """Write the assigned table and the centres under ``path``."""
        spark = df.sparkSession
        self.write_cells(df, f"{path}/cells", df.count() if self.rows is None else self.rows)
        spark.createDataFrame([(json.dumps({"column": self.column, "probes": self.default_probes, "centres": self.centres.tolist()}),)], "value string").coalesce(1).write.text(f"{path}/centres")

    @classmethod
    def load(cls, spark, path: str, more: Sequence[str] = ()) -> tuple[CellIndex, DataFrame]:
        """The index and its cells; ``more`` are further folders of cells, of rows that came later."""
        found = json.loads(spark.read.text(f"{path}/centres").first()["value"])
        cells = spark.read.parquet(f"{path}/cells")
        for folder in more:
            cells = cells.unionByName(spark.read.parquet(folder))
        return cls(np.array(found["centres"]), found["column"], found["probes"]), cells

    def probes(self, vector: Sequence[float], n: int | None = None) -> list[int]:
        """The cells nearest to a query."""
        n = n or self.default_probes
        q = np.zeros(self.centres.shape[1])
        q[: len(vector)] = list(vector)[: len(q)]
        return np.argsort(-(self.centres @ q), kind="stable")[:n].tolist()

    def search(self, assigned: DataFrame, vector: Sequence[float], k: int = 5, probes: int | None = None, order: list[str] | None = None, digits: int | None = None) -> DataFrame:
        """Approximate top-k by cosine: exact scores within the probed cells, of which more are probed while they hold under k rows."""
        if len(vector) != self.centres.shape[1]:
            return top_k(assigned.where("cell = -1").drop("cell"), self.column, vector, k, "cosine", order, digits)
        cells = self.probes(vector, len(self.centres))
        n = probes or self.default_probes
        near = assigned.where(F.col("cell").isin(cells[:n])).drop("cell")
        while n < len(cells) and near.limit(k).count() < k:
            n *= 2
            near = assigned.where(F.col("cell").isin(cells[:n])).drop("cell")
        return top_k(near, self.column, vector, k, "cosine", order, digits)
