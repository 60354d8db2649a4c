"""Token-id files: whole texts as ids of a public tokenizer, coded word-aligned by Simple-8b.

Documents are dealt to doc_id ranges, one a task; a doc_id that fills several ranges is split by its texts' hashes.
Each range is tokenised in ascending doc_id order (nulls
first, ties by text hash) and cut into files of whole documents. The table of files (range, file,
content) lies in the shared folder as Parquet, because executors share no other store; each
``content`` is one complete file in the layout of ``simple8b``. Reading decodes file by file.
Document starts come from the file heads and from one total per range, the only thing the driver
holds and broadcasts.

Defined cases: a null or empty text has only the end id; repeated rows are written one by one;
an empty table gives no files and an empty result; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import arrow_schema, blocks, documents, map_arrow, materialize, partitions, range_bounds, range_bucket, starts_of
from .tokens import TOKEN_BLOCK, encoder, ids_of

END_ID = 1
#: A file is closed at the first document that brings it to this many ids.
FILE_IDS = 1 << 19
FILES = "range_no int, file_no int, n_ids long, content binary"
READ = "doc_id long, range_no int, start long, n_tokens long, ids_crc32 long"


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def write_files(docs: DataFrame, path: str) -> DataFrame:
    """The written table of files; ``path`` is the vocabulary's."""
    n = partitions(docs.sparkSession)
    bounds = range_bounds(docs, "doc_id", n)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FILES)
        enc, current, file_no, start, size = encoder(path), None, 0, 0, 0
        held_docs: list = []
        held_ids: list = []

        def close() -> pa.RecordBatch:
            n_ids = sum(map(len, held_ids))
            row = [[current], [file_no], [n_ids], [simple8b.encode_file(held_docs, held_ids, start)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in blocks([batch], most=TOKEN_BLOCK):
                ranges, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                for r, doc, tokens in zip(ranges, ids, ids_of(enc, part.column(2)), strict=True):
                    if held_docs and r != current:
                        yield close()
                        held_docs, held_ids = [], []
                    if r != current:
                        current, file_no, start, size = r, 0, 0, 0
                    held_docs.append(doc)
                    held_ids.append(np.append(tokens, np.uint32(END_ID)))
                    size += len(tokens) + 1
                    if size >= FILE_IDS:
                        yield close()
                        file_no, start, size = file_no + 1, start + size, 0
                        held_docs, held_ids = [], []
        if held_docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    rows = rows.select(range_bucket("doc_id", "tie", bounds).alias("range_no"), "doc_id", "text", "tie")
    dealt = rows.repartitionById(n, "range_no").sortWithinPartitions("range_no", "doc_id", "tie").drop("tie")
    return materialize(map_arrow(dealt, files, FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Per document, from the files' bytes: doc_id, start (over all ranges), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(READ)
        for batch in batches:
            for range_no, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a file at a time
                docs, ids, first = simple8b.decode_file(content.as_buffer().to_pybytes())
                sizes = docs["n"].astype(np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(docs["id"], mask=docs["null"].astype(bool)), pa.array(np.full(len(docs), range_no, np.int32)), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    before = starts_of(files.groupBy("range_no").agg(F.sum("n_ids").alias("n")), "range_no", "n")
    found = map_arrow(files.select("range_no", "content"), read, READ)
    placed = found.join(F.broadcast(before), "range_no")  # one row a range
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(documents(spark, sf_dir), vocabulary()))
