"""From raw documents to packed token sequences, in four stages.

Each stage works on all rows that its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it. SQL can express neither the classifier nor the tokenizer, so
there is no ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import documents, materialize
from colonnade.llm.op2_quality import keep_good, train
from colonnade.llm.op3_suffix_dedup import deduplicate
from colonnade.llm.op5_token_files import vocabulary
from colonnade.llm.op6_jaccard_join import one_of_each
from colonnade.llm.op7_packing import cut_pieces, pack

#: Least bytes of a repeated passage: over 50 words of prose have more, 40 words have fewer; and the bytes of an anchor in it.
PASSAGE_BYTES, PASSAGE_GRAM = 250, 128


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; n_chars, where there is one, follows the text."""
    cut = deduplicate(docs, PASSAGE_BYTES, PASSAGE_GRAM)
    length = lambda f: F.length("text").cast(f.dataType).alias(f.name) if f.name.lower() == "n_chars" else F.col(f"`{f.name}`")
    return cut.select(*[length(f) for f in docs.schema])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return pack(cut_pieces(docs, vocabulary()))


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    now = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        now = materialize(stage(spark, now, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, now, sf_dir)
