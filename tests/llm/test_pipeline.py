import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from colonnade.llm import op2_quality as quality
from colonnade.llm import registry
from colonnade.llm.op5_token_files import vocabulary
from colonnade.llm.oracle import JACCARD_JOIN

SF, LENGTH = "/root/testdata/sf0.001", corpus_pipeline.PASSAGE_BYTES


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    from colonnade.llm.common import documents, materialize

    now, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, now, SF), f"test-{name}")
        out[name] = (now, after)
        now = after
    return out


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "passages", "packing"]
    for name in ("quality", "near_copies", "passages"):
        before, after = stages[name]
        assert after.columns == before.columns and after.count() > 0


def test_quality_stage(stages, spark):
    before, after = stages["quality"]
    scored = quality.op2_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored if r.predicted == 1)


def test_near_copies_stage(stages):
    import duckdb

    before, after = stages["near_copies"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    wanted = {r[2] for r in con.sql(JACCARD_JOIN).fetchall()}
    assert {r.doc_id for r in after.collect()} == wanted


def test_passages_stage(stages):
    before, after = stages["passages"]
    texts = {r.doc_id: r.text for r in before.collect()}
    seen = {}
    for t in texts.values():
        raw = t.encode()
        for i in range(len(raw) - LENGTH + 1):
            d = hashlib.blake2b(raw[i : i + LENGTH], digest_size=12).digest()
            seen[d] = seen.get(d, 0) + 1
    for r in after.collect():
        raw = texts[r.doc_id].encode()
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if seen[hashlib.blake2b(raw[i : i + LENGTH], digest_size=12).digest()] > 1:
                covered[i : i + LENGTH] = True
        assert r.text == bytes(np.frombuffer(raw, np.uint8)[~covered]).decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_packing_stage(stages):
    before, after = stages["packing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    t = Tokenizer.from_file(vocabulary())
    for r in after.collect():
        own = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")[r.start : r.start + r.length]
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and r.offset + r.length <= 4096
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(texts)


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None
