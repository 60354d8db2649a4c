"""Extra columns with the names that operators use inside, and doc_ids that hold many rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import op3_suffix_dedup as suffix
from colonnade.llm import op5_token_files as files
from colonnade.llm import op6_jaccard_join as jaccard
from colonnade.llm import op8_sharding as sharding
from colonnade.llm import op10_winnowing as win
from colonnade.llm.common import range_bounds, range_bucket

INSIDE = ["_id", "_key", "_text", "_row_key", "_p", "_place", "key", "kept", "row", "unset", "k1", "d1", "sid", "component", "tid", "place", "part", "before", "p", "tie", "bucket", "marks", "copies"]


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(n))


@pytest.mark.parametrize("upper", [False, True])
def test_clashing_columns(make_docs, upper, spark):
    rnd = random.Random(1)
    shared = words(rnd, 90)
    texts = [f"{words(rnd, 30)} {shared} {words(rnd, 30)}" for _ in range(3)] + [words(rnd, 60), words(rnd, 60)]
    docs = make_docs([*texts, texts[4], None])
    docs = docs.withColumns({c.upper() if upper else c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INSIDE})
    kept = {r.doc_id: r for r in jaccard.one_of_each(docs).collect()}
    assert sorted(kept) == [0, 1, 2, 3, 4, 6]
    cut = {r.doc_id: r for r in suffix.deduplicate(docs).collect()}
    assert all(shared not in cut[i].text for i in range(3)) and cut[3].text == texts[3] and cut[4].text == "" == cut[5].text and cut[6].text is None
    through = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert through[0].n_chars == len(through[0].text)
    placed = {r.doc_id: r for r in sharding.shard_rows(docs, ["doc_id"], 3).collect()}
    assert sorted((r.slot, r.shard) for r in placed.values()) == sorted((i // 3, i % 3) for i in range(7))
    for found in (kept, cut, placed, through):
        for i, r in found.items():
            held = r.asDict()
            assert all(held[c.upper() if upper else c] == f"{c}{i}" for c in INSIDE)


def test_repeated_rows_leave_one_fixed_row(make_docs, spark):
    docs = make_docs(["one two three four five six"] * 6, [5, 5, 5, 7, None, 7]).withColumn("at", F.monotonically_increasing_id())
    found = {tuple(jaccard.one_of_each(d).select("doc_id", "at").first()) for d in (docs, docs.orderBy(F.desc("at")), docs.repartition(3))}
    assert len(found) == 1 and found.pop()[0] == 5


def test_doc_ids_that_fill_ranges(make_docs, spark):
    rnd = random.Random(2)
    ids = [None] * 120 + [7] * 80 + list(range(40))
    docs = make_docs([words(rnd, 6) for _ in ids], ids)
    rows = docs.withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(rows, "doc_id", 8)
    dealt = rows.select("doc_id", "tie", range_bucket("doc_id", "tie", bounds).alias("b")).collect()
    order = sorted(dealt, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.b for r in order] == sorted(r.b for r in dealt), "ranges follow the order"
    assert len({r.b for r in dealt if r.doc_id is None}) >= 3 and len({r.b for r in dealt if r.doc_id == 7}) >= 2
    sizes = [sum(r.b == b for r in dealt) for b in range(8)]
    assert max(sizes) <= 3 * len(ids) / 8
    assert range_bounds(docs.limit(0), "doc_id", 8) == []
    found = sorted(files.read_files(files.write_files(docs, files.vocabulary())).collect(), key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in found] == [r.doc_id for r in order]
    texts = {r.tie: r.text for r in rows.collect()}
    ring = [texts[r.tie] for r in order]
    wanted = sorted((r.doc_id or -1, len(t), win.likeness(*(win.winnow([win.code_points(x)])[0][0] for x in (t, ring[(i + 1) % len(ring)])))) for i, (r, t) in enumerate(zip(order, ring, strict=True)))
    got = sorted((r.doc_id or -1, r.n_chars, r.near_next) for r in win.fingerprint_documents(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in wanted] and sum(g[2] for g in got) == pytest.approx(sum(w[2] for w in wanted))
