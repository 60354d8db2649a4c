import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import op2_quality as quality
from colonnade.llm import op4_license_scan as scan
from colonnade.llm import op8_sharding as shards
from colonnade.llm.numbering import number_rows


def stats_of(*texts):
    raw = [t.encode() for t in texts]
    return quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def test_statistics():
    a, b, empty, c = stats_of("The cat! sat\nTHE | cat cat\n\nx 1%", "The cat! sat\n", "", "%%")
    named = dict(zip(quality.STATISTICS, a.tolist(), strict=True))
    assert named["log_words"] == pytest.approx(np.log1p(9)) and named["longest_word"] == 4
    assert named["same_as_previous"] == pytest.approx(1 / 9) and named["distinct_words"] == pytest.approx(8 / 9)
    assert named["bar_words"] == pytest.approx(1 / 9) and named["upper_words"] == pytest.approx(1 / 9) and named["longest_run"] == 1
    assert not empty.any() and c[quality.STATISTICS.index("symbols")] == 1
    assert np.array_equal(stats_of("The cat! sat\n")[0], b), "neighbours do not matter"


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    model = quality.fit(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == (y[600:] > 0)).mean() > 0.9

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:20]), [walk(row) for row in x[:20]])
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_quality_odd_cases(make_docs, odd_texts, spark):
    docs = make_docs(odd_texts)
    labels = spark.createDataFrame([(5, 1), (None, 0), (6, None), (13, 0), (13, 0)], "doc_id long, quality int")
    scored = quality.score_documents(docs.withColumn("score", F.lit("old")), quality.train(docs, labels))
    assert scored.count() == len(odd_texts) and all(0 <= r.score <= 1 for r in scored.collect())
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == len(odd_texts)
    assert quality.score_documents(docs.limit(0), none).count() == 0


def test_training_on_repeated_doc_ids(make_docs, monkeypatch, spark):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    texts, ids = [f"text {'word ' * i}" for i in range(60)], [[i for i in range(50) if zlib.crc32(str(i).encode()) % 5][k % 3] for k in range(60)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(sorted(set(ids)))], "doc_id long, quality int")
    docs = make_docs(texts, ids)
    for order in (F.col("n_chars"), -F.col("n_chars")):
        quality.train(docs.repartition(3).orderBy(order), labels, 3)
    least = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("f")).orderBy("doc_id").collect()
    wanted = stats_of(*(r.f.text for r in least))
    for x, y in seen:
        assert sorted(map(tuple, x.tolist())) == sorted(map(tuple, wanted.tolist())) and y.tolist() == [0, 0, 1]


def test_license_scan(make_docs, odd_texts, spark):
    filler = " ".join(f"filler{i}" for i in range(80))
    texts = [*odd_texts, *[f"{filler}\n{t}\n{filler}" for t in scan.TEMPLATES.values()], *scan.TEMPLATES.values()]
    texts.append(scan.TEMPLATES["mit-grant"].replace("copies of the Software, and", "copies, and").upper())
    texts.append("Released under the Apache License, Version 2.0")
    found = {(r.doc_id, r.license, r.first_byte, r.end_byte, r.containment) for r in scan.scan(make_docs(texts)).collect()}
    templates, wanted = scan.Templates(scan.TEMPLATES), set()
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, _, first, end = scan.shingles(data, np.array([0, len(data)]))
        for k, s in enumerate(templates.sets):
            wanted |= {(i, templates.names[k], int(first[a]), int(end[b]), n / len(s)) for a, b, n in scan.verify(h, s)}
    assert found == wanted
    names = {i: {x[1] for x in found if x[0] == i} for i in range(len(texts))}
    for k, name in enumerate(scan.TEMPLATES):
        assert name in names[len(odd_texts) + k] and name in names[len(odd_texts) + len(scan.TEMPLATES) + k]
    assert "mit-grant" in names[len(texts) - 2] and not any(names[i] for i in range(len(odd_texts)))
    assert scan.scan(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        scan.Templates({"short": "too few"})


def test_truncated_template_alone_in_its_block():
    templates = scan.Templates(scan.TEMPLATES)
    k = templates.names.index("mpl-2.0-header")
    words = scan.TEMPLATES["mpl-2.0-header"].split()
    filler = " ".join(f"filler{i}" for i in range(9))
    for n in range(len(words) - 8, len(words) + 1):
        for text in (" ".join(words[:n]), " ".join(words[-n:]), f"{filler} {' '.join(words[:n])}"):
            data = np.frombuffer(text.encode(), np.uint8)
            h, *_ = scan.shingles(data, np.array([0, len(data)]))
            wanted = [held / len(templates.sets[k]) for _, _, held in scan.verify(h, templates.sets[k])]
            assert [f[4] for f in scan.scan_block(data, np.array([0, len(data)]), templates) if f[1] == k] == wanted, text


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel(n):
    cipher = shards.Feistel(n)
    p = cipher.forward(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and cipher.inverse(p).tolist() == list(range(n))
    shard, slot = shards.place_of(np.arange(n), n)
    assert shards.row_at(shard, slot, n).tolist() == list(range(n))


def test_sharding(make_docs, odd_texts, write_docs, spark):
    texts = odd_texts * 5
    ids = [None, None, *range(len(texts) - 2)]
    rows = shards.op8_sharding(spark, write_docs(make_docs(texts, ids))).collect()
    assert len(rows) == len(texts)
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(counts.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in counts.values())
    got = sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None)
    raw = [(t or "").encode() for t in texts]
    assert got == sorted((i, len(b) + 1, zlib.crc32(b)) for i, b in zip(ids, raw, strict=True) if i is not None)
    assert shards.op8_sharding(spark, write_docs(make_docs([]))).count() == 0


def test_numbering(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 499).alias("a"), F.col("id").alias("row_no_2"))
    numbered, n = number_rows(df, ["a", "row_no_2"])
    rows = sorted(numbered.collect(), key=lambda r: r.row_no)
    assert n == 500 and [r.row_no for r in rows] == list(range(500)) and [r.a for r in rows] == sorted(r.a for r in rows)
