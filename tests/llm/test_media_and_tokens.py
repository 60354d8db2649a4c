import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colonnade.llm import op1_media_chunks as media
from colonnade.llm import op5_token_files as files
from colonnade.llm import op7_packing as packing
from colonnade.llm import op9_sentencepiece as sp
from colonnade.llm import simple8b
from colonnade.llm.tokens import WordEncoder


def library_ids(texts):
    t = Tokenizer.from_file(files.vocabulary())
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_resynchronise():
    r = np.random.default_rng(0)
    a = r.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    b = a[:9000] + b"inserted" + a[9000:]
    (x, y) = media.cut_chunks([a, b])
    assert sum(x) == len(a) and sum(y) == len(b) and max(x + y) <= media.MOST and min(x[:-1] + y[:-1]) >= media.LEAST

    def digests(m, sizes):
        ends = np.cumsum(sizes)
        return {m[e - n : e] for e, n in zip(ends, sizes, strict=True)}

    assert len(digests(a, x) & digests(b, y)) >= len(x) - 4
    assert media.cut_chunks([b, a]) == [y, x], "neighbours do not matter"
    with pytest.raises(ValueError):
        media.from_media(b"P5\n64 2\n255\n" + bytes(64))


def test_media_round_trip(make_docs, odd_texts, spark):
    texts = [*odd_texts, odd_texts[9][:20_000] + "z" * 9000, "z" * 9000 + odd_texts[9][:20_000]]
    docs = make_docs([*texts, "dup"], [*range(len(texts) - 1), None, 3]).withColumn("key", F.lit("clash"))
    lists = media.chunk_lists(docs)
    store = media.chunk_store(docs, lists)
    found = lists.select("key", "doc_id", "n_bytes").join(media.read_media(store), "key").collect()
    assert len(found) == len(texts) + 1
    wanted = {}
    for i, t in zip([*range(len(texts) - 1), None, 3], [*texts, "dup"], strict=True):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        wanted[(i, len(raw), hashlib.sha256(p).hexdigest())] = (len(p), zlib.crc32(p[-64:]))
    for r in found:
        assert wanted[(r.doc_id, r.n_bytes, r.payload_sha256)] == (r.payload_bytes, r.tail_crc32)
        assert r.media_bytes > r.payload_bytes and sum(map(int, r.feature.split(","))) == r.payload_bytes
    chunks = store.select(F.explode("lent_digests").alias("d")).collect()
    assert len(chunks) == len({bytes(c.d) for c in chunks}) > 0, "a shared chunk is stored once"
    empty = docs.limit(0)
    lists = media.chunk_lists(empty)
    assert media.read_media(media.chunk_store(empty, lists)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1) | st.integers(0, 300) | st.just(0), max_size=300))
def test_simple8b_round_trip(ids):
    words = simple8b.encode_block(np.array(ids, np.uint64))
    assert simple8b.decode_block(words, len(ids)).tolist() == ids
    assert len(words) <= len(ids)


def test_simple8b_files():
    ids = [np.array([1, 2, 3], np.uint32), np.zeros(0, np.uint32), np.arange(200_000, dtype=np.uint32) % 49_000]
    docs, flat, start = simple8b.decode_file(simple8b.encode_file([5, None, -7], ids, 11))
    assert start == 11 and docs["id"].tolist() == [5, 0, -7] and docs["null"].tolist() == [0, 1, 0] and docs["n"].tolist() == [3, 0, 200_000]
    assert np.array_equal(flat, np.concatenate(ids))
    with pytest.raises(ValueError):
        simple8b.encode_block(np.array([2**60], np.uint64))
    for bad in (b"XXXX" + bytes(40), simple8b.MAGIC + bytes([9]) + bytes(40)):
        with pytest.raises(ValueError):
            simple8b.decode_file(bad)
    with pytest.raises(ValueError):
        simple8b.decode_block(np.array([0], np.uint64), 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAéÉßñ'tś!.,#<|>= \n\t9 漢İİ×÷Σς")), max_size=4))
def test_words_equal_the_library(texts):
    enc = WordEncoder(files.vocabulary(), cache_parts=8)
    assert [x.tolist() for x in enc.encode(texts)] == [x[:-1].tolist() for x in library_ids(texts)]


def test_token_files(make_docs, odd_texts, write_docs, spark):
    texts, ids = [*odd_texts, "last"], [*range(100, 100 + len(odd_texts) - 1), None, 100]
    docs = make_docs(texts, ids).withColumn("range_no", F.lit(1))
    found = sorted(files.read_files(files.write_files(docs, files.vocabulary())).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(ids, key=lambda i: (i is not None, i or 0))
    by_id = {}
    for i, own in zip(ids, library_ids(texts), strict=True):
        by_id.setdefault(i, []).append((len(own), zlib.crc32(own.tobytes())))
    at = 0
    for r in found:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        at += r.n_tokens
    assert files.read_files(files.write_files(docs.limit(0), files.vocabulary())).count() == 0


def test_packing(make_docs, odd_texts):
    texts = odd_texts + [f"word {i} " * (i % 60) for i in range(200)]
    pieces = packing.pack(packing.cut_pieces(make_docs(texts), files.vocabulary(), 512), 512, 80).collect()
    ids = library_ids(texts)
    seen, sequences = {}, {}
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 512 * r.piece and r.length == len(own) > 0 and r.ids_crc32 == zlib.crc32(own.tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in enumerate(ids)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.1 * sum(map(len, ids)) / 512 + 4
    assert packing.pack(packing.cut_pieces(make_docs([]), files.vocabulary())).count() == 0


def test_sum_of_squares_takes_the_least():
    lengths = np.random.default_rng(5).integers(1, 41, 300)
    sequence, offset = packing.sum_of_squares(lengths, 40)
    free, count = {}, np.zeros(41, int)
    for s, bin_, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def cost(gap):
            after = count.copy()
            if gap < 40:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            return (after[1:40] ** 2).sum()

        choices = {g: cost(g) for g in {*free.values(), 40} if g >= s}
        gap = free.get(bin_, 40)
        assert at == 40 - gap and choices[gap] == min(choices.values())
        if gap < 40:
            count[gap] -= 1
        free[bin_] = gap - s
        if gap > s:
            count[gap - s] += 1
        else:
            free.pop(bin_)


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(PIECES)


def plain_best(v, text):
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            s = v.pieces[text[i:j]][1] if text[i:j] in v.pieces else v.unknown if j == i + 1 else None
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    ids, j = [], len(text)
    while j:
        part = text[back[j] : j]
        ids = ([v.pieces[part][0]] if part in v.pieces else [v.byte_ids[b] for b in part.encode()]) + ids
        j = back[j]
    return ids


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("the inga ▁\né漢s"), max_size=60), st.integers(1, 9))
def test_streaming_search(vocabulary, text, step):
    search, ids = sp.StreamingViterbi(vocabulary), []
    for lo in range(0, len(text), step):
        ids += search.feed(text[lo : lo + step])
    assert ids + search.finish() == plain_best(vocabulary, text)


def test_window_stays_small(vocabulary):
    search, n = sp.StreamingViterbi(vocabulary), 0
    for _ in range(3000):
        n += len(search.feed("▁internationalen"))
    assert n > 3000 and search.widest < 8 * vocabulary.longest


def test_against_the_library_as_unigram(vocabulary):
    raw = open(PIECES, "rb").read()
    mark = b"\x06tok_v0\x18\x02"  # the model's name and kind; kind 1 is the unigram search
    assert raw.count(mark) == 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(mark, mark[:-1] + b"\x01"))
    enc = sp.Encoder(vocabulary, most=50)
    for text in ("the cat sat on the mat", "internationalisation of strings", "un texte en français avec des accents"):
        score = lambda ids: sum(unigram.get_score(i) for i in ids)
        assert score(enc.encode(text).tolist()) == max(map(score, unigram.nbest_encode(text, nbest_size=8, out_type=int)))


def test_texts_of_more_segments_than_the_cache(vocabulary):
    texts = [" ".join(f"w{i} the" for i in range(n)) for n in (1, 2, 40, 1, 3)]
    enc = sp.Encoder(vocabulary, most=4)
    for t in texts:
        assert enc.encode(t).tolist() == plain_best(vocabulary, sp.BLANK + t.replace(" ", sp.BLANK))
        assert len(enc.known) <= 4


def test_sentencepiece_documents(make_docs, odd_texts, spark):
    found = sp.check_documents(make_docs(odd_texts), PIECES).collect()
    assert len(found) == len(odd_texts) and all(r.round_trip for r in found)
    for r in found:
        assert r.decoded_sha256 == hashlib.sha256((odd_texts[r.doc_id] or "").encode()).hexdigest()
    ids = {r.doc_id: r.ids for r in sp.encode_documents(make_docs(odd_texts), PIECES).collect()}
    v = sp.Vocabulary.load(PIECES)
    for i in (5, 7, 14):
        assert ids[i] == plain_best(v, sp.BLANK + odd_texts[i].replace(" ", sp.BLANK))
    assert ids[0] == ids[1] == []
    assert sp.check_documents(make_docs([]), PIECES).count() == 0
