import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest

from colonnade.llm import op3_suffix_dedup as suffix
from colonnade.llm import op6_jaccard_join as jaccard
from colonnade.llm import op10_winnowing as win
from colonnade.llm.components import components
from colonnade.llm.oracle import JACCARD_JOIN
from colonnade.llm.suffix_array import SuffixArray


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((covered & ~np.append(False, covered[:-1])).sum()) if len(r) else 0
        out.append((len(r), int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~covered])).hexdigest()))
    return out


def passage_texts(odd_texts):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(110), text(90)
    out = [f"{text(30)} {shared} {text(20)}" for _ in range(12)] + [f"{shared[3:]} {text(5)} {other}", other + shared[:-7], text(400)]
    base = text(300)
    out += [base, base[:900] + "X" + base[901:], "pre " + base, base + base, "ab" * 700, "ab" * 300 + text(60), "é" * 350 + text(60) + "é" * 350]
    return out + odd_texts


@pytest.mark.parametrize("hot", [512, 3])
def test_repeated_passages(make_docs, odd_texts, monkeypatch, hot, spark):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 4000)
    texts = passage_texts(odd_texts)
    docs = make_docs(texts)
    kept = {bytes(r.key): r for r in suffix.kept_bytes(docs).collect()}
    for t, (n, removed, spans, sha) in zip(texts, brute_repeats(texts, suffix.LENGTH), strict=True):
        r = kept[hashlib.md5((t or "").encode()).digest()]
        assert (len(r.kept) + r.n_removed, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == (n, removed, spans, sha), t
    out = {r.doc_id: r for r in suffix.deduplicate(docs).collect()}
    assert suffix.deduplicate(docs).columns == docs.columns and len(out) == len(texts)
    assert out[14].text == texts[14] and "é" * 3 not in out[21].text.replace(texts[21][350:-350], "")
    assert suffix.kept_bytes(docs.limit(0)).count() == 0


def test_suffix_array_and_maximal_repeats():
    rnd = random.Random(1)
    for trial in range(30):
        strings = [bytes(rnd.choices(b"ab\x00", k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        begin = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        whole = b"".join(strings)
        starts = np.arange(len(whole))
        array = SuffixArray(strings, starts)
        tail = lambda p: whole[p : array.stop[p]]  # noqa: B023, E731
        suffixes = [tail(p) for p in array.order]
        common = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert array.lcp[1:].tolist() == common
        left_open = np.zeros(len(whole), bool)
        left_open[begin[:-1]] = True
        found = {}
        for length, places in array.maximal_repeats(2, left_open):
            assert len({tail(p)[:length] for p in places}) == 1
            found[tail(places[0])[:length]] = sorted(places.tolist())
        wanted = {}
        grams = {tail(p)[:n] for p in starts for n in range(2, len(tail(p)) + 1)}
        for g in grams:
            at = [p for p in starts.tolist() if tail(p).startswith(g)]
            if len(at) > 1:
                right = {tail(p)[len(g) : len(g) + 1] or p for p in at}
                left = {-1 - p if left_open[p] else whole[p - 1] for p in at}
                if len(right) > 1 and len(left) > 1:
                    wanted[g] = at
        # equal suffixes that end with their strings are told apart by place, so they have no common right byte
        assert all(found[g] == at for g, at in wanted.items()), trial
        assert all(len(g) in {len(w) for w in found} for g in wanted)


def test_repeats_that_differ_near_the_end_of_contexts():
    base = random.Random(5).randbytes(544)
    changed = lambda at: base[:at] + bytes([base[at] ^ 1]) + base[at + 1 :]
    for contexts in itertools.permutations([changed(540), changed(530), base]):
        array, found, begin = suffix.repeats_of(list(contexts))
        covered = np.zeros(len(array.text), bool)
        for length, places in found:
            for p in places:
                covered[p : p + length] = True
        assert [int(covered[a:b].sum()) for a, b in itertools.pairwise(begin)] == [530 if c == changed(530) else 540 for c in contexts]


def near_texts(odd_texts):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    common = [word() for _ in range(40)]
    out = []
    for size in (60, 120, 300):
        base = [word() for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 3, 4, 6, 9, 12, 18]:
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(size)] = word()
            out.append(" ".join(copy).upper() if edits == 2 else " ".join(copy))
        out.append(" ".join(base[: size * 8 // 10]))
    crowd = [word() for _ in range(150)]
    for _ in range(70):  # over FREQUENT, many pairs close to the bound
        copy = list(crowd)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(150)] = word()
        out.append(" ".join(copy))
    out += [" ".join([word() for _ in range(100)] + common) for _ in range(40)]
    return out + odd_texts


def brute_components(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return {r[0]: (r[1], r[2]) for r in con.sql(JACCARD_JOIN).fetchall()}


@pytest.mark.parametrize("frequent", [24, 2])
def test_jaccard_join(make_docs, odd_texts, monkeypatch, frequent, spark):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = make_docs(near_texts(odd_texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert found == brute_components(docs)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {c for n, c in found.values() if n} | {i for i, (n, _) in found.items() if not n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_jaccard_join_of_frequent_shingles_at_the_bound(make_docs, monkeypatch, spark):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=9)) for _ in range(n))
    passages = [words(40) for _ in range(10)]
    texts = []
    for _ in range(40):  # 8 common shingles, all frequent; the first text's own one is rare, the second's frequent
        common, own = words(12), words(1)
        texts += [f"{common} {words(1)}", f"{common} {own}"]
        a = rnd.sample(passages, 6)
        texts += [f"{common} {own} {x} {y}" for x, y in zip(a[::2], a[1::2], strict=True)]  # link with nothing
    docs = make_docs(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert found == brute_components(docs)
    assert all(found[i + 1] == (9, i) for i in range(0, len(texts), 5))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_of_templates(make_docs, monkeypatch, seed, spark):
    """Texts put together from few passages, so that all shingles but those across seams are frequent; many pairs lie near the bound."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=9)) for _ in range(n))
    passages = [words(rnd.choice((4, 9, 14, 30))) for _ in range(12)]
    texts = []
    for _ in range(160):
        chosen = rnd.sample(passages, rnd.randint(1, 6))
        texts.append(" ".join(sorted(chosen) if rnd.random() < 0.7 else chosen))
    docs = make_docs(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert found == brute_components(docs)


def test_least_number_of_shared_pairs():
    for n1 in range(4, 80):
        for n2 in range(n1, n1 * 5 // 4 + 1):
            o = -(-(n1 + n2) * 80 // 180)
            if o <= n1 and o < n2:  # different sets that may link
                assert 3 * o - 1 - n1 - n2 >= max(jaccard.shared_pairs(n1), jaccard.shared_pairs(n2)) >= 1


def test_jaccard_join_small_cases(make_docs, spark):
    assert jaccard.link_documents(make_docs([])).count() == 0
    text = "one two three four five six"
    docs = make_docs([text, text, text, None, None, "a b"], [7, 7, None, 1, None, 2])
    rows = sorted(jaccard.link_documents(docs).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 2, 7), (1, 0, 1), (2, 1, 2), (7, 2, 7), (7, 2, 7)]
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(docs).collect()) == ["1", "2", "7", "None"]


def test_components(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)]
    edges = [*chain, *[(100, 100 + rnd.randint(1, 50)) for _ in range(60)], (500, 500), (7, 3), (7, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and 500 not in found
    assert {found[v] for _, v in edges if 100 < v <= 150} == {100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_winnow(text, k, w):
    from colonnade.llm.common import mix, prefix_hash, span_hash

    codes = mix(win.code_points(text).astype(np.uint64) + np.uint64(1))
    n = len(codes)
    if not n:
        return []
    prefix = prefix_hash(codes)
    grams = [int(span_hash(prefix, np.array([i]), np.array([i + min(k, n)]))[0] >> np.uint64(32)) for i in range(max(n - k + 1, 1))]
    chosen = set()
    for i in range(max(len(grams) - w + 1, 1)):
        window = range(i, min(i + w, len(grams)))
        chosen.add(max(j for j in window if grams[j] == min(grams[x] for x in window)))
    return [(grams[j], j) for j in sorted(chosen)]


def test_winnowing(odd_texts):
    texts = [(t or "")[:700] for t in odd_texts]
    for t, (hashes, places) in zip(texts, win.winnow([win.code_points(t) for t in texts], 8, 13), strict=True):
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain_winnow(t, 8, 13), t[:20]
    rnd = random.Random(4)
    shared = "".join(rnd.choices("abc ", k=8 + 13 - 1))
    for _ in range(50):  # the guarantee: a passage of k + window - 1 shares a fingerprint
        pad = lambda: "".join(rnd.choices("abc ", k=rnd.randint(0, 40)))
        (a, _), (b, _) = win.winnow([win.code_points(pad() + shared + pad()) for _ in range(2)], 8, 13)
        assert set(a.tolist()) & set(b.tolist())


def test_short_texts_stay_like_their_edits(make_docs, spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abcdefgh ", k=n)) for n in range(27, 130)]
    found = win.fingerprint_documents(make_docs(texts)).collect()
    assert len(found) == len(texts) and all(r.near_edited > 0 for r in found)


def test_fingerprints_of_documents(make_docs, odd_texts, spark):
    ids = [5 * i for i in range(len(odd_texts))]
    found = {r.doc_id: r for r in win.fingerprint_documents(make_docs(odd_texts, ids)).collect()}
    assert sorted(found) == ids
    prints = {}
    for k, i in enumerate(ids):
        t, nxt = odd_texts[k] or "", odd_texts[(k + 1) % len(ids)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        (a, _), (b, _), (c, _) = win.winnow([win.code_points(x) for x in (t, edited, nxt)])
        assert (r.fingerprint, r.edited_fingerprint) == (win.as_string(a), win.as_string(b))
        assert (r.near_edited, r.near_next) == (win.likeness(a, b), win.likeness(a, c))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    one = win.fingerprint_documents(make_docs(["some single text"])).first()
    assert one.near_next == 1.0
    assert win.fingerprint_documents(make_docs([])).count() == 0
    nulls = win.fingerprint_documents(make_docs(["x", "y", "y"], [None, None, 3])).collect()
    assert len(nulls) == 3
