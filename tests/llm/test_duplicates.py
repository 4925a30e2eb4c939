import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenscribe.llm import near_dup, substring
from lumenscribe.llm.kernels import WORD_RE, Texts


def shingles(text):
    w = re.findall(WORD_RE, text.lower())
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


@pytest.fixture(scope="module")
def copies(spark):
    draw = random.Random(11)
    rows, key = [], 0
    for group in range(60):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([12, 60, 300]))]
        for _ in range(draw.choice([1, 2, 5])):
            w = list(base)
            for _ in range(int(len(w) * draw.choice([0, 0.01, 0.05]))):
                w[draw.randrange(len(w))] = f"v{draw.randrange(10**6)}"
            rows.append((key, " ".join(w)))
            key += 1
    draw.shuffle(rows)
    return rows


def components(n, edges):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in range(n) if find(k) != k}


def test_near_duplicates_against_all_pairs(spark, copies):
    sets = {k: shingles(t) for k, t in copies}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]]
    must = components(len(sets), [p for p in pairs if sim(*p) >= 0.7])
    may = components(len(sets), [p for p in pairs if sim(*p) >= 0.3])
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    got = {r[0]: r[1] for r in near_dup.near_duplicates(docs).collect()}
    assert sum(k in got for k in must) >= 0.97 * len(must)
    assert set(got) <= set(may)
    kept = {r[0] for r in near_dup.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept == set(sets) - set(got)


def bucket_components(rows, threshold=0.5):
    """Components of all pairs that share a band and the threshold of bins."""
    texts = Texts(pa.array([t.lower() for _, t in rows]))
    _, sig = near_dup.signatures(texts, 0, len(texts))
    sig, bands = sig.astype("<u2"), near_dup.band_keys(sig)
    edges = []
    for a in range(len(rows)):
        hit = (bands[a + 1 :] == bands[a]).any(axis=1) & ((sig[a + 1 :] == sig[a]).mean(axis=1) >= threshold)
        edges += [(a, a + 1 + int(b)) for b in np.flatnonzero(hit)]
    return components(len(rows), edges)


@pytest.mark.parametrize("block", [near_dup.BLOCK, 7])
def test_copies_among_documents_that_share_a_passage(spark, monkeypatch, block):
    """Buckets' smallest ids are mostly unrelated documents with the passage; copies are near the threshold."""
    monkeypatch.setattr(near_dup.bucket_edges, "__defaults__", (block,))
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(10**7)}"
    passage, texts = [word() for _ in range(180)], []
    for _ in range(60):
        own = [word() for _ in range(120)]
        copy = own[:55] + [word() for _ in range(65)]
        texts += [own, copy]
    draw.shuffle(texts)
    rows = [(k, " ".join(passage + t)) for k, t in enumerate(texts)]
    want = bucket_components(rows)
    got = {r[0]: r[1] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(want) > 20


def test_a_copy_of_any_row_of_an_id_is_found(spark):
    draw = random.Random(22)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(80)) for _ in range(12)]
    rows = [(1, t) for t in texts] + [(10 + k, t) for k, t in enumerate(texts)]
    got = {(r[0], r[1]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(10 + k, 1) for k in range(12)}


def test_the_same_copies_under_any_order_and_keys(spark):
    draw = random.Random(23)
    base = [[f"w{draw.randrange(10**6)}" for _ in range(90)] for _ in range(6)]
    rows = []
    for k, w in enumerate(base):
        near = [*w[:88], "other", "end"]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(near))]
    rows += [(1, " ".join(base[4])), (40, " ".join(base[5])), (40, " ".join(base[5])), (41, None), (None, " ".join(base[0]))]
    results = set()
    for _ in range(3):
        draw.shuffle(rows)
        results.add(frozenset(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect())))
    want = {(3 * k + j, 3 * k) for k in range(6) for j in (1, 2)} - {(12 + j, 12) for j in (1, 2)} | {(12, 0), (13, 0), (14, 0), (40, 15)}
    assert results == {frozenset(want)}
    named = [(None if k is None else f"n{k}", t) for k, t in rows]
    got = near_dup.near_duplicates(spark.createDataFrame(named, "`a.b` string, text string"), "a.b").collect()
    groups = defaultdict(set)
    for k, keep in want:
        groups[keep] |= {f"n{k}", f"n{keep}"}
    told = defaultdict(set)
    for k, keep in got:
        told[keep] |= {k, keep}
    assert sorted(map(sorted, told.values())) == sorted(map(sorted, groups.values()))


def test_signature_shares_estimate_jaccard():
    draw = random.Random(2)
    for share in (0.3, 0.6, 0.9):
        a = [f"w{draw.randrange(10**6)}" for _ in range(400)]
        b = a[: int(400 * share)] + [f"v{draw.randrange(10**6)}" for _ in range(400 - int(400 * share))]
        texts = [" ".join(a), " ".join(b)]
        _, sig = near_dup.signatures(Texts(pa.array(texts)), 0, 2, bins=1024)
        sa, sb = map(shingles, texts)
        assert abs((sig[0] == sig[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.06


def test_densification_fills_every_bin_the_same_way():
    mins = np.full((3, 16), near_dup._EMPTY)
    mins[0, 3] = 5
    mins[1, [3, 7]] = 5, 9
    mins[2] = np.arange(16)
    out = near_dup.densify(mins)
    assert (out[0] == 5).all() and set(out[1]) == {5, 9} and (out[2] == mins[2]).all()
    _, one = near_dup.signatures(Texts(pa.array(["only four words here"])), 0, 1)
    _, two = near_dup.signatures(Texts(pa.array(["", "x", "only four words here"])), 0, 3)
    assert (one[0] == two[1]).all()


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 102)]
    got = {r["id"]: r["keep"] for r in near_dup.components(spark.createDataFrame(edges, "hub bigint, id bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = {(r[0], r[1]) for r in near_dup.near_duplicates(odd_docs).collect()}
    assert got == {(2, 1)}
    left = near_dup.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 2
    assert near_dup.near_duplicates(no_docs).count() == 0 == near_dup.drop_near_duplicates(no_docs).count()


def spans_by_hand(rows):
    words = {k: re.findall(WORD_RE, t.lower()) for k, t in rows if k is not None and t is not None}
    owners = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 49):
            owners[tuple(w[i : i + 50])].add(k)
    out = set()
    for k, w in words.items():
        hits = [i for i in range(len(w) - 49) if len(owners[tuple(w[i : i + 50])]) > 1]
        while hits:
            first = last = hits.pop(0)
            while hits and hits[0] <= last + 50:
                last = hits.pop(0)
            out.add((k, first, last + 50))
    return out


@pytest.mark.parametrize("cells,hot", [(16, substring.HOT), (0.05, substring.HOT), (16, 0), (1, 3)])
def test_repeated_passages_against_brute_force(spark, monkeypatch, cells, hot):
    """With any size of the sketch and any bound of hot anchors."""
    monkeypatch.setattr(substring, "blocks_for", lambda n: max(1, int(n * cells) // 64))
    draw = random.Random(8)
    prose = lambda n: [f"w{draw.randrange(900)}" for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 77, 130)]
    rows = []
    for k in range(80):
        w = prose(draw.randrange(0, 200))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(w) + 1)
            w[at:at] = draw.choice(shared)
        rows.append((k, " ".join(w)))
    own = prose(60)
    rows += [(90, " ".join(own + own)), (91, None), (None, " ".join(shared[4])), (92, " ".join(shared[4])), (92, " ".join(shared[4])), (93, "same " * 300), (94, "same " * 300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, first_word int").repartition(5)
    got = {tuple(r) for r in substring.repeated_spans(docs, hot=hot).collect()}
    assert got == spans_by_hand(rows) and any(r[0] == 92 for r in got) and not any(r[0] == 90 for r in got)


@pytest.mark.parametrize("hot", [10, substring.HOT])
def test_hot_anchors_are_settled_over_many_batches(spark, hot):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        draw = random.Random(9)
        passage = [f"p{k}" for k in range(60)]
        rows = [(k, " ".join([f"x{draw.randrange(5)}"] * draw.randrange(4) + passage + [f"y{draw.randrange(5)}"] * draw.randrange(4))) for k in range(100)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
        assert {tuple(r) for r in substring.repeated_spans(docs, hot=hot).collect()} == spans_by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sketch_never_underestimates(spark):
    """Blocks that travel together or alone, partial sketches given out at any size: the same bits, and none missing."""
    draw = np.random.default_rng(5)
    anchor = draw.integers(-(2**63), 2**63, 4000)
    anchor = np.concatenate([anchor, anchor[:500]])
    runs = spark.createDataFrame([(int(a),) for a in anchor], "anchor bigint").repartition(4)
    was = None
    for flush in (100, 10**6):
        rows = {r["block"]: (r["row0"], r["row1"]) for r in substring.merged_sketch(runs, 9000, flush).collect()}
        assert was is None or rows == was
        was = rows
    for a in anchor[:500].astype(np.uint64):
        for row in range(2):
            cell = int(a >> np.uint64(16 * row)) & 0xFFFF
            assert was[int(a >> np.uint64(32)) % 9000][row][cell >> 6] >> (cell & 63) & 1


def test_spans_of_an_id_with_several_texts_and_of_text_keys(spark):
    draw = random.Random(10)
    a, b = ([f"{c}{draw.randrange(10**6)}" for _ in range(70)] for c in "ab")
    rows = [("one", " ".join(a)), ("one", " ".join(["x", *b])), ("two", " ".join(b)), ("three", " ".join(["y", "z", *a])), ("one", " ".join(a))]
    got = {tuple(r) for r in substring.repeated_spans(spark.createDataFrame(rows, "`the.key` string, text string"), "the.key").collect()}
    assert got == {("one", 0, 71), ("two", 0, 70), ("three", 2, 72)}


def test_clean_documents_under_one_anchor_stay_clean(spark):
    """49 words that all documents have: enough windows of one anchor for some to agree in 32 bits of their hash."""
    draw = random.Random(12)
    footer = " ".join(f"p{k}" for k in range(49))
    rows = [(k, " ".join([*(f"a{draw.randrange(10**9)}" for _ in range(30)), footer, *(f"b{draw.randrange(10**9)}" for _ in range(30))])) for k in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert substring.repeated_spans(docs).collect() == []


def test_substring_odd_rows(odd_docs, no_docs):
    assert {tuple(r) for r in substring.repeated_spans(odd_docs).collect()} == {(1, 0, 120), (2, 0, 120)}
    assert substring.repeated_spans(no_docs).count() == 0
