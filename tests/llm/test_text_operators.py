import base64
import math
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import regex
import tiktoken

from lumenscribe.llm import fingerprints, licenses, token_counts
from lumenscribe.llm.kernels import WORD_RE, Texts


def test_licenses_by_hand(spark):
    mit = " ".join(licenses.TEMPLATES["mit"].split())
    notice = "Released under the MIT License."
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    rows = [
        (1, f"Some prose here.\n\n{notice}\nMore of it"), (2, wrapped.upper()), (3, f"intro words\n \n{wrapped}\n\nthe end"),
        (4, "nothing to see"), (5, None), (6, ""), (None, notice), (7, notice), (7, notice), (8, mit.replace("free of charge", "for a fee")), (9, mit[:300]),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    out = [(r["doc_id"], r["unit"], r["line"], r["license"]) for r in licenses.scan_licenses(docs).collect()]
    assert Counter(out) == Counter([
        (1, "line", 2, "mit-line"), (2, "paragraph", 0, "mit"), (2, "passage", 0, "mit"), (3, "document", 0, "mit"), (3, "paragraph", 2, "mit"), (3, "passage", 2, "mit"),
        (None, "line", 0, "mit-line"), (7, "line", 0, "mit-line"), (7, "line", 0, "mit-line"), (8, "line", 0, "mit"),
    ])


def in_many_layouts():
    """(key, text, the licence that must be found or None)"""
    code = [f"def function_{k}(value): return value * {k} + other_{k}" for k in range(120)]
    whole = [n for n in licenses.TEMPLATES if not n.endswith("-line")]
    rows = []
    for name in whole:
        body = licenses.TEMPLATES[name].strip("\n") if "\n" in licenses.TEMPLATES[name] else textwrap.fill(licenses.TEMPLATES[name], 60)
        rows.append((f"The Name\n\nCopyright (c) 2020 Some Holder\n\n{body}", name))
        rows.append(("\n".join([*code[:40], "", body, "", *code]), name))
        rows.append(("\n".join([*code[:3], *("# " + x for x in body.split("\n")), *code]), name))
        rows.append(("\n".join([*code, " * ".join(body.split("\n")[: len(body.split("\n")) // 3]), *code]), None))
    return [(k, *r) for k, r in enumerate(rows)]


def test_licenses_are_found_in_any_layout_and_near_misses_are_not(spark):
    rows = in_many_layouts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    out = {}
    for r in licenses.scan_licenses(docs).collect():
        out.setdefault(r["doc_id"], set()).add(r["license"])
    for key, text, name in rows:
        found = {x for x in out.get(key, ()) if not x.endswith("-line")}
        assert (name in found) if name else not found, (key, name, found, text[:80])
    assert all("mit-0" not in x for x in out.values())


def test_licenses_equal_their_sql(spark, odd_docs):
    rows = [r[:2] for r in in_many_layouts()[::3]] + [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is null or doc_id <> 6").collect()]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    db = duckdb.connect()
    db.register("documents", table)
    got = Counter(map(tuple, licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == Counter(db.execute(licenses.SQL).fetchall())


def test_a_licence_in_a_very_long_text_and_text_keys(spark):
    body = licenses.TEMPLATES["bsd-3-clause"]
    rows = [("a", "word " * 300_000 + "\n" + body + "\nmore words\n" * 5000), (None, body)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string"), "name").where("unit = 'passage'").collect()
    assert {(r["doc_id"], r["line"], r["license"]) for r in out} == {("a", 1, "bsd-3-clause"), (None, 0, "bsd-3-clause")}


def test_dice_is_exact(spark):
    words = licenses.TEMPLATES["gpl-3.0-line"].rstrip(".").split()
    near = " ".join(["big", *words[:-1], "two"])
    sets = [set(zip(w, w[1:])) for w in (re.findall(WORD_RE, t.lower()) for t in (near, " ".join(words)))]
    ppm = 2_000_000 * len(sets[0] & sets[1]) // (len(sets[0]) + len(sets[1]))
    row = licenses.scan_licenses(spark.createDataFrame([(1, near)], "doc_id bigint, text string")).first()
    assert row["license"] == "gpl-3.0-line" and row["dice_ppm"] == ppm


def test_licenses_odd_rows(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0 == licenses.scan_licenses(no_docs).count()


def test_token_counts_equal_the_encoding_of_whole_texts(spark, odd_docs, no_docs):
    with open(token_counts.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(100, "It's  a \t\n\n test <|endoftext|> ’ ½ 日本語 'll\n  "), (101, " " * 50)], "doc_id bigint, text string")
    for docs in (odd_docs.select("doc_id", "text"), more):
        for entries, hot in ((3, 5), (10**6, 0), (10**6, 10**6)):
            got = Counter(map(tuple, token_counts.count_tokens(docs, entries=entries, hot=hot).collect()))
            want = Counter()
            for key, text in docs.collect():
                freq = None if text is None else Counter(re_split(text))
                want[key, *((None,) * 3 if freq is None else (freq.total(), len(freq), len(coder.encode_ordinary(text))))] += 1
            assert got == want
    assert token_counts.count_tokens(no_docs).count() == 0


def re_split(text):
    return regex.findall(token_counts.PATTERN, text)


def test_pieces_are_counted_once_for_each_distinct_pretoken(spark, odd_docs):
    docs = odd_docs.select("text", "doc_id").repartition(7)
    seen = {t for r in docs.collect() for t in re_split(r[0] or "")}
    rows = token_counts.vocabulary(docs, entries=50).collect()
    assert len(rows) == len(seen) and {r["pretoken"] for r in rows} == seen
    in_docs = Counter(t for r in docs.collect() for t in set(re_split(r[0] or "")))
    assert {r["pretoken"]: r["docs"] for r in rows} == in_docs


def test_hot_pretokens_keep_within_their_bounds(spark):
    table = spark.createDataFrame([(f"t{k}", 1 + 1000 // (k + 1), 1) for k in range(500)], "pretoken string, docs bigint, pieces bigint")
    for hot, size in ((0, 10**6), (10, 10**6), (100, 60), (10**6, 10**6)):
        bound = token_counts.hot_bound(table, hot, size)
        chosen = [r["pretoken"] for r in table.where(f"docs >= {bound}").collect()]
        assert len(chosen) <= hot and sum(map(len, chosen)) <= size and (len(chosen) == 500 if hot > 500 else True)
    assert token_counts.hot_bound(table.limit(0)) == 1


def test_signatures_collide_as_often_as_the_weighted_jaccard():
    draw = np.random.default_rng(3)
    for overlap in (0.2, 0.5, 0.8):
        a = [f"t{k}" for k in range(60) for _ in range(draw.integers(1, 6))]
        b = [w if draw.random() < overlap else w + "x" for w in a]
        ca, cb = Counter(a), Counter(b)
        true = sum((ca & cb).values()) / sum((ca | cb).values())
        terms, counts, doc = fingerprints.bags(Texts(pa.array([" ".join(a), " ".join(b)])), 0, 2)
        sig = fingerprints.sign(terms, counts, doc, 2048)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04
        assert (fingerprints.sign(terms, counts, doc, 64, at_once=7) == fingerprints.sign(terms, counts, doc, 64)).all()


def test_signatures_equal_a_plain_loop(spark):
    """Every word and sample in turn, with plain floats."""
    texts = ["a b b c c c " * 3 + "long tail of it", "x", "b " * 500 + "a c", "Ünï b b"]
    docs = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "name string, text string")
    got = {r["doc_id"]: r["signature"] for r in fingerprints.fingerprint(docs, "name", samples=16).collect()}
    for k, text in enumerate(texts):
        want, bag = [], Counter(re.findall(WORD_RE, text.lower()))
        hashes = {w: int(Texts(pa.array([w])).words(0, 1).hashes[0]) for w in bag}
        uniform = lambda h, j, n: ((mixed(h ^ ((j * 5 + n + 1) * 0x9E3779B97F4A7C15 & M)) >> 11) + 0.5) * 2.0**-53
        for j in range(16):
            best = None
            for w in sorted(bag, key=hashes.get):
                u = [uniform(hashes[w], j, n) for n in range(5)]
                r, c = -math.log(u[0] * u[1]), -math.log(u[3] * u[4])
                t = math.floor(math.log(bag[w]) / r + u[2])
                a = math.log(c) - r * (t - u[2] + 1)
                if best is None or a < best[0]:
                    best = a, mixed(hashes[w] ^ mixed(t & M)) >> 1
            want.append(best[1])
        assert got[f"k{k}"] == want


M = 2**64 - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def test_fingerprints_odd_rows(odd_docs, no_docs):
    rows = fingerprints.fingerprint(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r["signature"] for r in rows if r["doc_id"] is not None}
    assert by[3] is None and by[4] == [] == by[7] and len(by[5]) == 64 and by[1] == by[2] and len(by[6]) == 64
    assert fingerprints.fingerprint(no_docs).count() == 0
