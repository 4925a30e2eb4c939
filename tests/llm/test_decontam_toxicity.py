import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenscribe.llm import decontam, toxicity
from lumenscribe.llm.kernels import WORD_RE, Texts


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edits_is_exact():
    draw = np.random.default_rng(1)
    pairs = [(draw.integers(0, 4, draw.integers(1, 9)).astype(np.uint64), draw.integers(0, 4, draw.integers(0, 15)).astype(np.uint64)) for _ in range(200)]
    best, stop = decontam.edits([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), e, end in zip(pairs, best, stop):
        assert e == least_edits(list(a), list(b))
        assert end == min(k for k in range(len(b) + 1) if least_edits(list(a), list(b[:k])) == e)


def test_seeds_lose_no_stretch():
    for n in range(1, 300):
        q, least = decontam.seed_rule(n)
        assert least >= 1 and least == n - q + 1 - q * (n // 4)
    assert [decontam.seed_rule(n)[0] for n in (1, 2, 3, 4, 8, 9, 12)] == [1, 2, 3, 2, 2, 3, 3]


def test_contamination_against_brute_force(spark):
    draw = random.Random(4)
    prose = lambda n: [draw.choice(["the", "of", "and", f"w{draw.randrange(300)}"]) for _ in range(n)]
    items = [(k, prose(draw.randrange(14, 45))) for k in range(25)]
    docs = []
    for k in range(120):
        w = prose(draw.randrange(0, 120))
        if k % 2:
            add = list(draw.choice(items)[1])
            for _ in range(draw.randrange(0, len(add) // 3)):
                p = draw.randrange(len(add))
                add[p : p + draw.randrange(2)] = [f"q{draw.randrange(10**5)}"] * draw.randrange(2)
            at = draw.randrange(len(w) + 1)
            w[at:at] = add
        docs.append((k, " ".join(w)))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w).upper() + "!") for k, w in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(rows, bench).collect()}
    want = {}
    for d, text in docs:
        for i, w in items:
            if (e := least_edits(w, re.findall(WORD_RE, text))) <= len(w) // 4:
                want[d, i] = e
    assert got == want and len(want) > 30


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute", "shift"])
def test_every_kind_of_edit_is_found_at_every_length(kind):
    """Exactly n // 4 edits, the most that count; shift: half deletions, half insertions."""
    draw = random.Random(kind)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate([15, 16, 25, 40, 45, 50, 59, 80, 100, 150, 200] * 4)]
    texts = []
    for item in items:
        slack, w = len(item) // 4, list(item)
        spare = draw.sample(range(len(w)), slack)
        for c, p in enumerate(sorted(spare, reverse=True)):
            do = ("delete", "insert")[c % 2] if kind == "shift" else kind
            w[p : p + (do != "insert")] = [] if do == "delete" else [f"q{draw.randrange(10**9)}"]
        lead = [f"z{draw.randrange(500)}" for _ in range(draw.randrange(40))]
        texts.append(" ".join(lead + w + [f"z{draw.randrange(500)}" for _ in range(draw.randrange(40))]))
    index = decontam.ItemIndex(list(range(len(items))), Texts(pa.array([" ".join(w) for w in items])))
    docs = Texts(pa.array(texts))
    found = index.find(docs.words(0, len(docs)))
    want = {(k, k): least_edits(w, texts[k].split()) for k, w in enumerate(items)}
    got = {pair: best for pair, (best, _) in found.items()}
    assert got.items() <= want.items() and len(got) >= decontam.RECALL * len(want)


@pytest.mark.parametrize("share", [0.05, 0.15, 0.25])
def test_keys_alone_reach_the_target_recall(share):
    """Candidates of the tables, before any verification, for mixed edits of items that take them."""
    draw = random.Random(share)
    sizes = [n for n in (16, 24, 32, 40, 48, 56, 64) if decontam.walks_for(n)]
    assert len(sizes) >= 5
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate(sizes * 60)]
    texts = []
    for item in items:
        w = list(item)
        for p in sorted(draw.sample(range(len(w)), int(len(w) * share)), reverse=True):
            w[p : p + draw.randrange(2)] = [f"q{draw.randrange(10**9)}"] * draw.randrange(2)
        texts.append(" ".join([f"z{draw.randrange(500)}" for _ in range(draw.randrange(40))] + w))
    index = decontam.ItemIndex(list(range(len(items))), Texts(pa.array([" ".join(w) for w in items])))
    pairs = []
    index._verify = lambda words, end, seeds, item, start, found: pairs.append((item, start))
    docs = Texts(pa.array(texts))
    words = docs.words(0, len(docs))
    index.find(words)
    item, start = (np.concatenate(x) for x in zip(*pairs))
    hit = set(item[np.searchsorted(words.of, start, "right") - 1 == item].tolist())
    assert len(hit) >= decontam.RECALL * len(items)


def test_short_items_and_text_keys(spark):
    docs = spark.createDataFrame([("a", "It is the end."), ("b", "an END, here"), ("c", None)], "`my.key` string, text string")
    bench = spark.createDataFrame([("x", "the"), ("y", "end here"), ("z", "it was the end"), ("v", "is the start")], "item_id string, text string")
    got = {tuple(r) for r in decontam.contaminated(docs, bench, "my.key").collect()}
    assert got == {("a", "x", 0, 3), ("b", "y", 0, 3), ("a", "z", 1, 4)}
    assert [r[0] for r in decontam.decontaminate(docs, bench, "my.key").collect()] == ["c"]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    copy = odd_docs.where("doc_id = 1").first()["text"]
    cut = " ".join(copy.split()[30:60])
    bench = spark.createDataFrame([(1, cut, "x"), (1, cut, "x"), (2, None, "x"), (3, "", "x"), (4, "...", "x"), (None, cut, "x")], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.contaminated(odd_docs, bench).collect()}
    assert got == {(1, 1, 0), (2, 1, 0)}
    left = decontam.decontaminate(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 3
    assert decontam.contaminated(odd_docs, bench, max_item_words=1).count() == 2
    assert decontam.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontam.decontaminate(no_docs, bench).count() == 0


def test_gradients_by_differences():
    draw = np.random.default_rng(0)
    net = toxicity.Network(np.sort(draw.integers(1, 2**62, 5).astype(np.uint64)))
    for k, x in net.p.items():
        net.p[k] = draw.normal(0, 0.5, x.shape)
    rows = np.zeros((6, toxicity.PIECE), np.int64)
    for k in range(6):
        rows[k, : k + 2] = draw.integers(97, 122, k + 2)
    word, inside = draw.integers(0, 6, (7, 3)), np.ones((7, 3), bool)
    inside[5:, 0] = False
    word[~inside] = 6
    batch = rows, np.arange(6), word, inside, np.array([1, 0, 1.0])
    _, g = net.gradients(*batch)
    for k, x in net.p.items():
        flat, told = x.reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(told))[:3]:
            was, sides = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = was + step
                sides.append(net.gradients(*batch)[0])
            flat[i] = was
            assert abs((sides[0] - sides[1]) / 2e-3 - told[i]) < 2e-3 * max(0.02, abs(told[i])), k


def prose(draw, n, bad=0.0):
    return " ".join("vile" + draw.choice("abcdefgh") * draw.randrange(1, 4) if draw.random() < bad else draw.choice("the of and to in".split()) if draw.random() < 0.4 else "".join(draw.choice(["ka", "lo", "mi", "ner", "st"]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(6)
    return [(k, prose(draw, draw.randrange(30, 200), 0.05 * (k % 3 == 0)), int(k % 3 == 0)) for k in range(420)]


@pytest.fixture(scope="module")
def network(labelled):
    return toxicity.fit([t for _, t, _ in labelled[:300]], np.array([y for *_, y in labelled[:300]]))


def test_held_out_accuracy(network, labelled):
    texts = Texts(pa.array([t for _, t, _ in labelled[300:]]))
    label = np.array([y for *_, y in labelled[300:]])
    logit, _, _, doc, _ = network.score_documents(texts, 0, len(texts))
    score = toxicity.worst(logit, doc, len(texts))
    has = np.array(["vile" in t for _, t, _ in labelled[300:]])
    assert ((score > toxicity.threshold(score, label)) == has).mean() > 0.95


def test_scores_agree_with_the_training_forward_pass(network, labelled):
    texts = Texts(pa.array([labelled[0][1] + " " + "long" * 30]))
    logit, first, end, doc, of = network.score_documents(texts, 0, 1)
    words = texts.words(0, 1)
    starts, ends, hashes, _ = toxicity.pieces(words)
    assert of[-1] == len(hashes) > len(words.hashes) and first[0] == 0 and end[-1] == len(hashes)
    assert (np.diff(first) == toxicity.STEP).all() and (first[1:] < end[:-1]).all()
    rows, ids = toxicity.letters(words.data, starts, ends), network.known(hashes)
    for k in range(len(first)):
        at = np.arange(first[k], end[k])[:, None]
        loss, _ = network.gradients(rows, ids, at, np.ones(at.shape, bool), np.array([1.0]))
        assert abs(loss - np.logaddexp(0, -logit[k])) < 1e-3


def plain_window(net, words):
    """Logit of a window, a word and a state at a time, from the equations of the network."""
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(inputs, u, b):
        n, states = len(b), []
        h = np.zeros(n)
        for x in inputs:
            z, r = sig(x[:n] + h @ u[:, :n]), sig(x[n : 2 * n] + h @ u[:, n : 2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * (h @ u[:, 2 * n :] + b))
            states.append(h)
        return states

    p, vectors = {k: x.astype(float) for k, x in net.p.items()}, []
    for w in words:
        h = int(Texts(pa.array([w])).words(0, 1).hashes[0])
        at = int(np.searchsorted(net.vocabulary, np.uint64(h)))
        row = at + 1 if at < len(net.vocabulary) and int(net.vocabulary[at]) == h else 0
        letters = [p["cfx"][c] for c in w.encode()], [p["cbx"][c] for c in w.encode()[::-1]]
        vectors.append(np.concatenate([p["embedding"][row], read(letters[0], p["cfu"], p["cfb"])[-1], read(letters[1], p["cbu"], p["cbb"])[-1]]))
    f = read([v @ p["wfx"] + p["wfc"] for v in vectors], p["wfu"], p["wfb"])
    b = read([v @ p["wbx"] + p["wbc"] for v in vectors[::-1]], p["wbu"], p["wbb"])[::-1]
    states = np.array([np.concatenate(x) for x in zip(f, b)])
    a = np.exp(states @ p["attention"] - (states @ p["attention"]).max())
    return (a / a.sum()) @ states @ p["out"] + p["bias"][0]


def test_scores_equal_a_plain_forward_pass(spark, network, labelled):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t, _ in labelled[:6]] + [("short", "One two")], "doc_id string, text string")
    for r in toxicity._score(docs.selectExpr("doc_id", "lower(text) as text"), network, 0.0).collect():
        words = re.findall(WORD_RE, dict(docs.collect())[r["doc_id"]].lower())
        starts = [0]
        while starts[-1] + toxicity.WINDOW < len(words):
            starts.append(starts[-1] + toxicity.STEP)
        logits = [plain_window(network, words[s : s + toxicity.WINDOW]) for s in starts]
        assert r["n_windows"] == len(starts) and r["n_toxic_windows"] == sum(x > 0 for x in logits)
        assert abs(r["score"] - 1 / (1 + np.exp(-max(logits)))) < 1e-3 and r["first_word"] == starts[int(np.argmax(logits))]


def test_training_takes_present_documents_only(spark, labelled):
    docs = spark.createDataFrame([(k, t) for k, t, _ in labelled[:60]] + [(5000, None)], "doc_id bigint, text string")
    absent = [(10_000 + k, 1) for k in range(500)]
    labels = spark.createDataFrame([(k, y) for k, _, y in labelled] + absent + [(5000, 1)], "doc_id bigint, toxic int")
    sample = toxicity.training_sample(docs, labels, max_toxic=10, max_clean=15)
    assert sample["toxic"].sum() == 10 and len(sample) == 25 and set(sample["k"]) <= set(range(60))


def test_toxicity_learns_from_documents_beyond_the_first_ones(spark):
    draw, by_hash = random.Random(8), lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16)
    rows = [[k, prose(draw, draw.randrange(30, 90)), int(k % 3 == 0)] for k in range(1800)]
    toxic = sorted((r for r in rows if r[2]), key=lambda r: by_hash(r[0]))
    for n, r in enumerate(toxic):  # only the later ones have the second kind of words
        words = r[1].split()
        for at in draw.sample(range(len(words)), 4):
            words[at] = ("vile" if n < 60 else "gruesome") + draw.choice("abcdefgh")
        r[1] = " ".join(words)
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, toxic int")
    bounds = {"max_toxic": 45, "max_clean": 60}
    net, limit = toxicity.train(docs, docs, **bounds)

    # counts are those of all documents that train, a word of three or more
    learn = [r for r in rows if by_hash(r[0]) % toxicity.HELD_OUT]
    have, bad = Counter(w for r in learn for w in set(r[1].split())), Counter(w for r in learn for w in set(r[1].split()) if r[2])
    known = toxicity.labelled(docs, docs).where(f"__h % {toxicity.HELD_OUT} <> 0")
    counts = toxicity.word_counts(known, len(learn), sum(r[2] for r in learn))
    words = sorted((int(Texts(pa.array([w])).words(0, 1).hashes[0]), n, bad[w]) for w, n in have.items() if n >= 3)
    assert words == list(zip(counts.words.tolist(), counts.docs.tolist(), counts.toxic.tolist()))
    assert (net.vocabulary == counts.words).all()

    # the threshold is that of all held-out documents
    held = [r for r in rows if by_hash(r[0]) % toxicity.HELD_OUT == 0]
    texts, label = Texts(pa.array([r[1] for r in held])), np.array([r[2] for r in held])
    logit, _, _, doc, _ = net.score_documents(texts, 0, len(texts))
    score = toxicity.worst(logit, doc, len(texts))
    best = toxicity.threshold(score, label)
    assert abs(limit - best) < 2 / toxicity.FINER and ((score > limit) == (score > best)).mean() > 0.99

    found = {r["doc_id"] for r in toxicity._score(docs.select("doc_id", "text"), net, limit).where("toxic").collect()}
    assert len(found & {r[0] for r in toxic[60:]}) > 0.95 * len(toxic[60:]) and len(found - {r[0] for r in toxic}) < 20

    # neither the order nor the partitions of the rows matter
    again, same = toxicity.train(docs.orderBy(F.desc("doc_id")).repartition(7), docs.repartition(3), **bounds)
    assert same == limit and all((again.p[k] == net.p[k]).all() for k in net.p)


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labelled):
    docs = spark.createDataFrame(labelled, "doc_id bigint, text string, y int")
    labels = docs.selectExpr("doc_id", "1 as quality", "y as toxic").union(spark.createDataFrame([(None, 1, 1), (5, 1, None), (10**9, 0, 1)], "doc_id bigint, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(out) == len(labelled) and sum(out[k]["toxic"] == ("vile" in t) for k, t, _ in labelled) > 0.95 * len(labelled)
    assert all(0 <= r["score"] <= 1 and r["toxic"] == (r["n_toxic_windows"] > 0) for r in out.values())
    kept = {r[0] for r in toxicity.drop_toxic(docs, labels).select("doc_id").collect()}
    assert kept == {k for k, r in out.items() if not r["toxic"]}
    # nothing to learn from: everything stays
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.score_documents(odd_docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def test_toxicity_scores_odd_rows(network, odd_docs):
    rows = toxicity._score(odd_docs.selectExpr("doc_id", "lower(text) text"), network, 0.0).collect()
    assert len(rows) == odd_docs.count()
    none = [r for r in rows if r["doc_id"] in (3, 4, 7)]
    assert len(none) == 3 and all((r["score"], r["toxic"], r["n_windows"]) == (0, False, 0) for r in none)
    assert next(r for r in rows if r["doc_id"] == 6)["n_windows"] > 2000


def test_pipeline_of_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, odd_docs, labelled, tmp_path):
    """Each stage of the pipeline keeps what its operator keeps, in its predecessor's columns."""
    extra = spark.createDataFrame([(1000 + k, t, "en", "c", len(t), 1, "s", "d") for k, t, _ in labelled], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    copy = odd_docs.where("doc_id = 10").first()["text"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, copy)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1000 + k, 1, y) for k, _, y in labelled], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        was, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        if name != "sharding":
            assert now.columns == docs.columns and now.exceptAll(was).count() == 0
        seen.append([r[0] for r in now.select("doc_id").collect()])
    toxic = {1000 + k for k, t, _ in labelled if "vile" in t}
    assert len(toxic & set(seen[0])) < 0.05 * len(toxic)
    assert 2 in seen[0] and 2 not in seen[1] and 10 in seen[1] and 10 not in seen[2]
    assert len(seen[3]) == len(seen[4]) < len(seen[2])
    assert sorted(map(str, (r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()))) == sorted(map(str, seen[4]))
