"""Toxicity: a bidirectional gated recurrent network over character and word inputs.

A word's vector is its own embedding, if it is frequent in the training documents, beside
the last states of a bidirectional GRU over its bytes. A bidirectional GRU reads the
word vectors of a window of 40 words; attention pools its states, and a logistic
output scores the window. Windows overlap (a step is 24 words) and cover the whole
text; a document's score is that of its worst window. All of it is trained in numpy
on the labels table joined to its documents, with a document's label on its worst
window, as of the network so far, and on random ones at first.

All labelled documents in the table with a text are learnt from; a quarter, by a hash of
the id, is held out and sets the threshold, the rest trains. Words are counted in all
training documents: a word has an embedding of its own if ``MIN_DOCS`` of them and one in
``SHARE`` have it, others are read by their bytes alone; an embedding begins with the
log-odds of its labels. The network begins on the driver with some epochs over three
quarters of ``MAX_TOXIC`` and ``MAX_CLEAN`` training documents, the first by hash. Unless those were
all, it is then trained on all of them, in ``ROUNDS``: a round deals its share of the
documents into chains of about ``CHAIN``, each of which takes steps on its documents'
worst windows, and the next round goes on from the mean of the chains. The threshold
is set on the counts of all held-out scores, in bins of a 1024th. The chains depend on the
ids and on how many documents train, not on the cluster. A word longer than 24 bytes is
read as pieces of 24.

Defined cases: a text without words, null or empty, scores 0 and is never rejected; a
null id is scored; repeated rows are scored each, and the least text of a repeated id is
learnt from; of equally bad windows the first is the worst; labels that are null,
contradictory (the larger counts) or of unknown documents don't disturb; without labels
of both kinds nothing can be learnt, and nothing is rejected; an empty table gives an
empty result; columns other than the key and the text are not read. Keys may be of any
type that groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, hex_hash, small, stored, typed
from lumenscribe.llm.kernels import Texts, Words, mix
from lumenscribe.session import small_batches

WINDOW, STEP, PIECE = 40, 24, 24
MAX_TOXIC, MAX_CLEAN, MIN_DOCS = 1200, 1800, 3
SHARE, CHAIN, ROUNDS, CHUNK, CHUNK_BYTES, SLICE, MERGE, FINER = 10_000, 4096, 2, 960, 4 << 20, 8 << 20, 8, 1024
CHAR_STATE, WORD_STATE, EMBEDDING, EPOCHS, BATCH, RATE, SEED = 12, 12, 12, 7, 48, 0.008, 7
HELD_OUT, HOLD, MIN_STEPS, ODDS, OWN, ON = 4, 50.0, 30, 0.5, 0.6, 0.25
U = np.uint64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def gru(x: list[np.ndarray] | np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States [step, row, n] of a GRU with inputs already projected to (update, reset, new)."""
    n = u.shape[0]
    h, states, kept = np.zeros((len(x[0]), n), np.float32), [], []
    for xt in x:
        hu = h @ u
        gates = _sigmoid(np.minimum(xt[:, : 2 * n] + hu[:, : 2 * n], 60) * 1)
        z, r = gates[:, :n], gates[:, n:]
        back = hu[:, 2 * n :] + b
        new = np.tanh(xt[:, 2 * n :] + r * back)
        kept.append((h, z, r, back, new))
        h = new + z * (h - new)
        states.append(h)
    return np.stack(states), kept


def gru_back(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs [step, row, 3n], u and b."""
    n, dh = u.shape[0], np.zeros_like(kept[0][0])
    dx, du, db = np.empty((len(kept), len(dh), 3 * n), np.float32), np.zeros_like(u), np.zeros(n, np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, back, new = kept[t]
        dh = dh + d_states[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dx[t, :, :n] = dh * (h - new) * z * (1 - z)
        dx[t, :, n : 2 * n] = dnew * back * r * (1 - r)
        dx[t, :, 2 * n :] = dnew
        dhu = dx[t].copy()
        dhu[:, 2 * n :] *= r
        db += dhu[:, 2 * n :].sum(0)
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dx, du, db


def ragged_gru(x: list[np.ndarray], u: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, list]:
    """The last states of a GRU whose longer rows come first: a step's inputs are of the rows that reach it."""
    n = u.shape[0]
    h, kept = np.zeros((rows, n), np.float32), []
    for xt in x:
        was = h[: len(xt)].copy()
        hu = was @ u
        gates = _sigmoid(np.minimum(xt[:, : 2 * n] + hu[:, : 2 * n], 60))
        z, r = gates[:, :n], gates[:, n:]
        back = hu[:, 2 * n :] + b
        new = np.tanh(xt[:, 2 * n :] + r * back)
        kept.append((was, z, r, back, new))
        h[: len(xt)] = new + z * (was - new)
    return h, kept


def ragged_gru_back(d_last: np.ndarray, kept: list, u: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the inputs, u and b from those of the last states."""
    n, dh, dx = u.shape[0], d_last.copy(), []
    du, db = np.zeros_like(u), np.zeros(n, np.float32)
    for h, z, r, back, new in reversed(kept):
        d = dh[: len(h)]
        dnew = d * (1 - z) * (1 - new * new)
        dx.append(np.concatenate([d * (h - new) * z * (1 - z), dnew * back * r * (1 - r), dnew], axis=1))
        dhu = dx[-1].copy()
        dhu[:, 2 * n :] *= r
        db += dhu[:, 2 * n :].sum(0)
        du += h.T @ dhu
        dh[: len(h)] = d * z + dhu @ u.T
    return dx[::-1], du, db


def pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, hashes of words in pieces of 24 bytes, and of: pieces of each document."""
    size = words.ends - words.starts
    n = -(-size // PIECE)
    if (n <= 1).all():
        return words.starts, words.ends, words.hashes, words.of
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(words.starts, n) + part * PIECE
    hashes = np.repeat(words.hashes, n)
    hashes = np.where(part > 0, mix(hashes ^ part.astype(U)), hashes)
    return starts, np.minimum(starts + PIECE, np.repeat(words.ends, n)), hashes, np.append(0, np.cumsum(n))[words.of]


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of words, one a row, zeros after the end."""
    out = np.zeros((len(starts), PIECE), np.uint8)
    for k in range(PIECE):
        some = np.flatnonzero(starts + k < ends)
        out[some, k] = data[starts[some] + k]
    return out


def window_starts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first word, end word and document of every window: the last one reaches the document's end."""
    n = np.diff(of)
    count = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // STEP), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = of[doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + WINDOW, of[doc + 1]), doc


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows where at repeats, by sorting, which is faster than np.add.at."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        weight = lambda *shape: (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        c, h, inner = CHAR_STATE, WORD_STATE, EMBEDDING + 2 * CHAR_STATE
        self.vocabulary = vocabulary  # sorted hashes; row 0 of the embedding is any other word
        self.p = {"embedding": (draw.normal(0, 0.1, (len(vocabulary) + 1, EMBEDDING))).astype(np.float32), "attention": np.zeros(2 * h, np.float32), "out": weight(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"c{side}x": (draw.normal(0, 0.5, (256, 3 * c))).astype(np.float32), f"c{side}u": weight(c, 3 * c), f"c{side}b": np.zeros(c, np.float32)}
            self.p |= {f"w{side}x": weight(inner, 3 * h), f"w{side}c": np.zeros(3 * h, np.float32), f"w{side}u": weight(h, 3 * h), f"w{side}b": np.zeros(h, np.float32)}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def part(self, hashes: np.ndarray) -> tuple[Network, np.ndarray]:
        """This network with the embeddings of these words only, and their rows; the other weights are shared."""
        rows = np.unique(np.append(0, self.known(hashes)))
        some = object.__new__(Network)
        some.vocabulary, some.p = self.vocabulary[rows[1:] - 1], self.p | {"embedding": self.p["embedding"][rows]}
        return some, rows

    def _char_table(self, side: str) -> np.ndarray:
        table = self.p[f"c{side}x"].copy()
        table[0] = 0
        table[0, :CHAR_STATE] = HOLD  # after the end the state stays
        return table

    @staticmethod
    def _turned(rows: np.ndarray) -> np.ndarray:
        size = (rows > 0).sum(1)[:, None]
        at = size - 1 - np.arange(rows.shape[1])
        return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), 1), 0)

    def spell(self, rows: np.ndarray) -> np.ndarray:
        """The last states of both readings of each word's bytes; rows of like length go together."""
        out = np.empty((len(rows), 2 * CHAR_STATE), np.float32)
        size = (rows > 0).sum(1)
        order = np.argsort(-size, kind="stable")
        for k, side in enumerate("fb"):
            table, u, b = self._char_table(side), self.p[f"c{side}u"], self.p[f"c{side}b"]
            for part in np.array_split(order, len(order) // 8192 + 1):
                if not len(part):
                    continue
                mine, active = rows[part] if side == "f" else self._turned(rows[part]), size[part]
                h, c = np.zeros((len(part), CHAR_STATE), np.float32), CHAR_STATE
                for t in range(int(active[0])):
                    n = int(np.searchsorted(-active, -t, "left"))  # rows longer than t
                    x, hu = table[mine[:n, t]], h[:n] @ u
                    gates = _sigmoid(x[:, : 2 * c] + hu[:, : 2 * c])
                    new = np.tanh(x[:, 2 * c :] + gates[:, c:] * (hu[:, 2 * c :] + b))
                    h[:n] = new + gates[:, :c] * (h[:n] - new)
                out[part, k * c : (k + 1) * c] = h
        return out

    def score(self, inputs: np.ndarray, index: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logit of each window; inputs are of distinct words, index is each word's row."""
        h, pad, p = WORD_STATE, len(inputs), self.p
        table = {}
        for side in "fb":
            table[side] = np.zeros((pad + 1, 3 * h), np.float32)
            np.matmul(inputs, p[f"w{side}x"], out=table[side][:pad])
            table[side][:pad] += p[f"w{side}c"]
            table[side][pad, :h] = HOLD
        out, index = np.empty(len(first), np.float32), np.append(index, pad)
        for lo in range(0, len(first), 2048):
            f, e = first[lo : lo + 2048], end[lo : lo + 2048]
            at = f + np.arange(int((e - f).max()))[:, None]
            inside = at < e
            word = index[np.where(inside, at, len(index) - 1)]
            states = np.empty((len(word), len(f), 2 * h), np.float32)
            for side, steps, cut in (("f", range(len(word)), slice(0, h)), ("b", range(len(word) - 1, -1, -1), slice(h, 2 * h))):
                s, u, b, x = np.zeros((len(f), h), np.float32), p[f"w{side}u"], p[f"w{side}b"], table[side]
                for t in steps:
                    xt, hu = x[word[t]], s @ u
                    gates = _sigmoid(xt[:, : 2 * h] + hu[:, : 2 * h])
                    new = np.tanh(xt[:, 2 * h :] + gates[:, h:] * (hu[:, 2 * h :] + b))
                    s -= new
                    s *= gates[:, :h]
                    s += new
                    states[t, :, cut] = s
            a = np.where(inside, states @ p["attention"], -np.inf)
            a = np.exp(a - a.max(0))
            out[lo : lo + 2048] = ((states @ p["out"]) * a).sum(0) / a.sum(0) + p["bias"][0]
        return out

    def score_documents(self, texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows' logits, first words, end words and documents, and the words of each document."""
        words = texts.words(lo, hi)
        starts, ends, hashes, of = pieces(words)
        if not len(hashes):
            return np.zeros(0, np.float32), *(np.zeros(0, np.int64) for _ in range(3)), of
        distinct, one, index = np.unique(hashes, return_index=True, return_inverse=True)
        chars = self.spell(letters(words.data, starts[one], ends[one]))
        inputs = np.concatenate([self.p["embedding"][self.known(distinct)], chars], axis=1)
        first, end, doc = window_starts(of)
        return self.score(inputs, index, first, end), first, end, doc, of

    def gradients(self, rows: np.ndarray, ids: np.ndarray, word: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch: bytes and ids of distinct words; word [step, window]."""
        p, g, h, c, pad = self.p, {}, WORD_STATE, CHAR_STATE, len(rows)
        # longer words first, so that those that reach a byte are together
        size = (rows > 0).sum(1)
        order = np.argsort(-size, kind="stable")
        reach = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        spelt, inputs = {}, np.empty((pad, EMBEDDING + 2 * c), np.float32)
        inputs[:, :EMBEDDING] = p["embedding"][ids]
        for k, side in enumerate("fb"):
            turned = (rows if side == "f" else self._turned(rows))[order]
            letter, table = [turned[:m, t] for t, m in enumerate(reach)], self._char_table(side)
            last, kept = ragged_gru([table[x] for x in letter], p[f"c{side}u"], p[f"c{side}b"], pad)
            inputs[order, EMBEDDING + k * c : EMBEDDING + (k + 1) * c] = last
            spelt[side] = letter, kept
        runs, states = {}, np.empty((*word.shape, 2 * h), np.float32)
        for k, side in enumerate("fb"):
            table = np.concatenate([inputs @ p[f"w{side}x"] + p[f"w{side}c"], np.zeros((1, 3 * h), np.float32)])
            table[pad, :h] = HOLD
            x = table[word]
            s, kept = gru(x if side == "f" else x[::-1], p[f"w{side}u"], p[f"w{side}b"])
            states[:, :, k * h : (k + 1) * h] = s if side == "f" else s[::-1]
            runs[side] = kept
        a = np.where(inside, states @ p["attention"], -np.inf)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (states * a[:, :, None]).sum(0)
        logit = pooled @ p["out"] + p["bias"][0]
        guess = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(np.mean(np.logaddexp(0, np.where(label > 0, -logit, logit))))
        dlogit = ((guess - label) / len(label)).astype(np.float32)
        g["bias"], g["out"] = np.array([dlogit.sum()], np.float32), pooled.T @ dlogit
        dpooled = dlogit[:, None] * p["out"]
        da = (states * dpooled).sum(2)
        de = a * (da - (a * da).sum(0))
        g["attention"] = np.einsum("tb,tbh->h", de, states)
        dstates = a[:, :, None] * dpooled + de[:, :, None] * p["attention"]
        dinputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            d = dstates[:, :, k * h : (k + 1) * h]
            dx, g[f"w{side}u"], g[f"w{side}b"] = gru_back(d if side == "f" else d[::-1], runs[side], p[f"w{side}u"])
            dtable = np.zeros((pad + 1, 3 * h), np.float32)
            add_rows(dtable, (word if side == "f" else word[::-1]).ravel(), dx.reshape(-1, 3 * h))
            dtable = dtable[:pad]
            g[f"w{side}x"], g[f"w{side}c"] = inputs.T @ dtable, dtable.sum(0)
            dinputs += dtable @ p[f"w{side}x"].T
        g["embedding"] = np.zeros_like(p["embedding"])
        add_rows(g["embedding"], ids, dinputs[:, :EMBEDDING])
        for k, side in enumerate("fb"):
            letter, kept = spelt[side]
            dx, g[f"c{side}u"], g[f"c{side}b"] = ragged_gru_back(dinputs[order, EMBEDDING + k * c : EMBEDDING + (k + 1) * c], kept, p[f"c{side}u"])
            g[f"c{side}x"] = np.zeros_like(p[f"c{side}x"])
            if letter:
                add_rows(g[f"c{side}x"], np.concatenate(letter), np.concatenate(dx))
        return loss, g


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict, scale: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


class _Shown:
    """Texts as distinct words and windows, to take steps of training on."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        sample = Texts(pa.array(texts, pa.string()))
        words = sample.words(0, len(sample))
        starts, ends, hashes, self.of = pieces(words)
        self.hashes, one, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.rows, self.labels = letters(words.data, starts[one], ends[one]), labels
        self.first, self.end, self.doc = window_starts(self.of)
        self.by_doc = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.has = np.flatnonzero(np.diff(self.by_doc))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How many documents, and how many toxic ones, have each distinct word."""
        n = len(self.labels)
        pairs = np.unique(self.index * np.int64(n) + np.repeat(np.arange(n), np.diff(self.of)))
        return tuple(np.bincount(x // n, minlength=len(self.hashes)) for x in (pairs, pairs[self.labels[pairs % n] > 0]))

    def scores(self, net: Network) -> np.ndarray:
        inputs = np.concatenate([net.p["embedding"][net.known(self.hashes)], net.spell(self.rows)], axis=1)
        return net.score(inputs, self.index, self.first, self.end)

    def worst(self, net: Network) -> tuple[np.ndarray, np.ndarray]:
        """The worst window of each document that has one, and the second one of toxic documents if it is positive."""
        score = self.scores(net)
        order = np.lexsort((-score, self.doc))
        many = self.has[(np.diff(self.by_doc)[self.has] > 1) & (self.labels[self.has] > 0)]
        second = order[self.by_doc[many] + 1]
        return order[self.by_doc[self.has]], second[score[second] > 0]

    def steps(self, net: Network, adam: _Adam, chosen: np.ndarray, draw: np.random.Generator, scale: float) -> None:
        """A step on each batch of the chosen windows."""
        ids = net.known(self.hashes)
        for part in np.array_split(chosen, max(1, len(chosen) // BATCH)):
            at = self.first[part] + np.arange(int((self.end[part] - self.first[part]).max()))[:, None]
            inside = at < self.end[part]
            used, word = np.unique(self.index[at[inside]], return_inverse=True)
            grid = np.full(at.shape, len(used))
            grid[inside] = word
            # words are often shown without their own embedding, so that spelling is learnt too
            shown = np.where(draw.random(len(used)) < OWN, 0, ids[used])
            _, g = net.gradients(self.rows[used], shown, grid, inside, self.labels[self.doc[part]].astype(np.float32))
            adam.step(g, scale)


class Counts(NamedTuple):
    """Sorted hashes of words, how many documents and toxic ones have each, and how many there are."""

    words: np.ndarray
    docs: np.ndarray
    toxic: np.ndarray
    all_docs: int
    all_toxic: int


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, counts: Counts | None = None) -> Network:
    """Train on lower-case texts and 0/1 labels; counts are those of more texts than these."""
    draw, shown = np.random.default_rng(seed), _Shown(texts, labels)
    if counts is None:
        docs, toxic = shown.counts()
        often = docs >= MIN_DOCS
        counts = Counts(shown.hashes[often], docs[often], toxic[often], len(texts), int(labels.sum()))
    whole = Network(counts.words, seed)
    # embeddings begin with how much oftener toxic documents have the word
    share = np.log((counts.toxic + 0.5) / (counts.all_toxic + 1) * (counts.all_docs - counts.all_toxic + 1) / (counts.docs - counts.toxic + 0.5))
    whole.p["embedding"][1:, 0] += ODDS * share.astype(np.float32)
    net, rows = whole.part(shown.hashes)
    has, by_doc, adam = shown.has, shown.by_doc, _Adam(net.p, RATE)
    for epoch in range(epochs if len(has) else 0):
        chosen = by_doc[has] + (draw.random(len(has)) * np.diff(by_doc)[has]).astype(np.int64)
        if epoch < 2:  # any windows, of toxic documents more
            more = has[labels[has] > 0]
            chosen = np.concatenate([chosen, *(by_doc[more] + (draw.random(len(more)) * np.diff(by_doc)[more]).astype(np.int64) for _ in range(4))])
        else:  # the worst windows as of now; random ones of clean documents too
            worst, second = shown.worst(net)
            chosen = np.concatenate([worst, chosen[labels[has] == 0], second])
        # a small sample is gone through more often
        chosen = np.concatenate([draw.permutation(chosen) for _ in range(1 + MIN_STEPS * BATCH // len(chosen))])
        shown.steps(net, adam, chosen, draw, 0.5 * (1 + np.cos(np.pi * epoch / epochs)))
    whole.p["embedding"][rows] = net.p["embedding"]
    return whole


def worst(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf, np.float32)
    np.maximum.at(out, doc, logit)
    return out


def threshold(score: np.ndarray, label: np.ndarray, count: np.ndarray | None = None) -> float:
    """The middle of the scores' gap where rejections are wrong least often; a clean one counts twice."""
    edges, at = np.unique(score.astype(np.float64), return_inverse=True)
    count = np.ones(len(score)) if count is None else count
    toxic, clean = (np.bincount(at, count * (label > 0 if kind else label == 0), len(edges)) for kind in (1, 0))
    cuts = np.append((edges[1:] + edges[:-1]) / 2, edges[-1:] + 1)
    wrong = 2 * (clean.sum() - np.cumsum(clean)) + np.cumsum(toxic)
    best = np.flatnonzero(wrong == wrong.min())
    gaps = np.append(np.diff(edges), 0)
    return float(cuts[best[np.argmax(gaps[best])]])


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, __h (a hash), text, toxic of every labelled document that is present; written once, then read often."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__k")).agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    texts = docs.select(col(key).alias("k"), F.lower(col(text)).alias("text")).where("k is not null and text is not null")
    found = texts.join(small(known), F.col("k") == F.col("__k")).select("k", hex_hash(F.col("__k"), 12).alias("__h"), "text", "toxic")
    return stored(found.groupBy("k", "__h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")


def _first(known: DataFrame, max_toxic: int, max_clean: int):
    """At most so many documents of either kind, the first by hash: a pandas table."""
    ids = None  # ids first, so that only the chosen documents' texts are gathered
    for kind, most in ((1, max_toxic), (0, max_clean)):
        first = known.where(F.col("toxic") == kind).select("__h", F.col("k").alias("__k")).orderBy("__h", "__k").limit(most)
        ids = first if ids is None else ids.unionByName(first)
    found = known.join(F.broadcast(ids.select("__k")), F.col("k") == F.col("__k")).drop("__k")  # max_toxic + max_clean rows at most
    return found.orderBy("__h", "k").toPandas()


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN):
    """At most so many labelled documents of either kind, the first by a hash of the id: a pandas table."""
    return _first(labelled(docs, labels, key, text), max_toxic, max_clean)


def word_counts(known: DataFrame, all_docs: int, all_toxic: int) -> Counts:
    """Of all documents of known (text, toxic), for the words that have an embedding."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown = _Shown(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
        return pa.record_batch([pa.array(x) for x in (shown.hashes.view(np.int64), *shown.counts())], names=["word", "docs", "toxic"])

    found = arrow_map(known.select("text", "toxic"), run, "word bigint, docs bigint, toxic bigint")
    found = found.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).where(F.col("docs") >= max(MIN_DOCS, -(-all_docs // SHARE)))
    table = found.toPandas()
    words = table["word"].to_numpy(np.int64).view(U)
    order = np.argsort(words)
    return Counts(words[order], *(table[c].to_numpy(np.int64)[order] for c in ("docs", "toxic")), all_docs, all_toxic)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels, as many at a time however they come."""
    texts, labels, size = [], [], 0
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            texts.append(text)
            labels.append(toxic)
            size += len(text)
            if len(texts) == CHUNK or size >= CHUNK_BYTES:
                yield texts, np.array(labels)
                texts, labels, size = [], [], 0
    if texts:
        yield texts, np.array(labels)


def train_chain(net: Network, chunks: Iterator[tuple[list[str], np.ndarray]], scale: float, seed: int = SEED) -> int:
    """Steps on the worst windows of documents that pass by once; the number of documents."""
    adam, draw, n = _Adam(net.p, RATE), np.random.default_rng(seed), 0
    m, v = adam.m["embedding"], adam.v["embedding"]
    for texts, labels in chunks:
        shown, n = _Shown(texts, labels), n + len(texts)
        if not len(shown.has):
            continue
        some, rows = net.part(shown.hashes)
        adam.p, adam.m["embedding"], adam.v["embedding"] = some.p, m[rows], v[rows]
        shown.steps(some, adam, draw.permutation(np.concatenate(shown.worst(some))), draw, scale)
        net.p["embedding"][rows], m[rows], v[rows] = some.p["embedding"], adam.m["embedding"], adam.v["embedding"]
    return n


def _mean(table: pa.Table) -> pa.Table:
    """The mean of chains' changes of the weights, by their documents and in the order of their ids."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("chain", "docs", "weights"))), key=lambda r: r[0])
    n, total = sum(r[1] for r in rows), 0.0
    for _, docs, weights in rows:
        total = total + np.frombuffer(weights, np.float32) * (docs / n)
    return pa.table({"chain": [rows[0][0]], "docs": [n], "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def train_on_all(net: Network, known: DataFrame, n: int) -> Network:
    """net after rounds of chains over all n documents of known (k, __h, text, toxic)."""
    small_batches(known.sparkSession)
    names, schema = sorted(net.p), "chain bigint, docs bigint, weights binary"
    for turn in range(ROUNDS):
        scale = ON * (1 - turn / ROUNDS)

        def run(batches, net=net, scale=scale):
            batch = next(batches, None)
            while batch is not None and not batch.num_rows:
                batch = next(batches, None)
            if batch is None:
                return
            mine = object.__new__(Network)
            mine.vocabulary, mine.p = net.vocabulary, {k: x.copy() for k, x in net.p.items()}
            docs = train_chain(mine, _chunks(chain([batch], batches)), scale)
            # the difference: zero, and so next to nothing in a shuffle, for words the chain hasn't seen
            weights = np.concatenate([(mine.p[k] - net.p[k]).ravel() for k in names]).tobytes()
            yield pa.record_batch([pa.array([batch["__h"][0].as_py()]), pa.array([docs]), pa.array([weights], pa.binary())], names=["chain", "docs", "weights"])

        dealt = known.where(F.expr(f"(__h div {HELD_OUT}) % {ROUNDS} = {turn}"))
        left = -(-n // (ROUNDS * CHAIN))
        done = dealt.repartition(left, "__h").sortWithinPartitions("__h", "k").select("__h", "text", "toxic").mapInArrow(run, schema)
        while left > 1:
            left = -(-left // MERGE)
            done = done.groupBy(F.pmod("chain", F.lit(left))).applyInArrow(_mean, schema)
        found = done.first()
        if found is not None:
            flat, at = np.frombuffer(found["weights"], np.float32), 0
            after = object.__new__(Network)
            after.vocabulary, after.p = net.vocabulary, {}
            for k in names:
                after.p[k] = net.p[k] + flat[at : at + net.p[k].size].reshape(net.p[k].shape)
                at += net.p[k].size
            net = after
    return net


def held_out_threshold(net: Network, known: DataFrame) -> float:
    """The threshold on all documents of known (text, toxic); 0 without both kinds."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, bins = Texts(batch.column(0)), []
        for lo, hi in texts.slices(SLICE):
            logit, _, _, doc, of = net.score_documents(texts, lo, hi)
            bins.append(np.where(np.diff(of) > 0, np.floor(worst(logit, doc, hi - lo).astype(np.float64) * FINER), np.nan))
        bins = np.concatenate(bins)
        some = np.isfinite(bins)
        return pa.record_batch([pa.array(bins[some].astype(np.int64)), batch.column(1).filter(pa.array(some))], names=["bin", "toxic"])

    found = arrow_map(known.select("text", "toxic"), run, "bin bigint, toxic int").groupBy("bin", "toxic").count().toPandas()
    if found["toxic"].nunique() < 2:
        return 0.0
    return threshold((found["bin"].to_numpy() + 0.5) / FINER, found["toxic"].to_numpy(), found["count"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[Network, float] | None:
    """The network and its threshold (a logit), or None without labels of both kinds; the bounds are of the first epochs' documents only."""
    known = labelled(docs, labels, key, text)
    held, learn = (known.where(f"__h % {HELD_OUT} {is_} 0") for is_ in ("=", "<>"))
    size = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    sample = _first(learn, *(max(1, n * (HELD_OUT - 1) // HELD_OUT) for n in (max_toxic, max_clean)))
    counts = word_counts(learn, sum(size.values()), size[1])
    net = fit(list(sample["text"]), sample["toxic"].to_numpy(), counts=counts)
    if len(sample) < counts.all_docs:
        net = train_on_all(net, learn, counts.all_docs)
    return net, held_out_threshold(net, held)


def _score(narrow: DataFrame, net: Network, limit: float) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = Texts(batch.column(1)), []
        for lo, hi in texts.slices(SLICE):
            logit, first, _, doc, of = net.score_documents(texts, lo, hi)
            score = worst(logit, doc, hi - lo)
            at = np.zeros(hi - lo, np.int64)
            top = np.flatnonzero(logit == score[doc])[::-1]
            at[doc[top]] = first[top] - of[doc[top]]
            n, bad = np.bincount(doc, minlength=hi - lo), np.bincount(doc[logit > limit], minlength=hi - lo)
            out.append((1 / (1 + np.exp(-np.clip(score.astype(np.float64), -500, 500))), score > limit, at, n, bad))
        columns = [np.concatenate(c) for c in zip(*out)]
        columns[0][columns[3] == 0] = 0
        return pa.record_batch([batch.column(0), *(pa.array(c) for c in columns)], names=["doc_id", "score", "toxic", "first_word", "n_windows", "n_toxic_windows"])

    return arrow_map(narrow, run, typed(narrow, doc_id="doc_id") + "score double, toxic boolean, first_word bigint, n_windows bigint, n_toxic_windows bigint")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """doc_id, score, toxic, first_word (of the worst window), n_windows, n_toxic_windows of each row."""
    narrow = docs.select(col(key).alias("doc_id"), F.lower(col(text)).alias("text"))
    trained = train(docs, labels, key, text, **bounds)
    if trained is None:
        zero = F.lit(0).cast("bigint")
        return narrow.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("toxic"), zero.alias("first_word"), zero.alias("n_windows"), zero.alias("n_toxic_windows"))
    return _score(narrow, *trained)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """docs without the rejected rows, in one pass: rows are filtered where they are scored."""
    trained = train(docs, labels, key, text, **bounds)
    if trained is None:
        return docs
    net, limit = trained

    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        texts, out = Texts(text), [np.zeros(0, bool)]
        for lo, hi in texts.slices(SLICE):
            logit, _, _, doc, _ = net.score_documents(texts, lo, hi)
            out.append(worst(logit, doc, hi - lo) > limit)
        return pa.array(np.concatenate(out))

    return docs.where(~toxic(F.lower(col(text))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected document with its score and worst window; all documents are scored."""
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("toxic").drop("toxic")
