"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their frequency. For each of the samples, a
word has r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from its hash alone; with weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The word of least a gives the
sample, and the pair (word, t) is its value: two documents' samples are equal with
the probability of their generalised Jaccard similarity, sum of min / sum of max.

Defined cases: a null text has a null signature, a text without words an empty one; of
words of equally least a the one of the smaller hash counts; repeated rows are signed
each; an empty table gives an empty result; columns other than the key and the text are
not read. Keys may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, typed
from lumenscribe.llm.kernels import Texts, mix

SAMPLES, TERMS = 64, 1 << 15
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def draws(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b, ln c for each term and sample."""
    u = []
    for k in range(5):
        salt = np.array([((j * 5 + k + 1) * _STEP) & (2**64 - 1) for j in range(samples)], U)
        u.append(((mix(terms[:, None] ^ salt) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return -np.log(u[0] * u[1]), u[2], np.log(-np.log(u[3] * u[4]))


def sign(terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, samples: int = SAMPLES, at_once: int = TERMS) -> np.ndarray:
    """Signatures of documents 0..doc[-1], given their distinct terms; doc is sorted and leaves none out."""
    out = np.zeros((doc[-1] + 1 if len(doc) else 0, samples), np.int64)
    words, place = np.unique(terms, return_inverse=True)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    least = np.full(out.shape, np.inf)
    column = np.arange(samples)
    # in pieces of terms, so a document of very many is signed as the best over its pieces
    for lo in range(0, len(words), at_once):
        r, b, lnc = draws(words[lo : lo + at_once], samples)
        mine = np.flatnonzero((place >= lo) & (place < lo + at_once)) if len(words) > at_once else np.arange(len(terms))
        for part in np.array_split(mine, len(mine) // 8192 + 1):
            if not len(part):
                continue
            at, d = place[part] - lo, doc[part]
            rr, bb = r[at], b[at]
            t = np.floor(np.log(counts[part])[:, None] / rr + bb)
            lna = lnc[at] - rr * (t - bb + 1)
            begin = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            best = np.minimum.reduceat(lna, begin, axis=0)
            length = np.diff(np.append(begin, len(d)))
            row, sample = np.nonzero(lna == np.repeat(best, length, axis=0))
            owner = np.repeat(np.arange(len(begin)), length)[row]
            pick = np.zeros((len(begin), samples), np.int64)
            pick[owner[::-1], sample[::-1]] = row[::-1]  # the first of equals
            own = d[begin]
            better = best < least[own]
            value = (mix(terms[part][pick] ^ mix(t[pick, column].astype(np.int64).view(U))) >> U(1)).astype(np.int64)
            least[own] = np.where(better, best, least[own])
            out[own] = np.where(better, value, out[own])
    assert len(first) == len(out)
    return out


def bags(texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each document, their counts, and the documents."""
    words = texts.words(lo, hi)
    doc = np.repeat(np.arange(hi - lo), words.counts)
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    if not len(h):
        return h, np.zeros(0, np.int64), d
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    return h[first], np.diff(np.append(first, len(h))), d[first]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, signature of each row. No shuffle."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        texts, size, body = Texts(column), np.zeros(len(column), np.int64), []
        for lo, hi in texts.slices():
            terms, counts, doc = bags(texts, lo, hi)
            have, dense = np.unique(doc, return_inverse=True)
            if len(have):
                body.append(sign(terms, counts, dense, samples).ravel())
                size[lo + have] = samples
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        null = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=null), pa.array(np.concatenate(body) if body else np.zeros(0, np.int64)))
        return pa.record_batch([batch.column(0), lists], names=["doc_id", "signature"])

    narrow = docs.select(col(key).alias("doc_id"), F.lower(col(text)).alias("text"))
    return arrow_map(narrow, run, typed(narrow, doc_id="doc_id") + "signature array<bigint>")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
