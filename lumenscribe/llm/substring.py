"""Substring dedup: passages of 50 words or more that other documents have too.

A window is 50 words; its anchor is the smallest hash of its 26 runs of 25 words, so
equal windows have equal anchors, and neighbouring windows mostly share one.

1. Every run of windows of one anchor is written as a narrow row (anchor, document,
   place), a 20th of the text's size.
2. Count-min sketch of the anchors, with two rows of counts up to 2, in blocks; tasks'
   partial sketches hold only the cells they touch and are merged block by block. The
   sketch is a table of one row a block, sized by the number of runs, about 16 cells a run
   and row at any size; it is neither broadcast nor collected. Runs are joined to their
   block. The sketch never underestimates, so what it holds for single is single.
3. Only windows of the runs that are left are hashed (64 bits), where their texts are
   joined to them, and grouped exactly under their anchor: those in two documents or more
   are repeated. Anchors of up to ``HOT`` runs are sorted, and told apart in one task; those
   of more, as of boilerplate, are reduced to the least and the largest document of each
   window before the shuffle, and joined to what is repeated.
4. Runs of repeated windows become spans of words.

Defined cases: null and short texts have no windows; a null id takes no part; rows
that repeat an id, with the same text or others, are one document, so they don't repeat
each other, and their spans are united; an empty table gives an empty result; columns
other than the key and the text are not read. Keys that aren't integers are told apart
by 64 bits of hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, id_of, small, stored, with_keys
from lumenscribe.llm.kernels import WORD_RE, Texts, Words, mix, sliding_min

WINDOW, RUN = 50, 25
CELLS_PER_RUN, FLUSH, MOST_BLOCKS_TOGETHER, HOT = 16, 1 << 19, 512, 20_000
#: Cells of a row of a block; 16 bits of the anchor choose one.
BLOCK = 1 << 16
U = np.uint64


def anchors(words: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words, documents and anchors of all windows."""
    at, doc = words.window_owner(window)
    return at, doc, mix(sliding_min(words.windows(run), window - run + 1)[at]) if len(at) else np.zeros(0, U)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    change = np.zeros(len(keys[0]), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def anchor_runs(narrow: DataFrame) -> DataFrame:
    """anchor, id, h (of the text), start, n: n windows from word start on have the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(2))
            for lo, hi in texts.slices():
                words = texts.words(lo, hi)
                at, doc, anchor = anchors(words)
                if len(at):
                    first = _runs(anchor, doc)
                    n, owner = np.diff(np.append(first, len(at))), doc[first]
                    rows = pa.array(owner + lo)
                    yield pa.record_batch([pa.array(anchor[first].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at[first] - words.of[owner]).astype(np.int64)), pa.array(n.astype(np.int32))], names=["anchor", "id", "h", "start", "n"])

    return narrow.mapInArrow(find, "anchor bigint, id bigint, h bigint, start bigint, n int")


def blocks_for(n_runs: int) -> int:
    return max(1, -(-n_runs * CELLS_PER_RUN // BLOCK))


def merged_sketch(runs: DataFrame, n_blocks: int, flush: int = FLUSH) -> DataFrame:
    """block, row0, row1: bits, in longs, of the cells counted at least twice; a block without any is left out."""
    together = max(1, min(MOST_BLOCKS_TOGETHER, n_blocks // 4096))  # blocks that travel as one row
    span = together * 2 * BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(U))
            n += len(held[-1])
            if n >= flush:
                yield give(np.concatenate(held))
                held, n = [], 0
        if n:
            yield give(np.concatenate(held))

    def give(anchor: np.ndarray) -> pa.RecordBatch:
        block = ((anchor >> U(32)) % U(n_blocks)).astype(np.int64)
        place = [(block * 2 + row) * BLOCK + ((anchor >> U(16 * row)) & U(BLOCK - 1)).astype(np.int64) for row in range(2)]
        place = np.sort(np.concatenate(place))
        first = _runs(place)
        place, twice = place[first], np.diff(np.append(first, len(place))) > 1
        begin = _runs(place // span)
        parts = []
        for lo, hi in zip(begin, np.append(begin[1:], len(place))):
            # steps from cell to cell, twice the step plus 1 if it is counted twice
            step = np.diff(place[lo:hi] % span, prepend=0) * 2 + twice[lo:hi]
            parts.append(zlib.compress(step.astype("<u4").tobytes(), 1))
        return pa.record_batch([pa.array(place[begin] // span), pa.array(parts, pa.binary())], names=["group", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(span, np.uint8)
        for batch in batches:
            for group, part in zip(*(c.to_pylist() for c in batch.columns)):
                if group != at:
                    if at is not None:
                        yield bits(at, total)
                    at, total = group, np.zeros(span, np.uint8)
                step = np.frombuffer(zlib.decompress(part), "<u4").astype(np.int64)
                place = np.cumsum(step >> 1)
                total[place] = np.minimum(total[place] + 1 + (step & 1).astype(np.uint8), 2)
        if at is not None:
            yield bits(at, total)

    def bits(group: int, total: np.ndarray) -> pa.RecordBatch:
        rows = np.packbits((total > 1).reshape(together, 2, BLOCK), axis=2, bitorder="little").view("<i8")
        some = np.flatnonzero(rows.any(axis=(1, 2)))
        ends = pa.array(np.arange(len(some) + 1) * (BLOCK // 64), pa.int32())
        longs = [pa.ListArray.from_arrays(ends, pa.array(rows[some, r].ravel())) for r in range(2)]
        return pa.record_batch([pa.array(group * together + some), *longs], names=["block", "row0", "row1"])

    parts = runs.select("anchor").mapInArrow(count, "group bigint, part binary")
    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(merge, "block bigint, row0 array<bigint>, row1 array<bigint>")


def estimated_repeated(runs: DataFrame, sketch: DataFrame, n_blocks: int) -> DataFrame:
    """The runs whose anchor the sketch counts twice in both rows."""
    probes = runs.withColumn("block", F.expr(f"shiftrightunsigned(anchor, 32) % {n_blocks}"))
    test = " and ".join(f"getbit(get(row{r}, cast(shiftrightunsigned(anchor, {16 * r + 6}) & 1023 as int)), cast(shiftrightunsigned(anchor, {16 * r}) & 63 as int)) = 1" for r in range(2))
    return probes.join(sketch, "block").where(test).select("anchor", "id", "h", "start", "n")


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+n[0]-1, first[1] .. and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def candidate_windows(narrow: DataFrame, runs: DataFrame) -> DataFrame:
    """anchor, id, start, hashes (8 bytes each) of the windows of the runs, whose texts are joined to them."""
    own = runs.groupBy("id", "h").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))  # as many as a text has

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = Texts(batch.column(1)), batch.column(2)
            ends, fields = np.asarray(lists.offsets), lists.values.flatten() if isinstance(lists.values, pa.StructArray) else None
            start, n, anchor = (f.to_numpy() for f in fields)
            for lo, hi in texts.slices():
                words = texts.words(lo, hi)
                pick = slice(int(ends[lo]), int(ends[hi]))
                owner = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                s, m = start[pick], n[pick].astype(np.int64)
                if not len(s):
                    continue
                whole = words.windows(WINDOW)[_expand(words.of[owner] + s, m)].astype("<u8")
                offsets = np.append(0, np.cumsum(m) * 8).astype(np.int32)
                hashes = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
                yield pa.record_batch([pa.array(anchor[pick]), batch.column(0).take(pa.array(owner + lo)), pa.array(s), hashes], names=["anchor", "id", "start", "hashes"])

    return narrow.join(own, ["id", "h"]).select("id", "text", "runs").mapInArrow(find, "anchor bigint, id bigint, start bigint, hashes binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, hash, id and place of each window."""
    raw = batch.column(3)
    ends = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset)
    n = np.diff(ends) // 8
    hashes = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8")
    anchor, doc, start = (np.repeat(batch.column(k).to_numpy(), n) for k in range(3))
    return anchor, hashes, doc, start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)


def _verdicts(anchor: np.ndarray, hashes: np.ndarray, doc: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Of each window, whether two documents have it; sure: it is already known to be."""
    order = np.lexsort((hashes, anchor))
    a, h = anchor[order], hashes[order]
    first = _runs(a, h)
    group = np.zeros(len(order), np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    d = doc[order]
    twice = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)) | np.maximum.reduceat(sure[order], first)
    out = np.zeros(len(order), bool)
    out[order] = twice[group]
    return out


def exact_runs(candidates: DataFrame) -> DataFrame:
    """id, first, last: runs of start words of windows that two documents or more have.

    Rows come sorted by anchor. What of the last anchor of a batch is not settled is
    carried on: of a window at most one document's places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = none
        for batch in batches:
            flat = _flat(batch)
            anchor, hashes, doc, place, sure = (np.concatenate(x) for x in zip(held, (*flat, np.zeros(len(flat[0]), bool))))
            twice = _verdicts(anchor, hashes, doc, sure)
            open_ = anchor == anchor[-1]
            keep = open_ & ~twice
            known = np.flatnonzero(open_ & twice)
            known = known[np.unique(hashes[known], return_index=True)[1]]
            keep[known] = True
            held = tuple(x[keep] for x in (anchor, hashes, doc, place)) + (twice[keep],)
            shown = np.flatnonzero(twice & (place >= 0))
            held[3][held[4]] = -1  # a mark that its hash is settled, not a place
            if len(shown):
                d, p = doc[shown], place[shown]
                first = _runs(d, p - np.arange(len(p)))
                last = np.append(first[1:], len(p)) - 1
                yield pa.record_batch([pa.array(d[first]), pa.array(p[first]), pa.array(p[last])], names=["id", "first", "last"])

    return candidates.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "id bigint, first bigint, last bigint")


def hot_windows(candidates: DataFrame) -> DataFrame:
    """id, first, last (equal) of windows that two documents or more have, for anchors of any number of runs."""

    def bounds(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, hashes, doc, _ = _flat(batch)
        order = np.lexsort((hashes, anchor))
        a, h, d = anchor[order], hashes[order], doc[order]
        first = _runs(a, h)
        least, most = (f.reduceat(d, first) for f in (np.minimum, np.maximum))
        return pa.record_batch([pa.array(a[first]), pa.array(h[first].view(np.int64)), pa.array(least), pa.array(most)], names=["anchor", "hash", "least", "most"])

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, hashes, doc, place = _flat(batch)
        return pa.record_batch([pa.array(anchor), pa.array(hashes.view(np.int64)), pa.array(doc), pa.array(place)], names=["anchor", "hash", "id", "first"])

    ranges = arrow_map(candidates, bounds, "anchor bigint, hash bigint, least bigint, most bigint")
    again = ranges.groupBy("anchor", "hash").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("anchor", "hash")
    all_ = arrow_map(candidates, places, "anchor bigint, hash bigint, id bigint, first bigint")
    return all_.join(small(stored(again, "repeated")), ["anchor", "hash"], "left_semi").select("id", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, first_word, end_word (exclusive): the longest spans made of repeated windows."""
    narrow = docs.select(id_of(docs, key).alias("id"), F.lower(col(text)).alias("text")).where("id is not null and text is not null")
    narrow = narrow.select("id", F.xxhash64("text").alias("h"), "text")
    runs = stored(anchor_runs(narrow), "runs")
    n_blocks = blocks_for(runs.count())
    left = stored(estimated_repeated(runs, merged_sketch(runs, n_blocks), n_blocks), "candidates")
    crowded = stored(left.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
    if crowded.isEmpty():
        hits = exact_runs(candidate_windows(narrow, left))
    else:
        hits = exact_runs(candidate_windows(narrow, left.join(small(crowded), "anchor", "left_anti")))
        hits = hits.union(hot_windows(stored(candidate_windows(narrow, left.join(small(crowded), "anchor", "left_semi")), "hot-windows")))
    order = Window.partitionBy("id").orderBy("first", "last")
    hits = hits.distinct().withColumn("before", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("span", F.sum(F.when(F.col("first") <= F.col("before") + WINDOW, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy("id", "span").agg(F.min("first").alias("first_word"), (F.max("last") + WINDOW).alias("end_word"))
    return with_keys(spans, docs, key, id="doc_id").select("doc_id", "first_word", "end_word")


SQL = f"""
with texts as (select distinct doc_id, regexp_extract_all(lower(text), '{WORD_RE}') as w from documents where doc_id is not null and text is not null),
windows as (
  select doc_id, i - 1 as pos, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) as body
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from texts)),
again as (select body from windows group by body having min(doc_id) < max(doc_id)),
hits as (select distinct doc_id, pos from windows join again using (body)),
marked as (select *, lag(pos) over (partition by doc_id order by pos) as before from hits),
spans as (select *, sum(case when pos <= before + {WINDOW} then 0 else 1 end) over (partition by doc_id order by pos rows unbounded preceding) as span from marked)
select doc_id, min(pos)::bigint as first_word, (max(pos) + {WINDOW})::bigint as end_word from spans group by doc_id, span
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
