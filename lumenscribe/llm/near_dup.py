"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's shingles (3 words) are hashed once; the hash picks one of 128 bins and
the bin keeps its minimum. An empty bin copies the bin that its own sequence of
hashed tries finds first, the same for all documents. Documents of one signature, such
as exact copies, are one text from here on, however many they are. Bands of 4 bins make
buckets; a bucket of n texts gives n - 1 candidate edges, all to its smallest id. Edges
are then verified by the share of equal bins, an estimate of the Jaccard similarity,
and connected by alternating large-star and small-star steps.

In a bucket of which an edge fails, members that other buckets haven't joined are
compared with each other, in blocks of bounded size, so what a bucket connects doesn't
depend on its smallest id. That takes time by the square of such a bucket's texts, spread
over as many tasks as there are pairs of blocks; nothing but edges comes out.

No step needs a group of any size in one task: minima of signatures, buckets and
neighbours are aggregated before the shuffle and joined back, where AQE splits hot keys.

Defined cases: a document without words, with a null text or a null id is never a
near-duplicate; one of fewer than 3 words is a single shingle; rows that repeat an id
are one document, as similar to another as the best of their rows, whatever their
order, and stay or go together; of a group the smallest id stays (keys that aren't
integers are compared by 64 bits of their hash); an empty table gives an empty result;
other columns are passed through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, id_of, keep_ids, small, with_keys
from lumenscribe.llm.kernels import Texts, mix
from lumenscribe.session import cut

SHINGLE, BINS, ROWS, THRESHOLD, BLOCK = 3, 128, 4, 0.5, 4096
_EMPTY = np.uint64(2**64 - 1)


def densify(mins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (at least one is full) by hashed tries."""
    bins = np.uint64(mins.shape[1])
    row, place = np.nonzero(mins == _EMPTY)
    full, out, attempt = mins != _EMPTY, mins.copy(), 0
    while len(row):
        attempt += 1
        donor = (mix(place.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt << 32)) % bins).astype(np.int64)
        found = full[row, donor]
        out[row[found], place[found]] = mins[row[found], donor[found]]
        row, place = row[~found], place[~found]
    return out


def signatures(texts: Texts, lo: int, hi: int, shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the documents have words, and the bins of those."""
    words = texts.words(lo, hi)
    at, doc = words.window_owner(shingle)
    hashes = words.windows(shingle)[at] if len(at) else np.zeros(0, np.uint64)
    for k in np.flatnonzero((words.counts > 0) & (words.counts < shingle)):
        whole = np.uint64(words.counts[k])
        for h in words.hashes[words.of[k] : words.of[k + 1]]:
            whole = mix(np.array([whole ^ h]))[0]
        hashes, doc = np.append(hashes, whole), np.append(doc, k)
    mins = np.full((hi - lo) * bins, _EMPTY)
    np.minimum.at(mins, doc * bins + (hashes >> np.uint64(40)).astype(np.int64) % bins, mix(hashes) >> np.uint64(1))
    have = np.flatnonzero(words.counts)
    return have, densify(mins.reshape(-1, bins)[have])


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 63-bit key for each band of each row."""
    bands = sig.reshape(len(sig), -1, rows)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
    for k in range(rows):
        key = mix(key ^ bands[:, :, k])
    return (key >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, key: str, text: str, shingle: int, bins: int, rows: int) -> DataFrame:
    """id, sig (16 bits a bin), bands of each document with words."""
    schema = pa.schema([("id", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, at, sig, bands = Texts(batch.column(1)), [], [], []
        for lo, hi in texts.slices():
            have, mins = signatures(texts, lo, hi, shingle, bins)
            at.append(have + lo)
            sig.append(mins.astype("<u2"))
            bands.append(band_keys(mins, rows))
        ids = batch.column(0).take(pa.array(np.concatenate(at)))
        n = len(ids)
        body = pa.py_buffer(np.ascontiguousarray(np.concatenate(sig)).tobytes())
        sigs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * bins).astype(np.int32)), body])
        per = bins // rows
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * per, pa.int32()), pa.array(np.concatenate(bands).ravel()))
        return pa.record_batch([ids, sigs, lists], schema=schema)

    narrow = docs.select(id_of(docs, key).alias("id"), F.lower(col(text)).alias("text")).where("id is not null and text is not null")
    return arrow_map(narrow, run, "id bigint, sig binary, bands array<bigint>")


def representatives(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of made with the smallest id of each signature; and id, rep of all rows: the smallest id of the same signature."""
    name = [F.xxhash64("sig").alias("k"), F.crc32("sig").alias("c")]
    same = small(made.groupBy(*name).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    told = made.select("*", *name).join(same, ["k", "c"], "left")
    heads = told.where("rep is null").union(told.where("rep = id").dropDuplicates(["id", "k", "c"])).select("id", "sig", "bands")
    return heads, told.select("id", F.coalesce("rep", "id").alias("rep")).distinct()


def stars(made: DataFrame) -> DataFrame:
    """band, hub, id, n: each row of a bucket of two or more, the bucket's smallest id and its rows."""
    rows = made.select(F.explode("bands").alias("band"), "id")
    return rows.join(rows.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "band").select("band", "hub", "id", "n")


def judged(edges: DataFrame, made: DataFrame, bins: int) -> DataFrame:
    """hub, id, similarity: the share of bins that the ends of each edge have in common, the best of their rows."""
    schema = pa.schema([("hub", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(n, bins) for k in (2, 3))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array((left == right).mean(axis=1))], schema=schema)

    one = made.select("id", "sig")
    pairs = edges.join(one.select(F.col("id").alias("hub"), F.col("sig").alias("a")), "hub").join(one.select("id", F.col("sig").alias("b")), "id")
    shares = arrow_map(pairs.select("hub", "id", "a", "b"), run, "hub bigint, id bigint, similarity double")
    return shares.groupBy("hub", "id").agg(F.max("similarity").alias("similarity"))


def _joins(ids: np.ndarray, sigs: np.ndarray, block: np.ndarray, group: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect what all pairs of the threshold connect beside the groups; of two blocks only pairs across."""
    _, label = np.unique(group, return_inverse=True)
    across, out = block[0] != block[-1], []
    later = np.searchsorted(block, block[0], "right") if across else 0
    for i in range(later if across else len(ids) - 1):
        rest = later if across else i + 1
        match = rest + np.flatnonzero((sigs[rest:] == sigs[i]).mean(axis=1) >= threshold)
        fresh = match[label[match] != label[i]]
        if len(fresh):
            joined, first = np.unique(label[fresh], return_index=True)
            out += [(min(x), max(x)) for x in ((int(ids[i]), int(ids[k])) for k in fresh[first])]
            label[np.isin(label, joined)] = label[i]
    return out


def bucket_edges(made: DataFrame, spokes: DataFrame, failed: DataFrame, joined: DataFrame, bins: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """hub, id: edges of the threshold inside buckets with a failed edge, between members that are not in one component of joined."""
    schema = pa.schema([("hub", pa.int64()), ("id", pa.int64())])
    open_ = spokes.where("n > 2").join(small(failed.select("hub", "id")), ["hub", "id"]).select("band").distinct()
    members = spokes.join(small(open_), "band", "left_semi").select("band", "id").distinct()
    members = members.join(joined, "id", "left").select("band", "id", F.coalesce("keep", "id").alias("group"))
    apart = members.groupBy("band").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("n")).where("a < b")
    # a bucket is cut into blocks by a hash of the id, and every two blocks meet in a group of their own
    blocks = F.floor((F.col("n") - 1) / block).cast("bigint")
    rows = cut(members.join(apart.select("band", blocks.alias("last")), "band").join(made.select("id", "sig"), "id"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    rows = rows.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "sig", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = pa.Table.from_batches(parts)
            sigs = np.frombuffer(b"".join(group.column(5).to_pylist()), "<u2").reshape(-1, bins)
            found = _joins(group.column(4).to_numpy(), sigs, group.column(3).to_numpy(), group.column(6).to_numpy(), threshold)
            return pa.record_batch([pa.array([e[k] for e in found], pa.int64()) for k in range(2)], schema=schema)

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            begin = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for lo, hi in zip(begin, np.append(begin[1:], batch.num_rows)):
                key = tuple(keys[:, lo])
                if key != at and held:
                    yield edges(held)
                    held = []
                at = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield edges(held)

    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "block", "id").mapInArrow(run, "hub bigint, id bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, keep: each node and the smallest id of its component, for all but that one.

    Alternates large-star and small-star until the edges stay the same; each round
    is written to the shared folder. A node's neighbours are never collected.
    """
    now = cut(edges.select("hub", "id").where("hub < id").distinct())
    state = None
    while True:
        both = now.select(F.col("hub").alias("u"), F.col("id").alias("v")).union(now.select(F.col("id").alias("u"), F.col("hub").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("hub"), F.col("v").alias("id")).where("hub < id").distinct()
        low = large.groupBy("id").agg(F.min("hub").alias("m"))
        other = large.join(low, "id").where("hub > m").select(F.col("m").alias("hub"), F.col("hub").alias("id"))
        now = cut(low.select(F.col("m").alias("hub"), "id").union(other).distinct())
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("hub", "id").cast("decimal(20,0)"))).first()
        if was == state:
            return now.select("id", F.col("hub").alias("keep"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, keep_id: each document that is a copy, and the one of its group that stays."""
    made, copies = representatives(cut(sketches(docs, key, text, shingle, bins, rows)))
    made, copies = cut(made), cut(copies)
    spokes = cut(stars(made))
    shares = cut(judged(spokes.select("hub", "id").where("hub < id").distinct(), made, bins))
    failed, edges = shares.where(F.col("similarity") < threshold), shares.where(F.col("similarity") >= threshold).select("hub", "id")
    # an id of several texts connects what each of them is a copy of
    reps = copies.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    several = reps.where("rep < other").select("id")
    edges = edges.union(copies.join(small(several), "id", "left_semi").where("rep < id").select(F.col("rep").alias("hub"), "id"))
    found = components(edges)
    if not failed.isEmpty():
        more = cut(bucket_edges(made, spokes, failed, found, bins, threshold))
        if not more.isEmpty():
            found = components(found.select(F.col("keep").alias("hub"), "id").union(more))
    kept = reps.join(found.select(F.col("id").alias("rep"), "keep"), "rep", "left").select("id", F.coalesce("keep", "rep").alias("keep")).where("keep < id")
    return with_keys(kept, docs, key, id="doc_id", keep="keep_id").select("doc_id", "keep_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the copies; a row with a null id or text stays."""
    return keep_ids(docs, near_duplicates(docs, key, text, **how), "left_anti", key)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with the document that stays for it."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
