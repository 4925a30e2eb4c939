"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Strings are sequences of words (lower case, no punctuation). A document is
contaminated by an item of n words if some stretch of it is within n // 4 word edits
of the item.

1. Seeds, losing none: k edits spoil at most q k of an item's n - q + 1 runs of q words
   (q = 3 wherever that leaves one, else 2 or 1). Only where so many runs of items of one
   length stand within n + k words do windows begin that can be close to an item.
2. CGK: a random walk over the words of an item, or of the item-sized window from each of
   those places, puts out the word it stands on and steps on or not by a random bit of
   that word. Edit distance becomes Hamming distance of the outputs.
3. Bit-sampling LSH: a key is two sampled places of a walk's outputs. A walk gives
   ``KEYS`` keys, and an item of n words takes as many walks as reach the target recall:
   the number is measured on n random words with n // 4 of them substituted, deleted or
   inserted, the worst of the three (``walks_for``). Equal keys make candidates. Where
   ``MAX_WALKS`` walks don't reach the target, and for items under ``MIN_LSH`` words, all
   places of step 1 are candidates.
4. Candidates with enough runs of their own item are verified by the exact least word
   edit distance between the item and any stretch of the window, widened by k words.

The work on a document doesn't grow with the number of items but by their matches. The
items are a benchmark, small beside the corpus; their index is broadcast and bounded by
``max_item_words`` (about 50 bytes a word): a larger benchmark is taken in several passes.

Defined cases: null or empty texts, and items without words, match nothing; an item of
1 to 3 words admits no edit and matches wherever its words stand in a row; a null id
takes no part as an item, and as a document it stays and is not reported; equal items
are reported each; of equally good stretches the one that ends first is reported; rows
that repeat an id are reported as one; an empty table on either side gives an empty
result; other columns are passed through unread. Keys may be of any type that groups.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, arrow_type, col, keep_ids, typed
from lumenscribe.llm.kernels import WORD_RE, Texts, Words, distinct, mix

EDIT_SHARE, MAX_ITEM_WORDS = 4, 1_000_000
STEPS, KEYS, MIN_LSH, MAX_WALKS, RECALL = 24, 10, 12, 96, 0.99
TRIALS, TRIAL_WALKS = 200, 40
SLICE = 2 << 20
U = np.uint64


def edits(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the least word edit distance of the item to a stretch of the text, and where the first such ends."""
    n, m = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    best, stop = n.copy(), np.zeros(len(n), np.int64)
    order = np.argsort(m, kind="stable")
    # pairs with texts of like length go on together
    for part in np.array_split(order, len(order) // 64 + 1):
        if not len(part):
            continue
        wide, long = int(n[part].max()), int(m[part].max())
        item, text = np.zeros((len(part), wide), U), np.zeros((len(part), long), U)
        for r, p in enumerate(part):
            item[r, : n[p]], text[r, : m[p]] = items[p], texts[p]
        at, rows = np.arange(wide + 1), np.arange(len(part))
        row = np.broadcast_to(at, (len(part), wide + 1))  # distances of the item's beginnings to stretches ending here
        for j in range(long):
            new = np.zeros_like(row)
            np.minimum(row[:, :-1] + (item != text[:, j, None]), row[:, 1:] + 1, out=new[:, 1:])
            row = np.minimum.accumulate(new - at, axis=1) + at
            now = row[rows, n[part]]
            better = part[(now < best[part]) & (j < m[part])]
            best[better], stop[better] = now[(now < best[part]) & (j < m[part])], j + 1
    return best, stop


def seed_rule(n: int) -> tuple[int, int]:
    """q and the runs of q words that a stretch within n // 4 edits of n words has at least."""
    k = n // EDIT_SHARE
    return next((q, n - q + 1 - k * q) for q in (3, 2, 1) if n >= q and n - q + 1 - k * q >= 1)


def _places(walk: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([7, walk])
    pairs = np.sort(np.stack([draw.choice(STEPS, 2, replace=False) for _ in range(KEYS)]), axis=1)
    return pairs[:, 0], pairs[:, 1]


#: The two sampled steps of each key of each walk.
PLACES = [_places(walk) for walk in range(MAX_WALKS)]


def cgk_keys(hashes: np.ndarray, start: np.ndarray, room: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys [key, window] of the walks that begin at start, and which stay within room words.

    hashes holds at least ``STEPS`` words after each start (of whatever document).
    """
    coins = mix(hashes ^ U((walk + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    at, outputs, stood = start.copy(), np.empty((STEPS, len(start)), U), np.empty((STEPS, len(start)), np.int16)
    for step in range(STEPS):
        outputs[step] = hashes[at]
        stood[step] = at - start
        at = at + ((coins[at] >> U(step)) & U(1)).astype(np.int64)
    a, b = PLACES[walk]
    name = (np.arange(KEYS, dtype=U) + U(walk * KEYS + 1))[:, None]
    return mix(outputs[a] * U(0xD1342543DE82EF95) + mix(outputs[b] + name)), stood[b] < room


@lru_cache(maxsize=None)
def walks_for(n: int, target: float = RECALL) -> int:
    """Walks that find n words with n // 4 random edits at the target recall; 0 if MAX_WALKS don't.

    Measured at lengths that are multiples of 4, beyond 64 of 16, and rounded up to the next.
    """
    if n < MIN_LSH:
        return 0
    grid = 4 if n <= 64 else 16
    if n % grid:
        return walks_for(n + -n % grid, target)
    draw, needed = np.random.default_rng([11, n]), 0
    for kind in ("substitute", "delete", "insert"):
        items = draw.integers(1, 2**63, (TRIALS, n), dtype=U)
        texts = draw.integers(1, 2**63, (TRIALS, 2 * n + STEPS), dtype=U)
        for item, text in zip(items, texts):
            spoilt = draw.permutation(n) < n // EDIT_SHARE
            whole = {"substitute": lambda: np.where(spoilt, text[:n], item), "delete": lambda: item[~spoilt], "insert": lambda: np.stack([text[:n], item], 1)[np.stack([spoilt, ~spoilt | True], 1)]}[kind]()
            text[: len(whole)] = whole
        long = np.concatenate([items, np.zeros((TRIALS, STEPS), U)], axis=1)
        hits = np.zeros(TRIALS)
        for walk in range(TRIAL_WALKS):
            one, own = cgk_keys(long.ravel(), np.arange(TRIALS) * long.shape[1], np.full(TRIALS, n), walk)
            two, _ = cgk_keys(texts.ravel(), np.arange(TRIALS) * texts.shape[1], np.full(TRIALS, n), walk)
            hits += ((one == two) & own).any(axis=0)
        missed = (1 - hits / TRIAL_WALKS)[:, None] ** np.arange(1, MAX_WALKS + 1)
        enough = np.flatnonzero(missed.mean(axis=0) <= 1 - target)
        if not len(enough):
            return 0
        needed = max(needed, int(enough[0]) + 1)
    return needed


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+n[0]-1, first[1] .. and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Table:
    """Sorted hashes, and the items that have each."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        pairs = np.unique(np.stack([hashes, items.astype(U)]), axis=1) if len(hashes) else np.zeros((2, 0), U)
        self.hashes, first = np.unique(pairs[0], return_index=True)
        self.items, self.first = pairs[1].astype(np.int64), np.append(first, pairs.shape[1]).astype(np.int64)
        # a filter in front of the search: most of a text's hashes are no item's
        bits = max(16, min(24, int(len(self.hashes)).bit_length() + 5))
        self.shift, self.front = U(64 - bits), np.zeros(1 << bits, bool)
        self.front[(self.hashes >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes and items, one row a match."""
        some = np.flatnonzero(self.front[(hashes >> self.shift).astype(np.int64)])
        if not len(some):
            return some, some
        place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        exact = self.hashes[place] == hashes[some]
        some, place = some[exact], place[exact]
        n = self.first[place + 1] - self.first[place]
        return np.repeat(some, n), self.items[_spread(self.first[place], n)]


class ItemIndex:
    """Items with their seeds and LSH keys."""

    def __init__(self, ids: list, texts: Texts, target: float = RECALL):
        words = texts.words(0, len(texts))
        have = np.flatnonzero(words.counts)
        self.ids = [ids[k] for k in have]
        self.items = [words.hashes[words.of[k] : words.of[k + 1]] for k in have]
        self.n = words.counts[have].astype(np.int64)
        self.slack = self.n // EDIT_SHARE
        rules = np.array([seed_rule(int(n)) for n in self.n]).reshape(-1, 2)
        self.q, self.least = rules[:, 0], rules[:, 1]
        self.seeds = {}
        for q in sorted(set(self.q.tolist())):
            at, doc = words.window_owner(q)
            own = self.q[np.searchsorted(have, doc)] == q
            self.seeds[q] = _Table(words.windows(q)[at[own]], np.searchsorted(have, doc[own]))
        self.walks_at = {int(n): walks_for(int(n), target) for n in np.unique(self.n)}
        self.walks = np.array([self.walks_at[int(n)] for n in self.n], np.int64)
        flat, start = np.append(words.hashes, np.zeros(STEPS, U)), words.of[have]
        self.keys = []
        for walk in range(int(self.walks.max(initial=0))):
            own = np.flatnonzero(self.walks > walk)
            keys, inside = cgk_keys(flat, start[own], self.n[own], walk)
            self.keys.append(_Table(keys[inside], np.broadcast_to(own, keys.shape)[inside]))

    def _candidates(self, words: Words, end: np.ndarray, open_: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Items and start words of windows with a key in common; open_: places by the walks they need, most first."""
        size = len(words.hashes)
        near = np.zeros(size + STEPS, bool)
        begins = distinct(np.concatenate([p for _, p in open_]))
        near[(begins[:, None] + np.arange(STEPS)).ravel()] = True
        region = np.flatnonzero(near)
        hashes = np.append(words.hashes, np.zeros(STEPS, U))[region]
        item, start = [], []
        for walk, table in enumerate(self.keys):
            mine = distinct(np.concatenate([np.zeros(0, np.int64), *(p for need, p in open_ if need > walk)]))
            for part in np.array_split(mine, len(mine) // 16_384 + 1):
                if len(part):
                    keys, inside = cgk_keys(hashes, np.searchsorted(region, part), end[part] - part, walk)
                    at, found = table.find(keys.ravel())
                    ok = inside.ravel()[at]
                    item.append(found[ok])
                    start.append(part[at[ok] % len(part)])
        return np.concatenate(item), np.concatenate(start)

    def find(self, words: Words) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (edits, end word in the document) of the best match."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        size = len(words.hashes)
        if not size or not self.items:
            return found
        end, wide = np.repeat(words.of[1:], words.counts), np.int64(size + 1)
        seeds, lengths = [], []
        for q, table in self.seeds.items():
            hashes = words.windows(q)
            hashes = hashes if len(hashes) else np.zeros(0, U)
            at, item = table.find(hashes)
            inside = at + q <= end[at]
            seeds.append(item[inside] * wide + at[inside])
            lengths.append(self.n[item[inside]] * wide + at[inside])
        seeds, by_length = distinct(np.concatenate(seeds)), distinct(np.concatenate(lengths))
        n, at = by_length // wide, by_length % wide
        if not len(n):
            return found
        # places from which a stretch can have the seeds that items of that length leave at least
        sizes, which = np.unique(n, return_inverse=True)
        q, least = np.array([seed_rule(int(s)) for s in sizes])[which].T
        k = n // EDIT_SHARE
        last = np.arange(len(n)) + least - 1
        ok = last < len(n)
        last = np.minimum(last, len(n) - 1)
        ok &= (n[last] == n) & (at[last] + q - at <= n + k) & (end[at[last]] == end[at])
        n, k, q, at, last = n[ok], k[ok], q[ok], at[ok], at[last[ok]]
        if not len(n):
            return found
        first = np.maximum(last + q - n - k, end[at] - np.repeat(words.counts, words.counts)[at])
        need, open_, item, start = np.array([self.walks_at[int(s)] for s in sizes])[which[ok]], [], [], []
        for walks in np.unique(need)[::-1]:
            step = np.zeros(size + 1, np.int32)
            np.add.at(step, first[need == walks], 1)
            np.add.at(step, at[need == walks] + 1, -1)
            open_.append((int(walks), np.flatnonzero(np.cumsum(step)[:-1])))
        if any(w for w, _ in open_):
            item, start = map(list, zip(self._candidates(words, end, [x for x in open_ if x[0]])))
        whole = np.flatnonzero(self.walks == 0)
        if len(whole):  # what the tables can't find: every seed is a candidate
            mine = seeds[np.isin(seeds // wide, whole)]
            item, start = [*item, mine // wide], [*start, mine % wide]
        pairs = distinct(np.concatenate(item) * wide + np.concatenate(start))
        self._verify(words, end, seeds, pairs // wide, pairs % wide, found)
        return found

    def _verify(self, words: Words, end: np.ndarray, seeds: np.ndarray, item: np.ndarray, start: np.ndarray, found: dict) -> None:
        wide, n, k = np.int64(len(words.hashes) + 1), self.n[item], self.slack[item]
        begin = end[start] - np.repeat(words.counts, words.counts)[start]
        # a window from a seed stands for those that hold the seed, one from a key for itself; both ways it is widened
        back = np.where(self.walks[item] == 0, n + k, k)
        lo, hi = np.maximum(begin, start - back), np.minimum(end[start], start + n + k)
        have = np.searchsorted(seeds, item * wide + hi) - np.searchsorted(seeds, item * wide + lo)
        ok = have >= self.least[item]
        item, lo, hi, doc = item[ok], lo[ok], hi[ok], np.searchsorted(words.of, start[ok], "right") - 1
        if not len(item):
            return
        # neighbouring windows are verified together
        fresh = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1]))
        edge = np.flatnonzero(fresh)
        last = np.append(edge[1:], len(item)) - 1
        best, stop = edits([self.items[i] for i in item[edge]], [words.hashes[a:b] for a, b in zip(lo[edge], hi[last])])
        for d, i, left, e, s in zip(doc[edge].tolist(), item[edge].tolist(), lo[edge].tolist(), best.tolist(), stop.tolist()):
            if e <= self.slack[i] and e < found.get((d, i), (e + 1, 0))[0]:
                found[d, i] = e, left + s - int(words.of[d])


def _matches(narrow: DataFrame, items: DataFrame, ids: list, texts: list[str]) -> DataFrame:
    index = ItemIndex(ids, Texts(pa.array(texts, pa.string())))
    shared, kind = narrow.sparkSession.sparkContext.broadcast(index), arrow_type(items, "i")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, index, out = Texts(batch.column(1)), shared.value, []
        for lo, hi in docs.slices(SLICE):
            out += [(lo + d, index.ids[item], best, end) for (d, item), (best, end) in index.find(docs.words(lo, hi)).items()]
        columns = [pa.array([o[k] for o in out], t) for k, t in ((1, kind), (2, pa.int32()), (3, pa.int64()))]
        return pa.record_batch([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), *columns], names=["doc_id", "item_id", "edits", "end_word"])

    return arrow_map(narrow, run, typed(narrow, doc_id="doc_id") + typed(items, item_id="i") + "edits int, end_word bigint")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, edits, end_word of the best match of each pair that matches. One pass over docs a round."""
    narrow = docs.select(col(key).alias("doc_id"), F.lower(col(text)).alias("text")).where("doc_id is not null and text is not null")
    items = items.select(col(item_key).alias("i"), F.lower(col(item_text)).alias("t")).where("i is not null and t is not null")
    rounds, ids, texts, n = [], [], [], 0
    # a benchmark is read to the driver in order, one round's index at a time
    for row in items.orderBy("i", "t").toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        n += row["t"].count(" ") + 1
        if n >= max_item_words:
            rounds.append((ids, texts))
            ids, texts, n = [], [], 0
    rounds.append((ids, texts))
    out = None
    for ids, texts in rounds:
        part = _matches(narrow, items, ids, texts)
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("edits", "end_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.edits", "b.end_word")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the contaminated ones."""
    return keep_ids(docs, contaminated(docs, items, key, **how).select(F.col("doc_id").alias(key)), "left_anti", key)


#: Words become characters of an alphabet of the item's own words, so that edits of words are those of a string
#: (items of the benchmark have under 90 words). Starts and lengths are all those that have the seeds of step 1.
SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '{WORD_RE}') as w from documents where doc_id is not null and text is not null),
i as (
  select item_id, w, len(w) as n, len(w) // {EDIT_SHARE} as k, list_distinct(w) as u
  from (select item_id, regexp_extract_all(lower(text), '{WORD_RE}') as w from benchmark where item_id is not null and text is not null) where len(w) > 0),
item_grams as (select distinct item_id, n, k, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as gram from (select *, unnest(range(1, n - 1)) as p from i)),
doc_grams as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as gram from (select *, unnest(range(1, len(w) - 1)) as p from d)),
hits as (
  select doc_id, item_id, p, n, k, greatest(n - 2 - 3 * k, 1) as least, row_number() over (partition by doc_id, item_id order by p) as r
  from (select distinct doc_id, item_id, p, n, k from doc_grams join item_grams using (gram))),
spots as (
  select distinct a.doc_id, a.item_id, unnest(range(greatest(b.p + 3 - a.n - a.k, 1), a.p + 1)) as s
  from hits a join hits b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.r = a.r + a.least - 1 and b.p + 3 - a.p <= a.n + a.k),
short as (select doc_id, item_id, unnest(range(1, len(d.w) + 1)) as s from d, i where n - 2 - 3 * k < 1),
tries as (select * from spots union select * from short),
letters as (
  select t.doc_id, t.item_id, t.s, n, k,
         array_to_string(list_transform(i.w, lambda x: chr((33 + list_position(u, x))::int)), '') as a,
         array_to_string(list_transform(d.w[t.s : t.s + n + k - 1], lambda x: chr((33 + coalesce(list_position(u, x), 0))::int)), '') as b
  from tries t join d on d.doc_id = t.doc_id join i on i.item_id = t.item_id),
scored as (
  select doc_id, item_id, s + m - 1 as end_word, levenshtein(a, b[1:m]) as edits, k
  from (select *, unnest(range(n - k, least(n + k, len(b)) + 1)) as m from letters) where m > 0)
select doc_id, item_id, min(edits)::int as edits, min_by(end_word, edits * 1000000000 + end_word)::bigint as end_word
from scored where edits <= k group by doc_id, item_id
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with its items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
