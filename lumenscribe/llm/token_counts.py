"""Token counts of a byte-level BPE without materialising a document's ids.

1. Distinct pre-tokens: every task counts in how many of its documents each occurs, in
   a table of bounded size that it gives out when full; sums by pre-token make the
   vocabulary.
2. The pieces of a pre-token are counted once in the whole job, in its vocabulary row,
   and the vocabulary is written to the shared folder.
3. Join to the documents' frequencies: pre-tokens of the most documents, as many as the
   bounds ``hot`` (entries) and ``HOT_BYTES`` admit by a histogram of the document counts,
   are broadcast, and a document's sum over them is taken where its frequencies arise. Its
   other pre-tokens are joined by a shuffle and summed by row. Documents share the hot
   ones, so no join key is skewed.

Texts are split twice, as splitting again is cheaper than keeping frequencies.

Defined cases: a null text has null counts; an empty one has none; special tokens'
strings are ordinary text; repeated rows are counted each; an empty table gives an
empty result; columns other than the key and the text are not read. Keys may be of any
type. The vocabulary file must be at the same path on every executor.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, stored, typed, worker_cache

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of byte-level BPE vocabularies of this size.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_ENTRIES, HOT, HOT_BYTES, BATCH_ROWS = 100_000, 400_000, 16 << 20, 50_000


def splitter(pattern: str):
    """All pre-tokens of a text; the pattern is compiled once a worker."""
    cache = worker_cache()
    if ("split", pattern) not in cache:
        import regex

        cache["split", pattern] = regex.compile(pattern).findall
    return cache["split", pattern]


def encoder(ranks: str, pattern: str):
    """The tokenizer, loaded once a worker."""
    cache = worker_cache()
    if (ranks, pattern) not in cache:
        import tiktoken

        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        cache[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    return cache[ranks, pattern]


def vocabulary(narrow: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, entries: int = TABLE_ENTRIES) -> DataFrame:
    """pretoken, docs, pieces: one row for each distinct pre-token of the column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = splitter(pattern), Counter()
        give = lambda: pa.record_batch([pa.array(list(table), pa.string()), pa.array(table.values(), pa.int64())], names=["pretoken", "docs"])
        for batch in batches:
            for text in batch.column(0):
                table.update(set(split(text.as_py())))
                if len(table) >= entries:
                    yield give()
                    table.clear()
        yield give()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(ranks, pattern)
        n = pa.array([len(encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
        return pa.record_batch([batch.column(0), batch.column(1), n], names=["pretoken", "docs", "pieces"])

    each = narrow.select("text").where("text is not null").mapInArrow(count, "pretoken string, docs bigint")
    return arrow_map(each.groupBy("pretoken").agg(F.sum("docs").alias("docs")), pieces, "pretoken string, docs bigint, pieces bigint")


def hot_bound(vocabulary: DataFrame, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> int:
    """The least number of documents such that pre-tokens of so many keep within the bounds."""
    step = F.floor(F.log2("docs") * 16).alias("step")  # some hundred steps whatever the data
    rows = vocabulary.groupBy(step).agg(F.min("docs").alias("least"), F.max("docs").alias("most"), F.count("*").alias("n"), F.sum(F.octet_length("pretoken").cast("bigint")).alias("size")).orderBy("step").collect()
    bound, n, size = rows[-1]["most"] + 1 if rows else 1, 0, 0
    for r in reversed(rows):
        n, size = n + r["n"], size + r["size"]
        if n > hot or size > hot_bytes:
            break
        bound = r["least"]
    return bound


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN, entries: int = TABLE_ENTRIES, hot: int = HOT) -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens of each row."""
    narrow = docs.select(col(text).alias("text"), col(key).alias("doc_id"))
    known = stored(vocabulary(narrow, ranks, pattern, entries), "vocabulary")
    bound = hot_bound(known, hot)
    common = {r["pretoken"]: r["pieces"] for r in known.where(F.col("docs") >= bound).select("pretoken", "pieces").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row for each document, and one for each of its pre-tokens that isn't hot
        split, pieces, task = splitter(pattern), shared.value, TaskContext.get().partitionId() << 40
        seen = 0
        for batch in batches:
            lo, n, out = 0, 0, [[] for _ in range(7)]
            for k, text in enumerate(batch.column(0)):
                text, rare, total = text.as_py(), [], 0
                freq = None if text is None else Counter(split(text))
                for t, f in (freq or {}).items():
                    if (p := pieces.get(t)) is None:
                        rare.append((t, f))
                    else:
                        total += f * p
                row = task + seen
                seen += 1
                for c, x in enumerate((row, k, None if freq is None else freq.total(), None if freq is None else len(freq), None if freq is None else total, None, None)):
                    out[c].append(x)
                for t, f in rare:
                    for c, x in enumerate((row, None, None, None, None, t, f)):
                        out[c].append(x)
                if len(out[0]) >= BATCH_ROWS:
                    yield pack(batch, out)
                    out = [[] for _ in range(7)]
            yield pack(batch, out)

    def pack(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
        ids = batch.column(1).take(pa.array(out[1], pa.int64()))
        return pa.record_batch([pa.array(out[0], pa.int64()), ids, *(pa.array(out[c], pa.int64()) for c in (2, 3, 4)), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64())], names=["row", "doc_id", "n_pretokens", "n_distinct", "hot", "pretoken", "freq"])

    parts = narrow.mapInArrow(rows, f"row bigint, {typed(narrow, doc_id='doc_id')}n_pretokens bigint, n_distinct bigint, hot bigint, pretoken string, freq bigint")
    # a document's own row joins nothing; its key only spreads it
    parts = parts.withColumn("__k", F.coalesce("pretoken", F.col("row").cast("string")))
    cold = known.where(F.col("docs") < bound).select(F.col("pretoken").alias("__p"), "pieces")
    joined = parts.join(cold, (F.col("__k") == F.col("__p")) & F.col("freq").isNotNull(), "left")
    own = F.when(F.col("freq").isNull(), F.struct("doc_id", "n_pretokens", "n_distinct", "hot"))
    summed = joined.groupBy("row").agg(F.first(own, ignorenulls=True).alias("d"), F.coalesce(F.sum(F.col("freq") * F.col("pieces")), F.lit(0)).alias("cold"))
    return summed.select("d.doc_id", "d.n_pretokens", "d.n_distinct", (F.col("d.hot") + F.col("cold")).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
