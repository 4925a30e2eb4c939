"""The relational front end: numbering, dedup, limit, routing, cycling, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscribe.functions.draws import below
from lumenscribe.functions.naming import BUCKET_SIZE, bucket
from lumenscribe.session import cut

#: Rows of a lookup side that may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, key: str, rows_per_task: int = 20_000) -> DataFrame:
    """Narrow rows over tasks for the work that follows, however few files and row groups they are read from.

    A task has rows_per_task rows, unless that makes more than four tasks a core: then up to ten times as many.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-n // rows_per_task), max(4 * cores, -(-n // (10 * rows_per_task))))), key)


def numbered(df: DataFrame, *order: str | Column, name: str = "idx", start: int = 0) -> DataFrame:
    """Rows numbered in a global order, without one task seeing them all.

    The rows are range-partitioned and sorted, and written, so that numbering reads
    what it counted; each partition then adds the number of rows before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__at")))
    sizes = placed.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # one row a partition
    return joined.select(*df.columns, (F.col("__before") + F.col("__at") + start).cast("bigint").alias(name))


def distinct_first(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Each value at its first place; values combine on the map side."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(value, *(F.col(f"first.{c}").alias(c) for c in order))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order: a top-n, no global sort."""
    return df.orderBy(*order).limit(n)


def cycled(requests: DataFrame, items: DataFrame, value: str, idx: str = "idx") -> DataFrame:
    """Each request with the item at its number modulo the items; items have pos 0 .. n-1."""
    n = items.count()
    if not n:
        raise ValueError("nothing to cycle through")
    side = lookup(items.select(F.col("pos").alias("__pos"), F.col(value)))
    return requests.join(side, F.pmod(F.col(idx), F.lit(n)) == F.col("__pos")).drop("__pos")


def routed(df: DataFrame, fonts: DataFrame, seed: int, base: str = "base", size: int = BUCKET_SIZE) -> DataFrame:
    """bucket, out_dir and a font drawn for each idx; fonts have pos and font."""
    n = fonts.count()
    drawn = df.withColumn("__font", below(seed, "font", F.col("idx"), n))
    out = drawn.join(lookup(fonts.select(F.col("pos").alias("__pos"), "font")), F.col("__font") == F.col("__pos")).drop("__pos", "__font")
    return out.withColumn("bucket", bucket(F.col("idx"), size)).withColumn("out_dir", F.concat_ws("/", F.lit(base), "bucket"))


def not_done(df: DataFrame, done: DataFrame) -> DataFrame:
    """Requests whose file (bucket, file_name) is not among the done ones."""
    return df.join(done.select("bucket", "file_name").distinct(), ["bucket", "file_name"], "left_anti")
