"""Endless sources as stateless micro-batches over the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenscribe.operators import generators, render


def endless_requests(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """idx 0, 1, 2 ... without an end, at a rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("idx"))


def text_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """text of new files' lines, as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("text"))


def random_texts(requests: DataFrame, seed: int, **how) -> DataFrame:
    """Random text for each request of a stream; a draw depends on idx alone, not on the batch."""
    return generators.from_random(requests, seed, **how)


def key_lines(batch: DataFrame, batch_id: int) -> DataFrame:
    """idx of lines that have none: the batch's number and the row's place in it.

    It is unique and the same when a batch runs again, but not a batch query's number.
    """
    return batch.withColumn("idx", F.lit(batch_id).cast("bigint") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40))


def start(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run a sink on every micro-batch; with a checkpoint folder a restart goes on where it was."""
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def render_stream(lines: DataFrame, params: render.Params, seed: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Samples of a stream of text, as Parquet; a batch that runs again replaces its own folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        keyed = batch if "idx" in batch.columns else key_lines(batch, batch_id)
        render.rendered(keyed, params, seed).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return start(lines, sink, checkpoint, **trigger)
