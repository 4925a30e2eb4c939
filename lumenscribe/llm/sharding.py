"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its key, so it never changes; only the map from
slots to shards does. Rebalancing edits the map as little as it can: shards above
their share give up whole slots, laid end to end, to the shards below it.

Defined cases: a null key hashes as the empty string; a null text weighs 0 bytes;
repeated rows have one slot; an empty table gives an empty result and the initial
map; input columns named slot or shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscribe.llm.common import col, hex_hash, put
from lumenscribe.session import run_dir

SLOTS, SHARDS = 4096, 64


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (hex_hash(key, 8) % slots).cast("int")


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """slot, bytes: one row for each slot that has records; partial sums combine on the map side."""
    return docs.groupBy(slot_of(col(key), slots).alias("slot")).agg(F.sum(F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint")).alias("bytes"))


def initial_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: equal ranges of slots."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), F.expr(f"cast(id * {shards} div {slots} as int)").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map for these bytes per slot and number of shards.

    A shard keeps its slots in order while their bytes stay within the mean; what
    is over moves to the shards below the mean, each slot to the one whose share
    of the missing bytes holds the slot's middle. Shards numbered past ``shards``
    are drained. All tables here have one row a slot or a shard.
    """
    sized = slot_map.join(sizes.select(F.col("slot").alias("__s"), "bytes"), F.col("slot") == F.col("__s"), "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    run = Window.partitionBy("shard").orderBy("slot")
    sized = sized.withColumn("upto", F.sum("bytes").over(run)).withColumn("all", F.sum("bytes").over(Window.partitionBy()))
    fits = (F.col("shard") < shards) & (F.col("upto") * shards <= F.col("all"))
    sized = sized.withColumn("moves", ~fits)
    loads = sized.groupBy("shard").agg(F.sum("bytes").alias("load"))
    total = sized.select(F.max("all").alias("all"))
    order = Window.partitionBy(F.lit(0)).orderBy("shard")
    needs = (
        sized.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left").crossJoin(F.broadcast(total))
        .select(F.col("shard").alias("to"), F.greatest(F.col("all") - F.coalesce("load", F.lit(0)) * shards, F.lit(0)).alias("gap"), "shard")
        .withColumn("until", F.sum("gap").over(order)).withColumn("since", F.col("until") - F.col("gap")).where("gap > 0").select("to", "since", "until")
    )
    over = sized.where("moves").withColumn("end", F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("shard", "slot"))).select(F.col("slot").alias("moved"), ((F.col("end") * 2 - F.col("bytes")) * shards).alias("middle2"))
    moved = over.join(F.broadcast(needs), (F.col("middle2") >= F.col("since") * 2) & (F.col("middle2") < F.col("until") * 2)).select("moved", "to")
    # a drained shard's slots that found no gap go round the shards that stay
    stay = F.when(F.col("shard") < shards, F.col("shard")).otherwise(F.col("slot") % shards)
    return sized.join(moved, F.col("slot") == F.col("moved"), "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", stay).cast("int").alias("shard"))


class SlotMaps:
    """Versions of a slot map as Parquet folders; a version counts once its _SUCCESS is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, slot_map: DataFrame, version: int) -> None:
        """Write a version; an existing one is never changed."""
        slot_map.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")

    def get(self, version: int) -> DataFrame:
        kind = "version int, slot int, shard int"
        return self.spark.read.schema(kind).parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        done = [p.getPath() for p in fs.listStatus(home) if fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))

    def latest(self) -> DataFrame:
        return self.get(self.versions()[-1])


def assign(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard. The map is broadcast: it has ``slots`` rows whatever the data."""
    pairs = F.broadcast(slot_map.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard")))
    return put(docs.join(pairs, slot_of(col(key), slots) == F.col("__slot"), "left"), slot=F.col("__slot"), shard=F.col("__shard")).drop("__slot", "__shard")


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """Aggregate bytes per slot, edit the stored map for them, assign by the edit.

    path is the folder of the map's versions: the latest is edited, and a new folder
    begins with the initial map. Without a path the map is this run's own.
    """
    spark = docs.sparkSession
    maps = SlotMaps(spark, path or run_dir(spark, "slot-map"))
    if not maps.versions():
        maps.commit(initial_map(spark, slots, shards), 1)
    now = maps.versions()[-1]
    maps.commit(rebalance(maps.get(now), slot_bytes(docs, slots=slots), shards), now + 1)
    return assign(docs, maps.latest(), slots=slots)


SQL = f"""
with docs as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {SLOTS})::int as slot
  from documents),
sizes as (select slot, sum(n_bytes)::bigint as bytes from docs group by slot),
sized as (
  select r.range::int as slot, (r.range * {SHARDS} // {SLOTS})::int as shard, coalesce(bytes, 0)::bigint as bytes
  from range({SLOTS}) r left join sizes on sizes.slot = r.range),
marked as (
  select *, (sum(bytes) over (partition by shard order by slot) * {SHARDS} <= sum(bytes) over ())::boolean as fits, sum(bytes) over () as whole
  from sized),
gaps as (
  select shard, greatest(max(whole) - sum(bytes) * {SHARDS}, 0)::bigint as gap from marked group by shard),
needs as (
  select shard, gap, sum(gap) over (order by shard)::bigint as until from gaps),
surplus as (
  select slot, (2 * sum(bytes) over (order by shard, slot) - bytes)::bigint * {SHARDS} as middle2 from marked where not fits),
moved as (
  select s.slot, n.shard from surplus s join needs n on n.gap > 0 and middle2 >= 2 * (n.until - n.gap) and middle2 < 2 * n.until),
slot_map as (
  select m.slot, coalesce(moved.shard, m.shard)::int as shard from marked m left join moved on moved.slot = m.slot)
select doc_id, docs.slot, slot_map.shard, n_bytes from docs join slot_map on slot_map.slot = docs.slot
"""


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document under the rebalanced map."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
