"""What the operators share: column handling, size-checked joins, worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, DateType, IntegralType, NumericType, StringType, TimestampType

from lumenscribe.session import run_dir, small_batches

#: Rows and bytes of a small side that may be broadcast; beyond either Spark's own join runs.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def put(df: DataFrame, **new: Column) -> DataFrame:
    """df with new columns at the end; same-named columns of df, in any case, go."""
    lower = {k.lower() for k in new}
    return df.select(*[col(c) for c in df.columns if c.lower() not in lower], *[v.alias(k) for k, v in new.items()])


def hex_hash(key: Column, digits: int) -> Column:
    """The first hex digits of md5(key) as a number; a null key hashes as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("bigint")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows and their bytes, counted here, are few enough."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, StringType | BinaryType):
            size += F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        elif not isinstance(f.dataType, NumericType | BooleanType | DateType | TimestampType):
            size += F.octet_length(F.to_json(F.struct(col(f.name)))) * 4
    n, total = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= limit_bytes else df


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join on the key alone; no other column can clash."""
    ids = small(ids.select(col(key).alias("__id")).where("__id is not null").distinct())
    return docs.join(ids, col(key) == F.col("__id"), how)


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column, for what Python makes of its values."""
    return to_arrow_type(df.schema[name].dataType)


def typed(df: DataFrame, **fields: str) -> str:
    """A schema's beginning, 'new type, ', with the types of df's columns."""
    return "".join(f"`{new}` {df.schema[old].dataType.simpleString()}, " for new, old in fields.items())


def id_of(docs: DataFrame, key: str) -> Column:
    """The key as a bigint: itself if it is an integer, else 64 bits of its hash; null stays null."""
    if isinstance(docs.select(col(key)).schema[0].dataType, IntegralType):
        return col(key).cast("bigint")
    return F.when(col(key).isNotNull(), F.xxhash64(col(key)))


def with_keys(df: DataFrame, docs: DataFrame, key: str, **names: str) -> DataFrame:
    """df whose columns of ``id_of`` are renamed as told and hold the keys themselves."""
    keys = docs.select(col(key).alias("__key")).where("__key is not null")
    kind = keys.schema[0].dataType
    for old, new in names.items():
        if isinstance(kind, IntegralType):
            df = df.withColumn(old, F.col(old).cast(kind)).withColumnRenamed(old, new)
        else:
            found = keys.groupBy(F.xxhash64("__key").alias("__id")).agg(F.first("__key").alias(new))
            df = df.join(found, F.col(old) == F.col("__id")).drop("__id", old)
    return df


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn on each Arrow batch; it may return None for no rows."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet, which is smaller than a checkpoint, and read again."""
    small_batches(df.sparkSession)
    df.write.parquet(out := run_dir(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(out)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over many tasks."""
    home = sys.modules.get("_lumenscribe_worker") or types.ModuleType("_lumenscribe_worker")
    sys.modules["_lumenscribe_worker"] = home
    return home.__dict__.setdefault("cache", {})
