"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Rows of texts that go to a Python worker at once, unless the session sets its own number.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Documents may be long: keep Arrow batches below Spark's 10 000 rows, in the worker's memory and the JVM's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without that setting; it then gets a temporary
    folder, which is removed at exit.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not set_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = getattr(sc, "_lumenscribe_dir", None)
        if set_dir is None:
            set_dir = tempfile.mkdtemp(prefix="lumenscribe-")
            sc._lumenscribe_dir = set_dir
            atexit.register(shutil.rmtree, set_dir, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_dir)
    return set_dir


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, size: int) -> list[pa.Array]:
    """Texts in order, in slices of about that many bytes; a longer text is a slice of its own."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(n) - n) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
