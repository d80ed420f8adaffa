"""Shared helpers of the corpus operators: tables, scratch tables, column clashes."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch_root

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
"""Bytes of an Arrow batch; a longer row is a batch of its own."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 50_000
"""Rows of a few numbers, counted, that are broadcast at most."""


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES, and leaves it so.

    Rows of texts are of any length, and a batch is held by the executor and by its Python worker.
    """
    if int(spark.conf.get(BATCH, "64m").rstrip("bkmg") or 0) != BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_held: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting within a block; the last of blocks that overlap restores what was before the first."""
    with _lock:
        n, before = _held.get(key) or (0, spark.conf.get(key, None))
        _held[key] = (n + 1, before)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            n, before = _held.pop(key)
            if n > 1:
                _held[key] = (n - 1, before)
            elif before:
                spark.conf.set(key, before)
            else:
                spark.conf.unset(key)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks of one step only, and
    the step's shuffle files go as soon as the table is complete.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes kept tables that nothing reads any more: all that was made from them is kept itself."""
    for t in tables:
        path = getattr(t, "kept_at", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """keep, and the number of rows, seen while writing."""
    seen = Observation()
    out = keep(df.observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def meet(rows: DataFrame, stats: DataFrame, n_stats: int, key: str, total: int) -> DataFrame:
    """rows joined with stats by key. stats: a written table of n_stats rows, one for each key, with n, its number of rows.

    total: the number of all rows, or more. A small table of stats is broadcast. Of a larger one the keys with over
    a thousandth of all rows, under 1,000 keys, are broadcast, so a crowded key stays spread over as many tasks as
    before, and the rest meets by a shuffle.
    """
    if n_stats <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stats.drop("n")), key)
    most = max(1, total // 1000)
    crowded = F.broadcast(stats.filter(F.col("n") > most).drop("n"))
    rest = rows.join(crowded.select(key), key, "left_anti").join(stats.filter(F.col("n") <= most).drop("n"), key)
    return rows.join(crowded, key).unionByName(rest)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, to size buckets by."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def tasks_for(spark: SparkSession, n_bytes: int, per_task: int) -> int:
    """Number of pieces of about per_task bytes; at least two for each core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // per_task))
