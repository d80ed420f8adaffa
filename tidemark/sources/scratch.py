"""Tables written to the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset only a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage is cut and its rows stay as they were dealt.

    What is returned reads that folder, so its files stay until they are discarded or the folder is cleared.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.kept_at)
    p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
