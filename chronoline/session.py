"""Where iterations keep what they have computed so far."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of ``spark.checkpoint.dir``; sets a local one only where that is unset and Spark is local."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and drops its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, some: Column | None = None) -> tuple[DataFrame, int]:
    """``cut(df)`` and its number of rows, or of those for which ``some`` holds, without a further job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n") if some is None else F.count_if(some).alias("n")))
    return out, seen.get["n"]
