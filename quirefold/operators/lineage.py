"""Cutting lineage where a relation is used more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset and Spark
    runs in this process alone (tests), one of our own is made; on a cluster without the setting this is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            import atexit
            import shutil
            import tempfile

            named = tempfile.mkdtemp(prefix="quirefold-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint()
