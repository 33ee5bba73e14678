"""Session helpers: cutting the lineage of loops in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints/gridloom"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a local folder if all runs on this machine, as in tests; on a cluster there must be one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` into a reliable checkpoint, so that a loop's plan stays short and a lost executor costs no loop."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
