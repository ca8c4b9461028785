"""Storing an intermediate table so that its lineage is cut and it survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names.

    Without one a local session (tests, notebooks) gets a temporary folder, any
    other a folder in its warehouse, which all executors share.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, set where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="corpusloom-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or folder)
    return sc.getCheckpointDir()
