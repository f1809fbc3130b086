"""Ends of lineage in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where no such folder is set, one in the warehouse, which executors share, too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder, for tables that several later steps read."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def round_state(df: DataFrame) -> DataFrame:
    """settled(), without the constraints that the optimiser has inferred about df.

    A checkpoint keeps them, and in a loop they multiply from round to round. For the small tables that a loop carries.
    """
    kept = settled(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.toDF().javaRDD(), kept._jdf.schema()), df.sparkSession)


def scratch(spark: SparkSession) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
