"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.lineage import removed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: White space that separates words: space and the ASCII controls from tab to return.
SPACES = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII texts take the cheap path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def tokens(c: Column, separators: str) -> Column:
    """The pieces between separators, without empty ones; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, one in the warehouse, which executors share, too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a reliable checkpoint; for small tables that later steps read several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Ends the lineage by a Parquet table in the shared folder: columns stay prunable and compressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of stored() that no later step reads."""
    files = df.inputFiles()
    if files:
        removed(df.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits_broadcast(df: DataFrame, bytes_each: Column, limit_mb: float) -> bool:
    """Whether all rows of a small table stay below the limit; one pass, one number back."""
    total = df.agg(F.coalesce(F.sum(bytes_each), F.lit(0)).alias("b")).first()["b"]
    return total <= limit_mb * 1e6


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have: the given ones, with underscores where they are taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
