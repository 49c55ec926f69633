"""What is computed once and kept."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lagloom.operators.pairing import TASKS

#: Rows of an Arrow batch while what is kept is computed: a row may hold a second of samples, and both sides hold a batch.
BATCH = 512


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it what is computed has Arrow batches of at most BATCH rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(df: DataFrame, *by: str) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names; where there is none, persisted.

    by: columns by which its rows are dealt, to TASKS for each core. What is kept may be few bytes in very many parts, and each part that is read costs a task.
    """
    sc = df.sparkSession.sparkContext
    df = df.repartition(TASKS * sc.defaultParallelism, *by) if by else df
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    if not sc.getCheckpointDir():
        return df.persist()
    with small_batches(df.sparkSession):
        return df.checkpoint()
