"""Cut the lineage of iterative plans in a folder that every executor shares, and deal rows to tasks of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Bytes of input files for each task of a dealt step.
TASK_BYTES = 4 << 20


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="cairngraph-"))
        base = _OWN[0]
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame in the shared folder and read it back."""
    path = f"{shared(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """How many tasks the rows of a frame need, by the size of the files it reads; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(1, -(-sum(s for s in sizes if s < 1 << 60) // TASK_BYTES))  # frames of unknown size are no files


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Rows of equal keys together, in as many tasks as the input of ``like`` needs.

    A fixed number of shuffle partitions lets a task's memory grow with the input, and joining small partitions by
    their compressed size lets it grow further; grouping and windows by these keys need no other exchange.
    """
    return df.repartition(tasks(df if like is None else like), *keys)
