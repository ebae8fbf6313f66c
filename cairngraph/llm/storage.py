"""Where operators cut lineage: a folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Folders written since each call of ``concluded`` that is still open, innermost last; the first are the results'.
_MADE: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="cairngraph-"))
    return _OWN[0]


#: With the result in the shared folder, the shuffle files that led to it serve nothing more.  Plan texts are
#: kept by the driver for every job; one that holds a constant table would weigh megabytes each time.
WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "100000"}


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: a lost executor costs nothing made before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[-1].append(path)
    before = {name: spark.conf.get(name) for name in WHILE_STORING}
    try:
        for name, value in WHILE_STORING.items():
            spark.conf.set(name, value)
        df.write.options(**(options or {})).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def concluded(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``build`` returns, then delete all that was stored on the way to it."""
    _MADE.append([])
    try:
        result = build()
        inner = _MADE[-1]
        _MADE[-1] = _MADE[-2]  # the result belongs to who called
        try:
            return stored(result, name)
        finally:
            _MADE[-1] = inner
    finally:
        _remove(spark, _MADE.pop())


def clear(spark: SparkSession) -> None:
    """Delete every folder that results of this session still read from; those results can't be read any more."""
    _remove(spark, _MADE[0])
    _MADE[0].clear()


#: Rows and bytes of text that cross to Python at once.  The defaults (10000 rows, 64 MB or more) let a few
#: long documents outgrow an executor; texts are worked on in slices of about a megabyte anyway.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds to ``BATCH``; bounds already lower stay."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not str(now).lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
