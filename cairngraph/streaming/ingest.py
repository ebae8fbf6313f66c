"""Continuous ingest: micro-batches of triples folded into stored edges.

Sums, minima, unions and noisy-or are associative, so a batch fused on its own and
merged with what is stored gives what one batch over everything gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.sources.lineage import shared

FIELDS = "subject string, predicate string, object string, weight double, n_observations long, sources array<string>"


def fold(rows: DataFrame) -> DataFrame:
    """Partial edges to one for each key; applies to single observations and to folded rows alike."""
    return rows.groupBy("subject", "predicate", "object").agg(
        F.sum("weight").alias("weight"), F.sum("n_observations").alias("n_observations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")
    )


def observations(triples: DataFrame) -> DataFrame:
    return triples.where("subject <> object").select("subject", "predicate", "object", "weight", F.lit(1).cast("long").alias("n_observations"), F.array("source").alias("sources"))


class EdgeStore:
    """Folded edges in a shared folder, a part for each micro-batch; nothing is kept by the driver.

    A batch writes its own part, ``batch=<id>``; one whose part is whole is skipped when it comes again, so a stream
    that resumes from its checkpoint loses and repeats nothing.  Reading folds all whole parts.  ``compact`` folds what there is into
    one part, ``upto=<id>``, and deletes the parts it stands for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = (path or f"{shared(spark)}/edge-store-{uuid.uuid4().hex}").rstrip("/")

    def _files(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> tuple[int, dict[str, int]]:
        """(id up to which parts are folded, -1 for none; the whole parts to read and their ids)."""
        root, files = self._files()
        if not files.exists(root):
            return -1, {}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(root) if files.exists(path(s.getPath(), "_SUCCESS"))]
        ids = {n: int(n.split("=")[1]) for n in names}
        base = max((i for n, i in ids.items() if n.startswith("upto=")), default=-1)
        return base, {n: i for n, i in ids.items() if n == f"upto={base}" or (n.startswith("batch=") and i > base)}

    @property
    def last(self) -> int:
        """The last batch that is stored, -1 for none."""
        base, parts = self._parts()
        return max([base, *parts.values()])

    @property
    def edges(self) -> DataFrame:
        _, parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], FIELDS)
        return fold(self.spark.read.schema(FIELDS).parquet(*[f"{self.path}/{n}" for n in parts]))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        base, parts = self._parts()
        if batch_id > base and f"batch={batch_id}" not in parts:
            fold(observations(batch)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def compact(self) -> None:
        base, parts = self._parts()
        if len(parts) < 2:
            return
        self.edges.write.mode("overwrite").parquet(f"{self.path}/upto={max(parts.values())}")
        root, files = self._files()
        for name in parts:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name), True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Consume what the stream has now."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and time window, batch or stream; a stream drops what is later than the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
