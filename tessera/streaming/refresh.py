"""Refreshing an index from a stream of changed files.

While one micro-batch is worked on, all that arrives waits and becomes the next one: one
refresh runs and one waits, whatever the number of requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.trigrams import analyzed
from tessera.runtime import SharedFolder


def latest(changes: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last change of each file; of changes with equal numbers any one. Earlier ones are
    dropped map-side."""
    rest = [c for c in changes.columns if c not in (key, order)]
    return changes.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("_c")).select(key, f"_c.{order}", *[f"_c.{c}" for c in rest])


class PostingsLog:
    """Postings kept as a log of batches: each has its files' trigrams as they are now.

    A batch's folder is named by its number, so that a batch that is run again after a
    failure replaces itself. Of a file's rows those of its last batch count: they equal what
    a build of all files anew would hold.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = SharedFolder(spark, self.path)

    def append(self, changes: DataFrame, number: int) -> None:
        """``changes``: (path, seq, content); a null content means the file is gone."""
        now = latest(changes)
        rows = analyzed(now.withColumn("k", F.struct("path", "seq")), "k", "content")
        rows.select("k.path", "k.seq", "reason", "grams").write.mode("overwrite").parquet(f"{self.path}/batch-{number:012d}")

    def files(self) -> DataFrame | None:
        """(path, reason, grams) of each file's last change."""
        names = [n for n in self._folder.names() if n.startswith("batch-")]
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])
        w = W.partitionBy("path").orderBy(F.desc("seq"))
        return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("path", "reason", "grams")

    def postings(self) -> DataFrame | None:
        rows = self.files()
        return None if rows is None else rows.filter(F.col("reason").isNull()).select(F.explode("grams").alias("trigram"), "path")


def refresh_on(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Run ``work`` on each micro-batch of ``stream``: all there is, then stop, if ``once``;
    else for good, at most one batch per ``every``."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
