"""The change feed as a stream: micro-batches merged into a keyed state table.

Each batch reads the state of the batch before, drops the items that changed or
went, adds them as read again, and writes a new version under its batch number.
A batch that is run again writes the same version, so a failed batch neither
loses pending items nor applies them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliograph.operators.changes import dirty_items, snapshot


def _version(path: str, n: int) -> str:
    return f"{path}/version={n:010d}"


def latest_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the state (older than `before`), or None."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    done = [
        int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path)
        if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(_version(path, max(done))) if done else None


def follow_changes(changes: DataFrame, library, state_path: str, checkpoint: str, key: str = "item_id") -> StreamingQuery:
    """Start following a streaming change feed; `library()` gives the rows as they now are."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = latest_state(spark, state_path, before=n)
        fresh = library()
        new = fresh if before is None else snapshot(before, fresh, dirty_items(batch), key)
        new.write.mode("overwrite").parquet(_version(state_path, n))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(changes: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts of changes by day and type with late arrivals up to `late` after the event; batch or stream."""
    t = changes.where(F.col("event").isNotNull())
    if t.isStreaming:
        t = t.withWatermark("changed_at", late).dropDuplicatesWithinWatermark(["change_id"])
    else:
        t = t.dropDuplicates(["change_id"])
    return t.groupBy(F.window("changed_at", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.start").alias("day"), "type", "changes")
