"""Structured Streaming: insert-if-absent ingestion, access counters and sessions of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.sources.store import Store


def stream_json(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def drawers_of(rows: DataFrame) -> DataFrame:
    """Content-addressed rows of (wing, room, content, mined_at)."""
    return rows.where(F.trim("content") != "").withColumn("id", T.short_hash(F.col("content")))


def ingest_into(store: Store, name: str, rows: DataFrame, checkpoint: str, watermark: str = "1 day"):
    """A query that adds rows of new ids to a table: repeats within the watermark go early, others at the table."""
    fresh = drawers_of(rows).withWatermark("mined_at", watermark).dropDuplicatesWithinWatermark(["id"])

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["id"])
        store.append(name, new.join(store.read(name).select("id"), "id", "left_anti").select(*batch.columns) if store.exists(name) else new)

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uses by row and day of a stream of (id, ts)."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "id").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_accessed_at"))


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity by wing."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "wing").agg(F.count(F.lit(1)).alias("actions"))
