"""Event streams of the audit log: sessions coalesced within a window, running counts; the same in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds within which an entry of the same article, action and source takes the place of the one before; the bound itself counts.
GAP = 300
SCHEMA = "id string, article_id string, ts timestamp, action string, from_status string, to_status string, details string, source string, loaded_at timestamp"


def coalesced(entries: DataFrame) -> DataFrame:
    """(article_id, action, source, started, ts, n, id, to_status): entries at most GAP seconds after the one before are one; the last one's values stay."""
    keys = ["article_id", "action", "source"]
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce(at - F.lag(at).over(w) > GAP * 1_000_000, F.lit(True))
    run = entries.where("ts is not null").distinct().withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("id", "to_status"), F.struct("ts", "id"))
    return run.groupBy(*keys, "_run").agg(F.min("ts").alias("started"), F.max("ts").alias("ts"), F.count("*").alias("n"), last.alias("m")).select(*keys, "started", "ts", "n", "m.id", "m.to_status")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The audit log's files as a stream, as many a trigger as come."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def coalesced_stream(entries: DataFrame, delay: str = "7 days") -> DataFrame:
    """coalesced over a stream: session windows, entries later than delay left out; a session comes out when the watermark has passed it."""
    session = F.session_window("ts", f"{GAP} seconds")
    keyed = entries.where("ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    out = keyed.groupBy(session.alias("s"), "article_id", "action", "source").agg(F.count("*").alias("n"), F.max(F.struct("ts", "id", "to_status")).alias("m"))
    return out.select("article_id", "action", "source", F.col("s.start").alias("started"), F.col("m.ts").alias("ts"), "n", "m.id", "m.to_status")


def running_counts(entries: DataFrame) -> DataFrame:
    """Entries by action, for complete mode."""
    return entries.groupBy("action").agg(F.count("*").alias("n"))


def changed(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, change): 'added', 'removed' or 'changed' rows of two manifests; equal ones have none."""
    o, n = old.select(*keys, F.col(digest).alias("_o")).distinct(), new.select(*keys, F.col(digest).alias("_n")).distinct()
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return o.join(n, keys, "full").withColumn("change", kind).where("change is not null").select(*keys, "change")
