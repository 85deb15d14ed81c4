"""Streams: journals, progress throttling, windows over event time. Each has a batch twin with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOURNAL = "t string, ns long, op string, payload string"


def read_journal(spark, path: str, stream: bool = False) -> DataFrame:
    """Journal lines ``t, ns, op, payload``; blank and torn lines are left out."""
    lines = (spark.readStream if stream else spark.read).format("text").load(path)
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", JOURNAL, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return parsed.filter("ns is not null and op is not null")


def replay(journal: DataFrame, saved_ns: int = 0, key: str = "k") -> DataFrame:
    """State after the records later than ``saved_ns``: the last ``set_state`` and the ``patch`` records after it, by JSON field.

    ``payload`` is a flat JSON object; the result is ``field, value``.
    """
    late = journal.filter((F.col("ns") > saved_ns) & F.col("op").isin("set_state", "patch"))
    base = late.filter("op = 'set_state'").agg(F.coalesce(F.max("ns"), F.lit(saved_ns)).alias("base"))
    used = late.crossJoin(F.broadcast(base)).filter(F.col("ns") >= F.col("base"))
    fields = used.select("ns", F.explode(F.from_json("payload", "map<string,string>")).alias("field", "value"))
    return fields.groupBy("field").agg(F.max_by("value", "ns").alias("value"))


def append_journal(stream: DataFrame, path: str, checkpoint: str):
    """Write-ahead journal of a stream: committed files, one checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_state(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Last writer of each key; works on streams in complete mode too."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed(events: DataFrame, key: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Count, sum and greatest of tumbling or sliding windows; late rows are dropped beyond the watermark in a stream."""
    timed = event_time(events, column)
    if events.isStreaming:
        timed = timed.withWatermark(column, late)
    frame = F.window(column, length, slide) if slide else F.window(column, length)
    out = timed.groupBy(frame.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "greatest")


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Runs of events of a key that lie within the gap: autosave groups of edits."""
    timed = event_time(events, column)
    if events.isStreaming:
        timed = timed.withWatermark(column, late)
    out = timed.groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def throttled(events: DataFrame, key: str, every: float, column: str = "ts", order: list[str] | None = None, done: str | None = None) -> DataFrame:
    """First progress event of each key in every stretch of ``every`` seconds since the epoch, and those whose ``done`` share is 1 (batch)."""
    slot = F.floor(F.unix_micros(F.col(column).cast("timestamp")) / int(every * 1e6))
    w = Window.partitionBy(key, "__slot").orderBy(*(order or [column]))
    rows = events.withColumn("__slot", slot).withColumn("__r", F.row_number().over(w))
    test = F.col("__r") == 1
    return rows.filter(test if done is None else test | (F.col(done) >= 1)).drop("__slot", "__r")


def throttled_stream(events: DataFrame, key: str, every: str, value: str, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The same of a stream: the first value of each key and slot."""
    timed = event_time(events, column).withWatermark(column, late)
    return timed.groupBy(F.window(column, every).alias("w"), key).agg(F.min_by(value, column).alias(value)).select(F.col("w.start").alias("start"), key, value)


def push(stream: DataFrame, send, checkpoint: str):
    """Hand each micro-batch to ``send(rows)``; a batch is a progress update of bounded size, not a corpus."""
    return stream.writeStream.foreachBatch(lambda df, n: send(df.toLocalIterator())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
