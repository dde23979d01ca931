"""Event-time operators. Each works on batch and streaming DataFrames alike unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("s.start").alias("start"), "last", "n")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """Streaming: events by id, once each within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rolling_mean(events: DataFrame, rows: int) -> DataFrame:
    """Batch: the mean of each user's last values."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1 - rows, 0)
    return events.withColumn("mean", F.avg("value").over(w))


def jumps(events: DataFrame, least: float) -> DataFrame:
    """Batch: places where a user's value leaves the one before by `least` or more."""
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("jump", F.abs(F.col("value") - before)).where(F.col("jump") >= least)


def merged(segments: DataFrame, gap: float) -> DataFrame:
    """Batch: segments (key, begin, end) merged where at most `gap` lies between them."""
    w = W.partitionBy("key").orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = segments.withColumn("new", F.when(reach.isNull() | (F.col("begin") - reach > gap), 1).otherwise(0))
    s = s.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def overlaps(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Batch: pairs of segments (key, id, begin, end) with the same key that overlap.

    Both sides are cut into slots of `width`; segments meet in equal slots, and
    only the first slot that they share reports them.
    """
    cut = lambda s: s.withColumn("slot", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    j = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.slot") == F.col("y.slot")))
    j = j.where((F.col("x.begin") < F.col("y.end")) & (F.col("y.begin") < F.col("x.end")) & (F.col("x.slot") == F.floor(F.greatest("x.begin", "y.begin") / width)))
    return j.select(F.col("x.key").alias("key"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.least("x.end", "y.end") - F.greatest("x.begin", "y.begin")).alias("shared"))


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """Batch: each row of left (key, ts, id) with the last value of right (key, ts, value) at or before it.

    Both sides are sorted together by key and time, once; no pairs are made.
    """
    both = left.select("key", "ts", "id", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")).unionByName(right.select("key", "ts", F.lit(None).cast("long").alias("id"), F.col("value").cast("double"), F.lit(0).alias("side")))
    w = W.partitionBy("key").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("side = 1").select("key", "ts", "id", "value")


def dwell(fixations: DataFrame, longest: float) -> DataFrame:
    """Batch: fixations (viewer, object_idx, ts, event_id) to object_idx, fixations, dwell and the longest one, in
    seconds to the viewer's next fixation, `longest` at most each."""
    nxt = F.lead("ts").over(W.partitionBy("viewer").orderBy("ts", "event_id"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    held = F.least(F.coalesce(seconds(nxt) - seconds(F.col("ts")), F.lit(0.0)), F.lit(float(longest)))
    return fixations.withColumn("held", held).groupBy("object_idx").agg(F.count("*").alias("fixations"), F.sum("held").alias("dwell"), F.max("held").alias("longest"))


def speech_lines(words: DataFrame, gap: float) -> DataFrame:
    """Batch: words (key, at, end, word) joined to lines (key, begin, end, text) where at most `gap` lies between them."""
    w = W.partitionBy("key").orderBy("at", "word")
    new = F.when(F.col("at") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    lines = words.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return lines.groupBy("key", "line").agg(F.min("at").alias("begin"), F.max("end").alias("end"), text.alias("text")).drop("line")


def votes(boundaries: DataFrame, least: int, gap: float) -> DataFrame:
    """Batch: boundaries (key, at, feature) that `least` features share within `gap`; close ones are merged to the first."""
    w = W.partitionBy("key").orderBy("at", "feature")
    new = F.when(F.col("at") - F.lag("at").over(w) <= gap, 0).otherwise(1)
    b = boundaries.withColumn("new", new).withColumn("group", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy("key", "group").agg(F.min("at").alias("at"), F.count_distinct("feature").alias("votes")).where(F.col("votes") >= least).drop("group")
