"""Streaming queries: the events come in slices, in two runs with one checkpoint, and the query returns what was written."""

from pyspark.sql import functions as F

from tessel.operators.shared import fresh
from tessel.plans._registry import query, table
from tessel.streaming import curation

#: Slices that the events are dealt into by event_id; each is one micro-batch, and half of them come after a restart.
SLICES = 8


class Feed:
    """The events of a folder that fills up slice by slice, with ts as a timestamp."""

    def __init__(self, spark, sf_dir):
        self.spark, self.path = spark, fresh(spark, "feed")
        self.events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        ends = self.events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
        width = max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // SLICES))
        self.slice = F.floor((F.col("event_id") - F.lit(ends["low"] or 0)) / width)

    def fill(self, slices):
        for k in slices:
            self.events.where(self.slice == k).coalesce(1).write.parquet(f"{self.path}/slice={k}")

    def stream(self):
        return self.spark.readStream.schema(self.events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.path)

    def halves(self):
        """Fills in one half of the slices, then, when the first run has ended, the other."""
        for half in (range(SLICES // 2), range(SLICES // 2, SLICES)):
            self.fill(half)
            yield self.stream()


def drained(spark, sf_dir, plan, mode="append"):
    """Append mode writes Parquet; in complete mode the last batch's table stays."""
    path = fresh(spark, "stream")
    for events in Feed(spark, sf_dir).halves():
        stream = plan(events)
        if mode == "append":
            curation.drained(stream, f"{path}/out", f"{path}/state")
        else:
            curation.drained(stream, "", f"{path}/state", mode, lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT event_id, lower(event_type) AS event_type, CASE WHEN value < 20 THEN 'low_value' WHEN event_type = 'click' THEN 'excluded' END AS reject_reason FROM events")
def x01_streaming_curation(spark, sf_dir):
    reason = F.when(F.col("value") < 20, "low_value").when(F.col("event_type") == "click", "excluded")
    return drained(spark, sf_dir, lambda events: curation.curate(events, {"event_type": F.lower("event_type")}, reason).select("event_id", "event_type", "reject_reason"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 20) AS n, greatest(0, 3000 - count(*) FILTER (WHERE value >= 20)) AS missing, count(*) FILTER (WHERE value >= 20) >= 3000 AS complete FROM events GROUP BY 1")
def x02_running_counts(spark, sf_dir):
    return drained(spark, sf_dir, lambda events: curation.class_counts(curation.curate(events, {}, F.when(F.col("value") < 20, "low_value")), "event_type", 3000), "complete")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def x03_streaming_cap(spark, sf_dir):
    """The counts of a user's rows go on from batch to batch and through the restart."""
    return drained(spark, sf_dir, lambda events: curation.capped(events.select("user_id", "event_id"), "user_id", "event_id", 5))


@query("SELECT DISTINCT event_id FROM events")
def x04_exactly_once(spark, sf_dir):
    """Each event comes twice in its batch, and one in ten of the first half's once more after the restart."""

    def twice(events):
        again = events.select(F.explode(F.array("event_id", "event_id", F.col("event_id") - F.col("event_id") % 10)).alias("event_id"))
        return curation.once(again, "event_id")

    known = table(spark, sf_dir, "events").select("event_id")
    return drained(spark, sf_dir, twice).join(known, "event_id", "left_semi")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2")
def x05_tumbling_windows(spark, sf_dir):
    """In complete mode every window is there, whatever the watermark."""
    return drained(spark, sf_dir, lambda events: curation.windowed(events, "ts", "event_type", "value", "1 hour"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def x05_sessions(spark, sf_dir):
    found = drained(spark, sf_dir, lambda events: curation.sessions(events, "ts", "user_id", "6 hours"), "complete")
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 20")
def x06_incremental_quota(spark, sf_dir):
    """Each batch merges with the table of the one before; the last one's is the result."""
    path, last = fresh(spark, "quota"), 0
    columns = ["event_type", "event_id", "value"]
    for events in Feed(spark, sf_dir).halves():
        run = curation.merge_quota(events.select(*columns), f"{path}/out", "event_type", [F.desc("value"), "event_id"], 20, columns, f"{path}/state")
        run.awaitTermination()
        last = max([last, *(p["batchId"] for p in run.recentProgress if p["numInputRows"])])
    return spark.read.schema(events.select(*columns).schema).parquet(f"{path}/out/{last}")
