"""Queries that run a stream over the events, with timers on event time, until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.operators import jobs as J
from canticle.plans import query
from canticle.plans.jobs import JOBS, RANK, STATUS
from canticle.plans.views import micros, table
from canticle.storage import Scratch
from canticle.streaming import timers as T

AWAY, LIFE, LATE = 90_000_000_000, 604_800_000_000, 3_600_000_000
#: Neighbouring requests, or rooms and jobs with many rows each, that share a row of state.
REQUESTS, JOBS_TOGETHER = 512, 16


def event_stream(spark, sf: str) -> DataFrame:
    """The events as a stream of files: job, event_id, us, event_type, status and rank."""
    like = table(spark, sf, "events")
    # A pattern, so that the table may be one file as well as a folder of them.
    e = spark.readStream.schema(like.schema).parquet(f"{sf}/[e]vents.parquet")
    e = e.select(F.col("user_id").alias("job"), "event_id", micros("ts").alias("us"), "event_type", "value")
    return e.withColumn("status", F.expr(STATUS)).withColumn("rank", F.expr(RANK))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream tells until its input is read and its watermark has moved: a table a trigger, in the shared folder."""
    scratch = Scratch(stream.sparkSession, name)
    out = scratch.path("out")

    def told(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    q = stream.writeStream.foreachBatch(told).outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(f"{stream._jdf.schema().toDDL()}, trigger long").parquet(out)


END = f"watermark AS (SELECT max(us) - {LATE} AS us FROM jobs)"


@query("room_timers_stream", f"""WITH RECURSIVE {JOBS}, {END}, e AS (SELECT DISTINCT job AS room, us FROM jobs),
 l AS (SELECT *, lead(us) OVER (PARTITION BY room ORDER BY us) AS nx FROM e),
 n AS (SELECT room, us, min(CASE WHEN nx IS NULL OR nx - us > {AWAY} THEN us + {AWAY} END) OVER (PARTITION BY room ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lost FROM l),
 s AS (SELECT room, us, least(lost, us + {LIFE}) AS ends, us + {LIFE} <= lost AS old FROM n), t AS (SELECT s.*, e.us AS later FROM s ASOF LEFT JOIN e ON e.room = s.room AND e.us > s.ends),
 lives AS (SELECT * FROM t WHERE us = (SELECT min(us) FROM e WHERE e.room = t.room) UNION ALL SELECT t.* FROM lives JOIN t ON t.room = lives.room AND t.us = lives.later)
SELECT room, lives.us AS opened, ends, CASE WHEN old THEN 'closed' ELSE 'gone' END AS why FROM lives, watermark w WHERE later IS NOT NULL OR ends <= w.us""")
def room_timers_stream(spark, sf):
    """Every life of every room that has ended: its host away for 25 hours, or a week old; timers end those that are not heard of again."""
    host = event_stream(spark, sf).select(F.col("job").alias("room"), "event_id", "us")
    return drained(T.room_lives(host, AWAY, LIFE, "1 hour", JOBS_TOGETHER), "rooms").drop("trigger")


@query("rate_limit_stream", f"WITH {JOBS} SELECT job, event_id, row_number() OVER (PARTITION BY job, secs // 604800 ORDER BY us, event_id) <= 10 AS accepted FROM jobs")
def rate_limit_stream(spark, sf):
    """Ten messages a week of each key, counted as they come; a key that stays away for a week is forgotten."""
    return drained(T.span_limit(event_stream(spark, sf).select("job", "event_id", "us"), LIFE, 10, "1 hour", JOBS_TOGETHER), "limit").drop("trigger")


@query("replies_stream", f"""WITH {JOBS}, {END}, f AS (SELECT event_id // 2 AS request, us, event_id % 2 = 1 AS reply, event_id % 14 = 1 AS dropped FROM jobs), p AS (SELECT request, min(us) FILTER (NOT reply) AS asked, min(us) FILTER (reply AND NOT dropped) AS said FROM f GROUP BY request)
SELECT request, asked, said - asked AS took, CASE WHEN said IS NULL THEN 'lost' WHEN said - asked > 120000000 THEN 'late' ELSE 'answered' END AS outcome FROM p, watermark w WHERE asked IS NOT NULL AND (said >= asked OR (said IS NULL AND asked + 120000000 <= w.us))""")
def replies_stream(spark, sf):
    """Each even event asks and the next one replies, but for every seventh: replies in two minutes, late ones, and requests that a timer gives up."""
    e, i = event_stream(spark, sf), F.col("event_id")
    frames = e.where(i % 14 != 1).select(F.floor(i / 2).alias("request"), "event_id", "us", F.when(i % 2 == 0, "request").otherwise("reply").alias("kind"))
    return drained(T.replies(frames, 120_000_000, "1 hour", REQUESTS), "replies").drop("trigger")


@query("jobs_from_snapshot", f"WITH {JOBS} SELECT job, arg_max(status, [rank, us, event_id]) AS status, count(*) AS events FROM jobs GROUP BY job HAVING count(*) FILTER (WHERE event_id % 2 = 1) > 0")
def jobs_from_snapshot(spark, sf):
    """A snapshot of the jobs after every second event, then the others as a stream: jobs end where all events together put them."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), "event_id", micros("ts").alias("us"), "event_type", "value")
    e = e.withColumn("status", F.expr(STATUS)).withColumn("rank", F.expr(RANK)).where("event_id % 2 = 0")
    later = event_stream(spark, sf).where("event_id % 2 = 1").select("job", "rank", "us", "event_id", "status")
    told = drained(T.followed_jobs(later, J.snapshot(e), 10 * LIFE, "1 hour", JOBS_TOGETHER), "followed", "update")
    return told.groupBy("job").agg(F.max_by("status", "trigger").alias("status"), F.max_by("events", "trigger").alias("events"))
