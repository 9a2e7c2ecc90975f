"""Streams with timers and initial state: what they tell, when, and what state they keep."""

import json

import pytest
from pyspark.sql import functions as F

from canticle.operators import jobs as J
from canticle.plans.jobs import jobs
from canticle.streaming import timers as T
from tests.conftest import DATA

HOUR = 3_600_000_000
#: Where the clock of hand-made rows begins; a watermark starts at 0, and what is not after it is late.
ZERO = 400_000 * HOUR


def triggers(spark, path, parts, schema):
    """A stream of one file a trigger."""
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("us", F.col("us") + ZERO).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    assert q.awaitTermination(180) and q.exception() is None
    clock = lambda v: v - ZERO if isinstance(v, int) and v >= ZERO - HOUR else v
    return q, sorted(tuple(map(clock, r)) for r in stream.sparkSession.table(name).collect())


def kept(spark, tmp_path, name):
    """The keys that a stream's state holds after it has stopped."""
    return sorted(r[0] for r in spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / f"cp-{name}")).select("key.*").collect())


def test_rooms_end_without_further_input(spark, tmp_path):
    """Room 1 falls silent, room 2 comes back too late and opens anew, room 3 grows old; only room 9 is left in the state."""
    first = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (1, 4, HOUR // 2)]
    second = [(3, 5, HOUR), (2, 6, 3 * HOUR), (3, 7, 2 * HOUR), (3, 8, 3 * HOUR), (3, 9, 4 * HOUR)]
    third = [(9, 10, 40 * HOUR)]
    s = triggers(spark, str(tmp_path / "in"), (first, second, third), "room long, event_id long, us long")
    _, got = run(T.room_lives(s, HOUR, 4 * HOUR, "1 minute"), tmp_path, "lives", "append")
    assert got == [(1, 0, HOUR // 2 + HOUR, "gone"), (2, 0, HOUR, "gone"), (2, 3 * HOUR, 4 * HOUR, "gone"), (3, 0, 4 * HOUR, "closed")]
    assert kept(spark, tmp_path, "lives") == [9]


def test_room_stream_begins_as_its_batch_query_says(spark, tmp_path):
    host = jobs(spark, DATA).select(F.col("job").alias("room"), "event_id", "us")
    end = host.agg(F.max("us")).first()[0]
    rows = [(*r[:2], r[2] - ZERO) for r in host.collect()] + [(-1, -1, end - ZERO + 1000 * HOUR)]
    s = triggers(spark, str(tmp_path / "in"), (rows,), "room long, event_id long, us long")
    _, got = run(T.room_lives(s, 25 * HOUR, 168 * HOUR, "1 minute"), tmp_path, "all_rooms", "append")
    first = {}
    for room, _, ends, _ in got:
        first[room] = min(first.get(room, ends), ends)
    want = {r["room"]: r["ends"] for r in J.room_ends(host.select("room", (F.col("us") - ZERO).alias("at")), 25 * HOUR, 168 * HOUR).collect()}
    assert first == want and kept(spark, tmp_path, "all_rooms") == [-1]


def test_a_key_that_stays_away_is_forgotten(spark, tmp_path):
    first = [(1, k, k) for k in range(4)] + [(2, 9, 5)]
    later = [(1, 10, HOUR - 1), (1, 11, HOUR), (3, 12, 9 * HOUR)]
    s = triggers(spark, str(tmp_path / "in"), (first, later), "job long, event_id long, us long")
    _, got = run(T.span_limit(s, HOUR, 3, "1 minute"), tmp_path, "spans", "append")
    assert got == [(1, 0, True), (1, 1, True), (1, 2, True), (1, 3, False), (1, 10, False), (1, 11, True), (2, 9, True), (3, 12, True)]
    assert kept(spark, tmp_path, "spans") == [3]


def test_requests_without_a_reply_are_given_up(spark, tmp_path):
    minute = HOUR // 60
    first = [(1, 1, 0, "request"), (1, 2, minute, "reply"), (1, 3, 2 * minute, "reply"), (2, 4, 0, "request"), (3, 5, 0, "request"), (4, 6, 0, "reply")]
    later = [(2, 7, 3 * minute, "reply"), (5, 8, 5 * HOUR, "request")]
    s = triggers(spark, str(tmp_path / "in"), (first, later), "request long, event_id long, us long, kind string")
    _, got = run(T.replies(s, 2 * minute, "1 hour"), tmp_path, "answers", "append")
    assert got == [(1, 0, minute, "answered"), (2, 0, 3 * minute, "late"), (3, 0, None, "lost")]
    assert kept(spark, tmp_path, "answers") == [5]


@pytest.mark.parametrize("cut", [3])
def test_jobs_follow_a_snapshot_through_a_restart(spark, tmp_path, cut):
    """Seeded, stopped after a trigger, started again: as the batch over all events; nothing of the snapshot is told."""
    e = jobs(spark, DATA).select("job", "rank", "us", "event_id", "status")
    seed = J.snapshot(e.where(f"event_id % {cut} = 0"))
    path, schema = str(tmp_path / "in"), "job long, rank int, us long, event_id long, status string"
    told = {}
    for part in (1, 2):
        e.where(f"event_id % {cut} = {part}").select("job", F.col("rank").cast("int").alias("rank"), "us", "event_id", "status").coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(schema).parquet(path)
        out = str(tmp_path / f"out-{part}")
        q = (
            T.followed_jobs(s, seed, 10_000 * HOUR, "2000 hours").writeStream.foreachBatch(lambda b, n, out=out: b.write.mode("append").parquet(out))
            .outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp-jobs")).start()
        )
        assert q.awaitTermination(180) and q.exception() is None
        rows = spark.read.parquet(out).collect()
        touched = {r["job"] for r in e.where(f"event_id % {cut} = {part}").select("job").distinct().collect()}
        assert {r["job"] for r in rows} == touched and len(rows) == len(touched)
        told |= {r["job"]: (r["status"], r["events"]) for r in rows}
    want = {r["job"]: (r["status"], r["events"]) for r in J.snapshot(e).collect()}
    assert told == {k: v for k, v in want.items() if k in told} and len(told) > 5


def test_done_jobs_leave_the_state(spark, tmp_path):
    schema = "job long, rank int, us long, event_id long, status string"
    seed = spark.createDataFrame([(1, 2, ZERO, 1, "completed", 7), (2, 0, ZERO, 2, "queued", 1)], f"{schema}, events long")
    s = triggers(spark, str(tmp_path / "in"), ([(3, 2, HOUR, 3, "failed"), (2, 1, HOUR, 4, "running")], [(4, 0, 90 * HOUR, 5, "queued")]), schema)
    _, got = run(T.followed_jobs(s, seed, 24 * HOUR, "1 minute"), tmp_path, "done", "update")
    assert got == [(2, "running", 2), (3, "failed", 1), (4, "queued", 1)]
    assert kept(spark, tmp_path, "done") == [2, 4]


def test_neighbouring_keys_share_state_and_calls(spark, tmp_path):
    """Runs of keys tell what single keys do; a run of 64 is one row of state, and goes with its last key."""
    minute = HOUR // 60
    first = [(k, 2 * k, k, "request") for k in range(-3, 200)] + [(k, 2 * k + 1, k + minute * (k % 5), "reply") for k in range(0, 200, 3)]
    later = [(150, 900, minute, "reply"), (151, 901, minute, "reply"), (500, 902, 5 * HOUR, "request"), (501, 903, 5 * HOUR, "request")]
    got = {}
    for n in (1, 64):
        s = triggers(spark, str(tmp_path / f"in-{n}"), (first, later), "request long, event_id long, us long, kind string")
        _, got[n] = run(T.replies(s, 2 * minute, "1 hour", n), tmp_path, f"runs_{n}", "append")
    assert got[1] == got[64] and sum(x[3] == "lost" for x in got[1]) > 100 and {x[3] for x in got[1]} == {"answered", "late", "lost"}
    assert kept(spark, tmp_path, "runs_1") == [500, 501] and kept(spark, tmp_path, "runs_64") == [7]


def test_runs_of_jobs_go_on_from_a_snapshot(spark, tmp_path):
    """A run holds jobs of the snapshot, jobs of the stream and jobs of both; those that are done leave it one by one."""
    schema = "job long, rank int, us long, event_id long, status string"
    seed = spark.createDataFrame([(k, k % 3, ZERO, k, f"s{k % 3}", k) for k in range(10)], f"{schema}, events long")
    s = triggers(spark, str(tmp_path / "in"), ([(k, 1, HOUR, 100 + k, "running") for k in range(5, 13)], [(40, 0, 90 * HOUR, 5, "queued")]), schema)
    _, got = run(T.followed_jobs(s, seed, 24 * HOUR, "1 minute", 8), tmp_path, "job_runs", "update")
    assert got == sorted([(k, "s2" if k % 3 == 2 and k < 10 else "running", k + 1 if k < 10 else 1) for k in range(5, 13)] + [(40, "queued", 1)])
    held = spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / "cp-job_runs")).select("value.kept").collect()
    assert sorted(x[0] for r in held for x in json.loads(r[0])) == [0, 1, 3, 4, 6, 7, 9, 10, 11, 12, 40]
