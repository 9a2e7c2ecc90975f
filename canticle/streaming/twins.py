"""Streaming forms of the job reducer, the tumbling rate limit, the latch, playing marks and room views (SURVEY L)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canticle.operators.jobs import guest_view


def reduced_jobs(events: DataFrame) -> DataFrame:
    """job, status and count of events so far, by keyed state; events: job, rank, us, event_id, status.

    A lower rank never takes a job back, so late events do no harm; state is one row a job.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, us, ident, status, n = state.get if state.exists else (-1, -1, -1, "", 0)
        for pdf in batches:
            n += len(pdf)
            for r in pdf.itertuples():
                if (r.rank, r.us, r.event_id) > (rank, us, ident):
                    rank, us, ident, status = int(r.rank), int(r.us), int(r.event_id), r.status
        state.update((rank, us, ident, status, n))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "events": [n]})

    return events.groupBy("job").applyInPandasWithState(step, "job long, status string, events long", "rank int, us long, event_id long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def latched(events: DataFrame) -> DataFrame:
    """job, event_id and held: on at a hit, off after two misses; events: job, event_id, us, hit.

    Rows of a trigger are taken in event order; state keeps the last sample of each job.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else False
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        held = []
        for hit in pdf["hit"]:
            held.append(bool(hit or last))
            last = bool(hit)
        state.update((last,))
        yield pd.DataFrame({"job": key[0], "event_id": pdf["event_id"], "held": held})

    return events.groupBy("job").applyInPandasWithState(step, "job long, event_id long, held boolean", "hit boolean", "append", GroupStateTimeout.NoTimeout)


def minute_counts(events: DataFrame, limit: int = 30, late: str = "1 hour") -> DataFrame:
    """Messages and refusals of each key and minute, with a watermark that bounds the state; events: job, ts."""
    w = events.withWatermark("ts", late).groupBy("job", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return w.select("job", F.col("w.start").alias("minute"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def play_marks(plays: DataFrame) -> DataFrame:
    """party, event_id, accepted and gone of plays of queue entries (party, event_id, us, entry), by keyed state.

    A play of another entry makes the one before leave for good; plays of entries that have left are
    refused.  State keeps what plays and what has left, no more than a party's queue has held.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        playing, left = state.get if state.exists else (None, [])
        left = set(left)
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        accepted, gone = [], []
        for entry in pdf["entry"].tolist():
            accepted.append(entry not in left)
            moves = accepted[-1] and playing is not None and entry != playing
            gone.append(playing if moves else None)
            if moves:
                left.add(playing)
            if accepted[-1]:
                playing = entry
        state.update((playing, sorted(left)))
        yield pd.DataFrame({"party": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": accepted, "gone": pd.array(gone, "Int64")})

    return plays.groupBy("party").applyInPandasWithState(step, "party long, event_id long, accepted boolean, gone long", "playing long, gone array<long>", "append", GroupStateTimeout.NoTimeout)


def fan_out(queues: DataFrame, guests: DataFrame, listing: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """A stream, yet to be started, that writes each guest's view of a party's queue once it has changed.

    queues: party, version and what guest_view takes; guests and listing are tables.  Of the versions of a party in a
    trigger the last is told.  A trigger's views replace what a lost run of the same trigger has left.
    """

    def send(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("party").agg(F.max("version").alias("version"))
        views = guest_view(batch.join(last, ["party", "version"], "left_semi"), guests, listing).join(last, "party")
        views.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    return queues.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
