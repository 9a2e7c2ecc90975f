"""Streams with keyed timers and initial state: rooms that end by themselves, rates that are forgotten, replies that stay out,
jobs that go on from a snapshot.

State is a row a run of neighbouring keys: `together` of them, one by default.  An event-time timer drops a key when its
time has passed, whether or not it is heard of again, so state is bounded by the keys of one waiting time and not by all
that ever came.  Calls of the state store are made once a run; streams of many keys with few rows each need runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from canticle.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """What streams with timers need of a session: a state store that has column families, and this package in workers."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Timed(StatefulProcessor):
    """A processor whose keys come in runs of neighbours: a run is a group of the stream, with one value and one timer.

    What is kept of a key is a tuple with the microsecond at which it is due (null: never).  `rows` takes a key's rows of a
    trigger in order; `over` tells what is left of a key that is due, which is then forgotten.  A call of the state store
    or of pandas serves a whole run, so it costs little a key, and a run's size is bounded by its width.
    """

    COLUMNS: tuple[str, ...] = ("us", "event_id")
    ORDER: tuple[str, ...] = ("us", "event_id")
    OUT = ""

    def rows(self, key: int, now: tuple | None, rows: list[tuple], out: list[tuple]) -> tuple[tuple | None, int | None]:
        """What is kept of a key after its rows (COLUMNS) and when that is due; `out` takes what is told."""
        raise NotImplementedError

    def over(self, key: int, now: tuple, out: list[tuple]) -> None:
        pass

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "kept string")
        self.names = [x.split()[0] for x in self.OUT.split(", ")]
        self.whole = [x.split()[0] for x in self.OUT.split(", ") if x.endswith("long")]

    def kept(self) -> dict:
        """due and state of each key of the run."""
        return {key: (due, tuple(now)) for key, due, now in json.loads(self.value.get()[0])} if self.value.exists() else {}

    def keep(self, kept: dict, fired: int | None = None) -> None:
        """Keeps what is left of a run and sets its timer for the first that is due; `fired` is a timer that Spark drops itself."""
        dues = [due for due, _ in kept.values() if due is not None]
        first = -(-min(dues) // 1000) if dues else None
        armed = [t for t in self.handle.listTimers() if t != fired]
        for t in armed:
            if t != first:
                self.handle.deleteTimer(t)
        if first is not None and first not in armed:
            self.handle.registerTimer(first)
        if kept:
            self.value.update((json.dumps([(key, due, now) for key, (due, now) in kept.items()]),))
        else:
            self.value.clear()

    def told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=self.names).astype(dict.fromkeys(self.whole, "Int64"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["key", *self.ORDER], kind="stable")
        kept, out = self.kept(), []
        for k, some in groupby(zip(*(pdf[c].tolist() for c in ("key", *self.COLUMNS))), itemgetter(0)):
            now, due = self.rows(k, kept.pop(k, (None, None))[1], [r[1:] for r in some], out)
            if now is not None:
                kept[k] = due, now
        self.keep(kept)
        return self.told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, out = self.kept(), []
        at, clock = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for k, (due, now) in list(kept.items()):
            # What else the watermark has passed is over too, as its own timer would have fired.
            if due is not None and ((ms := -(-due // 1000)) == at or ms < clock):
                self.over(k, now, out)
                del kept[k]
        self.keep(kept, at)
        return self.told(out)

    def close(self) -> None:
        pass


class Rooms(Timed):
    """Ends a room when its host has been silent for `away`, or the room is `life` old; what comes later opens a new one."""

    OUT = "room long, opened long, ends long, why string"

    def __init__(self, away: int, life: int):
        self.away, self.life = away, life

    def ended(self, room: int, opened: int, heard: int) -> tuple:
        old = opened + self.life <= heard + self.away
        return room, opened, min(opened + self.life, heard + self.away), "closed" if old else "gone"

    def rows(self, key, now, rows, out):
        for us, _ in rows:
            if now and us > (over := self.ended(key, *now))[2]:
                out.append(over)
                now = None
            now = (now[0], max(now[1], us)) if now else (us, us)
        return now, self.ended(key, *now)[2]

    def over(self, key, now, out):
        out.append(self.ended(key, *now))


class Limit(Timed):
    """Numbers the messages of a key in tumbling spans; forgets a key when a span has passed since it was last here."""

    OUT = "job long, event_id long, accepted boolean"

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most

    def rows(self, key, now, rows, out):
        span, count = now or (None, 0)
        for us, event in rows:
            count = count + 1 if us // self.width == span else 1
            span = us // self.width
            out.append((key, event, count <= self.most))
        return (span, count), rows[-1][0] + self.width


class Replies(Timed):
    """Pairs a request with the first reply to it; a request that no reply reaches in `wait` is told as lost."""

    COLUMNS = ("us", "kind")
    OUT = "request long, asked long, took long, outcome string"

    def __init__(self, wait: int):
        self.wait = wait

    def rows(self, key, now, rows, out):
        asked, answered = now or (None, False)
        for us, kind in rows:
            if kind == "request" and asked is None:
                asked = us
            elif kind == "reply" and asked is not None and not answered:
                answered = True
                out.append((key, asked, us - asked, "late" if us - asked > self.wait else "answered"))
        return (None, None) if asked is None else ((asked, answered), asked + self.wait)

    def over(self, key, now, out):
        asked, answered = now
        if not answered:
            out.append((key, asked, None, "lost"))


class Jobs(Timed):
    """The job reducer, begun from a snapshot: what is newest by rank, then time; a job that is done is forgotten after `keep`."""

    COLUMNS = ORDER = ("rank", "us", "event_id", "status")
    OUT = "job long, status string, events long"
    DONE = 2

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def due(self, now: tuple) -> int | None:
        return now[1] + self.keep_us if now[0] >= self.DONE else None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Nothing is told and nothing is replayed: the snapshot is where the job is.  A run's jobs may come in pieces.
        kept = self.kept()
        for k, *now in zip(*(initialState[c].tolist() for c in ("key", *self.COLUMNS, "events"))):
            kept[k] = self.due(now), tuple(now)
        self.keep(kept)

    def rows(self, key, now, rows, out):
        now = now or (-1, -1, -1, "", 0)
        # The trigger's greatest is all that can win.
        now = (*max(now[:4], rows[-1]), now[4] + len(rows))
        out.append((key, now[3], now[4]))
        return now, self.due(now)


def keyed(stream: DataFrame, key: str, processor: Timed, late: str, mode: str, together: int, seed: DataFrame | None = None) -> DataFrame:
    """The stream (key, event_id, us and what the processor reads) by runs of `together` keys, with a watermark on us of `late`."""
    ready(stream.sparkSession)

    def runs(df: DataFrame) -> DataFrame:
        return df.withColumns({"run": F.expr(f"`{key}` div {together}"), "key": F.col(key).cast("long")})

    timed = runs(stream).withColumn("at", F.timestamp_micros("us")).withWatermark("at", late).select("run", "key", *dict.fromkeys((*processor.COLUMNS, *processor.ORDER)), "at")
    return timed.groupBy("run").transformWithStateInPandas(processor, processor.OUT, mode, "EventTime", initialState=runs(seed).groupBy("run") if seed is not None else None)


def room_lives(host: DataFrame, away_us: int, life_us: int, late: str = "10 minutes", together: int = 1) -> DataFrame:
    """room, opened, ends and why (gone, closed) of rooms that have ended; host: room, event_id, us of what hosts send."""
    return keyed(host, "room", Rooms(away_us, life_us), late, "append", together)


def span_limit(messages: DataFrame, width_us: int, most: int, late: str = "10 minutes", together: int = 1) -> DataFrame:
    """job, event_id and accepted of messages (job, event_id, us): `most` in each span of a key, the rest refused."""
    return keyed(messages, "job", Limit(width_us, most), late, "append", together)


def replies(frames: DataFrame, wait_us: int, late: str = "10 minutes", together: int = 1) -> DataFrame:
    """request, asked, took and outcome (answered, late, lost) of frames (request, event_id, us, kind of request and reply)."""
    return keyed(frames, "request", Replies(wait_us), late, "append", together)


def followed_jobs(events: DataFrame, snapshot: DataFrame, keep_us: int, late: str = "10 minutes", together: int = 1) -> DataFrame:
    """job, status and events after each trigger, from a snapshot (job, rank, us, event_id, status, events) on.

    events: job, rank, us, event_id, status of what came after it.  The snapshot is read when the stream first starts;
    a restart goes on from the checkpoint.  A job is forgotten `keep_us` after it was done.
    """
    return keyed(events, "job", Jobs(keep_us), late, "update", together, snapshot)
