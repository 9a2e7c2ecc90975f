"""Jobs, stages, rooms and queues as folds over their events (SURVEY E, L)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of a song's states in lists: what runs first, what is done last.
STATES = ("processing", "failed", "review", "needs-timings", "ready")


def song_states(songs: DataFrame, jobs: DataFrame) -> DataFrame:
    """id and state of each song; jobs: job, song_id, audio_path, status, seq.

    A job belongs to the song of its id or of its audio path, by two equi-joins.  A job that waits or runs wins; else
    the last one that was not cancelled; else what the song lacks.
    """
    s = songs.select("id", F.col("audio_path").alias("_path"))
    j = jobs.select("job", "song_id", "audio_path", "status", "seq")
    by_id = s.join(j, s["id"] == j["song_id"]).select("id", "job", "status", "seq")
    by_path = s.join(j, s["_path"] == j["audio_path"]).select("id", "job", "status", "seq")
    own = by_id.unionByName(by_path).distinct().groupBy("id").agg(
        F.bool_or(F.col("status").isin("queued", "running")).alias("_active"), F.max_by("status", F.when(F.col("status") != "cancelled", F.col("seq"))).alias("_last")
    )
    out = songs.join(own, "id", "left")
    state = F.when(F.col("_active"), "processing").when(F.col("_last") == "failed", "failed").when(F.col("timing_map_path").isNull(), "needs-timings").when(F.col("reviewed_at").isNull(), "review").otherwise("ready")
    return out.select("id", "title", state.alias("state"))


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state) - 1


def snapshot(events: DataFrame) -> DataFrame:
    """job, rank, us, event_id, status and events: where each job is after its events (job, rank, us, event_id, status)."""
    last = F.max(F.struct("rank", "us", "event_id", "status")).alias("last")
    return events.groupBy("job").agg(last, F.count("*").alias("events")).select("job", "last.*", "events")


def progress(events: DataFrame) -> DataFrame:
    """job, stage, fraction and failure after its events (job, seq, type, stage, fraction, message).

    Each of them is what the last event that may set it has set: a start or a tick shows its stage; a separation that
    is skipped or done shows the next; only separation and alignment move the fraction, and their starts clear it.
    """
    kind, stage, seq = F.col("type"), F.col("stage"), F.col("seq")
    shown = F.when(stage == "separate", "separating").otherwise("aligning")
    measured = stage.isin("separate", "align")
    sets_stage = kind.isin("stage_started", "stage_progress") | (kind.isin("stage_skipped", "stage_completed") & (stage == "separate"))
    to_stage = F.when(kind.isin("stage_started", "stage_progress"), shown).otherwise("aligning")
    sets_fraction = (kind == "stage_started") & measured | (kind == "stage_progress") & measured & F.col("fraction").isNotNull() | (kind == "stage_completed") & (stage == "separate")
    to_fraction = F.when(kind == "stage_started", F.lit(None)).when(kind == "stage_completed", 1.0).otherwise(F.col("fraction"))
    last = lambda value, when: F.max_by(F.struct(value.alias("v")), F.when(when, seq))["v"]
    return events.groupBy("job").agg(last(to_stage, sets_stage).alias("stage"), last(to_fraction, sets_fraction).alias("fraction"), last(F.col("message"), kind == "stage_failed").alias("failure"))


def up_to_date(stages: DataFrame) -> DataFrame:
    """Stages (job, ord, status, fingerprint, wanted, size, found) with fresh and stale.

    A stage is fresh if it is complete, was made from the same inputs and its artifact is there at its size; it is stale
    if it or one before it is not fresh.
    """
    fresh = (F.col("status") == "completed") & F.col("fingerprint").eqNullSafe(F.col("wanted")) & F.coalesce(F.col("size") == F.col("found"), F.lit(False))
    chain = Window.partitionBy("job").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("fresh", fresh).withColumn("stale", F.max(F.when(fresh, 0).otherwise(1)).over(chain) == 1)


def failures(failed: DataFrame) -> DataFrame:
    """batch and report: why the failed jobs (batch, job, title, reason) of a batch failed, the commonest reason first.

    One shared reason lists eight titles; else three reasons list four each, and the rest are counted.  Only the first
    eight titles of a reason are ever gathered.
    """
    order = Window.partitionBy("batch", "reason").orderBy("job")
    first = failed.withColumn("_rn", F.row_number().over(order)).where("_rn <= 8").groupBy("batch", "reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "title"))), lambda x: x["title"]).alias("titles"))
    g = failed.groupBy("batch", "reason").agg(F.count("*").alias("n"), F.min("job").alias("since")).join(first, ["batch", "reason"])
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("n"), "since")))
    shown = lambda k: F.concat(F.array_join(F.slice("titles", 1, k), ", "), F.when(F.col("n") > k, ", …").otherwise(""))
    top = F.when(F.col("place") <= 3, F.struct("place", F.concat(shown(4), F.lit(" — "), "reason").alias("row")))
    b = g.groupBy("batch").agg(
        F.sum("n").alias("total"), F.count("*").alias("reasons"), F.array_sort(F.collect_list(top)).alias("top"), F.sum(F.when(F.col("place") > 3, F.col("n")).otherwise(0)).alias("rest"),
        F.max_by(F.concat(F.lit("Couldn't finish: "), shown(8), F.lit(".\n"), "reason"), -F.col("place")).alias("single"),
    )
    many = F.concat(F.lit("Couldn't finish "), F.col("total").cast("string"), F.lit(" songs:\n"), F.array_join(F.transform("top", lambda x: x["row"]), "\n"), F.when(F.col("rest") > 0, F.concat(F.lit("\n…and "), F.col("rest").cast("string"), F.lit(" more for other reasons."))).otherwise(""))
    return b.select("batch", F.when(F.col("reasons") == 1, F.col("single")).otherwise(many).alias("report"))


#: What each command does to a job: from which states to which; others leave it alone.
COMMANDS = {
    "enqueue": ({None}, "queued"), "take": ({"queued"}, "running"), "finish": ({"running"}, "completed"), "fail": ({"running"}, "failed"),
    "cancel": ({"queued", "running"}, "cancelled"), "retry": ({"failed", "cancelled"}, "queued"), "restart": ({"running"}, "queued"),
}


def after(state: str | None, command: str) -> str | None:
    before, then = COMMANDS.get(command, (set(), None))
    return then if state in before else state


def lifecycles(commands: DataFrame) -> DataFrame:
    """job, state and refused (commands that did nothing) after each job's commands (job, seq, command) in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, refused = None, 0
        for c in pdf.sort_values("seq")["command"]:
            new = after(state, c)
            refused += new == state
            state = new
        return pd.DataFrame({"job": [pdf["job"].iloc[0]], "state": [state], "refused": [refused]})

    return commands.groupBy("job").applyInPandas(run, "job long, state string, refused long")


def lifecycle_stream(commands: DataFrame) -> DataFrame:
    """The same on a stream, with state kept by job: job, state and refused after each trigger; seq orders a trigger's commands.

    A job that starts from a snapshot gets it as its first command, "seed:" and the state.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else (None, 0)
        for c in pd.concat(list(batches)).sort_values("seq")["command"]:
            new = c.removeprefix("seed:") if c.startswith("seed:") else after(now, c)
            refused += int(new == now)
            now = new
        state.update((now, refused))
        yield pd.DataFrame({"job": [key[0]], "state": [now], "refused": [refused]})

    return commands.groupBy("job").applyInPandasWithState(step, "job long, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def admitted(hellos: DataFrame, most: int) -> DataFrame:
    """hellos (room, secret, seq, name) with guest and accepted: a known secret gets its guest back, new ones a number while the room has place; names without a letter are refused."""
    good = F.col("name").isNotNull()
    first = hellos.where(good).groupBy("room", "secret").agg(F.min("seq").alias("_first"))
    first = first.withColumn("guest", F.row_number().over(Window.partitionBy("room").orderBy("_first"))).where(F.col("guest") <= most)
    out = hellos.join(first, ["room", "secret"], "left")
    return out.withColumn("accepted", good & F.col("guest").isNotNull()).withColumn("guest", F.when(good, F.col("guest"))).drop("_first")


def room_ends(host: DataFrame, away: float, life: float) -> DataFrame:
    """room and ends: when its host (room, at) has been away for `away`, or the room is `life` old, whichever is first."""
    order = Window.partitionBy("room").orderBy("at")
    later = F.lead("at").over(order)
    lost = F.when(later.isNull() | (later - F.col("at") > away), F.col("at") + away)
    return host.withColumn("_lost", lost).groupBy("room").agg(F.least(F.min("_lost"), F.min("at") + life).alias("ends"))


def guest_view(queue: DataFrame, guests: DataFrame, listing: DataFrame) -> DataFrame:
    """The queue as each guest of a party (party, guest) sees it: entries in order with mine, and nobody's guest id; songs that are not listed are gone."""
    rows = queue.select("party", F.col("guest").alias("_owner"), "id", "position", "song_id", F.col("id").eqNullSafe(F.col("playing")).alias("playing"))
    rows = rows.join(listing.select(F.col("id").alias("song_id"), "pid", "title"), "song_id")
    return guests.join(rows, "party").select("party", "guest", "id", "position", "pid", "title", "playing", (F.col("_owner") == F.col("guest")).alias("mine"))


def stage_states(events: DataFrame) -> DataFrame:
    """status, fingerprint, seconds, error and output_token of each stage of a job after its events.

    events: job, stage, seq, type (in_flight, complete, failed, not_applicable), fingerprint, at, seconds, artifacts (a
    text), message.  A start drops the output token, so later stages see that it ran again; a completion makes a new
    one; a stage that does not apply has the same one as long as its fingerprint stays; a failure leaves it alone.
    """
    kind = F.col("type")
    begins, last = kind.isin("in_flight", "not_applicable"), lambda value, when: F.max_by(F.struct(value.alias("v")), F.when(when, F.col("seq")))["v"]
    latest = events.groupBy("job", "stage").agg(
        F.max_by("type", "seq").alias("status"),
        F.coalesce(last(F.col("fingerprint"), begins), F.lit("")).alias("fingerprint"),
        last(F.when(kind == "complete", F.col("seconds")), kind != "failed").alias("seconds"),
        F.max_by(F.when(kind == "failed", F.col("message")), "seq").alias("error"),
        F.max_by(F.struct("type", "at", "seconds", "artifacts"), F.when(kind != "failed", F.col("seq"))).alias("made"),
    )
    # What sets the fingerprint also sets the token, so a token that stands was made from the last fingerprint.
    token = F.when(F.col("made.type") == "complete", F.sha2(F.concat_ws("|", "fingerprint", "made.at", "made.seconds", "made.artifacts"), 256))
    token = token.when(F.col("made.type") == "not_applicable", F.sha2(F.concat(F.lit("n/a|"), "fingerprint"), 256)).otherwise("")
    return latest.withColumn("output_token", token).drop("made")


def in_front(fullscreen: Column, pid: Column, own: Column, load: Column, threshold: float) -> Column:
    """Whether a game is in front: exclusive full screen, or another process that keeps the graphics unit busy."""
    return fullscreen | ((pid != 0) & (pid != own) & (load >= threshold))


def jobs_list(active: DataFrame, registry: DataFrame) -> DataFrame:
    """Running jobs and registered ones in one table, with `part` to tell them apart; columns of one part are null in the other."""
    return active.withColumn("part", F.lit("active")).unionByName(registry.withColumn("part", F.lit("registry")), allowMissingColumns=True)
