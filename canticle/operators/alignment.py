"""Operators on aligned words: anchors, silent frames, token targets, lanes, edit ranges and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agrees(aligned: Column, start: Column, end: Column, window_start: Column, window_end: Column, tolerance: float) -> Column:
    """Whether an aligned word's middle lies in its rough window, give or take the tolerance; false without a window."""
    middle = (start + end) / 2
    return F.coalesce(aligned & (middle >= window_start - tolerance) & (middle <= window_end + tolerance), F.lit(False))


def silent_frames(stretches: DataFrame, frame_s: float, window_s: float, frames: int) -> DataFrame:
    """song_id, frame: the frames below `frames` whose window lies wholly inside a stretch (song_id, start, end)."""
    first = F.greatest(F.ceil(F.col("start") / frame_s), F.lit(0))
    last = F.least(F.floor(F.col("end") / frame_s), F.lit(frames - 1))
    each = stretches.select("song_id", "end", first.alias("first"), last.alias("last")).where("first <= last")
    each = each.select("song_id", "end", F.explode(F.sequence("first", "last")).alias("frame"))
    return each.where(F.col("frame") * frame_s + window_s <= F.col("end") + 1e-9).select("song_id", "frame").distinct()


def token_targets(words: DataFrame, by: list[str], alphabet: str, delimiter: int = 0) -> DataFrame:
    """words (by, pos, word) with ids, lo and hi: the word's tokens and their range in its text's targets.

    Targets are a delimiter, then each word's letters and a delimiter again; a letter's id is its place in
    the alphabet, from 1.  A word without letters of the alphabet has an empty range and no delimiter.
    """
    letters = F.regexp_extract_all("word", F.lit(f"[{alphabet}]"), F.lit(0))
    rows = words.withColumn("ids", F.transform(letters, lambda c: F.position(c, F.lit(alphabet)) + delimiter))
    size = F.size("ids")
    taken = F.sum(size + F.when(size > 0, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("lo", F.coalesce(taken, F.lit(0)) + 1).withColumn("hi", F.col("lo") + size)


def lanes_at(lanes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (song_id, id, t) with the lane that the playhead is in, null before all and after the last.

    lanes: song_id, lane (in order), start and end of its padded window, first and last of its words.  A gap
    belongs to the lane before it until the next one's window opens.  Lanes and probes are merged by time.
    """
    so_far = Window.partitionBy("song_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    ends = lanes.select("song_id", F.max("last").over(so_far).alias("t"), F.struct("lane", "start", "first", "end").alias("l"))
    both = probes.select("song_id", "t", "id").unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("song_id").orderBy("t", F.col("l").isNotNull(), "l.lane")
    both = both.withColumn("next", F.first("l", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    both = both.withColumn("final", F.last("l", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.col("t")
    ahead = F.when((t >= F.col("next.first")) | (t >= F.col("next.start")), F.col("next.lane")).otherwise(F.nullif(F.col("next.lane") - 1, F.lit(-1)))
    behind = F.when(t < F.col("final.end"), F.col("final.lane"))
    return both.where("l IS NULL").select("song_id", "id", "t", F.when(F.col("next").isNotNull(), ahead).otherwise(behind).alias("lane"))


def shift_ranges(words: DataFrame) -> DataFrame:
    """words (song_id, word_idx, line) with what moves along: the run of the word's line, and the last word of the song.

    A word without a line is a run of its own.
    """
    song = Window.partitionBy("song_id").orderBy("word_idx")
    starts = F.col("line").isNull() | ~F.col("line").eqNullSafe(F.lag("line").over(song))
    runs = words.withColumn("run", F.sum(starts.cast("int")).over(song))
    run, whole = Window.partitionBy("song_id", "run"), Window.partitionBy("song_id")
    return runs.withColumn("line_first", F.min("word_idx").over(run)).withColumn("line_last", F.max("word_idx").over(run)).withColumn("tail_last", F.max("word_idx").over(whole)).drop("run")


def summary(words: DataFrame, runs: DataFrame, song_s: float = 210.0) -> DataFrame:
    """Per song: words, quantiles of duration and score, long words, and the time factor of its run (song_id, audio_s, total_s)."""
    at = lambda column, share: F.percentile(column, F.lit(share))
    per = words.groupBy("song_id").agg(
        F.count("*").alias("n_words"), at("duration", 0.5).alias("duration_median"), at("duration", 0.95).alias("duration_p95"),
        F.count_if(F.col("duration") > 2).alias("longer_than_2s"), at("score", 0.5).alias("score_median"), at("score", 0.1).alias("score_p10"),
    )
    factor = F.col("total_s") / F.col("audio_s")
    per = runs.join(per, "song_id", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0))).withColumn("longer_than_2s", F.coalesce("longer_than_2s", F.lit(0)))
    return per.withColumn("time_factor", factor).withColumn("song_seconds", factor * song_s)


def cached_passes(wanted: DataFrame, entries: DataFrame, same: list[str]) -> DataFrame:
    """wanted with hit and snr: the first entry (place, passed, snr) that passed and has the same values; failures are never trusted."""
    good = entries.where("passed").groupBy(*same).agg(F.min_by(F.struct("snr"), "place").alias("found"))
    return wanted.join(good, same, "left").withColumn("hit", F.col("found").isNotNull()).withColumn("snr", F.col("found.snr")).drop("found")


def play_marks(plays: DataFrame) -> DataFrame:
    """plays (party, seq, entry) with accepted and left: whether the entry still was there, and the entry that it made leave.

    Playing another entry makes the one before leave for good, so what plays is always the entry that was
    first played last; a play is accepted where it is of that one.
    """
    party = Window.partitionBy("party").orderBy("seq")
    new = F.when(F.col("seq") == F.min("seq").over(Window.partitionBy("party", "entry")), F.col("entry"))
    rows = plays.withColumn("new", new)
    playing = F.last("new", ignorenulls=True).over(party.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("new", ignorenulls=True).over(party.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("accepted", F.col("entry") == playing).withColumn("left", F.when(F.col("new").isNotNull(), before)).drop("new")
