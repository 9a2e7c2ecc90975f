"""Timed-word operators: sessions, islands, clamps, as-of joins and accuracy (SURVEY D, E, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.operators.library import at_places
from canticle.storage import Scratch



def song():
    """A song's words in order."""
    return Window.partitionBy("song_id").orderBy("word_idx")


def so_far():
    return song().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return song().rowsBetween(Window.unboundedPreceding, -1)


def numbered(new: Column) -> Column:
    """A running session number from flags of new sessions."""
    return F.sum(F.when(new, 1).otherwise(0)).over(so_far())


def pace_sessions(words: DataFrame, gap: float) -> DataFrame:
    """Same line if the ids agree; where an id is missing, if the gap from the previous end is at most `gap`."""
    w = words.withColumn("_l", F.lag("line").over(song())).withColumn("_e", F.lag("end").over(song()))
    same = F.when(F.col("line").isNotNull() & F.col("_l").isNotNull(), F.col("line") == F.col("_l")).otherwise(F.col("start") - F.col("_e") <= gap)
    return w.withColumn("session", numbered(F.col("_e").isNull() | ~same)).drop("_l", "_e")


def export_sessions(words: DataFrame, gap: float) -> DataFrame:
    """A new line where the id changes, where linked words meet unlinked ones, or after a gap of `gap`."""
    w = words.withColumn("_l", F.lag("line").over(song())).withColumn("_e", F.lag("end").over(song()))
    both = F.col("line").isNotNull() & F.col("_l").isNotNull()
    neither = F.col("line").isNull() & F.col("_l").isNull()
    new = F.when(both, F.col("line") != F.col("_l")).when(neither, F.col("start") - F.col("_e") >= gap).otherwise(F.lit(True))
    return w.withColumn("session", numbered(F.col("_e").isNull() | new)).drop("_l", "_e")


def view_sessions(words: DataFrame) -> DataFrame:
    """Runs of one line id; a word without id is a group of its own."""
    new = F.coalesce(F.col("line") != F.lag("line").over(song()), F.lit(True))
    return words.withColumn("session", numbered(new))


def singing_pace(words: DataFrame, gap: float) -> DataFrame:
    """Sung words by minute of singing; null below 10 words or 5 seconds."""
    sung = pace_sessions(words.where(~F.col("unsung")), gap)
    spans = sung.groupBy("song_id", "session").agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("span"))
    per = spans.groupBy("song_id").agg(F.sum("n").alias("n"), F.sum("span").alias("span"))
    return per.select("song_id", "n", F.when((F.col("n") >= 10) & (F.col("span") >= 5), F.round(F.col("n") / (F.col("span") / 60), 6)).alias("pace_wpm"))


def islands(words: DataFrame, flag: Column) -> DataFrame:
    """Runs of consecutive words with the flag: first and last index and their times."""
    w = words.withColumn("_f", flag)
    run = F.col("word_idx") - F.row_number().over(Window.partitionBy("song_id", "_f").orderBy("word_idx"))
    w = w.withColumn("_run", run).where("_f")
    return w.groupBy("song_id", "_run").agg(F.min("word_idx").alias("first"), F.max("word_idx").alias("last"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def as_of(probes: DataFrame, words: DataFrame, tolerance: float | None = None) -> DataFrame:
    """The last word that starts at or before each probe's t; none if it ended more than `tolerance` before.

    Probes and words are merged and carried forward by a window: one shuffle by song, no range join.
    """
    w = words.select("song_id", F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct("word_idx", "end").alias("w"), F.lit(None).cast("long").alias("probe"))
    p = probes.select("song_id", "t", F.lit(1).alias("kind"), F.lit(None).cast(w.schema["w"].dataType).alias("w"), F.col("probe").cast("long"))
    order = Window.partitionBy("song_id").orderBy("t", "kind", F.col("w.word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    out = w.unionByName(p).withColumn("w", F.last("w", ignorenulls=True).over(order)).where("kind = 1")
    idx = F.col("w.word_idx")
    if tolerance is not None:
        idx = F.when(F.col("t") <= F.col("w.end") + tolerance, idx)
    return out.select("song_id", "probe", "t", idx.alias("word_idx"))


def ui_lines(words: DataFrame) -> DataFrame:
    """song_id, session, first, last, start, end and the places of each line as the player shows them.

    A line starts with its first word and ends with the latest word end.
    """
    w = view_sessions(words).groupBy("song_id", "session").agg(
        F.min("word_idx").alias("first"), F.max("word_idx").alias("last"), F.min_by("start", "word_idx").alias("start"), F.max(F.greatest("end", "start")).alias("end")
    )
    return w.withColumn("line_no", F.row_number().over(Window.partitionBy("song_id").orderBy("session")) - 1)


def gaps(lines: DataFrame, least: float) -> DataFrame:
    """song_id, after_line, start and end of each pause before a line of `least` seconds or more; the intro is after line -1."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy("song_id").orderBy("line_no")), F.lit(0.0))
    g = lines.select("song_id", (F.col("line_no") - 1).alias("after_line"), before.alias("start"), F.col("start").alias("end"))
    return g.where(F.col("end") - F.col("start") >= least)


def pages(lines: DataFrame, wait: float, most: int = 3) -> DataFrame:
    """Lines with segment and page: at most three lines a page, and a new one behind each wait."""
    order = Window.partitionBy("song_id").orderBy("line_no")
    waits = F.col("start") - F.coalesce(F.lag("end").over(order), F.lit(0.0)) >= wait
    out = lines.withColumn("segment", F.sum(F.when(waits & (F.col("line_no") > 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("song_id", "segment").orderBy("line_no"))
    new = F.when((place - 1) % most == 0, 1).otherwise(0)
    out = out.withColumn("new", new)
    return out.withColumn("page", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def carried(points: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """probes (song_id, probe, t) with the value of the last point (song_id, t, value) at or before each.

    Points and probes are merged and carried forward by a window: one shuffle by song, no range join.
    """
    kind = dict(points.dtypes)[value]
    p = points.select("song_id", "t", F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("probe"))
    q = probes.select("song_id", "t", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_v"), F.col("probe").cast("long"))
    order = Window.partitionBy("song_id").orderBy("t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(q).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1").select("song_id", "probe", "t", F.col("_v").alias(value))


def frames_at(words: DataFrame, probes: DataFrame, grace: float, lead: float, approach: float) -> DataFrame:
    """What the player shows at each probe (song_id, probe, t): active, sung_through, wipe, approach_word, approach, line.

    active is the word at t, up to `grace` behind its end; in a pause the next word is approached in its last
    `approach` seconds; the line is that of the last word, or the next one when all of the line is sung and the next
    starts within `lead`.
    """
    w = words.join(view_sessions(words).select("song_id", "word_idx", "session"), ["song_id", "word_idx"])
    line = F.dense_rank().over(Window.partitionBy("song_id").orderBy("session")) - 1
    w = w.withColumn("line_no", line).withColumn("closes", F.coalesce(F.lead("session").over(song()) != F.col("session"), F.lit(True)))
    point = F.struct("word_idx", "start", "end", "line_no", "closes", F.lead("start").over(song()).alias("next"))
    at = carried(w.select("song_id", F.col("start").alias("t"), point.alias("w")), probes, "w")
    x, t = F.col("w"), F.col("t")
    active = F.when(t <= x["end"] + grace, x["word_idx"])
    size = x["end"] - x["start"]
    wipe = F.when(active.isNull(), 0.0).when(size <= 0, 1.0).otherwise(F.least(F.lit(1.0), (t - x["start"]) / size))
    begins = F.greatest(F.greatest(x["end"], x["start"]) + grace, x["next"] - approach)
    nearing = active.isNull() & (t >= begins) & (t < x["next"])
    ahead = active.isNull() & x["closes"] & (x["next"] - t <= lead)
    return at.select(
        "song_id", "probe", "t", active.alias("active"), x["word_idx"].alias("sung_through"), F.coalesce(wipe, F.lit(0.0)).alias("wipe"), F.when(nearing, x["word_idx"] + 1).alias("approach_word"),
        F.coalesce(F.when(nearing, (t - begins) / (x["next"] - begins)), F.lit(0.0)).alias("approach"), F.coalesce(x["line_no"] + F.when(F.coalesce(ahead, F.lit(False)), 1).otherwise(0), F.lit(0)).alias("line"),
    )


def inside(intervals: DataFrame, probes: DataFrame, name: str) -> DataFrame:
    """probes (song_id, probe, t) with the name of the interval (song_id, start, end, name) that holds t, [start, end); intervals of a song do not overlap."""
    points = intervals.select("song_id", F.col("start").alias("t"), F.struct("start", "end", name).alias("_i"))
    return carried(points, probes, "_i").select("song_id", "probe", "t", F.when(F.col("t") < F.col("_i.end"), F.col(f"_i.{name}")).alias(name))


def uncovered_runs(bins: DataFrame, words: DataFrame, width: float, level: int, least: int) -> DataFrame:
    """song_id, first and last of each run of `least` loud bins (song_id, bin, peak) or more that no word touches.

    A word covers from the bin of its start to the one before its end, rounded up.  Covered stretches are merged to
    their edges before bins are looked up, so a long word is two rows, not one a bin.
    """
    edges = words.select("song_id", F.explode(F.array(
        F.struct(F.floor(F.col("start") / width).alias("t"), F.lit(1).alias("step")), F.struct(F.ceil(F.col("end") / width).alias("t"), F.lit(-1).alias("step")),
    )).alias("e")).select("song_id", "e.*").groupBy("song_id", "t").agg(F.sum("step").alias("step"))
    open_ = edges.withColumn("open", F.sum("step").over(Window.partitionBy("song_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    at = carried(open_.select("song_id", "t", "open"), bins.select("song_id", F.col("bin").alias("t"), F.col("bin").alias("probe")), "open")
    loud = bins.where(F.col("peak") >= level).join(at.select("song_id", F.col("probe").alias("bin"), "open"), ["song_id", "bin"]).where(F.coalesce("open", F.lit(0)) <= 0)
    run = F.col("bin") - F.row_number().over(Window.partitionBy("song_id").orderBy("bin"))
    runs = loud.withColumn("_run", run).groupBy("song_id", "_run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).drop("_run")


def violations(words: DataFrame, spans: DataFrame) -> DataFrame:
    """song_id, at and rule of each way in which a timing map is not well formed.

    words: song_id, word_idx, start, end, line, word_in_line, duration; spans: song_id, span, first, last.  Rules:
    finite, range, reversed, unordered (onsets, words without a finite time left out), link (lines go forward, and
    places within a line), span.
    """
    bad = F.isnan("start") | F.isnan("end") | (F.abs("start") == float("inf")) | (F.abs("end") == float("inf")) | F.col("start").isNull() | F.col("end").isNull()
    fine = F.when(~bad, F.col("start"))
    link = F.when(F.col("line").isNotNull() & F.col("word_in_line").isNotNull(), F.struct("line", "word_in_line"))
    w = words.withColumns({"last_start": F.last(fine, ignorenulls=True).over(before()), "last_link": F.last(link, ignorenulls=True).over(before())})
    tests = {
        "finite": bad,
        "range": ~bad & ((F.col("start") < 0) | (F.col("end") > F.col("duration") + 1e-6)),
        "reversed": ~bad & (F.col("end") < F.col("start")),
        "unordered": ~bad & (F.col("start") < F.col("last_start")),
        "link": link.isNotNull() & (link <= F.col("last_link")),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in tests.items())))
    rows = w.select("song_id", F.col("word_idx").alias("at"), F.explode(found).alias("rule"))
    n = words.groupBy("song_id").agg(F.count("*").alias("_n"))
    wrong = spans.join(n, "song_id", "left").where((F.col("first") > F.col("last")) | (F.col("last") >= F.coalesce("_n", F.lit(0))))
    return rows.unionByName(wrong.select("song_id", F.col("span").alias("at"), F.lit("span").alias("rule")))


def integral(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """song_id and the song time that device frames (song_id, start, end) cover at the ratios in force (song_id, t, ratio).

    A ratio holds from its t to the next one's.  With S(t), the song time up to t, a frame covers S(end) - S(start);
    S is carried to both ends of each frame, so frames and segments are never paired.
    """
    order = Window.partitionBy("song_id").orderBy("t")
    s = segments.withColumn("_step", F.coalesce((F.col("t") - F.lag("t").over(order)) * F.lag("ratio").over(order), F.lit(0.0)))
    s = s.withColumn("_sum", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    points = s.select("song_id", "t", F.struct("t", "ratio", F.col("_sum").alias("sum")).alias("p"))
    ends = frames.select("song_id", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1.0).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(1.0).alias("sign")))).alias("e")).select("song_id", "e.*")
    ends = ends.groupBy("song_id", "t").agg(F.sum("sign").alias("sign"))
    at = carried(points, ends.select("song_id", "t", F.lit(0).alias("probe")), "p")
    both = at.join(ends, ["song_id", "t"])
    upto = F.coalesce(F.col("p.sum") + (F.col("t") - F.col("p.t")) * F.col("p.ratio"), F.lit(0.0))
    return both.groupBy("song_id").agg(F.sum(upto * F.col("sign")).alias("total"))


def error_stats(errors: DataFrame, by: list[str]) -> DataFrame:
    """n, nearest-rank quantiles of the absolute error, its mean with sign, shares within 50 and 100 ms."""
    a = F.abs("err")
    ranks = (F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY abs(err))").alias(name) for p, name in ((0.5, "median"), (0.9, "p90"), (0.95, "p95")))
    return errors.groupBy(*by).agg(
        F.count("*").alias("n"), *ranks,
        F.max(a).alias("worst"), F.round(F.avg("err"), 6).alias("mean"), F.round(F.avg(F.when(a <= 0.05, 1.0).otherwise(0.0)), 6).alias("within_50"), F.round(F.avg(F.when(a <= 0.1, 1.0).otherwise(0.0)), 6).alias("within_100"),
    )


def accuracy_report(aligned: DataFrame) -> DataFrame:
    """One row a song and one for all (song null): words of both sides, matches, what has no partner, errors, and the row as JSON.

    aligned: song, hyp_idx and ref_idx (one of them null where a word has no partner), err (seconds, of pairs) and
    freestyle (of the reference word).  Quantiles are nearest-rank ones of the absolute error, found by place over one
    range partitioning, so no song and not the row for all is gathered.
    """
    rows = aligned.withColumn("scope", F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("song")), F.struct(F.lit(True).alias("all"), F.lit(None).cast(aligned.schema["song"].dataType).alias("song")))))
    rows = rows.select("scope.all", "scope.song", "hyp_idx", "ref_idx", "freestyle", "err", F.abs("err").alias("off"))
    rows = Scratch(aligned.sparkSession, "accuracy").table(rows, "rows")  # read by the counts and by the places; aligned once
    hyp, ref = F.col("hyp_idx").isNotNull(), F.col("ref_idx").isNotNull()
    ones = {"n_hyp": hyp, "n_ref": ref, "matched": hyp & ref, "freestyle_matched": hyp & ref & F.col("freestyle"), "hyp_only": ~ref, "ref_only": ~hyp}
    by = ["all", "song"]
    share = lambda s: F.round(F.avg(F.when(F.col("off") <= s, 1.0).when(F.col("off").isNotNull(), 0.0)), 6)
    folds = rows.groupBy(*by).agg(
        *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in ones.items()),
        F.max("off").alias("worst"), F.round(F.avg("err"), 6).alias("mean"), share(0.05).alias("within_50"), share(0.1).alias("within_100"),
    )
    rank = lambda p: lambda n: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))
    places = at_places(rows.where("off IS NOT NULL"), by, "off", {"median": rank(0.5), "p90": rank(0.9), "p95": rank(0.95)}).drop("n")
    keep = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by]
    out = folds.alias("f").join(places.alias("p"), keep[0] & keep[1], "left").select("f.*", "p.median", "p.p90", "p.p95").drop("all")
    return out.withColumn("report", F.to_json(F.struct(*out.columns)))


def on_bars(bins: DataFrame, first: int, width: float, bars: int) -> DataFrame:
    """song_id, edges, bar and peak of bins (song_id, bin, peak) on bars of `width` bins from bin `first` on.

    round: edges are rounded, so each bin is in one bar (a bar has a bin at least); wide: from the floor of a bar's
    start to the ceiling of its end.  A bin names its few bars itself, so there is no range join.
    """
    at = (F.col("bin") - first) / F.lit(width)
    near = F.explode(F.sequence(F.floor(at) - 2, F.floor(at) + 2))
    rows = bins.withColumn("bar", near).where((F.col("bar") >= 0) & (F.col("bar") < bars))
    a, b = F.col("bar") * width + first, (F.col("bar") + 1) * width + first
    low = F.floor(a + 0.5)
    rounded = (F.col("bin") >= low) & (F.col("bin") < F.greatest(low + 1, F.floor(b + 0.5)))
    wide = (F.col("bin") >= F.floor(a)) & (F.col("bin") < F.ceil(b))
    rows = rows.withColumn("edges", F.explode(F.array_compact(F.array(F.when(rounded, F.lit("round")), F.when(wide, F.lit("wide"))))))
    return rows.groupBy("song_id", "edges", "bar").agg(F.max("peak").alias("peak"))


def splice(words: DataFrame, runs: DataFrame, timings: DataFrame) -> DataFrame:
    """Words with a run of each song (runs: song_id, first, last, duration) timed anew (timings: song_id, word_idx, start, end, confidence).

    Onsets stay between those of the words around the run and never go back inside it; a run that is out of range or
    lacks a timing is left alone.  Words of a run are sung and rest on no anchor.
    """
    whole = Window.partitionBy("song_id")
    t = timings.select("song_id", "word_idx", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("confidence").alias("_confidence"))
    w = words.join(runs, "song_id", "left").join(t, ["song_id", "word_idx"], "left")
    inside = F.col("word_idx").between(F.col("first"), F.col("last"))
    complete = F.sum(F.when(inside & F.col("_start").isNotNull(), 1).otherwise(0)).over(whole) == F.col("last") - F.col("first") + 1
    w = w.withColumn("_in", F.coalesce(inside & complete, F.lit(False)))
    low = F.coalesce(F.max(F.when(F.col("word_idx") == F.col("first") - 1, F.col("start"))).over(whole), F.lit(0.0))
    high = F.coalesce(F.max(F.when(F.col("word_idx") == F.col("last") + 1, F.col("start"))).over(whole), F.col("duration"))
    # Clamping from above at a fixed bound commutes with the running maximum.
    onset = F.least(F.greatest(F.max(F.when(F.col("_in"), F.col("_start"))).over(so_far()), low, F.lit(0.0)), high, F.col("duration"))
    w = w.withColumn("_onset", onset)
    new = {
        "end": F.least(F.greatest("_end", "_onset"), F.greatest("duration", "_onset")), "start": F.col("_onset"), "confidence": F.col("_confidence"), "unsung": F.lit(False),
    }
    return w.withColumns({k: F.when(F.col("_in"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_in", "_start", "_end", "_confidence", "_onset", "first", "last", "duration")
