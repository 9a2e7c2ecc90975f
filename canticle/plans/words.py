"""Timed-word queries; gaps are scaled to the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.operators import library as L
from canticle.operators import words as W
from canticle.plans import query
from canticle.plans.views import WORDS, words

GAP = 21600.0
S = "OVER (PARTITION BY song_id ORDER BY word_idx)"
RUN = "OVER (PARTITION BY song_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING)"
LAGGED = f'l AS (SELECT *, lag(line) {S} AS pl, lag("end") {S} AS pe FROM words)'
PACE_NEW = f'pe IS NULL OR NOT (CASE WHEN line IS NOT NULL AND pl IS NOT NULL THEN line = pl ELSE start - pe <= {GAP} END)'


@query("sessions_pace", f"WITH {WORDS}, {LAGGED} SELECT song_id, word_idx, CAST(sum(CASE WHEN {PACE_NEW} THEN 1 ELSE 0 END) {RUN} AS BIGINT) AS session FROM l")
def sessions_pace(spark, sf):
    return W.pace_sessions(words(spark, sf), GAP).select("song_id", "word_idx", "session")


@query("sessions_export", f"WITH {WORDS}, {LAGGED} SELECT song_id, word_idx, CAST(sum(CASE WHEN pe IS NULL OR CASE WHEN line IS NOT NULL AND pl IS NOT NULL THEN line <> pl WHEN line IS NULL AND pl IS NULL THEN start - pe >= {GAP} ELSE TRUE END THEN 1 ELSE 0 END) {RUN} AS BIGINT) AS session FROM l")
def sessions_export(spark, sf):
    return W.export_sessions(words(spark, sf), GAP).select("song_id", "word_idx", "session")


@query("sessions_ui", f"WITH {WORDS}, {LAGGED} SELECT song_id, word_idx, CAST(sum(CASE WHEN coalesce(line <> pl, TRUE) THEN 1 ELSE 0 END) {RUN} AS BIGINT) AS session FROM l")
def sessions_ui(spark, sf):
    return W.view_sessions(words(spark, sf)).select("song_id", "word_idx", "session")


@query("singing_pace", f"""WITH {WORDS}, s AS (SELECT * FROM words WHERE NOT unsung), l AS (SELECT *, lag(line) {S} AS pl, lag("end") {S} AS pe FROM s),
n AS (SELECT *, sum(CASE WHEN {PACE_NEW} THEN 1 ELSE 0 END) {RUN} AS session FROM l), g AS (SELECT song_id, session, count(*) AS n, max("end") - min(start) AS span FROM n GROUP BY ALL)
SELECT song_id, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) >= 10 AND sum(span) >= 5 THEN round(sum(n) / (sum(span) / 60), 6) END AS pace_wpm FROM g GROUP BY song_id""")
def singing_pace(spark, sf):
    return W.singing_pace(words(spark, sf), GAP)


@query("renumber", f"WITH {WORDS} SELECT song_id, word_idx, row_number() OVER (PARTITION BY song_id, line ORDER BY word_idx) - 1 AS word_in_line, dense_rank() OVER (PARTITION BY song_id ORDER BY line) - 1 AS line_no FROM words WHERE line IS NOT NULL")
def renumber(spark, sf):
    w = words(spark, sf).where("line IS NOT NULL")
    return w.select("song_id", "word_idx", (F.row_number().over(Window.partitionBy("song_id", "line").orderBy("word_idx")) - 1).alias("word_in_line"), (F.dense_rank().over(Window.partitionBy("song_id").orderBy("line")) - 1).alias("line_no"))


VIEWED = f"""{WORDS}, lv AS (SELECT *, sum(CASE WHEN coalesce(line <> pl, TRUE) THEN 1 ELSE 0 END) {RUN} AS session FROM (SELECT *, lag(line) {S} AS pl FROM words)),
ui AS (SELECT song_id, session, min(word_idx) AS first, max(word_idx) AS last, arg_min(start, word_idx) AS start, max(greatest("end", start)) AS "end", row_number() OVER (PARTITION BY song_id ORDER BY session) - 1 AS line_no FROM lv GROUP BY song_id, session),
gaps AS (SELECT song_id, line_no - 1 AS after_line, coalesce(lag("end") OVER l, 0) AS start, start AS "end" FROM ui WINDOW l AS (PARTITION BY song_id ORDER BY line_no))"""


@query("gap_cues", f'WITH {VIEWED} SELECT song_id, after_line, round(start, 6) AS start, round("end", 6) AS "end" FROM gaps WHERE "end" - start >= {GAP}')
def gap_cues(spark, sf):
    """Pauses between the player's lines that are long enough for a wait row, the intro among them."""
    return W.gaps(W.ui_lines(words(spark, sf)), GAP).select("song_id", "after_line", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("lead_in_kinds", f"""WITH {VIEWED} SELECT song_id, after_line + 1 AS line_no, CASE WHEN "end" - start >= {GAP * 5} THEN 'pips' WHEN "end" - start >= {GAP * 1.5} THEN 'bar' END AS kind FROM gaps""")
def lead_in_kinds(spark, sf):
    g = W.gaps(W.ui_lines(words(spark, sf)), float("-inf")).withColumn("gap", F.col("end") - F.col("start"))
    return g.select("song_id", (F.col("after_line") + 1).alias("line_no"), F.when(F.col("gap") >= GAP * 5, "pips").when(F.col("gap") >= GAP * 1.5, "bar").alias("kind"))


@query("running_max_end", f'WITH {WORDS} SELECT song_id, word_idx, round(max("end") OVER (PARTITION BY song_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS busy_until FROM words')
def running_max_end(spark, sf):
    return words(spark, sf).select("song_id", "word_idx", F.round(F.max("end").over(W.before()), 6).alias("busy_until"))


@query("clip_next", f'WITH {WORDS} SELECT song_id, word_idx, round(least("end", coalesce(lead(start) {S}, "end")), 6) AS clipped FROM words')
def clip_next(spark, sf):
    return words(spark, sf).select("song_id", "word_idx", F.round(F.least("end", F.coalesce(F.lead("start").over(W.song()), F.col("end"))), 6).alias("clipped"))


@query("monotonic_onsets", f"WITH {WORDS} SELECT song_id, word_idx, round(max(start - confidence * 40000) {RUN}, 6) AS onset FROM words")
def monotonic_onsets(spark, sf):
    return words(spark, sf).select("song_id", "word_idx", F.round(F.max(F.col("start") - F.col("confidence") * 40000).over(W.so_far()), 6).alias("onset"))


@query("islands_unsung", f'WITH {WORDS}, r AS (SELECT *, word_idx - row_number() OVER (PARTITION BY song_id, unsung ORDER BY word_idx) AS run FROM words) SELECT song_id, min(word_idx) AS first, max(word_idx) AS last, min(start) AS start, max("end") AS "end" FROM r WHERE unsung GROUP BY song_id, run')
def islands_unsung(spark, sf):
    return W.islands(words(spark, sf), F.col("unsung"))


BROKEN = f"""broken AS (SELECT *, CASE WHEN word_idx % 50 = 49 THEN 'nan'::DOUBLE ELSE start - CASE WHEN word_idx % 17 = 16 THEN 90000 ELSE 0 END END AS s, line // 3 AS l, CASE WHEN line IS NOT NULL THEN word_idx % 10 END AS k, max("end") OVER (PARTITION BY song_id) - 50000 AS duration FROM words),
spans AS (SELECT DISTINCT song_id, song_id % 3 AS span, song_id % 5 AS first, CASE WHEN song_id % 4 = 0 THEN 1 WHEN song_id % 4 = 1 THEN 100000 ELSE 4 END AS last FROM words)"""


@query("timing_validate", f"""WITH {WORDS}, {BROKEN}, v AS (SELECT *, isnan(s) AS bad, last_value(CASE WHEN NOT isnan(s) THEN s END IGNORE NULLS) OVER b AS ps, last_value(CASE WHEN l IS NOT NULL THEN l * 1000 + k END IGNORE NULLS) OVER b AS pk FROM broken WINDOW b AS (PARTITION BY song_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT song_id, word_idx AS at_idx, unnest(list_filter([CASE WHEN bad THEN 'finite' END, CASE WHEN NOT bad AND (s < 0 OR "end" > duration + 1e-6) THEN 'range' END, CASE WHEN NOT bad AND "end" < s THEN 'reversed' END, CASE WHEN NOT bad AND s < ps THEN 'unordered' END, CASE WHEN l * 1000 + k <= pk THEN 'link' END], lambda x: x IS NOT NULL)) AS rule FROM v)
SELECT song_id, at_idx AS "at", rule FROM r UNION ALL SELECT s.song_id, span, 'span' FROM spans s JOIN (SELECT song_id, count(*) AS n FROM words GROUP BY 1) USING (song_id) WHERE first > last OR last >= n""")
def timing_validate(spark, sf):
    """All six rules over songs whose times, links and spans are broken here and there."""
    w, i = words(spark, sf), F.col("word_idx")
    s = F.when(i % 50 == 49, F.lit(float("nan"))).otherwise(F.col("start") - F.when(i % 17 == 16, 90000).otherwise(0))
    bad = w.select("song_id", "word_idx", s.alias("start"), "end", F.floor(F.col("line") / 3).alias("line"), F.when(F.col("line").isNotNull(), i % 10).alias("word_in_line"), (F.max("end").over(Window.partitionBy("song_id")) - 50000).alias("duration"))
    k = F.col("song_id")
    spans = w.select("song_id").distinct().select("song_id", (k % 3).alias("span"), (k % 5).alias("first"), F.when(k % 4 == 0, 1).when(k % 4 == 1, 100000).otherwise(4).alias("last"))
    return W.violations(bad, spans)


PROBES = "probes AS (SELECT song_id, event_id AS probe, start + 1800 AS t FROM words)"


def probes(spark, sf, after: float = 1800.0):
    return words(spark, sf).select("song_id", F.col("event_id").alias("probe"), (F.col("start") + after).alias("t"))


@query("asof_word", f'WITH {WORDS}, {PROBES} SELECT p.song_id, p.probe, p.t, CASE WHEN p.t <= w."end" + 900 THEN w.word_idx END AS word_idx FROM probes p ASOF LEFT JOIN words w ON p.song_id = w.song_id AND p.t >= w.start')
def asof_word(spark, sf):
    return W.as_of(probes(spark, sf), words(spark, sf), 900.0)


@query("sung_through", f'WITH {WORDS}, {PROBES} SELECT p.song_id, p.probe, p.t, w.word_idx FROM probes p ASOF LEFT JOIN words w ON p.song_id = w.song_id AND p.t >= w.start')
def sung_through(spark, sf):
    return W.as_of(probes(spark, sf), words(spark, sf))


@query("sung_neighbours", f"WITH {WORDS}, {PROBES}, s AS (SELECT *, lead(word_idx) {S} AS nx FROM words WHERE NOT unsung), f AS (SELECT song_id, min(word_idx) AS nx FROM s GROUP BY 1) SELECT p.song_id, p.probe, w.word_idx AS previous, CASE WHEN w.word_idx IS NULL THEN f.nx ELSE w.nx END AS following FROM probes p ASOF LEFT JOIN s w ON p.song_id = w.song_id AND p.t >= w.start LEFT JOIN f ON f.song_id = p.song_id")
def sung_neighbours(spark, sf):
    """The sung words before and after each probe, unsung ones passed over."""
    s = words(spark, sf).where("not unsung")
    point = F.struct("word_idx", F.lead("word_idx").over(W.song()).alias("nx"))
    at = W.carried(s.select("song_id", F.col("start").alias("t"), point.alias("w")), probes(spark, sf), "w")
    first = s.groupBy("song_id").agg(F.min("word_idx").alias("first"))
    return at.join(first, "song_id", "left").select("song_id", "probe", F.col("w.word_idx").alias("previous"), F.when(F.col("w").isNull(), F.col("first")).otherwise(F.col("w.nx")).alias("following"))


LATER = "later AS (SELECT song_id, event_id AS probe, start + 10800 + event_id % 5 * 3600 AS t FROM words UNION ALL SELECT song_id, -song_id - 1, min(start) - 100 FROM words GROUP BY song_id)"
FRAMES = f"""WITH {VIEWED}, {LATER}, x AS (SELECT lv.*, u.line_no, lead(lv.start) OVER o AS nx, coalesce(lead(lv.session) OVER o <> lv.session, TRUE) AS closes FROM lv JOIN ui u ON u.song_id = lv.song_id AND u.session = lv.session WINDOW o AS (PARTITION BY lv.song_id ORDER BY lv.word_idx)),
 f AS (SELECT p.song_id, p.probe, p.t, w.word_idx, w.start, w."end" AS fin, w.line_no, w.closes, w.nx, p.t <= w."end" + 900 AS active FROM later p ASOF LEFT JOIN x w ON p.song_id = w.song_id AND p.t >= w.start),
 g AS (SELECT *, greatest(greatest(fin, start) + 900, nx - 7200) AS begins FROM f)"""


def later(spark, sf):
    w = words(spark, sf)
    early = w.groupBy("song_id").agg((F.min("start") - 100).alias("t")).select("song_id", (-F.col("song_id") - 1).alias("probe"), "t")
    return w.select("song_id", F.col("event_id").alias("probe"), (F.col("start") + 10800 + F.col("event_id") % 5 * 3600).alias("t")).unionByName(early)


@query("playback_frame", FRAMES + """ SELECT song_id, probe, CASE WHEN active THEN word_idx END AS active, word_idx AS sung_through, round(CASE WHEN NOT active OR active IS NULL THEN 0 WHEN fin <= start THEN 1 ELSE least(1, (t - start) / (fin - start)) END, 6) AS wipe,
 CASE WHEN NOT active AND t >= begins AND t < nx THEN word_idx + 1 END AS approach_word, round(CASE WHEN NOT active AND t >= begins AND t < nx THEN (t - begins) / (nx - begins) ELSE 0 END, 6) AS approach FROM g""")
def playback_frame(spark, sf):
    """What the player shows at moments during and between words, and before the first."""
    f = W.frames_at(words(spark, sf), later(spark, sf), 900.0, GAP, 7200.0)
    return f.select("song_id", "probe", "active", "sung_through", F.round("wipe", 6).alias("wipe"), "approach_word", F.round("approach", 6).alias("approach"))


@query("asof_line", FRAMES + f" SELECT song_id, probe, coalesce(line_no, 0) + CASE WHEN NOT active AND closes AND nx - t <= {GAP} THEN 1 ELSE 0 END AS line FROM g")
def asof_line(spark, sf):
    """The line to look at: the next one early, but only when all of this one is sung."""
    return W.frames_at(words(spark, sf), later(spark, sf), 900.0, GAP, 7200.0).select("song_id", "probe", "line")


@query("gap_at", f'WITH {VIEWED}, {LATER} SELECT p.song_id, p.probe, CASE WHEN p.t < g."end" THEN g.after_line END AS after_line FROM later p ASOF LEFT JOIN (SELECT * FROM gaps WHERE "end" - start >= {GAP}) g ON p.song_id = g.song_id AND p.t >= g.start')
def gap_at(spark, sf):
    """The long pause that each moment falls into."""
    return W.inside(W.gaps(W.ui_lines(words(spark, sf)), GAP), later(spark, sf), "after_line").select("song_id", "probe", "after_line")


PIPS = "CASE WHEN dt <= 0 OR dt > 3 THEN 0 ELSE least(3, ceil(dt / 3 * 3)) END"


@query("pips_and_bars", f'WITH {VIEWED}, m AS (SELECT song_id, after_line + 1 AS line_no, "end" - start AS gap, (after_line * 7 + song_id) % 40 / 10.0::DOUBLE AS dt FROM gaps) SELECT song_id, line_no, CAST({PIPS} AS INTEGER) AS pips, round(greatest(0, least(2, gap / 7200)), 6) AS run, CASE WHEN gap / 7200 > 0 AND dt > 0 AND dt <= least(2, gap / 7200) THEN round(1 - dt / least(2, gap / 7200), 6) END AS bar FROM m')
def pips_and_bars(spark, sf):
    """Pips lit and the progress of the lead-in bar at a moment before each line; pauses are scaled to seconds."""
    g = W.gaps(W.ui_lines(words(spark, sf)), float("-inf"))
    dt = F.pmod(F.col("after_line") * 7 + F.col("song_id"), F.lit(40)) / 10.0
    pips = F.when((dt <= 0) | (dt > 3), 0).otherwise(F.least(F.lit(3), F.ceil(dt / 3 * 3))).cast("int")
    run = F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("end") - F.col("start")) / 7200))
    return g.select("song_id", (F.col("after_line") + 1).alias("line_no"), pips.alias("pips"), F.round(run, 6).alias("run"), F.when((run > 0) & (dt > 0) & (dt <= run), F.round(1 - dt / run, 6)).alias("bar"))


BINS = "bins AS (SELECT song_id, CAST(floor(start / 21600) AS BIGINT) + d AS bin, CAST(max(value * 10) AS BIGINT) % 256 AS peak FROM words, (VALUES (0), (2), (3), (4)) x(d) GROUP BY ALL)"


@query("uncovered_runs", f"""WITH {WORDS}, {BINS}, q AS (SELECT DISTINCT b.* FROM bins b WHERE peak >= 40 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.song_id = b.song_id AND b.bin >= floor(w.start / 21600) AND b.bin < ceil(w."end" / 21600))),
 r AS (SELECT *, bin - row_number() OVER (PARTITION BY song_id ORDER BY bin) AS run FROM q) SELECT song_id, min(bin) AS first, max(bin) AS last FROM r GROUP BY song_id, run HAVING max(bin) - min(bin) + 1 >= 2""")
def uncovered_runs(spark, sf):
    """Loud stretches of two bins or more that no word covers."""
    w = words(spark, sf)
    d = F.explode(F.array(*map(F.lit, (0, 2, 3, 4))))
    bins = w.select("song_id", "start", "value", d.alias("d")).groupBy("song_id", (F.floor(F.col("start") / 21600) + F.col("d")).alias("bin")).agg((F.round(F.max(F.col("value") * 10)).cast("long") % 256).alias("peak"))
    return W.uncovered_runs(bins, w, 21600.0, 40, 2)


ERR = "err AS (SELECT song_id, confidence - 0.5 AS err FROM words)"
STATS = "count(*) AS n, quantile_disc(abs(err), 0.5) AS median, quantile_disc(abs(err), 0.9) AS p90, quantile_disc(abs(err), 0.95) AS p95, max(abs(err)) AS worst, round(avg(err), 6) AS mean, round(avg(CASE WHEN abs(err) <= 0.05 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS within_50, round(avg(CASE WHEN abs(err) <= 0.1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS within_100"


@query("error_stats", f"WITH {WORDS}, {ERR} SELECT song_id, {STATS} FROM err GROUP BY song_id")
def error_stats(spark, sf):
    return W.error_stats(words(spark, sf).select("song_id", (F.col("confidence") - 0.5).alias("err")), ["song_id"])


@query("accuracy_rollup", f"WITH {WORDS}, {ERR} SELECT song_id, {STATS} FROM err GROUP BY GROUPING SETS ((song_id), ())")
def accuracy_rollup(spark, sf):
    """Error statistics of each song and of all words pooled, the latter without a song."""
    err = words(spark, sf).select("song_id", (F.col("confidence") - 0.5).alias("err"))
    return W.error_stats(err, ["song_id"]).unionByName(W.error_stats(err, []).withColumn("song_id", F.lit(None).cast("long")))


@query("worst_errors", f"WITH {WORDS}, r AS (SELECT song_id, word_idx, round(confidence - 0.5, 6) AS err, row_number() OVER (PARTITION BY song_id ORDER BY abs(confidence - 0.5) DESC, word_idx) AS place FROM words) SELECT * FROM r WHERE place <= 5")
def worst_errors(spark, sf):
    """The five largest errors of each song."""
    w = words(spark, sf).withColumn("err", F.col("confidence") - 0.5)
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(F.abs("err").desc(), "word_idx"))
    return w.withColumn("place", place).where("place <= 5").select("song_id", "word_idx", F.round("err", 6).alias("err"), "place")


@query("gap_stalls", f"WITH {WORDS}, g AS (SELECT song_id, start - lag(start) {S} AS gap FROM words) SELECT song_id, count(gap) AS gaps, count(*) FILTER (WHERE gap > 2 * 26400 AND gap - 26400 >= 1) AS stalls, round(max(gap), 6) AS worst FROM g GROUP BY song_id")
def gap_stalls(spark, sf):
    g = words(spark, sf).withColumn("gap", F.col("start") - F.lag("start").over(W.song()))
    return g.groupBy("song_id").agg(F.count("gap").alias("gaps"), F.count_if((F.col("gap") > 2 * 26400) & (F.col("gap") - 26400 >= 1)).alias("stalls"), F.round(F.max("gap"), 6).alias("worst"))


CLAMP = lambda p: f"v[least(len(v) - 1, CAST(floor({p} * len(v)) AS INTEGER)) + 1]"


@query("frame_time_stats", f"WITH {WORDS}, v AS (SELECT song_id, list_sort(list(value)) AS v, sum(value) AS total FROM words GROUP BY song_id) SELECT song_id, {CLAMP(0.5)} AS p50, {CLAMP(0.95)} AS p95, {CLAMP(0.99)} AS p99, round(1000 * len(v) / total, 6) AS fps, CAST(len(list_filter(v, lambda x: x > 400)) AS BIGINT) AS over_400, CAST(len(list_filter(v, lambda x: x > 450)) AS BIGINT) AS over_450 FROM v")
def frame_time_stats(spark, sf):
    """Frame times by their place among all of a song, frames a second, and how many are over two budgets."""
    w = words(spark, sf)
    at = lambda p: lambda n: F.least(n - 1, F.floor(F.lit(p) * n))
    q = L.at_places(w, ["song_id"], "value", {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99)})
    sums = w.groupBy("song_id").agg(F.round(1000 * F.count("*") / F.sum("value"), 6).alias("fps"), *(F.count_if(F.col("value") > b).alias(f"over_{b}") for b in (400, 450)))
    return q.drop("n").join(sums, "song_id")


@query("usage_by_key", f"WITH {WORDS} SELECT song_id, round(sum(value), 4) AS used FROM words WHERE event_type LIKE '%e' OR event_type LIKE '%k' GROUP BY song_id")
def usage_by_key(spark, sf):
    return words(spark, sf).where(F.col("event_type").endswith("e") | F.col("event_type").endswith("k")).groupBy("song_id").agg(F.round(F.sum("value"), 4).alias("used"))


@query("piecewise_integral", f"""WITH {WORDS}, s AS (SELECT song_id, start AS t, lead(start) {S} AS nx, confidence AS ratio FROM words), f AS (SELECT song_id, start + 1000 AS a, start + 41000 AS b FROM words WHERE word_idx % 2 = 0)
SELECT f.song_id, round(sum(greatest(0, least(f.b, coalesce(s.nx, f.b)) - greatest(f.a, s.t)) * s.ratio), 3) AS total FROM f JOIN s ON s.song_id = f.song_id AND s.t < f.b AND coalesce(s.nx, f.b) > f.a GROUP BY f.song_id""")
def piecewise_integral(spark, sf):
    """Song time under device frames that straddle changes of the ratio."""
    w = words(spark, sf)
    segments = w.select("song_id", F.col("start").alias("t"), F.col("confidence").alias("ratio"))
    spans = w.where("word_idx % 2 = 0").select("song_id", (F.col("start") + 1000).alias("start"), (F.col("start") + 41000).alias("end"))
    return W.integral(segments, spans).select("song_id", F.round("total", 3).alias("total"))


@query("energy_window", f"WITH {WORDS} SELECT song_id, word_idx, round(avg(value) OVER (PARTITION BY song_id ORDER BY CAST(floor(start) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING), 6) AS energy FROM words")
def energy_window(spark, sf):
    near = Window.partitionBy("song_id").orderBy(F.floor("start")).rangeBetween(-86400, 86400)
    return words(spark, sf).select("song_id", "word_idx", F.round(F.avg("value").over(near), 6).alias("energy"))


@query("resample_bars", f"WITH {WORDS}, b AS (SELECT song_id, CAST(floor(start / 86400) AS BIGINT) AS bin, max(value) AS peak FROM words GROUP BY ALL), r AS (SELECT song_id, 'round' AS edges, i AS bar, peak FROM b, range(0, 20) t(i) WHERE bin >= floor(19720 + i * 2.5 + 0.5) AND bin < greatest(floor(19720 + i * 2.5 + 0.5) + 1, floor(19720 + (i + 1) * 2.5 + 0.5)) UNION ALL SELECT song_id, 'wide', i, peak FROM b, range(0, 20) t(i) WHERE bin >= floor(19720 + i * 2.5) AND bin < ceil(19720 + (i + 1) * 2.5)) SELECT song_id, edges, bar, max(peak) AS peak FROM r GROUP BY ALL")
def resample_bars(spark, sf):
    """Bins on 20 bars of two bins and a half: with rounded edges each bin is in one bar, with wide edges in one or two."""
    b = words(spark, sf).groupBy("song_id", F.floor(F.col("start") / 86400).alias("bin")).agg(F.max("value").alias("peak"))
    return W.on_bars(b, 19720, 2.5, 20)


@query("lines_to_text", f"WITH {WORDS} SELECT song_id, line, string_agg(event_type, ' ' ORDER BY word_idx) AS text, arg_min(start, word_idx) AS start, max(\"end\") AS \"end\" FROM words WHERE line IS NOT NULL GROUP BY song_id, line")
def lines_to_text(spark, sf):
    """Words of a line joined in order; the line runs from its first word's start to the last end."""
    w = words(spark, sf).where("line IS NOT NULL").groupBy("song_id", "line")
    text = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "event_type"))), lambda x: x["event_type"])
    return w.agg(F.array_join(text, " ").alias("text"), F.min_by("start", "word_idx").alias("start"), F.max("end").alias("end"))


@query("pages", f"""WITH {VIEWED}, w AS (SELECT *, line_no > 0 AND start - coalesce(lag("end") OVER l, 0) >= {GAP * 5} AS wait FROM ui WINDOW l AS (PARTITION BY song_id ORDER BY line_no)), g AS (SELECT *, sum(CASE WHEN wait THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY line_no) AS segment FROM w),
 p AS (SELECT *, (row_number() OVER (PARTITION BY song_id, segment ORDER BY line_no) - 1) // 3 AS part FROM g) SELECT song_id, line_no, CAST(segment AS BIGINT) AS segment, dense_rank() OVER (PARTITION BY song_id ORDER BY segment, part) - 1 AS page FROM p""")
def pages(spark, sf):
    """At most three lines a page, and a new one behind each wait."""
    return W.pages(W.ui_lines(words(spark, sf)), GAP * 5).select("song_id", "line_no", "segment", "page")


@query("shift_clamp", f'WITH {WORDS}, b AS (SELECT song_id, word_idx, value AS s, value + 40 AS e FROM words), c AS (SELECT *, least(500, greatest(0, s - 100)) AS a FROM b) SELECT song_id, word_idx, round(a, 6) AS start, round(least(500, greatest(a, e - 100)), 6) AS "end" FROM c')
def shift_clamp(spark, sf):
    b = words(spark, sf).select("song_id", "word_idx", (F.greatest(F.lit(0.0), F.least(F.lit(500.0), F.col("value") - 100))).alias("start"), (F.col("value") + 40 - 100).alias("e"))
    return b.select("song_id", "word_idx", F.round("start", 6).alias("start"), F.round(F.least(F.lit(500.0), F.greatest("start", "e")), 6).alias("end"))


@query("splice_run", f"""WITH {WORDS}, n AS (SELECT *, count(*) OVER (PARTITION BY song_id) AS n, max("end") OVER (PARTITION BY song_id) AS duration, lag(start) {S} AS before FROM words),
 b AS (SELECT *, max(CASE WHEN word_idx = 1 THEN start END) OVER (PARTITION BY song_id) AS low, coalesce(max(CASE WHEN word_idx = 6 THEN start END) OVER (PARTITION BY song_id), duration) AS high, start + (event_id % 7 - 3) * 40000 AS t, n > 5 AND song_id % 10 <> 0 AND word_idx BETWEEN 2 AND 5 AS inside FROM n),
 o AS (SELECT *, least(greatest(max(CASE WHEN inside THEN t END) {RUN}, low, 0), high, duration) AS onset FROM b)
SELECT song_id, word_idx, round(CASE WHEN inside THEN onset ELSE start END, 6) AS start, round(CASE WHEN inside THEN least(greatest(t + 600, onset), greatest(duration, onset)) ELSE "end" END, 6) AS "end", CASE WHEN inside THEN 0.5 ELSE confidence END AS confidence, CASE WHEN inside THEN FALSE ELSE unsung END AS unsung FROM o""")
def splice_run(spark, sf):
    """The third to sixth word of each song timed anew; every tenth song lacks a timing, and short songs are left alone."""
    w = words(spark, sf)
    runs = w.groupBy("song_id").agg(F.lit(2).alias("first"), F.lit(5).alias("last"), F.max("end").alias("duration"))
    t = F.col("start") + (F.col("event_id") % 7 - 3) * 40000
    timings = w.where("song_id % 10 <> 0 OR word_idx <> 4").select("song_id", "word_idx", t.alias("start"), (t + 600).alias("end"), F.lit(0.5).alias("confidence"))
    return W.splice(w, runs, timings).select("song_id", "word_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "confidence", "unsung")
