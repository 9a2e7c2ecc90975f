"""Queries on aligned words, their lanes and edits, token targets, cached checks and playing marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from canticle.operators import alignment as A
from canticle.plans import query
from canticle.plans.jobs import JOBS, jobs
from canticle.plans.views import WORDS, table, words

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
FOLDED = "translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("anchor_agreement", f"""WITH {WORDS}, a AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN start + (event_id % 7 - 3) * 60 END AS ws FROM words)
SELECT song_id, word_idx, NOT unsung AND ws IS NOT NULL AND abs((start + "end") / 2 - (ws + 60)) <= 300 AS anchored FROM a""")
def anchor_agreement(spark, sf):
    """Words whose place agrees with a rough window of two minutes, give or take four."""
    i = F.col("event_id")
    low = F.when(i % 5 != 0, F.col("start") + (i % 7 - 3) * 60)
    return words(spark, sf).select("song_id", "word_idx", A.agrees(~F.col("unsung"), F.col("start"), F.col("end"), low, low + 120, 240.0).alias("anchored"))


@query("silent_frames", """WITH s AS (SELECT user_id AS song_id, event_id % 300 + 0.005 * (event_id % 4) AS s, event_id % 300 + 0.005 * (event_id % 4) + value / 500 AS e FROM events WHERE event_type = 'error'),
 f AS (SELECT DISTINCT song_id, frame FROM (SELECT song_id, s, e, unnest(range(CAST(floor(s * 50) AS BIGINT) - 1, CAST(ceil(e * 50) AS BIGINT) + 2)) AS frame FROM s) WHERE frame >= ceil(s / 0.02::DOUBLE) AND frame BETWEEN 0 AND 14999 AND frame * 0.02::DOUBLE + 0.025::DOUBLE <= e + 1e-9)
SELECT song_id, count(*) AS frames, CAST(sum(frame) AS BIGINT) AS places FROM f GROUP BY song_id""".replace("0.005 *", "0.005::DOUBLE *"))
def silent_frames(spark, sf):
    """Frames of 20 ms whose 25 ms window is wholly silent, summed up by song."""
    i = F.col("event_id")
    start = i % 300 + F.lit(0.005) * (i % 4)
    stretches = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("song_id"), start.alias("start"), (start + F.col("value") / 500).alias("end"))
    return A.silent_frames(stretches, 0.02, 0.025, 15000).groupBy("song_id").agg(F.count("*").alias("frames"), F.sum("frame").alias("places"))


@query("token_targets", rf"""WITH w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM conversations)),
 t AS (SELECT *, list_transform(regexp_extract_all({FOLDED}, '[{ALPHABET.replace("'", "''")}]'), lambda c: instr('{ALPHABET.replace("'", "''")}', c)) AS ids FROM w),
 r AS (SELECT *, 1 + coalesce(sum(len(ids) + CASE WHEN len(ids) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM t)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, array_to_string(ids, ' ') AS ids, CAST(lo AS BIGINT) AS lo, CAST(lo + len(ids) AS BIGINT) AS hi FROM r""")
def token_targets(spark, sf):
    """Letters of each turn's words as numbers between delimiters, with each word's range."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("pos", "w"))
    c = c.select("conv_id", "turn", "pos", F.expr(FOLDED).alias("word"))
    return A.token_targets(c, ["conv_id", "turn"], ALPHABET).select("conv_id", "turn", "pos", F.array_join("ids", " ").alias("ids"), "lo", "hi")


LANES = """lanes AS (SELECT song_id, word_idx // 4 AS lane, min(start) AS first, greatest(arg_max("end", word_idx), min(start)) AS last FROM words GROUP BY ALL)"""


@query("lane_at", f"""WITH {WORDS}, {LANES}, p AS (SELECT song_id, event_id AS id, start + 900 AS t FROM words),
 k AS (SELECT p.song_id, p.id, p.t, min(l.lane) FILTER (WHERE p.t <= l.last) AS k, max(l.lane) AS final FROM p JOIN lanes l USING (song_id) GROUP BY ALL)
SELECT k.song_id, k.id, CASE WHEN k.k IS NULL THEN CASE WHEN k.t < l.last + 300 THEN k.final END WHEN k.t >= l.first - 300 THEN k.k WHEN k.k > 0 THEN k.k - 1 END AS lane
FROM k JOIN lanes l ON l.song_id = k.song_id AND l.lane = coalesce(k.k, k.final)""")
def lane_at(spark, sf):
    """The lane of four words that is in front a quarter of an hour after each word."""
    w = words(spark, sf)
    last = F.greatest(F.max_by("end", "word_idx"), F.min("start"))
    lanes = w.groupBy("song_id", F.floor(F.col("word_idx") / 4).alias("lane")).agg(F.min("start").alias("first"), last.alias("last"))
    lanes = lanes.withColumn("start", F.col("first") - 300).withColumn("end", F.col("last") + 300)
    return A.lanes_at(lanes, w.select("song_id", F.col("event_id").alias("id"), (F.col("start") + 900).alias("t"))).select("song_id", "id", "lane")


@query("shift_range", f"""WITH {WORDS}, g AS (SELECT *, word_idx - row_number() OVER (PARTITION BY song_id, line ORDER BY word_idx) AS g FROM words)
SELECT song_id, word_idx, CASE WHEN line IS NULL THEN word_idx ELSE min(word_idx) OVER (PARTITION BY song_id, line, g) END AS line_first,
 CASE WHEN line IS NULL THEN word_idx ELSE max(word_idx) OVER (PARTITION BY song_id, line, g) END AS line_last, max(word_idx) OVER (PARTITION BY song_id) AS tail_last FROM g""")
def shift_range(spark, sf):
    """What moves along with each word: its line's run, or all that follows."""
    return A.shift_ranges(words(spark, sf)).select("song_id", "word_idx", "line_first", "line_last", "tail_last")


@query("alignment_summary", """SELECT user_id AS song_id, count(*) AS n_words, round(quantile_cont(value / 100, 0.5), 6) AS duration_median, round(quantile_cont(value / 100, 0.95), 6) AS duration_p95,
 count(*) FILTER (WHERE value / 100 > 2) AS longer_than_2s, round(quantile_cont(value, 0.5), 6) AS score_median, round(quantile_cont(value, 0.1), 6) AS score_p10,
 round((10 + user_id % 50) / (60.0::DOUBLE + user_id % 240), 6) AS time_factor, round((10 + user_id % 50) / (60.0::DOUBLE + user_id % 240) * 210, 6) AS song_seconds FROM events GROUP BY user_id""")
def alignment_summary(spark, sf):
    """Quantiles, long words and time factors of each song's alignment."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("song_id"), (F.col("value") / 100).alias("duration"), F.col("value").alias("score"))
    i = F.col("song_id")
    out = A.summary(e, e.select("song_id").distinct().select("song_id", (60.0 + i % 240).alias("audio_s"), (10 + i % 50).alias("total_s")))
    kept = ("duration_median", "duration_p95", "score_median", "score_p10", "time_factor", "song_seconds")
    return out.select("song_id", "n_words", "longer_than_2s", *(F.round(c, 6).alias(c) for c in kept))


@query("cache_hit", """WITH e AS (SELECT l_partkey AS model, l_linenumber % 2 AS ep, l_suppkey % 2 AS version, l_returnflag <> 'R' AS passed, CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS snr, l_orderkey * 10 + l_linenumber AS place FROM lineitem),
 f AS (SELECT p_partkey AS id, e.snr, row_number() OVER (PARTITION BY p_partkey ORDER BY place) AS n FROM part JOIN e ON e.model = p_partkey AND e.ep = p_size % 2 AND e.version = 1 AND e.passed)
SELECT p_partkey AS id, f.id IS NOT NULL AS hit, f.snr FROM part LEFT JOIN f ON f.id = p_partkey AND f.n = 1""")
def cache_hit(spark, sf):
    """Models that an earlier check of the same kind and version found good."""
    n = F.col("l_linenumber")
    e = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), (n % 2).alias("ep"), (F.col("l_suppkey") % 2).alias("version"), (F.col("l_returnflag") != "R").alias("passed"),
        F.when(F.col("l_linestatus") == "O", n).alias("snr"), (F.col("l_orderkey") * 10 + n).alias("place"),
    )
    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("ep"), F.lit(1).alias("version"))
    return A.cached_passes(wanted, e, ["id", "ep", "version"]).select("id", "hit", "snr")


@query("play_marks", f"""WITH RECURSIVE {JOBS}, p AS (SELECT job AS party, event_id, event_id * 31 % 13 AS entry, row_number() OVER (PARTITION BY job ORDER BY us, event_id) AS seq FROM jobs),
 s AS (SELECT party, seq, event_id, TRUE AS accepted, CAST(NULL AS BIGINT) AS gone, entry AS playing, CAST([] AS BIGINT[]) AS dropped FROM p WHERE seq = 1
  UNION ALL SELECT p.party, p.seq, p.event_id, NOT list_contains(s.dropped, p.entry), CASE WHEN NOT list_contains(s.dropped, p.entry) AND p.entry <> s.playing THEN s.playing END,
   CASE WHEN list_contains(s.dropped, p.entry) THEN s.playing ELSE p.entry END, CASE WHEN list_contains(s.dropped, p.entry) OR p.entry = s.playing THEN s.dropped ELSE list_append(s.dropped, s.playing) END
  FROM s JOIN p ON p.party = s.party AND p.seq = s.seq + 1)
SELECT event_id, accepted, gone FROM s""")
def play_marks(spark, sf):
    """Plays of queue entries: those of entries that have left are refused, the others make the entry before leave."""
    plays = jobs(spark, sf).select(F.col("job").alias("party"), "event_id", F.struct("us", "event_id").alias("seq"), (F.col("event_id") * 31 % 13).alias("entry"))
    return A.play_marks(plays).select("event_id", "accepted", F.col("left").alias("gone"))
