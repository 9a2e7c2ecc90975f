"""Kernel queries: grouped maps, checked against plain Python in the tests; chunk_plan in SQL too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.functions.text import normalize_word
from canticle.operators import kernels as K
from canticle.operators import words as W
from canticle.plans import query
from canticle.plans.views import WORDS, table, words
from canticle.shipping import ship


@query("align_grade")
def align_grade(spark, sf):
    """Each turn of a conversation against the next, word by word; a null text has no words."""
    ship(spark)
    return K.align_grade(turns(spark, sf))


def turns(spark, sf):
    c = table(spark, sf, "conversations").withColumn("w", F.coalesce(F.transform(F.split("text", r"\s+"), normalize_word), F.array().cast("array<string>")))
    nxt = F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("ref", nxt).where("ref IS NOT NULL")
    return pairs.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", F.col("w").alias("hyp"), "ref")


@query("align_pairs")
def align_pairs(spark, sf):
    """The pairs themselves of each turn and the next, and the words of both that have no partner."""
    ship(spark)
    return K.align_pairs(turns(spark, sf))


@query("accuracy_report")
def accuracy_report(spark, sf):
    """Each conversation's turns against the next ones: word k of a turn begins at 0.4 k seconds, of the next one at 0.38 k; words of up to three letters are freestyle."""
    ship(spark)
    t = turns(spark, sf)
    p = K.align_pairs(t).join(t.select("id", "conv_id", "ref"), "id")
    err = F.when(F.col("hyp_idx").isNotNull() & F.col("ref_idx").isNotNull(), F.round(F.col("hyp_idx") * 0.4 - F.col("ref_idx") * 0.38, 6))
    free = F.length(F.get("ref", F.col("ref_idx"))) <= 3
    return W.accuracy_report(p.select(F.col("conv_id").alias("song"), "hyp_idx", "ref_idx", err.alias("err"), free.alias("freestyle")))


@query("ctc_align")
def ctc_align(spark, sf):
    """Frames are a label's vectors; the target has a token for every four of them, every fourth component's place in turn."""
    ship(spark)
    return K.ctc_align(emissions(spark, sf).drop("silent"))


@query("ctc_align_silent")
def ctc_align_silent(spark, sf):
    """The same with silent frames, those of two vectors in eleven, and a token in every five that parts words."""
    ship(spark)
    rows = emissions(spark, sf)
    parted = F.transform("target", lambda t, k: F.when(k % 5 == 4, 1).otherwise(F.when(t == 1, 2).otherwise(t)))
    return K.ctc_align_silent(rows.withColumn("target", parted), 1)


def emissions(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    rows = e.groupBy(F.col("label").cast("long").alias("song")).agg(F.array_sort(F.collect_list(F.struct("n", "embedding", (F.col("vec_id") % 11 < 2).alias("silent")))).alias("f"))
    rows = rows.select("song", F.transform("f", lambda x: x["embedding"]).alias("emission"), F.transform("f", lambda x: x["silent"]).alias("silent"))
    places = F.size(F.get("emission", F.lit(0))) - 1
    return rows.withColumn("target", F.transform(F.sequence(F.lit(0), F.ceil(F.size("emission") / 4).cast("int") - 1), lambda k: 4 * k % places + 1))


def spoken(w):
    """A word for each event; an error ends a phrase."""
    return F.concat(F.col("event_type"), F.when(F.col("unsung"), ".").otherwise("")).alias("word")


@query("line_breaks")
def line_breaks(spark, sf):
    """Lines of least cost, over all ways to break each song."""
    ship(spark)
    w = words(spark, sf)
    return K.line_breaks(w.select("song_id", F.col("word_idx").cast("int").alias("word_idx"), (F.col("start") / 7200).alias("start"), (F.col("end") / 7200).alias("end"), spoken(w)))


@query("greedy_match")
def greedy_match(spark, sf):
    """Each turn of a conversation against the next with a look-ahead of four words."""
    ship(spark)
    return K.greedy_match(turns(spark, sf))


@query("onset_picks")
def onset_picks(spark, sf):
    """Peaks of each song's values, three words apart at least."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[0], "word_idx": K.onsets(pdf["value"].tolist(), 200.0, 3)})

    return words(spark, sf).select("song_id", "word_idx", "value").groupBy("song_id").applyInPandas(run, "song_id long, word_idx long")


@query("realign_windows")
def realign_windows(spark, sf):
    """Stretches around the errors of each song that are aligned again; hours are scaled to seconds."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        w = K.windows(pdf["unsung"].tolist(), pdf["start"].tolist(), pdf["end"].tolist(), duration=pdf["end"].max())
        return pd.DataFrame(w, columns=["first", "last", "low", "high"]).assign(song_id=pdf["song_id"].iloc[0])[["song_id", "first", "last", "low", "high"]]

    w = words(spark, sf)
    zero = F.min("start").over(Window.partitionBy("song_id"))
    at = lambda c: ((F.col(c) - zero) / 7200).alias(c)
    return w.select("song_id", "word_idx", at("start"), at("end"), "unsung").groupBy("song_id").applyInPandas(run, "song_id long, first long, last long, low double, high double")


@query("reflow_lines")
def reflow_lines(spark, sf):
    ship(spark)
    w = words(spark, sf)
    return K.reflow_lines(w.select("song_id", F.col("word_idx").cast("int").alias("word_idx"), "start", "end", F.concat(F.col("event_type"), F.when(F.col("unsung"), ".").otherwise("")).alias("word")), 21600.0)


@query("lcs_retime")
def lcs_retime(spark, sf):
    """Every song retyped in capitals with commas, without its errors and with a word put in front."""
    ship(spark)
    w = words(spark, sf)
    old = F.array_sort(F.collect_list(F.struct("word_idx", F.col("event_type").alias("word"), "start", "end")))
    s = w.groupBy("song_id").agg(F.transform(old, lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("old"))
    kept = F.filter(F.transform("old", lambda x: x["word"]), lambda x: x != "error")
    typed = F.transform(kept, lambda w: F.concat(F.upper(w), F.lit(",")))
    return K.lcs_retime(s.withColumn("new", F.concat(F.array(F.lit("intro")), typed)))


@query("line_times", f"""WITH {WORDS} SELECT song_id, CAST(k AS INTEGER) AS row_no, CASE WHEN k % 2 = 0 AND k // 2 * 6 < n THEN list_extract(starts, CAST(k // 2 * 6 + 1 AS INTEGER)) END AS at
FROM (SELECT song_id, count(*) AS n, list(start ORDER BY word_idx) AS starts FROM words GROUP BY song_id), LATERAL (SELECT unnest(range(0, (n + 5) // 6 * 2 + 1)) AS k)""")
def line_times(spark, sf):
    """Every song's words typed six to a row, in capitals with signs, a blank row behind each and a new word in the last."""
    ship(spark)
    old = F.array_sort(F.collect_list(F.struct("word_idx", F.concat("event_type", F.col("word_idx").cast("string")).alias("word"), "start", "end")))
    s = words(spark, sf).groupBy("song_id").agg(old.alias("w"))
    row = lambda k: F.array_join(F.transform(F.slice("w", k * 6 + 1, 6), lambda x: F.upper(F.concat(x["word"], F.lit("!")))), "  ")
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 6).cast("int")), lambda k: F.array(row(k), F.lit(" "))))
    plain = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    return K.line_times(s.select("song_id", plain.alias("old"), F.concat(rows, F.array(F.lit("coda"))).alias("rows")))


@query("plan_chunks")
def plan_chunks(spark, sf):
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[0], "cut": K.plan_chunks(pdf["value"].tolist(), 20, 30)})

    return words(spark, sf).select("song_id", "word_idx", "value").groupBy("song_id").applyInPandas(run, "song_id long, cut long")


@query("clock_reports")
def clock_reports(spark, sf):
    """Reports every 50 ms whose positions jitter and whose rate changes now and then: what is shown, and where it snaps."""
    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        now = [x * 0.05 for x in range(len(pdf))]
        got = K.clock([t + v / 1000 for t, v in zip(now, pdf["value"])], [1.0 if k % 30 else 0.0 for k in range(len(now))], now)
        return pd.DataFrame({"song_id": pdf["song_id"], "word_idx": pdf["word_idx"], "shown": [x for x, _ in got], "snapped": [s for _, s in got]})

    return words(spark, sf).select("song_id", F.col("word_idx").cast("int").alias("word_idx"), "value").groupBy("song_id").applyInPandas(run, "song_id long, word_idx int, shown double, snapped boolean")


@query("chunk_plan", "WITH n AS (SELECT doc_id, n_chars AS n FROM documents) SELECT doc_id, c AS chunk, c * 300 AS keep_from, least(n, (c + 1) * 300) AS keep_to, greatest(0, c * 300 - 50) AS read_from, least(n, (c + 1) * 300 + 50) AS read_to FROM n, LATERAL (SELECT unnest(range(0, greatest(1, (n + 299) // 300))) AS c)")
def chunk_plan(spark, sf):
    """Chunks that tile a text exactly, each read with some context on either side."""
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n"))
    c = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor((F.col("n") + 299) / 300)) - 1))
    d = d.select("doc_id", "n", c.alias("chunk"))
    a, b = F.col("chunk") * 300, F.least("n", (F.col("chunk") + 1) * 300)
    return d.select("doc_id", "chunk", a.alias("keep_from"), b.alias("keep_to"), F.greatest(F.lit(0), a - 50).alias("read_from"), F.least(F.col("n"), (F.col("chunk") + 1) * 300 + 50).alias("read_to"))


@query("word_edits")
def word_edits(spark, sf):
    """Every song's words after twelve edits: drags, moves of several words, new texts, insertions, deletions, undo and redo."""
    ship(spark)
    w = words(spark, sf).withColumn("duration", F.max("end").over(Window.partitionBy("song_id")))
    kinds = F.array(*map(F.lit, ("drag", "nudge", "text", "insert", "undo", "delete", "undo", "redo")))
    k, i = F.col("seq"), F.col("song_id")
    e = w.groupBy("song_id").agg(F.count("*").alias("n"), F.min("start").alias("zero")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(11))))
    kind, first = F.get(kinds, ((i + k * 3) % 8).cast("int")), (i * 7 + k * 5) % F.col("n")
    at = F.when(kind == "nudge", (i % 11 - 5) * 9000.0).when((kind == "drag") | (k % 2 == 0), F.col("zero") + (i * 31 + k * 17) % 200 * 3600.0)
    e = e.select("song_id", "seq", kind.alias("kind"), first.alias("first"), (first + k % 3).alias("last"), at.alias("start"), (at + 1800).alias("end"), F.concat(F.lit("new "), k.cast("string")).alias("text"))
    return K.word_edits(w.select("song_id", "word_idx", F.col("event_type").alias("word"), "start", "end", "line", "duration"), e)


@query("log_mel")
def log_mel(spark, sf):
    """Eight mel bands of windows of 16 samples, every eight samples of each vector."""
    ship(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return K.log_mels(e, 16, 8, 8)
