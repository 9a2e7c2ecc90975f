"""Signal queries over the embeddings as frames of 64 samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.operators import signal as G
from canticle.plans import query
from canticle.plans.views import table


def frames(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("song"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.withColumn("frame_idx", F.row_number().over(Window.partitionBy("song").orderBy("vec_id")) - 1)


FRAMES = "frames AS (SELECT label AS song, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx FROM embeddings)"
DB = "10 * log10(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-12)"


@query("norm_stats", f"WITH {FRAMES}, s AS (SELECT song, unnest(x) AS v FROM frames) SELECT song, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM s GROUP BY song")
def norm_stats(spark, sf):
    return frames(spark, sf).select("song", F.explode("x").alias("v")).groupBy("song").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query("frame_db", f"WITH {FRAMES} SELECT vec_id, round({DB}, 6) AS db FROM frames")
def frame_db(spark, sf):
    return frames(spark, sf).select("vec_id", F.round(G.frame_db(F.col("x")), 6).alias("db"))


@query("voice_level", f"WITH {FRAMES}, v AS (SELECT song, list_sort(list({DB})) AS v FROM frames GROUP BY song) SELECT song, round(v[CAST(floor((len(v) - 1) * 0.95) AS INTEGER) + 1], 6) AS level FROM v")
def voice_level(spark, sf):
    f = frames(spark, sf).withColumn("db", G.frame_db(F.col("x")))
    return G.level(f, "song", "db", 0.95).select("song", F.round("level", 6).alias("level"))


@query("silent_runs", f"WITH {FRAMES}, f AS (SELECT *, x[1] < 0 AS quiet FROM frames), r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY song, quiet ORDER BY frame_idx) AS run FROM f) SELECT song, min(frame_idx) AS first, max(frame_idx) AS last FROM r WHERE quiet GROUP BY song, run")
def silent_runs(spark, sf):
    f = frames(spark, sf).withColumn("quiet", F.get("x", F.lit(0)) < 0)
    return G.runs(f, "song", "frame_idx", "quiet")


@query("snr_pairs", f"WITH {FRAMES}, p AS (SELECT *, lead(x) OVER (PARTITION BY song ORDER BY frame_idx) AS y FROM frames) SELECT vec_id, round(10 * log10(list_sum(list_transform(x, lambda a: a * a)) / list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS snr FROM p WHERE y IS NOT NULL")
def snr_pairs(spark, sf):
    p = frames(spark, sf).withColumn("y", F.lead("x").over(Window.partitionBy("song").orderBy("frame_idx"))).where("y IS NOT NULL")
    return p.select("vec_id", F.round(G.snr_db(F.col("x"), F.col("y")), 6).alias("snr"))


@query("peak_envelope", f"WITH {FRAMES}, b AS (SELECT song, frame_idx // 2 AS bin, max(list_max(list_transform(x, lambda v: abs(v)))) AS peak FROM frames GROUP BY ALL) SELECT song, CAST(bin AS BIGINT) AS bin, CAST(floor(peak / max(peak) OVER (PARTITION BY song) * 255 + 0.5) AS BIGINT) AS level FROM b")
def peak_envelope(spark, sf):
    loud = F.array_max(F.transform("x", lambda v: F.abs(v)))
    b = frames(spark, sf).groupBy("song", F.floor(F.col("frame_idx") / 2).alias("bin")).agg(F.max(loud).alias("peak"))
    return b.select("song", "bin", F.floor(F.col("peak") / F.max("peak").over(Window.partitionBy("song")) * 255 + 0.5).alias("level"))


@query("mix_minus", f"WITH {FRAMES}, p AS (SELECT *, lead(x) OVER (PARTITION BY song ORDER BY frame_idx) AS y FROM frames) SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) AS rest FROM p WHERE y IS NOT NULL")
def mix_minus(spark, sf):
    p = frames(spark, sf).withColumn("y", F.lead("x").over(Window.partitionBy("song").orderBy("frame_idx"))).where("y IS NOT NULL")
    return p.select("vec_id", F.round(G.total(F.zip_with("x", "y", lambda a, b: F.abs(a - b))), 6).alias("rest"))


@query("soft_limit", f"WITH {FRAMES}, v AS (SELECT vec_id, x[1] * 8 AS v FROM frames) SELECT vec_id, round(CASE WHEN abs(v) <= 0.8 THEN v ELSE sign(v) * (0.8 + 0.2 * tanh((abs(v) - 0.8) / 0.2)) END, 6) AS v FROM v")
def soft_limit(spark, sf):
    return frames(spark, sf).select("vec_id", F.round(G.soft_limit(F.get("x", F.lit(0)) * 8), 6).alias("v"))


@query("log_softmax", f"WITH {FRAMES}, t AS (SELECT vec_id, x, list_max(x) AS m FROM frames) SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, round(unnest(x) - m - ln(list_sum(list_transform(x, lambda v: exp(v - m)))), 6) AS v FROM t")
def log_softmax(spark, sf):
    return frames(spark, sf).select("vec_id", F.posexplode(G.log_softmax(F.col("x"))).alias("i", "v")).withColumn("v", F.round("v", 6))


@query("zscore_vectors", f"WITH {FRAMES}, m AS (SELECT vec_id, x, list_sum(x) / len(x) AS m FROM frames) SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, round((unnest(x) - m) / sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x) + 1e-7), 6) AS v FROM m")
def zscore_vectors(spark, sf):
    return frames(spark, sf).select("vec_id", F.posexplode(G.zscore(F.col("x"))).alias("i", "v")).withColumn("v", F.round("v", 6))


@query("longest_silent_run", f"WITH {FRAMES}, s AS (SELECT vec_id, generate_subscripts(x, 1) AS i, abs(unnest(x)) < 0.05 AS q FROM frames), r AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, q ORDER BY i) AS run FROM s), n AS (SELECT vec_id, run, count(*) FILTER (WHERE q) AS n FROM r WHERE q GROUP BY ALL) SELECT f.vec_id, CAST(coalesce(max(n), 0) AS INTEGER) AS longest FROM frames f LEFT JOIN n USING (vec_id) GROUP BY f.vec_id")
def longest_silent_run(spark, sf):
    return frames(spark, sf).select("vec_id", G.longest_run(F.col("x"), 0.05).alias("longest"))


@query("overlap_add", f"WITH {FRAMES}, s AS (SELECT song, frame_idx, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM frames), w AS (SELECT song, frame_idx * 32 + i AS sample, 32.5::DOUBLE - abs(i + 1 - 32.5::DOUBLE) AS w, v FROM s) SELECT song, CAST(sample AS INTEGER) AS sample, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY song, sample")
def overlap_add(spark, sf):
    return G.overlap_add(frames(spark, sf), 32, 64).select("song", "sample", F.round("v", 6).alias("v"))


@query("shifted_passes", f"""WITH {FRAMES}, s AS (SELECT song, frame_idx * 64 + generate_subscripts(x, 1) - 1 AS j, unnest(x) AS v FROM frames),
st AS (SELECT song, count(*) AS n, avg(v) AS m, stddev_samp(v) AS d FROM s GROUP BY song),
z AS (SELECT song, j, (v - m) / d AS v FROM s JOIN st USING (song)),
g AS (SELECT song, n + lead AS total, lead, unnest(range(0, (n + lead + 149) // 150)) * 150 AS o FROM st, (VALUES (75), (25)) p(lead)),
h AS (SELECT song, lead, o, least(o + 200, total) AS e FROM g),
c AS (SELECT song, lead, o, e, o - (200 - (e - o)) // 2 AS b FROM h),
x AS (SELECT c.song, c.lead, o, z.j, z.v - coalesce(y.v, 0) / 2 AS v FROM c JOIN z ON z.song = c.song AND z.j + c.lead >= o AND z.j + c.lead < e LEFT JOIN z y ON y.song = c.song AND y.j = 2 * b + 199 - 2 * c.lead - z.j),
w AS (SELECT *, 100.5::DOUBLE - abs(j + lead - o + 1 - 100.5::DOUBLE) AS w FROM x),
p AS (SELECT song, lead, j, sum(w * v) / sum(w) AS v FROM w GROUP BY song, lead, j)
SELECT song, j, round(avg(p.v) * max(d) + max(m), 6) AS v FROM p JOIN st USING (song) GROUP BY song, j""")
def shifted_passes(spark, sf):
    """Two delayed passes over each label's vectors end to end, 200 samples every 150; each segment loses half its mirror image."""
    f = frames(spark, sf).select("song", "frame_idx", F.posexplode("x").alias("i", "v"))
    s = f.select("song", (F.col("frame_idx").cast("long") * 64 + F.col("i")).alias("j"), "v")
    mirrored = lambda x: F.zip_with(x, F.reverse(x), lambda v, w: v - w / 2)
    return G.shifted_passes(s, 200, 150, G.leads(2, 100), mirrored).select("song", "j", F.round("v", 6).alias("v"))
