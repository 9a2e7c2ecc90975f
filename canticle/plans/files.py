"""Song files and stores through the data sources: the query writes the events' songs as files and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canticle.plans import query
from canticle.plans.formats import BEATS, TIMED, even, timed
from canticle.plans.views import table
from canticle.sources import levels as L
from canticle.sources import lrc as R
from canticle.sources import songfiles as S
from canticle.storage import Scratch


def song_folder(spark, texts: DataFrame, name: str) -> str:
    """A folder with a file a song, of texts (song_id, text), a thousand neighbours to a folder below it."""
    S.register(spark)
    path = Scratch(spark, name).path("songs")
    named = F.concat(F.expr("coalesce(cast(song_id div 1000 as string), 'none')"), F.lit("/song_id="), F.coalesce(F.col("song_id").cast("string"), F.lit("none")), F.lit(".txt"))
    S.write_files(texts.select(named.alias("path"), F.encode("text", "UTF-8").alias("content")), path)
    return path


def song_of(path: str) -> F.Column:
    return F.regexp_extract(path, "song_id=(-?[0-9]+)", 1).try_cast("long")


@query("ultrastar_files", BEATS + " SELECT song_id, count(*) AS words, CAST(sum(beat) AS BIGINT) AS beats, CAST(sum(length) AS BIGINT) AS lengths, count(DISTINCT session) AS lines, string_agg(word, ' ' ORDER BY k) AS said FROM notes GROUP BY song_id")
def ultrastar_files(spark, sf):
    """Every song as an UltraStar file, read back through the data source: notes, their beats, lines and words."""
    folder = song_folder(spark, R.export(timed(spark, sf), "ultrastar"), "ultrastar")
    lines = spark.read.format("ultrastar").load(folder).where("error is null")
    n = R.note_rows(lines.withColumn("relative", F.lit(False))).where("error is null")
    said = F.array_join(R.in_order(F.trim("syllable"), "note_no"), " ")
    return n.groupBy(song_of("path").alias("song_id")).agg(F.count("*").alias("words"), F.sum("beat").alias("beats"), F.sum("length").alias("lengths"), F.count_distinct("line").alias("lines"), said.alias("said"))


@query("lrc_files", f"WITH {TIMED}, c AS (SELECT *, {even('sms', 10)} AS a FROM sessions) SELECT song_id, session AS line, CAST(greatest(arg_min(a, word_idx), 0) AS BIGINT) AS at_cs, string_agg(word, ' ' ORDER BY word_idx) AS said FROM c GROUP BY ALL")
def lrc_files(spark, sf):
    """Every song as an LRC file, read back through the data source: a row a lyric line, with its time."""
    folder = song_folder(spark, R.export(timed(spark, sf), "lrc"), "lrc")
    rows = spark.read.format("lrc").option("suffix", ".txt").load(folder).where("error is null and line != ''")
    tag = lambda k: F.regexp_extract("line", r"^\[([0-9]+):([0-9]+)\.([0-9]+)\]", k).cast("long")
    order = Window.partitionBy("path").orderBy("line_no")
    return rows.select(song_of("path").alias("song_id"), F.row_number().over(order).cast("long").alias("line"), (tag(1) * 6000 + tag(2) * 100 + tag(3)).alias("at_cs"), R.strip_tags(F.col("line")).alias("said"))


MAPPED = f"""{TIMED}, maps AS (SELECT song_id, word_idx, word, start, "end", unsung, ad_lib, song_id % 5 = 0 AND word_idx = 3 AS spoiled, max("end") OVER (PARTITION BY song_id) AS duration FROM timed)"""


def maps(spark, sf) -> tuple[DataFrame, DataFrame]:
    w = timed(spark, sf).withColumn("confidence", F.lit(0.5)).withColumn("word_in_line", F.lit(None).cast("int")).withColumn("line", F.lit(None).cast("int"))
    return w, w.groupBy("song_id").agg(F.max("end").alias("duration"))


@query("timing_map_files", f"""WITH {MAPPED}, s AS (SELECT song_id, count(*) AS words, any_value(duration) AS duration, sum(start) AS starts, count(*) FILTER (unsung) AS unsung FROM maps GROUP BY song_id)
SELECT song_id, CASE WHEN song_id % 4 = 1 THEN NULL WHEN song_id % 4 = 2 THEN NULL ELSE words END AS words, CASE WHEN song_id % 4 IN (1, 2) THEN NULL ELSE round(starts, 3) END AS starts, CASE WHEN song_id % 4 IN (1, 2) THEN NULL ELSE unsung END AS unsung,
 CASE song_id % 4 WHEN 1 THEN 'time base is not ''original-song''' WHEN 2 THEN 'not JSON' END AS error FROM s""")
def timing_map_files(spark, sf):
    """Every song's timing map as a JSON file, some on another time base and some cut short: words, or what is wrong."""
    text, k = F.col("content"), F.col("song_id")
    t = S.map_texts(*maps(spark, sf)).withColumn("song_id", F.col("key").cast("long"))
    t = t.select("song_id", F.when(k % 4 == 1, F.replace(text, F.lit("original-song"), F.lit("stretched"))).when(k % 4 == 2, F.substring("content", 1, 40)).otherwise(text).alias("text"))
    rows = spark.read.format("timingmap").option("suffix", ".txt").load(song_folder(spark, t, "maps"))
    good = F.col("error").isNull()
    return rows.groupBy(song_of("path").alias("song_id")).agg(
        F.when(F.bool_and(good), F.count("*")).alias("words"), F.round(F.sum("start"), 3).alias("starts"), F.when(F.bool_and(good), F.count_if("unsung")).alias("unsung"), F.max("error").alias("error")
    )


@query("map_store", f"WITH {MAPPED} SELECT CAST(song_id AS VARCHAR) AS key, CASE WHEN song_id % 3 = 0 THEN 2 ELSE 1 END AS version, count(*) FILTER (song_id % 3 > 0 OR word_idx % 2 = 0) AS words, round(sum(start) FILTER (song_id % 3 > 0 OR word_idx % 2 = 0), 3) AS starts FROM maps GROUP BY song_id")
def map_store(spark, sf):
    """Timing maps published to a store, every third song once more without its odd words: what the store then holds."""
    w, songs = maps(spark, sf)
    store = Scratch(spark, "map-store").path("store")
    S.publish(S.map_texts(w, songs), store)
    third = F.col("song_id") % 3 == 0
    S.publish(S.map_texts(w.where(third & (F.col("word_idx") % 2 == 0)), songs.where(third)), store)
    m = S.stored(spark, store).withColumn("map", F.from_json("content", "words array<struct<start double>>"))
    total = F.aggregate(F.col("map.words"), F.lit(0.0), lambda a, x: a + x["start"])
    return m.select("key", "version", F.size("map.words").cast("long").alias("words"), F.round(total, 3).alias("starts"))


@query("export_sidecars", f"""WITH {TIMED}, e AS (SELECT DISTINCT song_id, f.f AS format FROM timed, (VALUES ('lrc'), ('ass'), ('ultrastar')) f(f))
SELECT song_id, format, 'song' || song_id || '.' || CASE format WHEN 'ultrastar' THEN 'txt' ELSE format END AS path, sha256('map ' || song_id || CASE WHEN song_id % 2 = 0 AND format <> 'ass' THEN ' edited' ELSE '' END) AS map_sha256, CASE WHEN song_id % 2 = 0 AND format <> 'ass' THEN 2000 ELSE 1000 END AS written FROM e""")
def export_sidecars(spark, sf):
    """A sidecar a song of what was exported from which map: all formats once, then two of every second song after an edit."""
    ids = timed(spark, sf).select("song_id").distinct()
    store = Scratch(spark, "sidecars").path("store")
    k = F.col("song_id").cast("string")

    def entries(songs: DataFrame, formats: dict, note: str, at: int) -> DataFrame:
        e = songs.select("song_id", F.explode(F.create_map(*(F.lit(x) for pair in formats.items() for x in pair))).alias("format", "extension"))
        return e.select("song_id", "format", F.concat(F.lit("song"), k, F.lit("."), "extension").alias("path"), F.sha2(F.concat(F.lit("map "), k, F.lit(note)), 256).alias("map_sha256"), F.lit(at).alias("written"))

    def sidecars(rows: DataFrame) -> DataFrame:
        record = F.struct("path", "map_sha256", "written")
        all_ = F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", record.alias("r")))))
        return rows.groupBy("song_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), all_.alias("exports"))).alias("content")).select(k.alias("key"), "content")

    shape = "version int, exports map<string, struct<path string, map_sha256 string, written int>>"

    def read() -> DataFrame:
        m = S.stored(spark, store).select(F.col("key").cast("long").alias("song_id"), F.explode(F.from_json("content", shape)["exports"]).alias("format", "r"))
        return m.select("song_id", "format", "r.*")

    S.publish(sidecars(entries(ids, {"lrc": "lrc", "ass": "ass", "ultrastar": "txt"}, "", 1000)), store)
    new = entries(ids.where("song_id % 2 = 0"), {"lrc": "lrc", "ultrastar": "txt"}, " edited", 2000)
    kept = read().join(new.select("song_id").distinct(), "song_id", "left_semi").join(new, ["song_id", "format"], "left_anti")
    S.publish(sidecars(kept.unionByName(new)), store)
    return read()


@query("levels_cache", """WITH s AS (SELECT label AS song, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS f, embedding AS x, vec_id FROM embeddings),
v AS (SELECT song, f, f * len(x) + generate_subscripts(x, 1) - 1 AS j, CAST(unnest(x) AS DOUBLE) AS v FROM s),
c AS (SELECT song, j, CASE WHEN song % 3 = 0 AND f % 2 = 0 THEN v / 2 ELSE v END AS v FROM v),
b AS (SELECT song, j // 40 AS bin, max(abs(v)) AS p FROM c GROUP BY song, bin), t AS (SELECT *, max(p) OVER (PARTITION BY song) AS top FROM b),
n AS (SELECT label AS song, count(*) AS n, max(vec_id) AS m FROM embeddings GROUP BY label)
SELECT CAST(song AS VARCHAR) AS key, max(n) AS source_len, max(m + CASE WHEN song % 3 = 0 THEN 1 ELSE 0 END) AS source_mtime_unix, count(*) AS bins, CAST(sum(floor(p / top * 255 + 0.5)) AS BIGINT) AS peaks FROM t JOIN n USING (song) GROUP BY song""")
def levels_cache(spark, sf):
    """Envelopes of each label's vectors end to end, in a store; then every third label's change and the rest must come from the store, as their samples are gone."""
    e = table(spark, sf, "embeddings").withColumn("f", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    k = F.col("label").cast("string").alias("key")
    v = e.select(k, "f", "label", F.size("embedding").alias("n"), F.posexplode("embedding").alias("i", "v"))
    v = v.select("key", "label", "f", (F.col("f").cast("long") * F.col("n") + F.col("i")).alias("j"), F.col("v").cast("double").alias("v"))
    found = e.groupBy("label").agg(F.count("*").alias("source_len"), F.max("vec_id").alias("source_mtime_unix"))
    later = found.withColumn("source_mtime_unix", F.col("source_mtime_unix") + F.when(F.col("label") % 3 == 0, 1).otherwise(0))
    store = Scratch(spark, "levels-cache").path("store")
    L.refresh(spark, store, found.withColumn("key", k), v, 40)
    third = v.where("label % 3 = 0").withColumn("v", F.when(F.col("f") % 2 == 0, F.col("v") / 2).otherwise(F.col("v")))
    got = L.refresh(spark, store, later.withColumn("key", k), third, 40)
    return got.select("key", "source_len", "source_mtime_unix", F.size("peaks").cast("long").alias("bins"), L.total(F.col("peaks")).cast("long").alias("peaks"))
