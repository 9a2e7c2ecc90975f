"""Resolvers of files and lyrics, covers, the event channel and what follows an import."""

from __future__ import annotations

from pyspark.sql import functions as F

from canticle.operators import resolve as R
from canticle.plans import query
from canticle.plans.jobs import JOBS, job_reduce, jobs
from canticle.plans.views import COLL, LIB, NOW, coll, lib, table


def job_manifests(spark, sf):
    """The manifest in each part's job folder: every fifth is missing, every third is of another map."""
    i = F.col("p_partkey")
    folder = F.concat(F.lit("jobs/"), i.cast("string"))
    return table(spark, sf, "part").where(i % 5 != 0).select(
        folder.alias("folder"), F.concat(folder, F.when(i % 3 == 0, "/other.json").otherwise("/map.json")).alias("map"),
        *(F.concat(folder, F.lit(f"/{r}.wav")).alias(r) for r in ("instrumental", "vocals")), F.concat(F.lit("in/"), i.cast("string")).alias("original"),
        F.when(i % 4 != 0, F.concat(folder, F.lit("/lyrics.txt"))).alias("lyrics_path"),
    )


@query("playable_sources", f"""WITH {LIB}, a AS (SELECT p_partkey AS ask, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + p_partkey % 3 * 1000000 END AS song_id, CASE WHEN p_partkey % 4 < 3 THEN 'jobs/' || p_partkey || '/map.json' END AS map_path FROM part),
f AS (SELECT unnest([vocals_path, instrumental_path, audio_path]) AS path FROM lib WHERE id % 7 <> 0),
r AS (SELECT a.ask, CASE WHEN a.song_id IS NOT NULL THEN CASE WHEN l.id IS NULL THEN 'no song' ELSE 'ok' END WHEN map_path IS NULL THEN 'nothing' WHEN ask % 5 = 0 THEN 'no manifest' WHEN ask % 3 = 0 THEN 'not its map' ELSE 'ok' END AS outcome,
 CASE WHEN a.song_id IS NOT NULL THEN l.instrumental_path ELSE 'jobs/' || ask || '/instrumental.wav' END AS i, CASE WHEN a.song_id IS NOT NULL THEN l.vocals_path ELSE 'jobs/' || ask || '/vocals.wav' END AS v, CASE WHEN a.song_id IS NOT NULL THEN l.audio_path ELSE 'in/' || ask END AS o
 FROM a LEFT JOIN lib l ON l.id = a.song_id)
SELECT ask, outcome, CASE WHEN outcome = 'ok' AND i IN (SELECT path FROM f WHERE path IS NOT NULL) THEN i END AS instrumental, CASE WHEN outcome = 'ok' AND v IN (SELECT path FROM f WHERE path IS NOT NULL) THEN v END AS vocals, CASE WHEN outcome = 'ok' AND o IN (SELECT path FROM f WHERE path IS NOT NULL) THEN o END AS original FROM r""")
def playable_sources(spark, sf):
    """Files to play by library id or by map; every seventh song's are gone."""
    i = F.col("p_partkey")
    asks = table(spark, sf, "part").select(i.alias("ask"), F.when(i % 4 == 0, i + i % 3 * 1000000).alias("song_id"), F.when(i % 4 < 3, F.concat(F.lit("jobs/"), i.cast("string"), F.lit("/map.json"))).alias("map_path"))
    songs = lib(spark, sf).select("id", F.col("instrumental_path").alias("instrumental"), F.col("vocals_path").alias("vocals"), F.col("audio_path").alias("original"))
    files = songs.where("id % 7 <> 0").select(F.explode(F.array("vocals", "instrumental", "original")).alias("path"))
    return R.playable(asks, songs, job_manifests(spark, sf), files)


@query("job_lyrics", "SELECT 'jobs/' || p_partkey AS folder, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 5 = 0 THEN 'pasted ' || p_name WHEN p_partkey % 4 <> 0 THEN 'used ' || p_name END AS lyrics FROM part")
def job_lyrics(spark, sf):
    """The lyrics that each job last ran with; every seventh job's files are gone."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("jobs/"), F.col("p_partkey").cast("string")).alias("folder"), "p_name")
    kinds = F.array(*(F.struct(F.lit(a).alias("end"), F.lit(b).alias("word")) for a, b in ((f"/{R.PASTED}", "pasted "), ("/lyrics.txt", "used "))))
    texts = p.where("p_partkey % 7 <> 6").withColumn("k", F.explode(kinds)).select(F.concat("folder", "k.end").alias("path"), F.concat("k.word", "p_name").alias("text"))
    return R.last_lyrics(p.select("folder"), job_manifests(spark, sf), texts)


CHOICES = """c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END || '/' || p_name || '.' || p_partkey || '.mp3' AS path, p_partkey % 3 > 0 AS checked,
 CASE WHEN p_partkey % 5 > 0 THEN p_name WHEN p_partkey % 2 = 0 THEN ' ' END AS lyrics, CASE WHEN p_partkey % 7 > 0 THEN p_type ELSE '' END AS collection, p_partkey % 4 = 0 AS in_library FROM part)"""


def candidates(spark, sf):
    """A song a part, in folders with either separator; every fourth is in the library under another case."""
    i = F.col("p_partkey")
    path = lambda slash, brand: F.concat(brand, F.lit(slash), "p_name", F.lit("."), i.cast("string"), F.lit(".mp3"))
    p = table(spark, sf, "part")
    c = p.select(i.alias("id"), path("/", F.when(i % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))).alias("path"), (i % 3 > 0).alias("checked"), F.when(i % 5 > 0, F.col("p_name")).when(i % 2 == 0, " ").alias("lyrics"), F.when(i % 7 > 0, F.col("p_type")).otherwise("").alias("collection"))
    return c, p.where(i % 4 == 0).select(path("\\", F.lower("p_brand")).alias("path"))


@query("import_known", f"WITH {CHOICES} SELECT id, path, in_library, id % 4 = 0 AS downloaded FROM c")
def import_known(spark, sf):
    """Which candidates the library has, by path, and by path without extension for links that are yet to be downloaded."""
    c, songs = candidates(spark, sf)
    links = R.in_library(c.select("id", F.regexp_replace("path", r"\.mp3$", "").alias("path")), songs, stems=True).select("id", F.col("in_library").alias("downloaded"))
    return R.in_library(c, songs).select("id", "path", "in_library").join(links, "id")


@query("import_choice", f"WITH {CHOICES}, n AS (SELECT count(*) FILTER (checked) AS n, count(*) FILTER (checked AND trim(coalesce(lyrics, '')) <> '') AS with_lyrics, count(*) FILTER (checked AND trim(coalesce(lyrics, '')) = '') AS transcribe, count(*) FILTER (in_library AND NOT checked) AS skipped, count(DISTINCT collection) FILTER (checked AND collection <> '') AS k FROM c) SELECT u AS use_collections, n, with_lyrics, transcribe, skipped, CASE WHEN u THEN k ELSE 0 END AS collections FROM n, (VALUES (true), (false)) v(u)")
def import_choice(spark, sf):
    """What an import of the checked candidates does, into collections or not."""
    c = R.in_library(*candidates(spark, sf))
    with_, without = (R.import_choice(c, u).withColumn("use_collections", F.lit(u)) for u in (True, False))
    return with_.unionByName(without)


@query("accuracy_targets", """WITH p AS (SELECT p_partkey AS ask, p_partkey % 7 AS k, p_partkey % 3 = 0 AS bare, p_name AS n FROM part)
SELECT ask, CASE k WHEN 0 THEN 'job' WHEN 1 THEN 'job' WHEN 2 THEN 'map' WHEN 3 THEN 'audio' WHEN 4 THEN 'none' WHEN 5 THEN 'job' ELSE 'audio' END AS kind,
 CASE WHEN k IN (0, 1, 3) AND NOT bare THEN n || '.' || ask WHEN k = 2 THEN n END AS name, CASE WHEN k IN (0, 1) AND NOT bare THEN 'jobs/' || ask || '/1.align.json' WHEN k = 2 THEN 'maps/' || n || '.align.json.align.json' WHEN k = 3 AND NOT bare THEN 'jobs/' || ask || '/2.align.json' END AS map,
 CASE WHEN k = 4 THEN 'not a job, a timing map or a song' WHEN k = 5 THEN 'no manifest' WHEN k IN (0, 1) AND bare THEN 'not aligned yet' WHEN k = 6 OR k = 3 AND bare THEN 'no job of this song' END AS error FROM p""")
def accuracy_targets(spark, sf):
    """A target a part: job folders, manifests, maps, songs and other files; every third job has no map, songs have two jobs."""
    i, k = F.col("p_partkey"), F.col("p_partkey") % 7
    text = i.cast("string")
    folder, song = F.concat(F.lit("jobs/"), text), F.concat(F.lit("in/"), "p_name", F.lit("."), text, F.lit(".mp3"))
    path = F.when(k.isin(0, 5), folder).when(k == 1, F.concat(folder, F.lit("/job.json"))).when(k == 2, F.concat(F.lit("maps/"), "p_name", F.lit(".align.json.align.json")))
    path = path.when(k.isin(3, 6), song).otherwise(F.concat(F.lit("in/"), text, F.lit(".pdf")))
    p = table(spark, sf, "part")
    created = F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    m = p.where(~k.isin(5, 6)).withColumn("created", F.explode(created))
    file = F.concat(folder, F.when(F.col("created") == 2, "/again").otherwise(""), F.lit("/job.json"))
    m = m.select(file.alias("path"), song.alias("audio"), F.when(i % 3 != 0, F.concat(folder, F.lit("/"), F.col("created").cast("string"), F.lit(".align.json"))).alias("map"), "created")
    return R.targets(p.select(i.alias("ask"), path.alias("path"), k.isin(0, 5).alias("is_dir")), m)


#: A suite's files, and which of them belong together.
SUITE = ["s/a.mp3", "s/a.txt", "s/a.ultrastar.txt", "s/a.lyrics.txt", "s/b.flac", "s/b.txt", "s/c.WAV", "s/c.lyrics.txt", "s/d.txt", "t/d.ogg", "s/E.m4a", "s/e.UltraStar.txt"]
BESIDE = "(VALUES ('s/a.mp3', 's/a.ultrastar.txt', 's/a.lyrics.txt'), ('s/b.flac', 's/b.txt', NULL), ('s/c.WAV', NULL, 's/c.lyrics.txt'), ('t/d.ogg', NULL, NULL), ('s/E.m4a', 's/e.UltraStar.txt', NULL)) AS v(audio, reference, lyrics)"


@query("suite_pairs", f"SELECT s_suppkey || '/' || audio AS audio, s_suppkey || '/' || reference AS reference, s_suppkey || '/' || lyrics AS lyrics FROM supplier, {BESIDE}")
def suite_pairs(spark, sf):
    """Songs of an accuracy suite a supplier, with their references."""
    paths = table(spark, sf, "supplier").select(F.explode(F.array(*map(F.lit, SUITE))).alias("path"), F.col("s_suppkey").cast("string").alias("k"))
    return R.suite(paths.select(F.concat("k", F.lit("/"), "path").alias("path")))


TEXT = r'{"audio":"D:\\Old Songs\\{n}\\a.mp3","dir":"d:/old songs/{n}","root":"D:\\OLD SONGS","other":"D:\\Old Songs 2\\x","note":"see D:/Old Songs/"}'


@query("json_paths", r"""SELECT p_partkey AS id, '{"audio":"E:\\Neu\\' || p_brand || '\\a.mp3","dir":"E:/Neu/' || p_brand || '","root":"E:\\Neu","other":"D:\\Old Songs 2\\x","note":"see D:/Old Songs/"}' AS text, 3 AS n FROM part""")
def json_paths(spark, sf):
    """Job files whose folder has moved: strings that start with it are rewritten, with either separator."""
    text, n = R.rewrite_json(F.replace(F.lit(TEXT), F.lit("{n}"), F.col("p_brand")), "D:\\Old Songs\\", "E:\\Neu")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), n.alias("n"))


@query("cover_names", "WITH c AS (SELECT p_partkey AS id, left(sha256(p_brand), 16) || CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.img' END AS file FROM part) SELECT id, file, count(*) OVER (PARTITION BY file) AS shared FROM c")
def cover_names(spark, sf):
    """Covers named by their content, and how many songs share each file; the file is written once."""
    i = F.col("p_partkey")
    mime = F.when(i % 3 == 0, "image/jpeg").when(i % 3 == 1, "image/png")
    named, files = R.cover_files(table(spark, sf, "part").select(i.alias("id"), mime.alias("mime"), F.col("p_brand").cast("binary").alias("data")))
    shared = named.groupBy("file").agg(F.count("*").alias("shared"))
    return named.select("id", "file").join(files.select("file"), "file").join(shared, "file")


REDUCED = "r AS (SELECT job, arg_max(status, [rank, us, event_id]) AS status FROM jobs GROUP BY job)"


@query("unfinished_jobs", f"WITH {JOBS}, s AS (SELECT event_id // 3 AS job, arg_max(status, [rank, us, event_id]) AS status FROM jobs GROUP BY 1) SELECT job, status FROM s WHERE status IN ('queued', 'running') AND job % 9 <> 0")
def unfinished_jobs(spark, sf):
    """What the queue file holds: jobs (three events each) that wait or run and were not asked to stop, as every ninth was."""
    j = jobs(spark, sf).groupBy(F.floor(F.col("event_id") / 3).alias("job")).agg(F.max_by("status", F.struct("rank", "us", "event_id")).alias("status"))
    return R.unfinished(j.withColumn("cancel_requested", F.col("job") % 9 == 0)).select("job", "status")


@query("event_channel", f"""WITH {JOBS}, {REDUCED} SELECT -1 AS seq, job AS job_id, '{{"kind":"lifecycle","job_id":' || job || ',"status":"' || status || '"}}' AS payload FROM r
UNION ALL SELECT event_id, job, '{{"kind":"pipeline","job_id":' || job || ',"event":"' || event_type || '"}}' FROM jobs WHERE event_id % 2 = 0
UNION ALL SELECT event_id, job, '{{"kind":"prep","job_id":' || job || ',"step":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN ',"percent":' || (event_id % 100) ELSE '' END || '}}' FROM jobs WHERE event_id % 2 = 1""")
def event_channel(spark, sf):
    """States, events and preparation of jobs on one channel."""
    e = jobs(spark, sf).select(F.col("event_id").alias("seq"), F.col("job").alias("job_id"), "event_type")
    states = job_reduce(spark, sf).select(F.lit(-1).cast("long").alias("seq"), F.col("job").alias("job_id"), "status")
    percent = F.when(F.col("seq") % 3 == 0, F.col("seq") % 100).alias("percent")
    return R.channel(states, e.where("seq % 2 = 0").withColumnRenamed("event_type", "event"), e.where("seq % 2 = 1").select("seq", "job_id", F.col("event_type").alias("step"), percent))


@query("post_import", f"""WITH {LIB}, {COLL}, p AS (SELECT id, CASE id % 4 WHEN 0 THEN ' supplier#00000000' || (1 + id % 9) || ' ' WHEN 1 THEN ' ' WHEN 2 THEN 'New ' || (id % 5) END AS name FROM lib WHERE id % 6 <> 5),
m AS (SELECT lower(trim(name)) AS fold, min(id) AS cid FROM coll GROUP BY 1)
SELECT l.id, m.cid AS collection_id, CASE WHEN trim(p.name) <> '' THEN CASE WHEN m.cid IS NULL THEN 'create' ELSE 'use' END END AS outcome, CASE WHEN p.id IS NOT NULL AND l.id % 2 = 0 THEN {NOW} ELSE reviewed_at END AS reviewed_at,
 CASE WHEN p.id IS NOT NULL AND l.id % 3 = 0 THEN 2001 ELSE year END AS year, CASE WHEN p.id IS NOT NULL AND l.id % 5 = 0 THEN 'Pop' ELSE genre END AS genre, CASE WHEN p.id IS NOT NULL AND l.id % 7 = 0 THEN 'it' ELSE language_tag END AS language_tag
FROM lib l LEFT JOIN p USING (id) LEFT JOIN m ON m.fold = lower(trim(p.name))""")
def post_import(spark, sf):
    """Songs after their import: put into collections, checked, and with the facts that came along."""
    songs, i = lib(spark, sf), F.col("id")
    name = F.when(i % 4 == 0, F.concat(F.lit(" supplier#00000000"), (1 + i % 9).cast("string"), F.lit(" "))).when(i % 4 == 1, " ").when(i % 4 == 2, F.concat(F.lit("New "), (i % 5).cast("string")))
    posts = songs.where(i % 6 != 5).select("id", name.alias("collection"), (i % 2 == 0).alias("checked"), F.when(i % 3 == 0, 2001).alias("year"), F.when(i % 5 == 0, "Pop").alias("genre"), F.when(i % 7 == 0, "it").alias("language"))
    return R.post_import(songs, posts, coll(spark, sf), NOW).select("id", "collection_id", "outcome", "reviewed_at", "year", "genre", "language_tag")
