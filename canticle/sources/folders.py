"""Song folders: which files are songs and lyrics, what a lyrics file is, and which song it belongs to.

Files come as rows (path, content), as Spark's binaryFile source gives them, so any store that Spark reads will do.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canticle.functions.text import clean_genre, filename_title, header, headers, language_tag, plausible_year
from canticle.sources import lrc
from canticle.sources.songfiles import opened
from canticle.storage import Scratch, large

# Extensions of songs, those that cannot be decoded among them, and names that are never lyrics.
AUDIO = ("mp3", "flac", "wav", "m4a", "ogg", "aac", "aiff", "aif", "mp4", "m4v", "mov", "mkv")
UNSUPPORTED = ("wma", "opus", "webm")
NOT_LYRICS = ("readme", "read me", "license", "licence", "copying", "changelog")
MANIFEST = "job.json"
DEEPEST = 12


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, content and length of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", "length")


#: Bytes of contents that a task reads before it passes them on.
READ_BYTES = 4 << 20


def reachable(root: str) -> bool:
    """Whether tasks can open a root themselves; other stores are left to Spark's own readers."""
    try:
        opened(root)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def entries(root: str):
    """A map over batches of folders (below a root, as text) to what is in them: path below the root, length, and whether it is a folder."""

    def run(batches):
        from pyarrow import fs

        system, base = opened(root)
        for b in batches:
            for below in b.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(base.rstrip("/") + below or "/", allow_not_found=below != ""))
                kept = [f for f in found if not hidden(f.base_name)]
                for k in range(0, len(kept), 10_000):
                    some = kept[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{below}/{f.base_name}" for f in some], pa.string()), pa.array([f.size if f.is_file else None for f in some], pa.int64()), pa.array([not f.is_file for f in some], pa.bool_())],
                        names=["below", "length", "is_folder"],
                    )

    return run


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below a folder; no file is opened.

    Tasks list folders, a level of the tree at a time, so the driver holds no names.
    """
    if not reachable(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    scratch, levels, tasks = Scratch(spark, "listing"), [], spark.sparkContext.defaultParallelism * 4
    level = spark.createDataFrame([("",)], "below string")
    while not level.isEmpty():
        found = scratch.table(level.mapInArrow(entries(root), "below string, length long, is_folder boolean"), f"level-{len(levels)}")
        levels.append(found)
        level = found.where("is_folder").select("below").repartition(tasks)
    rows = functools.reduce(DataFrame.unionByName, levels).where("not is_folder")
    return rows.select(F.concat(F.lit(root.rstrip("/")), "below").alias("path"), "length")


def with_contents(spark: SparkSession, root: str, lyrics: DataFrame) -> DataFrame:
    """Lyric files of a scan with their contents; only files with an extension of lyrics are opened, by the tasks that have their rows."""
    if not reachable(root):
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[tT][xX][tT],[lL][rR][cC]}").load(root)
        return lyrics.join(texts.select("path", "content"), "path")
    place = lyrics.columns.index("path")
    schema = T.StructType([*lyrics.schema.fields, T.StructField("content", T.BinaryType())])
    start, names = len(root.rstrip("/")), schema.names

    def run(batches):
        system, base = opened(root)
        for b in batches:
            rows, contents, size = [], [], 0
            for k, path in enumerate(b.column(place).to_pylist()):
                try:
                    with system.open_input_stream(base.rstrip("/") + path[start:]) as f:
                        contents.append(f.read())
                    rows.append(k)
                    size += len(contents[-1])
                except FileNotFoundError:
                    pass
                if size >= READ_BYTES or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(contents, pa.binary())], names=names)
                    rows, contents, size = [], [], 0

    tasks = spark.sparkContext.defaultParallelism * 4
    return lyrics.repartition(tasks, "path").mapInArrow(run, schema)


def root_of(found: DataFrame) -> str:
    """The root of a scan, spelled as its paths are."""
    return found._root


def parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder, name and stem, and the extension last, of a path with either separator; the latter three folded."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.lower(F.substring_index(flat, "/", -1))
    return F.regexp_replace(flat, "/[^/]*$", ""), name, F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r".\.([^.]*)$", 1)


def spelled(found: DataFrame, root: str) -> str:
    """A root as Spark's own listing spells it, with a scheme, where the paths have one."""
    first = found.select("path").first()
    scheme = "" if first is None or not (at := first["path"].find(root.removeprefix("file://").removeprefix("file:"))) > 0 else first["path"][:at]
    return scheme + root.removeprefix("file://").removeprefix("file:") if scheme else root


def scan(found: DataFrame, root: str) -> DataFrame:
    """The song and lyric files (path, folder, name, stem, kind, ...) below a root; each path once, whatever its case.

    Left out: hidden files and folders, folders below DEEPEST, what jobs have put out (folders that end in -karaoke or
    hold a manifest, and all below them), and names that are never lyrics.  kind is audio or lyrics.
    """
    folder, name, stem = parts(F.col("path"))
    root = spelled(found, root)
    rows = found.withColumn("folder", folder).withColumn("name", name).withColumn("stem", stem)
    below = F.regexp_replace(F.substring(F.col("folder"), len(root.rstrip("/")) + 1, 1 << 20), "^/", "")
    steps = F.filter(F.split(below, "/"), lambda x: x != "")
    rows = rows.withColumn("steps", steps).where((F.size("steps") <= DEEPEST) & ~F.col("name").startswith(".") & ~F.exists("steps", lambda x: x.startswith(".") | F.lower(x).endswith("-karaoke")))
    # A folder with a manifest and all folders below it: every folder of a path is looked up.
    jobs = rows.where(F.col("name") == MANIFEST).select(F.lower("folder").alias("_job")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda k: F.lower(F.concat_ws("/", F.lit(root.rstrip("/")), F.array_join(F.slice("steps", F.lit(1), k), "/"))))
    ups = rows.select("path", F.explode(F.transform(above, lambda x: F.regexp_replace(x, "/$", ""))).alias("_up"))
    inside = ups.join(large(jobs), F.col("_up") == F.col("_job"), "left_semi").select(F.lower("path").alias("_key")).distinct()
    rows = rows.drop("steps").withColumn("_key", F.lower("path")).join(large(inside), "_key", "left_anti")
    ext = extension(F.col("name"))
    lyrics = ext.isin("txt", "lrc") & ~F.col("stem").isin(*NOT_LYRICS)
    rows = rows.withColumn("kind", F.when(ext.isin(*AUDIO, *UNSUPPORTED), "audio").when(lyrics, "lyrics")).where("kind is not null")
    first = rows.groupBy("_key").agg(F.min("path").alias("path"))
    out = rows.join(large(first.select("path")), "path", "left_semi").withColumn("playable", ~ext.isin(*UNSUPPORTED)).drop("_key")
    out = Scratch(found.sparkSession, "folders").table(out, "scan")
    out._root = root.rstrip("/")
    return out


def inspect(lyrics: DataFrame) -> DataFrame:
    """Lyric files with what they are: lrc, ultrastar, text, empty or unreadable; their headers, title and artist, and why a song cannot be read."""
    scratch = Scratch(lyrics.sparkSession, "folders")
    rows = scratch.table(lyrics.withColumn("text", lrc.decode(F.col("content"))), "texts")
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    top = F.slice(lines, 1, 40)
    song = F.get(top, F.lit(0)).startswith("#") & F.exists(top, lambda x: F.upper(x).startswith("#TITLE:") | F.upper(x).startswith("#BPM:"))
    what = F.when(F.col("text").isNull(), "unreadable").when(extension(F.col("name")) == "lrc", "lrc").when(F.coalesce(song, F.lit(False)), "ultrastar").when(F.size(lines) == 0, "empty").otherwise("text")
    rows = rows.withColumn("what", what).withColumn("headers", F.when(F.col("what") == "ultrastar", headers(F.col("text"))))
    rows = scratch.table(rows, "kinds")
    tagged = lrc.read_lrc(rows.where("what = 'lrc'")).select("path", F.col("text").alias("lrc_text"), F.col("title").alias("lrc_title"), F.col("artist").alias("lrc_artist"))
    bad = lrc.read_ultrastar(rows.where("what = 'ultrastar'")).groupBy("path").agg(F.max("error").alias("reason"))
    return scratch.table(rows.join(large(tagged), "path", "left").join(large(bad), "path", "left"), "lyrics")


def pair(audio: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Each song of a folder with its lyric file (song, lyric), each side once at most; songs without one have a null.

    First a song file names its audio in a header; then equal names (.txt, .lyrics.txt, .lrc, in this order); last the
    only song of a folder gets the only file that is left and not empty.
    """
    a = audio.select("folder", F.col("path").alias("song"), "name", "stem")
    c = lyrics.select("folder", F.col("path").alias("lyric"), F.col("name").alias("lyric_name"), "what", F.lower(F.coalesce(header(F.col("headers"), "AUDIO"), header(F.col("headers"), "MP3"))).alias("named"))
    mine = lambda p: p.groupBy("song").agg(F.min_by("lyric", F.struct("rank", F.lower("lyric"))).alias("lyric"))
    one = mine(c.where("named is not null").join(large(a), [c["folder"] == a["folder"], c["named"] == a["name"]]).select("song", "lyric", F.lit(0).alias("rank")))
    scratch = Scratch(audio.sparkSession, "folders")
    one = scratch.table(one, "named")
    left, free = a.join(large(one), "song", "left_anti"), c.join(large(one), "lyric", "left_anti")
    # Songs of one stem want the same files in the same order, so the k-th of them gets the k-th file.
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.concat("stem", F.lit(x)).alias("wanted")) for k, x in enumerate((".txt", ".lyrics.txt", ".lrc")))))
    same = Window.partitionBy("folder", "stem")
    queue = left.withColumn("k", F.row_number().over(same.orderBy(F.lower("song"))))
    wants = left.select("folder", "stem").distinct().withColumn("w", ends).select("folder", "stem", "w.*")
    given = wants.join(large(free.select(F.col("folder").alias("_in"), "lyric", "lyric_name")), [F.col("folder") == F.col("_in"), F.col("wanted") == F.col("lyric_name")])
    given = given.withColumn("k", F.row_number().over(same.orderBy("rank", F.lower("lyric")))).select("folder", "stem", "k", "lyric", "rank")
    two = queue.join(large(given), ["folder", "stem", "k"])
    two = two.groupBy("lyric").agg(F.min_by("song", F.lower("song")).alias("song")).select("song", "lyric")
    two = scratch.table(two, "alike")
    single = a.groupBy("folder").agg(F.count("*").alias("n"), F.min("song").alias("song")).where("n = 1").join(large(two), "song", "left_anti").join(large(one), "song", "left_anti")
    rest = free.where("what not in ('empty', 'unreadable')").join(large(two), "lyric", "left_anti").groupBy("folder").agg(F.count("*").alias("m"), F.min("lyric").alias("lyric")).where("m = 1")
    three = single.join(large(rest), "folder").select("song", "lyric")
    return a.select("song").join(large(one.unionByName(two).unionByName(three)), "song", "left")


def songs(audio: DataFrame, lyrics: DataFrame, tags: DataFrame) -> DataFrame:
    """song, lyric, kind of lyrics, title, artist, title_source, year, genre and language of each song.

    Title: a song file's header beats the tags (path, title, artist), those an LRC's, that the file name; the artist by
    itself in the same order.
    """
    c = lyrics.select(F.col("path").alias("lyric"), "what", "headers", "lrc_text", "lrc_title", "lrc_artist", "reason")
    t = tags.select(F.col("path").alias("song"), F.nullif(F.trim("title"), F.lit("")).alias("tag_title"), F.nullif(F.trim("artist"), F.lit("")).alias("tag_artist"))
    rows = pair(audio, lyrics).join(large(c), "lyric", "left").join(large(t), "song", "left")
    bare = F.regexp_replace(F.regexp_replace(F.replace("song", F.lit("\\"), F.lit("/")), "^.*/", ""), r"(.)\.[^.]*$", "$1")
    file_artist, file_title = filename_title(bare)
    h = lambda k: F.when(F.col("headers").isNotNull(), header(F.col("headers"), k))
    titles = (("ultrastar", h("TITLE")), ("tags", F.col("tag_title")), ("lrc", F.col("lrc_title")), ("filename", file_title))
    source = F.coalesce(*(F.when(v.isNotNull(), F.lit(k)) for k, v in titles))
    what = F.col("what")
    kind = F.when((what == "ultrastar") & F.col("reason").isNull(), "ultrastar").when(what == "ultrastar", "unreadable").when((what == "lrc") & (F.col("lrc_text") != ""), "lrc").when(what == "text", "text").otherwise("none")
    return rows.select(
        "song", "lyric", kind.alias("kind"), F.coalesce(*(v for _, v in titles)).alias("title"), F.coalesce(h("ARTIST"), "tag_artist", "lrc_artist", file_artist).alias("artist"), source.alias("title_source"),
        plausible_year(F.left(h("YEAR"), F.lit(4)).try_cast("int")).alias("year"), clean_genre(h("GENRE")).alias("genre"), language_tag(h("LANGUAGE")).alias("language"), F.col("reason").alias("error"),
    )


def unclaimed(lyrics: DataFrame, paired: DataFrame) -> DataFrame:
    """Lyric files that no song claimed, empty ones left out."""
    return lyrics.where("what <> 'empty'").join(large(paired.select(F.col("lyric").alias("path"))), "path", "left_anti").select("path")


def collections(found: DataFrame, root: str) -> DataFrame:
    """song and the collection that its folder makes: the folder's name, or its parent's where the song is alone in it.

    Songs at the root have none, unless all are there: then the root names one.
    """
    base = root.rstrip("/")
    n = F.count("*").over(Window.partitionBy("folder"))
    own = F.when((n == 1) & (F.lower("folder") != base.lower()), F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.col("folder"))
    homes = found.where("kind = 'audio'").select(F.col("path").alias("song"), own.alias("home"), F.lit(1).alias("_one"))
    flat = homes.groupBy("_one").agg(F.bool_and(F.lower("home") == base.lower()).alias("flat"))
    named = F.nullif(F.substring_index("home", "/", -1), F.lit(""))
    return homes.join(F.broadcast(flat), "_one").select("song", F.when((F.lower("home") != base.lower()) | F.col("flat"), named).alias("collection"))
