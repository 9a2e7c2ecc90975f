"""Which files, lyrics and records belong to a song or a job, as joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.functions.text import ascii_fold
from canticle.operators.library import create_collections
from canticle.sources.folders import AUDIO, MANIFEST, UNSUPPORTED, extension, parts

ROLES = ("instrumental", "vocals", "original")
#: The lyrics that were pasted for a job, in its folder.
PASTED = "pasted-lyrics.txt"
#: How the name of a file with a timing map ends.
ALIGNED = ".align.json"
# Extensions of covers by media type; others are img.
COVERS = {"image/jpeg": "jpg", "image/png": "png", "image/bmp": "bmp", "image/gif": "gif", "image/tiff": "tiff", "image/webp": "webp"}


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def spread(key: Column, own: Column) -> Column:
    """A join key that meets nothing where it is null, but is a row's own there, so rows without a key are not all dealt to one task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), own.cast("string")))


def playable(asks: DataFrame, songs: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """ask, outcome and the files (null where they are gone) that may be played for each ask (ask, song_id, map_path).

    A library id is looked up among songs (id and one path a role); without one, the manifest (folder, map and one path
    a role) in the map's folder answers, if that map is its own.  outcome: ok, no song, no manifest, not its map, nothing.
    """
    s = songs.select(F.col("id").cast("string").alias("_id"), *(F.col(r).alias(f"s_{r}") for r in ROLES), F.lit(True).alias("_song"))
    m = manifests.select(F.col("folder").alias("_folder"), F.col("map").alias("_map"), *(F.col(r).alias(f"m_{r}") for r in ROLES), F.lit(True).alias("_man"))
    folder = F.when(F.col("song_id").isNull(), folder_of(F.col("map_path")))
    rows = asks.withColumn("_id", spread(F.col("song_id"), F.col("ask"))).withColumn("_folder", spread(folder, F.col("ask"))).join(s, "_id", "left").join(m, "_folder", "left")
    by_id = F.col("song_id").isNotNull()
    outcome = F.when(by_id, F.when(F.col("_song"), "ok").otherwise("no song")).when(F.col("map_path").isNull(), "nothing").when(F.col("_man").isNull(), "no manifest")
    rows = rows.withColumn("outcome", outcome.when(F.col("_map").eqNullSafe(F.col("map_path")), "ok").otherwise("not its map"))
    wanted = F.array(*(F.struct(F.lit(r).alias("role"), F.when(F.col("outcome") == "ok", F.when(by_id, F.col(f"s_{r}")).otherwise(F.col(f"m_{r}"))).alias("path")) for r in ROLES))
    each = rows.select("ask", "outcome", F.explode(wanted).alias("w")).select("ask", "outcome", "w.role", "w.path")
    there = files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    each = each.withColumn("_path", spread(F.col("path"), F.col("ask"))).join(there, "_path", "left")
    return each.groupBy("ask", "outcome").agg(*(F.max(F.when((F.col("role") == r) & F.col("_there"), F.col("path"))).alias(r) for r in ROLES))


def targets(asks: DataFrame, manifests: DataFrame) -> DataFrame:
    """ask, kind, name, map and error of each accuracy target (ask, path, is_dir).

    kind: job (a job's folder or its manifest), map (a timing map), audio (graded by the newest job of that file) or none.
    manifests: path, audio, map (null where the job has not been aligned) and created.  A name is the audio's, or the map's
    file name, without its extension.  Targets meet manifests by two equal-key joins, each a target at most once.
    """
    name = F.substring_index("path", "/", -1)
    stem = lambda p: F.regexp_replace(F.substring_index(p, "/", -1), r"(.)\.[^.]*$", "$1")
    kind = F.when(F.col("is_dir") | (name == MANIFEST), "job").when(name.endswith(ALIGNED), "map").when(extension(F.lower(name)).isin(*AUDIO), "audio").otherwise("none")
    rows = asks.withColumn("kind", kind)
    by_file = F.when(F.col("kind") == "job", F.when(F.col("is_dir"), F.concat("path", F.lit(f"/{MANIFEST}"))).otherwise(F.col("path")))
    rows = rows.withColumn("_file", by_file).withColumn("_audio", F.when(F.col("kind") == "audio", F.col("path")))
    own = manifests.groupBy(F.col("path").alias("_file")).agg(F.max_by(F.struct("audio", "map"), "created").alias("own"))
    newest = manifests.where("map IS NOT NULL").groupBy(F.col("audio").alias("_audio")).agg(F.max_by("map", F.struct("created", "path")).alias("_newest"))
    rows = rows.join(own, "_file", "left").join(newest, "_audio", "left")
    job, audio = F.col("kind") == "job", F.col("kind") == "audio"
    found = F.when(job, F.col("own.map")).when(audio, F.col("_newest")).when(F.col("kind") == "map", F.col("path"))
    called = F.when(job, stem(F.col("own.audio"))).when(audio, stem(F.col("path"))).when(F.col("kind") == "map", F.regexp_replace(name, rf"({re.escape(ALIGNED)})+$", ""))
    error = F.when(F.col("kind") == "none", "not a job, a timing map or a song").when(job & F.col("own").isNull(), "no manifest").when(job & F.col("own.map").isNull(), "not aligned yet").when(audio & F.col("_newest").isNull(), "no job of this song")
    return rows.select("ask", "kind", F.when(error.isNull(), called).alias("name"), found.alias("map"), error.alias("error"))


def last_lyrics(jobs: DataFrame, manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """folder and lyrics of each job's last run: those of its manifest (folder, lyrics_path), even if it had none; without a manifest, the pasted file."""
    m = manifests.select("folder", "lyrics_path", F.lit(True).alias("_man"))
    path = F.when(F.col("_man"), F.col("lyrics_path")).otherwise(F.concat("folder", F.lit(f"/{PASTED}")))
    return jobs.join(m, "folder", "left").withColumn("path", path).join(texts.select("path", "text"), "path", "left").select("folder", F.col("text").alias("lyrics"))


def path_key(path: Column) -> Column:
    """A path as paths are compared: either separator, any case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def in_library(candidates: DataFrame, songs: DataFrame, stems: bool = False) -> DataFrame:
    """Candidates (path) with in_library: whether a song has that path, or with stems that path but for its extension."""
    path = F.regexp_replace("path", r"([^/\\])\.[^./\\]*$", "$1") if stems else F.col("path")
    have = songs.select(path_key(path).alias("_key")).distinct().withColumn("_have", F.lit(True))
    rows = candidates.withColumn("_key", path_key(F.col("path"))).join(have, "_key", "left")
    return rows.withColumn("in_library", F.coalesce("_have", F.lit(False))).drop("_key", "_have")


def import_choice(candidates: DataFrame, use_collections: bool) -> DataFrame:
    """One row on what an import will do: candidates have checked, lyrics, collection and in_library.

    Only checked songs are counted, but for those of the library that are left out; blank collections are none.
    """
    c, lyrics = F.col("checked"), F.trim(F.coalesce("lyrics", F.lit(""))) != ""
    names = F.count_distinct(F.when(c & (F.col("collection") != ""), F.col("collection"))) if use_collections else F.lit(0).cast("long")
    return candidates.agg(F.count_if(c).alias("n"), F.count_if(c & lyrics).alias("with_lyrics"), F.count_if(c & ~lyrics).alias("transcribe"), F.count_if(F.col("in_library") & ~c).alias("skipped"), names.alias("collections"))


def suite(files: DataFrame) -> DataFrame:
    """audio, reference (name.ultrastar.txt before name.txt; null: skipped) and lyrics (name.lyrics.txt) of each song file among files (path)."""
    folder, name, stem = parts(F.col("path"))
    rows = files.select("path", folder.alias("folder"), name.alias("name"), stem.alias("stem"))
    songs = rows.where(extension(F.col("name")).isin(*AUDIO, *UNSUPPORTED))
    out = songs.select(F.col("path").alias("audio"), "folder", "stem")
    for column, end in (("_first", ".ultrastar.txt"), ("_second", ".txt"), ("lyrics", ".lyrics.txt")):
        beside = rows.where(F.col("name").endswith(end)).groupBy("folder", F.left("name", F.length("name") - len(end)).alias("stem")).agg(F.min("path").alias(column))
        out = out.join(beside, ["folder", "stem"], "left")
    return out.select("audio", F.coalesce("_first", "_second").alias("reference"), "lyrics")


def rewrite_json(text: Column, old: str, new: str) -> tuple[Column, Column]:
    """A JSON text with one folder in place of another at the start of its strings, whatever its case, and how often."""
    old, new = (x.rstrip("\\/") for x in (old, new))
    double, slashed = (lambda x: x.replace("\\", "\\\\")), (lambda x: x.replace("\\", "/"))
    count = F.lit(0)
    for end, form in (("\\\\", double), ("/", slashed), ('"', double)):
        found = "(?i)" + re.escape('"' + form(old) + end)
        count = count + F.regexp_count(text, F.lit(found))
        text = F.regexp_replace(text, found, ('"' + form(new) + end).replace("\\", "\\\\").replace("$", "\\$"))
    return text, count


def cover_files(covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covers (mime, data and others) with the file that each is kept in, named by its content, and those files (file, data) once each."""
    ends = F.create_map(*(F.lit(x) for pair in COVERS.items() for x in pair))
    named = covers.withColumn("file", F.concat(F.left(F.sha2("data", 256), F.lit(16)), F.lit("."), F.coalesce(F.try_element_at(ends, F.col("mime")), F.lit("img"))))
    return named.drop("data"), named.groupBy("file").agg(F.first("data").alias("data"))


def unfinished(jobs: DataFrame) -> DataFrame:
    """The jobs (status, cancel_requested) that a new session takes up again."""
    return jobs.where(F.col("status").isin("queued", "running") & ~F.coalesce("cancel_requested", F.lit(False)))


def channel(lifecycle: DataFrame, pipeline: DataFrame, prep: DataFrame) -> DataFrame:
    """One channel of events (seq, job_id, payload) from three kinds (seq, job_id and what each tells); absent values are left out of a payload."""

    def told(kind: str, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in ("seq", "job_id")]
        return df.select("seq", "job_id", F.to_json(F.struct(F.lit(kind).alias("kind"), "job_id", *rest)).alias("payload"))

    return told("lifecycle", lifecycle).unionByName(told("pipeline", pipeline)).unionByName(told("prep", prep))


def post_import(songs: DataFrame, posts: DataFrame, have: DataFrame, now: int) -> DataFrame:
    """Songs after the steps behind their import (posts: id, collection, checked, year, genre, language).

    A collection is found by its folded name or made (collection_id is null then); a checked song is reviewed now; year,
    genre and language replace those of the song where there are any.
    """
    p = posts.select("id", F.nullif(F.trim("collection"), F.lit("")).alias("_name"), F.col("checked").alias("_checked"), F.col("year").alias("_year"), F.col("genre").alias("_genre"), F.col("language").alias("_language"))
    found = create_collections(have, p.select(F.col("_name").alias("name")).where("name is not null"))
    found = found.select(ascii_fold(F.col("name")).alias("_fold"), F.col("id").alias("collection_id"), "outcome")
    out = songs.join(p, "id", "left").withColumn("_fold", ascii_fold(F.col("_name"))).join(found, "_fold", "left")
    out = out.withColumn("reviewed_at", F.when(F.col("_checked"), F.lit(now)).otherwise(F.col("reviewed_at")))
    out = out.withColumn("year", F.coalesce("_year", "year")).withColumn("genre", F.coalesce("_genre", "genre")).withColumn("language_tag", F.coalesce("_language", "language_tag"))
    return out.drop("_name", "_checked", "_year", "_genre", "_language", "_fold")
