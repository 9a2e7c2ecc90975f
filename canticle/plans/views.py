"""Views of the driver tables as library, queue, timed words, frames and jobs; Spark and DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = 795744000  # fixed value: 1995-03-21, the day on which "recent" is judged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def epoch(ts: str) -> Column:
    return F.floor(micros(ts) / 1000000).cast("long")


def lib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The song library: parts are songs, some line items their plays."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), epoch("l_shipdate").alias("at"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("play"))
    plays = items.groupBy("id").agg(F.count_if("play").alias("play_count"), F.max(F.when(F.col("play"), F.col("at"))).alias("last_played"), F.min("at").alias("date_added"))
    p = table(spark, sf_dir, "part")
    songs = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
        (F.col("p_size") * 10.0).alias("duration_s"),
        F.when(F.col("p_partkey") % 11 != 0, (1950 + (F.col("p_partkey") * 7) % 73).cast("int")).alias("year"),
        F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("language_tag"),
        F.when(F.col("p_size") >= 3, F.col("p_retailprice") / 10).alias("pace_wpm"),
        F.when(F.col("p_size") != 50, F.concat(F.lit("maps/"), F.col("p_partkey").cast("string"))).alias("timing_map_path"),
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("audio_hash"),
        F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("Album "), (F.col("p_partkey") % 40).cast("string"))).alias("album"),
        F.concat_ws("/", F.lit("music"), "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".mp3"))).alias("audio_path"),
        F.concat(F.lit("jobs/"), F.col("p_partkey").cast("string")).alias("job_dir"),
        *(F.when(F.col("p_size") != 50, F.concat(F.lit("jobs/"), F.col("p_partkey").cast("string"), F.lit(f"/{x}.wav"))).alias(f"{x}_path") for x in ("vocals", "instrumental")),
        F.element_at(F.array(*map(F.lit, ("pasted", "transcribed", "imported"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("lyric_source"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("covers/"), (F.col("p_partkey") % 50).cast("string"))).alias("cover_path"),
        (F.col("p_partkey") % 8 == 1).alias("cover_by_user"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 788918400).alias("reviewed_at"),
        (F.col("p_partkey") % 4).alias("meta_version"),
    )
    out = songs.join(plays, "id", "left").withColumn("play_count", F.coalesce("play_count", F.lit(0)))
    return out.withColumn("date_added", F.coalesce("date_added", F.lit(0)))


LIB = """lib AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS genre, p_size * 10.0::DOUBLE AS duration_s,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(1950 + (p_partkey * 7) % 73 AS INTEGER) END AS year,
    ['en','de','fr','es'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS language_tag, CASE WHEN p_size >= 3 THEN p_retailprice / 10 END AS pace_wpm,
    CASE WHEN p_size <> 50 THEN 'maps/' || p_partkey END AS timing_map_path, sha256(CAST(p_partkey AS VARCHAR)) AS audio_hash,
    CASE WHEN p_partkey % 6 <> 0 THEN 'Album ' || (p_partkey % 40) END AS album, 'music/' || p_brand || '/' || p_partkey || '.mp3' AS audio_path, 'jobs/' || p_partkey AS job_dir,
    CASE WHEN p_size <> 50 THEN 'jobs/' || p_partkey || '/vocals.wav' END AS vocals_path, CASE WHEN p_size <> 50 THEN 'jobs/' || p_partkey || '/instrumental.wav' END AS instrumental_path,
    ['pasted','transcribed','imported'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS lyric_source, CASE WHEN p_partkey % 4 <> 0 THEN 'covers/' || (p_partkey % 50) END AS cover_path,
    p_partkey % 8 = 1 AS cover_by_user, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 788918400 END AS reviewed_at, p_partkey % 4 AS meta_version,
    coalesce(play_count, 0) AS play_count, last_played, coalesce(date_added, 0) AS date_added
  FROM part LEFT JOIN (
    SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 45) AS play_count,
      max(CAST(floor(epoch(l_shipdate)) AS BIGINT)) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 45) AS last_played, min(CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS date_added
    FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def coll_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections are suppliers; positions follow the part key."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("song_id")).distinct()
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy("collection_id").orderBy("song_id")) - 1)


COLL = """coll AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
coll_songs AS (SELECT collection_id, song_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY song_id) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT l_suppkey AS collection_id, l_partkey AS song_id FROM lineitem))"""


def coll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queues: all orders, ten customers a party, each order with its first song; the first entry plays."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l"))
    q = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    q = q.select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_custkey") / 10).alias("party"), F.col("l.l_partkey").alias("song_id"), F.col("l.l_suppkey").alias("from_collection"),
        (F.col("o_custkey") % 10).alias("guest"), F.col("o_orderstatus").alias("status"),
    )
    own = Window.partitionBy("party")
    return q.withColumn("position", F.row_number().over(own.orderBy("id")) - 1).withColumn("playing", F.min("id").over(own))


QUEUE = """queue AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY party ORDER BY id) - 1 AS INTEGER) AS position, min(id) OVER (PARTITION BY party) AS playing FROM (
    SELECT o_orderkey AS id, o_custkey // 10 AS party, l.p AS song_id, l.s AS from_collection, o_custkey % 10 AS guest, o_orderstatus AS status
    FROM orders JOIN (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}).p AS p, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}).s AS s FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words: a user's events in order; times in seconds."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long")
    e = e.select(F.col("user_id").alias("song_id"), "event_id", micros("ts").alias("us"), "event_type", "value", k.alias("k"))
    e = e.withColumn("word_idx", F.row_number().over(Window.partitionBy("song_id").orderBy("us", "event_id")) - 1)
    start = F.col("us") / 1000000.0
    return e.select(
        "song_id", "word_idx", F.col("event_id"), start.alias("start"), (start + F.col("value") * 60).alias("end"), (F.col("event_type") == "error").alias("unsung"),
        F.when(F.col("k") % 7 != 0, F.floor(F.col("k") / 10).cast("long")).alias("line"), (F.col("value") / 500).alias("confidence"), "event_type", "value",
    )


WORDS = r"""words AS (
  SELECT user_id AS song_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS word_idx, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS start,
    epoch_us(ts) / 1000000.0::DOUBLE + value * 60 AS "end", event_type = 'error' AS unsung, CASE WHEN k % 7 <> 0 THEN k // 10 END AS line, value / 500 AS confidence, event_type, value
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS BIGINT) AS k FROM events))"""
