"""Library queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.operators import library as L
from canticle.plans import query
from canticle.plans.views import COLL, LIB, NOW, QUEUE, coll, coll_songs, epoch, lib, queue, table

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("lib_search_sql", f"WITH {LIB} SELECT id, title FROM lib WHERE contains({FOLD.format('title')}, 'red') OR contains({FOLD.format('artist')}, 'red') OR language_tag = 'Red'")
def lib_search_sql(spark, sf):
    return L.search_store(lib(spark, sf), "Red").select("id", "title")


@query("lib_search_ui", f"WITH {LIB} SELECT id, title FROM lib WHERE contains(lower(title), 'de') OR contains(lower(artist), 'de') OR lower(language_tag) = 'de'")
def lib_search_ui(spark, sf):
    return L.search_view(lib(spark, sf), " DE ").select("id", "title")


@query("sort_recent", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY date_added DESC, id DESC) AS place FROM lib")
def sort_recent(spark, sf):
    return L.ranked(lib(spark, sf), F.desc("date_added"), F.desc("id")).select("id", "place")


@query("sort_played", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY last_played DESC NULLS LAST, date_added DESC, id DESC) AS place FROM lib")
def sort_played(spark, sf):
    return L.ranked(lib(spark, sf), F.desc_nulls_last("last_played"), F.desc("date_added"), F.desc("id")).select("id", "place")


@query("sort_title", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY {FOLD.format('title')}, id) AS place FROM lib")
def sort_title(spark, sf):
    return L.ranked(lib(spark, sf), L.ascii_fold(F.col("title")), F.col("id")).select("id", "place")


@query("sort_column", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY year IS NULL, year DESC, id) AS place FROM lib")
def sort_column(spark, sf):
    return L.ranked(lib(spark, sf), F.col("year").isNull(), F.desc("year"), F.col("id")).select("id", "place")


@query("lib_collection", f"WITH {LIB}, {COLL} SELECT s.id, s.title, c.position FROM coll_songs c JOIN lib s ON s.id = c.song_id WHERE c.collection_id = 3")
def lib_collection(spark, sf):
    members = coll_songs(spark, sf).where(F.col("collection_id") == 3)
    return lib(spark, sf).join(members, F.col("id") == F.col("song_id")).select("id", "title", "position")


@query("lib_browse", f"WITH {LIB}, {COLL}, b AS (SELECT NULL AS collection, id, NULL AS position FROM lib UNION ALL SELECT collection_id, song_id, position FROM coll_songs WHERE collection_id IN (2, 5)) SELECT b.collection, b.id, b.position, s.title FROM b JOIN lib s USING (id)")
def lib_browse(spark, sf):
    """The whole library, then two collections of it: without a collection there is no join."""
    songs, members = lib(spark, sf), coll_songs(spark, sf)
    views = (L.browse(songs, members, c).select(F.lit(c).cast("long").alias("collection"), "id", F.col("position").cast("long").alias("position"), "title") for c in (None, 2, 5))
    return functools.reduce(DataFrame.unionByName, views)


@query("sort_columns", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY year IS NULL, year, id) AS by_year, row_number() OVER (ORDER BY lower(title) DESC, id) AS by_title FROM lib")
def sort_columns(spark, sf):
    """Places by year going up and by title, whatever its case, going down; what has no value comes last either way."""
    year = L.sort_by(lib(spark, sf), F.col("year"), "asc", F.col("id")).select("id", F.col("place").alias("by_year"))
    title = L.sort_by(lib(spark, sf), F.lower("title"), "desc", F.col("id")).select("id", F.col("place").alias("by_title"))
    return year.join(title, "id")


@query("collection_names_by_song", f"WITH {COLL} SELECT song_id, string_agg(name, '|' ORDER BY lower(name), name) AS names FROM coll_songs JOIN coll ON id = collection_id GROUP BY song_id")
def collection_names_by_song(spark, sf):
    named = coll_songs(spark, sf).join(coll(spark, sf), F.col("id") == F.col("collection_id"))
    names = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("fold"), "name")))
    return named.groupBy("song_id").agg(F.array_join(F.transform(names, lambda x: x["name"]), "|").alias("names"))


@query("collections_with_counts", f"WITH {COLL} SELECT id, name, (SELECT count(*) FROM coll_songs WHERE collection_id = id) AS songs FROM coll")
def collections_with_counts(spark, sf):
    n = coll_songs(spark, sf).groupBy("collection_id").agg(F.count("*").alias("songs"))
    return coll(spark, sf).join(n, F.col("id") == F.col("collection_id"), "left").select("id", "name", F.coalesce("songs", F.lit(0)).alias("songs"))


@query("shelf_most", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY play_count DESC, title, id) AS place FROM lib WHERE play_count > 0")
def shelf_most(spark, sf):
    return L.ranked(lib(spark, sf).where("play_count > 0"), F.desc("play_count"), F.col("title"), F.col("id")).select("id", "place")


@query("shelf_never", f"WITH {LIB} SELECT id FROM lib WHERE play_count = 0 AND timing_map_path IS NOT NULL")
def shelf_never(spark, sf):
    return lib(spark, sf).where("play_count = 0 AND timing_map_path IS NOT NULL").select("id")


@query("shelf_recent", f"WITH {LIB} SELECT id FROM lib WHERE date_added >= {NOW} - 2592000")
def shelf_recent(spark, sf):
    return lib(spark, sf).where(F.col("date_added") >= NOW - 30 * 86400).select("id")


@query("shelf_counts", f"WITH {LIB} SELECT count(*) FILTER (WHERE play_count > 0) AS most, count(*) FILTER (WHERE play_count = 0 AND timing_map_path IS NOT NULL) AS never, count(*) FILTER (WHERE date_added >= {NOW} - 2592000) AS recent, count(*) FILTER (WHERE duration_s > 0 AND duration_s < 180) AS short FROM lib")
def shelf_counts(spark, sf):
    return lib(spark, sf).agg(
        F.count_if(F.col("play_count") > 0).alias("most"), F.count_if((F.col("play_count") == 0) & F.col("timing_map_path").isNotNull()).alias("never"),
        F.count_if(F.col("date_added") >= NOW - 30 * 86400).alias("recent"), F.count_if((F.col("duration_s") > 0) & (F.col("duration_s") < 180)).alias("short"),
    )


BANDS = f"""WITH {LIB}, v AS (SELECT list_sort(list(pace_wpm) FILTER (WHERE pace_wpm IS NOT NULL)) AS v FROM lib),
b AS (SELECT CASE WHEN len(v) >= 3 THEN v[CAST(floor(1/3.0::DOUBLE * (len(v) - 1) + 0.5) AS INTEGER) + 1] END AS slow, CASE WHEN len(v) >= 3 THEN v[CAST(floor(2/3.0::DOUBLE * (len(v) - 1) + 0.5) AS INTEGER) + 1] END AS fast FROM v)"""


@query("pace_bands", f"{BANDS} SELECT id, CASE WHEN pace_wpm <= slow THEN 'slow' WHEN pace_wpm >= fast THEN 'fast' WHEN pace_wpm IS NOT NULL AND slow IS NOT NULL THEN 'medium' END AS band FROM lib, b")
def pace_bands(spark, sf):
    return L.pace_bands(lib(spark, sf)).select("id", "band")


@query("facets_artist", f"WITH {LIB}, g AS (SELECT lower(trim(artist)) AS key, arg_min(trim(artist), id) AS label, count(*) AS n FROM lib WHERE trim(artist) <> '' GROUP BY 1) SELECT *, row_number() OVER (ORDER BY lower(label), key) AS place FROM g")
def facets_artist(spark, sf):
    return L.facets(lib(spark, sf), F.lower(F.trim("artist")), F.trim("artist"))


@query("facets_decade", f"WITH {LIB}, g AS (SELECT CAST(year // 10 * 10 AS VARCHAR) AS key, count(*) AS n FROM lib WHERE year IS NOT NULL GROUP BY 1) SELECT key, key || 's' AS label, n, row_number() OVER (ORDER BY key) AS place FROM g")
def facets_decade(spark, sf):
    d = L.decade(F.col("year")).cast("string")
    return L.facets(lib(spark, sf), d, F.concat(d, F.lit("s")))


NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.LANGUAGES.items()) + "}"


@query("facets_lang", f"WITH {LIB}, g AS (SELECT language_tag AS key, any_value(coalesce(map_extract({NAMES}, language_tag)[1], upper(language_tag))) AS label, count(*) AS n FROM lib GROUP BY 1) SELECT *, row_number() OVER (ORDER BY lower(label), key) AS place FROM g")
def facets_lang(spark, sf):
    return L.facets(lib(spark, sf), F.col("language_tag"), L.language_name(F.col("language_tag")))


BANDED = rf"""{BANDS}, banded AS (SELECT lib.*, CASE WHEN pace_wpm <= slow THEN 'slow' WHEN pace_wpm >= fast THEN 'fast' WHEN pace_wpm IS NOT NULL AND slow IS NOT NULL THEN 'medium' END AS band FROM lib, b),
worded AS (SELECT *, lower(trim(title)) || ' ' || lower(trim(coalesce(artist, ''))) AS hay,
  (CASE WHEN year IS NULL THEN [] ELSE [(year // 10 * 10) || 's', lpad(CAST(year // 10 * 10 % 100 AS VARCHAR), 2, '0') || 's', CAST(year AS VARCHAR)] END)
  || (CASE WHEN genre IS NULL THEN [] ELSE [lower(trim(genre))] || list_filter(string_split_regex(lower(trim(genre)), '[\s/,&-]+'), lambda w: w <> '') END)
  || [lower(coalesce(map_extract({NAMES}, language_tag)[1], upper(language_tag))), language_tag]
  || (CASE WHEN band = 'slow' THEN ['easy', 'slow', 'easy-sing-alongs'] WHEN band = 'fast' THEN ['fast', 'fast-lyrics'] ELSE [] END)
  || (CASE WHEN duration_s > 0 AND duration_s < 180 THEN ['short'] ELSE [] END)
  || (CASE WHEN play_count > 0 THEN ['most-sung', 'sung'] WHEN timing_map_path IS NOT NULL THEN ['never-sung', 'unsung'] ELSE [] END)
  || (CASE WHEN date_added >= {NOW} - 2592000 THEN ['recent', 'recently-added'] ELSE [] END) AS words FROM banded)"""
FIND = "Brand#1  fast NEVER  sung"


def found(text: str, tokens: list[str]) -> str:
    every = " AND ".join(f"(contains(hay, '{t}') OR len(list_filter(words, lambda w: starts_with(w, '{t}'))) > 0)" for t in tokens)
    return f"SELECT * FROM worded WHERE contains(hay, '{text}') OR lower(language_tag) = '{text}' OR ({every})"


@query("facet_search", f"{BANDED} SELECT id, title, artist FROM ({found(FIND.lower(), ['brand#1', 'fast', 'never-sung'])})")
def facet_search(spark, sf):
    return L.search_facets(L.pace_bands(lib(spark, sf)), FIND, NOW).select("id", "title", "artist")


FINDS = {"80s easy": ["80s", "easy"], "german recently added": ["german", "recently-added"], "most sung short": ["most-sung", "short"], "FR": ["fr"], "1955 red": ["1955", "red"]}


@query("facet_searches", f"{BANDED} " + " UNION ALL ".join(f"SELECT '{k}' AS find, id FROM ({found(k.lower(), v)})" for k, v in FINDS.items()))
def facet_searches(spark, sf):
    """Search texts with phrases, decades, years, language names, pace and shelf words."""
    return L.labelled(L.worded(L.pace_bands(lib(spark, sf)), NOW), "find", {k: L.found_by(k) for k in FINDS}).select("find", "id")


@query("search_blank", f"WITH {LIB} SELECT id FROM lib")
def search_blank(spark, sf):
    """Blank texts keep everything in all three searches."""
    songs = lib(spark, sf)
    return L.search_facets(L.search_view(L.search_store(songs, " "), "\t"), "", NOW).select("id")


NODES = {
    "shelf:most": "play_count > 0", "shelf:never": "play_count = 0 AND timing_map_path IS NOT NULL", "shelf:recent": f"date_added >= {NOW} - 2592000", "sing:short": "duration_s > 0 AND duration_s < 180",
    "sing:slow": "band = 'slow'", "sing:medium": "band = 'medium'", "sing:fast": "band = 'fast'", "artist:brand#11": "lower(trim(coalesce(artist, ''))) = 'brand#11'",
    "genre:economy anodized: steel": "lower(trim(coalesce(genre, ''))) = 'economy anodized: steel'", "decade:1980": "coalesce(CAST(year // 10 * 10 AS VARCHAR), 'null') = '1980'", "decade:null": "year IS NULL", "lang:de": "language_tag = 'de'",
}


@query("category_nodes", f"{BANDED} " + " UNION ALL ".join(f"SELECT '{k}' AS node, id FROM banded WHERE {v}" for k, v in NODES.items()))
def category_nodes(spark, sf):
    return L.labelled(L.pace_bands(lib(spark, sf)), "node", {k: L.in_category(k, NOW) for k in NODES}).select("node", "id")


@query("group_rows", f"""{BANDED}, f AS ({found(FIND.lower(), ['brand#1', 'fast', 'never-sung'])}), g AS (SELECT *, coalesce(CAST(year // 10 * 10 AS VARCHAR), 'Unknown') AS decade FROM f)
SELECT id, title, band, decade, row_number() OVER (ORDER BY decade = 'Unknown', decade, {FOLD.format('title')}, id) AS place FROM g""")
def group_rows(spark, sf):
    """The flagship read path: terciles, search, sort, group."""
    rows = L.search_facets(L.pace_bands(lib(spark, sf)), FIND, NOW)
    rows = rows.select("id", "title", "band", F.coalesce(L.decade(F.col("year")).cast("string"), F.lit("Unknown")).alias("decade"))
    return L.ranked(rows, F.col("decade") == "Unknown", F.col("decade"), L.ascii_fold(F.col("title")), F.col("id")).select("id", "title", "band", "decade", "place")


@query("queue_list", f"WITH {LIB}, {QUEUE} SELECT q.party, q.id, q.position, q.guest, s.title, s.timing_map_path IS NOT NULL AS ready FROM queue q JOIN lib s ON s.id = q.song_id")
def queue_list(spark, sf):
    s = lib(spark, sf).select(F.col("id").alias("sid"), "title", F.col("timing_map_path").isNotNull().alias("ready"))
    return queue(spark, sf).join(s, F.col("song_id") == F.col("sid")).select("party", "id", "position", "guest", "title", "ready")


@query("queue_compact", f"WITH {QUEUE} SELECT party, id, row_number() OVER (PARTITION BY party ORDER BY position, id) - 1 AS position FROM queue WHERE status <> 'F'")
def queue_compact(spark, sf):
    """Positions close up when finished entries leave."""
    return L.compact_positions(queue(spark, sf).where("status <> 'F'")).select("party", "id", "position")


@query("queue_append", f"WITH {LIB}, {QUEUE}, adds AS (SELECT c_custkey // 10 AS party, id FROM customer JOIN lib ON id = c_custkey WHERE timing_map_path IS NOT NULL), l AS (SELECT party, max(position) + 1 AS base FROM queue GROUP BY party) SELECT party, id AS song_id, coalesce(base, 0) + row_number() OVER (PARTITION BY party ORDER BY id) - 1 AS position FROM adds LEFT JOIN l USING (party)")
def queue_append(spark, sf):
    """Every customer adds the song of their number to their party's queue."""
    asks = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 10).alias("party"), F.col("c_custkey").alias("id"))
    return L.append_to_queue(queue(spark, sf), asks.join(lib(spark, sf).select("id", "timing_map_path"), "id"))


@query("queue_move", f"WITH {QUEUE}, m AS (SELECT *, max(CASE WHEN position = 4 THEN position END) OVER w AS a, least(party % 25, max(position) OVER w) AS t FROM queue WINDOW w AS (PARTITION BY party)) SELECT party, id, CASE WHEN a IS NULL THEN position WHEN position = 4 THEN t WHEN position > 4 AND position <= t THEN position - 1 WHEN position < 4 AND position >= t THEN position + 1 ELSE position END AS position FROM m")
def queue_move(spark, sf):
    """The fifth entry of each party's queue moves to the place of the party's number, modulo 25."""
    q = queue(spark, sf)
    moves = q.where("position = 4").select("party", F.col("id").alias("entry"), (F.col("party") % 25).cast("int").alias("to"))
    return L.move(q, moves).select("party", "id", "position")


@query("kick_guest", f"WITH {QUEUE} SELECT party, id, position FROM queue WHERE NOT (guest = 3 AND id IS DISTINCT FROM playing)")
def kick_guest(spark, sf):
    return L.kick(queue(spark, sf), 3).select("party", "id", "position")


CHANGE = """chg AS (SELECT audio_hash, upper(title) AS title, artist, 'new/' || id AS audio_path, job_dir, CASE WHEN id % 7 <> 0 THEN timing_map_path END AS timing_map_path, vocals_path, instrumental_path, CASE WHEN id % 2 = 0 THEN 'New album' END AS album,
 CASE WHEN id % 2 = 0 THEN duration_s + 1 END AS duration_s, CASE WHEN id % 3 = 0 THEN 'it' END AS language_tag, CASE WHEN id % 4 = 0 THEN 100.0::DOUBLE END AS pace_wpm, CASE WHEN id % 3 = 1 THEN 'imported' END AS lyric_source,
 CASE WHEN id % 2 = 1 THEN 'new/cover' END AS cover_path, 2 AS meta_version, 2000 AS year, 'new' AS genre FROM lib WHERE id % 5 = 0), old AS (SELECT * FROM lib WHERE id % 10 <> 0)"""
SQL_PICK = ", ".join(
    [f"CASE WHEN n.audio_hash IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in L.NEW] + [f"coalesce(n.{c}, o.{c}) AS {c}" for c in L.KEEP_IF_NULL if c != "language_tag"]
    + [f"coalesce(o.{c}, n.{c}) AS {c}" for c in L.FILL_ONLY] + [f"o.{c} AS {c}" for c in L.KEPT]
    + ["coalesce(o.audio_hash, n.audio_hash) AS audio_hash", "coalesce(n.language_tag, o.language_tag, 'en') AS language_tag", "CASE WHEN coalesce(o.cover_by_user, FALSE) THEN o.cover_path ELSE coalesce(n.cover_path, o.cover_path) END AS cover_path",
       "coalesce(o.cover_by_user, FALSE) AS cover_by_user", "greatest(coalesce(o.meta_version, 0), coalesce(n.meta_version, 0)) AS meta_version", "CASE WHEN n.audio_hash IS NULL THEN o.reviewed_at END AS reviewed_at",
       "coalesce(o.play_count, 0) AS play_count", f"coalesce(o.date_added, {NOW}) AS date_added"]
)


@query("upsert_songs", f"WITH {LIB}, {CHANGE} SELECT {SQL_PICK} FROM old o FULL JOIN chg n ON o.audio_hash = n.audio_hash")
def upsert_songs(spark, sf):
    """Every fifth song is imported again, half of them new to the library; each column by its own policy."""
    songs, i = lib(spark, sf), F.col("id")
    change = songs.where("id % 5 = 0").select(
        "audio_hash", F.upper("title").alias("title"), "artist", F.concat(F.lit("new/"), i.cast("string")).alias("audio_path"), "job_dir", F.when(i % 7 != 0, F.col("timing_map_path")).alias("timing_map_path"), "vocals_path", "instrumental_path",
        F.when(i % 2 == 0, F.lit("New album")).alias("album"), F.when(i % 2 == 0, F.col("duration_s") + 1).alias("duration_s"), F.when(i % 3 == 0, F.lit("it")).alias("language_tag"), F.when(i % 4 == 0, F.lit(100.0)).alias("pace_wpm"),
        F.when(i % 3 == 1, F.lit("imported")).alias("lyric_source"), F.when(i % 2 == 1, F.lit("new/cover")).alias("cover_path"), F.lit(2).cast("long").alias("meta_version"), F.lit(2000).alias("year"), F.lit("new").alias("genre"),
    )
    return L.upsert(songs.where("id % 10 <> 0"), change, NOW)


ADDS = "new AS (SELECT DISTINCT l_suppkey AS collection_id, l_partkey + 1 AS song_id FROM lineitem WHERE l_linenumber = 1)"


@query("insert_ignore", f"WITH {COLL}, {ADDS}, b AS (SELECT collection_id, max(position) + 1 AS base FROM coll_songs GROUP BY collection_id) SELECT n.collection_id, n.song_id, coalesce(base, 0) + row_number() OVER (PARTITION BY n.collection_id ORDER BY n.song_id) - 1 AS position FROM new n LEFT JOIN b ON b.collection_id = n.collection_id WHERE NOT EXISTS (SELECT 1 FROM coll_songs c WHERE c.collection_id = n.collection_id AND c.song_id = n.song_id)")
def insert_ignore(spark, sf):
    """Songs added to collections, those that are in them already left out; the rest go behind the last position."""
    have = coll_songs(spark, sf)
    new = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("collection_id"), (F.col("l_partkey") + 1).alias("song_id")).distinct()
    return L.add_members(have, new)


GONE = "gone AS (SELECT p_partkey AS song_id FROM part WHERE p_size > 40), lost AS (SELECT s_suppkey AS collection_id FROM supplier WHERE s_acctbal < 0)"


@query("delete_cascade", f"""WITH {COLL}, {QUEUE}, {GONE} SELECT 'member' AS kind, song_id AS id, collection_id AS owner FROM coll_songs WHERE song_id NOT IN (SELECT song_id FROM gone) AND collection_id NOT IN (SELECT collection_id FROM lost)
UNION ALL SELECT 'queue', id, CASE WHEN from_collection NOT IN (SELECT collection_id FROM lost) THEN from_collection END FROM queue WHERE song_id NOT IN (SELECT song_id FROM gone)""")
def delete_cascade(spark, sf):
    """Deleted songs leave collections and queues; deleted collections leave queue entries that forget their origin."""
    gone = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("song_id"))
    lost = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("collection_id"))
    members, entries = L.delete_collections(lost, *L.delete_songs(gone, coll_songs(spark, sf), queue(spark, sf)))
    return members.select(F.lit("member").alias("kind"), F.col("song_id").alias("id"), F.col("collection_id").alias("owner")).unionByName(entries.select(F.lit("queue").alias("kind"), "id", F.col("from_collection").alias("owner")))


@query("meta_policies", f"WITH {LIB} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'tag' END, genre) AS imported, coalesce(genre, 'fill') AS filled, coalesce(year, 1999) AS year, CASE WHEN id % 3 = 0 THEN 90.0::DOUBLE END AS pace_wpm FROM lib WHERE meta_version < 2")
def meta_policies(spark, sf):
    """Songs whose metadata is of an older version: imported values replace, the backfill fills blanks, pace is always replaced."""
    i = F.col("id")
    return lib(spark, sf).where("meta_version < 2").select(
        "id", F.coalesce(F.when(i % 2 == 0, F.lit("tag")), F.col("genre")).alias("imported"), F.coalesce("genre", F.lit("fill")).alias("filled"), F.coalesce("year", F.lit(1999)).alias("year"), F.when(i % 3 == 0, F.lit(90.0)).alias("pace_wpm")
    )


@query("update_details", f"WITH {LIB} SELECT id, trim(title) AS title, nullif(trim(CASE WHEN id % 4 = 0 THEN '  ' ELSE artist END), '') AS artist, coalesce(CASE WHEN id % 5 = 0 THEN 'sv' END, language_tag) AS language_tag FROM lib WHERE trim(title) <> ''")
def update_details(spark, sf):
    blank = F.when(F.col("id") % 4 == 0, F.lit("  ")).otherwise(F.col("artist"))
    return lib(spark, sf).where(F.trim("title") != "").select("id", F.trim("title").alias("title"), F.nullif(F.trim(blank), F.lit("")).alias("artist"), F.coalesce(F.when(F.col("id") % 5 == 0, F.lit("sv")), F.col("language_tag")).alias("language_tag"))


PLAYS = "plays AS (SELECT l_partkey AS id, count(*) AS n, max(CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS seen FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


@query("play_counters", f"WITH {LIB}, {PLAYS} SELECT id, play_count + coalesce(n, 0) AS play_count, greatest(last_played, seen) AS last_played, CASE WHEN id % 5 <> 0 THEN coalesce(CASE WHEN id % 4 = 0 THEN {NOW} END, reviewed_at) END AS reviewed_at FROM lib LEFT JOIN plays USING (id)")
def play_counters(spark, sf):
    """New plays are counted and dated; reviews are set for some songs and cleared for others."""
    plays = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.max(epoch("l_shipdate")).alias("at"))
    s, i = lib(spark, sf).join(plays, "id", "left"), F.col("id")
    reviewed = F.when(i % 5 != 0, F.coalesce(F.when(i % 4 == 0, F.lit(NOW)), F.col("reviewed_at")))
    return s.select("id", (F.col("play_count") + F.coalesce("n", F.lit(0))).alias("play_count"), F.greatest("last_played", "at").alias("last_played"), reviewed.alias("reviewed_at"))


LISTED = f"""listed AS (SELECT l.id, 's' || left(sha256('salt:' || from_hex(lpad(hex(l.id % 256), 2, '0') || lpad(hex(l.id // 256 % 256), 2, '0') || lpad(hex(l.id // 65536 % 256), 2, '0') || lpad(hex(l.id // 16777216), 2, '0') || '00000000')::VARCHAR::BLOB), 10) AS pid,
  l.title, nullif(trim(l.artist), '') AS artist, round(l.duration_s, 1) AS duration, coalesce(string_agg(c.name, '|' ORDER BY lower(c.name), c.name), '') AS collections, l.timing_map_path IS NOT NULL AS ready
  FROM lib l LEFT JOIN coll_songs m ON m.song_id = l.id LEFT JOIN coll c ON c.id = m.collection_id GROUP BY ALL)"""


@query("party_listing", f"WITH {LIB}, {COLL}, {LISTED.replace('::VARCHAR::BLOB', '').replace(chr(39) + 'salt:' + chr(39) + ' || ', chr(39) + 'salt:' + chr(39) + '::BLOB || ')} SELECT pid, title, artist, duration, collections, ready, row_number() OVER (ORDER BY lower(title), lower(artist), id) AS place FROM listed")
def party_listing(spark, sf):
    """What guests see of the library: opaque ids, blank artists as null, collections by name, and nothing else."""
    rows = L.listing(lib(spark, sf), coll_songs(spark, sf), coll(spark, sf), "salt")
    rows = L.ranked(rows, F.lower("title"), F.lower("artist"), F.col("id"))
    return rows.select("pid", "title", "artist", "duration", F.array_join("collections", "|").alias("collections"), "ready", "place")


@query("check_request", f"""WITH {LIB}, {QUEUE}, w AS (SELECT party, guest, count(*) AS n FROM queue WHERE id IS DISTINCT FROM playing GROUP BY ALL), r AS (SELECT o_orderkey AS req, o_custkey // 10 AS party, o_orderkey % 2500 AS song_id, o_custkey % 10 AS guest FROM orders)
SELECT req, CASE WHEN l.id IS NULL THEN 'unknown' WHEN l.timing_map_path IS NULL THEN 'not_ready' WHEN coalesce(n, 0) >= 12 THEN 'limit' ELSE 'ok' END AS verdict FROM r LEFT JOIN lib l ON l.id = r.song_id LEFT JOIN w USING (party, guest)""")
def check_request(spark, sf):
    """Unknown song, song without timings, or twelve entries of the guest waiting already (the one that plays is none), in that order."""
    asks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("req"), F.floor(F.col("o_custkey") / 10).alias("party"), (F.col("o_orderkey") % 2500).alias("song_id"), (F.col("o_custkey") % 10).alias("guest"))
    return L.check_requests(asks, lib(spark, sf), queue(spark, sf), 12).select("req", "verdict")
