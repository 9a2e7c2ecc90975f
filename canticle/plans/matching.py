"""Catalogue matching and title cleanup over the parts, whose names get the decorations that titles carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from canticle.functions import names as N
from canticle.operators import matching as M
from canticle.plans import query
from canticle.plans.views import table

FORMS = [
    "", " (Live at {b})", " [Remastered 2011]", " feat. Guest", " - Live", " V2", " Acoustic Version", " Don't, {{Stop}}!", " (A (B) C) Demo 3", " Live 2011 Mix",
]  # what follows a part's name, by p_partkey modulo ten


def records(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    ends = F.array(*(F.concat(*(F.col("p_brand") if x == "{b}" else F.lit(x.replace("{{", "{").replace("}}", "}")) for x in f.replace("{b}", "\0{b}\0").split("\0"))) if "{b}" in f else F.lit(f.replace("{{", "{").replace("}}", "}")) for f in FORMS))
    return p.select(
        k.alias("record"), F.concat("p_name", F.get(ends, (k % 10).cast("int"))).alias("track"),
        F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, F.concat("p_brand", F.lit(" & Friends"))).when(k % 4 == 2, F.lit("Various Artists")).alias("band"),
        F.when(k % 9 == 0, F.concat(F.lit("Live in "), "p_brand")).otherwise("Album").alias("album"), F.when(k % 13 != 0, F.col("p_size") * 10.0 + k % 7).alias("length"),
        (k % 30).cast("int").alias("lines"), (k % 3 == 0).alias("synced"), "p_name", "p_brand", (F.col("p_size") * 10.0).alias("duration"),
    )


def form_sql() -> str:
    return "CASE p_partkey % 10 " + " ".join("WHEN {} THEN '{}'".format(i, f.replace("'", "''").replace("{b}", "' || p_brand || '").replace("{{", "{").replace("}}", "}")) for i, f in enumerate(FORMS)) + " END"


RECS = f"""recs AS (SELECT p_partkey AS record, p_name || {form_sql()} AS track, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' & Friends' WHEN 2 THEN 'Various Artists' END AS band,
  CASE WHEN p_partkey % 9 = 0 THEN 'Live in ' || p_brand ELSE 'Album' END AS album, CASE WHEN p_partkey % 13 <> 0 THEN p_size * 10.0::DOUBLE + p_partkey % 7 END AS length, CAST(p_partkey % 30 AS INTEGER) AS lines, p_partkey % 3 = 0 AS synced, p_name, p_brand, p_size * 10.0::DOUBLE AS duration FROM part)"""


def norm_sql(c: str) -> str:
    """Two rounds of innermost brackets are enough for these titles; then the same words by a list of tokens."""
    bare = c
    for _ in range(2):
        bare = f"regexp_replace({bare}, '[(\\[{{][^()\\[\\]{{}}]*[)\\]}}]', '', 'g')"
    words = f"list_filter(string_split(regexp_replace(replace(lower({bare}), '''', ''), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' '), lambda w: w <> '')"
    cut = f"coalesce(list_min(list_filter([list_position({words}, 'feat'), list_position({words}, 'ft'), list_position({words}, 'featuring')], lambda i: i > 0)), 1000)"
    return f"array_to_string(list_slice({words}, 1, {cut} - 1), ' ')"


TAGS = "[" + ", ".join(f"'{w}'" for w in N.VERSION_WORDS) + "]"
STRIP = f"""WITH RECURSIVE {{views}}, s AS (
  SELECT {{key}} AS id, string_split({{norm}}, ' ') AS w FROM {{source}}
  UNION ALL SELECT id, list_slice(w, 1, len(w) - 1) FROM s WHERE len(w) > 1 AND (list_contains({TAGS}, w[-1]) OR regexp_full_match(w[-1], 'v[0-9]+')
    OR (regexp_full_match(w[-1], '[0-9]+') AND (list_contains({TAGS}, w[-2]) OR regexp_full_match(w[-2], 'v[0-9]+')))))"""


@query("normalize_title", f"WITH {RECS} SELECT record, {norm_sql('track')} AS norm FROM recs")
def normalize_title(spark, sf):
    return records(spark, sf).select("record", N.normalize_title(F.col("track")).alias("norm"))


@query("strip_version", STRIP.format(views=RECS, key="record", norm=norm_sql("track"), source="recs") + " SELECT id AS record, array_to_string(arg_min(w, len(w)), ' ') AS bare FROM s GROUP BY id")
def strip_version(spark, sf):
    return records(spark, sf).select("record", N.strip_version(N.normalize_title(F.col("track"))).alias("bare"))


@query("artist_match", f"WITH {RECS}, n AS (SELECT record, {norm_sql('p_brand')} AS a, {norm_sql(chr(99) + 'oalesce(band, ' + chr(39) * 2 + ')')} AS b FROM recs) SELECT record, a <> '' AND b <> '' AND (contains(' ' || b || ' ', ' ' || a || ' ') OR contains(' ' || a || ' ', ' ' || b || ' ')) AS same FROM n")
def artist_match(spark, sf):
    return records(spark, sf).select("record", N.artists_match(N.normalize_title(F.col("p_brand")), N.normalize_title(F.coalesce("band", F.lit("")))).alias("same"))


LIVE = "(len(list_filter(list_zip(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), (list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))[2:]), lambda p: p[1] = 'live' AND p[2] IN ('at', 'in', 'from', 'on'))) > 0 OR contains(lower({c}), '(live') OR contains(lower({c}), '[live') OR contains(lower({c}), '- live') OR list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') = ['live'])"


@query("live_records", f"WITH {RECS} SELECT record, {LIVE.format(c='track')} AS live, {LIVE.format(c='album')} AS live_album FROM recs")
def live_records(spark, sf):
    return records(spark, sf).select("record", N.is_live(F.col("track")).alias("live"), N.is_live(F.col("album")).alias("live_album"))


PICK = (
    STRIP.format(views=RECS, key="record", norm=norm_sql("track"), source="recs")
    + f""", k AS (SELECT id AS record, replace(array_to_string(arg_max(w, len(w)), ' '), ' ', '') AS whole, replace(array_to_string(arg_min(w, len(w)), ' '), ' ', '') AS bare FROM s GROUP BY id),
 m AS (SELECT q.record AS song, q.p_name AS title, {{duration}} AS duration, r.*, {norm_sql('q.p_brand')} AS want, {norm_sql("coalesce(r.band, '')")} AS got
  FROM recs q JOIN k ON replace(lower(q.p_name), ' ', '') IN (k.whole, k.bare) JOIN (SELECT * EXCLUDE (duration) FROM recs) r ON r.record = k.record AND r.lines > 0),
 a AS (SELECT *, contains(' ' || got || ' ', ' ' || want || ' ') OR (got <> '' AND contains(' ' || want || ' ', ' ' || got || ' ')) AS same FROM m),
 b AS (SELECT *, max(same) OVER (PARTITION BY song) AS anyone FROM a),
 c AS (SELECT *, {LIVE.format(c='track')} OR {LIVE.format(c='album')} AS live, abs(length - duration) AS off FROM b WHERE same OR NOT anyone)"""
)


@query("pick_best", PICK.replace("{duration}", "q.duration") + ", d AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY live, CASE WHEN off <= 3 THEN -1 ELSE floor(off / 10) END, lines DESC, synced DESC, off, record) AS rn FROM c WHERE off <= greatest(20, duration * 0.25)) SELECT song, record FROM d WHERE rn = 1")
def pick_best(spark, sf):
    """The best record of every song: title and artist, then studio, band of length, lines, synced, nearest."""
    r = records(spark, sf)
    songs = r.select(F.col("record").alias("song"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "duration")
    return M.best_records(songs, r.drop("p_name", "p_brand", "duration"))


@query("pick_best_nodur", PICK.replace("{duration}", "NULL::DOUBLE") + ", d AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY CASE WHEN live THEN 2 WHEN synced THEN 0 ELSE 1 END, record) AS rn FROM c) SELECT song, record FROM d WHERE rn = 1")
def pick_best_nodur(spark, sf):
    r = records(spark, sf)
    songs = r.select(F.col("record").alias("song"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.lit(None).cast("double").alias("duration"))
    return M.best_records(songs, r.drop("p_name", "p_brand", "duration"))


#: How a look-up asks for a part's record, by p_partkey modulo six: title, artist and length in SQL.
ASKED = [
    ("track", "band", "length"), ("p_name", "p_brand", "duration"), ("p_name", "'Nobody'", "NULL"), ("p_name || ' Acoustic Version Demo'", "p_brand", "duration"), ("p_name || ' Remastered 2011'", "NULL", "NULL"), ("p_brand", "p_name", "duration"),
]


def look_up_sql() -> str:
    """The stages one behind the other; keys of titles by the same recursion as the records'."""
    case = lambda i: "CASE record % 6 " + " ".join(f"WHEN {k} THEN {f[i]}" for k, f in enumerate(ASKED)) + " END"
    views = f"""{RECS}, q AS (SELECT record AS song, CASE WHEN record % 37 = 0 THEN ' ' ELSE {case(0)} END AS title, {case(1)} AS artist, CAST({case(2)} AS DOUBLE) AS duration FROM recs),
 allt AS (SELECT record AS id, track AS t FROM recs UNION ALL SELECT -song - 1, title FROM q UNION ALL SELECT 1000000000 + song, coalesce(artist, '') FROM q)"""
    keys = STRIP.format(views=views, key="id", norm=norm_sql("t"), source="allt") + """, k AS (SELECT id, array_to_string(arg_max(w, len(w)), ' ') AS norm, replace(array_to_string(arg_max(w, len(w)), ' '), ' ', '') AS whole, replace(array_to_string(arg_min(w, len(w)), ' '), ' ', '') AS bare FROM s GROUP BY id),
 r AS (SELECT recs.record, track, album, length, lines, synced, lower(trim(track)) AS lt, lower(trim(band)) AS lb, k.whole, k.bare, """ + norm_sql("coalesce(band, '')") + f""" AS got, {LIVE.format(c='track')} OR {LIVE.format(c='album')} AS live FROM recs JOIN k ON k.id = record WHERE lines > 0),
 a AS (SELECT q.song, q.title, q.artist, q.duration, t.norm AS tn, t.whole AS tw, t.bare AS tb, coalesce(n.norm, '') AS an, coalesce(n.whole, '') AS aw, {LIVE.format(c='q.title')} AS tl, coalesce({LIVE.format(c='q.artist')}, FALSE) AS al
  FROM q JOIN k t ON t.id = -q.song - 1 JOIN k n ON n.id = 1000000000 + q.song WHERE trim(q.title) <> ''),
 f1 AS (SELECT song, min(record) AS record, 'exact' AS stage FROM a JOIN r ON r.lt = lower(trim(a.title)) AND r.lb = lower(trim(a.artist)) WHERE coalesce(abs(length - duration) <= 2, TRUE) GROUP BY song)"""

    def stage(n: int, name: str, key: str, want: str, live: str, where: str, only: bool) -> str:
        seen = " UNION ALL ".join(f"SELECT song FROM f{i}" for i in range(1, n))
        return f""",
 m{n} AS (SELECT a.song, a.duration, r.*, r.live AND NOT a.{live} AS far, abs(r.length - a.duration) AS off, a.{want} AS want, a.{want} <> '' AND r.got <> '' AND (contains(' ' || r.got || ' ', ' ' || a.{want} || ' ') OR contains(' ' || a.{want} || ' ', ' ' || r.got || ' ')) AS same
  FROM a JOIN r ON a.{key} <> '' AND a.{key} IN (r.whole, r.bare) WHERE {where} AND a.song NOT IN ({seen})),
 n{n} AS (SELECT *, max(same) OVER (PARTITION BY song) AS anyone FROM m{n}),
 f{n} AS (SELECT song, record, '{name}' AS stage FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY CASE WHEN duration > 0 THEN far END, CASE WHEN duration > 0 THEN CASE WHEN off <= 3 THEN -1 ELSE floor(off / 10) END END, CASE WHEN duration > 0 THEN -lines END, CASE WHEN duration > 0 THEN NOT synced END, CASE WHEN duration > 0 THEN off END,
  CASE WHEN far THEN 2 WHEN synced THEN 0 ELSE 1 END, record) AS rn FROM n{n} WHERE (same OR NOT (anyone OR {only})) AND (coalesce(duration, 0) <= 0 OR off <= greatest(20, duration * 0.25))) WHERE rn = 1)"""

    rest = [("title and artist", "tw", "an", "tl", "a.an <> ''", True), ("title", "tw", "an", "tl", "TRUE", False), ("bare title and artist", "tb", "an", "tl", "a.an <> '' AND a.tb <> a.tw", True), ("bare title", "tb", "an", "tl", "a.tb <> a.tw", False), ("swapped", "aw", "tn", "al", "a.an <> ''", True)]
    return keys + "".join(stage(n, *x) for n, x in enumerate(rest, 2)) + " " + " UNION ALL ".join(f"SELECT * FROM f{n}" for n in range(1, 7))


@query("look_up", look_up_sql())
def look_up(spark, sf):
    """Each part looked up in the catalogue by what is known of it, stage by stage."""
    r = records(spark, sf).withColumn("nothing", F.lit(None).cast("string"))
    pick = lambda i: F.coalesce(*(F.when(F.col("record") % 6 == k, F.expr(f[i])) for k, f in enumerate(ASKED)))
    title = F.when(F.col("record") % 37 == 0, " ").otherwise(pick(0))
    songs = r.select(F.col("record").alias("song"), title.alias("title"), pick(1).alias("artist"), pick(2).cast("double").alias("duration"))
    return M.look_up(songs, r.drop("p_name", "p_brand", "duration", "nothing"))


VIDEO = [" (Official Video)", " [Lyrics]", " (Acoustic)", " | Channel", " [HD] (4K)", " (Live Performance at home)", " [Session 3]"]


def video_sql() -> str:
    end = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VIDEO)) + " END"
    return f"video AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand || ' - ' || p_name) WHEN 1 THEN p_brand || ' – ' || p_name ELSE p_name END || {end} AS raw, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' - Topic' WHEN 1 THEN p_brand || 'VEVO' WHEN 2 THEN 'me@example.org' WHEN 3 THEN p_brand END AS channel, CASE WHEN p_partkey % 11 = 0 THEN 'Creator  Name' END AS credited FROM part)"


def tidy_sql(c: str) -> str:
    return f"CASE WHEN length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) >= 4 AND {c} = upper({c}) THEN array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE {c} END"


GROUPS = f"""parts AS (SELECT *, string_split(raw, ' | ')[1] AS cut, CASE WHEN contains(raw, ' - ') THEN ' - ' WHEN contains(raw, ' – ') THEN ' – ' END AS dash FROM video),
 sides AS (SELECT id, credited, channel, CASE WHEN dash IS NULL THEN cut ELSE substring(cut, strpos(cut, dash) + length(dash)) END AS title, CASE WHEN dash IS NOT NULL THEN string_split(cut, dash)[1] END AS named FROM parts),
 bare AS (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(title, '\\([^)]*\\)|\\[[^\\]]*\\]|[^(\\[]+'), lambda g: CASE WHEN NOT regexp_matches(g, '^[(\\[]') OR (len(list_intersect(string_split_regex(lower(g), '[^\\p{{L}}\\p{{N}}/]+'), [{', '.join(f"'{w}'" for w in N.NOISE_WORDS)}])) = 0
   AND NOT contains(lower(g), 'live performance') AND NOT contains(lower(g), 'full song')) THEN g ELSE '' END), lambda g: g <> ''), '') AS kept,
   coalesce(nullif(trim(credited), ''), named, CASE WHEN NOT contains(channel, '@') THEN nullif(trim(replace(replace(channel, ' - Topic', ''), 'VEVO', '')), '') END) AS who FROM sides)"""


@query("clean_titles", f"WITH {video_sql()}, {GROUPS} SELECT id, {tidy_sql('trim(regexp_replace(kept, ' + chr(39) + ' +' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')} AS title, {tidy_sql('regexp_replace(who, ' + chr(39) + ' +' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS artist FROM bare")
def clean_titles(spark, sf):
    """Titles and artists read from video titles, channels and credits."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    dashed = F.when(k % 3 == 0, F.upper(F.concat("p_brand", F.lit(" - "), "p_name"))).when(k % 3 == 1, F.concat("p_brand", F.lit(" – "), "p_name")).otherwise(F.col("p_name"))
    raw = F.concat(dashed, F.get(F.array(*map(F.lit, VIDEO)), (k % 7).cast("int")))
    channel = F.when(k % 5 == 0, F.concat("p_brand", F.lit(" - Topic"))).when(k % 5 == 1, F.concat("p_brand", F.lit("VEVO"))).when(k % 5 == 2, F.lit("me@example.org")).when(k % 5 == 3, F.col("p_brand"))
    title, artist = N.song_meta(raw, F.lit(None).cast("string"), F.when(k % 11 == 0, F.lit("Creator  Name")), channel)
    return p.select(k.alias("id"), title.alias("title"), artist.alias("artist"))


@query("album_versions", "SELECT page_id, CASE WHEN contains(url, 'youtube') THEN 'YouTube' ELSE 'Web' END AS label, contains(url, 'youtube') AND page_id % 3 <> 0 AS hint FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'youtube:tab' ELSE '' END AS url FROM pages)")
def album_versions(spark, sf):
    i = F.col("page_id")
    site = F.when(i % 2 == 0, "youtube:tab").otherwise("")
    channel = F.when(i % 3 == 0, F.lit("Band - Topic"))
    return table(spark, sf, "pages").select("page_id", N.site_label(site).alias("label"), N.may_have_album_version(site, channel).alias("hint"))


@query("link_texts", "WITH t AS (SELECT page_id, list_distinct([url]) || CASE WHEN page_id % 2 = 0 THEN ['https://www.example.org/a' || page_id] ELSE [] END AS links FROM pages) SELECT page_id, array_to_string(links, ' ') AS links FROM t")
def link_texts(spark, sf):
    """Links of pasted texts, in order and once each, bare hosts completed."""
    i = F.col("page_id").cast("string")
    text = F.concat(F.lit("see <"), "url", F.lit(">, and "), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("www.example.org/a"), i)).otherwise("nothing"), F.lit('). "'), "url", F.lit('" not.a/link'))
    return table(spark, sf, "pages").select("page_id", F.array_join(N.links(text), " ").alias("links"))


@query("thumbnails", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'c.jpeg' ELSE 'b.PNG?x=1' END AS url FROM pages")
def thumbnails(spark, sf):
    """The largest still picture, the last among equals; other formats have none."""
    i = F.col("page_id")
    one = lambda u, w, h: F.struct(F.lit(u).alias("url"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    listed = F.when(i % 4 == 0, F.array(one("a.webp", 99, 99))).when(i % 2 == 0, F.array(one("a.webp", 99, 99), one("b.png", 10, 20), one("c.jpeg", 20, 10))).otherwise(F.array(one("a.jpg", 3, 4), one("b.PNG?x=1", 5, 6), one("c.jpg", None, 6)))
    return table(spark, sf, "pages").select("page_id", N.thumbnail(listed).alias("url"))


@query("export_names", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'song' ELSE p_name || CASE p_partkey % 5 WHEN 1 THEN ' ab' WHEN 2 THEN ' x' ELSE '' END END || '.lrc' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '/' || p_type END AS folder FROM part")
def export_names(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    title = F.when(k % 5 == 0, "???").otherwise(F.concat("p_name", F.when(k % 5 == 1, "  a:b").when(k % 5 == 2, " x. .").otherwise("")))
    path = F.concat("p_brand", F.when(k % 2 == 0, F.lit("\\")).otherwise(F.concat(F.lit("/"), "p_type", F.lit("/"))), F.lit("f.mp3"))
    return p.select(k.alias("id"), N.export_name(title, "lrc").alias("name"), N.folder_of(path).alias("folder"))
