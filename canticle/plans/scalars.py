"""Small rules over the parts, events and vectors; library changes that need no song."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.functions import scalars as S
from canticle.operators import library as L
from canticle.operators import signal as G
from canticle.plans import query
from canticle.plans.signal import DB, FRAMES, frames
from canticle.plans.views import COLL, LIB, coll, lib, table

HEX = "CASE WHEN p_partkey % 20 = 0 THEN 'red' ELSE printf('#%06X', p_partkey * 7919 % 16777216) END"
LUM = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})"


def lum_sql(n: str) -> str:
    parts = [f"(({n}) // {d} % 256 / 255.0::DOUBLE)" for d in (65536, 256, 1)]
    return LUM.format(*(f"(CASE WHEN {s} <= 0.04045 THEN {s} / 12.92 ELSE pow(({s} + 0.055) / 1.055, 2.4) END)" for s in parts))


@query("contrast", f"WITH c AS (SELECT p_partkey AS id, {lum_sql('p_partkey * 7919 % 16777216')} AS a, {lum_sql('p_partkey * 104729 % 16777216')} AS b FROM part) SELECT id, CASE WHEN id % 20 <> 0 THEN round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) END AS ratio FROM c")
def contrast(spark, sf):
    """Contrast of two colours; what is no colour has none."""
    k = F.col("p_partkey")
    a = F.when(k % 20 == 0, "red").otherwise(F.format_string("#%06X", k * 7919 % 16777216))
    return table(spark, sf, "part").select(k.alias("id"), F.round(S.contrast(a, F.format_string(" %06x ", k * 104729 % 16777216)), 6).alias("ratio"))


@query("fetch_rates", "SELECT p_partkey AS id, greatest(8000, CAST(ceil(CASE WHEN p_partkey % 3 <> 0 AND p_size > 5 THEN p_retailprice * 1000 / p_size WHEN p_partkey % 4 <> 0 THEN p_partkey % 200 * 125.0::DOUBLE END) AS BIGINT)) AS rate, round(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE least(1.0, (p_partkey % 90) / 60.0::DOUBLE) END, 6) AS fraction FROM part WHERE p_partkey % 200 <> 0 AND NOT (p_partkey % 4 = 0 AND (p_partkey % 3 = 0 OR p_size <= 5))")
def fetch_rates(spark, sf):
    """Download caps by size or bit rate, and the share done that progress lines tell."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    size = F.when(k % 3 != 0, F.col("p_retailprice") * 1000)
    rate = S.playback_rate(size, F.when(F.col("p_size") > 5, F.col("p_size")), F.when(k % 4 != 0, (k % 200).cast("double")))
    line = F.concat_ws(" ", (k % 90).cast("string"), F.when(k % 5 == 0, "NA").when(k % 2 == 0, "60").otherwise("NA"), F.when(k % 5 == 0, "NA").otherwise("60"))
    return p.select(k.alias("id"), rate.alias("rate"), F.round(S.progress_fraction(line), 6).alias("fraction")).where(F.col("rate").isNotNull() & (k % 200 != 0) & ~((k % 4 == 0) & ((k % 3 == 0) | (F.col("p_size") <= 5))))


@query("view_geometry", """WITH v AS (SELECT event_id, value AS nat, 300.0::DOUBLE AS room, value / 10 AS a, value / 10 + event_id % 7 AS b, 45.0::DOUBLE AS d FROM events), f AS (SELECT *, floor(room / nat * 1000) / 1000 AS raw FROM v), w AS (SELECT *, greatest(0, floor(a - 0.6)) AS wa, least(greatest(d, b), ceil(b + 0.6)) AS wb FROM f)
SELECT event_id, CASE WHEN nat <= room OR nat <= 0 THEN 1.0 ELSE greatest(raw, 0.55) END AS scale, nat > room AND raw < 0.55 AS wrap, wa AS low, greatest(wb, wa + 1) AS high, round((a - wa) / (greatest(wb, wa + 1) - wa) * 640, 6) AS x, CAST((a > 10)::INT + (a > 20)::INT + (a > 30)::INT AS INTEGER) AS slot, 0.25 + 0.75 * least(1, a / 40) AS pulse, round(least(1, a / 40 * (0.35 + 0.65 * abs(sin(5.1 + a * (1.3 + 3 * 0.35))))), 6) AS bar FROM w""")
def view_geometry(spark, sf):
    """Line fit, line windows, pixels, drop slots, pulse and bars at each event's value."""
    v = F.col("value")
    a, b = v / 10, v / 10 + F.col("event_id") % 7
    scale, wrap = S.line_fit(v, F.lit(300.0))
    low, high = S.line_window(a, b, F.lit(45.0))
    e = table(spark, sf, "events").select("event_id", scale.alias("scale"), wrap.alias("wrap"), low.alias("low"), high.alias("high"), a.alias("a"))
    x = S.to_pixels(F.col("a"), F.col("low"), F.col("high"), F.lit(640))
    middles = F.array(*(F.lit(float(m)) for m in (10, 20, 30)))
    return e.select("event_id", "scale", "wrap", "low", "high", F.round(x, 6).alias("x"), S.slot(middles, F.col("a")).alias("slot"), S.pulse(F.col("a") / 40).alias("pulse"), F.round(F.get(S.bar_heights(F.col("a") / 40, F.col("a"), 24), F.lit(3)), 6).alias("bar"))


@query("escapes", "SELECT page_id, replace(replace(replace(url, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS liked, array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN regexp_full_match(substr(t, i, 1), '[A-Za-z0-9._~-]') THEN substr(t, i, 1) ELSE regexp_replace(hex(encode(substr(t, i, 1))), '(..)', '%\\1', 'g') END), '') AS encoded FROM (SELECT page_id, url, url || ' *~é' AS t FROM pages)")
def escapes(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.escape_like(F.col("url")).alias("liked"), S.percent_encode(F.concat("url", F.lit(" *~é"))).alias("encoded"))


KNOWN = {"scheme": ("string", "classic", ("classic", "night")), "autoAdvance": ("boolean", False, None), "advanceSeconds": ("double", 10.0, (3, 30))}


@query("settings_merge", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'night' ELSE 'classic' END AS scheme, event_id % 4 = 0 AS auto, CASE WHEN event_id % 6 = 0 THEN 10 ELSE least(30, greatest(3, round(value / 10))) END AS secs FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, 'classic', FALSE, 10 FROM events WHERE event_id % 11 = 0")
def settings_merge(spark, sf):
    """Stored settings with defaults field by field; a broken blob is all defaults."""
    i = F.col("event_id")
    parts = F.concat(F.lit('{"scheme":'), F.when(i % 3 == 0, '"night"').when(i % 3 == 1, '"plaid"').otherwise("7"), F.lit(',"autoAdvance":'), F.when(i % 4 == 0, "true").otherwise('"yes"'), F.lit(',"advanceSeconds":'), F.when(i % 6 == 0, '"soon"').otherwise((F.col("value") / 10).cast("string")), F.lit("}"))
    blob = F.when(i % 11 == 0, "{broken").otherwise(parts)
    s = S.settings(blob, KNOWN)
    return table(spark, sf, "events").select("event_id", s["scheme"].alias("scheme"), s["autoAdvance"].alias("auto"), s["advanceSeconds"].alias("secs"))


@query("tone_measures", f"WITH {FRAMES}, s AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM frames), d AS (SELECT vec_id, max(abs(v - p)) AS delta FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM s) GROUP BY 1), g AS (SELECT vec_id, pow(sum(v * cos(2 * pi() * 0.125 * i)), 2) + pow(sum(v * sin(2 * pi() * 0.125 * i)), 2) AS power FROM s GROUP BY 1), e AS (SELECT vec_id, w, sqrt(sum(v * v) / 16) AS rms FROM s, range(0, 7) t(w) WHERE i >= w * 8 AND i < w * 8 + 16 GROUP BY ALL) SELECT vec_id, round(power, 6) AS power, round(delta, 6) AS delta, round(sum(rms), 6) AS rms FROM g JOIN d USING (vec_id) JOIN e USING (vec_id) GROUP BY ALL")
def tone_measures(spark, sf):
    """Power of one tone, the largest step and the summed envelope of each frame."""
    x = F.col("x")
    return frames(spark, sf).select("vec_id", F.round(S.goertzel(x, 0.125), 6).alias("power"), F.round(S.max_delta(x), 6).alias("delta"), F.round(G.total(S.rms_envelope(x, 16, 8)), 6).alias("rms"))


@query("mel_scale", "SELECT p_partkey AS id, round(CASE WHEN p_retailprice * 4 < 1000 THEN p_retailprice * 4 * 3 / 200 ELSE 15 + 27 * ln(p_retailprice * 4 / 1000) / ln(6.4) END, 6) AS mel, TRUE AS back FROM part")
def mel_scale(spark, sf):
    """Frequencies on the mel scale and back."""
    hz = F.col("p_retailprice") * 4
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(S.hz_to_mel(hz), 6).alias("mel"), (F.abs(S.mel_to_hz(S.hz_to_mel(hz)) - hz) < 1e-6 * hz).alias("back"))


LEVEL = f"lv AS (SELECT song, frame_idx, {DB} AS db FROM frames), top AS (SELECT song, list_sort(list(db))[CAST(floor((count(*) - 1) * 0.95) AS INTEGER) + 1] AS level FROM lv GROUP BY song)"


@query("voiced_chunks", f"WITH {FRAMES}, {LEVEL}, c AS (SELECT l.song, frame_idx // 8 AS chunk, avg(CASE WHEN db > level - 3 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM lv l JOIN top USING (song) GROUP BY ALL) SELECT song, CAST(chunk AS BIGINT) AS chunk, round(share, 6) AS share, share >= 0.03 AS voiced FROM c")
def voiced_chunks(spark, sf):
    """Chunks of eight frames with the share that is near the song's loud level (3 dB here, as the vectors are all loud)."""
    f = frames(spark, sf).withColumn("db", G.frame_db(F.col("x")))
    return G.voiced(f, "song", "frame_idx", "db", 8, 3.0, 0.03).withColumn("share", F.round("share", 6))


@query("silent_totals", f"WITH {FRAMES}, f AS (SELECT *, x[1] < 0 AS quiet FROM frames), r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY song, quiet ORDER BY frame_idx) AS run FROM f), s AS (SELECT song, count(*) AS n FROM r WHERE quiet GROUP BY song, run) SELECT song, count(*) AS stretches, round(sum(n) * 0.02, 6) AS secs, max(n) AS longest FROM s WHERE n >= 2 GROUP BY song")
def silent_totals(spark, sf):
    """Silent stretches of two frames and more of each song: how many, how long in all, and the longest."""
    runs = G.runs(frames(spark, sf).withColumn("quiet", F.get("x", F.lit(0)) < 0), "song", "frame_idx", "quiet").withColumn("n", (F.col("last") - F.col("first") + 1).cast("long"))
    return runs.where("n >= 2").groupBy("song").agg(F.count("*").alias("stretches"), F.round(F.sum("n") * 0.02, 6).alias("secs"), F.max("n").alias("longest"))


@query("word_confidence", f"WITH {FRAMES}, w AS (SELECT song, frame_idx // 3 AS word, exp(avg(-abs(x[1]))) AS c, min(frame_idx) AS first, max(frame_idx) AS last FROM frames GROUP BY ALL) SELECT song, CAST(word AS BIGINT) AS word, round(least(1, greatest(0, c)), 6) AS confidence, first, last FROM w")
def word_confidence(spark, sf):
    """Words over spans of token frames: their first and last frame and the mean of log-probabilities as a confidence."""
    f = frames(spark, sf).select("song", "frame_idx", F.floor(F.col("frame_idx") / 3).alias("word"), (-F.abs(F.get("x", F.lit(0)))).alias("logp"))
    return G.over_spans(f, ["song", "word"]).withColumn("confidence", F.round("confidence", 6))


@query("stem_minima", f"WITH {FRAMES}, p AS (SELECT song, frame_idx % 4 AS stem, x, lead(x) OVER (PARTITION BY song ORDER BY frame_idx) AS y FROM frames), s AS (SELECT stem, 10 * log10(list_sum(list_transform(x, lambda a: a * a)) / list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS snr, sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(x)) AS rms FROM p WHERE y IS NOT NULL) SELECT stem, round(min(snr), 6) AS snr, round(max(rms), 6) AS rms FROM s GROUP BY GROUPING SETS ((stem), ())")
def stem_minima(spark, sf):
    """The worst signal-to-noise ratio and error of each stem, and of all."""
    p = frames(spark, sf).withColumn("y", F.lead("x").over(Window.partitionBy("song").orderBy("frame_idx"))).where("y IS NOT NULL").withColumn("stem", F.col("frame_idx") % 4)
    error = F.sqrt(G.total(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))) / F.size("x"))
    s = p.select("stem", G.snr_db(F.col("x"), F.col("y")).alias("snr"), error.alias("rms"))
    return s.rollup("stem").agg(F.round(F.min("snr"), 6).alias("snr"), F.round(F.max("rms"), 6).alias("rms"))


@query("gain_blend", f"WITH {FRAMES}, p AS (SELECT vec_id, x, lead(x) OVER (PARTITION BY song ORDER BY frame_idx) AS y FROM frames) SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] + p[2])), 6) AS stems, round(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] + p[2]) / 2)), 6) AS mono, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] + least(1.0, greatest(-0.5, (vec_id % 8) / 4.0::DOUBLE - 1)) * p[2])), 6) AS blend FROM p WHERE y IS NOT NULL")
def gain_blend(spark, sf):
    """Two stems summed, mixed down and blended with a gain held between -0.5 and 1."""
    p = frames(spark, sf).withColumn("y", F.lead("x").over(Window.partitionBy("song").orderBy("frame_idx"))).where("y IS NOT NULL")
    gain = S.clamp((F.col("vec_id") % 8) / 4.0 - 1, -0.5, 1.0)
    p = p.withColumn("gain", gain)
    each = lambda f: F.round(G.total(F.zip_with("x", "y", f)), 6)
    return p.select("vec_id", each(lambda a, b: a + b).alias("stems"), each(lambda a, b: (a + b) / 2).alias("mono"), each(lambda a, b: a + F.col("gain") * b).alias("blend"))


# Library changes


@query("song_scan", f"WITH {LIB} SELECT sha256(concat_ws('|', id, title, coalesce(artist, ''), coalesce(album, ''), audio_path, audio_hash, job_dir, coalesce(timing_map_path, ''), coalesce(vocals_path, ''), coalesce(instrumental_path, ''), coalesce(cover_path, ''), lyric_source, language_tag, date_added, coalesce(last_played, 0), play_count, coalesce(reviewed_at, 0), coalesce(year, 0), coalesce(genre, ''))) AS row, duration_s, pace_wpm FROM lib")
def song_scan(spark, sf):
    """Every song with all its columns, the texts as one hash."""
    columns = ("id", "title", "artist", "album", "audio_path", "audio_hash", "job_dir", "timing_map_path", "vocals_path", "instrumental_path", "cover_path", "lyric_source", "language_tag", "date_added")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    text += [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("last_played", "play_count", "reviewed_at", "year")] + [F.coalesce("genre", F.lit(""))]
    return lib(spark, sf).select(F.sha2(F.concat_ws("|", *text), 256).alias("row"), "duration_s", "pace_wpm")


@query("song_lookup", f"WITH {LIB} SELECT 'id' AS by, id, title FROM lib WHERE id = 7 UNION ALL SELECT 'hash', id, title FROM lib WHERE audio_hash = sha256('9')")
def song_lookup(spark, sf):
    """One song by its id and one by the hash of its audio; the id reaches the scan as a filter."""
    songs = lib(spark, sf)
    by = lambda name, test: songs.where(test).select(F.lit(name).alias("by"), "id", "title")
    return by("id", F.col("id") == 7).unionByName(by("hash", F.col("audio_hash") == F.sha2(F.lit("9"), 256)))


SETTINGS = "s AS (SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation), ch AS (SELECT n_name AS key, 'new' AS value FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT r_name, 'region' FROM region)"


def stored(spark, sf):
    n = table(spark, sf, "nation")
    old = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return old, n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("key"), F.lit("new").alias("value")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit("region").alias("value")))


@query("settings_put", f"WITH {SETTINGS} SELECT * FROM s WHERE key NOT IN (SELECT key FROM ch) UNION ALL SELECT * FROM ch")
def settings_put(spark, sf):
    """Key-value rows put into a store: a new value replaces, a new key is added; sidecars and caches are kept the same way."""
    return L.put(*stored(spark, sf), "key")


@query("key_migration", f"WITH {SETTINGS} SELECT * FROM s UNION ALL SELECT 'app.' || key, value FROM s WHERE length(key) > 6 AND 'app.' || key NOT IN (SELECT key FROM s)")
def key_migration(spark, sf):
    """Values copied once to new key names; old ones stay."""
    old, _ = stored(spark, sf)
    names = old.where(F.length("key") > 6).select(F.col("key").alias("old"), F.concat(F.lit("app."), "key").alias("new"))
    return L.migrate_keys(old, names)


@query("set_covers", f"WITH {LIB} SELECT id, CASE WHEN id % 6 = 0 THEN coalesce(cover_path, 'found') WHEN id % 6 = 1 THEN 'mine' WHEN id % 6 = 2 THEN NULL ELSE cover_path END AS cover_path, CASE WHEN id % 6 = 1 THEN TRUE WHEN id % 6 = 2 THEN FALSE ELSE cover_by_user END AS cover_by_user FROM lib")
def set_covers(spark, sf):
    """Covers found where there is none, chosen by the user, and cleared."""
    songs, i = lib(spark, sf), F.col("id")
    action = F.when(i % 6 == 0, "found").when(i % 6 == 1, "user").when(i % 6 == 2, "clear")
    changes = songs.select("id", action.alias("action"), F.when(i % 6 == 0, "found").when(i % 6 == 1, "mine").alias("path")).where("action is not null")
    return L.set_covers(songs, changes).select("id", "cover_path", "cover_by_user")


@query("collections_made", f"WITH {COLL}, w AS (SELECT upper(s_name) AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT '  new ' || (s_suppkey % 3) || ' ' FROM supplier UNION ALL SELECT 'NEW 1' UNION ALL SELECT '  '), n AS (SELECT lower(trim(name)) AS f, min(trim(name)) AS name FROM w WHERE trim(name) <> '' GROUP BY 1) SELECT n.name, c.id, CASE WHEN c.id IS NULL THEN 'create' ELSE 'use' END AS outcome FROM n LEFT JOIN coll c ON lower(trim(c.name)) = n.f")
def collections_made(spark, sf):
    """Collections that an import names: known ones by folded name, the rest made once."""
    s = table(spark, sf, "supplier")
    new = s.select(F.concat(F.lit("  new "), (F.col("s_suppkey") % 3).cast("string"), F.lit(" ")).alias("name"))
    wanted = s.where("s_suppkey % 2 = 0").select(F.upper("s_name").alias("name")).unionByName(new).unionByName(spark.createDataFrame([("NEW 1",), ("  ",)], "name string"))
    return L.create_collections(coll(spark, sf), wanted)


@query("collections_renamed", f"WITH {COLL}, r AS (SELECT id, CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Name ' || (id // 10) WHEN 2 THEN name WHEN 3 THEN (SELECT min(name) FROM coll) END AS nn FROM coll WHERE id % 5 <> 4), a AS (SELECT c.id, c.name, trim(r.nn) AS nn, min(CASE WHEN r.nn IS NOT NULL THEN c.id END) OVER (PARTITION BY trim(r.nn)) AS first FROM coll c LEFT JOIN r USING (id)), b AS (SELECT *, CASE WHEN nn IS NULL THEN 'kept' WHEN nn = '' THEN 'blank' WHEN EXISTS (SELECT 1 FROM coll o WHERE o.name = nn AND o.id <> a.id) OR first <> id THEN 'taken' ELSE 'renamed' END AS outcome FROM a) SELECT id, CASE WHEN outcome = 'renamed' THEN nn ELSE name END AS name, outcome FROM b")
def collections_renamed(spark, sf):
    """Renames, with blank and taken names refused."""
    c, i = coll(spark, sf), F.col("id")
    least = F.broadcast(c.agg(F.min("name").alias("least")).withColumn("_one", F.lit(1)))  # one row
    name = F.when(i % 5 == 0, " ").when(i % 5 == 1, F.concat(F.lit("Name "), F.floor(i / 10).cast("string"))).when(i % 5 == 2, F.col("name")).otherwise(F.col("least"))
    asks = c.where(i % 5 != 4).withColumn("_one", F.lit(1)).join(least, "_one").select("id", name.alias("new_name"))
    return L.rename_collections(c, asks)


@query("catalog_rewrite", f"WITH {LIB} SELECT id, CASE WHEN starts_with(lower(audio_path), 'music/') THEN 'D:/songs' || substring(audio_path, 6) ELSE audio_path END AS audio_path, job_dir, cover_path FROM lib")
def catalog_rewrite(spark, sf):
    """A moved folder in every text column of a table."""
    return L.rewrite_texts(lib(spark, sf).select("id", "audio_path", "job_dir", "cover_path"), "MUSIC\\", "D:/songs")


@query("schema_migration", "SELECT p_partkey AS id, p_name AS title, NULL AS artist, NULL AS reviewed_at, NULL AS year, NULL AS genre, NULL AS pace_wpm, 0 AS meta_version, FALSE AS cover_by_user FROM part")
def schema_migration(spark, sf):
    """A table of the first version brought up to the last: rows kept, new columns empty."""
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    new, _ = L.migrate(old.withColumn("artist", F.lit(None).cast("string")), 1, L.MIGRATIONS)
    return new


THEMES = [("night", True), ("paper", True), ("gone", False)]


@query("theme_pins", f"WITH {LIB}, p AS (SELECT id, CASE id % 4 WHEN 0 THEN 'night' WHEN 1 THEN 'gone' WHEN 2 THEN 'paper' END AS pin FROM lib) SELECT id, CASE WHEN pin IN ('night', 'paper') THEN pin ELSE 'paper' END AS theme, coalesce(pin IN ('night', 'paper'), FALSE) AS pinned FROM p")
def theme_pins(spark, sf):
    """The theme of each song: its pin where that theme still exists, else the default, else the built-in one."""
    i = F.col("id")
    pins = lib(spark, sf).select("id", F.when(i % 4 == 0, "night").when(i % 4 == 1, "gone").when(i % 4 == 2, "paper").alias("pin"))
    have = spark.createDataFrame([t for t, there in THEMES if there], "string").toDF("theme")
    return L.themes(pins, have, "paper", "classic")


@query("swap_link", "SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'https://album.example.org/' || page_id ELSE url END AS url FROM pages WHERE page_id % 6 <> 2")
def swap_link(spark, sf):
    """Links with one of a list put in place of another, in its place; a row that shows the new one already is dropped."""
    i = F.col("page_id")
    album = F.concat(F.lit("https://album.example.org/"), (i - i % 6 + 1).cast("string"))
    links = table(spark, sf, "pages").select(F.floor(i / 6).alias("list"), i.alias("page_id"), F.when(i % 6 == 2, album).otherwise(F.col("url")).alias("url"))
    swaps = links.where(i % 6 == 1).select("list", F.col("page_id").alias("at"), album.alias("new"))
    return L.swap_links(links, swaps).select("page_id", "url")
