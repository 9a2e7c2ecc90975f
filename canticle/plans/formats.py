"""Formats and song folders: exports of the timed words, and files made around the parts' names, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.plans import query
from canticle.plans.lyrics import formed, formed_sql, quoted, values
from canticle.plans.views import WORDS, table, words
from canticle.shipping import ship
from canticle.sources import folders as D
from canticle.sources import lrc as R
from canticle.sources import songfiles as S
from canticle.storage import Scratch

#: Hours between events become seconds between words.
PACE = 7200.0


def timed(spark, sf):
    """The words on a song's own clock, with asides."""
    w = words(spark, sf)
    zero = F.min("start").over(Window.partitionBy("song_id"))
    at = lambda c: F.round((F.col(c) - zero) / PACE, 3)
    return w.select("song_id", "word_idx", F.col("event_type").alias("word"), at("start").alias("start"), at("end").alias("end"), "unsung", "line", (F.col("event_type") == "click").alias("ad_lib"))


TIMED = f"""{WORDS}, timed AS (SELECT song_id, word_idx, event_type AS word, round((start - min(start) OVER s) / {PACE}, 3) AS start, round(("end" - min(start) OVER s) / {PACE}, 3) AS "end", unsung, line, event_type = 'click' AS ad_lib FROM words WINDOW s AS (PARTITION BY song_id)),
lagged AS (SELECT *, lag(line) OVER o AS pl, lag("end") OVER o AS pe FROM timed WINDOW o AS (PARTITION BY song_id ORDER BY word_idx)),
sessions AS (SELECT *, sum(CASE WHEN pe IS NULL OR CASE WHEN line IS NOT NULL AND pl IS NOT NULL THEN line <> pl WHEN line IS NULL AND pl IS NULL THEN start - pe >= 1.5 ELSE TRUE END THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS session,
  CAST(round(start * 1000) AS BIGINT) AS sms, CAST(round("end" * 1000) AS BIGINT) AS ems FROM lagged)"""
EVEN = "(({n}) // {d} - CASE WHEN ({n}) % {d} < 0 THEN 1 ELSE 0 END)"


def even(n: str, d: int) -> str:
    """Nearest multiple, ties to even, by the remainder's double."""
    q, r = f"CAST(floor(({n}) / {d}) AS BIGINT)", f"(({n}) - {d} * CAST(floor(({n}) / {d}) AS BIGINT))"
    return f"({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND abs({q}) % 2 = 1) THEN 1 ELSE 0 END)"


def stamp(c: str) -> str:
    return f"printf('%02d:%02d.%02d', {c} // 6000, {c} // 100 % 60, {c} % 100)"


@query("lrc_export", f"""WITH {TIMED}, c AS (SELECT *, {even('sms', 10)} AS a, {even('ems', 10)} AS b FROM sessions), l AS (SELECT song_id, session, '[' || {stamp('arg_min(a, word_idx)')} || ']' || string_agg('<' || {stamp('a')} || '>' || word || ' ', '' ORDER BY word_idx) || '<' || {stamp('greatest(max(b), arg_min(a, word_idx))')} || '>' || chr(10) AS row FROM c GROUP BY ALL)
SELECT song_id, sha256(string_agg(row, '' ORDER BY session)) AS text, count(*) AS lines FROM l GROUP BY song_id""")
def lrc_export(spark, sf):
    """Every song as enhanced LRC, by the hash of its text."""
    t = R.export(timed(spark, sf), "lrc")
    return t.select("song_id", F.sha2("text", 256).alias("text"), F.regexp_count("text", F.lit("\n")).cast("long").alias("lines"))


BEATS = f"""WITH RECURSIVE {TIMED}, g AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY word_idx) AS k, greatest(0, first_value(sms) OVER (PARTITION BY song_id ORDER BY word_idx)) AS gap FROM sessions),
 q AS (SELECT *, {even('sms - gap', 50)} AS want, {even('ems - gap', 50)} AS e FROM g),
 n AS (SELECT song_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS beat, CAST(0 AS BIGINT) AS busy, CAST(0 AS BIGINT) AS done FROM q WHERE k = 1
  UNION ALL SELECT q.song_id, q.k, greatest(q.want, n.done), n.done, greatest(q.want, n.done) + greatest(1, q.e - greatest(q.want, n.done)) FROM n JOIN q ON q.song_id = n.song_id AND q.k = n.k + 1),
 notes AS (SELECT q.*, n.beat, n.busy, n.done - n.beat AS length FROM n JOIN q USING (song_id, k))"""


@query("beat_roundtrip", BEATS + " SELECT song_id, word_idx, beat, length, round(gap / 1000.0::DOUBLE + beat * 0.05::DOUBLE, 6) AS start FROM notes")
def beat_roundtrip(spark, sf):
    """Words on the beat grid and back in seconds."""
    b = R.beats(timed(spark, sf))
    return b.select("song_id", "word_idx", "beat", "length", F.round(F.col("gap") / 1000 + F.col("beat") * 0.05, 6).alias("start"))


@query("ultrastar_export", BEATS + """, r AS (SELECT *, lag(session) OVER o <> session AS turn, lead(session) OVER o IS NOT DISTINCT FROM session AS more FROM notes WINDOW o AS (PARTITION BY song_id ORDER BY k))
SELECT song_id, sha256('#TITLE:Unknown' || chr(10) || '#ARTIST:Unknown' || chr(10) || '#LANGUAGE:English' || chr(10) || '#BPM:300' || chr(10) || '#GAP:' || any_value(gap) || chr(10) ||
 string_agg(CASE WHEN turn THEN '- ' || greatest(want, busy) || chr(10) ELSE '' END || CASE WHEN unsung OR ad_lib THEN 'F' ELSE ':' END || ' ' || beat || ' ' || length || ' 0 ' || word || CASE WHEN more THEN ' ' ELSE '' END || chr(10), '' ORDER BY k) || 'E' || chr(10)) AS text FROM r GROUP BY song_id""")
def ultrastar_export(spark, sf):
    """Every song as UltraStar text, by its hash."""
    return R.export(timed(spark, sf), "ultrastar").select("song_id", F.sha2("text", 256).alias("text"))


@query("ass_export", f"""WITH {TIMED}, u AS (SELECT *, bool_and(unsung) OVER l AS silent, bool_and(ad_lib) OVER l AS aside, greatest(0, {even('sms', 10)}) AS a0, greatest(0, {even('ems', 10)}) AS b0 FROM sessions WINDOW l AS (PARTITION BY song_id, session)),
 m AS (SELECT *, max(a0) OVER (PARTITION BY song_id, session ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS a FROM u WHERE NOT silent),
 x AS (SELECT *, lead(a) OVER (PARTITION BY song_id, session ORDER BY word_idx) AS nx FROM m), y AS (SELECT *, least(greatest(b0, a), coalesce(nx, greatest(b0, a))) AS b FROM x),
 l AS (SELECT song_id, session, min(a) AS first, arg_max(b, word_idx) AS last, any_value(aside) AS aside, string_agg('{{\\k' || (b - a) || CASE WHEN ad_lib AND NOT aside THEN '\\i1}}' || word || '{{\\i0}}' ELSE '}}' || word END || CASE WHEN nx IS NULL THEN '' WHEN nx > b THEN '{{\\k' || (nx - b) || '}} ' ELSE ' ' END, '' ORDER BY word_idx) AS body FROM y GROUP BY ALL HAVING arg_max(b, word_idx) > min(a)),
 p AS (SELECT *, coalesce(max(last) OVER (PARTITION BY song_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS busy FROM l), z AS (SELECT *, CASE WHEN busy <= first THEN greatest(first - 50, busy) ELSE first END AS start FROM p)
SELECT song_id, count(*) AS events, sha256(string_agg(printf('%d:%02d:%02d.%02d', start // 360000, start // 6000 % 60, start // 100 % 60, start % 100) || ',' || CASE WHEN aside THEN 'AdLib' ELSE 'Karaoke' END || CASE WHEN first > start THEN '{{\\k' || (first - start) || '}}' ELSE '' END || body, chr(10) ORDER BY session)) AS text FROM z GROUP BY song_id""")
def ass_export(spark, sf):
    """The events of every song's ASS script: start, style and text of each, by their hash."""
    t = R.export(timed(spark, sf), "ass").withColumn("e", F.filter(F.split("text", "\n"), lambda x: x.startswith("Dialogue: ")))
    plain = F.transform("e", lambda x: F.regexp_replace(x, r"^Dialogue: 0,([^,]*),[^,]*,([^,]*),,0,0,0,,", "$1,$2"))
    return t.where(F.size("e") > 0).select("song_id", F.size("e").cast("long").alias("events"), F.sha2(F.array_join(plain, "\n"), 256).alias("text"))


@query("self_check", f"WITH {TIMED} SELECT song_id, count(*) AS words, TRUE AS same_words, TRUE AS on_grid FROM timed GROUP BY song_id")
def self_check(spark, sf):
    """Each song out as UltraStar and in again: the same words, and no word off its beat.

    A word that an earlier one pushed on is held against the pushed beat.
    """
    scratch = Scratch(spark, "self-check")
    # Words and texts are read by several branches of the plan; each is worked out once.
    w = scratch.table(timed(spark, sf), "words")
    texts = scratch.table(R.export(w, "ultrastar").select(F.col("song_id").cast("string").alias("path"), "text"), "texts")
    back = R.merge_syllables(R.read_ultrastar(texts)).select(F.col("song_id").cast("long").alias("song_id"), "word_idx", F.col("word").alias("got"), F.col("start").alias("found"), "end")
    b = R.beats(w).select("song_id", "word_idx", "word", "start", (F.col("gap") / 1000 + F.col("beat") * 0.05).alias("due"), ((F.col("want") < F.col("busy"))).alias("pushed"))
    both = b.join(back, ["song_id", "word_idx"], "left")
    exact = F.abs(F.col("found") - F.col("due")) < 1e-6
    near = F.col("pushed") | (F.abs(F.col("found") - F.col("start")) <= 0.025 + 1e-3)
    return both.groupBy("song_id").agg(F.count("*").alias("words"), F.bool_and(F.coalesce(F.col("got") == F.col("word"), F.lit(False))).alias("same_words"), F.bool_and(F.coalesce(exact & near, F.lit(False))).alias("on_grid"))


LRCS = [
    ("a", "﻿[ti:Song {n}]\r\n[ar: Ann ]\r\n[00:12.00]<00:12.50>Hello <00:13.00>you\r\n[00:15.00]\r\n[00:16.00]\r\n[01:02.3][01:05.3]Twice I <3 {n}\r\n[Chorus]\r\n[chorus: la]\r\n[00:20:50]end\r\n[00:30.00]", "Hello you||Twice I <3 {n}|[Chorus]|[chorus: la]|end", "Song {n}", "Ann"),
    ("b", "plain\n\n{n}\n", "plain|{n}", None, None), ("c", "[tool:x][00:01.00] [la:en] one\n[ti:]\n[ti:Last][#:note]two", "one|two", "Last", None), ("d", "", "", None, None), ("e", "[00:01]\n[0a:01]no tag", "[0a:01]no tag", None, None),
]


@query("lrc_read", "SELECT p_partkey AS id, " + ", ".join(f"{formed_sql([x[i] for x in LRCS])} AS {c}" for i, c in ((2, "text"), (3, "title"), (4, "artist"))) + " FROM part")
def lrc_read(spark, sf):
    """Whole LRC documents around each part's name: words, title and artist."""
    rows = R.read_lrc(formed(spark, sf, [x[1] for x in LRCS], "text").select(F.col("id").alias("path"), "text"))
    return rows.select(F.col("path").alias("id"), F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), "title", "artist")


STARS = [
    ("a", "#TITLE:{n}\n#BPM:120,0\n#GAP:500\n: 0 2 5 Hel\n: 2 2 5 lo \n* 4 1 7 you\n- 6\nF 8 2 0 ~ah\nR 10 1 0  rap\nG 11 1 0 per\nE\njunk"),
    ("b", "#TITLE:B\n#BPM:300\n#RELATIVE:yes\n: 0 1 0 a\n- 4 10\n: 0 1 0 b\n- 5\n: 1 1 0 c\nE"), ("duet", "#TITLE:D\n#BPM:300\nP1\n: 0 1 0 a\nE"), ("nobpm", "#TITLE:N\n: 0 1 0 a\nE"), ("short", "#BPM:300\n: 0 1\nE"), ("none", "#BPM:300\nE"), ("word", "#BPM:300\nHello\nE"),
]
MERGED = [
    ("a", 0, "Hello", 0.5, 1.0, 0, 0, False), ("a", 1, "you", 1.0, 1.125, 0, 1, False), ("a", 2, "~ah", 1.5, 1.75, 1, 0, True), ("a", 3, "rapper", 1.75, 2.0, 1, 1, False),
    ("b", 0, "a", 0.0, 0.05, 0, 0, False), ("b", 1, "b", 0.5, 0.55, 1, 0, False), ("b", 2, "c", 0.8, 0.85, 2, 0, False),
]
WRONG = [("duet", "line 3: duets are not read"), ("nobpm", "no usable #BPM"), ("short", "line 2: malformed note"), ("none", "no notes"), ("word", "line 2: unrecognized line")]


def stars(spark, sf):
    return formed(spark, sf, [t for _, t in STARS], "text").select(F.col("id").cast("string").alias("path"), "text")


OF = "SELECT p_partkey AS id, [" + ", ".join(f"'{x}'" for x, _ in STARS) + f"][1 + p_partkey % {len(STARS)}] AS kind FROM part"


@query("syllable_merge", f"WITH s AS ({OF}), " + values(MERGED, ["kind", "word_idx", "word", "start", "finish", "line", "word_in_line", "unsung"]) + " SELECT id, word_idx, word, CAST(start AS DOUBLE) AS start, CAST(finish AS DOUBLE) AS finish, line, word_in_line, unsung FROM s JOIN v USING (kind)")
def syllable_merge(spark, sf):
    """Notes of an UltraStar file a part as words in seconds: relative beats, decimal commas, free and golden notes."""
    m = R.merge_syllables(R.read_ultrastar(stars(spark, sf)))
    return m.select(F.col("song_id").cast("long").alias("id"), "word_idx", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("finish"), "line", "word_in_line", "unsung")


@query("ultrastar_errors", f"WITH s AS ({OF}), " + values(WRONG, ["kind", "error"]) + " SELECT id, error FROM s JOIN v USING (kind)")
def ultrastar_errors(spark, sf):
    """Song files that cannot be read, with the line that is wrong."""
    return R.read_ultrastar(stars(spark, sf)).where("error is not null").select(F.col("path").cast("long").alias("id"), "error").distinct()


#: How a text is stored: mark and charset of each encoding; the old code page's own characters come last.
STORED = [("EFBBBF", "UTF-8", ""), ("FFFE", "UTF-16LE", ""), ("FEFF", "UTF-16BE", ""), ("", "UTF-8", ""), ("", "ISO-8859-1", "20937194 80")]


@query("decode_text", "SELECT p_partkey AS id, p_name || ' é' || CASE WHEN p_partkey % 5 = 4 THEN ' “q” €' ELSE '' END AS text FROM part")
def decode_text(spark, sf):
    """Texts in the encodings that song files come in."""
    p, k, text = table(spark, sf, "part"), F.col("p_partkey"), F.concat("p_name", F.lit(" é"))
    content = F.coalesce(*(F.when(k % 5 == i, F.concat(F.unhex(F.lit(mark)), F.encode(text, charset), F.unhex(F.lit(more.replace(" ", "20"))))) for i, (mark, charset, more) in enumerate(STORED)))
    return p.select(k.alias("id"), R.decode(content).alias("text"))


TREE = {
    "/m/Ann - One.mp3": "", "/m/ann - one.txt": "la la", "/m/B/Two.mp3": "", "/m/B/Two.lyrics.txt": "lo", "/m/B/Two.lrc": "[ti:Other]\n[00:01.00]x", "/m/B/Three.wav": "", "/m/B/Three.lrc": "[ti:Lrc Three]\n[ar:Lrc Band]\n[00:01.00]x", "/m/B/notes.txt": "what",
    "/m/C/Solo.mp3": "", "/m/C/any.txt": "words here", "/m/C/README.txt": "no", "/m/D/Named.mp3": "", "/m/D/song.txt": "#TITLE:Star\n#ARTIST:Star Band\n#MP3:NAMED.mp3\n#BPM:300\n#YEAR:1999 (live)\n#GENRE:(17)\n#LANGUAGE:Deutsch\n: 0 1 0 a\nE", "/m/D/Named.txt": "plain",
    "/m/E/Duet.mp3": "", "/m/E/Duet.txt": "#TITLE:Two\n#BPM:300\nP1\n: 0 1 0 a\nE", "/m/.hid/x.mp3": "", "/m/F-karaoke/y.mp3": "", "/m/G/job.json": "{}", "/m/G/sub/z.mp3": "", "/m/H/.z.mp3": "", "/m/H/Tagged.m4a": "", "/m/H/empty.txt": "  ", "/m/H/video.webm": "",
    "/m/I/Same.mp3": "", "/m/I/same.wav": "", "/m/I/Same.txt": "first", "/m/I/Same.lrc": "[00:01.00]second",
}
TAGS = [("/m/H/Tagged.m4a", "From tags", "Tag Band"), ("/m/D/Named.mp3", "Tag title", "Tag artist"), ("/m/B/Three.wav", "", " ")]
PAIRED = [
    ("/m/Ann - One.mp3", "/m/ann - one.txt", "text", "One", "Ann", "filename", None, None, None, "m"), ("/m/B/Two.mp3", "/m/B/Two.lyrics.txt", "text", "Two", None, "filename", None, None, None, "B"),
    ("/m/B/Three.wav", "/m/B/Three.lrc", "lrc", "Lrc Three", "Lrc Band", "lrc", None, None, None, "B"), ("/m/C/Solo.mp3", "/m/C/any.txt", "text", "Solo", None, "filename", None, None, None, "s{k}"),
    ("/m/D/Named.mp3", "/m/D/song.txt", "ultrastar", "Star", "Star Band", "ultrastar", 1999, None, "de", "s{k}"), ("/m/E/Duet.mp3", "/m/E/Duet.txt", "unreadable", "Two", None, "ultrastar", None, None, None, "s{k}"),
    ("/m/H/Tagged.m4a", None, "none", "From tags", "Tag Band", "tags", None, None, None, "H"), ("/m/H/video.webm", None, "none", "video", None, "filename", None, None, None, "H"),
    ("/m/I/Same.mp3", "/m/I/Same.txt", "text", "Same", None, "filename", None, None, None, "I"), ("/m/I/same.wav", "/m/I/Same.lrc", "lrc", "same", None, "filename", None, None, None, "I"),
]
PAIRED[0] = (*PAIRED[0][:-1], None)  # alone in a folder at the root
KINDS = [
    ("/m/ann - one.txt", "text"), ("/m/B/Two.lyrics.txt", "text"), ("/m/B/Two.lrc", "lrc"), ("/m/B/Three.lrc", "lrc"), ("/m/B/notes.txt", "text"), ("/m/C/any.txt", "text"), ("/m/D/song.txt", "ultrastar"),
    ("/m/D/Named.txt", "text"), ("/m/E/Duet.txt", "ultrastar"), ("/m/H/empty.txt", "empty"), ("/m/I/Same.txt", "text"), ("/m/I/Same.lrc", "lrc"),
]


def at(path: str) -> str:
    """A path of the tree in SQL, with the supplier's folder behind the root."""
    return f"'s' || s_suppkey || '{path.removeprefix('/m')}'" if path else "NULL"


def tree(spark, sf):
    """The songs and lyric files of a folder, written to disk, with a copy of the tree for each supplier; and its root."""
    root = Scratch(spark, "songs").path("m")
    one = F.explode(F.create_map(*(F.lit(x) for k, v in TREE.items() for x in (k.removeprefix("/m"), v)))).alias("place", "text")
    # A table of one file is one task, and so would be all its files.
    files = table(spark, sf, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism * 4, "s_suppkey").select("s_suppkey", one)
    files = files.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), "place").alias("path"), F.when(F.col("text") == "", "sound").otherwise(F.col("text")).cast("binary").alias("content"))
    S.write_files(files, root)
    found = D.scan(D.listed(spark, root), root)
    return found, D.inspect(D.with_contents(spark, root, found.where("kind = 'lyrics'"))), root


def local(root: str, *columns: str) -> list[F.Column]:
    """Paths below the root as they were before it."""
    return [F.regexp_replace(c, f"^.*{root.rsplit('/', 1)[-1]}/", "").alias(c) for c in columns]


def titled_sql() -> str:
    rows = [(at(r[0]), at(r[1]) if r[1] else "NULL", *(quoted(x) for x in r[2:9]), "NULL" if r[9] is None else quoted(r[9]).replace("{k}", "' || s_suppkey || '")) for r in PAIRED]
    names = ("song", "lyric", "kind", "title", "artist", "title_source", "year", "genre", "language", "collection")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{'CAST(NULL AS INTEGER)' if c == 'year' and v == 'NULL' else v} AS {c}" for v, c in zip(r, names, strict=True)) + " FROM supplier" for r in rows)


@query("title_precedence", titled_sql())
def title_precedence(spark, sf):
    """A folder of songs a supplier, scanned from disk, paired and titled."""
    ship(spark)
    found, lyrics, root = tree(spark, sf)
    base = D.root_of(found)
    tags = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(t, ("at", "title", "artist"), strict=True))) for t in TAGS))).alias("t"))
    tags = tags.select(F.concat(F.lit(f"{base}/s"), F.col("s_suppkey").cast("string"), F.replace("t.at", F.lit("/m/"), F.lit("/"))).alias("path"), "t.title", "t.artist")
    out = D.songs(found.where("kind = 'audio'"), lyrics, tags).join(D.large(D.collections(found, base)), "song", "left").drop("error")
    return out.withColumns({c: local(root, c)[0] for c in ("song", "lyric")})


@query("pair_folder", " UNION ALL ".join([f"SELECT {at(r[0])} AS song, {at(r[1]) if r[1] else 'NULL'} AS lyric FROM supplier" for r in PAIRED] + [f"SELECT 'left', {at(x)} FROM supplier" for x in ("/m/B/Two.lrc", "/m/B/notes.txt", "/m/D/Named.txt")]))
def pair_folder(spark, sf):
    """Which lyric file belongs to which song, and the files that nobody claimed."""
    ship(spark)
    found, lyrics, root = tree(spark, sf)
    paired = D.pair(found.where("kind = 'audio'"), lyrics)
    return paired.unionByName(D.unclaimed(lyrics, paired.where("lyric is not null")).select(F.lit("left").alias("song"), F.col("path").alias("lyric"))).select(*local(root, "song", "lyric"))


@query("inspect_files", " UNION ALL ".join(f"SELECT {at(p)} AS path, '{w}' AS what FROM supplier" for p, w in KINDS))
def inspect_files(spark, sf):
    """What each lyric file of the folders is."""
    ship(spark)
    _, lyrics, root = tree(spark, sf)
    return lyrics.select(*local(root, "path"), "what")
