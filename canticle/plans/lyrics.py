"""Lyric text and catalogue queries over documents, pages and parts, with forms put around their names where those lack the case."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canticle.functions import text as T
from canticle.operators import cleanup as C
from canticle.operators.library import LANGUAGES, language_name, opaque_id
from canticle.plans import query
from canticle.plans.views import NOW, epoch, table
from canticle.shipping import ship

LINES = "lines AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def literal(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def formed(spark, sf, forms, column: str):
    """id and a text for each part: its form by its key, with the part's name for {n}."""
    k = F.col("p_partkey")
    form = F.get(F.array(*(F.lit(f).cast("string") for f in forms)), (k % len(forms)).cast("int"))
    return table(spark, sf, "part").select(k.alias("id"), F.replace(form, F.lit("{n}"), F.col("p_name")).alias(column), (k % len(forms)).cast("int").alias("form"))


def formed_sql(forms) -> str:
    """The same as an expression over part."""
    return f"replace([{', '.join(map(quoted, forms))}][1 + p_partkey % {len(forms)}], '{{n}}', p_name)"


def values(rows, columns) -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"v({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(q(v) for v in r) + ')' for r in rows)})"


CREDIT = "(" + " OR ".join(f"starts_with(lower(trim(line)), '{p}')" for p in C.CREDITS) + " OR lower(trim(line)) IN ('embed', 'you might also like') OR regexp_matches(lower(trim(line)), '^[0-9]+\\s*contributor'))"
#: Lines that the tables lack, with what each is.
SHAPES = [
    ("[Chorus]", "header"), ("(Verse 2: Ann)", "header"), ("{Hook x2}", "header"), ("Chorus: (x2)", "header"), ("Chorus", "text"), ("Bridge: over the water", "text"), ("[Part II - Bob]", "header"), ("[Am]", "text"),
    ("x2", "repeat"), ("(3x)", "repeat"), ("{ ×4 }", "repeat"), ("[2x)", "text"), ("x1", "text"), ("x 2", "text"), ("X100", "text"), ("Written by A Person", "credit"), ("23 Contributors", "credit"), ("You Might Also Like", "credit"),
    ("pre chorus 2:", "header"), ("[Outro (x2)]", "header"), ("[Verse 2 la]", "text"), ("  ", "blank"), ("© 1999 Nobody", "credit"), ("Sources: none", "text"),
]


@query("lyrics_line_kinds", f"WITH {LINES}, {values(SHAPES, ['line', 'kind'])}, k AS (SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN {CREDIT} THEN 'credit' ELSE 'text' END AS kind, line FROM lines UNION ALL SELECT kind, line FROM v) SELECT kind, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM k GROUP BY kind")
def lyrics_line_kinds(spark, sf):
    """What each line of the documents is, and of lines in all the shapes that headers, markers and credits take."""
    rows = lines(spark, sf).select("line").unionByName(literal(spark, [(x,) for x, _ in SHAPES], "line string"))
    return rows.groupBy(C.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


KEPT = f"kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k FROM lines WHERE trim(line) <> '' AND NOT {CREDIT})"
TOKENS = r"tokens AS (SELECT doc_id, k AS line, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS word FROM (SELECT doc_id, k, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM kept))"


@query("lyrics_clean", f"WITH {LINES}, {KEPT}, {TOKENS}, n AS (SELECT doc_id, count(*) AS words FROM tokens GROUP BY 1), l AS (SELECT doc_id, count(*) AS lines FROM kept GROUP BY 1), e AS (SELECT doc_id, count(*) AS credits FROM lines WHERE trim(line) <> '' AND {CREDIT} GROUP BY 1) SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(words, 0) AS words, coalesce(credits, 0) AS credits FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)")
def lyrics_clean(spark, sf):
    """What the cleanup keeps of every document and how many credits it takes out."""
    ship(spark)
    c = C.clean(table(spark, sf, "documents").select("doc_id", "text"))
    n = lambda x: F.size(x).cast("long")
    return c.select("doc_id", n("lines").alias("lines"), n("words").alias("words"), n(F.filter("edits", lambda e: e["kind"] == "credit")).alias("credits"))


SONGS = [
    ("la {n}\nlo lo\n", "la {n}\nlo lo\n", "no changes needed"),
    ("[Verse 1: Ann]\r\n{n} there (ooh)\r\nagain x2\r\n\r\n[Chorus x2]\r\nla la\r\nlo lo\r\n\r\nend of it42Embed", "{n} there (ooh)\nagain\nagain\n\nla la\nlo lo\n\nla la\nlo lo\n\nend of it", "removed 1 section header, removed 1 credit/boilerplate line, expanded 2 marked repeats, flagged 1 ad-lib".replace("removed 1 section header, ", "removed 2 section headers, ")),
    ("one\n{n}\n(x3)\nthree", "one\n{n}\none\n{n}\none\n{n}\nthree", "expanded one x3 stanza"),
    ("Lyrics by Someone\n\nsing (a (b) c) and (d\nx99", "\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d\nsing (a (b) c) and (d", "removed 1 credit/boilerplate line, expanded one x8 stanza, flagged 1 ad-lib"),
    ("Hook: (x2)\nhey", "hey\n\nhey", "removed 1 section header, expanded one x2 hook"), ("", "", "no changes needed"),
]


@query("cleanup_summary", f"SELECT p_partkey AS id, {formed_sql([t.replace(chr(10), '|') for _, t, _ in SONGS])} AS text, {formed_sql([w for _, _, w in SONGS])} AS summary FROM part")
def cleanup_summary(spark, sf):
    """Cleaned texts and what was changed, in words, for lyrics of several shapes around each part's name."""
    ship(spark)
    c = C.clean(formed(spark, sf, [t for t, _, _ in SONGS], "text").select("id", "text"))
    return c.select("id", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), C.summary(F.col("edits")).alias("summary"))


@query("annotate_zip", f"""WITH {LINES}, {KEPT}, {TOKENS}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, place) - 1 AS word_idx, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens)
SELECT doc_id AS song, line, min(word_idx) * 0.5 AS start, count(*) AS words, NULL AS error FROM i WHERE doc_id % 7 <> 0 GROUP BY ALL UNION ALL SELECT doc_id, NULL, NULL, count(*), (n - 1) || ' timed words, ' || n || ' cleaned ones' FROM i WHERE doc_id % 7 = 0 GROUP BY doc_id, n""")
def annotate_zip(spark, sf):
    """Timed words meet cleaned ones one to one; a seventh of the documents lacks a timed word, which is an error."""
    ship(spark)
    c = C.clean(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("song"), "words")
    kept = lines(spark, sf).where(~C.line_kind(F.col("line")).isin("blank", "credit")).select("doc_id", F.filter(F.split("line", r"\s+"), lambda x: x != "").alias("w"))
    n = kept.groupBy(F.col("doc_id").alias("song")).agg(F.sum(F.size("w")).alias("n")).withColumn("n", F.col("n") - F.when(F.col("song") % 7 == 0, 1).otherwise(0))
    timed = n.where("n > 0").select("song", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("word_idx")).withColumn("start", F.col("word_idx") * 0.5)
    out = C.annotate(c, timed).groupBy("song", "line", "error").agg(F.min("start").alias("start"), F.count("*").alias("n"))
    said = F.regexp_extract("error", r", ([0-9]+) cleaned", 1).try_cast("long")
    return out.select("song", "line", "start", F.coalesce(said, F.col("n")).alias("words"), "error")


@query("doc_word_counts", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \t\n]+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents")
def doc_word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "[ \t\n]+"), lambda w: w != "")).alias("words"))


@query("adlib_flags", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\([^()\n]*\)')) AS INTEGER) AS spans, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '\([^()\n]*\)'), lambda s: length(s))), 0) AS INTEGER) AS chars FROM documents")
def adlib_flags(spark, sf):
    s = F.regexp_extract_all("text", F.lit(r"\([^()\n]*\)"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("spans"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


@query("normalize_words", f"WITH {LINES} SELECT doc_id, line_no, regexp_replace(upper(replace(line, 'ß', 'ss')), '[^A-Z'']', '', 'g') AS norm FROM lines")
def normalize_words(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.normalize_word(F.col("line")).alias("norm"))


@query("edit_ratio", "SELECT a.p_partkey AS id, CASE WHEN greatest(length(a.p_name), length(a.p_type)) = 0 THEN 0.0 ELSE round(levenshtein(a.p_name, a.p_type) / greatest(length(a.p_name), length(a.p_type)), 6) END AS ratio FROM part a")
def edit_ratio(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(T.edit_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("site_of", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|music)\.', '') AS site FROM pages")
def site_of(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.site_of(F.col("url")).alias("site"))


@query("swap_prefix", "SELECT page_id, CASE WHEN starts_with(lower(url), 'https://') THEN 'sec:' || substring(url, 7) ELSE url END AS url FROM pages")
def swap_prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.swap_prefix(F.col("url"), "HTTPS:/", "sec:").alias("url"))


@query("file_stem", r"""SELECT page_id, trim(left(trim(regexp_replace(url, '[<>:"/\\|?*]', '', 'g')), 60)) || ' [' || CASE WHEN length(url) <= 16 THEN url ELSE left(sha256(url), 10) END || ']' AS stem FROM pages""")
def file_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_stem(F.col("url"), F.col("url")).alias("stem"))


@query("opaque_ids", "SELECT s_suppkey, 's' || left(sha256('salt:'::BLOB || from_hex(lpad(hex(s_suppkey % 256), 2, '0') || lpad(hex(s_suppkey // 256 % 256), 2, '0') || lpad(hex(s_suppkey // 65536), 2, '0') || '0000000000')), 10) AS opaque FROM supplier")
def opaque_ids(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", opaque_id(F.col("s_suppkey"), "salt").alias("opaque"))


@query("fingerprint", """SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def fingerprint(spark, sf):
    """A hash of canonical JSON: keys in order, nulls said, so that a missing part is not an empty one."""
    note = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", T.fingerprint(customer=F.col("o_custkey"), note=note, status=F.col("o_orderstatus")).alias("fingerprint"))


@query("decade_of", "SELECT o_orderkey, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade FROM orders")
def decade_of(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"))


@query("half_even", "SELECT l_orderkey, l_linenumber, l_partkey, m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END AS cs FROM (SELECT *, CAST(l_quantity AS BIGINT) * 5 + l_linenumber AS m FROM lineitem)")
def half_even(spark, sf):
    m = F.col("l_quantity").cast("long") * 5 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.to_cs(m).alias("cs"))


@query("format_timestamps", "SELECT p_partkey, printf('%02d:%02d.%02d', c // 6000, c // 100 % 60, c % 100) AS lrc, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS ass, printf('%d:%02d', (c + 50) // 6000, (c + 50) // 100 % 60) AS short FROM (SELECT p_partkey, CAST(floor(p_retailprice * 100) AS BIGINT) AS c FROM part)")
def format_timestamps(spark, sf):
    c = F.floor(F.col("p_retailprice") * 100)
    return table(spark, sf, "part").select("p_partkey", T.lrc_time(c).alias("lrc"), T.ass_time(c).alias("ass"), T.short_time(c / 100).alias("short"))


@query("humanize_age", f"SELECT o_orderkey, CASE WHEN d < 60 THEN d || 's ago' WHEN d < 3600 THEN d // 60 || 'm ago' WHEN d < 86400 THEN d // 3600 || 'h ago' ELSE d // 86400 || 'd ago' END AS age FROM (SELECT o_orderkey, greatest(0, o_orderkey * 37 % 200000 - 50) AS d FROM orders)")
def humanize_age(spark, sf):
    seen = F.lit(NOW) - (F.col("o_orderkey") * 37 % 200000 - 50)
    return table(spark, sf, "orders").select("o_orderkey", T.ago(F.lit(NOW) - seen).alias("age"))


@query("civil_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def civil_dates(spark, sf):
    """Calendar dates from days since 1970."""
    days = F.floor(epoch("o_orderdate") / 86400).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", F.date_from_unix_date(days).cast("string").alias("day"))


SPOKEN = [(1, "English"), (2, " deutsch "), (3, "Español"), (4, "castellano"), (5, "FR"), (6, "Klingon"), (7, None), (8, "日本語"), (9, "čeština"), (10, "norsk"), (11, "la"), (12, "Latin"), (13, "")]
TAGGED = [(1, "en"), (2, "de"), (3, "es"), (4, "es"), (5, "fr"), (6, None), (7, None), (8, "ja"), (9, "cs"), (10, "no"), (11, "la"), (12, "la"), (13, None)]
TITLES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items()) + "}"


@query("language_tags", f"WITH {values(TAGGED, ['id', 'tag'])} SELECT id, tag, coalesce(map_extract({TITLES}, tag)[1], upper(tag)) AS language FROM v UNION ALL SELECT doc_id + 100, lang, coalesce(map_extract({TITLES}, lang)[1], upper(lang)) FROM documents")
def language_tags(spark, sf):
    """Tags of language names as files write them, and names of tags."""
    rows = literal(spark, SPOKEN, "id long, name string").unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("lang").alias("name")))
    tag = T.language_tag(F.col("name"))
    return rows.select("id", tag.alias("tag"), language_name(tag).alias("language"))


NAMES = ["  {n}   Lee ", "x{n}xxxxxxxxxxxxxxxxxxxx", "   ", "Zoë {n}", "a\tb {n}"]


@query("clean_name", f"WITH v AS (SELECT p_partkey AS id, {formed_sql(NAMES)} AS name FROM part) " + r"SELECT id, nullif(trim(left(trim(regexp_replace(name, '\s+', ' ', 'g')), 14)), '') AS name FROM v")
def clean_name(spark, sf):
    return formed(spark, sf, NAMES, "name").select("id", T.clean_name(F.col("name")).alias("name"))


GENRES = ["Rock {n}", "(17)", "17", " ", None, "80s {n} ", "{n}"]


@query("clean_genre", f"WITH v AS (SELECT p_partkey AS id, {formed_sql(GENRES)} AS g FROM part) " + r"SELECT id, CASE WHEN trim(g) <> '' AND NOT regexp_matches(trim(g), '^\(?[0-9]+\)?$') THEN trim(g) END AS genre FROM v")
def clean_genre(spark, sf):
    return formed(spark, sf, GENRES, "g").select("id", T.clean_genre(F.col("g")).alias("genre"))


FILES = ["Artist_-_{n}", "Just {n}", "A - {n} - C", " - {n}", "{n} -  B_b"]


@query("filename_meta", f"WITH v AS (SELECT p_partkey AS id, {formed_sql(FILES)} AS f FROM part), " + r"t AS (SELECT id, trim(regexp_replace(replace(f, '_', ' '), '\s+', ' ', 'g')) AS t FROM v) SELECT id, nullif(trim(regexp_extract(t, '^(.*?) - (.*)$', 1)), '') AS artist, coalesce(nullif(trim(regexp_extract(t, '^(.*?) - (.*)$', 2)), ''), t) AS title FROM t")
def filename_meta(spark, sf):
    artist, title = T.filename_title(F.col("f"))
    return formed(spark, sf, FILES, "f").select("id", artist.alias("artist"), title.alias("title"))


#: Repeat markers, and other texts that look like one; {d} is a number from 0 to 119.
MARKS = ["x{d}", "({d}x)", "[x {d}]", "xx", "{d} x", "chorus x{d}", " { ×{d} } ", "[{d}x)", "((x{d}))", "[x0{d}]", "X{d}"]


@query("repeat_markers", "WITH m AS (SELECT p_partkey AS id, p_partkey % 11 AS form, p_partkey // 11 % 120 AS d FROM part) SELECT id, CASE WHEN form IN (0, 1, 6, 9, 10) AND d BETWEEN 2 AND 99 THEN CAST(least(d, 8) AS INTEGER) END AS times FROM m")
def repeat_markers(spark, sf):
    """How often each marker says to sing a line: from 2 to 99 counts, and 8 is the most."""
    rows = formed(spark, sf, MARKS, "m")
    d = (F.floor(F.col("id") / len(MARKS)) % 120).cast("string")
    return rows.select("id", C.repeat_count(F.replace("m", F.lit("{d}"), d)).alias("times"))


@query("repeat_expand", f"WITH {LINES}, {KEPT}, r AS (SELECT doc_id, k, line, CAST(1 + (doc_id + k) % 3 AS BIGINT) AS times FROM kept), d AS (SELECT doc_id, sum(times) AS total, count(*) AS n FROM r GROUP BY 1) SELECT doc_id, CAST(total AS BIGINT) AS lines, CAST(total - n AS BIGINT) AS repeated FROM d")
def repeat_expand(spark, sf):
    """Documents whose lines carry a repeat marker each or none: lines after the cleanup, and how many are copies."""
    ship(spark)
    rows = lines(spark, sf).where(~C.line_kind(F.col("line")).isin("blank", "credit"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    times = 1 + (F.col("doc_id") + place) % 3
    marked = rows.select("doc_id", "line_no", F.concat("line", F.when(times > 1, F.concat(F.lit(" (x"), times.cast("string"), F.lit(")"))).otherwise("")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    c = C.clean(marked.groupBy("doc_id").agg(text.alias("text")))
    return c.select("doc_id", F.size("lines").cast("long").alias("lines"), F.size(F.filter("lines", lambda x: x["repeated"])).cast("long").alias("repeated"))


#: What stands behind a root, and whether that makes a chord.
CHORDS = [("m", True), ("#m7", True), ("/G", True), ("ello", False), ("sus4", True), ("o", False), ("7sus4", True), ("M7", True), ("m7b5", True), ("sus4add", False), ("/", False), ("b5", True), ("7", True), ("b", True), ("/Gm", False)]


@query("chord_names", f"SELECT p_partkey AS id, [{', '.join(str(c).upper() for _, c in CHORDS)}][1 + p_partkey % 15] AND substr('ABCDEFGH', CAST(1 + p_partkey // 15 % 8 AS INTEGER), 1) <> 'H' AS chord FROM part")
def chord_names(spark, sf):
    """Which words are chords: roots A to G with what may stand behind one."""
    rows = formed(spark, sf, [c for c, _ in CHORDS], "w")
    root = F.substr(F.lit("ABCDEFGH"), (F.floor(F.col("id") / 15) % 8 + 1).cast("int"), F.lit(1))
    return rows.select("id", C.is_chord(F.concat(root, "w")).alias("chord"))


SHEETS = [(-1, "Am  F#m7 C/G\nHello [Am] there\n[00:12.00]Timed\nA &amp; B", ["only 10 words: is this the whole song?", "1 chord lines", "1 lines with inline chords", "1 lines with timestamps: this is an LRC file", "HTML left over from a web page"]), (-2, "", ["no lyric words left after cleanup"]), (-3, "Am\nthe [not a chord] line " + "la " * 40, ["1 lines over 100 characters"])]
WARNED = "list_filter([CASE WHEN words = 0 THEN 'no lyric words left after cleanup' WHEN words < 15 THEN 'only ' || words || ' words: is this the whole song?' END, CASE WHEN words > 1500 THEN words || ' words: this may hold more than one song' END, CASE WHEN long > 0 THEN long || ' lines over 100 characters' END, CASE WHEN html THEN 'HTML left over from a web page' END], lambda x: x IS NOT NULL)"


@query("lyrics_check", f"WITH {LINES}, {KEPT}, {TOKENS}, n AS (SELECT doc_id, count(*) AS words FROM tokens GROUP BY 1), w AS (SELECT d.doc_id, coalesce(any_value(words), 0) AS words, count(*) FILTER (WHERE length(trim(line)) > 100) AS long, regexp_matches(any_value(text), '<br|<p>|&amp;|&#39;|&quot;') AS html FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1), {values([(i, '|'.join(w)) for i, _, w in SHEETS], ['id', 'warnings'])} SELECT doc_id AS id, array_to_string({WARNED}, '|') AS warnings FROM w UNION ALL SELECT * FROM v")
def lyrics_check(spark, sf):
    """What a person should mend in each text before it is aligned."""
    ship(spark)
    rows = literal(spark, [(i, t) for i, t, _ in SHEETS], "id long, text string").unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    c = C.clean(rows).select("id", F.size("words").alias("n"))
    return rows.join(c, "id").select("id", F.array_join(C.problems(F.col("text"), F.col("n")), "|").alias("warnings"))


LRC = ["[00:12.00]<00:12.50>Hello <00:13.00>{n}", "[ti:{n}]", "[{n}]", "[01:02.3][01:05.3]{n}", "I <3 {n}"]


@query("lrc_strip", f"WITH v AS (SELECT p_partkey AS id, {formed_sql(LRC)} AS l FROM part) " + r"SELECT id, trim(regexp_replace(regexp_replace(l, '(\[|<)[0-9]{1,3}:[0-9]{2}(\.[0-9]{1,3})?(\]|>)', '', 'g'), '^\[(ti|ar|al|by|offset|length|re|ve|au):.*\]$', '')) AS line FROM v")
def lrc_strip(spark, sf):
    from canticle.sources.lrc import strip_tags

    return formed(spark, sf, LRC, "l").select("id", strip_tags(F.col("l")).alias("line"))


@query("union_dedup", "WITH u AS (SELECT url, page_id, 0 AS s FROM pages UNION ALL SELECT upper(url), page_id, 1 FROM pages WHERE page_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY s, page_id) AS rn FROM u) SELECT url, page_id FROM r WHERE rn = 1")
def union_dedup(spark, sf):
    p = table(spark, sf, "pages")
    u = p.select("url", "page_id", F.lit(0).alias("s")).unionByName(p.where("page_id % 2 = 0").select(F.upper("url").alias("url"), "page_id", F.lit(1).alias("s")))
    first = u.groupBy(F.lower("url").alias("k")).agg(F.min_by(F.struct("url", "page_id"), F.struct("s", "page_id")).alias("r"))
    return first.select("r.url", "r.page_id")


@query("unmatched_lyrics", "SELECT doc_id FROM documents d WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unmatched_lyrics(spark, sf):
    return table(spark, sf, "documents").where(F.trim("text") != "").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("import_in_library", "SELECT d.doc_id, l.doc_id IS NOT NULL AS in_library FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def import_in_library(spark, sf):
    have = table(spark, sf, "labels").select("doc_id").distinct().withColumn("in_library", F.lit(True))
    return table(spark, sf, "documents").select("doc_id").join(have, "doc_id", "left").select("doc_id", F.coalesce("in_library", F.lit(False)).alias("in_library"))


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("import_summary", "SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE lang <> 'en') AS foreign_lang FROM documents")
def import_summary(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("lang") != "en").alias("foreign_lang"))


@query("scan_summary", "SELECT count(*) AS pages, count(*) FILTER (WHERE starts_with(url, 'https')) AS secure, count(*) FILTER (WHERE contains(url, '#')) AS fragments, count(*) FILTER (WHERE contains(url, '?')) AS queries, max(length(url)) AS longest FROM pages")
def scan_summary(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("pages"), F.count_if(F.col("url").startswith("https")).alias("secure"), F.count_if(F.col("url").contains("#")).alias("fragments"), F.count_if(F.col("url").contains("?")).alias("queries"), F.max(F.length("url")).cast("long").alias("longest"))


FOLDERS = "paths AS (SELECT p_partkey AS id, p_brand AS brand, 'C:\\Music/' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END || '/' || p_type || '\\song.mp3' AS path FROM part UNION ALL SELECT s_suppkey, 'none', substr('ABC', CAST(s_suppkey % 3 + 1 AS INTEGER), 1) || ':/x/' || s_suppkey FROM supplier UNION ALL SELECT n_nationkey, 'one drive', 'D:\\' || n_name FROM nation)"


@query("common_folder", f"WITH {FOLDERS}, f AS (SELECT brand, id, string_split_regex(regexp_replace(path, '[\\\\/][^\\\\/]*$', ''), '[\\\\/]') AS parts FROM paths), b AS (SELECT brand, min(list_transform(parts, lambda x: lower(x))) AS a, max(list_transform(parts, lambda x: lower(x))) AS z, arg_min(parts, id) AS first FROM f GROUP BY brand), c AS (SELECT brand, array_to_string(list_slice(first, 1, len(list_filter(range(1, len(a) + 1), lambda i: list_slice(a, 1, i) = list_slice(z, 1, i)))), '\\') AS folder FROM b) SELECT brand, CASE WHEN folder <> '' AND NOT regexp_full_match(folder, '[A-Za-z]:') THEN folder END AS folder FROM c")
def common_folder(spark, sf):
    """The folder that all paths of a brand share, whatever the case, as the first one spells it; a bare drive is none."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    one = p.select(k.alias("id"), F.col("p_brand").alias("brand"), F.concat(F.lit("C:\\Music/"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("/"), "p_type", F.lit("\\song.mp3")).alias("path"))
    two = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("none").alias("brand"), F.concat(F.substr(F.lit("ABC"), (F.col("s_suppkey") % 3 + 1).cast("int"), F.lit(1)), F.lit(":/x/"), F.col("s_suppkey").cast("string")).alias("path"))
    three = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("one drive").alias("brand"), F.concat(F.lit("D:\\"), "n_name").alias("path"))
    return T.common_folder(one.unionByName(two).unionByName(three), "brand")


#: Song files, with the title, tempo and genre that they give.
US = [
    ("#TITLE: A {n} \n#BPM:300\n#bpm:20\n: 0 1 0 la", "A {n}", "300", None), ("#ARTIST:\n#ARTIST:Bob\n#TITLE:{n}:y\n", "{n}:y", None, None), ("no headers\n#TITLE:{n}", None, None, None),
    ("\ufeff#title:{n}\n\n# GENRE : pop {n} \nE\n#BPM:1", "{n}", None, "pop {n}"),
]


@query("header_lookup", "SELECT p_partkey AS id, " + ", ".join(f"{formed_sql([u[i] for u in US])} AS {c}" for i, c in ((1, "title"), (2, "bpm"), (3, "genre"))) + " FROM part")
def header_lookup(spark, sf):
    """Headers of a song file: the first of a name counts, blank values and what stands behind the notes do not."""
    rows = formed(spark, sf, [u[0] for u in US], "text").withColumn("h", T.headers(F.col("text")))
    return rows.select("id", *(T.header(F.col("h"), k).alias(k.lower()) for k in ("TITLE", "BPM", "GENRE")))
