"""Library operators: search, sort, facets, queue and mutations as DataFrame functions (SURVEY C, D, E, G, J)."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions.text import ascii_fold, swap_prefix
from canticle.storage import Scratch


def search_store(songs: DataFrame, term: str) -> DataFrame:
    """Title or artist contains the term (ASCII fold), or the tag equals it; a blank term keeps all."""
    term = term.strip()
    if not term:
        return songs
    low = "".join(c.lower() if c.isascii() else c for c in term)
    return songs.where(ascii_fold(F.col("title")).contains(low) | F.coalesce(ascii_fold(F.col("artist")).contains(low), F.lit(False)) | (F.col("language_tag") == term))


def search_view(songs: DataFrame, term: str) -> DataFrame:
    """The same with Unicode folding and a folded tag."""
    low = term.strip().lower()
    if not low:
        return songs
    return songs.where(F.lower("title").contains(low) | F.coalesce(F.lower("artist").contains(low), F.lit(False)) | (F.lower("language_tag") == low))


# Names of language tags, and the phrases of a search text that stand for one facet word.
LANGUAGES = {
    "en": "English", "de": "German", "es": "Spanish", "fr": "French", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "no": "Norwegian", "da": "Danish",
    "fi": "Finnish", "pl": "Polish", "cs": "Czech", "hu": "Hungarian", "ru": "Russian", "tr": "Turkish", "el": "Greek", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "la": "Latin",
}
PHRASES = (
    (r"\bnever\s+sung\b|\bnot\s+sung\b", "never-sung"),
    (r"\bmost\s+sung\b", "most-sung"),
    (r"\brecently\s+added\b", "recently-added"),
    (r"\beasy\s+sing-?\s?alongs?\b", "easy-sing-alongs"),
    (r"\bfast\s+lyrics\b", "fast-lyrics"),
)


def language_name(tag: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, tag), F.upper(tag))


def is_short() -> Column:
    return F.coalesce((F.col("duration_s") > 0) & (F.col("duration_s") < 180), F.lit(False))


def is_recent(now: int) -> Column:
    return F.col("date_added") >= now - 30 * 86400


def singable() -> Column:
    return F.col("timing_map_path").isNotNull()


def facet_words(now: int) -> Column:
    """The words that a song (with its pace band) answers to beyond title and artist."""
    d, some = decade(F.col("year")), F.array().cast("array<string>")
    when = lambda c, *words: F.when(F.coalesce(c, F.lit(False)), F.array(*(F.lit(w) if isinstance(w, str) else w for w in words))).otherwise(some)
    genre = F.lower(F.trim("genre"))
    return F.concat(
        when(F.col("year").isNotNull(), F.concat(d.cast("string"), F.lit("s")), F.concat(F.lpad((d % 100).cast("string"), 2, "0"), F.lit("s")), F.col("year").cast("string")),
        F.when(genre.isNotNull(), F.concat(F.array(genre), F.filter(F.split(genre, r"[\s/,&-]+"), lambda w: w != ""))).otherwise(some),
        F.array(F.lower(language_name(F.col("language_tag"))), F.col("language_tag")),
        when(F.col("band") == "slow", "easy", "slow", "easy-sing-alongs"),
        when(F.col("band") == "fast", "fast", "fast-lyrics"),
        when(is_short(), "short"),
        F.when(F.col("play_count") > 0, F.array(F.lit("most-sung"), F.lit("sung"))).when(singable(), F.array(F.lit("never-sung"), F.lit("unsung"))).otherwise(some),
        when(is_recent(now), "recent", "recently-added"),
    )


def phrased(text: str) -> list[str]:
    """The tokens of a search text, phrases first joined to the facet words that they stand for."""
    for pattern, word in PHRASES:
        text = re.sub(pattern, word, text)
    return text.split()


def worded(songs: DataFrame, now: int) -> DataFrame:
    """songs (with their pace band) with hay, the text of title and artist, and words, the facet words."""
    hay = F.concat(F.lower(F.trim("title")), F.lit(" "), F.lower(F.trim(F.coalesce("artist", F.lit("")))))
    return songs.withColumn("hay", hay).withColumn("words", facet_words(now))


def found_by(text: str) -> Column:
    """Of worded songs: every token is inside the text or starts a facet word; or the whole is inside, or is the tag."""
    whole = text.strip().lower()
    if not whole:
        return F.lit(True)

    def starts(token: str) -> Column:
        return F.exists("words", lambda w: w.startswith(token))

    tokens = (F.col("hay").contains(t) | starts(t) for t in phrased(whole))
    return F.col("hay").contains(whole) | (F.lower("language_tag") == whole) | functools.reduce(Column.__and__, tokens)


def search_facets(songs: DataFrame, text: str, now: int) -> DataFrame:
    """The songs (with their pace band) that a search text finds; a blank text keeps all."""
    return worded(songs, now).where(found_by(text)).drop("hay", "words") if text.strip() else songs


def in_category(node: str, now: int) -> Column:
    """Whether a song (with its pace band) belongs to a tree node such as shelf:recent, sing:fast, decade:1980 or lang:en.

    The value is what follows the first colon, further colons included.
    """
    kind, _, value = node.partition(":")
    fold = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    shelves = {"most": lambda: F.col("play_count") > 0, "never": lambda: (F.col("play_count") == 0) & singable(), "recent": lambda: is_recent(now)}
    kinds = {
        "shelf": lambda: shelves[value](),
        "sing": lambda: is_short() if value == "short" else F.coalesce(F.col("band") == value, F.lit(False)),
        "artist": lambda: fold("artist") == value,
        "genre": lambda: fold("genre") == value,
        "decade": lambda: F.coalesce(decade(F.col("year")).cast("string"), F.lit("null")) == value,
        "lang": lambda: F.col("language_tag") == value,
    }
    return kinds[kind]()


def labelled(rows: DataFrame, name: str, tests: dict[str, Column]) -> DataFrame:
    """rows once for each test that they pass, its key under `name`; one pass over rows."""
    hits = F.array_compact(F.array(*(F.when(test, F.lit(key)) for key, test in tests.items())))
    return rows.withColumn(name, F.explode(hits))


def ranked(df: DataFrame, *keys: Column) -> DataFrame:
    """The row's place in a total order; Spark results carry no order of their own.

    Rows are range-partitioned by the keys and written, numbered inside their range, and each range's base
    is the count of rows before it, so no task holds more than a range.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    ordered = scratch.table(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ordered.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = ordered.join(F.broadcast(bases), "_part")  # one row a range
    return out.withColumn("place", F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*keys))).drop("_part", "_base")


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row a group: its size n and, by name, the value at a place from 0 that is a function of n.

    Groups are ordered by one range partitioning of all rows, so a large group is many tasks' work.
    """
    rows = ranked(df.select(*by, value), *(F.col(c) for c in by), F.col(value))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("place").alias("_first"))
    wanted = F.array(*(f(F.col("n")).cast("long") for f in places.values()))
    sizes = sizes.select(*by, "n", "_first", wanted.alias("_wanted"))
    pairs = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] or [F.lit(True)]
    hits = rows.alias("r").join(F.broadcast(sizes).alias("s") if not by else sizes.alias("s"), functools.reduce(Column.__and__, pairs))
    at = F.col("r.place") - F.col("s._first")
    hits = hits.where(F.array_contains("s._wanted", at)).select(*(F.col(f"s.{c}").alias(c) for c in by), F.col("s.n").alias("n"), F.col("s._wanted").alias("_wanted"), at.alias("_at"), F.col(f"r.{value}").alias("_value"))
    pick = (F.max(F.when(F.col("_at") == F.get("_wanted", F.lit(k)), F.col("_value"))).alias(name) for k, name in enumerate(places))
    return hits.groupBy(*by, "n").agg(*pick)


def sort_by(df: DataFrame, value: Column, direction: str, tie: Column) -> DataFrame:
    """Rows with their place in a column's order, "asc" or "desc"; nulls come last in both, ties by `tie`."""
    return ranked(df, value.isNull(), value.desc() if direction == "desc" else value.asc(), tie)


def browse(songs: DataFrame, members: DataFrame, collection: int | None) -> DataFrame:
    """Songs (id), of a collection with their position in it, or all of them, without a position and without a join."""
    if collection is None:
        return songs.withColumn("position", F.lit(None).cast(members.schema["position"].dataType))
    own = members.where(F.col("collection_id") == collection).select(F.col("song_id").alias("id"), "position")
    return songs.join(own, "id")


def terciles(songs: DataFrame, column: str) -> DataFrame:
    """slow and fast bounds, of round-index thirds; null with fewer than three values."""
    known = songs.where(F.col(column).isNotNull() & ~F.isnan(column))
    third = lambda k: lambda n: F.floor((n - 1) * F.lit(k / 3) + 0.5)
    found = at_places(known, [], column, {"slow": third(1), "fast": third(2)})
    few = F.max("n") >= 3
    return found.agg(F.when(few, F.max("slow")).alias("slow"), F.when(few, F.max("fast")).alias("fast"))


def pace_bands(songs: DataFrame) -> DataFrame:
    """band of each song: slow is tested before fast, both inclusive; the bounds are one row."""
    bounds = F.broadcast(terciles(songs, "pace_wpm").withColumn("_one", F.lit(1)))
    p = F.col("pace_wpm")
    band = F.when(p <= F.col("slow"), "slow").when(p >= F.col("fast"), "fast").when(p.isNotNull() & F.col("slow").isNotNull(), "medium")
    return songs.withColumn("_one", F.lit(1)).join(bounds, "_one").withColumn("band", band).drop("_one", "slow", "fast")


def facets(songs: DataFrame, key: Column, label: Column, order: str = "id") -> DataFrame:
    """key, label, n and place of each value: the spelling seen first names it; blank ones are left out."""
    rows = songs.select(key.alias("key"), label.alias("label"), F.col(order).alias("_o")).where("trim(key) <> ''")
    out = rows.groupBy("key").agg(F.min_by("label", "_o").alias("label"), F.count("*").alias("n"))
    return ranked(out, F.lower("label"), F.col("key"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def compact_positions(queue: DataFrame) -> DataFrame:
    """Positions of each party's queue without gaps."""
    return queue.withColumn("position", F.row_number().over(Window.partitionBy("party").orderBy("position", "id")) - 1)


def append_to_queue(queue: DataFrame, adds: DataFrame) -> DataFrame:
    """party, song_id and position of the adds (party, id, timing_map_path), behind each party's last position, in id order.

    Songs without timings are left out; a party without a queue starts at 0.
    """
    last = queue.groupBy("party").agg((F.max("position") + 1).alias("base"))
    new = adds.where(F.col("timing_map_path").isNotNull()).join(last, "party", "left")
    place = F.row_number().over(Window.partitionBy("party").orderBy("id")) - 1
    return new.select("party", F.col("id").alias("song_id"), (F.coalesce("base", F.lit(0)) + place).alias("position"))


def move(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves one entry a party (moves: party, entry, to) to a position, clamped to the queue; the others close up."""
    dense = compact_positions(queue)
    whole = Window.partitionBy("party")
    out = dense.join(moves, "party", "left").withColumn("at", F.max(F.when(F.col("id") == F.col("entry"), F.col("position"))).over(whole)).withColumn("last", F.max("position").over(whole))
    goal, p = F.greatest(F.lit(0), F.least(F.col("to"), F.col("last"))), F.col("position")
    moved = F.when(F.col("at").isNull(), p).when(F.col("id") == F.col("entry"), goal)
    moved = moved.when((p > F.col("at")) & (p <= goal), p - 1).when((p < F.col("at")) & (p >= goal), p + 1).otherwise(p)
    return out.withColumn("position", moved.cast("int")).drop("at", "last", "entry", "to")


def kick(queue: DataFrame, guest: int) -> DataFrame:
    """Without the guest's entries, but for the one that plays (null-safe); queue: guest, id, playing."""
    return queue.where(~(F.col("guest").eqNullSafe(F.lit(guest)) & ~F.col("id").eqNullSafe(F.col("playing"))))


#: How an import changes a stored song, by column.
NEW = ("title", "artist", "audio_path", "job_dir", "timing_map_path", "vocals_path", "instrumental_path")
KEEP_IF_NULL, FILL_ONLY = ("album", "duration_s", "lyric_source", "language_tag", "pace_wpm"), ("year", "genre")
KEPT = ("id", "last_played")


def upsert(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Songs by content hash: new columns win, keep if null, or only fill, by column; counters stay.

    A cover that the user chose stays, any other gives way to a new one; the review is reset by an import;
    meta_version never falls.  New songs have no id until the store gives one.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.audio_hash") == F.col("n.audio_hash"), "full_outer")
    there = F.col("n.audio_hash").isNotNull()
    pick = {c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in NEW}
    pick |= {c: F.coalesce(f"n.{c}", f"o.{c}") for c in KEEP_IF_NULL} | {c: F.coalesce(f"o.{c}", f"n.{c}") for c in FILL_ONLY} | {c: F.col(f"o.{c}") for c in KEPT}
    by_user = F.coalesce("o.cover_by_user", F.lit(False))
    pick |= {
        "audio_hash": F.coalesce("o.audio_hash", "n.audio_hash"),
        "language_tag": F.coalesce(pick["language_tag"], F.lit("en")),
        "cover_path": F.when(by_user, F.col("o.cover_path")).otherwise(F.coalesce("n.cover_path", "o.cover_path")),
        "cover_by_user": by_user,
        "meta_version": F.greatest(F.coalesce("o.meta_version", F.lit(0)), F.coalesce("n.meta_version", F.lit(0))),
        "reviewed_at": F.when(~there, F.col("o.reviewed_at")),
        "play_count": F.coalesce("o.play_count", F.lit(0)),
        "date_added": F.coalesce("o.date_added", F.lit(now)),
    }
    return both.select(*(c.alias(k) for k, c in pick.items()))


def put(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of old ones with the same key; settings, export sidecars and cache records are kept so."""
    return old.join(new, key, "left_anti").unionByName(new)


def set_covers(songs: DataFrame, changes: DataFrame) -> DataFrame:
    """Covers after changes (id, action, path): found (only where there is none), user (always, and it stays), clear."""
    s = songs.join(changes.select("id", "action", F.col("path").alias("_path")), "id", "left")
    path = F.when(F.col("action") == "user", F.col("_path")).when(F.col("action") == "found", F.coalesce("cover_path", "_path")).when(F.col("action").isNull(), F.col("cover_path"))
    user = F.when(F.col("action") == "user", True).when(F.col("action") == "clear", False).otherwise(F.col("cover_by_user"))
    return s.withColumn("cover_path", path).withColumn("cover_by_user", user).drop("action", "_path")


def create_collections(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, id (null where it has to be made) and outcome of each wanted name, matched by folded ASCII; blank names are refused.

    wanted: name; of names that fold alike the least is made once.
    """
    names = wanted.select(F.trim("name").alias("name")).where("name <> ''").groupBy(ascii_fold(F.col("name")).alias("_fold")).agg(F.min("name").alias("name"))
    known = have.groupBy(ascii_fold(F.trim("name")).alias("_fold")).agg(F.min("id").alias("id"))
    return names.join(known, "_fold", "left").select("name", "id", F.when(F.col("id").isNull(), "create").otherwise("use").alias("outcome"))


def rename_collections(have: DataFrame, renames: DataFrame) -> DataFrame:
    """id, name and outcome after renames (id, new_name): a blank name or one that another collection has is refused.

    Of several renames to one name the least id gets it.
    """
    asked = renames.select("id", F.trim("new_name").alias("new_name"))
    taken = have.select(F.col("id").alias("_owner"), F.col("name").alias("new_name"))
    first = asked.groupBy("new_name").agg(F.min("id").alias("_first"))
    out = have.join(asked, "id", "left").join(taken, "new_name", "left").join(first, "new_name", "left")
    outcome = F.when(F.col("new_name").isNull(), "kept").when(F.col("new_name") == "", "blank")
    outcome = outcome.when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("id")) | (F.col("_first") != F.col("id")), "taken").otherwise("renamed")
    return out.select("id", F.when(outcome == "renamed", F.col("new_name")).otherwise(F.col("name")).alias("name"), outcome.alias("outcome"))


def delete_songs(gone: DataFrame, members: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership and queue (song_id) without the songs gone (song_id)."""
    return members.join(gone, "song_id", "left_anti"), queue.join(gone, "song_id", "left_anti")


def delete_collections(gone: DataFrame, members: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership without the collections gone (collection_id); queue entries stay and forget where they came from."""
    lost = gone.select(F.col("collection_id").alias("from_collection"), F.lit(True).alias("_gone"))
    kept = queue.join(lost, "from_collection", "left").withColumn("from_collection", F.when(F.col("_gone").isNull(), F.col("from_collection"))).drop("_gone")
    return members.join(gone, "collection_id", "left_anti"), kept


def migrate_keys(settings: DataFrame, names: DataFrame) -> DataFrame:
    """Settings (key, value) with the value of each old name copied to its new one (old, new) once; old ones stay."""
    copies = settings.join(names, F.col("key") == F.col("old")).select(F.col("new").alias("key"), "value")
    return settings.unionByName(copies.join(settings, "key", "left_anti"))


def rewrite_texts(df: DataFrame, old: str, new: str) -> DataFrame:
    """Every text column with one folder prefix in place of another, whatever its case and separators."""
    return df.select(*(swap_prefix(F.col(f"`{c}`"), old, new).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))


def migrate(df: DataFrame, version: int, steps: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, int]:
    """A table of an older version brought up by the steps that it lacks; a newer one is refused."""
    if version > len(steps):
        raise ValueError(f"the table is of version {version}, newer than {len(steps)}")
    for step in steps[version:]:
        df = step(df)
    return df, len(steps)


def add_columns(**columns: str) -> Callable[[DataFrame], DataFrame]:
    """A migration that adds null columns, or zero ones where the type ends in =0."""

    def step(df: DataFrame) -> DataFrame:
        fresh = {k: F.lit(0 if v.endswith("=0") else None).cast(v.removesuffix("=0")) for k, v in columns.items()}
        return df.withColumns(fresh)

    return step


#: The song table's migrations: version i becomes i + 1.
MIGRATIONS = [
    add_columns(title="string", artist="string"),
    add_columns(reviewed_at="long"),
    add_columns(year="int", genre="string", pace_wpm="double", meta_version="long=0"),
    add_columns(cover_by_user="boolean=0"),
]


def add_members(have: DataFrame, new: DataFrame) -> DataFrame:
    """collection_id, song_id and position of the new members (collection_id, song_id), those already there left out."""
    bases = have.groupBy("collection_id").agg((F.max("position") + 1).alias("base"))
    rows = new.distinct().join(have, ["collection_id", "song_id"], "left_anti").join(bases, "collection_id", "left")
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("song_id")) - 1
    return rows.select("collection_id", "song_id", (F.coalesce("base", F.lit(0)) + place).alias("position"))


def little_endian(number: Column) -> Column:
    """The eight bytes of a long, the least significant first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2))))


def opaque_id(number: Column, salt: str) -> Column:
    """An id that guests may see: "s" and ten hex digits of the salted hash of the number's bytes."""
    return F.concat(F.lit("s"), F.left(F.sha2(F.concat(F.lit(f"{salt}:").cast("binary"), little_endian(number)), 256), F.lit(10)))


def listing(songs: DataFrame, members: DataFrame, collections: DataFrame, salt: str) -> DataFrame:
    """id, pid, title, artist, duration, collections (names in folded order, an empty array where there are none) and ready."""
    named = members.join(collections.select(F.col("id").alias("collection_id"), "name"), "collection_id")
    names = named.groupBy(F.col("song_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("fold"), "name"))).alias("names"))
    rows = songs.join(names, "id", "left")
    return rows.select(
        "id", opaque_id(F.col("id"), salt).alias("pid"), "title", F.nullif(F.trim("artist"), F.lit("")).alias("artist"), F.round("duration_s", 1).alias("duration"),
        F.coalesce(F.transform("names", lambda x: x["name"]), F.array().cast("array<string>")).alias("collections"), singable().alias("ready"),
    )


def check_requests(asks: DataFrame, songs: DataFrame, queue: DataFrame, limit: int) -> DataFrame:
    """asks (party, guest, song_id) with a verdict: unknown, not_ready, limit or ok, the first that holds."""
    waiting = queue.where(~F.col("id").eqNullSafe(F.col("playing"))).groupBy("party", "guest").agg(F.count("*").alias("_n"))
    known = songs.select(F.col("id").alias("song_id"), F.lit(True).alias("_known"), singable().alias("_ready"))
    out = asks.join(known, "song_id", "left").join(waiting, ["party", "guest"], "left")
    verdict = F.when(F.col("_known").isNull(), "unknown").when(~F.col("_ready"), "not_ready").when(F.coalesce("_n", F.lit(0)) >= limit, "limit").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_known", "_ready", "_n")


def themes(pins: DataFrame, have: DataFrame, default: str, built_in: str) -> DataFrame:
    """id, theme and pinned of each song (id, pin): the pin if that theme is among `have` (theme), else the default, else the built-in."""
    known = have.select(F.col("theme").alias("pin"), F.lit(True).alias("_known"))
    fallback = have.where(F.col("theme") == default).agg(F.coalesce(F.max("theme"), F.lit(built_in)).alias("_default")).withColumn("_one", F.lit(1))
    out = pins.join(known, "pin", "left").withColumn("_one", F.lit(1)).join(F.broadcast(fallback), "_one")  # one row
    pinned = F.col("_known").isNotNull()
    return out.select("id", F.when(pinned, F.col("pin")).otherwise(F.col("_default")).alias("theme"), pinned.alias("pinned"))


def swap_links(links: DataFrame, swaps: DataFrame) -> DataFrame:
    """Links (list, page_id, url) with the new one of each swap (list, at, new) in its place, and not a second time."""
    out = links.join(swaps, "list", "left")
    here = F.coalesce(F.col("page_id") == F.col("at"), F.lit(False))
    shown = F.coalesce(F.col("url") == F.col("new"), F.lit(False))
    return out.where(here | ~shown).withColumn("url", F.when(here, F.col("new")).otherwise(F.col("url"))).drop("at", "new")
