"""Titles, artists and file names of a catalogue as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canticle.functions.text import squash_spaces

# Words that tag a version of a song where they end its normalized title.
VERSION_WORDS = (
    "version", "ver", "demo", "acoustic", "live", "remaster", "remastered", "edit", "radio", "extended", "mono",
    "stereo", "explicit", "clean", "single", "album", "original", "mix", "take", "unplugged", "session",
)
# Words and phrases that mark a bracketed group of a video title as noise.
NOISE_WORDS = (
    "official", "video", "audio", "lyric", "lyrics", "visualizer", "visualiser", "hd", "hq", "4k", "remaster",
    "remastered", "mv", "m/v", "explicit", "music", "clip",
)
NOISE_PHRASES = ("live performance", "full song")
TAG = rf"(?:{'|'.join(VERSION_WORDS)}|v[0-9]+)"
OTHER = r"[^\p{L}\p{N}/"


def outside_brackets(c: Column) -> Column:
    """A text without its brackets and what is in them, however deep; an open bracket swallows the rest.

    Three rounds take out pairs without brackets in them; what is nested deeper goes character by character.
    """
    flat = c
    for _ in range(3):
        flat = F.regexp_replace(flat, r"[(\[{][^()\[\]{}]*[)\]}]", "")
    rest = F.regexp_replace(F.regexp_replace(flat, r"(?s)[(\[{].*$", ""), r"[)\]}]", "")
    return F.when(flat.rlike(r"(?s)[(\[{].*[)\]}]"), folded_brackets(c)).otherwise(rest)


def folded_brackets(c: Column) -> Column:
    """The same by one pass over the characters."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s, x):
        depth = F.when(x.isin("(", "[", "{"), s["depth"] + 1).when(x.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        shown = (s["depth"] == 0) & ~x.isin(*"()[]{}")
        return F.struct(depth.alias("depth"), F.when(shown, F.concat(s["out"], x)).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.split(c, ""), zero, step, lambda s: s["out"])


def normalize_title(c: Column) -> Column:
    """Lower-case words outside brackets, without apostrophes and punctuation, cut at feat, ft or featuring."""
    bare = F.regexp_replace(F.translate(outside_brackets(c), "'’", ""), r"[^\p{L}\p{N}]", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), squash_spaces(F.lower(bare)), F.lit(" ")), r" (feat|ft|featuring) .*$", ""))


def strip_version(c: Column) -> Column:
    """A normalized title without trailing version tags, and numbers behind them; never stripped to nothing."""
    only = rf"^({TAG})(?: [0-9]+)?(?: {TAG}(?: [0-9]+)?)*$"
    tail = rf"^(\S+(?: \S+)*?)(?: {TAG}(?: [0-9]+)?)+$"
    return F.when(c.rlike(only), F.regexp_extract(c, only, 1)).when(c.rlike(tail), F.regexp_extract(c, tail, 1)).otherwise(c)


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def title_keys(c: Column) -> Column:
    """Keys of a normalized title: two titles match if they share one, so a match is an equi-join."""
    whole, bare = squash(c), squash(strip_version(c))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.concat(F.lit("whole "), whole), F.concat(F.lit("bare "), bare))))


def titles_match(a: Column, b: Column) -> Column:
    return F.arrays_overlap(title_keys(a), title_keys(b))


def artists_match(a: Column, b: Column) -> Column:
    """Whole-word containment either way; blank names match nothing."""
    x, y = (F.concat(F.lit(" "), c, F.lit(" ")) for c in (a, b))
    return (a != "") & (b != "") & (F.contains(x, y) | F.contains(y, x))


def is_live(c: Column) -> Column:
    """A recorded performance: live at, in, from or on; a bracket or dash followed by live; or live alone."""
    low = F.lower(c)
    words = F.concat(F.lit(" "), squash_spaces(F.regexp_replace(low, r"[^\p{L}\p{N}]", " ")), F.lit(" "))
    return words.rlike(" live (at|in|from|on) ") | low.contains("(live") | low.contains("[live") | low.contains("- live") | (words == " live ")


def clean_title(c: Column) -> Column:
    """A video title without what follows " | " and without bracketed groups that hold a noise word."""
    words, phrases = "|".join(NOISE_WORDS), "|".join(NOISE_PHRASES)

    def group(opened: str, closed: str) -> str:
        inside = rf"[^\{closed}]*"
        token = rf"(?:{inside}{OTHER}\{closed}])?(?:{words})(?:{OTHER}\{closed}]{inside})?"
        return rf"\{opened}(?:{token}|{inside}(?:{phrases}){inside})\{closed}"

    return squash_spaces(F.regexp_replace(F.substring_index(c, " | ", 1), rf"(?i){group('(', ')')}|{group('[', ']')}", ""))


def split_artist_title(c: Column) -> tuple[Column, Column]:
    """Artist and title around the first of four dashes that has both sides; null where none has."""
    artist, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for dash in (" -- ", " — ", " – ", " - "):  # the last one tried here is the first choice
        at = F.locate(dash, c)
        a, t = F.trim(F.substring(c, F.lit(1), at - 1)), F.trim(F.substr(c, at + len(dash)))
        good = (at > 0) & (a != "") & (t != "")
        artist, title = F.when(good, a).otherwise(artist), F.when(good, t).otherwise(title)
    return artist, title


def clean_artist(c: Column) -> Column:
    return squash_spaces(F.regexp_replace(F.trim(c), r" - Topic$", ""))


def channel_artist(c: Column) -> Column:
    """The artist that a channel's name reads as; null for blank names and addresses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r" - Topic$", ""), r"VEVO$", ""))
    return F.when(~F.contains(c, F.lit("@")), F.nullif(bare, F.lit("")))


def tidy_case(c: Column) -> Column:
    """Titles in capitals only, of four letters and more, with capital first letters."""
    shout = (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 4) & ~c.rlike(r"\p{Ll}")
    return F.when(shout, F.initcap(c)).otherwise(c)


def song_meta(title: Column, track: Column, credited: Column, channel: Column) -> tuple[Column, Column]:
    """Title and artist of a fetched song: its music metadata, else "Artist - Title", else the channel."""
    track, credited = F.nullif(F.trim(track), F.lit("")), F.nullif(F.trim(credited), F.lit(""))
    a, t = split_artist_title(title)
    known = track.isNotNull() & credited.isNotNull()
    name = F.when(known, track).when(t.isNotNull(), t).otherwise(F.coalesce(track, title))
    artist = F.when(known, credited).when(t.isNotNull(), F.coalesce(credited, a)).otherwise(F.coalesce(credited, channel_artist(channel)))
    return tidy_case(clean_title(name)), F.nullif(tidy_case(clean_artist(artist)), F.lit(""))


def thumbnail(listed: Column) -> Column:
    """The JPEG or PNG of largest area among structs (url, width, height), the last one among equals."""
    still = F.filter(listed, lambda x: F.lower(F.regexp_replace(x["url"], r"[?#].*$", "")).rlike(r"\.(jpg|jpeg|png)$"))
    numbered = F.transform(still, lambda x, i: F.struct((F.coalesce(x["width"], F.lit(0)) * F.coalesce(x["height"], F.lit(0))).alias("area"), i.alias("i"), x["url"].alias("url")))
    return F.array_max(numbered)["url"]


def links(c: Column) -> Column:
    """The distinct links of a text in their order; bare www. and short hosts get https://, closing punctuation goes."""
    tokens = F.transform(F.split(c, r'[\s<>"]+'), lambda t: F.regexp_replace(t, r"[),.;]+$", ""))
    whole = F.transform(tokens, lambda t: F.when(t.rlike(r"(?i)^(www\.|youtu\.be/|m\.youtube\.com/|music\.youtube\.com/)"), F.concat(F.lit("https://"), t)).otherwise(t))
    return F.array_distinct(F.filter(whole, lambda t: t.rlike(r"(?i)^https?://[^\s/]+\.[^\s/]+")))


def site_label(c: Column) -> Column:
    """A site's name as people say it."""
    low = F.lower(c)
    named = F.when(low.startswith("youtube"), "YouTube").when(low.isin("archiveorg", "archive.org"), "Internet Archive")
    for start, label in (("soundcloud", "SoundCloud"), ("bandcamp", "Bandcamp"), ("vimeo", "Vimeo")):
        named = named.when(low.startswith(start), label)
    return named.otherwise(F.coalesce(F.nullif(F.regexp_replace(c, ":.*", ""), F.lit("")), F.lit("Web")))


def may_have_album_version(site: Column, channel: Column) -> Column:
    return (site_label(site) == "YouTube") & ~F.coalesce(F.trim(channel), F.lit("")).rlike(" - Topic$")


def export_name(title: Column, extension: str) -> Column:
    """A file name from a title: no characters that a file system refuses, no dots or blanks at the end."""
    bare = F.regexp_replace(squash_spaces(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "")), r"[. ]+$", "")
    return F.concat(F.coalesce(F.nullif(bare, F.lit("")), F.lit("song")), F.lit(f".{extension}"))


def folder_of(c: Column) -> Column:
    """The folder of a path; a path with no folder, or one at the root, stays."""
    return F.when(c.rlike(r"^.+[\\/][^\\/]*$"), F.regexp_extract(c, r"^(.+)[\\/][^\\/]*$", 1)).otherwise(c)


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {one}s")))
