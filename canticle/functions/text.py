"""String functions on columns (SURVEY I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Folds A-Z only, as the store's search does."""
    return F.translate(c, UPPER, LOWER)


def normalize_word(c: Column) -> Column:
    """Upper case, letters A-Z and apostrophes only; curly apostrophes count as straight ones."""
    return F.regexp_replace(F.upper(F.translate(c, "‘’ʼ", "'''")), "[^A-Z']", "")


def ui_norm(c: Column) -> Column:
    """Lower case; letters and digits of any script and apostrophes only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}']", "")


def edit_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def clean_name(c: Column) -> Column:
    """Control characters out, white space collapsed, at most 14 characters; null if nothing is left."""
    return F.nullif(F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"\s+", " ")), F.lit(14))), F.lit(""))


def clean_genre(c: Column) -> Column:
    """Null for blank genres and for numeric codes such as "17" and "(17)"."""
    t = F.trim(c)
    return F.when((t != "") & ~t.rlike(r"^\(?[0-9]+\)?$"), t)


def plausible_year(y: Column) -> Column:
    return F.when(y.between(1900, 2100), y)


def site_of(url: Column) -> Column:
    """Lower-case host without www., m. or music.; the short host stands for the long one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^(www|m|music)\.", "")
    return F.when(host == "youtu.be", F.lit("youtube.com")).otherwise(F.nullif(host, F.lit("")))


def file_stem(title: Column, ident: Column) -> Column:
    """A file name: illegal characters out, 60 characters, with a short id or the id's hash."""
    safe = F.trim(F.left(F.trim(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "")), F.lit(60)))
    tag = F.when(F.length(ident) <= 16, ident).otherwise(F.left(F.sha2(ident, 256), F.lit(10)))
    return F.concat(safe, F.lit(" ["), tag, F.lit("]"))


def swap_prefix(path: Column, old: str, new: str) -> Column:
    """Replaces a folder prefix, whatever its case and separators."""
    folded, prefix = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), old.lower().replace("\\", "/").rstrip("/")
    hit = (folded == prefix) | folded.startswith(prefix + "/")
    return F.when(hit, F.concat(F.lit(new), F.substring(path, len(prefix) + 1, 1 << 20))).otherwise(path)


def to_cs(ms: Column) -> Column:
    """Milliseconds to centiseconds, half to even, in integers."""
    q, r = F.floor(ms / 10).cast("long"), F.pmod(ms, F.lit(10))
    return q + F.when((r > 5) | ((r == 5) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)


def lrc_time(cs: Column) -> Column:
    return F.format_string("%02d:%02d.%02d", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def ass_time(cs: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def squash_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def filename_title(c: Column) -> tuple[Column, Column]:
    """Artist and title of a file name, split at the first " - "."""
    t = squash_spaces(F.replace(c, F.lit("_"), F.lit(" ")))
    artist = F.nullif(F.trim(F.regexp_extract(t, r"^(.*?) - (.*)$", 1)), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(t, r"^(.*?) - (.*)$", 2)), F.lit(""))
    both = artist.isNotNull() & title.isNotNull()
    return F.when(both, artist), F.when(both, title).otherwise(t)


def short_time(seconds: Column) -> Column:
    """Minutes and rounded seconds, as lists show a length."""
    t = F.round(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(t / 60), t % 60)


def ago(seconds: Column) -> Column:
    """An age in its largest whole unit; ages below zero are none."""
    d = F.greatest(seconds, F.lit(0))
    told = lambda size, unit: F.concat(F.floor(d / size).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(d < 60, told(1, "s")).when(d < 3600, told(60, "m")).when(d < 86400, told(3600, "h")).otherwise(told(86400, "d"))


def fingerprint(**parts: Column) -> Column:
    """SHA-256 of the parts as JSON, keys in order and nulls written out."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


# The names under which song files give a language, besides its tag.
LANGUAGE_NAMES = {
    "en": ("english", "englisch"), "de": ("german", "deutsch"), "es": ("spanish", "español", "espanol", "castellano"), "fr": ("french", "français", "francais"),
    "it": ("italian", "italiano"), "pt": ("portuguese", "português", "portugues"), "nl": ("dutch", "nederlands"), "sv": ("swedish", "svenska"), "no": ("norwegian", "norsk"),
    "da": ("danish", "dansk"), "fi": ("finnish", "suomi"), "pl": ("polish", "polski"), "cs": ("czech", "čeština", "cestina"), "hu": ("hungarian", "magyar"),
    "ru": ("russian", "русский"), "tr": ("turkish", "türkçe", "turkce"), "el": ("greek", "ελληνικά"), "ja": ("japanese", "日本語"), "ko": ("korean", "한국어"),
    "zh": ("chinese", "中文"), "la": ("latin",),
}


def language_tag(name: Column) -> Column:
    """The tag of a language's name or tag; null for what is not known."""
    names = F.create_map(*(F.lit(x) for tag, known in LANGUAGE_NAMES.items() for n in (tag, *known) for x in (n, tag)))
    return F.try_element_at(names, F.lower(F.trim(name)))


def common_folder(paths: DataFrame, by: str) -> DataFrame:
    """The folder that all paths (id, path) of a group share, whatever the case; null for none and for a bare drive.

    What the least and the greatest list of folder names share, all between share: two aggregates, no gathering.
    """
    parts = F.split(F.regexp_replace("path", r"[\\/][^\\/]*$", ""), r"[\\/]")
    folded = F.transform(parts, F.lower)
    b = paths.groupBy(by).agg(F.min(folded).alias("a"), F.max(folded).alias("z"), F.min_by(parts, "id").alias("first"))
    differ = F.array_position(F.transform(F.arrays_zip("a", "z"), lambda x: x["a"].eqNullSafe(x["z"])), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int")
    folder = F.array_join(F.slice("first", F.lit(1), n), "\\")
    return b.select(by, F.when((folder != "") & ~folder.rlike(r"^[A-Za-z]:$"), folder).alias("folder"))


def headers(text: Column) -> Column:
    """key and value of each #KEY:value line before the first other line; keys in capitals."""
    rows = F.filter(F.transform(F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    other = F.array_position(F.transform(rows, lambda x: x.startswith("#")), False)
    head = F.when(other > 0, F.slice(rows, F.lit(1), (other - 1).cast("int"))).otherwise(rows)
    pairs = F.filter(head, lambda x: x.contains(":"))
    return F.transform(pairs, lambda x: F.struct(F.upper(F.trim(F.regexp_extract(x, "^#([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(x, "^#[^:]*:(.*)$", 1)).alias("value")))


def header(pairs: Column, key: str) -> Column:
    """The value of the first header of a name; null where it is missing or blank."""
    return F.nullif(F.get(F.filter(pairs, lambda x: x["key"] == key), F.lit(0))["value"], F.lit(""))
