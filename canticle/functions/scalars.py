"""Small rules as column functions: colours, rates, windows, escapes, settings (SURVEY I)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, c))


def luminance(colour: Column) -> Column:
    """Relative luminance of a colour in six hex digits, with or without #; null for anything else."""
    digits = F.regexp_extract(F.lower(F.trim(colour)), "^#?([0-9a-f]{6})$", 1)

    def channel(at: int) -> Column:
        s = F.conv(F.substring(digits, at, 2), 16, 10).cast("double") / 255
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return F.when(digits != "", 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def playback_rate(size: Column, seconds: Column, kbps: Column) -> Column:
    """Bytes a second that fetch a file in about the time it plays, by size or bit rate; 8,000 at least, null if neither is known."""
    by_size = F.when((size > 0) & (seconds > 0), size / seconds)
    return F.greatest(F.ceil(F.coalesce(by_size, F.when(kbps > 0, kbps * 1000 / 8))), F.lit(8000))


def progress_fraction(line: Column) -> Column:
    """The share done of a line "done total estimate", where a total may be NA."""
    n = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))
    total = F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(2)))
    return F.when(total > 0, clamp(F.get(n, F.lit(0)) / total, 0.0, 1.0))


def pulse(energy: Column) -> Column:
    return 0.25 + 0.75 * clamp(energy, 0.0, 1.0)


def bar_heights(energy: Column, t: Column, bars: int) -> Column:
    """Heights from 0 to 1 of a row of bars, each with a phase and pace of its own."""
    k = F.sequence(F.lit(0), F.lit(bars - 1))
    return F.transform(k, lambda x: clamp(energy * (0.35 + 0.65 * F.abs(F.sin(x * 1.7 + t * (1.3 + (x % 5) * 0.35)))), 0.0, 1.0))


def line_fit(natural: Column, room: Column) -> tuple[Column, Column]:
    """Scale and wrap of a line: down to 0.55 it shrinks, rounded down to three places; beyond it wraps."""
    over = (natural > 0) & (room > 0) & (natural > room)
    raw = F.floor(room / natural * 1000) / 1000
    return F.when(~over, 1.0).otherwise(F.greatest(raw, F.lit(0.55))), over & (raw < 0.55)


def line_window(start: Column, end: Column, duration: Column, pad: float = 0.6) -> tuple[Column, Column]:
    """A line's visible span: padded, out to whole seconds, inside the song, a second long at least."""
    a = F.greatest(F.lit(0), F.floor(start - pad)).cast("double")
    b = F.least(F.greatest(duration, end), F.ceil(end + pad).cast("double"))
    return a, F.greatest(b, a + 1)


def slot(middles: Column, y: Column) -> Column:
    """Where a drop at y goes: behind the rows whose middle is above it."""
    return F.size(F.filter(middles, lambda m: m < y))


def to_pixels(t: Column, start: Column, end: Column, width: Column) -> Column:
    return F.when(end > start, (t - start) / (end - start) * width).otherwise(0.0)


def escape_like(c: Column) -> Column:
    """A term that LIKE takes literally with a backslash as escape."""
    return F.regexp_replace(c, r"([%_\\])", r"\\$1")


def percent_encode(c: Column) -> Column:
    """Every byte but letters, digits and - . _ ~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def settings(blob: Column, known: dict[str, tuple]) -> Column:
    """A stored JSON blob as a struct, each field with its default where it is missing, malformed or not allowed.

    known: name -> (type, default, allowed values or (low, high) of numbers, None for any).
    """

    def field(name: str, kind: str, default, allowed) -> Column:
        raw = F.get_json_object(blob, f"$.{name}")
        if kind == "boolean":
            v = F.when(raw.isin("true", "false"), raw == "true")
        elif kind == "double":
            v = F.round(clamp(raw.try_cast("double"), float(allowed[0]), float(allowed[1])))
            v = F.when(raw.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), v)
        else:
            v = F.when(raw.isin(*allowed), raw)
        return F.coalesce(v, F.lit(default)).alias(name)

    return F.struct(*(field(k, *v) for k, v in known.items()))


def goertzel(x: Column, share: float) -> Column:
    """Power of a tone of `share` of the sample rate in an array of samples."""
    import math

    c = 2 * math.cos(2 * math.pi * share)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(x, zero, lambda s, v: F.struct((v + c * s["a"] - s["b"]).alias("a"), s["a"].alias("b")), lambda s: F.greatest(F.lit(0.0), s["a"] * s["a"] + s["b"] * s["b"] - c * s["a"] * s["b"]))


def max_delta(x: Column) -> Column:
    return F.coalesce(F.array_max(F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.abs(a - b))), F.lit(0.0))


def rms_envelope(x: Column, size: int, hop: int) -> Column:
    """Root mean squares of whole windows of `size` samples, one every `hop`."""
    at = F.when(F.size(x) >= size, F.sequence(F.lit(0), F.size(x) - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.sqrt(F.aggregate(F.slice(x, i + 1, F.lit(size)), F.lit(0.0), lambda s, v: s + v * v) / size))


def hz_to_mel(hz: Column) -> Column:
    """The mel scale that is linear below 1 kHz and logarithmic above."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.log(hz / 1000) * 27 / F.log(F.lit(6.4)))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15, mel * 200 / 3).otherwise(1000 * F.exp((mel - 15) * F.log(F.lit(6.4)) / 27))
