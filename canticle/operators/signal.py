"""Signal operators on frames held as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.operators.library import at_places


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def frame_db(x: Column) -> Column:
    """10 log10 of the mean square, never below -120."""
    return 10 * F.log10(total(F.transform(x, lambda v: v * v)) / F.size(x) + 1e-12)


def snr_db(reference: Column, test: Column) -> Column:
    """Power of the reference over that of the difference, in dB; infinite when they are equal."""
    noise = total(F.zip_with(reference, test, lambda a, b: (a - b) * (a - b)))
    power = total(F.transform(reference, lambda a: a * a))
    return F.when(noise == 0, F.lit(float("inf"))).otherwise(10 * F.log10(power / noise))


def soft_limit(v: Column, knee: float = 0.8) -> Column:
    """Linear up to the knee, tanh above it."""
    a, room = F.abs(v), 1 - knee
    return F.when(a <= knee, v).otherwise(F.signum(v) * (knee + room * F.tanh((a - knee) / room)))


def with_value(value: Column, f) -> Column:
    """f(value) with the value worked out once a row; a lambda would work it out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_softmax(x: Column) -> Column:
    def shifted(top):
        norm = F.log(total(F.transform(x, lambda v: F.exp(v - top))))
        return with_value(norm, lambda n: F.transform(x, lambda v: v - top - n))

    return with_value(F.array_max(x), shifted)


def zscore(x: Column) -> Column:
    def scaled(mean):
        var = total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x)
        return with_value(F.sqrt(var + 1e-7), lambda sd: F.transform(x, lambda v: (v - mean) / sd))

    return with_value(total(x) / F.size(x), scaled)


def longest_run(x: Column, below: float) -> Column:
    """Length of the longest run of samples below a level."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, v):
        now = F.when(F.abs(v) < below, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(x, zero, step, lambda s: s["best"])


def overlap_add(frames: DataFrame, hop: int, size: int) -> DataFrame:
    """song, sample and the triangularly weighted mean of the frames that cover each sample.

    frames: song, frame_idx, x.  Exploded to samples and summed with map-side combining.
    """
    s = frames.select("song", "frame_idx", F.posexplode("x").alias("i", "v"))
    half = (size + 1) / 2.0
    s = s.withColumn("w", half - F.abs(F.col("i") + 1 - half)).withColumn("sample", F.col("frame_idx") * hop + F.col("i"))
    return s.groupBy("song", "sample").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def leads(shifts: int, most: int) -> list[int]:
    """Delays of the passes: the midpoints of `shifts` equal parts of `most` samples, the latest first; one pass without delay for none."""
    return [most - (2 * k + 1) * most // (2 * shifts) for k in range(shifts)] or [0]


def segments(samples: DataFrame, size: int, stride: int, delays: list[int]) -> DataFrame:
    """song, lead, seg, start, from, to and x: what each pass gives to a model, `size` samples at a time.

    samples: song, j (from 0), v.  A pass delays its song by `lead` zeros.  Segment `seg` answers for the samples
    [from, to) of the delayed song; a short last one is read with what lies around it (start is its first sample read),
    and zeros stand beyond both ends.  A sample names its few segments itself; only one segment is ever gathered.
    """
    n = samples.groupBy("song").agg((F.max("j") + 1).alias("n"))
    s = samples.join(n, "song").withColumn("lead", F.explode(F.array(*map(F.lit, delays))))
    s = s.withColumn("at", F.col("j") + F.col("lead")).withColumn("total", F.col("n") + F.col("lead"))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size) / stride))
    last = F.least(F.floor((F.col("at") + size // 2) / stride), F.floor((F.col("total") - 1) / stride))
    s = s.withColumn("seg", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("from", F.col("seg") * stride)
    s = s.withColumn("to", F.least(F.col("from") + size, F.col("total")))
    s = s.withColumn("start", F.col("from") - F.floor((size - (F.col("to") - F.col("from"))) / 2)).withColumn("i", (F.col("at") - F.col("start")).cast("int"))
    s = s.where((F.col("from") < F.col("total")) & F.col("i").between(0, size - 1))
    rows = s.groupBy("song", "lead", "seg", "start", "from", "to").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    head = F.get("r", F.lit(0))["i"]
    x = F.concat(zeros(head), F.transform("r", lambda p: p["v"]), zeros(F.lit(size) - head - F.size("r")))
    return rows.select("song", "lead", "seg", "start", "from", "to", x.alias("x"))


def shifted_passes(samples: DataFrame, size: int, stride: int, delays: list[int], model: Callable[[Column], Column]) -> DataFrame:
    """song, j and v: the mean over all passes of what `model` makes of a song's segments, blended by triangular weights.

    samples: song, j (from 0, without holes), v (doubles).  The model sees samples less their song's mean, over its
    deviation (a song without one is only centred), `size` at a time, and gives as many.  The stride is at most the size.
    """
    stats = samples.groupBy("song").agg(F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_std"))
    stats = stats.withColumn("_std", F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0))
    level = samples.join(stats, "song").select("song", "j", ((F.col("v") - F.col("_mean")) / F.col("_std")).alias("v"))
    made = segments(level, size, stride, delays).withColumn("y", model(F.col("x")))
    out = made.select("song", "lead", "from", (F.col("from") - F.col("start")).cast("int").alias("trim"), (F.col("to") - F.col("from")).cast("int").alias("kept"), "y")
    out = out.select("song", "lead", "from", F.posexplode(F.slice("y", F.col("trim") + 1, F.col("kept"))).alias("i", "v"))
    half = (size + 1) / 2.0
    out = out.withColumn("w", half - F.abs(F.col("i") + 1 - half)).withColumn("j", F.col("from") + F.col("i") - F.col("lead")).where("j >= 0")
    passes = out.groupBy("song", "lead", "j").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    blended = passes.groupBy("song", "j").agg(F.avg("v").alias("v")).join(stats, "song")
    return blended.select("song", "j", (F.col("v") * F.col("_std") + F.col("_mean")).alias("v"))


def level(frames: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Floor-index quantile of a value in each group, by its place; no group is gathered."""
    return at_places(frames, [by], value, {"level": lambda n: F.floor((n - 1) * F.lit(p))}).select(by, "level")


def voiced(frames: DataFrame, by: str, order: str, db: str, size: int, near: float, least: float) -> DataFrame:
    """chunk, share of frames within `near` dB of the group's loud level, and whether that is `least` or more."""
    rows = frames.join(level(frames, by, db, 0.95), by)
    share = F.avg(F.when(F.col(db) > F.col("level") - near, 1.0).otherwise(0.0))
    return rows.groupBy(by, F.floor(F.col(order) / size).alias("chunk")).agg(share.alias("share")).withColumn("voiced", F.col("share") >= least)


def over_spans(frames: DataFrame, by: list[str]) -> DataFrame:
    """first, last and confidence (the mean log-probability as a probability) of each span of frames (frame_idx, logp)."""
    mean = F.exp(F.avg("logp"))
    return frames.groupBy(*by).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("confidence"))


def runs(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """First and last place of each run of true flags."""
    r = rows.withColumn("_run", F.col(order) - F.row_number().over(Window.partitionBy(by, flag).orderBy(order))).where(flag)
    return r.groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")
