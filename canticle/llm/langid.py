"""Language identification by Bayesian fusion of text, markup, address and host evidence.

    log P(lang | page) = log P(lang | host) + TEMPER * log P(text | lang)
                         + log P(declared | lang) + log P(suffix | lang) + constant

Text likelihoods are byte-trigram models counted over all labelled documents.  What pages declare
and the suffixes of their addresses are counted by grouped aggregation of the text posteriors, and
so are the host priors: a host is smoothed towards its domain, the domain towards all pages.  A
page's own share is taken out of the counts that judge it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import kernels as K
from canticle.llm.storage import Scratch

#: Cells of the hashed trigrams; a language's model is 2^BITS float32.
BITS = 16
#: Languages whose models are broadcast together (16 MB); more are scored in turn, group by group.
TOGETHER = 64
#: Trigrams overlap, so a text's likelihood counts for less than its trigrams; at most EVIDENCE of them.
TEMPER, EVIDENCE = 0.2, 400
ADD, KAPPA = 0.5, 5.0
#: Bytes worked on at once within a batch.
PIECE = 1 << 20


def trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each three bytes in a row within a text, ASCII folded, and the row of each."""
    buf, off = K.buffer_of(texts)
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = K.LOWER[buf].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    size = np.maximum(np.diff(off) - 2, 0)
    start = np.repeat(off[:-1], size)
    inner = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
    return cell[start + inner], np.repeat(np.arange(len(size)), size)


def pieces(texts):
    """A text column in slices of about PIECE bytes; a longer text is alone."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, off = K.buffer_of(texts)
    for lo, hi in K.blocks(off, PIECE):
        yield lo, hi, texts.slice(lo, hi - lo)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        names = np.array(b.column(0).to_pylist(), object)
        for name in set(names.tolist()):
            total.setdefault(name, np.zeros(1 << BITS, np.int64))
            for _, _, part in pieces(b.column(1).filter(pa.array(names == name))):
                total[name] += np.bincount(trigrams(part)[0], minlength=1 << BITS)
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "cell", "n"])


def _model(counts: pa.Table) -> pa.Table:
    """The log-probabilities of one language's cells."""
    n = np.zeros(1 << BITS)
    n[np.array(counts["cell"])] = np.array(counts["n"])
    return pa.table({"lang": counts["lang"][:1], "model": [np.log((n + ADD) / (n + ADD).sum()).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang and model, the log-probabilities of the trigram cells, of each language in docs (text, lang); all of docs counts."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # At most 2^BITS rows a language.  A language whose texts are too short for a trigram has a uniform model.
    known = rows.select("lang").distinct().select("lang", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("n"))
    all_counts = known.unionByName(counts).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return scratch.table(all_counts.groupBy("lang").applyInArrow(_model, "lang string, model binary"), "models")


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]{1,8};", " ")


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (the last two labels) and suffix (the last) of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def declared(html: Column) -> Column:
    """The primary language tag that the markup declares, empty where it declares none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, declared, suffix, host, text_lang and posterior (by langs) of each page.

    pages: page_id, url, html; docs: text, lang.  Null or empty html, url or attributes are values of
    their own (the empty string); such pages rest on the other evidence.  Repeated rows are judged
    one by one.  Ties go to the language that sorts first.  Without labelled docs lang is null.
    """
    scratch = Scratch(spark, "langid")
    models = fit(docs, scratch)
    langs = sorted(r.lang for r in models.select("lang").toLocalIterator())  # names only
    size = len(langs)
    host, domain, suffix = address(F.col("url"))
    rows = pages.select(
        "page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared(F.col("html")).alias("declared"),
        F.array().cast("array<double>").alias("text_score"), visible_text(F.coalesce("html", F.lit(""))).alias("text"),
    )
    kind = dict(rows.dtypes)["page_id"]
    evidence = ["page_id", "host", "domain", "suffix", "declared"]
    schema = f"page_id {kind}, host string, domain string, suffix string, declared string, text_score array<double>"
    if not size:
        none = rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "declared", "suffix", "host")
        return none.withColumns({"text_lang": F.lit(None).cast("string"), "posterior": F.array().cast("array<double>")})
    groups = [langs[k : k + TOGETHER] for k in range(0, size, TOGETHER)]
    for k, group in enumerate(groups):
        last = k == len(groups) - 1
        found = {r.lang: r.model for r in models.where(F.col("lang").isin(group)).toLocalIterator()}  # TOGETHER rows at most
        shared = spark.sparkContext.broadcast(np.stack([np.frombuffer(found[x], np.float32) for x in group]))
        rows = scratch.table(rows.mapInArrow(_scored(shared, evidence, last), schema if last else f"{schema}, text string"), "text")
    return fused(rows, langs)


def _scored(shared, evidence: list[str], last: bool):
    """Adds the tempered log-likelihoods of the broadcast languages to text_score; the last ones drop the text."""

    def run(batches):
        for b in batches:
            size = len(shared.value)
            scores = np.zeros((b.num_rows, size))
            for lo, hi, part in pieces(b.column("text")):
                cell, row = trigrams(part)
                weight = TEMPER * np.minimum(1.0, EVIDENCE / np.maximum(np.bincount(row, minlength=hi - lo), 1))
                for k in range(size):
                    scores[lo:hi, k] = np.bincount(row, shared.value[k][cell], minlength=hi - lo) * weight
            before = [x or [] for x in b.column("text_score").to_pylist()]
            out = {c: b.column(c) for c in evidence} | {"text_score": pa.array([x + y for x, y in zip(before, scores.tolist(), strict=True)], pa.list_(pa.float64()))}
            yield pa.record_batch(out if last else out | {"text": b.column("text")})

    return run


def fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """The posterior of each row (page_id, host, domain, suffix, declared, text_score by langs) from all evidence.

    What each kind of evidence says is counted language by language: a value's sums are one row each, with
    partial sums before the shuffle, so a host that holds a third of all pages is no hot group.
    """
    size = len(langs)
    rows = rows.withColumn("w", F.transform("text_score", lambda x: F.exp(x - F.array_max("text_score"))))
    rows = rows.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b))).drop("w")

    def gathered(by: list[str], name: str) -> DataFrame:
        """The sum of p over each value, by language: at most as long an array as there are languages."""
        cells = rows.select(*by, F.posexplode("p").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
        sums = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
        return cells.groupBy(*by).agg(sums.alias(name)) if by else cells.agg(sums.alias(name))

    total = gathered([], "total").first()["total"] or [0.0] * size
    n_declared, n_suffix = rows.agg(F.count_distinct("declared"), F.count_distinct("suffix")).first()
    out = rows
    for name in ("declared", "suffix", "host", "domain"):
        out = out.join(gathered([name], f"in_{name}"), name)
    everything = F.array(*(F.lit(float(x)) for x in total))

    def less_own(sums: Column) -> Column:
        """Sums without the page's own share."""
        return F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def smoothed(sums: Column, towards: Column) -> Column:
        mass = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b) + KAPPA
        return F.zip_with(sums, towards, lambda s, t: (s + KAPPA * t) / mass)

    out = out.withColumn("rest", less_own(everything))
    out = out.withColumns({f"in_{x}": less_own(F.col(f"in_{x}")) for x in ("declared", "suffix", "host", "domain")})
    out = out.withColumn("general", F.transform("rest", lambda x: (x + ADD) / F.lit(sum(total) - 1 + ADD * size)))
    out = out.withColumn("of_domain", smoothed(F.col("in_domain"), F.col("general")))
    out = out.withColumn("prior", F.transform(smoothed(F.col("in_host"), F.col("of_domain")), lambda x: F.log(F.greatest(x, F.lit(1e-12)))))

    def emission(name: str, values: int) -> Column:
        return F.zip_with(f"in_{name}", "rest", lambda s, r: F.log((s + ADD) / (r + ADD * (values + 1))))

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = out.withColumn("fused", plus(plus(plus(F.col("text_score"), emission("declared", n_declared)), emission("suffix", n_suffix)), F.col("prior")))
    out = out.withColumn("unscaled", F.transform("fused", lambda x: F.exp(x - F.array_max("fused"))))
    out = out.withColumn("posterior", F.transform("unscaled", lambda x: x / F.aggregate("unscaled", F.lit(0.0), lambda a, b: a + b)))
    names = F.array(*(F.lit(x) for x in langs))
    best = F.array_position("fused", F.array_max("fused")).cast("int")
    text_best = F.array_position("text_score", F.array_max("text_score")).cast("int")
    return out.select("page_id", F.element_at(names, best).alias("lang"), F.array_max("posterior").alias("probability"), "declared", "suffix", "host", F.element_at(names, text_best).alias("text_lang"), "posterior")
