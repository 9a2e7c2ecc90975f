"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canticle.shipping import ship

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows with crc32(doc_id) mod 3 = 1 are held out of learning."""
    from canticle.llm import quality, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels, ~toxicity.held_out("_id", 3, 1))
    out = quality.score(spark, docs, network)
    return out.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each vector whose vec_id is divisible by 50."""
    from pyspark.sql import functions as F

    from canticle.llm.topk import top_k

    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in documents: one row a pair."""
    from canticle.llm.decontamination import leaks

    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1).drop("key")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, string_split_regex(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM benchmark),
short AS (SELECT DISTINCT len(w) AS n FROM i WHERE w[1] <> '' AND len(w) < 5),
ds AS (
  SELECT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE w[1] <> '')
  UNION SELECT doc_id, array_to_string(list_slice(w, k, k + n - 1), ' ') FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, short WHERE w[1] <> '')),
iss AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE w[1] <> '')),
n AS (SELECT item_id, count(*) AS n_shingles FROM iss GROUP BY item_id),
l AS (SELECT item_id, max(len(w)) AS n_words FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, any_value(n_words) AS n_words, count(*) / any_value(n_shingles) AS containment
FROM ds JOIN iss USING (s) JOIN n USING (item_id) JOIN l USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 50-byte strings leaves of every document."""
    from canticle.llm.substring_dedup import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canticle.llm.near_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; text models are counted over all documents."""
    from canticle.llm.langid import identify

    return identify(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is the documents labelled of quality 1."""
    from canticle.llm.lm_scoring import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canticle.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows with crc32(doc_id) mod 5 = 0 are held out of learning."""
    from canticle.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels, ~toxicity.held_out("_id", 5, 0))
    out = toxicity.score(spark, docs, weights)
    return out.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canticle.llm.sharding import shard

    return shard(spark, table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    from canticle.llm.lexical import rank

    return rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, a third of them tampered with, and whether they fold to the root."""
    from canticle.llm.merkle import document_leaves, manifest

    return manifest(spark, document_leaves(table(spark, sf_dir, "documents")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.9 on three-word shingles."""
    from canticle.llm.ngram_join import similar_groups

    return similar_groups(spark, table(spark, sf_dir, "documents")).drop("n_copies")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, row_number() OVER () AS row_id
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM per),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (rank - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS spot
  FROM weighed
  WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, budget,
         CASE WHEN level * weight >= cap THEN cap
              ELSE weight * (SELECT arg_min(level, spot) FROM levels WHERE level * weight < cap) END AS target
  FROM levels),
placed AS (
  SELECT s.row_id, s.doc_id, s.size, s.key, t.source_size, t.target, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN (epoch * source_size + cum) / target ELSE 0.0 END AS finish
  FROM placed, (VALUES (0), (1)) e(epoch)),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total FROM copies)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken,
       CAST(sum(CASE WHEN total <= budget THEN 1 ELSE 0 END) AS INTEGER) AS copies, any_value(src) AS source
FROM (SELECT o.*, s.source AS src FROM ordered o JOIN sizes s USING (row_id)) GROUP BY row_id, doc_id, size, source_size, target
"""


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDED = f"translate(text, '{ALPHABET}', '{ALPHABET.lower()}')"

OP11_SQL = rf"""
WITH d AS (
  SELECT r, doc_id, t, len(t) AS n FROM (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS t FROM documents)
  WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM c) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p GROUP BY term),
s AS (
  SELECT q.item_id, p.r, p.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY q.item_id, p.r, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def merkle_sql(part_levels: int = 8, top_levels: int = 3) -> str:
    """The tree level by level: 8^part_levels leaves a lang and 8^top_levels langs at most."""

    def climb(name: str, levels: int) -> str:
        # Per level: nodes (grp, pos, h); a group's single node stays as it is.
        out = ""
        for k in range(levels):
            out += f"""
{name}{k + 1} AS (
  SELECT grp, pos // 8 AS pos, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS total FROM {name}{k}) GROUP BY grp, pos // 8),
{name}{k}s AS (
  SELECT grp, pos, string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
         string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi,
         count(*) OVER (PARTITION BY grp) > 1 AS more
  FROM {name}{k} WINDOW w AS (PARTITION BY grp, pos // 8 ORDER BY pos)),"""
        return out

    def field(x: str) -> str:
        return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    head = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 by half bytes, the low one first; a table entry is four steps of the reflected polynomial.
    entries = list(range(16))
    for _ in range(4):
        entries = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in entries]
    halves = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) & 15 AS BIGINT), CAST(ascii(x) >> 4 AS BIGINT)]))"
    crc32 = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda a, x: xor(CAST({entries} AS BIGINT[])[1 + (xor(a, x) & 15)], a >> 4))"

    def steps(name: str, levels: int, node: str) -> str:
        out = ""
        for k in range(levels):
            out += f"""
{node}{k + 1} AS (
  SELECT f.* REPLACE (CASE WHEN s.more THEN sha256(coalesce(s.lo, '') || f.seen || coalesce(s.hi, '')) ELSE f.seen END AS seen,
                      CASE WHEN s.more THEN f.beside || coalesce(s.lo, '') || coalesce(s.hi, '') ELSE f.beside END AS beside, f.place // 8 AS place)
  FROM {node}{k} f JOIN {name}{k}s s ON s.grp IS NOT DISTINCT FROM f.grp AND s.pos = f.place),"""
        return out

    return f"""
WITH rows_ AS (
  SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field(FOLDED)}) AS folded,
         xor({crc32}, 4294967295) % 3 = 0 AS tampered FROM documents),
f0 AS (
  SELECT doc_id, lang AS grp, leaf, CASE WHEN tampered THEN folded ELSE leaf END AS seen, '' AS beside,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
n0 AS (SELECT grp, place AS pos, leaf AS h FROM f0),{climb('n', part_levels)}{steps('n', part_levels, 'f')}
t0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, h, grp AS lang FROM n{part_levels}),{climb('t', top_levels)}
g0 AS (SELECT f.doc_id, 0 AS grp, f.leaf, f.seen, f.beside, t.pos AS place, t.h AS subroot FROM f{part_levels} f JOIN t0 t ON t.lang IS NOT DISTINCT FROM f.grp),{steps('t', top_levels, 'g')}
r AS (SELECT h AS root FROM t{top_levels})
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, seen AS folded_root, seen = root AS verified FROM g{top_levels}, r
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_topk": op2_topk,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_langid": op6_langid,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
        "op11_search": op11_search,
        "op12_merkle": op12_merkle,
        "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_decontamination": OP3_SQL, "op8_mixing": OP8_SQL, "op11_search": OP11_SQL, "op12_merkle": merkle_sql()}
