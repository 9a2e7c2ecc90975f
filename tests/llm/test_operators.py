import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canticle.llm import blocks, decontamination, langid, lm_scoring, mixing, near_dedup, quality, queries, sharding, substring_dedup, topk, toxicity
from tests.conftest import DATA, DATA_001
from tests.helpers import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key int, block string"


def odd_documents(seed=3, n=60):
    """Copies, near copies, ties, repeated rows, nulls, empty, periodic and long texts; clashing columns."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 40, 120]))) for _ in range(n)]
    for i in range(n // 2):
        words = texts[r.randrange(n)].split()
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \n\t", "a" * 400, "ab" * 300, "a" * 399, "É" * 80, "x " * 3000]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, texts[3]), (None, None), (7, texts[10])]
    return [(i, t, "en", None if (k % 5 == 0) else f"s{k % 3}", 1, "b", k, "x") for k, (i, t) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def removed(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49 if i is not None else 0):
            k = b[p : p + 50]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_against_brute_force(spark):
    rows = odd_documents()
    for options in ({}, {"block_bytes": 2000, "bucket_bytes": 3000, "hot_blocks": 1}):
        got = substring_dedup.remove_repeats(spark, frame(spark, rows), **options)
        assert sorted((tuple(r) for r in got.collect()), key=str) == removed([(r[0], r[1]) for r in rows])
    assert substring_dedup.remove_repeats(spark, frame(spark, [])).count() == 0


def test_substring_dedup_in_packs_and_shelves(spark):
    """Blocks of a pack and buckets of a shelf share messages; anchors are hot by their segments, not by their blocks."""
    rows = odd_documents(9)
    for options in ({"shelves": 2}, {"shelves": 1, "hot_segments": 1}, {"shelves": 3, "hot_segments": 3}):
        got = substring_dedup.remove_repeats(spark, frame(spark, rows), block_bytes=2000, bucket_bytes=300, **options)
        assert sorted((tuple(r) for r in got.collect()), key=str) == removed([(r[0], r[1]) for r in rows])
    batch = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*((i, t, 0) for i, t, *_ in rows), strict=True), (pa.int64(), pa.string(), pa.int8()), strict=True)], ["doc_id", "text", "tag"])
    packs = list(blocks._packed(blocks._filled((batch[k : k + 10] for k in range(0, len(rows), 10)), 8000), 8000))
    assert sum(len(b.ids) for p in packs for _, b in blocks.opened(p)) == len(rows) and len(packs) < 10
    deal = substring_dedup.Deal(100, 50, 2000)
    asked = [m for p in packs for m in substring_dedup._ask(deal)([p])]
    assert sum(len(list(b)) for p in packs for _, b in deal.blocks(p)) > len(packs) and max(m.num_rows for m in asked) == 2

    def codes(texts, hot):
        each = [blocks._packed([pa.record_batch([pa.array([k], pa.int64()), pa.array([t]), pa.array([0], pa.int8())], ["doc_id", "text", "tag"])], 8000) for k, t in enumerate(texts)]
        asked = [m for b in each for m in substring_dedup._ask(substring_dedup.Deal(1, 1, 8000))(b)]
        return {c for x in substring_dedup._answered(pa.Table.from_batches(asked), hot, None)["codes"] for c in blocks.unsqueeze(x.as_py())}

    line = " ".join(f"w{k}" for k in range(30))
    assert codes([line] * 40, 40) == {substring_dedup.REPEATED} and codes([line] * 41, 40) == {substring_dedup.HOT}
    assert codes([line], 0) == {substring_dedup.NONE}


def shingled(text):
    fold = {c: c + 32 for c in range(65, 91)}
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows, similarity=85):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs; rows of one doc_id are one document."""
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            alike = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
            if alike or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_near_dedup_against_brute_force(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    clash = [(i, t, "en", "s", 1, "b", 0, "x") for i, t in [(3, a), (7, a), (7, b), (9, b), (2, c), (None, c + " tail"), (None, "only " + a[:40]), (9, None), (11, "x y " * 200000)]]
    for rows in (odd_documents(5), odd_documents(6) + clash, clash):
        want = components([(r[0], r[1]) for r in rows])
        got = near_dedup.near_duplicates(spark, frame(spark, rows)).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(spark, frame(spark, [])).count() == 0
    kept = near_dedup.keep_one_of_each(spark, frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    texts = [r["text"] for r in kept.collect()]
    assert sorted(t for t in texts if t in (a, b)) == [a, b]


def test_overlap_matrix_equals_set_overlaps():
    """The matrix path of a tile (256 pairs and more) against plain sets."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    base = r.choice(10**6, 400, replace=False).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[: 400 - k], (2 * 10**6 + 1000 * k + np.arange(k)).astype(np.uint64)])) for k in range(60)]
    square = pa.table({"id": np.arange(60), "part": np.arange(60), "own": np.zeros(60, np.int32), "a": np.zeros(60, np.int32), "b": np.zeros(60, np.int32), "bag": [s.tobytes() for s in sets]})
    got = near_dedup._linked(square, 85)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)) == want and want


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(0)
    a = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:700], r.integers(0, 1 << 63, 300).astype(np.uint64)]))
    s = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.15


def test_topk_edge_cases(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, []), (6, [-1.0, 2.0, 0.25]), (7, [1.0, 0.5]), (None, [9.0]), (8, [float("inf")]), (7, [1.0, 0.5])]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit(1)), F.col("vec_id") % 50 == 0).collect()
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = set()
    for q, v in ok:
        if q % 50 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(v, w)), i) for i, w in ok if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_sql_twins(spark):
    con = connect(DATA_001)
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, DATA_001), con, sql)


def test_mixing_edge_cases(spark):
    rows = odd_documents()
    got = mixing.mix(spark, frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    assert got["taken"].sum() <= 1.5 * got["size"].sum() + 1e-6
    assert sorted(mixing.apply_mix(spark, frame(spark, rows)).columns) == sorted(frame(spark, []).columns)
    assert mixing.apply_mix(spark, frame(spark, rows)).count() == got["copies"].sum()
    assert mixing.mix(spark, frame(spark, [])).count() == 0
    twins = [(1, f"{x} " * 50, "en", "s", 1, "b", k, "x") for k, x in enumerate("abcdefgh")] + [(k, "w " * 50, "en", "t", 1, "b", k, "x") for k in range(9)]
    taken = [Counter(r["text"] for r in mixing.apply_mix(spark, frame(spark, twins).repartition(n)).collect()) for n in (1, 5, 3)]
    assert taken[0] == taken[1] == taken[2]


def test_decontamination_edge_cases(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = frame(spark, [(1, "intro " + text + " outro", "", "", 0, "", 0, ""), (2, text.replace("t3 ", "zz "), "", "", 0, "", 0, ""), (3, "t1 t2", "", "", 0, "", 0, ""), (None, text, "", "", 0, "", 0, ""), (4, None, "", "", 0, "", 0, ""), (5, "", "", "", 0, "", 0, "")])
    items = spark.createDataFrame([(1, text.upper()), (2, "t1 t2"), (3, None), (4, ""), (None, text)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark, docs, items).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (3, 2), (1, None), (2, None), (None, None)}
    assert {r["doc_id"] for r in decontamination.keep_unleaked(spark, docs, items).collect()} == {4, 5}
    assert decontamination.leaks(spark, docs, items.limit(0)).count() == 0


def test_lm_scoring_against_brute_force(spark):
    rows = odd_documents()
    labels = spark.createDataFrame([(0, 1), (3, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    counts, contexts = ({0: Counter(), 1: Counter()} for _ in range(2))
    tokens = lambda t: [(b"\xff" * 4 + (t or "").encode() + b"\xfe")[i : i + 5] for i in range(len((t or "").encode()) + 1)]
    for r in rows:
        for m in (0, 1) if r[0] in (0, 3) else (0,):
            for k in tokens(r[1]):
                counts[m][k] += 1
                contexts[m][k[:4]] += 1
    loss = lambda t, m: -sum(math.log((counts[m][k] + 0.1) / (contexts[m][k[:4]] + 25.7)) for k in tokens(t)) / len(tokens(t))
    want = sorted((str(r[0]), len(tokens(r[1])), round(loss(r[1], 1), 4), round(loss(r[1], 0), 4)) for r in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in lm_scoring.score(spark, frame(spark, rows), labels, block_bytes=3000).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a - b) < 2e-4 for g, w in zip(got, want, strict=True) for a, b in zip(g[2:], w[2:], strict=True))
    assert lm_scoring.score(spark, frame(spark, []), labels).count() == 0


def test_decontamination_by_shuffle_equals_broadcast(spark, monkeypatch):
    """Beyond BROADCAST_ROWS sketches are joined by a shuffle, with the same result."""
    docs, items = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "benchmark"))
    rows = lambda: sorted(map(str, decontamination.leaks(spark, docs, items).collect()))
    small = rows()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert rows() == small and small


def auc(rows):
    """The share of pairs of a positive and a negative that the score orders rightly; ties count half."""
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_classifiers_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA_001}/labels.parquet")
    for name, label, recall, precision, area in (("op1_quality", "quality", 0.95, 0.95, 0.99), ("op9_toxicity", "toxic", 0.6, 0.75, 0.9)):
        rows = queries.queries()[name](spark, DATA_001).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
        hit = sum(r["predicted"] and r["y"] for r in rows)
        assert hit >= recall * sum(r["y"] for r in rows) and hit >= precision * sum(r["predicted"] for r in rows)
        assert auc([(r["score"], r["y"]) for r in rows]) >= area


def test_network_against_a_naive_forward_pass_and_numeric_gradients():
    """Scores by loops over windows and chunks, and gradients by differences."""
    from canticle.llm import kernels as K
    import pyarrow as pa

    q = quality
    net = q.Network(3)
    texts = ["", "abc", "hello world " * 9, "aaaa" * 40, "Zürich " * 11]

    def naive(text):
        b = list(text.encode()) + [q.PAD] * 3 * q.HALF
        halves = max(1, -(-len(text.encode()) // q.HALF))
        size = halves * q.HALF
        b = list(text.encode()) + [q.PAD] * (size + 2 * q.HALF - len(text.encode()))
        pools = []
        for f in range(q.BYTE_FILTERS):
            pools.append(max(net.p["bias"][f] + sum(net.p["table"][j][b[p + j]][f] for j in range(q.WIDTH)) for p in range(0, size, q.STRIDE)))
        shares = [[sum(b[p] != q.PAD and p >= d and b[p] == b[p - d] for p in range(h * q.HALF, h * q.HALF + 2 * q.HALF)) / (2 * q.HALF) for d in range(1, q.LAGS + 1)] for h in range(halves)]
        for f in range(q.LAG_FILTERS):
            pools.append(max(net.p["lag_bias"][f] + sum(s[d] * net.p["lags"][d][f] for d in range(q.LAGS)) for s in shares))
        x = sum(max(0.0, v) * w for v, w in zip(pools, net.p["out"], strict=True)) + net.p["out_bias"][0]
        return 1 / (1 + math.exp(-x))

    buf, off = K.buffer_of(pa.array(texts))
    assert np.abs(net.probabilities(buf, off) - [naive(t) for t in texts]).max() < 1e-5
    y, rows = np.array([0, 1, 1, 0, 1], np.float32), np.arange(5)
    grad = net._gradient(buf, off, y, rows)

    def loss():
        p = net.probabilities(buf, off)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("out", (3,)), ("out_bias", (0,)), ("lags", (3, 1)), ("bias", (2,)), ("table", (0, ord("h"), 5)), ("lag_bias", (4,))):
        keep, step = net.p[k][at], 1e-2
        net.p[k][at] = keep + step
        up = loss()
        net.p[k][at] = keep - step
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * step) - grad[k][at]) < 2e-3


def test_ftrl_against_plain_python():
    """Weights after a few rows, by the published recurrence coordinate by coordinate."""
    r = random.Random(1)
    rows = [(sorted(r.sample(range(40), 6)), r.randrange(2)) for _ in range(60)]
    model, z, n = toxicity.Ftrl(), {}, {}
    A, B_, L1, L2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        l1 = 0.0 if i == toxicity.BIAS else L1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((B_ + math.sqrt(n.get(i, 0.0))) / A + L2)

    for x, label in rows * 8:
        at = [*x, toxicity.BIAS]
        model.learn(np.array(at), label)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / A
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    got = model.weights(np.array([*range(40), toxicity.BIAS]))
    assert np.allclose(got, [weight(i) for i in [*range(40), toxicity.BIAS]]) and np.abs(got).max() > 0


def test_classifiers_edge_cases(spark):
    docs, none = frame(spark, odd_documents()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert {r["score"] for r in quality.score(spark, docs, None).collect()} == {0.5}
    weights = toxicity.fit(docs, none)
    assert {r["score"] for r in toxicity.score(spark, docs, weights).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(spark, docs, quality.fit(docs, one)).where("score between 0 and 1").count() == docs.count()
    assert toxicity.keep_clean(spark, docs, one).columns == docs.columns


def test_langid_edge_cases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "not a url", "<p>x"), (-3, "not a url", "<p>x")], "page_id long, url string, html string")
    out = langid.identify(spark, pages.unionByName(odd), docs).collect()
    assert len(out) == pages.count() + 4
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 and r["lang"] for r in out)
    good = [r for r in out if r["page_id"] >= 0]
    assert sum(r["lang"] == r["declared"] for r in good) >= 0.95 * len(good)
    assert langid.identify(spark, odd, docs.limit(0)).where("lang is not null").count() == 0


def test_langid_many_languages_and_false_declarations(spark):
    """No number of languages is too many, and a page's declaration is outvoted where it is false."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang")
    stray = spark.createDataFrame([(f"zz zz{k} qq", f"x{k:03d}") for k in range(70)], "text string, lang string")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    out = langid.identify(spark, pages, docs.unionByName(stray)).collect()
    assert {len(r["posterior"]) for r in out} == {70 + docs.select("lang").distinct().count()}
    assert sum(r["lang"] == r["declared"] for r in out) >= 0.9 * len(out)
    # Each eighth page declares another language than before.
    truth = {r["page_id"]: r["lang"] for r in langid.identify(spark, pages, docs).collect()}
    wrong = F.when(F.col("page_id") % 8 == 0, F.regexp_replace("html", r"(?i)(<html\b[^>]*?\blang\s*=\s*[\"']?)[a-zA-Z]{2}", "$1zz")).otherwise(F.col("html"))
    lied = langid.identify(spark, pages.withColumn("html", wrong), docs).collect()
    assert any(r["declared"] == "zz" for r in lied)
    assert sum(r["lang"] == truth[r["page_id"]] for r in lied) >= 0.95 * len(lied)


def test_langid_posterior_against_plain_python(spark):
    docs = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "en"), ("no language", None)]
    pages = [(1, "https://a.example.com/x", "<html lang=en><p>the cat sat</p>"), (2, "https://b.example.com/", "<html lang=de>die katze</html>"), (3, "http://www.other.fr/y", "le chien"), (4, None, None), (4, "", ""), (5, "https://a.example.com/z", "<html lang='fr'>the dog and the cat")]
    got = langid.identify(spark, spark.createDataFrame(pages, "page_id int, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    cells = lambda t: [((((b[i] << 16) | (b[i + 1] << 8) | b[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for b in [t.lower().encode()] for i in range(len(b) - 2)]
    langs, n, model = ["de", "en", "fr"], 1 << 16, {}
    for x in langs:
        c = Counter(k for t, y in docs if y == x and t for k in cells(t))
        model[x] = lambda k, c=c, total=sum(c.values()): math.log((c[k] + 0.5) / (total + 0.5 * n))
    strip = lambda h: re.sub(r"&[a-zA-Z#0-9]{1,8};", " ", re.sub(r"<[^>]*>", " ", h or ""))
    rows = []
    for i, url, html in pages:
        k = cells(strip(html))
        score = [sum(model[x](c) for c in k) * 0.2 * min(1, 400 / max(1, len(k))) for x in langs]
        w = [math.exp(s - max(score)) for s in score]
        host = (re.match(r"^[a-z]+://([^/?#:]*)", url or "") or [None, ""])[1]
        said = (re.match(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html or "") or [None, ""])[1]
        rows.append((i, score, [x / sum(w) for x in w], said, host.split(".")[-1], host, ".".join(host.split(".")[-2:])))
    total = [sum(r[2][k] for r in rows) for k in range(3)]
    for r, out in zip(sorted(rows, key=str), sorted(got, key=lambda o: str((o["page_id"], o["text_lang"] is None))), strict=True):
        fused = []
        seen = lambda at, k: max(0.0, sum(q[2][k] for q in rows if q[at] == r[at]) - r[2][k])
        rest = [max(0.0, total[k] - r[2][k]) for k in range(3)]
        for k in range(3):
            say = sum(math.log((seen(at, k) + 0.5) / (rest[k] + 0.5 * (len({q[at] for q in rows}) + 1))) for at in (3, 4))
            general = (rest[k] + 0.5) / (sum(total) - 1 + 1.5)
            domain = (seen(6, k) + 5 * general) / (sum(seen(6, j) for j in range(3)) + 5)
            fused.append(r[1][k] + say + math.log((seen(5, k) + 5 * domain) / (sum(seen(5, j) for j in range(3)) + 5)))
        w = [math.exp(f - max(fused)) for f in fused]
        assert out["lang"] == langs[fused.index(max(fused))]
        assert all(abs(x / sum(w) - y) < 1e-6 for x, y in zip(w, out["posterior"], strict=True))


def test_shard_store_round_trip(spark, tmp_path):
    docs = frame(spark, odd_documents())
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20)
    for k in range(6):
        store.append(docs.where(F.pmod(F.hash("key"), F.lit(6)) == k).coalesce(1), 10)
    before = store.manifest().count()
    store.compact()
    assert store.manifest().count() < before
    rows = lambda d: sorted(map(str, d.select(docs.columns).collect()))
    assert rows(store.read()) == rows(docs) == rows(store.read(6))
    store.vacuum()
    assert rows(store.read()) == rows(docs) and store.versions() == [7]
    assert len(list((tmp_path / "store" / "manifests").iterdir())) == 1
    assert {str(p) for p in (tmp_path / "store" / "data").rglob("*.parquet")} == {re.sub("^file:/*", "/", r["path"]) for r in store.manifest().collect()}
    try:
        store._commit(store.versions()[-1], store.manifest())
        raise AssertionError("a version was committed twice")
    except sharding.Conflict:
        pass
    assert sharding.shard(spark, docs).count() == docs.count()
    assert sharding.shard(spark, frame(spark, [])).count() == 0


def test_shard_store_interleaved_writers(spark, tmp_path):
    """Two writers start from one version: one wins it, the other goes on from there, nothing is lost."""
    docs = frame(spark, odd_documents())
    one, two = (sharding.ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(docs.where("key < 20"), 10)
    commit, late = one._commit, []

    def slow(version, shards):
        if not late:
            late.append(two.append(docs.where("key >= 60"), 10))
            two.vacuum()  # beside an append that has written its shards and not yet committed
        return commit(version, shards)

    one._commit = slow
    assert one.append(docs.where("key >= 20 and key < 60"), 10) == 3 and late == [2]
    assert sorted(map(str, one.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_shard_store_outlives_a_dead_writer(spark, tmp_path):
    """A writer that dies before its version has a name, or an empty version file, holds nobody up."""
    docs = frame(spark, odd_documents())
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20)
    store.append(docs.where("key < 30"), 10)
    dead = sharding.ShardStore(spark, store.root)
    dead._published = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)
    try:
        dead.append(docs.where("key >= 30"), 10)
        raise AssertionError("the writer lived")
    except KeyboardInterrupt:
        pass
    assert store.versions() == [1]
    (tmp_path / "store" / "versions" / "v000002").touch()
    assert store.latest() == 1 and store.read().count() == docs.where("key < 30").count()
    assert store.append(docs.where("key >= 30"), 10) == 3
    assert store.compact() >= 3
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_short_items_are_found_inside_documents(spark):
    from tests.helpers import connect

    texts = ["a secret answer is hidden here", "Secret\tANSWER is", "secret answer", "no", "the answer is no", "", None, "x " * 300_000 + "secret answer is", "secret answer is secret answer is"]
    docs = frame(spark, [(k, t, "", "", 0, "", 0, "") for k, t in enumerate(texts)] + [(None, "so secret answer is", "", "", 0, "", 0, "")])
    items = spark.createDataFrame([(1, "secret answer is"), (2, "no"), (3, " "), (4, None), (5, "answer is"), (6, "a secret answer is hidden")], "item_id long, text string")
    got = decontamination.leaks(spark, docs, items, least=1).drop("key")
    want = {(k, i) for k, t in [*enumerate(texts), (None, "so secret answer is")] for i, x in ((1, "secret answer is"), (2, "no"), (5, "answer is"), (6, "a secret answer is hidden")) if f" {x} " in f" {' '.join((t or '').lower().split())} "}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10
    assert {(r["item_id"], r["n_words"]) for r in got.collect()} == {(1, 3), (2, 1), (5, 2), (6, 5)}
    whole = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark, docs, items).collect()}
    assert whole == {(1, 1), (3, 2), (0, 6)}
    some = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark, docs, items, least=3).collect()}
    assert some == {x for x in want if x[1] in (1, 6)} | {(3, 2)}
    assert {r["doc_id"] for r in decontamination.keep_unleaked(spark, docs, items, least=3).collect()} == {2, 4, 5, 6}
    con = connect(DATA)
    con.register("d", docs.where("doc_id is not null and doc_id != 7").select("doc_id", "text").toPandas())
    con.register("i", items.toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM d; CREATE OR REPLACE VIEW benchmark AS SELECT * FROM i")
    twin = {(int(r[0]), int(r[1])) for r in con.execute(queries.OP3_SQL).fetchall()}
    assert twin == {x for x in want if x[0] not in (None, 7)}  # the twin holds a text once a word


def test_labels_of_other_documents_do_not_thin_the_sample(spark):
    """The bound holds for labelled documents, however many labels there are; weights are means over learners that ran."""
    docs = frame(spark, [(k, f"word{k % 7} " * 5 + ("vile" if k % 3 == 0 else "kind"), "", "", 0, "", 0, "") for k in range(200)])
    labels = spark.range(400_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    rows, n = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 16000)
    assert n == 200 == rows.count()
    rows, n = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert n == 100 and 60 < rows.count() < 140
    few, all_ = toxicity.fit(docs, labels), toxicity.fit(docs, labels.where("doc_id < 200"))
    assert (few == all_).all() and few.any()
    one = docs.where("doc_id < 3")
    monkey, toxicity.ROWS_PER_LEARNER = toxicity.ROWS_PER_LEARNER, 1
    try:
        weights, ran = toxicity.fit_known(one, labels)
    finally:
        toxicity.ROWS_PER_LEARNER = monkey
    assert ran and np.isfinite(weights).all()


def test_compaction_plan_against_plain_python(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=100)
    r = random.Random(4)
    live = [(f"p{k:03d}", k % 4, r.randrange(1, 70), 5, 1 + k // 10) for k in range(50)]
    got = {}
    for x in store.plan(spark.createDataFrame(live, sharding.MANIFEST)).collect():
        got.setdefault(x["run"], set()).add(x["path"])
    want = []
    for tier in range(4):
        small = sorted((x for x in live if x[1] == tier and x[2] < 50), key=lambda x: (x[4], x[0]))
        total, runs = 0, {}
        for x in small if len(small) >= store.fanin else []:
            runs.setdefault(total // 100, set()).add(x[0])
            total += x[2]
        want += [v for v in runs.values() if len(v) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and set(got) == set(range(len(want)))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
            if name == "near_dedup":
                want = components([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
                assert {r["doc_id"] for r in out.collect()} == {i for i, _, c in want if c == i}
        docs = out.persist()
    assert docs.count() > 0


def test_keep_clean_keeps_all_where_nothing_was_learned(spark):
    docs, kind = frame(spark, odd_documents()), "doc_id long, quality int, toxic int"
    for rows in ([], [(0, 1, None), (3, 0, None)], [(-1, 1, 0), (-2, 0, 1)]):
        assert toxicity.keep_clean(spark, docs, spark.createDataFrame(rows, kind)).count() == docs.count()
    toxic = toxicity.keep_clean(spark, docs, spark.createDataFrame([(0, 0, 1)], kind))
    clean = toxicity.keep_clean(spark, docs, spark.createDataFrame([(0, 1, 0)], kind))
    assert toxic.count() == 0 and clean.count() == docs.count()


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    texts = [(5, a), (5, a), (5, b), (3, a + " more"), (None, a), (None, c), (None, c), (9, b), (8, None), (None, ""), (8, None)]
    rows = [(i, t, "en", "s", 1, "b", k, "x") for k, (i, t) in enumerate(texts)]
    kept = near_dedup.keep_one_of_each(spark, frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a + " more"), (5, b), (None, c), (8, None), (8, None), (None, "")], key=str)


def contaminated(rows, items):
    """The rows (doc_id, text) that hold an item by comparing all sets; rows of one doc_id are one document."""
    wanted = [s for s in (shingled(t) for t in items) if s]
    holds = [any(len(s & shingled(t)) >= 0.8 * len(s) for s in wanted) for _, t in rows]
    ids = {i for (i, _), h in zip(rows, holds, strict=True) if h and i is not None}
    return [h if i is None else i in ids for (i, _), h in zip(rows, holds, strict=True)]


def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    """Each stage against plain Python on its own input: nulls, empty and long texts, ties, repeats, clashing names, no rows."""
    import corpus_pipeline as p

    r = random.Random(8)
    rows = odd_documents(9)
    passage = " ".join(f"q{k}" for k in range(40))
    insults = [f"w{r.randrange(300)} you vile scum w{r.randrange(300)} w{k}" for k in range(40)]
    texts = [(2000 + k, t) for k, t in enumerate(insults)] + [(3000, f"a b {passage} c"), (3001, passage.upper()), (3002, "r s t " * 400000), (None, f"x {passage}")]
    rows += [(i, t, "en", "s1", 1, "b", k, "x") for k, (i, t) in enumerate(texts)]
    items = [passage, None, "", "one two", passage]
    labelled = [(i, 1, 0) for i in sorted({x[0] for x in rows if x[0] is not None and x[0] < 90})] + [(2000 + k, 0, 1) for k in range(30)] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(zip([1, 2, 3, 4, None], items, strict=True)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    for name in ("score", "predicted", "held_out", "label", "toxic", "place", "size", "target", "run", "path", "id", "row"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        before = [(x["doc_id"], x["text"]) for x in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out = after.collect()
        if name == "sharding":
            assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in before)
            assert all(n == k[1] for k, n in Counter((x["shard"], x["shard_rows"]) for x in out).items())
            break
        assert after.columns == docs.columns
        kept = Counter((x["doc_id"], x["text"]) for x in out)
        if name == "toxicity":
            assert kept == Counter(x for x in before if "vile" not in (x[1] or ""))
        elif name == "near_dedup":
            groups = {}
            for k, n, c in components([(k, t) for k, (_, t) in enumerate(before)], 80):
                groups.setdefault(c if n else ("blank", k), []).append(before[k][0])
            first = [min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()]
            assert Counter(i for i, _ in kept.elements()) == Counter(first) and not kept - Counter(before)
        elif name == "decontamination":
            gone = contaminated(before, items)
            assert any(gone) and kept == Counter(x for x, g in zip(before, gone, strict=True) if not g)
        else:
            said = Counter()
            for x in mixing.mix(spark, docs).collect():
                said[x["doc_id"], x["size"]] += x["copies"]
            got = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in kept.elements())
            assert got == +said and set(kept) <= set(before)
        docs = after
