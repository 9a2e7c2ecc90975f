"""Ranked search, the Merkle manifest and the n-gram join against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from canticle.llm import lexical, merkle, ngram_join
from canticle.llm.blocks import unsqueeze
from canticle.llm import queries as Q
from tests.conftest import DATA, DATA_001
from tests.helpers import connect, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, query string, rank int, part string, row long"
WORDS = ["Ama", "bel", "CORO", "dü", "ecos", "fín", "gul", "h9", "ir", "jota", "ka-la", "l'un"]


def odd_rows(seed: int, n: int = 160, words: int = 40) -> list[tuple]:
    """Rows with null and repeated ids, null, empty and blank texts, ties, copies, near copies and clashing columns."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, words))) for _ in range(n // 2)]
    for t in texts[: n // 4]:
        w = t.split(" ")
        if len(w) > 3:
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    texts += texts[:9] + [None, "", " \t\n", "..--", " ", "solo", None, "A b\x0bc"]
    ids = [*range(len(texts) - 3), 5, None, None]
    r.shuffle(texts)
    return [(i, t, r.choice(["en", "de", None, ""]), r.choice(["web", None]), None if t is None else len(t), "q", 1, "p", 7) for i, t in zip(ids, texts, strict=True)]


def fold(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(text or ""))


def ranked(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    sought = {}
    for item, text in items:
        sought.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in sought.items():
        scores = []
        for i, c in held:
            size = sum(c.values())
            m = 10 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def known(rows):
    return sorted((tuple(r) for r in rows), key=repr)


ITEMS = [(1, "ama coro ecos"), (2, "h9 jota"), (2, "DÜ fín"), (None, "gul ka ir bel ama"), (3, None), (4, "..."), (5, "unseen"), (6, "ama ama ama")]


@pytest.mark.parametrize("seed, group, shard", [(1, 400_000, 1 << 24), (2, 3, 300), (3, 400_000, 500)])
def test_search_is_the_plain_ranking(spark, monkeypatch, seed, group, shard):
    monkeypatch.setattr(lexical, "GROUP_TERMS", group)
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    rows = odd_rows(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, score int")
    got = lexical.rank(spark, docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert known(got.collect()) == known(ranked([r[:2] for r in rows], ITEMS))


def test_search_with_nothing_to_search(spark):
    docs, items = spark.createDataFrame(odd_rows(4), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank(spark, docs.limit(0), items).collect() == []
    assert lexical.rank(spark, docs, items.limit(0)).collect() == []
    assert lexical.rank(spark, docs.where("text is null"), items).collect() == []


def test_search_one_long_text(spark):
    long = " ".join(f"w{i % 50000}" for i in range(400_000))
    rows = [(1, long), (2, "w7 w8"), (3, "w7")]
    got = lexical.rank(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "w7 w8 w9")], "item_id long, text string"))
    assert known(got.collect()) == known(ranked(rows, [(1, "w7 w8 w9")]))


def test_search_skips_what_cannot_qualify():
    """With a score to beat, non-essential lists are probed for few documents; the answer stays whole."""
    r = np.random.default_rng(5)
    import pyarrow as pa

    texts = [" ".join(["the"] * int(r.integers(1, 4)) + (["rare"] if k % 97 == 0 else []) + [f"x{k}"]) for k in range(2000)]
    batch = pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "text": texts})
    (row,) = lexical._indexed([batch], 1 << 24)
    shard = lexical.Shard({c: row.column(c)[0] for c in row.schema.names}, 2000, sum(len(t.split()) for t in texts))
    h, _ = lexical.term_hashes(pa.array(["the rare"]))
    places = np.searchsorted(shard.terms, h)
    weights = np.array([1, 4000])
    all_probed, few = [], []
    found, score = lexical.best(shard, places, weights, 0, all_probed)
    tenth = int(np.sort(score)[-10])
    some, best = lexical.best(shard, places, weights, tenth, few)
    assert sorted(zip(found[score >= tenth], score[score >= tenth], strict=True)) == sorted(zip(some, best, strict=True))
    assert sum(few) < 60 and sum(all_probed) > 2000


@pytest.mark.parametrize("name", ["op11_search", "op12_merkle"])
@pytest.mark.parametrize("folder", [DATA, DATA_001])
def test_sql(spark, name, folder):
    same(Q.queries()[name](spark, folder), connect(folder), Q.oracle_sql()[name])


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return out


def manifested(rows):
    parts = {}
    for doc_id, text, lang, source, n_chars in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        own = leaf(doc_id, source, lang, n_chars, text)
        seen = leaf(doc_id, source, lang, n_chars, fold(text) if text is not None else None) if tampered else own
        parts.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, seen, doc_id))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: climbed([x[2] for x in sorted(parts[name])]) for name in names}
    top = climbed([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for i, (_, _, own, seen, doc_id) in enumerate(sorted(parts[name])):
            path = beside(trees[name], i) + beside(top, place)
            for left, right in path:
                seen = sha(left + seen + right)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), seen, seen == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_is_the_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = [(r[0], r[1], random.Random(k).choice(["en", "en", "en", "é", None, "", *"abcdefghijk"]), r[3], r[4], *r[5:]) for k, r in enumerate(odd_rows(7, 600))]
    docs = spark.createDataFrame([*rows, rows[0], (0, "X" * 3_000_000, "en", "web", 1, "q", 1, "p", 7)], SCHEMA)
    got = merkle.manifest(spark, merkle.document_leaves(docs), levels)
    want = manifested([tuple(r)[:5] for r in docs.collect()])
    assert known(got.collect()) == known(want)
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame(odd_rows(8), SCHEMA)
    assert merkle.manifest(spark, merkle.document_leaves(docs.limit(0))).collect() == []
    one = merkle.manifest(spark, merkle.document_leaves(docs.limit(1))).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, similarity=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or a and b and 100 * len(a & b) >= similarity * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def family(seed: int, n: int, words: int, edits: int) -> list[str]:
    """n near copies of one text of so many words, each with its own changed words: pairs on both sides of the threshold."""
    r = random.Random(seed)
    base = [f"{r.choice(WORDS)}{r.randrange(900)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{k}x{r.randrange(99)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed, share, tile, dense", [(1, 4, 256, 4), (2, 1, 4, 0), (3, 64, 7, 1)])
def test_join_is_the_plain_one(spark, monkeypatch, seed, share, tile, dense):
    monkeypatch.setattr(ngram_join, "_met", lambda similarity, own=ngram_join._met: own(similarity, dense))
    monkeypatch.setattr(ngram_join, "SHARE", share)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = [r[:2] for r in odd_rows(seed, 120, 60)]
    rows += [(1000 + k, t) for k, t in enumerate(family(seed, 30, 120, 4) + family(seed + 9, 25, 300, 12) + family(seed + 20, 12, 21, 1))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, token string").repartition(3)
    got = ngram_join.similar_groups(spark, docs).select("doc_id", "n_shingles", "component_id").collect()
    want = components(rows)
    assert known(got) == known(want)
    assert len({w[2] for w in want[-67:]}) > 3


def test_join_of_nothing_and_of_a_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(spark, docs).collect() == []
    long = [f"w{i % 70001}" for i in range(500_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "other"])), (3, None), (4, "")]
    got = ngram_join.similar_groups(spark, spark.createDataFrame(rows, docs.schema)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_derived_overlaps_are_the_full_ones():
    r = np.random.default_rng(3)
    base = np.sort(r.choice(10**6, 400, replace=False)).astype(np.uint64)
    bags = []
    for _ in range(40):
        keep = base[r.random(400) > r.random() * 0.1]
        bags.append(np.unique(np.concatenate([keep, r.choice(10**6, int(r.integers(0, 40))).astype(np.uint64)])))
    bags += [np.unique(r.choice(10**6, 300)).astype(np.uint64) for _ in range(3)]
    i, j = np.nonzero(np.triu(np.ones((len(bags), len(bags)), bool), 1))
    want = [100 * len(np.intersect1d(bags[a], bags[b])) >= 90 * len(np.union1d(bags[a], bags[b])) for a, b in zip(i, j, strict=True)]
    assert ngram_join.derived(bags, i, j, 90).tolist() == want and 0 < sum(want) < len(want)


def test_parities_never_say_too_much():
    r = np.random.default_rng(9)
    base = np.unique(r.choice(1 << 40, 700).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > r.random() * 0.6], r.choice(1 << 40, int(r.integers(1, 90))).astype(np.uint64)])) for _ in range(30)] + [base[:1], base[:64]]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    maps = ngram_join.parities(np.concatenate(sets), off)
    i, j = np.nonzero(np.triu(np.ones((len(sets), len(sets)), bool), 1))
    truth = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    for k in (slice(0, 30), slice(None)):
        few = (i < len(maps[k])) & (j < len(maps[k]))
        bits = ngram_join.apart(ngram_join.folded(maps[k]), i[few], j[few])
        assert (bits <= truth[few]).all() and ((truth[few] - bits) % 2 == 0).all() and bits.max() > 20


def test_block_skipping_leaves_every_pair_that_its_bound_allows():
    r = np.random.default_rng(4)
    n = r.integers(8, 60, 80)
    pos = (r.random(80) * (n // 10 + 1)).astype(np.int64)
    got = {frozenset(x) for x in zip(*(x.tolist() for x in ngram_join.candidates(n, pos, 90)), strict=True)}
    want = set()
    for i in range(80):
        for j in range(i):
            o = ngram_join.needed(n[i], n[j], 90)
            if 100 * min(n[i], n[j]) >= 90 * max(n[i], n[j]) and min(n[i] - pos[i], n[j] - pos[j]) >= o:
                want.add(frozenset((i, j)))
    assert got == want


def test_join_equals_brute_force_on_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert known(Q.op13_ngram_join(spark, DATA).collect()) == known(components(rows))


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    quantiles, statuses = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, quantiles, statuses)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_counted_shingles_are_no_rows_of_a_shuffle(spark):
    r = random.Random(5)
    rows = [(k, " ".join(f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(2000))) for k in range(200)]
    rows += [(200 + k, " ".join(t.split()[:-2])) for k, (_, t) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled(spark)
    got = ngram_join.similar_groups(spark, docs).select("doc_id", "n_shingles", "component_id").collect()
    used = shuffled(spark) - before
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k % 200 for k, _ in rows}
    text = sum(len(t) for _, t in rows)
    assert used < 1.75 * text, (used, text, used / text)


def test_blocks_are_told_how_many_sets_hold_a_shingle():
    r = np.random.default_rng(6)
    tokens = np.unique(r.integers(0, 1 << 62, 500)).astype(np.uint64)
    blocks = [np.concatenate([r.choice(tokens, 60, replace=False) for _ in range(k)]) for k in (1, 3, 9)]
    asks = [b.to_pylist() for b in ngram_join._ask(62, 2)([pa.record_batch({"block": [0, 1, 2], "tokens": [b.tobytes() for b in blocks]})])]
    sent = pa.Table.from_pylist([row for part in asks for row in part])
    assert set(sent["bucket"].to_pylist()) == {0, 1, 2, 3}
    answers = pa.concat_tables(ngram_join._answer(sent.filter(pa.array(np.array(sent["bucket"]) == k))) for k in range(4)).to_pylist()
    whole = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(blocks), return_counts=True)), strict=True))
    for k, block in enumerate(blocks):
        own = sorted((x for x in answers if x["block"] == k), key=lambda x: x["bucket"])
        got = np.concatenate([unsqueeze(x["df"], np.uint32) for x in own])
        assert got.tolist() == [whole[t] for t in np.unique(block).tolist()]


def test_leading_shingles_are_the_rarest_and_singles_hold_a_place():
    off, tokens = np.array([0, 4, 4, 7]), np.array([1, 2, 3, 4, 2, 3, 9], np.uint64)
    df = np.array([1, 3, 2, 1, 3, 2, 1])
    got = ngram_join.leading(off, tokens, df, np.array([4, 1, 2]))
    assert [x.tolist() for x in got] == [[0, 0, 2], [3, 2, 3], [2, 3, 1]]
