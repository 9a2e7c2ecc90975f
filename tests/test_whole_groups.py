"""The kernel queries on groups beyond the sizes that were once their limits, against plain Python."""

import random

import numpy as np
import pytest

from canticle import catalogue
from canticle.operators import kernels as K
from tests.conftest import DATA

QUERIES = catalogue.queries()


def matched(hyp, ref):
    """The number of pairs on the cheapest path, cell by cell."""
    d = {(i, 0): float(i) for i in range(len(hyp) + 1)} | {(0, j): float(j) for j in range(len(ref) + 1)}
    c = lambda i, j: K.cost(hyp[i - 1], ref[j - 1])
    for i in range(1, len(hyp) + 1):
        for j in range(1, len(ref) + 1):
            d[i, j] = min(d[i - 1, j - 1] + c(i, j), d[i - 1, j] + 1, d[i, j - 1] + 1)
    i, j, out = len(hyp), len(ref), []
    while i and j:
        if d[i, j] == d[i - 1, j - 1] + c(i, j):
            i, j = i - 1, j - 1
            if c(i + 1, j + 1) <= 0.5:
                out.append((i, j))
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def common(old, new):
    """The pairs of a longest common subsequence, cell by cell; leaving an old word out comes first."""
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    pairs = []
    while i < n and j < m:
        if old[i] == new[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def viterbi(emission, target):
    """The best path state by state; the earlier option wins ties."""
    states = [0] + [x for t in target for x in (t, 0)]
    score = {0: [emission[0][states[0]], emission[0][states[1]]] + [-np.inf] * (len(states) - 2)}
    back = {}
    for f in range(1, len(emission)):
        score[f] = []
        for s in range(len(states)):
            options = [s, s - 1] + [s - 2] * (s > 1 and states[s] != 0 and states[s] != states[s - 2])
            by = max((o for o in options if o >= 0), key=lambda o: score[f - 1][o])
            back[f, s] = by
            score[f].append(score[f - 1][by] + emission[f][states[s]])
    last = score[len(emission) - 1]
    at = len(states) - 2 if last[-2] > last[-1] else len(states) - 1
    path = [at]
    for f in range(len(emission) - 1, 0, -1):
        path.append(at := back[f, at])
    return path[::-1]


@pytest.mark.parametrize("held", [1 << 26, 1])
def test_kernels_against_cell_by_cell(monkeypatch, held):
    monkeypatch.setattr(K, "HELD", held)
    r = random.Random(4)
    words = ["", "A", "AB", "ABC", "ABD", "XBD", "HELLO", "HELO", "HELLOS", "É" * 20, "É" * 31 + "A", "É" * 40, "AÉ" * 30]
    for n, m in [(0, 3), (3, 0), (1, 1), (1, 30), (30, 1), (7, 40), (40, 7), (35, 35)] * 3:
        hyp, ref = ([r.choice(words) for _ in range(k)] for k in (n, m))
        assert K.align(hyp, ref) == matched(hyp, ref)
        old = [(w, float(k), k + 0.5) for k, w in enumerate(hyp)]
        pairs = common(hyp, ref)
        times = K.retime(old, ref)
        assert len(times) == m
        top = 0.0
        for k in range(m):  # common words keep their times, behind the running maximum
            if k in (found := {y: x for x, y in pairs}):
                assert times[k][0] == max(top, float(found[k]))
            top = times[k][0]
    for t, target in [(1, [2]), (30, [1, 2, 2, 3, 1]), (50, [3] * 20), (40, [1, 2] * 10)]:
        e = np.array([[r.choice([0.0, 0.25, 1.0]) for _ in range(4)] for _ in range(t)])
        assert K.ctc_path(e, target) == viterbi(e.tolist(), target)


def test_turns_of_any_length_are_graded(spark, tmp_path):
    r = random.Random(5)
    turns = [" ".join(r.choice(["la", "li", "lala", "sun"]) for _ in range(n)) for n in (130, 150, 3)]
    spark.createDataFrame([(1, k, t) for k, t in enumerate([*turns, None])], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["id"]: tuple(x)[1:] for x in QUERIES["align_grade"](spark, str(tmp_path)).collect()}
    want = {}
    for k, (a, b) in enumerate(zip([t.upper().split() for t in turns], [*[t.upper().split() for t in turns[1:]], []], strict=True)):
        n = len(matched(a, b))
        want[f"1-{k}"] = (n, len(a) - n, len(b) - n)
    assert got == want


def test_all_vectors_of_a_label_are_aligned(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, k % 2, [r.choice([0.0, 0.5, 1.0]) for _ in range(8)]) for k in range(203)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(x) for x in QUERIES["ctc_align"](spark, str(tmp_path)).collect())
    want = []
    for label in (0, 1):
        e = [v for _, own, v in rows if own == label]
        path = viterbi(e, [4 * k % 7 + 1 for k in range(-(-len(e) // 4))])
        frames = {}
        for f, s in enumerate(path):
            if s % 2:
                frames.setdefault(s // 2, []).append(f)
        want += [(label, k, v[0], v[-1]) for k, v in frames.items()]
    assert got == want and max(x[3] for x in got) > 90


def test_songs_keep_their_tails(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").limit(450).selectExpr("event_id", "ts", "1L AS user_id", "event_type", "value", "props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    kept = e.where("event_type <> 'error'").count()
    assert kept > 201
    got = QUERIES["lcs_retime"](spark, str(tmp_path)).collect()
    assert sorted(x["word_idx"] for x in got) == list(range(kept + 1))
