import itertools
import json
import math

import numpy as np
from pyspark.sql import functions as F

from canticle.operators import kernels as K
from canticle.operators import signal as G
from canticle.operators import words as W


def test_align_matches_exact_and_fuzzy_words():
    assert K.align(["A", "HELLO", "B"], ["A", "HELO", "B"]) == [(0, 0), (1, 1), (2, 2)]
    assert K.align([], ["A"]) == []
    assert K.align(["", "A"], ["A"]) == [(1, 0)]


def test_ctc_path_is_the_best_of_all_paths():
    r = np.random.default_rng(1)
    e = r.normal(size=(5, 4))
    target = [1, 2, 2]
    states = [0, 1, 0, 2, 0, 2, 0]

    def legal(p):
        if p[0] > 1 or p[-1] < len(states) - 2:
            return False
        return all(b - a in (0, 1) or (b - a == 2 and states[b] != 0 and states[b] != states[a]) for a, b in itertools.pairwise(p))

    best = max((p for p in itertools.product(range(7), repeat=5) if legal(p)), key=lambda p: sum(e[t, states[s]] for t, s in enumerate(p)))
    assert tuple(K.ctc_path(e, target)) == best
    assert K.ctc_path(e[:3], target) is None and K.ctc_path(e, []) is None


def test_line_breaks_are_the_cheapest():
    r = np.random.default_rng(2)
    start = np.cumsum(r.uniform(0.2, 1.5, 9)).tolist()
    end = [s + x for s, x in zip(start, r.choice([0.05, 0.2], 9), strict=True)]
    phrase = [bool(x) for x in r.integers(0, 2, 9)]

    def cost(cuts):
        total = 0.0
        for a, b in itertools.pairwise([0, *cuts, 9]):
            total += 0.25 * math.log((b - a) / 7) ** 2 * (b - a) + 0.4 * math.log(max(0.2, end[b - 1] - start[a]) / 3) ** 2
            if b < 9:
                total -= 3 * math.sqrt(min(max(0.0, start[b] - end[b - 1]), 2)) + 0.8 * phrase[b - 1] - 2.5
        return total

    best = min(cost(c) for k in range(9) for c in itertools.combinations(range(1, 9), k))
    line = K.break_lines(start, end, phrase)
    assert abs(cost([i for i in range(1, 9) if line[i] != line[i - 1]]) - best) < 1e-9


def test_retime_keeps_common_words_and_never_goes_back():
    old = [("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)]
    assert K.retime(old, ["a", "x", "c"]) == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0)]
    out = K.retime(old, ["z", "a", "b", "c"])
    assert [s for s, _ in out] == sorted(s for s, _ in out)
    assert K.retime([], ["a"]) == [(0.0, 0.0)]
    old = [("a", 1.0, 1.5), ("b", 2.0, 3.0), ("c", 3.0, 3.5), ("d", 5.0, 6.0)]
    assert K.retime(old, ["a", "x", "d"]) == [(1.0, 1.5), (1.5, 1.5 + 0.8 * 3.5), (5.0, 6.0)]
    assert K.retime(old, ["d", "y"]) == [(5.0, 6.0), (6.0, 6.0)]
    assert K.retime(old, ["x", "y"]) == [(1.0, 3.0), (3.5, 5.5)]


def test_reflow_breaks():
    assert K.reflow([0, 1, 3.0], [0.5, 1.5, 3.5], ["a", "b", "c"]) == [0, 0, 1]
    assert K.reflow([0, 1, 2], [0.5, 1.5, 2.5], ["a.", "b", "c"]) == [0, 1, 1]
    assert K.reflow([float(i) for i in range(9)], [i + 0.5 for i in range(9)], ["w"] * 9)[-1] == 1


def test_plan_chunks_cuts_at_the_quietest_frame():
    levels = [5.0] * 100
    levels[25] = 1.0
    assert K.plan_chunks(levels, 20, 30)[0] == 25


def test_clock_snaps_and_drains():
    got = K.clock([1.0, 1.06, 1.16, 2.0, 2.05, 2.05], [1.0] * 4 + [0.0, 0.0], [5.0, 5.05, 5.17, 5.2, 5.3, 5.4])
    assert [s for _, s in got] == [True, False, False, True, True, False]
    # 0.01 ahead at 5.05 is kept back and drained in full 0.12 s later; then 0.01 behind.
    assert [round(x, 6) for x, _ in got] == [1.0, 1.05, 1.18, 2.0, 2.05, 2.05]
    assert K.clock([], [], []) == []


def test_look_ahead_takes_the_next_equal_word_within_four():
    assert K.look_ahead(list("abcd"), list("axbycz")) == [(0, 0), (1, 2), (2, 4)]
    assert K.look_ahead(["z"], list("aaaaz")) == []


def test_onsets_against_all_choices():
    level = [0, 5, 1, 6, 6, 1, 3, 9, 9.5, 0, 4, 0]
    assert K.onsets(level, 2, 1) == [1, 3, 8, 10]
    assert K.onsets(level, 2, 3) == [3, 8]
    assert K.onsets([], 1, 1) == [] and K.onsets([9.0], 1, 1) == []


def test_windows_are_padded_to_their_neighbours_and_split():
    start = [0.0, 1.0, 5.0, 6.0, 20.0]
    end = [0.8, 1.5, 5.5, 6.5, 21.0]
    assert K.windows([False, True, False, True, False], start, end) == [(1, 1, 0.8, 2.5), (3, 3, 5.5, 7.5)]
    assert K.windows([True] * 3, [0.0, 60.0, 120.0], [1.0, 61.0, 121.0]) == [(0, 1, 0.0, 62.0), (2, 2, 119.0, 122.0)]
    assert K.windows([], [], []) == []


def test_edits_keep_the_map_in_order():
    words = [{"word": w, "start": s, "end": e, "line": ln} for w, s, e, ln in (("a", 1.0, 1.5, 0), ("b", 2.0, 2.5, 0), ("c", 4.0, 5.0, 1))]
    op = lambda kind, first=0, last=0, start=None, end=None, text=None: dict(kind=kind, first=first, last=last, start=start, end=end, text=text)
    times = lambda ws: [(w["word"], round(w["start"], 6), round(w["end"], 6)) for w in ws]
    assert times(K.edited(words, 6.0, op("drag", 1, start=0.5, end=9.0))) == [("a", 1.0, 1.5), ("b", 1.0, 6.0), ("c", 4.0, 5.0)]
    assert K.edited(words, 6.0, op("drag", 1, start=2.0, end=2.5)) is None and K.edited(words, 6.0, op("delete", 3)) is None
    assert times(K.edited(words, 6.0, op("nudge", 0, 1, start=5.0))) == [("a", 3.0, 3.5), ("b", 4.0, 4.5), ("c", 4.0, 5.0)]
    assert times(K.edited(words, 6.0, op("nudge", 2, 2, start=3.0))) == [("a", 1.0, 1.5), ("b", 2.0, 2.5), ("c", 6.0, 6.0)]
    assert times(K.edited(words, 6.0, op("insert", 1, text="x y"))) == [("a", 1.0, 1.5), ("b", 2.0, 2.5), ("x", 2.875, 3.25), ("y", 3.25, 3.625), ("c", 4.0, 5.0)]
    assert times(K.edited(words, 6.0, op("insert", 1, start=2.2, text="x"))) == [("a", 1.0, 1.5), ("b", 2.0, 2.2), ("x", 2.2, 2.5), ("c", 4.0, 5.0)]
    assert times(K.edited(words, 6.0, op("insert", -1, text="x")))[0] == ("x", 0.25, 0.75)
    assert K.edited(words, 6.0, op("text", 0, text=" a ")) is None and K.edited([], 6.0, op("insert", -1, text="x")) is None
    end, changed = K.after_edits(words, 6.0, [op("undo"), op("delete", 0), op("text", 0, text="B"), op("undo"), op("undo"), op("redo")])
    assert [w["word"] for w in end] == ["b", "c"] and changed == 5
    # Undo goes back 200 states; a new edit drops what could be redone.
    many = [op("text", 0, text=str(k)) for k in range(250)] + [op("undo")] * 300
    assert K.after_edits(words, 6.0, many)[0][0]["word"] == "49"
    assert K.after_edits(words, 6.0, [op("text", 0, text="x"), op("undo"), op("text", 0, text="y"), op("redo")])[0][0]["word"] == "y"


def test_word_edits_over_groups(spark):
    w = spark.createDataFrame([(1, 0, "a", 1.0, 2.0, 0, 9.0), (1, 1, "b", 3.0, 4.0, None, 9.0), (2, 0, "c", 0.0, 1.0, None, 9.0)], "song_id long, word_idx int, word string, start double, end double, line long, duration double")
    e = spark.createDataFrame([(1, 1, "text", 0, 0, None, None, "z"), (1, 0, "delete", 0, None, None, None, None), (3, 0, "delete", 0, 0, None, None, None)], "song_id long, seq int, kind string, first int, last int, start double, end double, text string")
    got = sorted((r["song_id"], r["word_idx"], r["word"], r["line"], r["changed"]) for r in K.word_edits(w, e).collect())
    assert got == [(1, 0, "z", None, 2), (2, 0, "c", None, 0)]


def test_log_mel_against_sums():
    r = np.random.default_rng(4)
    x, size, hop, mels, rate = r.normal(size=40), 16, 8, 4, 16000
    filters = K.mel_filters(size, mels, rate)
    mirrored = [x[abs(t)] if t < 40 else x[78 - t] for t in range(-8, 48)]
    want = []
    for frame in range(5):
        part = [v * (0.5 - 0.5 * math.cos(2 * math.pi * n / size)) for n, v in enumerate(mirrored[frame * hop : frame * hop + size])]
        power = [sum(v * math.cos(2 * math.pi * k * n / size) for n, v in enumerate(part)) ** 2 + sum(v * math.sin(2 * math.pi * k * n / size) for n, v in enumerate(part)) ** 2 for k in range(9)]
        want.append([math.log10(max(1e-10, sum(f * p for f, p in zip(row, power, strict=True)))) for row in filters])
    want = (np.maximum(want, np.max(want) - 8) + 4) / 4
    assert np.allclose(K.log_mel(x, filters, size, hop), want)
    full = K.mel_filters(400, 80, 16000)
    assert full.shape == (80, 201) and (full >= 0).all() and (full.sum(axis=1) > 0).all()


def test_windows_end_with_the_song():
    start, end = [0.0, 8.0, 9.0], [1.0, 8.5, 9.8]
    assert K.windows([False, False, True], start, end, duration=10.0) == [(2, 2, 8.5, 10.0)]
    assert K.windows([False, False, True], start, end, duration=8.5) == []
    assert K.windows([False, True, False], [0.0, 5.0, 9.0], [7.0, 4.0, 9.5]) == [(1, 1, 5.0, 6.0)]


def test_silent_frames_hold_only_blanks_between_words():
    r = np.random.default_rng(7)
    bad = 0
    for _ in range(40):
        target = [int(x) for x in r.integers(1, 3, 3)]
        e = np.round(r.normal(size=(6, 3)) * 4) / 4
        silent = r.random(6) < 0.3
        states = [0] + [x for t in target for x in (t, 0)]
        free = [s % 2 == 0 and (s in (0, 6) or 2 in (states[s - 1], states[s + 1])) for s in range(7)]
        assert K.between_words(target, 2).tolist() == free
        total = {
            p: sum(e[t, states[s]] for t, s in enumerate(p))
            for p in itertools.product(range(7), repeat=6)
            if p[0] < 2 and p[-1] > 4 and all(b - a in (0, 1) or (b - a == 2 and b % 2 and states[b] != states[a]) for a, b in itertools.pairwise(p))
            and all(free[s] for s, q in zip(p, silent, strict=True) if q)
        }
        path = K.ctc_path(e, target, silent=silent, delim=2)
        assert (path is None) == (not total)
        bad += path is None
        if path:
            assert tuple(path) in total and abs(total[tuple(path)] - max(total.values())) < 1e-9
    assert 0 < bad < 40
    assert K.ctc_path(e, target, silent=np.zeros(2, bool), delim=2) == K.ctc_path(e, target)


def test_songs_without_a_path_around_silence_are_aligned_freely(spark):
    e = [[0.0, -1.0, -2.0]] * 4
    rows = spark.createDataFrame([(1, e, [1], [True] * 4), (2, e, [1], [True, False, True, True]), (3, e[:1], [1, 1], [False])], "song long, emission array<array<double>>, target array<int>, silent array<boolean>")
    got = sorted(tuple(x) for x in K.ctc_align_silent(rows, 2).collect())
    assert got[1:] == [(2, 0, 1, 1, False)] and got[0][0] == 1 and got[0][4]


def test_pairs_and_report_are_those_of_plain_python(spark):
    r = np.random.default_rng(3)
    words = ["LA", "LALA", "SUN", "MOON", "A", ""]
    rows = [(f"{s}-{k}", s, *(list(map(str, r.choice(words, n))) for n in r.integers(0, 12, 2))) for s in (1, 2, 3) for k in range(5)]
    t = spark.createDataFrame([*rows, ("4-0", 4, [], []), ("5-0", 5, ["SUN"], [])], "id string, song long, hyp array<string>, ref array<string>")
    pairs = K.align_pairs(t.drop("song"))
    want = []
    for i, _, hyp, ref in [*rows, ("5-0", 5, ["SUN"], [])]:
        got = K.align(hyp, ref)
        want += [(i, *p) for p in got]
        want += [(i, k, None) for k in range(len(hyp)) if k not in dict(got)] + [(i, None, k) for k in range(len(ref)) if k not in {q for _, q in got}]
    key = lambda x: tuple(-1 if c is None else c for c in x)
    assert sorted((tuple(x) for x in pairs.collect()), key=key) == sorted(want, key=key)
    song, ref = {x[0]: x[1] for x in rows} | {"5-0": 5}, {x[0]: x[3] for x in rows}
    aligned = pairs.join(t.select("id", "song", "ref"), "id").selectExpr("song", "hyp_idx", "ref_idx", "IF(hyp_idx IS NULL, NULL, (hyp_idx - ref_idx) * 0.04D) AS err", "length(get(ref, ref_idx)) = 1 AS freestyle")
    report = {x["song"]: x.asDict() for x in W.accuracy_report(aligned).collect()}
    assert set(report) == {1, 2, 3, 5, None}
    for s, x in report.items():
        own = [p for p in want if s in (None, song[p[0]])]
        both = [p for p in own if None not in p]
        err = [(i - j) * 0.04 for _, i, j in both]
        off = sorted(map(abs, err))
        counts = [sum(p[1] is not None for p in own), sum(p[2] is not None for p in own), len(both), sum(len(ref[p[0]][p[2]]) == 1 for p in both), sum(p[2] is None for p in own), sum(p[1] is None for p in own)]
        assert [x[c] for c in ("n_hyp", "n_ref", "matched", "freestyle_matched", "hyp_only", "ref_only")] == counts
        for c, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("worst", 1.0)):
            assert x[c] == (off[math.ceil(len(off) * p) - 1] if off else None)
        assert x["mean"] is None if not off else abs(x["mean"] - sum(err) / len(err)) < 1e-6
        assert json.loads(x["report"])["n_ref"] == counts[1]


def test_retyped_words_are_known_without_case_and_signs(spark):
    songs = spark.createDataFrame([(1, [("Don't", 1.0, 2.0), ("Élan!", 3.0, 4.0)], ["x", "DON'T,", "élan"])], "song_id long, old array<struct<word:string,start:double,end:double>>, new array<string>")
    assert [(x["start"], x["end"]) for x in K.lcs_retime(songs).orderBy("word_idx").collect()] == [(1.0, 1.0), (1.0, 2.0), (3.0, 4.0)]


def test_shifted_passes_against_loops(spark):
    r = np.random.default_rng(9)
    songs = {1: r.normal(size=3), 2: r.normal(size=17), 3: np.full(5, 2.0), 4: r.normal(size=1)}
    rows = spark.createDataFrame([(s, j, float(v)) for s, x in songs.items() for j, v in enumerate(x)], "song int, j long, v double")
    delays = G.leads(2, 5)
    assert delays == [4, 2] and G.leads(0, 5) == [0]
    got = {(x["song"], x["j"]): x["v"] for x in G.shifted_passes(rows, 8, 6, delays, lambda x: F.zip_with(x, F.reverse(x), lambda a, b: a - b / 2)).collect()}
    want = {}
    for s, x in songs.items():
        std = float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
        std, mean = std if std > 0 else 1.0, float(np.mean(x))
        for lead in delays:
            late = np.concatenate([np.zeros(lead), (x - mean) / std])
            top, below = np.zeros(len(late)), np.zeros(len(late))
            for o in range(0, len(late), 6):
                kept = min(8, len(late) - o)
                start = o - (8 - kept) // 2
                seen = np.array([late[k] if 0 <= k < len(late) else 0.0 for k in range(start, start + 8)])
                made = seen - seen[::-1] / 2
                for i in range(kept):
                    w = min(i + 1, 8 - i)
                    top[o + i] += w * made[o - start + i]
                    below[o + i] += w
            for j in range(len(x)):
                want[s, j] = want.get((s, j), 0.0) + (top / below)[lead + j] / len(delays)
        for j in range(len(x)):
            want[s, j] = want[s, j] * std + mean
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
