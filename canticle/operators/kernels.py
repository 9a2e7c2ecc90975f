"""Sequential kernels: dynamic programs and recurrences over one song at a time (SURVEY K).

Each is a grouped map: Spark deals songs to tasks and a group is one song's words.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.functions.text import ui_norm

GAP, MISMATCH, PLAUSIBLE = 1.0, 1.5, 0.5
#: Bytes of decisions that a dynamic program holds at once.
HELD = 1 << 26
#: Letters of words that are compared as arrays; longer ones are compared one by one.
SHORT = 32
#: Cells of pairs of texts that are aligned in one walk.
TOGETHER = 1 << 20


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def cost(a: str, b: str) -> float:
    """The edit ratio where it is plausible, the mismatch otherwise; empty words never match."""
    if not a or not b:
        return MISMATCH
    ratio = levenshtein(a, b) / max(len(a), len(b))
    return ratio if ratio <= PLAUSIBLE else MISMATCH


def backwards(state, steps: int, step, width: int):
    """The last state of a recurrence, and an iterator over the decisions of its steps, the last step first.

    step(state, k) gives the next state and decisions of about `width` bytes.  Where all decisions would
    take over HELD bytes, about sqrt(steps) states are kept and the steps between them worked out again.
    """
    size = steps if steps * width <= HELD else math.isqrt(steps) + 1
    kept, rows = [], []
    for k in range(steps):
        if k % size == 0:
            kept.append(state)
            rows = []
        state, decisions = step(state, k)
        if k >= (steps - 1) // size * size:
            rows.append(decisions)

    def back():
        yield from reversed(rows)
        for block in range(len(kept) - 2, -1, -1):
            s, again = kept[block], []
            for k in range(block * size, (block + 1) * size):
                s, decisions = step(s, k)
                again.append(decisions)
            yield from reversed(again)

    return state, back()


def short_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of all words of a to all of b, each of 1 to SHORT letters."""
    x, y = (np.array(w).view(np.uint32).reshape(len(w), -1) for w in (a, b))
    size, ends = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    place = np.arange(y.shape[1] + 1, dtype=np.int8)[:, None, None]
    row = np.broadcast_to(place, (len(place), len(a), len(b)))
    out = np.zeros((len(a), len(b)), np.int8)
    for i in range(1, x.shape[1] + 1):
        new = row + np.int8(1)
        new[1:] = np.minimum(new[1:], row[:-1] + (x[None, :, i - 1, None] != y.T[:, None, :]))
        row = np.minimum.accumulate(new - place, axis=0) + place
        done = np.flatnonzero(size == i)
        out[done] = row[ends[None, :], done[:, None], np.arange(len(b))[None, :]]
    return out


def costs(hyp: list[str], ref: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cost of each pair of distinct words, and the place of each word of hyp and ref in it."""
    at, to = ({w: k for k, w in enumerate(dict.fromkeys(x))} for x in (hyp, ref))
    c = np.full((len(at), len(to)), MISMATCH)
    a, b = ([w for w in x if 0 < len(w) <= SHORT] for x in (at, to))
    rows, columns = (np.array([x[w] for w in words], int) for x, words in ((at, a), (to, b)))
    some = max(1, HELD // (16 * SHORT * max(1, len(b))))
    for k in range(0, len(a) if b else 0, some):
        ratio = short_distances(a[k : k + some], b) / np.maximum.outer([len(w) for w in a[k : k + some]], [len(w) for w in b])
        c[np.ix_(rows[k : k + some], columns)] = np.where(ratio <= PLAUSIBLE, ratio, MISMATCH)
    for x, i in at.items():
        for y, j in to.items() if len(x) > SHORT else ():
            c[i, j] = cost(x, y) if 2 * len(y) >= len(x) >= len(y) / 2 else MISMATCH
    for y, j in to.items():
        for x, i in at.items() if len(y) > SHORT else ():
            c[i, j] = cost(x, y) if len(x) <= SHORT and 2 * len(x) >= len(y) else c[i, j]
    return c, np.array([at[x] for x in hyp], int), np.array([to[y] for y in ref], int)


def align(hyp: list[str], ref: list[str]) -> list[tuple[int, int]]:
    """Pairs matched by the cheapest global alignment; ties prefer the diagonal, then skipping hyp, then ref.

    Worked out by anti-diagonals i + j = k, as arrays over i.
    """
    n, m = len(hyp), len(ref)
    if not n or not m:
        return []
    c, at, to = costs(hyp, ref)

    def step(state, s):
        k = s + 1
        before, last = state
        d = np.empty(n + 1)
        if k <= m:
            d[0] = k * GAP
        if k <= n:
            d[k] = k * GAP
        lo, hi = max(1, k - m), min(n, k - 1) + 1
        i = np.arange(lo, hi)
        diagonal, up, left = before[lo - 1 : hi - 1] + c[at[i - 1], to[k - i - 1]], last[lo - 1 : hi - 1] + GAP, last[lo:hi] + GAP
        best = np.minimum(np.minimum(diagonal, up), left)
        d[lo:hi] = best
        return (last, d), np.where(best == diagonal, 0, np.where(best == up, 1, 2)).astype(np.int8)

    _, moves = backwards((np.zeros(n + 1), np.zeros(n + 1)), n + m, step, min(n, m))
    out, i, j = [], n, m
    for k, move in zip(range(n + m, 0, -1), moves):
        if not i or not j:
            break
        if i + j < k:
            continue
        go = move[i - max(1, k - m)]
        if go == 0:
            i, j = i - 1, j - 1
            if c[at[i], to[j]] <= PLAUSIBLE:
                out.append((i, j))
        elif go == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def pair_distances(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of words[a[k]] to words[b[k]], each of 1 to SHORT letters; pairs of equal lengths go together."""
    size = np.array([len(w) for w in words])
    letters = np.array(words).view(np.uint32).reshape(len(words), -1)
    out = np.zeros(len(a), np.int8)
    order = np.argsort(kind := size[a] * (SHORT + 1) + size[b], kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else ():
        n, m = int(size[a[some[0]]]), int(size[b[some[0]]])
        x, y = np.ascontiguousarray(letters[a[some], :n].T), np.ascontiguousarray(letters[b[some], :m].T)
        row = [np.full(len(some), j, np.int8) for j in range(m + 1)]
        for i in range(n):
            new = [row[0] + np.int8(1)]
            for j in range(m):
                new.append(np.minimum(np.minimum(row[j + 1], new[j]) + np.int8(1), row[j] + (x[i] != y[j])))
            row = new
        out[some] = row[m]
    return out


def letter_sets(words: list[str]) -> np.ndarray:
    """Which of 32 classes of letters each word has at least once (low bits) and at least twice (high bits)."""
    out = np.zeros(len(words), np.uint64)
    for k, w in enumerate(words):
        once = twice = 0
        for x in w:
            bit = 1 << (ord(x) & 31)
            twice |= once & bit
            once |= bit
        out[k] = once | twice << 32
    return out


def cost_matrices(pairs: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """The cost of each word of hyp to each of ref, a matrix a pair of texts; equal pairs of words are compared once."""
    at: dict[str, int] = {}
    sides = [[np.array([at.setdefault(w, len(at)) for w in x]) for x in p] for p in pairs]
    words, codes, spots = list(at), [], []
    for x, y in sides:
        (u, i), (v, j) = (np.unique(z, return_inverse=True) for z in (x, y))
        codes.append((u[:, None] * len(words) + v[None, :]).ravel())
        spots.append((i, j, len(v)))
    every, place = np.unique(np.concatenate(codes), return_inverse=True)
    a, b = every // len(words), every % len(words)
    size = np.array([len(w) for w in words])
    least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    near = (least > 0) & (2 * least >= most)  # words further apart in length are never plausible
    # A letter of one word that the other lacks is an edit, so most pairs are settled without their distance.
    has = letter_sets(words)
    lacks = np.maximum(np.bitwise_count(has[a] & ~has[b]), np.bitwise_count(has[b] & ~has[a]))
    near &= lacks <= PLAUSIBLE * most
    short = np.flatnonzero(near & (most <= SHORT))
    c = np.full(len(every), MISMATCH)
    ratio = pair_distances([w[:SHORT] for w in words], a[short], b[short]) / most[short]
    c[short] = np.where(ratio <= PLAUSIBLE, ratio, MISMATCH)
    for k in np.flatnonzero(near & (most > SHORT)):
        c[k] = cost(words[a[k]], words[b[k]])
    ends = np.cumsum([len(x) for x in codes])
    return [c[place[end - len(x) : end]].reshape(-1, w)[np.ix_(i, j)] for x, end, (i, j, w) in zip(codes, ends, spots)]


def align_together(matrices: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """`align` of several pairs of texts, by the costs of their words (none empty), in one walk over the anti-diagonals of all."""
    size = np.array([m.shape for m in matrices])
    n, m = size[:, 0].max(), max(2, size[:, 1].max())
    c = np.full((len(matrices), n, m), MISMATCH)
    for k, x in enumerate(matrices):
        c[k, : x.shape[0], : x.shape[1]] = x
    flat = c.reshape(len(c), n * m)
    moves = np.zeros((n + m + 1, len(c), n + 1), np.int8)
    before, last = np.zeros((len(c), n + 1)), np.zeros((len(c), n + 1))
    for k in range(1, n + m + 1):
        d = np.empty_like(last)
        if k <= m:
            d[:, 0] = k * GAP
        if k <= n:
            d[:, k] = k * GAP
        lo, hi = max(1, k - m), min(n, k - 1) + 1
        if lo < hi:
            first = (lo - 1) * m + k - lo - 1
            diagonal = before[:, lo - 1 : hi - 1] + flat[:, first : first + (hi - lo - 1) * (m - 1) + 1 : m - 1]
            up, left = last[:, lo - 1 : hi - 1] + GAP, last[:, lo:hi] + GAP
            best = np.minimum(np.minimum(diagonal, up), left)
            d[:, lo:hi] = best
            moves[k, :, lo:hi] = np.where(best == diagonal, 0, np.where(best == up, 1, 2))
        before, last = last, d
    i, j = size.T.copy()
    out, live = [[] for _ in c], np.arange(len(c))
    while len(live := live[(i[live] > 0) & (j[live] > 0)]):
        go = moves[i[live] + j[live], live, i[live]]
        i[live] -= go != 2
        j[live] -= go != 1
        met = live[go == 0]
        met = met[c[met, i[met], j[met]] <= PLAUSIBLE]
        for k, x, y in zip(met.tolist(), i[met].tolist(), j[met].tolist()):
            out[k].append((x, y))
    return [x[::-1] for x in out]


def align_all(pairs: list[tuple[list[str], list[str]]]) -> list[list[tuple[int, int]]]:
    """`align` of each pair of texts: words are compared for many pairs at once, and pairs of like sizes are walked together.

    A pair of more than TOGETHER cells goes alone, with decisions worked out again in blocks.
    """
    cells = [len(a) * len(b) for a, b in pairs]
    out = [align(*p) if n > TOGETHER else [] for p, n in zip(pairs, cells)]
    some, held = [], 0
    for k, n in enumerate(cells):
        if 0 < n <= TOGETHER:
            some.append(k)
            held += n
        if some and (held > 4 * TOGETHER or k + 1 == len(pairs)):
            matrices = dict(zip(some, cost_matrices([pairs[x] for x in some])))
            for group in like_sizes({x: m.shape for x, m in matrices.items()}):
                for x, got in zip(group, align_together([matrices[x] for x in group])):
                    out[x] = got
            some, held = [], 0
    return out


def like_sizes(shapes: dict[int, tuple[int, int]]) -> list[list[int]]:
    """Groups of at most TOGETHER cells, of which at least a third are the pairs' own and the rest fill them up to one size."""
    out, n, m, used = [], 0, 0, 0
    for k, (a, b) in sorted(shapes.items(), key=lambda x: (x[1][0].bit_length(), x[1][1])):
        wide, high, size = max(n, a), max(m, b), len(out[-1]) + 1 if out else 1
        if not out or size * wide * max(wide, high) > TOGETHER or size * wide * high > 3 * (used + a * b):
            out.append([])
            wide, high, used = a, b, 0
        out[-1].append(k)
        n, m, used = wide, high, used + a * b
    return out


def aligned_frames(pdf: pd.DataFrame, rows, columns: list[str]):
    """Frames of what `rows` tells of each pair and its alignment, for some hundred pairs at a time."""
    for k in range(0, len(pdf), 512):
        part = pdf.iloc[k : k + 512]
        pairs = [(list(a), list(b)) for a, b in zip(part["hyp"], part["ref"])]
        out = [x for i, p, got in zip(part["id"], pairs, align_all(pairs)) for x in rows(i, *p, got)]
        yield pd.DataFrame(out, columns=columns)


def align_grade(pairs: DataFrame) -> DataFrame:
    """id, matched, hyp_only, ref_only; pairs: id, hyp and ref (arrays of words)."""

    def rows(i, hyp, ref, got):
        return [(i, len(got), len(hyp) - len(got), len(ref) - len(got))]

    def run(batches):
        for pdf in batches:
            yield from aligned_frames(pdf, rows, ["id", "matched", "hyp_only", "ref_only"])

    return pairs.mapInPandas(run, "id string, matched long, hyp_only long, ref_only long")


def align_pairs(pairs: DataFrame) -> DataFrame:
    """id, hyp_idx and ref_idx: a row for each matched pair, and one for each word of either side that has no partner.

    pairs: id, hyp and ref (arrays of words).  Decisions are worked out again in blocks where they would take over
    HELD bytes, so a long pair of texts takes longer, not more memory.
    """

    def rows(i, hyp, ref, got):
        left, right = ({p[k] for p in got} for k in (0, 1))
        yield from ((i, a, b) for a, b in got)
        yield from ((i, a, None) for a in range(len(hyp)) if a not in left)
        yield from ((i, None, b) for b in range(len(ref)) if b not in right)

    def run(batches):
        for pdf in batches:
            for out in aligned_frames(pdf, rows, ["id", "hyp_idx", "ref_idx"]):
                yield out.astype({"hyp_idx": "Int32", "ref_idx": "Int32"})

    return pairs.mapInPandas(run, "id string, hyp_idx int, ref_idx int")


def between_words(target: list[int], delim: int) -> np.ndarray:
    """Which of the 2N + 1 states are blanks between words: the outer two and those beside a token that parts words."""
    parts = np.array([True] + [t == delim for t in target] + [True])
    out = np.zeros(2 * len(target) + 1, bool)
    out[::2] = parts[:-1] | parts[1:]
    out[[0, -1]] = True
    return out


def ctc_path(emission: np.ndarray, target: list[int], blank: int = 0, silent: np.ndarray | None = None, delim: int | None = None) -> list[int] | None:
    """The state of each frame on the best path over 2N + 1 states; None where there is none.

    Stay, advance one, or skip a blank between different tokens; the earlier option wins ties.  A silent frame
    (silent: a flag a frame; those beyond its end are not) may be spent only in a blank between words.
    """
    states = [blank] + [x for t in target for x in (t, blank)]
    t, s = len(emission), len(states)
    if not target or t < len(target) + sum(a == b for a, b in zip(target, target[1:])):
        return None
    skip = np.array([k > 1 and states[k] != blank and states[k] != states[k - 2] for k in range(s)])
    score = np.full(s, -np.inf)
    score[:2] = emission[0, states[0]], emission[0, states[1]]
    quiet = np.zeros(t, bool)
    if silent is not None:
        quiet[: len(silent)] = silent[:t]
    barred = ~between_words(target, delim)
    if quiet[0]:
        score[barred] = -np.inf

    def step(score, k):
        one = np.concatenate([[-np.inf], score[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], score[:-2]])[:s], -np.inf)
        best, move = score.copy(), np.zeros(s, np.int8)
        for by, option in ((1, one), (2, two)):
            better = option > best
            best[better], move[better] = option[better], by
        best = best + emission[k + 1, states]
        if quiet[k + 1]:
            best[barred] = -np.inf
        return best, move

    score, moves = backwards(score, t - 1, step, s)
    at = s - 2 if score[s - 2] > score[s - 1] else s - 1
    if score[at] == -np.inf:
        return None
    path = [at]
    for move in moves:
        at -= int(move[at])
        path.append(at)
    return path[::-1]


def ctc_align(rows: DataFrame) -> DataFrame:
    """song, token_no, first, last: the frames of each target token; rows: song, emission, target."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            path = ctc_path(np.array(r.emission.tolist(), np.float64), [int(x) for x in r.target])
            frames: dict[int, list[int]] = {}
            for f, state in enumerate(path or []):
                if state % 2:
                    frames.setdefault(state // 2, []).append(f)
            out += [(r.song, k, v[0], v[-1]) for k, v in frames.items()]
        return pd.DataFrame(out, columns=["song", "token_no", "first", "last"])

    return rows.mapInPandas(lambda it: map(run, it), "song long, token_no int, first int, last int")


def ctc_align_silent(rows: DataFrame, delim: int) -> DataFrame:
    """song, token_no, first, last and free; rows: song, emission, target and silent (a flag a frame).

    No token lies in a silent frame and no word spans one; a song that has no such path is aligned without regard to
    silence, and free says so.  A song without any path has no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            emission, target = np.array(r.emission.tolist(), np.float64), [int(x) for x in r.target]
            path = ctc_path(emission, target, silent=np.asarray(r.silent, bool), delim=delim)
            free = path is None
            path = np.array(ctc_path(emission, target) or [] if free else path, int)
            token = path[path % 2 == 1] // 2
            frame = np.flatnonzero(path % 2 == 1)
            edges = np.flatnonzero(np.diff(token, prepend=-1))
            lasts = frame[np.append(edges[1:], len(frame)) - 1] if len(frame) else frame
            out.append(pd.DataFrame({"song": r.song, "token_no": token[edges], "first": frame[edges], "last": lasts, "free": free}))
        return pd.concat(out) if out else pd.DataFrame(columns=["song", "token_no", "first", "last", "free"])

    return rows.mapInPandas(lambda it: map(run, it), "song long, token_no int, first int, last int, free boolean")


IDEAL, LONGEST = 7, 24
#: Seconds that a line counts as at least.
SHORTEST = 0.2


def break_lines(start: list[float], end: list[float], ends_phrase: list[bool]) -> list[int]:
    """The line of each word: least total cost over all breaks, the earliest among equals.

    A line of k words and s seconds costs 0.25 ln(k/7)^2 k + 0.4 ln(s/3)^2; a break before a pause g
    earns 3 sqrt(min(g, 2)) + 0.8 behind punctuation - 2.5.
    """
    n = len(start)
    best, prev = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST), j):
            k, span = j - i, max(SHORTEST, end[j - 1] - start[i])
            c = best[i] + 0.25 * math.log(k / IDEAL) ** 2 * k + 0.4 * math.log(span / 3) ** 2
            if j < n:
                c -= 3 * math.sqrt(min(max(0.0, start[j] - end[j - 1]), 2)) + 0.8 * ends_phrase[j - 1] - 2.5
            if c < best[j]:
                best[j], prev[j] = c, i
    line, j, cuts = [0] * n, n, []
    while j:
        cuts.append((prev[j], j))
        j = prev[j]
    for k, (a, b) in enumerate(reversed(cuts)):
        line[a:b] = [k] * (b - a)
    return line


def line_breaks(words: DataFrame) -> DataFrame:
    """song_id, word_idx, line_no; words: song_id, word_idx, start, end, word; a word that ends in . ? or ! ends a phrase."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        line = break_lines(pdf["start"].tolist(), pdf["end"].tolist(), [w.rstrip()[-1:] in (".", "?", "!") for w in pdf["word"]])
        return pd.DataFrame({"song_id": pdf["song_id"], "word_idx": pdf["word_idx"], "line_no": line})

    return words.groupBy("song_id").applyInPandas(run, "song_id long, word_idx int, line_no int")


def look_ahead(old: list[str], new: list[str], window: int = 4) -> list[tuple[int, int]]:
    """Pairs of equal words in order: each old word takes the first equal new one among the next `window`."""
    out, at = [], 0
    for i, w in enumerate(old):
        j = next((k for k in range(at, min(at + window, len(new))) if new[k] == w), None)
        if j is not None:
            out.append((i, j))
            at = j + 1
    return out


def greedy_match(pairs: DataFrame) -> DataFrame:
    """id, i and j of each pair that the look-ahead finds; pairs: id, hyp and ref (arrays of words)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(r.id, i, j) for r in pdf.itertuples() for i, j in look_ahead(list(r.hyp), list(r.ref))]
        return pd.DataFrame(out, columns=["id", "i", "j"])

    return pairs.mapInPandas(lambda it: map(run, it), "id string, i int, j int")


def reflow(start: list[float], end: list[float], text: list[str], gap: float = 0.8) -> list[int]:
    """A new line after a gap, a full stop, a comma after four words, or eight words."""
    line, count, out = 0, 0, []
    for i in range(len(start)):
        last = text[i - 1][-1:] if i else ""
        if i and (start[i] - end[i - 1] > gap or last in ".!?" and last or last == "," and count >= 4 or count >= 8):
            line, count = line + 1, 0
        out.append(line)
        count += 1
    return out


def reflow_lines(words: DataFrame, gap: float) -> DataFrame:
    """song_id, word_idx, line_no by reflow; words: song_id, word_idx, start, end, word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        return pd.DataFrame({"song_id": pdf["song_id"], "word_idx": pdf["word_idx"], "line_no": reflow(pdf["start"].tolist(), pdf["end"].tolist(), pdf["word"].tolist(), gap)})

    return words.groupBy("song_id").applyInPandas(run, "song_id long, word_idx int, line_no int")


def kept_words(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence; leaving an old word out comes first."""
    n, m = len(old), len(new)
    code: dict[str, int] = {}
    was, now = (np.array([code.setdefault(x, len(code)) for x in words], int) for words in (old, new))

    def step(below, k):
        """Lengths from old word n - 1 - k on, by new word, and where leaving that old word out is as good."""
        row = np.where(now == was[n - 1 - k], below[1:] + 1, below[:-1])
        row = np.append(np.maximum.accumulate(row[::-1])[::-1], 0)
        return row, np.packbits(below[:-1] >= row[1:])

    _, rows = backwards(np.zeros(m + 1, np.int32), n, step, m // 8 + 1)
    pairs, j = [], 0
    for i, packed in enumerate(rows):
        leave = np.unpackbits(packed, count=m)
        while j < m and was[i] != now[j] and not leave[j]:
            j += 1
        if j < m and was[i] == now[j]:
            pairs.append((i, j))
            j += 1
    return pairs


def retime(old: list[tuple[str, float, float]], new: list[str]) -> list[tuple[float, float]]:
    """Times of typed words: equal words keep theirs (a longest common subsequence), equal runs go one to
    one, other runs share the span between the kept words around them (at the ends, the old text's), 80 per cent
    of each share voiced; onsets never go back."""
    n, m = len(old), len(new)
    pairs = kept_words([w[0] for w in old], new)
    out: list[tuple[float, float]] = [(0.0, 0.0)] * m
    a = b = 0
    for x, y in [*pairs, (n, m)]:
        if y > b:
            if x - a == y - b:
                out[b:y] = [old[a + k][1:] for k in range(y - b)]
            else:
                left = old[a - 1][2] if a else old[0][1] if n else 0.0
                right = old[x][1] if x < n else max(old[-1][1:]) if n else left
                share = max(0.0, right - left) / (y - b)
                out[b:y] = [(left + k * share, left + (k + 0.8) * share) for k in range(y - b)]
        if y < m:
            out[y] = old[x][1:]
        a, b = x + 1, y + 1
    top = 0.0
    for k, (s, e) in enumerate(out):
        top = max(top, s)
        out[k] = (top, max(top, e))
    return out


def lcs_retime(songs: DataFrame) -> DataFrame:
    """song_id, word_idx, start, end; songs: song_id, old (array of word, start, end), new (array of words).

    Words are equal where they are without case, punctuation and signs.
    """
    same = F.transform("old", lambda w: F.struct(ui_norm(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    songs = songs.select("song_id", same.alias("old"), F.transform("new", ui_norm).alias("new"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            times = retime([(w["word"], w["start"], w["end"]) for w in r.old], list(r.new))
            out += [(r.song_id, k, s, e) for k, (s, e) in enumerate(times)]
        return pd.DataFrame(out, columns=["song_id", "word_idx", "start", "end"])

    return songs.mapInPandas(lambda it: map(run, it), "song_id long, word_idx int, start double, end double")


def line_times(songs: DataFrame) -> DataFrame:
    """song_id, row_no and at: where each row of a typed text begins; songs: song_id, old (array of word, start, end), rows (array of lines).

    A row begins with its first word that is kept of the old ones; rows without one, blank ones among them, have null.
    """
    tokens = lambda r: F.filter(F.split(r, r"\s+"), lambda w: w != "")
    same = F.transform("old", lambda w: F.struct(ui_norm(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    songs = songs.select("song_id", same.alias("old"), F.transform("rows", lambda r: F.transform(tokens(r), ui_norm)).alias("rows"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            rows = [list(x) for x in r.rows]
            old, new = [(w["word"], w["start"], w["end"]) for w in r.old], [w for x in rows for w in x]
            times, kept, at = retime(old, new), {j for _, j in kept_words([w[0] for w in old], new)}, 0
            for k, x in enumerate(rows):
                out.append((r.song_id, k, next((times[j][0] for j in range(at, at + len(x)) if j in kept), None)))
                at += len(x)
        return pd.DataFrame(out, columns=["song_id", "row_no", "at"])

    return songs.mapInPandas(lambda it: map(run, it), "song_id long, row_no int, at double")


def plan_chunks(levels: list[float], least: int, most: int) -> list[int]:
    """Cut positions: each chunk ends at its quietest frame between `least` and `most` frames on."""
    cuts, at = [], 0
    while len(levels) - at > most:
        window = levels[at + least : at + most]
        at += least + int(np.argmin(window))
        cuts.append(at)
    return cuts


SNAP_S, DRAIN_S = 0.25, 0.12


def clock(pos: list[float], rate: list[float], now: list[float]) -> list[tuple[float, bool]]:
    """The position shown when each report (pos, rate, now in seconds) has been taken in, and whether it snapped to it.

    The first report, one of another rate and one off by more than SNAP_S snap.  A smaller error is kept back and
    drains evenly over DRAIN_S, so the position shown stays continuous.
    """
    out: list[tuple[float, bool]] = []
    base, at, pace, pending = 0.0, 0.0, 0.0, 0.0
    for k, (p, r, t) in enumerate(zip(pos, rate, now, strict=True)):
        gone = max(0.0, t - at)
        shown = max(0.0, base + gone * pace + pending * min(1.0, gone / DRAIN_S))
        snapped = k == 0 or r != pace or abs(p - shown) > SNAP_S
        base, pending = (p, 0.0) if snapped else (shown, p - shown)
        at, pace = t, r
        out.append((base, snapped))
    return out


def onsets(level: list[float], least: float, apart: int) -> list[int]:
    """Local maxima of `least` or more, `apart` frames from each other at least: of two too near the larger stays, the earlier of equals."""
    out: list[int] = []
    for k in range(1, len(level) - 1):
        if level[k] < least or level[k] <= level[k - 1] or level[k] < level[k + 1]:
            continue
        if out and k - out[-1] < apart:
            if level[k] > level[out[-1]]:
                out[-1] = k
        else:
            out.append(k)
    return out


def windows(changed: list[bool], start: list[float], end: list[float], pad: float = 1.0, most: float = 100.0, duration: float = math.inf) -> list[tuple[int, int, float, float]]:
    """first, last, from and to of each stretch to align again: runs of changed words, padded up to their neighbours, split where too long.

    Padding stays inside the song; a stretch without length, as behind the song's end, is left out.
    """
    out, k, n = [], 0, len(changed)
    while k < n:
        if not changed[k]:
            k += 1
            continue
        first = k
        while k < n and changed[k]:
            k += 1
        a = first
        while a < k:
            b = a
            while b + 1 < k and end[b + 1] - start[a] + 2 * pad <= most:
                b += 1
            voiced = max(end[b], start[a])
            low = max(0.0, start[a] - pad)
            if a:
                low = min(max(low, end[a - 1], start[a - 1]), start[a])
            high = min(voiced + pad, duration)
            if b + 1 < n:
                high = max(min(high, start[b + 1]), voiced)
            if high > low:
                out.append((a, b, low, high))
            a = b + 1
    return out


#: Seconds below which a move is none, that an inserted word lasts, and states that undo goes back.
STILL_S, INSERTED_S, UNDO = 1e-6, 0.3, 200


def placed(words: list[dict], duration: float, i: int, start: float, end: float) -> tuple[float, float]:
    """start and end of word i kept between its neighbours' onsets and inside the song."""
    low = words[i - 1]["start"] if i else 0.0
    high = words[i + 1]["start"] if i + 1 < len(words) else duration
    s = min(max(start, low, 0.0), high, duration)
    return s, min(max(end, s), duration)


def slot(words: list[dict], duration: float, after: int, at: float | None, count: int) -> tuple[float, float]:
    """The span of `count` words put in behind word `after`: from `at` on, else the middle half of the gap, else the next onset."""
    low = words[after]["start"] if after >= 0 else 0.0
    high = words[after + 1]["start"] if after + 1 < len(words) else duration
    if at is not None:
        s = min(max(at, low, 0.0), high, duration)
        return s, max(s, min(s + INSERTED_S * count, high, duration))
    left = max(words[after]["end"], low) if after >= 0 else 0.0
    gap = max(high, left) - left
    if gap > 0.06:
        return left + gap / 4, left + gap * 3 / 4
    s = min(high, duration)
    return s, min(s + 0.12, duration)


def edited(words: list[dict], duration: float, op: dict) -> list[dict] | None:
    """The words (word, start, end, line) after one edit, or None where it changes nothing.

    op: kind, first, last, start, end, text.  drag sets the times of word `first`; nudge moves first to last by `start`
    seconds as one; text and delete concern word `first`; insert puts the words of text behind word `first` (-1: in front).
    """
    kind, i, j = op["kind"], op["first"], op["last"]
    if kind == "insert":
        tokens = (op["text"] or "").split()
        if not tokens or not words or not -1 <= i < len(words):
            return None
        s, e = slot(words, duration, i, op["start"], len(tokens))
        step = (e - s) / len(tokens)
        near = [words[k]["line"] for k in (i, i + 1) if 0 <= k < len(words) and words[k]["line"] is not None]
        new = [{"word": w, "start": s + step * k, "end": e if k == len(tokens) - 1 else s + step * (k + 1), "line": near[0] if near else None} for k, w in enumerate(tokens)]
        out = [dict(w) for w in words]
        if i >= 0 and out[i]["end"] > s:
            out[i]["end"] = max(out[i]["start"], s)
        return out[: i + 1] + new + out[i + 1 :]
    if not 0 <= i < len(words):
        return None
    out = [dict(w) for w in words]
    if kind == "delete":
        return out[:i] + out[i + 1 :]
    if kind == "text":
        text = (op["text"] or "").strip()
        out[i]["word"] = text
        return out if text and text != words[i]["word"] else None
    if kind == "drag" or kind == "nudge" and i == j:
        by = op["start"]
        s, e = (op["start"], op["end"]) if kind == "drag" else (words[i]["start"] + by, words[i]["end"] + by)
        out[i]["start"], out[i]["end"] = placed(words, duration, i, s, e)
    elif kind == "nudge":
        if not i < j < len(words):
            return None
        low = words[i - 1]["start"] if i else 0.0
        high = words[j + 1]["start"] if j + 1 < len(words) else duration
        by = min(max(op["start"], low - words[i]["start"], -words[i]["start"]), high - words[j]["start"])
        for w in out[i : j + 1]:
            w["start"] = min(max(w["start"] + by, 0.0), duration)
            w["end"] = min(max(w["end"] + by, w["start"]), duration)
    moved = any(abs(a[c] - b[c]) > STILL_S for a, b in zip(out, words) for c in ("start", "end"))
    return out if moved else None


def after_edits(words: list[dict], duration: float, ops: list[dict]) -> tuple[list[dict], int]:
    """The words after all edits, undo and redo among them, and how many of them changed anything."""
    past: list[list[dict]] = []
    future: list[list[dict]] = []
    changed = 0
    for op in ops:
        if op["kind"] in ("undo", "redo"):
            source, other = (past, future) if op["kind"] == "undo" else (future, past)
            if not source:
                continue
            other.append(words)
            words = source.pop()
        else:
            new = edited(words, duration, op)
            if new is None:
                continue
            past, future, words = [*past[-(UNDO - 1) :], words], [], new
        changed += 1
    return words, changed


def word_edits(words: DataFrame, edits: DataFrame) -> DataFrame:
    """song_id, word_idx, word, start, end, line and changed after each song's edits in the order of seq.

    words: song_id, word_idx, word, start, end, line, duration; edits: song_id, seq, kind, first, last, start, end, text.
    Songs are co-grouped with their edits; a song without edits stays as it is.
    """
    schema = "song_id long, word_idx int, word string, start double, end double, line long, changed int"

    def none(x):
        return None if pd.isna(x) else x

    def run(w: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        w, e = w.sort_values("word_idx"), e.sort_values("seq")
        if not len(w):
            return pd.DataFrame(columns=["song_id", "word_idx", "word", "start", "end", "line", "changed"])
        before = [{"word": r.word, "start": r.start, "end": r.end, "line": none(r.line)} for r in w.itertuples()]
        ops = [{k: none(v) for k, v in r.items()} for r in e.to_dict("records")]
        for op in ops:
            op["first"], op["last"] = (int(op[k]) if op[k] is not None else -2 for k in ("first", "last"))
        after, changed = after_edits(before, float(w["duration"].iloc[0]), ops)
        out = pd.DataFrame(after, columns=["word", "start", "end", "line"])
        out["line"] = out["line"].astype("Int64")
        return out.assign(song_id=w["song_id"].iloc[0], word_idx=np.arange(len(out)), changed=changed)[["song_id", "word_idx", "word", "start", "end", "line", "changed"]]

    return words.groupBy("song_id").cogroup(edits.groupBy("song_id")).applyInPandas(run, schema)


def mel_filters(size: int, mels: int, rate: int) -> np.ndarray:
    """Triangular filters (mels, size / 2 + 1) evenly spaced on the mel scale up to half the rate, each of unit area."""
    slope = math.log(6.4) / 27
    top = rate / 2
    top = 15 + math.log(top / 1000) / slope if top >= 1000 else top * 3 / 200
    mel = np.linspace(0, top, mels + 2)
    hz = np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((np.maximum(mel, 15) - 15) * slope))
    low, mid, high = hz[:-2, None], hz[1:-1, None], hz[2:, None]
    f = np.arange(size // 2 + 1) * rate / size
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))) * 2 / (high - low)


def log_mel(x: np.ndarray, filters: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames by mels of a chunk of samples: powers of Hann windows, every `hop` samples, in log10 no more than 8 below the loudest, scaled to about -1..1.

    The chunk is mirrored by half a window at both ends, so it has to be longer than that.
    """
    padded = np.pad(x, size // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][: len(x) // hop]
    power = np.abs(np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)), axis=1)) ** 2
    out = np.log10(np.maximum(power @ filters.T, 1e-10))
    return (np.maximum(out, out.max() - 8) + 4) / 4


def log_mels(chunks: DataFrame, size: int = 400, hop: int = 160, mels: int = 80, rate: int = 16000) -> DataFrame:
    """id, frame and mel (an array of `mels` values) of each chunk; chunks: id, x (samples); a chunk of half a window or less has no frames."""

    def run(batches):
        filters = mel_filters(size, mels, rate)
        for pdf in batches:
            out = [(r.id, k, m.tolist()) for r in pdf.itertuples() if r.x is not None and len(r.x) > size // 2 for k, m in enumerate(log_mel(np.asarray(r.x, np.float64), filters, size, hop))]
            yield pd.DataFrame(out, columns=["id", "frame", "mel"])

    return chunks.mapInPandas(run, "id long, frame int, mel array<double>")
