"""Alignments against enumeration of all, their time on long texts, and synonyms from a side table."""

import random
import time

import pytest

from framescore.functions import alignment as A
from framescore.functions.stems import stem
from framescore.operators import corpus

R = random.Random(5)


def enumerated(h, r):
    """Matches and fewest chunks of all alignments that have most matches at the first level, then at the second, and so on."""
    best, levels = None, len(h[0])

    def go(i, used, pairs):
        nonlocal best
        if i == len(h):
            count = [0] * levels
            for a, b in pairs:
                count[next(k for k in range(levels) if h[a][k] == r[b][k])] += 1
            chunks = sum(x == 0 or pairs[x - 1] != (a - 1, b - 1) for x, (a, b) in enumerate(pairs))
            key = [-c for c in count], chunks
            best = key if best is None or key < best else best
            return
        go(i + 1, used, pairs)
        for j in range(len(r)):
            if j not in used and h[i][-1] == r[j][-1]:
                go(i + 1, used | {j}, [*pairs, (i, j)])

    go(0, frozenset(), [])
    return -sum(best[0]), best[1]


def test_alignment_against_enumeration():
    for _ in range(2000):
        levels = R.choice([1, 2, 3])
        h, r = ([(w, w // 2, w // 4)[:levels] for w in (R.randint(0, 5) for _ in range(R.randint(0, 6)))] for _ in range(2))
        assert A.align(h, r) == ((*enumerated(h, r), True) if h and r else (0, 0, True))


def test_without_steps_left_an_alignment_stands():
    for _ in range(300):
        h, r = ([(w, w // 2) for w in (R.randint(0, 5) for _ in range(R.randint(1, 6)))] for _ in range(2))
        m, chunks, _ = A.align(h, r, budget=-99)
        best = enumerated(h, r)
        assert m == best[0] and best[1] <= chunks <= m


def test_longest_runs():
    for _ in range(200):
        h, r = ([R.randint(0, 2) for _ in range(R.randint(0, 12))] for _ in range(2))
        for i, (n, j) in enumerate(A.longest_runs(h, r)):
            want = max((k for k in range(len(h) - i + 1) if any(r[x : x + k] == h[i : i + k] for x in range(len(r) - k + 1))), default=0)
            assert n == want and r[j : j + n] == h[i : i + n]


@pytest.mark.parametrize("h,r,chunks", [
    ([i % 7 for i in range(10_000)], [i % 7 for i in range(10_050)], 1),
    (list(range(10_000)), [*range(5000, 10_000), *range(5000)], 2),
    ([R.randint(0, 3) for _ in range(10_000)], [R.randint(0, 3) for _ in range(10_000)], None),
    ([R.randint(0, 500) for _ in range(10_000)], [R.randint(0, 500) for _ in range(10_000)], None),
])
def test_long_texts(h, r, chunks):
    began = time.process_time()
    m, c, _ = A.align([(x,) for x in h], [(x,) for x in r])
    assert time.process_time() - began < 4  # under a second on a machine that does nothing else
    assert m == sum(min(h.count(x), r.count(x)) for x in set(h)) and (c == chunks if chunks else 0 < c < m)


def test_meteor_with_synonyms(spark):
    same = spark.createDataFrame([("Autos", "car"), ("cars", "car"), ("stop", "b"), ("halted", "b"), ("stop", "a"), (None, "x"), ("y", None)], "word string, name string")
    rows = [(1, "the car stopped", "the auto halts"), (2, "car car", "autos"), (3, None, "car"), (4, "", ""), (5, "fog", "fog")]
    got = {r.id: r.meteor for r in corpus.meteor_scores(spark.createDataFrame(rows, "id long, hyp string, ref string"), same).collect()}
    groups = {"auto": "car", "car": "car", "stop": "a", "halt": "b"}
    assert groups == {stem("autos"): "car", stem("cars"): "car", stem("stop"): "a", stem("halted"): "b"}
    assert got == {i: pytest.approx(corpus.meteor_of(h, r, groups)) for i, h, r in rows}
    # two words in one chunk, the third in no common group
    p = 2 / 3
    assert got[1] == pytest.approx(p * (1 - 0.5 * (1 / 2) ** 3)) and got[2] > 0 and got[3] == got[4] == 0
    plain = {r.id: r.meteor for r in corpus.meteor_scores(spark.createDataFrame(rows, "id long, hyp string, ref string")).collect()}
    assert plain[1] < got[1] and plain[5] == got[5]


def test_long_states_cost_no_pass_over_the_text():
    """What words have used up is one number, kept up to date; a state of 60 by 60 words holds no count a word and level."""
    import sys

    own = random.Random(1)
    h, r = ([(w, w // 2) for w in (own.randint(0, 9) for _ in range(60))] for _ in range(2))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += frame.f_code.co_filename == A.__file__

    sys.setprofile(count)
    try:
        A.align(h, r)
    finally:
        sys.setprofile(None)
    assert calls < 50 * A.BUDGET


def test_equal_pairs_are_scored_once():
    import pandas as pd

    asked = []
    got = corpus._each_once([("a", "b"), ("a", "b"), (None, "b"), ("a", "b"), (None, "b")], lambda h, r: asked.append((h, r)) or len(asked))
    assert asked == [("a", "b"), (None, "b")] and got.tolist() == [1, 1, 2, 1, 2] and isinstance(got, pd.Series)


def test_synonyms_of_a_small_table_move_no_pairs(spark):
    """Up to ``few`` stems, pairs are neither shuffled nor joined; beyond, they are, with the same scores."""
    same = spark.createDataFrame([("Autos", "car"), ("cars", "car"), ("stop", "b"), ("halted", "b"), ("stop", "a"), (None, "x")], "word string, name string")
    rows = [(i, *t) for i, t in enumerate([("the car stopped", "the auto halts"), ("car car", "autos"), (None, "car"), ("", ""), ("fog stop", "fog halt"), ("stop", None)] * 3)]
    pairs = spark.createDataFrame(rows, "id long, hyp string, ref string")
    small, large = corpus.meteor_scores(pairs, same), corpus.meteor_scores(pairs, same, few=3)
    assert "Join" in large._jdf.queryExecution().executedPlan().toString()
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(small.select("id", "meteor").collect()) == sorted(large.select("id", "meteor").collect())
