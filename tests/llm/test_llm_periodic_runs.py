"""Periodic runs against a plain search, odd rows, and the query's SQL."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from framescore.llm import periodic_runs as P
from framescore.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")
R = random.Random(3)


def plain_runs(w, least=24, exponent=3):
    """Every period from 1 on, word by word; a stretch found before had a smaller one."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _made():
    """Words in few letters, with stretches that repeat, end to end and overlapping."""
    w = []
    for _ in range(R.randint(0, 6)):
        kind = R.random()
        if kind < 0.3:
            w += [R.choice("abc") for _ in range(R.randint(0, 40))]
        elif kind < 0.8:
            block, n = [R.choice("ab") for _ in range(R.randint(1, 14))], R.randint(1, 90)
            w += [block[i % len(block)] for i in range(n)]
        else:
            w += [str(R.randint(0, 300)) for _ in range(R.randint(0, 60))]
    return w


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (9, 4), (1, 3)])
def test_maximal_runs_against_a_plain_search(least, exponent):
    for _ in range(150):
        rows = [_made() for _ in range(R.randint(1, 6))]
        number = {x: i for i, x in enumerate(sorted({x for r in rows for x in r}))}
        off = np.cumsum([0, *map(len, rows)])
        got = zip(*(a.tolist() for a in P.maximal_runs(np.array([number[x] for r in rows for x in r], np.int64), off, least, exponent)), strict=True)
        assert list(got) == [(i, *x) for i, r in enumerate(rows) for x in plain_runs(r, least, exponent)]


def test_names_are_equal_for_equal_windows_of_a_row_only():
    w = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1], np.int64)
    level = P.names(w, np.array([0, 6, 9]), 4)
    assert len(level) == 3
    assert level[0][0] == level[0][2] != level[0][7]
    assert level[1][0] == level[1][2] == level[1][4] >= 0 and level[1][6] == level[1][7] == -1
    assert level[2][0] == level[2][2] >= 0 and level[2][1] == -1


def test_operator_on_odd_rows(spark):
    block = [f"w{i}" for i in range(30)]
    texts = [None, "", " \t\n\x0b", "one", "a " * 23, "a " * 24, "a\n" * 3000, " ".join(block * 2), " ".join(block * 3), "x " + " ".join(block * 3 + block[:7]) + " y", " ".join(_made() + _made()), "Wörter\x1cx " * 40, " ".join(f"u{i}" for i in range(5000))]
    rows = [(i, t, "k", i, 1, "c") for i, t in enumerate(texts)] + [(3, "one", None, None, None, None), (None, "b " * 50, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, runs int, start int, w string").repartition(3)
    got = P.periodic_runs(docs, ("doc_id", "h", "runs", "w")).collect()
    assert sorted(got[0].asDict()) == ["collapsed", "doc_id", "h", "n_words", "runs", "w"]
    want = []
    for i, t, h, *_, w in rows:
        words = WORD.findall(t or "")
        runs = plain_runs(words)
        want.append((i, h, w, len(words), runs, collapse(words, runs)))
    assert sorted(((r.doc_id, r.h, r.w, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert P.periodic_runs(docs.limit(0)).count() == 0
    plan = P.periodic_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the test's own repartition


def test_query(spark, tmp_path):
    texts = [None, "", "one", "a b " * 60] + [" ".join(_made() + [f"w{i}" for i in range(R.randint(0, 200))]) for _ in range(90)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    some = 0
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs, r = plain_runs(w), got[i]
        some += len(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert some > 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES["op13_periodic_runs"](spark, sf)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op13_periodic_runs']})").fetchall()))
