"""Spelling variants against a plain search through all pairs, odd rows, and the query's SQL."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.llm import queries
from framescore.llm import spelling as S

R = random.Random(6)


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def _words(n, letters, longest):
    return {"".join(R.choice(letters) for _ in range(R.randint(1, longest))): int(10 ** R.uniform(0, 5)) for _ in range(n)}


@pytest.mark.parametrize("words", [_words(250, "ab", 7), _words(300, "aéß\U0001f600", 5), _words(200, "abcdefgh", 3), {"aaaa": 5, "aaa": 50, "aa": 500, "a": 5000, "b": 50_000, "bb": 500_000, "ab": 7, "ba": 7}])
def test_against_all_pairs(spark, words):
    rows = [(w, n, 1, 2) for w, n in words.items()]
    got = S.spelling_variants(spark.createDataFrame(rows, "word string, n long, rank int, root int").repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(words)


def test_chains_of_forms(spark):
    """Six forms in a row, each with exactly ten times the count."""
    words = {"abcdefg"[:k] + "z" * (7 - k): 10 ** (k - 1) for k in range(1, 8)}
    got = S.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=str) == plain(words)
    assert {r.root for r in got} == {"abcdefg"} and sum(r.form is not None for r in got) == 6
    # one less than ten times is no form
    assert [r.form for r in S.spelling_variants(spark.createDataFrame([("aa", 10), ("ab", 99)], "word string, n long")).collect()] == [None, None]
    assert [r.form for r in S.spelling_variants(spark.createDataFrame([("aa", 10), ("ab", 19), ("ac", 20)], "word string, n long"), 2).orderBy("word").collect()] == ["ac", None, None]
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([], "word string, n long"), 1)


def test_odd_words(spark):
    """Nulls, repeated rows, an empty word, no rows, and words of many thousand letters, whose keys stay as many as letters."""
    long = "".join(R.choice("abcdef") for _ in range(30_000))
    words = {"": 3, "x": 40, long: 2, long[:9] + "é" + long[10:]: 30, long[:500] + long[501:]: 400, "y" * 20_000: 1, "y" * 20_001: 1}
    rows = [*words.items(), ("x", 2), (None, 7), ("null", None)]
    got = sorted(map(tuple, S.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()), key=str)
    assert got == plain({**words, "x": 42})
    assert S.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_one_group_of_many_words(spark):
    """All words of one wildcard group and of the insertions into one word: rows stay as many as keys."""
    words = {"base" + chr(0x100 + i): i % 50 + 1 for i in range(3000)} | {"base": 10**6}
    got = {r.word: r for r in S.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["base"].n_near == 3000 and all(r.n_near == 3000 and r.form == r.root == "base" for w, r in got.items() if w != "base")


def test_keys_are_linear_in_letters():
    b = S.keys_of(["abbbc", "é", ""], np.array([7, 3, 9]))
    assert Counter(b.column("kind").to_pylist()) == {S._HOLE: 6, S._DELETED: 4, S._OWN: 3}
    a = S.keys_of(["abbc", "abbbc"], np.array([0, 1]))
    key = lambda kind, rank: {(r["a"], r["b"]) for r in a.to_pylist() if r["kind"] == kind and r["rank"] == rank}
    assert key(S._OWN, 0) <= key(S._DELETED, 1) and not key(S._HOLE, 0) & key(S._HOLE, 1)


def test_query(spark, tmp_path):
    run = re.compile("[A-Za-zÀ-ÿ]+")
    stems = ["Banana", "bananas", "straÙenö", "ÀÉÎÕÜçÿ", "Common", "commone", "wordwords", "x" * 60]
    texts = [None, "", "1234 -- ×÷"] + [" ".join(R.choice(stems) + R.choice(["", "s", "ed", "e", "1x", ", ", "ß"]) for _ in range(400)) for _ in range(60)]
    ids = [*range(len(texts) - 1), None]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in zip(ids, texts, strict=True):
        for w in run.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))
    want = plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[1] for r in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES["op12_spelling_variants"](spark, sf)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op12_spelling_variants']})").fetchall()))


def test_keys_go_through_one_exchange(spark):
    words = spark.createDataFrame([("abc", 3, 0), ("abd", 2, 1)], "word string, n long, rank long")
    plan = S.near_words(words.where(F.length("word") > 1), 5 * S.LETTERS)._jdf.queryExecution().executedPlan().toString()
    # words to the tasks, keys to their groups, what words learn to the words
    assert plan.count("Exchange hashpartitioning(") == 3 and "Join" not in plan, plan
