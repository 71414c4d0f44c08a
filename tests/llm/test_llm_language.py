"""Language identification: held-out accuracy, features and prediction against plain versions, odd rows."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.llm import language as L
from framescore.llm import queries

R = random.Random(11)
#: Syllables of made-up languages; the first two and the last two share most of theirs.
SYLLABLES = {"en": "the er in on ing th an st wh ou ly", "de": "the er in on ung ch an st sch ei ich", "fr": "le es que ou eau tion é re ai ment", "es": "la es que os ado ción ó re ar mente"}


def _doc(lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(R.choice(s) for _ in range(R.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    return [(i, _doc(lang, R.randint(4, 60)), lang) for i in range(240) for lang in (["en", "de", "fr", "es"][i % 4],)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where(L.may_learn()))


def plain_grams(text):
    """Words as letters in lower case with a mark at both ends; n-grams hashed one by one."""
    out = collections.Counter()
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    for w in words:
        marked = [0, *map(ord, w), 0]
        for n in range(1, L.LONGEST + 1):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if n > 1 or g[0]:
                    h = 0
                    for c in g:
                        h = (h * 0x2545F4914F6CDD1D + c) % (1 << 64)
                    h = (h + n) % (1 << 64)
                    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                        h = (h ^ h >> 33) * m % (1 << 64)
                    out[(h ^ h >> 33) >> (64 - L.BITS)] += 1
    return out


ODD = [None, "", " \n", "123 --", "a", "ǅ İstanbul I", "日本語 です", "x1y2", "é" * 9, "Aa\U0001f600bB", "the " * 40]


def test_features(monkeypatch):
    texts = ODD + [_doc(lang, 30) for lang in SYLLABLES]
    for window in (L.WINDOW, 7):
        monkeypatch.setattr(L, "WINDOW", window)
        got = [collections.Counter() for _ in texts]
        for bucket, row in L.grams(*L.folded(texts)):
            for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
                got[r][b] += 1
        assert got == [plain_grams(t) for t in texts]
        for t, (at, v) in zip(texts, L.sparse(texts), strict=True):
            want = plain_grams(t)
            assert at.tolist() == sorted(want) and np.allclose(v, [want[b] / want.total() for b in sorted(want)])


def test_machine_meets_its_conditions():
    """At the optimum of the primal, its gradient is 0."""
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(1 << L.BITS, 6, replace=False)[:5] % 40 + np.arange(5) * 40), rng.random(5)) for _ in range(60)]
    y = np.where(rng.random(60) > 0.7, 1.0, -1.0)
    w, b = L.svm(rows, y, rounds=3000)
    scale = 1 / np.mean([np.sqrt((v * v).sum()) for _, v in rows])
    x = np.zeros((60, 200))
    for i, (at, v) in enumerate(rows):
        x[i, at] = v * scale
    v = w[:200].astype(float) / scale
    loss = 1 / (2 * np.where(y > 0, (y > 0).mean(), (y < 0).mean()))
    slack = np.maximum(0, 1 - y * (x @ v + b))
    assert np.abs(v - x.T @ (2 * loss * slack * y)).max() < 0.02 and abs(b - (2 * loss * slack * y).sum()) < 0.02


def test_prediction_against_a_plain_version(model):
    texts = ODD + [_doc(lang, n) for lang in SYLLABLES for n in (1, 3, 80)]
    lang, score = L.predict(model, texts)
    assert [m.a + m.b for m in model.between] == ["germanicromance"] and {f: [m.a + m.b for m in v[1]] for f, v in model.within.items()} == {"germanic": ["deen"], "romance": ["esfr"]}
    for t, got, p in zip(texts, lang, score, strict=True):
        g = plain_grams(t)
        if not g:
            assert (got, p) == ("und", 0.0)
            continue
        of = lambda m: 1 / (1 + np.exp(-(m.slope * (sum(float(m.weights[b]) * n for b, n in g.items()) / g.total() + m.offset) + m.bias)))  # noqa: E731, B023
        f = of(model.between[0])
        names, (machine,) = model.within["germanic" if f > 0.5 else "romance"]
        q = of(machine)
        assert got == (names[0] if q > 0.5 else names[1])
        assert abs(p - max(f, 1 - f) * max(q, 1 - q)) < 1e-6


def test_held_out_accuracy(spark, rows, model):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.languages(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 60 and sum(got[i] == lang for i, lang in held) >= 0.97 * len(held)


def test_votes_among_several(spark):
    """Three languages in one family, two single ones, and one outside the list."""
    made = {"en": "the wh ing", "de": "sch ung ich", "nl": "ij oe aa", "fr": "eau que", "xx-Q": "zz qq"}
    rows = [(i, " ".join(R.choice(s.split()) + R.choice(s.split()) for _ in range(20)), lang) for i in range(300) for lang, s in [list(made.items())[i % 5]]]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id % 3 > 0"), 40)
    assert {f: (x, len(m)) for f, (x, m) in model.within.items()} == {"germanic": (["de", "en", "nl"], 3), "romance": (["fr"], 0), "xx-Q": (["xx-Q"], 0)} and len(model.between) == 3
    lang, score = L.predict(model, [t for _, t, _ in rows])
    held = [i for i in range(300) if i % 3 == 0]
    assert all(lang[i] == rows[i][2] for i in held) and min(score) > 0 and max(score) <= 1


def test_sample_is_bounded_and_the_same_each_time(spark, rows):
    docs = spark.createDataFrame([*rows, *[(7, f"copy {i}", "es") for i in range(500)], (None, "none", "en"), (1, None, "fr"), (2, "x", None)], "doc_id long, text string, lang string")
    got = [sorted(map(tuple, L.sampled(d, 20).collect())) for d in (docs, docs.repartition(7))]
    assert got[0] == got[1] and {lang: sum(r[0] == lang for r in got[0]) for lang in SYLLABLES} == dict.fromkeys(SYLLABLES, 20)
    assert sum(t.startswith("copy") for _, t, _ in got[0]) <= 1


def test_odd_rows_and_tables(spark, model):
    rows = [(i, t, "x", 1.5, "y") for i, t in enumerate(ODD)] + [(None, "the wing", None, None, None), (3, "123 --", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, h string")
    got = L.languages(docs, model, ("doc_id", "h", "score", "text"))
    assert got.columns == ["doc_id", "h", "text", "lang_pred", "score"] and got.count() == len(rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got.collect())
    assert L.languages(docs.limit(0), model).count() == 0
    none = L.fit(docs.limit(0).select("doc_id", "text", F.lit("en").alias("lang")))
    assert {tuple(r) for r in L.languages(docs, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = L.fit(spark.createDataFrame([(1, "a b", "fr")], "doc_id long, text string, lang string"))
    assert {tuple(r) for r in L.languages(docs, one).select("lang_pred", "score").collect()} == {("und", 0.0), ("fr", 1.0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op11_language_id"](spark, sf).join(docs, "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
