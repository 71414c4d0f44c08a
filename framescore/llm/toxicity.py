"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes compatible forms of characters as one, lower-cases, maps homoglyphs to Latin letters and digits within words
to the letters they stand for, drops invisible characters and turns all else but letters and marks into one space.  Lexicon
entries are word beginnings or whole words (with the space after them).  They are learned from
labelled rows: beginnings that many toxic and few other documents have, each with the log
ratio of its rates.  Hits inside an exception phrase don't count; phrases are pairs of words that clean labelled rows
have and toxic ones never, and some fixed ones or a caller's own.  A document's weighted hits, per word and in all, go through a logistic
curve fitted on the same rows.

The fit takes at most ``SAMPLE`` labelled rows of each class, those with the smallest hashes.
Null and empty texts have no hits and score as such; a null id is never held out; labels of
no document and documents of no label are fine; with no toxic label at all, every score is 0.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C

#: Labelled rows of each class that the fit takes at most; candidates and entries of the lexicon at most, with a warning when there are more.
SAMPLE, CANDIDATES, ENTRIES = 3000, 20_000, 2000
#: Letters of a word's beginning that can be an entry; whole words may be longer.
SHORTEST, LONGEST = 3, 14
#: Clean rows that a learned exception phrase is in at least; it is in no toxic one.
CLEAN_ROWS = 2
RESULTS = ("weight", "density", "n_hits", "score")
#: Share of the toxic rows that an entry is in at least.
SUPPORT = 0.02
#: Log ratio of rates that an entry has at least.
LEAST_WEIGHT = 3.0
#: Standard errors between its shares of toxic and other rows at least.
LEAST_ERRORS = 2.0
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "class clown fish", "clown fish", "sore loser", "pond scum", "soap scum", "worthless currency")

# fixed values: characters that look like Latin letters, and digits or signs that stand for one
_LOOKALIKES = dict(zip("абвгдезіїјкмнорстухѕԁԛѡαβεηικνορτυχωɑɡıℓ", "abbrdeziijkmhopctyxsdqwabeniknoptuxwagil", strict=False))
_STANDS_FOR = dict(zip("013457@$", "oieasta" + "s", strict=True))
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """Translation table that finds out about a character when it first meets it; digits and signs that may stand for letters stay."""

    def __missing__(self, code: int):
        out = ""
        for low in unicodedata.normalize("NFKC", chr(code)).lower():
            if low in _INVISIBLE or unicodedata.combining(low) and not low.isalpha():
                continue
            out += _LOOKALIKES.get(low) or (low if low in _STANDS_FOR or low.isalpha() or not low.isascii() and low.isalnum() else " ")
        self[code] = out
        return out


_FOLD = _Fold()
_SPACES = re.compile(" {2,}")
_MIXED = re.compile(r"[^ ]*[013457@$][^ ]*")
_LETTERS = str.maketrans(_STANDS_FOR)
_NUMBERS = str.maketrans(dict.fromkeys(_STANDS_FOR, " "))


def _unmixed(m: re.Match) -> str:
    """Digits and signs in a word with letters stand for letters; others are none."""
    word = m[0]
    return word.translate(_LETTERS if any(map(str.isalpha, word)) else _NUMBERS)


def fold(text: str | None) -> str:
    """Folded text, a space before, between and after its words."""
    return _SPACES.sub(" ", _MIXED.sub(_unmixed, f" {(text or '').translate(_FOLD)} "))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


@functools.lru_cache(4)
def _automaton(entries: tuple[str, ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, e in enumerate(entries):
        made.add_word(" " + e, (i, len(e)))
    for e in exceptions:
        if (key := fold(e)) not in made:
            made.add_word(key, (-1, len(key)))
    if len(made):
        made.make_automaton()
    return made


def hits(text: str, entries: tuple[str, ...], exceptions: tuple[str, ...]) -> list[tuple[int, int]]:
    """(place, entry) of each hit outside exception phrases; of the entries at one place, the longest."""
    made = _automaton(entries, exceptions)
    if not len(made):
        return []
    found, spared = {}, []
    for end, (i, n) in made.iter(text):
        if i < 0:
            spared.append((end - n + 1, end))
        else:
            found[end - n + 1] = i  # ends rise, so the longest comes last
    if spared and found:
        found = {s: i for s, i in found.items() if not any(a < s <= b for a, b in spared)}
    return list(found.items())


def _beginnings(texts: list[str | None]) -> Counter:
    """Documents that hold each word beginning or whole word."""
    seen: Counter = Counter()
    for t in texts:
        words = set(fold(t).split())
        seen.update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + " " for w in words if SHORTEST <= len(w)})
    return seen


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` of at most ``per_class`` rows of each class that may be learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    few = [usable.where(f"y = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of rows that repeat an id, one: 2 * per_class rows at most


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, per_class: int = SAMPLE) -> Model:
    """Learns lexicon, exception phrases and curve from labelled rows that aren't held out."""
    sample = C.checkpoint(labelled(docs, labels, "toxic", per_class))  # documents are read once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(_beginnings(b.column("text").to_pylist()))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    toxic = sample.where("y = 1")
    n_toxic = toxic.count()
    if not n_toxic:
        return Model({}, tuple(exceptions), (0.0, 0.0, -math.inf))
    counted = toxic.select("text").mapInArrow(count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= max(2, math.ceil(SUPPORT * n_toxic))).orderBy(F.desc("n"), "entry").limit(CANDIDATES)
    df = {r["entry"]: r["n"] for r in frequent.collect()}
    if len(df) == CANDIDATES:
        warnings.warn(f"only the {CANDIDATES} most frequent candidates of the lexicon are looked at", stacklevel=2)
    entries = tuple(sorted(df))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(entries, ())
        for b in batches:
            rows = []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                text = fold(text)
                seen: Counter = Counter(i for _, (i, _) in made.iter(text)) if len(made) else Counter()
                rows.append((y, text.count(" ") - 1, list(seen), list(seen.values())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["y", "words", "entry", "n"])

    matched = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(match, "y int, words long, entry array<int>, n array<int>")
    each = F.arrays_zip("entry", "n")
    by_entry = matched.select("y", "words", F.explode(each).alias("e")).groupBy("e.entry").agg(
        *(F.sum((F.col("y") == c).cast("int")).alias(f"docs{c}") for c in (0, 1)),
        *(F.sum(F.when(F.col("y") == c, F.col("e.n")).otherwise(0)).alias(f"hits{c}") for c in (0, 1)),
    )
    total = {r["y"]: (r["words"], r["docs"]) for r in matched.groupBy("y").agg(F.sum("words").alias("words"), F.count("*").alias("docs")).collect()}
    (w0, d0), (w1, d1) = total.get(0, (0, 0)), total[1]
    stats = {entries[r["entry"]]: r for r in by_entry.collect()}
    gain: dict[str, tuple[float, float]] = {}
    for e, r in stats.items():
        weight = math.log((r["hits1"] + 0.5) / (w1 + 1)) - math.log((r["hits0"] + 0.5) / (w0 + 1))
        share, clean = r["docs1"] / d1, r["docs0"] / max(1, d0)
        error = math.sqrt(share * (1 - share) / d1 + clean * (1 - clean) / max(1, d0))
        if share >= 5 * clean and share - clean >= LEAST_ERRORS * error and weight >= LEAST_WEIGHT:
            gain[e] = (r["docs1"] * weight, weight)
    for e in sorted(gain, key=len, reverse=True):  # a beginning gives way to a longer one that as many toxic rows have
        short = e[:-1]
        if short in gain and stats[e]["docs1"] >= 0.97 * stats[short]["docs1"]:
            gain[short] = (0.0, gain[short][1])
    gain = {e: g for e, g in gain.items() if g[0]}
    chosen: dict[str, float] = {}
    parts: set[str] = set()  # the beginnings of those chosen
    for e in sorted(gain, key=lambda e: (-gain[e][0], -len(e), e)):
        if len(chosen) < ENTRIES and e not in parts and not any(e[:k] in chosen for k in range(SHORTEST, len(e))):
            chosen[e] = gain[e][1]
            parts.update(e[:k] for k in range(SHORTEST, len(e) + 1))
    if len(chosen) == ENTRIES:
        warnings.warn(f"the lexicon is cut at {ENTRIES} entries", stacklevel=2)
    phrases = tuple(dict.fromkeys([*exceptions, *_clean_phrases(sample, tuple(sorted(chosen)), exceptions)]))
    scored = _scored(sample.select("doc_id", "text", F.col("y").cast("int").alias("y")), chosen, phrases, ("y",)).select("y", "weight", "density").toPandas()  # 2 * per_class rows at most
    return Model(chosen, phrases, _logistic(scored[["density", "weight"]].to_numpy(), scored["y"].to_numpy()))


def _clean_phrases(sample: DataFrame, entries: tuple[str, ...], exceptions: tuple[str, ...]) -> list[str]:
    """Two words, one of them hit by an entry, that clean labelled rows have and toxic ones never."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            phrase, label = [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                text, found = fold(text), set()
                for at, _ in hits(text, entries, exceptions):
                    end = text.index(" ", at)
                    word, before, after = text[at:end], text[: at - 1].rpartition(" ")[2], text[end + 1 :].partition(" ")[0]
                    found.update(x for x in (f"{before} {word}" if before else "", f"{word} {after}" if after else "") if x)
                phrase += found
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(label, pa.int32())], ["phrase", "y"])

    counted = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(pairs, "phrase string, y int").groupBy("phrase").agg(F.count(F.when(F.col("y") == 0, 1)).alias("clean"), F.sum("y").alias("toxic"))
    return [r["phrase"] for r in counted.where((F.col("clean") >= CLEAN_ROWS) & (F.col("toxic") == 0)).orderBy("phrase").collect()]  # words of at most 2 * per_class rows


def _logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Coefficients of the logarithms of weighted hits per 100 words and of weighted hits, and the offset."""
    x = np.column_stack([np.log1p(features * [100, 1]), np.ones(len(y))])
    # both classes count alike
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * b
        h = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(3)
        b = b - np.linalg.solve(h, g)
    return tuple(map(float, b))


def _scored(docs: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    keep = tuple(k for k in keep if k not in RESULTS)
    entries = tuple(sorted(weights))
    values = [weights[e] for e in entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, density, n = [], [], []
            for text in b.column("text").to_pylist():
                text = fold(text)
                found = hits(text, entries, exceptions)
                n.append(len(found))
                weight.append(sum(values[i] for _, i in found))
                density.append(weight[-1] / max(10, text.count(" ") - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, pa.float64()) for c in (weight, density)), pa.array(n, pa.int64())], [*keep, "weight", "density", "n_hits"])

    types = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "weight double, density double, n_hits long"]))


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` from 0 to 1 and ``n_hits`` of each row; a kept column of such a name is left out."""
    found = _scored(docs, model.weights, model.exceptions, keep)
    if not model.weights:
        return found.withColumn("score", F.lit(0.0)).drop("weight", "density")
    a, b, c = model.curve
    x = a * F.log1p(100 * F.col("density")) + b * F.log1p("weight") + c
    return found.withColumn("score", 1 / (1 + F.exp(-x))).drop("weight", "density")


THRESHOLD = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
