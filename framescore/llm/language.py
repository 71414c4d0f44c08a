"""Language identification in two steps: the family first, then the language within it, by linear support vector machines.

Closely related languages share most of what tells them from the rest, so one flat classifier spends its weights on that.
Here one-versus-one machines choose a family, from the texts of all its languages, and others, each trained on two languages
of one family alone, choose the language there.  Only the machines of the chosen family look at a text.

Features are n-grams of one to four characters of lower-cased words, with a mark at both ends, hashed to 2**``BITS`` buckets;
a text's value is the mean weight of its n-grams, so its length doesn't matter.  All that isn't a letter only
separates words.  Texts are read whole and one by one, without a shuffle.

The fit takes at most ``SAMPLE`` rows of each language, those with the smallest hashes of their ids, and at most as many of each
family; each machine is trained in a task of its own.  Families are those of ``FAMILIES``; a value not listed is a family of its own.

Null texts and those without any letter are ``und`` with score 0, as all are where nothing can be learned; rows without an id
or with a null language are predicted and never learned from; of rows that repeat an id one is learned from. Repeated rows count each.
With one language in all, every text with a letter has that one.  Kept columns may have any name; one that a result has too is left out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks as C

#: Rows of each language, and of each family, that the fit takes at most.
SAMPLE = 1500
BITS, LONGEST = 16, 4
#: Bytes of text that are looked at together.
SLICE = 1 << 20
#: Code points whose n-grams are in memory at one time.
WINDOW = 1 << 20
RESULTS = ("lang_pred", "score")
UNKNOWN = "und"

# fixed values: families of languages by their codes
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
    "tai": "lo th",
}


def families_of(langs: list[str]) -> dict[str, str]:
    """The family of each language."""
    known = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
    return {x: known.get(x.lower().split("-")[0].split("_")[0], x) for x in langs}


# --- features ---


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """The lower case of each code point that is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' letters with one 0 between words and rows and at both ends, and the row of each place."""
    held = [t or "" for t in texts]
    codes = _letters()[np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(held)), [len(t) + (i + 1 < len(held)) for i, t in enumerate(held)])
    codes, row = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)]), np.concatenate([[0], row, [max(0, len(held) - 1)]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep], row[keep]


def grams(codes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of each n-gram, a bounded number at a time."""
    for begin in range(0, len(codes), WINDOW):
        c, r = codes[begin : begin + WINDOW + LONGEST - 1].astype(np.uint64), row[begin : begin + WINDOW + LONGEST - 1]
        most = min(WINDOW, len(codes) - begin)
        h, inner = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
        for n in range(1, LONGEST + 1):
            size = min(most, len(c) - n + 1)
            if size <= 0:
                break
            h = h[:size] * np.uint64(0x2545F4914F6CDD1D) + c[n - 1 : n - 1 + size]
            if n > 2:  # no end of a word within
                inner = inner[:size] & (c[n - 2 : n - 2 + size] != 0)
            good = c[:size] != 0 if n == 1 else inner[:size]
            bucket = (C.mix(h[good] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            # what begins with a word's end belongs to the word after it
            own = r[:size] if n == 1 else np.where(c[:size] != 0, r[:size], r[1 : 1 + size])
            yield bucket, own[good]


def sparse(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of the n-grams of each text."""
    out = []
    for t in texts:
        found = [b for b, _ in grams(*folded([t]))]
        at, n = np.unique(np.concatenate(found), return_counts=True)
        out.append((at, (n / max(1, n.sum())).astype(np.float64)))
    return out


# --- machines ---


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1 and both kinds count alike."""
    scale = 1 / max(1e-12, float(np.mean([np.sqrt((v * v).sum()) for _, v in rows])))
    w, offset, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    diagonal = share / cost  # one over twice the cost of a row's loss
    held = [(at, v * scale) for at, v in rows]
    norm = np.array([float((v * v).sum()) for _, v in held]) + 1 + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(held)):
            at, v = held[i]
            g = y[i] * (float(w[at] @ v) + offset) - 1 + diagonal[i] * alpha[i]
            if alpha[i] > 0 or g < 0:
                new = max(0.0, alpha[i] - g / norm[i])
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                offset += step
                most, alpha[i] = max(most, abs(step)), new
        if most < 1e-3:
            break
    return (w * scale).astype(np.float32), offset


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a margin to the probability of y = 1."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # not quite sure, so that the slope stays finite
    x, b = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, x.T @ (p - target)), -5, 5)
    return max(float(b[0]), 1e-3), float(b[1])


@dataclass(frozen=True)
class Machine:
    """Says ``a`` where its logistic curve is over a half, else ``b``."""

    a: str
    b: str
    weights: np.ndarray
    offset: float
    slope: float
    bias: float

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (mean + self.offset) + self.bias, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Machines between families, and for each family its languages and the machines between them."""

    between: list[Machine]
    within: dict[str, tuple[list[str], list[Machine]]]


def may_learn(doc_id: str = "doc_id", lang: str = "lang") -> Column:
    """Rows that the contract lets the fit see."""
    return F.col(lang).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 3 != 1)


def sampled(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """``lang``, ``text`` and ``place`` (from 1, within the language) of at most so many rows of each language.

    Rows are thinned by their hashes to about the number wanted before they are ranked, so no window holds a language's rows.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n"))
    share = 1.25 * (per_language + 6 * per_language**0.5) / F.col("n")  # so many that an estimate a fifth too high takes none away
    thin = usable.join(F.broadcast(counts), "lang").where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share)  # a row a language
    one = thin.groupBy("lang", "h").agg(F.min("text").alias("text"))
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return placed.where(F.col("place") <= per_language).select("lang", "text", "place")


_TRAINED = "a string, b string, weights binary, offset double, slope double, bias double"


def _train(table: pa.Table) -> pa.Table:
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    y = np.where(table.column("is_a").to_numpy(), 1.0, -1.0)
    order = np.lexsort((table.column("place").to_numpy(), table.column("lang").to_numpy()))  # rows come in any order
    rows = sparse(table.column("text").to_pylist())
    rows, y = [rows[i] for i in order], y[order]
    w, offset = svm(rows, y)
    margin = np.array([float(w[at] @ v) + offset for at, v in rows])
    return pa.table([pa.array([x], t) for x, t in zip((a, b, w.tobytes(), offset, *_curve(margin, y)), (pa.string(), pa.string(), pa.binary(), *[pa.float64()] * 3), strict=True)], ["a", "b", "weights", "offset", "slope", "bias"])


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Learns from rows (doc_id, text, lang), all of which may be learned from."""
    spark, sample = docs.sparkSession, C.checkpoint(sampled(docs, per_language))
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # one row a language
    family = families_of(langs)
    members = {f: [x for x in langs if family[x] == f] for f in sorted(set(family.values()))}
    # a problem is a pair of classes; each language takes part in those of its family, and in those of its own family with others
    rows = [("lang", a, b, x, x == a, per_language) for m in members.values() for a, b in itertools.combinations(m, 2) for x in (a, b)]
    rows += [("family", a, b, x, family[x] == a, max(1, per_language // len(members[family[x]]))) for a, b in itertools.combinations(members, 2) for x in (*members[a], *members[b])]
    found = []
    if rows:
        problems = spark.createDataFrame(rows, "level string, a string, b string, lang string, is_a boolean, most int")
        dealt = sample.join(F.broadcast(problems), "lang").where(F.col("place") <= F.col("most"))  # a few rows a language
        found = dealt.groupBy("level", "a", "b").applyInArrow(lambda key, t: _train(t).append_column("level", pa.array([key[0].as_py()])), f"{_TRAINED}, level string").collect()  # a row a pair of classes
    C.discard(sample)
    made = {(r["level"], r["a"], r["b"]): Machine(r["a"], r["b"], np.frombuffer(r["weights"], np.float32), r["offset"], r["slope"], r["bias"]) for r in found}
    pick = lambda level, names: [made[level, a, b] for a, b in itertools.combinations(names, 2)]
    return Model(pick("family", members), {f: (m, pick("lang", m)) for f, m in members.items()})


# --- prediction ---


def _chosen(classes: list[str], machines: list[Machine], means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (of ``means``, a column a machine) the class with most votes, of those that with most probability, and its mean probability."""
    votes = np.zeros((len(means), len(classes)))
    total = np.zeros_like(votes)
    for k, m in enumerate(machines):
        p, i, j = m.probability(means[:, k]), classes.index(m.a), classes.index(m.b)
        votes[:, i] += p > 0.5
        votes[:, j] += p <= 0.5
        total[:, i] += p
        total[:, j] += 1 - p
    best = np.argmax(votes + total / max(1, len(classes)), 1)
    return best, total[np.arange(len(means)), best] / max(1, len(classes) - 1) if machines else np.ones(len(means))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n, families = len(texts), list(model.within)
    codes, row = folded(texts)
    size = np.zeros(n)
    all_machines = [*model.between, *(m for _, machines in model.within.values() for m in machines)]
    place = {id(m): k for k, m in enumerate(all_machines)}
    total = np.zeros((n, len(all_machines)))

    def add(machines: list[Machine], bucket: np.ndarray, own: np.ndarray) -> None:
        for m in machines:
            total[:, place[id(m)]] += np.bincount(own, m.weights[bucket], n)

    for bucket, own in grams(codes, row):
        size += np.bincount(own, minlength=n)
        add(model.between, bucket, own)
    means = total / np.maximum(size, 1)[:, None]
    family, sure = _chosen(families, model.between, means[:, : len(model.between)])
    groups = [(i, f) for i, f in enumerate(families) if model.within[f][1] and (family[size > 0] == i).any()]
    for bucket, own in grams(codes, row) if groups else ():
        for i, f in groups:
            here = family[own] == i
            add(model.within[f][1], bucket[here], own[here])
    means = total / np.maximum(size, 1)[:, None]
    lang, score = [UNKNOWN] * n, np.zeros(n)
    for i, f in enumerate(families):
        names, machines = model.within[f]
        rows = np.flatnonzero((family == i) & (size > 0))
        best, p = _chosen(names, machines, means[rows][:, [place[id(m)] for m in machines]])
        score[rows] = sure[rows] * p
        for r, b in zip(rows, best, strict=True):
            lang[r] = names[b]
    return lang, score


def languages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` from 0 to 1 of each row's whole text."""
    keep = tuple(k for k in keep if k not in RESULTS)
    # 256 KB a machine; there are as many as pairs of families and of languages within one
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.slices(batch, SLICE):
                texts = b.column("text").to_pylist()
                lang, score = predict(held.value, texts) if held.value.within else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *RESULTS])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "lang_pred string, score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(may_learn()))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
