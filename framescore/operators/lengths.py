"""Effective reasoning length: repeated n-grams and near-equal clauses count once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import tokens
from ..functions.scoring import jaccard

#: Sizes of the windows whose repeats go, in their order; clauses that count; percent of words that near-equal ones share.
WINDOWS, MOST_CLAUSES, NEAR = (3, 4, 5), 50, 85
_ENDS = re.compile("[.!?;]")


def _numbered(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each window of ``n``, equal for equal windows, and how often each number stands.

    A window is one integer, a digit for each of its ids; where it would outgrow 63 bits, what there is so far is numbered anew.
    """
    places = len(ids) - n + 1
    base = int(ids.max()) + 1
    window, most = ids[:places].astype(np.int64), base
    for k in range(1, n):
        if most * base >= 1 << 63:
            window = np.unique(window, return_inverse=True)[1].ravel()
            most = places
        window = window * base + ids[k : k + places]
        most *= base
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    number = np.empty(places, np.int64)
    number[order] = np.cumsum(first) - 1
    return number, np.diff(np.append(np.flatnonzero(first), places))


def _fresh(ids: np.ndarray, n: int) -> np.ndarray:
    """Which places of a row of word ids stay when repeats of windows of ``n`` are cut out.

    Only places whose window occurs twice or more can begin a cut or be the reason of one, so only they are looked at.
    """
    stays = np.ones(len(ids), bool)
    if len(ids) <= n:
        return stays
    window, count = _numbered(ids, n)
    twice = np.flatnonzero(count[window] > 1)
    met, resume = np.zeros(len(count), bool), 0
    for at, w in zip(twice.tolist(), window[twice].tolist(), strict=True):
        if at < resume:
            continue
        if met[w]:
            resume = at + n
            stays[at:resume] = False
        met[w] = True
    return stays


def _clause_words(text: str) -> int:
    """Words of the first clauses that differ enough from each other."""
    total, sets = 0, []
    for part in _ENDS.split(text):
        words = part.split()
        own = set(words)
        if not own:
            continue
        # sets whose sizes differ too much can't be near; of others that share c words, 100 c >= NEAR (both sizes - c) is asked
        n = len(own)
        for other in sets:
            m = len(other)
            if 100 * (n if n < m else m) >= NEAR * (m if n < m else n) and (100 + NEAR) * len(own & other) >= NEAR * (n + m):
                break
        else:
            total += len(words)
            sets.append(own)
            if len(sets) == MOST_CLAUSES:
                break
    return total


def _length(text: str | None) -> int:
    words = (text or "").lower().split()
    if not words:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    at = np.arange(len(words))
    for n in WINDOWS:
        keep = _fresh(ids, n)
        ids, at = ids[keep], at[keep]
    return min(len(words), _clause_words(" ".join([words[i] for i in at.tolist()])))


@F.pandas_udf(T.LongType())
def effective_length(text: pd.Series) -> pd.Series:
    """Sequential by nature, so an Arrow function; equal texts of a batch are measured once."""
    known = {t: _length(t) for t in text.unique()}
    return text.map(known).astype("int64")


def without_repeats_column(t: Column, n: int) -> Column:
    """Words left when repeats of windows of ``n`` are cut out, as a fold over the places of an array (for short texts)."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        whole = i + (n - 1) <= F.size(t)
        window = F.array_join(F.slice(t, i, n), "\x01")
        again = whole & F.array_contains(s["seen"], window)
        kept = F.struct(F.when(whole, F.array_append(s["seen"], window)).otherwise(s["seen"]).alias("seen"), F.lit(0).alias("skip"), F.array_append(s["out"], F.element_at(t, i)).alias("out"))
        skipped = lambda left: F.struct(s["seen"].alias("seen"), left.alias("skip"), s["out"].alias("out"))
        return F.when(s["skip"] > 0, skipped(s["skip"] - 1)).when(again, skipped(F.lit(n - 1))).otherwise(kept)

    places = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)["out"]


def distinct_clauses_column(clauses: Column, near: float = NEAR / 100, words: Callable[[Column], Column] = tokens) -> Column:
    """Clauses that share less than ``near`` of their ``words`` with each one kept before, as a fold."""
    return F.aggregate(clauses, F.array().cast("array<string>"), lambda kept, c: F.when(F.exists(kept, lambda k: jaccard(k, c, words) >= near), kept).otherwise(F.array_append(kept, c)))
