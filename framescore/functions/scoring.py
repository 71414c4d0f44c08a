"""Metrics and rewards of one row as column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import matched_distance
from .parsing import let, strip, tokens


@dataclass(frozen=True)
class RewardWeights:
    """Shares of the three rewards and penalties of the first."""

    # fixed values: the default weights
    alpha: float = 0.4
    beta: float = 0.4
    gamma: float = 0.2
    severity: float = 0.5
    false_positive: float = 0.3
    false_negative: float = 0.3

    def __post_init__(self):
        if self.severity < 0:
            raise ValueError("the severity penalty can't be negative")


def tiou(pred: Column, gt: Column) -> Column:
    """Overlap of two intervals over their union; 0 without a prediction or a union."""

    def share(p: Column, g: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(p["end_sec"], g["end_sec"]) - F.greatest(p["start_sec"], g["start_sec"]))
        union = (p["end_sec"] - p["start_sec"]) + (g["end_sec"] - g["start_sec"]) - inter
        return F.when(p.isNull() | g.isNull() | (union <= 0), 0.0).otherwise(inter / union)

    return let(share, pred, gt)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def clipped_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """How many n-grams, n from 1 to ``MOST_GRAM``, of one array of words another has too, each as often as both have it."""

    def both(h, r) -> list[int]:
        h, r = list(h), list(r)
        return [sum((Counter(zip(*(h[i:] for i in range(n)), strict=False)) & Counter(zip(*(r[i:] for i in range(n)), strict=False))).values()) for n in range(1, MOST_GRAM + 1)]

    return pd.Series([None if h is None or r is None else both(h, r) for h, r in zip(hyp, ref, strict=True)])


#: Longest n-grams of BLEU.
MOST_GRAM = 4


def bleu(hyp: Column, ref: Column, n: int = 1) -> Column:
    """BLEU-n of one reference, without smoothing."""
    h, r = tokens(hyp), tokens(ref)
    return bleu_of(clipped_counts(h, r), F.size(h), F.size(r), n)


def bleu_of(same: Column, h: Column, r: Column, n: int) -> Column:
    """BLEU-n of clipped counts and the two numbers of words."""
    if not 1 <= n <= MOST_GRAM:
        raise ValueError(f"n is 1 to {MOST_GRAM}")
    brevity = F.least(F.lit(1.0), F.exp(1 - r / F.greatest(F.lit(1), h)))
    total = F.lit(0.0)
    for k in range(1, n + 1):
        total = total + F.log(F.nullif(F.get(same, k - 1), F.lit(0)) / F.greatest(F.lit(1), h - (k - 1)))
    return F.when((h == 0) | total.isNull(), 0.0).otherwise(brevity * F.exp(total / n))


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays: a row of the table is one long integer, a bit a column."""

    def length(x, y) -> int:
        where: dict[str, int] = {}
        for j, w in enumerate(y):
            where[w] = where.get(w, 0) | 1 << j
        full = (1 << len(y)) - 1
        row = full
        for w in x:
            met = row & where.get(w, 0)
            row = (row + met | row - met) & full
        return len(y) - row.bit_count()

    return pd.Series([None if x is None or y is None else length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def rouge_l(hyp: Column, ref: Column) -> Column:
    """F1 of the longest common subsequence."""
    h, r = rouge_tokens(hyp), rouge_tokens(ref)
    return F.when((F.size(h) == 0) | (F.size(r) == 0), 0.0).otherwise(2.0 * lcs(h, r) / (F.size(h) + F.size(r)))


def jaccard(a: Column, b: Column, words: Callable[[Column], Column] = tokens) -> Column:
    """Of two texts' ``words``, lower-cased ones between white space: both empty 1, one empty 0."""
    return let(_jaccard, F.array_distinct(words(a)), F.array_distinct(words(b)))


def _jaccard(x: Column, y: Column) -> Column:
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def exact_match(p: Column, g: Column) -> Column:
    return (F.lower(strip(p)) == F.lower(strip(g))).cast("int")


def _severities(profile: Column, name: Column) -> Column:
    return F.array_sort(F.transform(F.filter(profile, lambda e: e["name"] == name), lambda e: e["severity"]))


def _shared(pred: Column, gt: Column) -> Column:
    """The sorted severities ``p`` and ``g`` of each name that both profiles have."""
    names = F.array_intersect(F.transform(pred, lambda e: e["name"]), F.transform(gt, lambda e: e["name"]))
    return F.transform(names, lambda x: F.struct(_severities(pred, x).alias("p"), _severities(gt, x).alias("g")))


def _repeats(pred: Column, gt: Column) -> Column:
    """Both profiles have a name more than once; in all others a name stands once on one side at least."""
    more = lambda p: F.size(F.array_distinct(p["name"])) < F.size(p)
    return more(pred) & more(gt)


def _distance(e: Column) -> Column:
    """Distance of the nearest two of one name's severities, of which one side has one."""
    one, many = (F.when(F.size(e["p"]) == 1, e[a]).otherwise(e[b]) for a, b in (("p", "g"), ("g", "p")))
    return F.array_min(F.transform(many, lambda x: F.abs(x - F.get(one, 0))))


def _table_distance(e: Column) -> Column:
    """The same for any two numbers, by a table of matching the shorter array into the longer one in order."""

    def table(short: Column, long: Column) -> Column:
        def row(prev: Column, x: Column) -> Column:
            def cell(cur: Column, j: Column) -> Column:
                return F.array_append(cur, F.least(F.element_at(cur, -1), F.element_at(prev, j) + F.abs(x - F.element_at(long, j))))

            return F.aggregate(F.sequence(F.lit(1), F.size(long)), F.array(F.lit(float("inf"))), cell)

        return F.element_at(F.aggregate(short, F.array_repeat(F.lit(0.0), F.size(long) + 1), row), -1)

    p, g = e["p"], e["g"]
    return let(table, F.when(F.size(p) <= F.size(g), p).otherwise(g), F.when(F.size(p) <= F.size(g), g).otherwise(p))


def reward_observation(pred: Column, gt: Column, w: RewardWeights = RewardWeights(), heaps: bool = True) -> Column:
    """Reward of a predicted difficulty profile.

    Factors of one name are matched one to one at the least total distance of severities, which is plain where one side has a single one.
    Rows where both sides repeat names, and only those, go to ``matched_distance``, an Arrow function that takes n log n steps; without
    ``heaps`` they stay in the expression, which is quadratic and worse, for a few severities a name.
    """
    table = None if heaps else _table_distance
    plain = let(lambda p, g: let(lambda e: _rewarded(e, p, g, w, table), _shared(p, g)), pred, gt)
    if not heaps:
        return plain
    some = _repeats(pred, gt)
    # nulls for all other rows; it stands apart, as Arrow functions can't be within array functions
    return plain - w.severity * F.coalesce(matched_distance(F.when(some, pred), F.when(some, gt)), F.lit(0.0))


def _rewarded(each: Column, pred: Column, gt: Column, w: RewardWeights, table) -> Column:
    """Without distances where both sides repeat names, unless ``table`` gives them."""
    total = F.aggregate(each, F.lit(0.0), lambda a, e: a + (table or _distance)(e))
    distance = total if table else F.when(_repeats(pred, gt), 0.0).otherwise(total)
    count = F.aggregate(each, F.lit(0), lambda a, e: a + F.least(F.size(e["p"]), F.size(e["g"])))
    score = (count - w.severity * distance) / F.greatest(F.lit(1), count)
    out = score - w.false_positive * (F.size(pred) - count) - w.false_negative * (F.size(gt) - count)
    return F.when((F.size(pred) == 0) & (F.size(gt) == 0), 1.0).otherwise(out)


def reward_length(pred_length: Column, gt_length: Column) -> Column:
    """Compactness reward of two effective lengths."""
    off = 1 - F.abs(pred_length - gt_length) / F.greatest(F.lit(1), gt_length)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), off))


def total_reward(ro: Column, rt: Column, rl: Column, w: RewardWeights = RewardWeights()) -> Column:
    return w.alpha * ro + w.beta * rt + w.gamma * rl


def advantage(reward: Column, *group: str) -> Column:
    """Reward's distance from its group's mean, in the group's standard deviations."""
    by = Window.partitionBy(*group)
    return (reward - F.avg(reward).over(by)) / (F.stddev_pop(reward).over(by) + 1e-6)


def grpo_term(lp: Column, lp_ref: Column, adv: Column, clip: float = 0.2, kl: float = 0.02) -> Column:
    """Clipped policy objective of one response, with its divergence penalty."""
    ratio = F.exp(lp - lp_ref)
    bounded = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return -F.least(ratio * adv, bounded * adv) + kl * (lp - lp_ref)
