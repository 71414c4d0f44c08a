"""One-to-one matching of points on a line at the least total distance, every point of the smaller set matched."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def least_distance(a: Iterable[float], b: Iterable[float]) -> float:
    """Least sum of distances, in n log n steps.

    Points are swept from left to right.  The least cost as a function of how many points wait to be matched is convex, and two heaps hold its slopes on either
    side: what it costs to match one more point of the smaller set, and what changing the partner of one gives.  A point that
    is matched leaves behind the price of taking that back, so later points can undo it.  A partner still to come is priced
    as infinite: the first part of a slope counts such, the second is the finite rest.
    """
    small, large = sorted((list(a), list(b)), key=len)
    total = (0, 0.0)
    free: list[tuple[int, float]] = []  # of places that can be taken, what it costs besides the point's own coordinate
    settled: list[tuple[int, float]] = []  # of points, what another partner costs besides its coordinate
    for x, wants in sorted([(x, True) for x in small] + [(x, False) for x in large]):
        if wants:
            n, v = heappop(free) if free else (1, 0.0)
            total = total[0] + n, total[1] + x + v
            heappush(settled, (-n, -v - 2 * x))
        elif settled and (settled[0][0], settled[0][1] + x) < (0, 0.0):
            n, v = heappop(settled)
            total = total[0] + n, total[1] + x + v
            heappush(free, (-n, -v - 2 * x))
            heappush(settled, (0, -x))
        else:
            heappush(free, (0, -x))
    return total[1]


@F.pandas_udf(T.DoubleType())
def matched_distance(pred: pd.Series, gt: pd.Series) -> pd.Series:
    """The mean of ``least_distance`` over all that is matched of the names that two arrays of (name, severity) share; null of a null."""

    def by_name(profile) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {}
        for e in profile:
            out.setdefault(e["name"], []).append(e["severity"])
        return out

    def one(p, g) -> float | None:
        if p is None or g is None:
            return None
        p, g = by_name(p), by_name(g)
        shared = sorted(p.keys() & g.keys())
        return sum(least_distance(p[n], g[n]) for n in shared) / max(1, sum(min(len(p[n]), len(g[n])) for n in shared))

    return pd.Series([one(p, g) for p, g in zip(pred, gt, strict=True)], dtype="float64")
