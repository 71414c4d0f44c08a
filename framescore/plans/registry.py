"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import build, scores

QUERIES = {**scores.QUERIES, **build.QUERIES}
ORACLES: dict[str, str] = {**scores.ORACLES, **build.ORACLES}
