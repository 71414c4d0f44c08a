"""Group-relative advantages of a stream with keyed state: members once, timers, late rows apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "group_id long, member long, reward double, advantage double, kind string"
#: What a row of the result is: of a complete group, of one that timed out, or one that came after its group was settled.
COMPLETE, TIMED_OUT, LATE = "complete", "timed_out", "late"


class GroupAdvantages(StatefulProcessor):
    """Holds the reward of each member of a group until ``size`` have come; then the group's members stay known for as long as repeats may come."""

    def __init__(self, size: int, timeout_ms: int) -> None:
        self.size, self.timeout_ms = size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "member long", "reward double")
        self.settled = handle.getValueState("settled", "n int")

    def _expire(self, timers) -> None:
        """The group ends so long after its last news."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.members.iterator()}  # ``size`` at most
        settled, late, news = self.settled.exists(), [], False
        for part in rows:
            for member, reward in zip(part["member"].tolist(), part["reward"].tolist(), strict=True):
                if member in held:
                    continue  # a repeat, from a source that sends again
                if settled:
                    late.append((member, reward))
                    continue
                held[member], news = reward, True
                self.members.updateValue((member,), (reward,))
                if len(held) == self.size:
                    settled = True
                    self.settled.update((self.size,))
                    r = np.array(list(held.values()))
                    yield self._rows(key, list(held), r, (r - r.mean()) / (r.std() + 1e-6), COMPLETE)
        if news:
            self._expire(timerValues)
        if late:
            yield self._rows(key, [m for m, _ in late], [r for _, r in late], [None] * len(late), LATE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.settled.exists():
            held = [(k[0], v[0]) for k, v in self.members.iterator()]
            yield self._rows(key, [m for m, _ in held], [r for _, r in held], [None] * len(held), TIMED_OUT)
        self.members.clear()
        self.settled.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, members, rewards, advantages, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"group_id": key[0], "member": members, "reward": rewards, "advantage": pd.Series(advantages, dtype="float64"), "kind": kind})


def advantages_by_member(rows: DataFrame, size: int = 4, timeout_ms: int = 600_000) -> DataFrame:
    """Rows (group_id, member, reward) of a stream with ``advantage`` and ``kind``.

    A member that comes again doesn't count again, before its group is complete or after.  A group of ``size`` members comes out with
    the advantages that ``functions.scoring.advantage`` gives on a table; other members that come later are ``late``, with a null advantage; what a group has
    so long after its last news is ``timed_out``.  State is kept by key in the state store, a few members a group, and goes with the timer; the session has to have
    the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
    """
    return rows.groupBy("group_id").transformWithStateInPandas(GroupAdvantages(size, timeout_ms), OUT, "Append", "ProcessingTime")


def without_late(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in time, and the late ones apart."""
    return found.where(F.col("kind") != LATE), found.where(F.col("kind") == LATE)
