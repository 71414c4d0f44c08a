"""Scoring of response streams: row-local rewards, and advantages once a group is complete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import interval, let, parse_profile, parse_response
from ..functions.scoring import RewardWeights, reward_length, reward_observation, tiou, total_reward
from ..operators.lengths import effective_length


def score_responses(rows: DataFrame, w: RewardWeights = RewardWeights()) -> DataFrame:
    """Adds ``ro``, ``rt``, ``rl`` and ``reward`` to rows with ``text``, ``gt_profile``, ``gt`` and ``gt_reasoning``.

    A response that can't be parsed has reward 0.  Works on tables and on streams alike.
    """
    parsed = rows.withColumn("blocks", let(parse_response, F.col("text")))
    parsed = parsed.withColumn("profile", parse_profile(F.col("blocks.type_block"))).withColumn("span", interval(F.col("blocks.answer_block")))
    parsed = parsed.withColumns({"n_pred": effective_length(F.coalesce(F.col("blocks.reasoning_block"), F.lit(""))), "n_gt": effective_length("gt_reasoning")})
    some = F.col("blocks").isNotNull()
    scored = parsed.withColumns(
        {
            "ro": F.when(some, reward_observation(F.col("profile"), F.col("gt_profile"), w)),
            "rt": F.when(some, tiou(F.col("span"), F.col("gt"))),
            "rl": F.when(some, reward_length(F.col("n_pred"), F.col("n_gt"))),
        }
    )
    return scored.withColumn("reward", F.when(some, total_reward(F.col("ro"), F.col("rt"), F.col("rl"), w)).otherwise(0.0)).drop("blocks", "profile", "span", "n_pred", "n_gt")


def stream_advantages(rows: DataFrame, size: int = 4, timeout_ms: int = 600_000) -> DataFrame:
    """Rows (group_id, member, reward) of a stream with their advantage, when ``size`` of a group have come.

    What a group has after ``timeout_ms`` without news comes out with a null advantage.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        members, rewards = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"group_id": key[0], "member": members, "reward": rewards, "advantage": [None] * len(members)})
            return
        for p in parts:
            members += p["member"].tolist()
            rewards += p["reward"].tolist()
        while len(members) >= size:
            r = np.array(rewards[:size])
            yield pd.DataFrame({"group_id": key[0], "member": members[:size], "reward": r, "advantage": (r - r.mean()) / (r.std() + 1e-6)})
            members, rewards = members[size:], rewards[size:]
        if members:
            state.update((members, rewards))
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()

    return rows.groupBy("group_id").applyInPandasWithState(run, "group_id long, member long, reward double, advantage double", "members array<long>, rewards array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
