"""Functions of SQL against the expressions of the same name, on texts with all kinds of flaws."""

import random

import pytest
from pyspark.sql import functions as F

from framescore.functions import parsing as P
from framescore.functions import scoring as S
from framescore.functions import sql
from framescore.operators import lengths

R = random.Random(2)
GOOD = "<TYPE>fog:0.4; fog:0.9;x:1e-1;bad;y:0.4f<TYPE_END><INFLUENCE>i<INFLUENCE_END><REASONING>\n a b c. a b c. d; a b c d \x1f<REASONING_END><CONCLUSION>c<CONCLUSION_END><ANSWER>from 1 to 2.5 sec [3, 1]<ANSWER_END>"
TEXTS = [None, "", GOOD, GOOD.lower(), GOOD.replace("<ANSWER>", ""), "<ANSWER>x<ANSWER_END>" + GOOD, GOOD.replace("from 1 to 2.5 sec", "start_sec: 7 end sec 9"), GOOD.replace("from 1 to 2.5", "2–3 s, [0.5,0.75]"), "one two three. one two three four. a! b? c; c", "p q r s p q r t p q r", " ".join(R.choices("a b c d.; e! f", k=60)), " é É　x"]


@pytest.fixture(scope="module")
def rows(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) == len(sql.definitions())
    spans = [None, (0.0, 3.0), (2.0, 5.0), (4.0, 4.0)]
    make = lambda: [(R.choice("ab"), R.randint(0, 10) / 10) for _ in range(R.randint(0, 5))]
    data = [(i, TEXTS[i % len(TEXTS)], TEXTS[(5 * i + 3) % len(TEXTS)], make(), make(), spans[i % 4], spans[i // 4 % 4]) for i in range(144)]
    return spark.createDataFrame(data, f"i int, a string, b string, p {P.PROFILE_TYPE}, g {P.PROFILE_TYPE}, s {P.INTERVAL_TYPE}, t {P.INTERVAL_TYPE}")


@pytest.mark.parametrize("call,column", [
    ("stripped(a)", lambda: P.strip(F.col("a"))),
    ("words_of(a)", lambda: P.tokens(F.col("a"))),
    ("parse_response(a)", lambda: P.parse_response(F.col("a"))),
    ("interval_of(a)", lambda: P.interval(F.col("a"))),
    ("profile_of(parse_response(a).type_block)", lambda: P.parse_profile(P.parse_response(F.col("a"))["type_block"])),
    ("profile_of(a)", lambda: P.parse_profile(F.col("a"))),
    ("profile_text(p)", lambda: P.profile_text(F.col("p"))),
    ("mean_severity(p)", lambda: P.mean_severity(F.col("p"))),
    ("tiou(s, t)", lambda: S.tiou(F.col("s"), F.col("t"))),
    ("bleu(a, b, 1)", lambda: S.bleu(F.col("a"), F.col("b"), 1)),
    ("bleu(a, b, 4)", lambda: S.bleu(F.col("a"), F.col("b"), 4)),
    ("exact_match(a, b)", lambda: S.exact_match(F.col("a"), F.col("b"))),
    ("text_jaccard(a, b)", lambda: S.jaccard(F.col("a"), F.col("b"))),
    ("without_repeats(words_of(a), 3)", lambda: lengths.without_repeats_column(P.tokens(F.col("a")), 3)),
    ("CAST(effective_words(coalesce(a, '')) AS BIGINT)", lambda: lengths.effective_length(F.coalesce("a", F.lit("")))),
    ("observation_reward(p, g)", lambda: S.reward_observation(F.col("p"), F.col("g"))),
    ("length_reward(i, 20)", lambda: S.reward_length(F.col("i"), F.lit(20))),
    ("total_reward(i, 2, 3)", lambda: S.total_reward(F.col("i"), F.lit(2), F.lit(3))),
    ("policy_term(i / 100, 0.5D, 1D - i / 70)", lambda: S.grpo_term(F.col("i") / 100, F.lit(0.5), 1.0 - F.col("i") / 70)),
])
def test_function(rows, call, column):
    named = rows.sparkSession.sql(f"SELECT i, {call} AS x FROM {{rows}}", rows=rows)
    assert "Python" not in named._jdf.queryExecution().executedPlan().toString()
    want = {r.i: r.x for r in rows.select("i", column().alias("x")).collect()}
    got = {r.i: r.x for r in named.collect()}
    if isinstance(next(iter(want.values())), float):
        want = {i: pytest.approx(x) for i, x in want.items()}
    assert got == want and len({str(x) for x in got.values()}) > 1


def test_table_functions(rows):
    spark = rows.sparkSession
    assert [(r.difficulty_level, len(r.degradation_profile)) for r in spark.sql("SELECT * FROM profile_levels()").collect()] == [(0.0, 0), (0.2, 2), (0.4, 2), (0.8, 2)]
    got = spark.sql("SELECT i, name, severity FROM {rows}, LATERAL profile_entries(a) WHERE i < 12", rows=rows).collect()
    assert sorted((r.i, r.name, r.severity) for r in got) == sorted((r.i, e.name, e.severity) for r in rows.where("i < 12").select("i", P.parse_profile(F.col("a")).alias("p")).collect() for e in r.p or ())
    assert spark.sql("SELECT i, member FROM {rows}, LATERAL group_members(3)", rows=rows).count() == 3 * rows.count()
