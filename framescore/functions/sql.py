"""The expressions as functions of SQL, by name: ``register(spark)``.

Scalar functions have SQL bodies, which Catalyst puts in place of their calls, so a query made of them is planned as if its expressions were
written out; none of them runs Python.  Table functions give rows of a profile, the profiles of each level, and a group's members.
What is sequential by nature stays an Arrow function (see ``operators.corpus.register``); ``effective_words`` is its measure for short texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .parsing import _FLOAT, BLOCKS, INTERVAL_TYPE, INTERVALS, PROFILE_TYPE, SPACE
from .scoring import RewardWeights

_RESPONSE = "STRUCT<" + ", ".join(f"{name}: STRING" for name, _ in BLOCKS) + ", raw_text: STRING>"


def _strip(x: str) -> str:
    """The body of ``stripped``; calls of SQL functions can't have a lambda's variables as arguments."""
    return f"regexp_replace({x}, r'^{SPACE}+|{SPACE}+$', '')"


def _words(x: str) -> str:
    return f"filter(split(lower({x}), r'{SPACE}+'), y -> y <> '')"


_FOUND = "regexp_extract_all({text}, r'(?isu)<{tag}>(.*?)<{tag}_END>', 1)"


def _let(values: dict[str, str], body: str) -> str:
    """``body``, in which ``v.name`` stands for each value, computed once."""
    held = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"get(transform(array(named_struct({held})), v -> {body}), 0)"


def _parse() -> str:
    values = {f"b{k}": _FOUND.format(text="text", tag=tag) for k, (_, tag) in enumerate(BLOCKS)} | {f"p{k}": f"regexp_instr(text, r'(?iu)<{tag}>')" for k, (_, tag) in enumerate(BLOCKS)}
    have = " AND ".join(f"size(v.b{k}) > 0" for k in range(len(BLOCKS)))
    order = " AND ".join(f"v.p{k} <= v.p{k + 1}" for k in range(len(BLOCKS) - 1))
    fields = ", ".join(f"'{name}', {_strip(f'get(v.b{k}, 0)')}" for k, (name, _) in enumerate(BLOCKS))
    return _let(values, f"CASE WHEN {have} AND {order} THEN named_struct({fields}, 'raw_text', text) END")


def _interval() -> str:
    each = []
    for p in INTERVALS:
        start, end = (f"try_cast(regexp_extract(text, r'{p}', {i}) AS DOUBLE)" for i in (1, 2))
        each.append(_let({"a": start, "b": end}, "CASE WHEN v.a >= 0 AND v.a < v.b THEN named_struct('start_sec', v.a, 'end_sec', v.b) END"))
    return f"coalesce({', '.join(each)})"


#: A text's words without repeats of windows of n, as a fold over its places.
_FOLD = """aggregate(IF(size({t}) > 0, sequence(1, size({t})), array()), named_struct('seen', CAST(array() AS ARRAY<STRING>), 'skip', 0, 'kept', CAST(array() AS ARRAY<STRING>)),
(s, i) -> CASE WHEN s.skip > 0 THEN named_struct('seen', s.seen, 'skip', s.skip - 1, 'kept', s.kept)
WHEN i + {n} - 1 <= size({t}) AND array_contains(s.seen, array_join(slice({t}, i, {n}), '\\u0001')) THEN named_struct('seen', s.seen, 'skip', {n} - 1, 'kept', s.kept)
ELSE named_struct('seen', IF(i + {n} - 1 <= size({t}), array_append(s.seen, array_join(slice({t}, i, {n}), '\\u0001')), s.seen), 'skip', 0, 'kept', array_append(s.kept, element_at({t}, i))) END).kept"""

_CLAUSES = f"""aggregate(filter(transform(split(text, '[.!?;]'), c -> {_words('c')}), w -> size(w) > 0), CAST(array() AS ARRAY<ARRAY<STRING>>),
(kept, w) -> IF(exists(kept, k -> 100 * size(array_intersect(k, w)) >= 85 * size(array_union(k, w))), kept, array_append(kept, w)))"""

#: Least total distance of two sorted arrays, the shorter matched into the longer in order, by a table.
_TABLE = """element_at(aggregate(x.short, array_repeat(0D, size(x.long) + 1),
(before, s) -> aggregate(sequence(1, size(x.long)), array(CAST('Infinity' AS DOUBLE)), (row, j) -> array_append(row, least(element_at(row, -1), element_at(before, j) + abs(s - element_at(x.long, j)))))), -1)"""


def _observation(w: RewardWeights) -> str:
    severities = "array_sort(transform(filter({p}, e -> e.name = n), e -> e.severity))"
    p, g = severities.format(p="pred"), severities.format(p="truth")
    each = f"transform(array_intersect(pred.name, truth.name), n -> named_struct('short', IF(size({p}) <= size({g}), {p}, {g}), 'long', IF(size({p}) <= size({g}), {g}, {p})))"
    total = f"aggregate({each}, named_struct('n', 0, 'd', 0D), (a, x) -> named_struct('n', a.n + size(x.short), 'd', a.d + {_TABLE}))"
    scored = f"(m.n - {w.severity}D * m.d) / greatest(1, m.n) - {w.false_positive}D * (size(pred) - m.n) - {w.false_negative}D * (size(truth) - m.n)"
    return f"CASE WHEN size(pred) = 0 AND size(truth) = 0 THEN 1D ELSE get(transform(array({total}), m -> {scored}), 0) END"


_SHARE = "greatest(0D, least(pred.end_sec, truth.end_sec) - greatest(pred.start_sec, truth.start_sec))"
_UNION = f"(pred.end_sec - pred.start_sec + (truth.end_sec - truth.start_sec) - {_SHARE})"
_GRAMS = "IF(size({t}) >= k, transform(sequence(1, greatest(1, size({t}) - k + 1)), i -> array_join(slice({t}, i, k), '\\u0001')), CAST(array() AS ARRAY<STRING>))"
_CLIPPED = "aggregate(array_distinct(x.h), 0, (a, g) -> a + least(size(filter(x.h, y -> y = g)), size(filter(x.r, y -> y = g))))"
_PRECISION = f"get(transform(array(named_struct('h', {_GRAMS.format(t='h')}, 'r', {_GRAMS.format(t='r')})), x -> {_CLIPPED}), 0)"
_BLEU = (
    "CASE WHEN size(h) = 0 THEN 0D ELSE coalesce(least(1D, exp(1 - size(r) / size(h))) * "
    f"exp(aggregate(sequence(1, n), 0D, (s, k) -> s + ln(nullif({_PRECISION}, 0) / greatest(1, size(h) - k + 1))) / n), 0D) END"
)


def definitions(w: RewardWeights = RewardWeights()) -> list[str]:
    """What follows CREATE FUNCTION for each, in an order in which they can be made."""
    words, strings = "ARRAY<STRING>", "CAST(array() AS ARRAY<STRING>)"
    profile, span = PROFILE_TYPE.upper().replace("NAME", "name").replace("SEVERITY", "severity"), INTERVAL_TYPE.upper().replace("START_SEC", "start_sec").replace("END_SEC", "end_sec")
    number = _strip("substring(x, instr(x, ':') + 1)")
    entry = f"named_struct('name', {_strip("substring(x, 1, instr(x, ':') - 1)")}, 'severity', CASE WHEN {number} RLIKE r'{_FLOAT}' THEN try_cast({number} AS DOUBLE) END)"
    level = "named_struct('difficulty_level', {v}D, 'degradation_profile', {p})"
    factors = lambda v: f"array(named_struct('name', 'motion_blur', 'severity', {v}D), named_struct('name', 'low_light', 'severity', {v}D))"
    levels = ", ".join(level.format(v=v, p=f"CAST(array() AS {profile})" if v == "0.0" else factors(v)) for v in ("0.0", "0.2", "0.4", "0.8"))
    return [
        f"stripped(text STRING) RETURNS STRING RETURN {_strip('text')}",
        f"words_of(text STRING) RETURNS {words} RETURN {_words('text')}",
        f"parse_response(text STRING) RETURNS {_RESPONSE} RETURN {_parse()}",
        f"interval_of(text STRING) RETURNS {span} RETURN {_interval()}",
        f"profile_of(text STRING) RETURNS {profile} RETURN filter(transform(filter(transform(split(text, ';'), x -> {_strip('x')}), x -> instr(x, ':') > 0), x -> {entry}), e -> e.severity IS NOT NULL AND abs(e.severity) < CAST('Infinity' AS DOUBLE))",
        f"profile_text(profile {profile}) RETURNS STRING RETURN IF(size(profile) = 0, 'none', array_join(transform(profile, e -> format_string('%s:%.1f', e.name, e.severity)), '; '))",
        f"mean_severity(profile {profile}) RETURNS DOUBLE RETURN IF(size(profile) = 0, 0D, aggregate(profile.severity, 0D, (a, x) -> a + x) / size(profile))",
        f"tiou(pred {span}, truth {span}) RETURNS DOUBLE RETURN CASE WHEN pred IS NULL OR truth IS NULL OR {_UNION} <= 0 THEN 0D ELSE {_SHARE} / {_UNION} END",
        f"bleu_of_words(h {words}, r {words}, n INT) RETURNS DOUBLE RETURN {_BLEU}",
        "bleu(hyp STRING, ref STRING, n INT) RETURNS DOUBLE RETURN bleu_of_words(words_of(hyp), words_of(ref), n)",
        "exact_match(a STRING, b STRING) RETURNS INT RETURN CAST(lower(stripped(a)) = lower(stripped(b)) AS INT)",
        f"text_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN size(words_of(a)) = 0 AND size(words_of(b)) = 0 THEN 1D WHEN size(words_of(a)) = 0 OR size(words_of(b)) = 0 THEN 0D ELSE size(array_intersect(words_of(a), words_of(b))) / size(array_union(words_of(a), words_of(b))) END",
        f"without_repeats(t {words}, n INT) RETURNS {words} RETURN {_FOLD.format(t='t', n='n')}",
        f"clause_words(text STRING) RETURNS INT RETURN aggregate(slice({_CLAUSES}, 1, 50), 0, (a, c) -> a + size(c))",
        f"effective_words(text STRING) RETURNS INT RETURN least(size(words_of(text)), clause_words(array_join(without_repeats(without_repeats(without_repeats(coalesce(words_of(text), {strings}), 3), 4), 5), ' ')))",
        f"observation_reward(pred {profile}, truth {profile}) RETURNS DOUBLE RETURN {_observation(w)}",
        "length_reward(pred BIGINT, truth BIGINT) RETURNS DOUBLE RETURN least(1D, greatest(0D, 1 - abs(pred - truth) / greatest(1, truth)))",
        f"total_reward(ro DOUBLE, rt DOUBLE, rl DOUBLE) RETURNS DOUBLE RETURN {w.alpha}D * ro + {w.beta}D * rt + {w.gamma}D * rl",
        "policy_term(lp DOUBLE, lp_ref DOUBLE, advantage DOUBLE) RETURNS DOUBLE RETURN -least(exp(lp - lp_ref) * advantage, least(greatest(exp(lp - lp_ref), 0.8D), 1.2D) * advantage) + 0.02D * (lp - lp_ref)",
        f"profile_levels() RETURNS TABLE (difficulty_level DOUBLE, degradation_profile {profile}) RETURN SELECT inline(array({levels}))",
        "profile_entries(text STRING) RETURNS TABLE (name STRING, severity DOUBLE) RETURN SELECT e.name, e.severity FROM (SELECT explode(p) AS e FROM (SELECT profile_of(text) AS p))",
        "group_members(n INT) RETURNS TABLE (member INT) RETURN SELECT explode(sequence(1, n))",
    ]


def register(spark: SparkSession, w: RewardWeights = RewardWeights()) -> list[str]:
    """Makes all of them temporary functions of the session; returns their names."""
    made = definitions(w)
    for d in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
    return [d.split("(")[0] for d in made]
