"""Structured responses as column expressions: blocks, intervals, difficulty profiles, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's split and strip know, as a Java regex class.
SPACE = r"[\s\x0B\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# fixed values: the blocks of a response in their order (field and tag), and the ways to write an interval
BLOCKS = (("type_block", "TYPE"), ("influence_block", "INFLUENCE"), ("reasoning_block", "REASONING"), ("conclusion_block", "CONCLUSION"), ("answer_block", "ANSWER"))
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
#: In the order they are tried.
INTERVALS = (
    rf"(?iu)\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]",
    rf"(?iu)start[_\s]sec[:\s]+{_NUMBER}[^0-9]+end[_\s]sec[:\s]+{_NUMBER}",
    rf"(?iu)from\s+{_NUMBER}\s+to\s+{_NUMBER}\s+sec",
    rf"(?iu){_NUMBER}\s*[-–]\s*{_NUMBER}\s*s(?:ec)?",
)
INTERVAL_TYPE = "struct<start_sec:double,end_sec:double>"
PROFILE_TYPE = "array<struct<name:string,severity:double>>"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(f, *cols: Column) -> Column:
    """``f`` of columns that are computed once, however often it uses them."""
    names = [f"x{i}" for i in range(len(cols))]
    held = F.array(F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True))))
    return F.get(F.transform(held, lambda s: f(*(s[n] for n in names))), 0)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(SPACE.replace("[", "[^", 1)), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda x: x != "")


def ngrams(t: Column, n: int) -> Column:
    """Every n consecutive elements as an array of arrays."""
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))


def parse_response(c: Column) -> Column:
    """Struct of the five stripped blocks and the raw text; null unless all are there and open in order."""
    # one extract a block: a list of none or of the first match, empty or not
    found = [F.slice(F.regexp_extract_all(c, F.lit(rf"(?isu)<{tag}>(.*?)<{tag}_END>"), F.lit(1)), 1, 1) for _, tag in BLOCKS]
    at = [F.regexp_instr(c, F.lit(f"(?iu)<{tag}>")) for _, tag in BLOCKS]

    def built(*parts: Column) -> Column:
        blocks, places = parts[: len(BLOCKS)], parts[len(BLOCKS) :]
        ok = F.lit(True)
        for b in blocks:
            ok = ok & (F.size(b) > 0)
        for a, b in zip(places, places[1:], strict=False):
            ok = ok & (a <= b)
        fields = [strip(F.get(b, 0)).alias(name) for (name, _), b in zip(BLOCKS, blocks, strict=True)]
        return F.when(ok, F.struct(*fields, c.alias("raw_text")))

    return let(built, *found, *at)


def interval(c: Column) -> Column:
    """First interval, by the order of ``INTERVALS``, whose first match has its start below its end."""

    def good(a: Column, b: Column) -> Column:
        return F.when((a < b) & (a >= 0), F.struct(a.alias("start_sec"), b.alias("end_sec")))

    def first(x: Column) -> Column:
        return F.coalesce(*(let(good, *(F.regexp_extract(x, p, i).try_cast("double") for i in (1, 2))) for p in INTERVALS))

    return let(first, c)


def parse_profile(c: Column) -> Column:
    """``name:severity`` entries between semicolons; those without a plain finite number are left out."""
    parts = F.filter(F.transform(F.split(c, ";"), strip), lambda x: F.instr(x, ":") > 0)

    def entry(x: Column) -> Column:
        return let(lambda x, at, number: named(x, at, number), x, F.instr(x, ":"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))))

    def named(x: Column, at: Column, number: Column) -> Column:
        return F.struct(strip(F.substring(x, F.lit(1), at - 1)).alias("name"), F.when(number.rlike(_FLOAT), number.try_cast("double")).alias("severity"))

    return F.filter(F.transform(parts, entry), lambda e: e["severity"].isNotNull() & (F.abs(e["severity"]) < float("inf")))


def _listed(profile: Column, pattern: str, between: str) -> Column:
    text = F.array_join(F.transform(profile, lambda e: F.format_string(pattern, e["name"], e["severity"])), between)
    return F.when(F.size(profile) == 0, F.lit("none")).otherwise(text)


def profile_text(profile: Column) -> Column:
    """``name:0.4; name:0.8``, or ``none``."""
    return _listed(profile, "%s:%.1f", "; ")


def factor_phrase(profile: Column) -> Column:
    """``name (severity=0.4), ...``, or ``none``."""
    return _listed(profile, "%s (severity=%.1f)", ", ")


def mean_severity(profile: Column) -> Column:
    total = F.aggregate(profile, F.lit(0.0), lambda a, e: a + e["severity"])
    return F.when(F.size(profile) > 0, total / F.size(profile)).otherwise(0.0)


def serialize_target(*blocks: Column) -> Column:
    """The five blocks between their tags."""
    return F.concat(*(x for (_, tag), b in zip(BLOCKS, blocks, strict=True) for x in (F.lit(f"<{tag}>"), b, F.lit(f"<{tag}_END>"))))


def base_id(c: Column) -> Column:
    """What stands before the first ``_diff`` of a video id."""
    return F.substring_index(c, "_diff", 1)


# --- prompts, in our own words ---

#: What a trained model is asked about a clip.
PROMPT = "Look for an anomaly in this traffic clip. Name what hampers the view and how, reason about what happens, conclude, and answer with its type, interval and cause."


def influence_prompt(profile: Column) -> Column:
    return F.concat(F.lit("These factors make a traffic clip hard to observe: "), factor_phrase(profile), F.lit(". Say briefly how they weaken the visual evidence and which other cues can stand in."))


def reasoning_prompt(profile: Column, influence: Column) -> Column:
    return F.concat(F.lit("A traffic clip is hard to observe because of: "), factor_phrase(profile), F.lit(". Effect on the evidence: "), influence, F.lit(". Reason step by step from cause to effect, in keeping with both."))


def conclusion_prompt(reasoning: Column) -> Column:
    return F.concat(F.lit("State in one short judgment what event this reasoning shows:\n"), reasoning)


def answer_prompt(conclusion: Column) -> Column:
    return F.concat(F.lit("Give the anomaly's type, its interval as [start_sec, end_sec] and a brief cause.\nConclusion: "), conclusion)


def compactness_case(s: Column) -> Column:
    """Kind of rewriting by mean severity."""
    return F.when(s >= 0.6, "detailed").when(s >= 0.3, "moderate").otherwise("concise")


def compactness_prompt(reasoning: Column, s: Column) -> Column:
    how = F.when(s >= 0.6, "in more detail, with steps that make up for weak evidence").when(s >= 0.3, "in moderate detail, with every causal step").otherwise("concisely, with the essential causal steps only")
    return F.concat(F.lit("Rewrite this reasoning "), how, F.lit(":\n"), reasoning)
