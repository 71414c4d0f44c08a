"""Queries of the training-data operators, by name; ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

from . import sql
from .bpe import op10_bpe
from .embedding_dedup import op6_embedding_dedup
from .html_text import op2_html_text
from .jaccard import op7_jaccard_join
from .language import op11_language_id
from .packing import op8_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .quality import op5_quality_rules
from .spelling import op12_spelling_variants
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op9_toxicity
from .warc import op4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_html_text, op3_suffix_dedup, op4_warc, op5_quality_rules, op6_embedding_dedup, op7_jaccard_join, op8_best_fit_packing, op9_toxicity, op10_bpe, op11_language_id, op12_spelling_variants, op13_periodic_runs)}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": sql.SUBSTRING_DEDUP,
    "op3_suffix_dedup": sql.SUFFIX_DEDUP,
    "op4_warc": op4_SQL,
    "op6_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op7_jaccard_join": sql.JACCARD_JOIN,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
    "op13_periodic_runs": sql.PERIODIC_RUNS,
}
