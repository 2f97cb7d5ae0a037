"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from impactspark.llm.chat import OP10_SQL, op10_chat_format
from impactspark.llm.decontaminate import OP9_SQL, op9_decontaminate, op9_decontaminate_near
from impactspark.llm.lm import OP6_BASE_SQL, op6_lm_base, op6_lm_score
from impactspark.llm.mixing import op1_mix_sources
from impactspark.llm.pii import op5_pii
from impactspark.llm.quality import op4_quality_classifier
from impactspark.llm.rules import OP8_COUNTS_SQL, op8_quality_rules, op8_rule_counts
from impactspark.llm.simhash import op2_simhash_near_dedup
from impactspark.llm.toxicity import op3_toxicity
from impactspark.llm.urls import OP7_SQL, op7_url_filter

#: The query of each operator comes first; further ones show more of it, or what SQL can check of it.
_ALL = (
    op1_mix_sources,
    op2_simhash_near_dedup,
    op3_toxicity,
    op4_quality_classifier,
    op5_pii,
    op6_lm_score,
    op6_lm_base,
    op7_url_filter,
    op8_quality_rules,
    op8_rule_counts,
    op9_decontaminate,
    op9_decontaminate_near,
    op10_chat_format,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op6_lm_base": OP6_BASE_SQL, "op7_url_filter": OP7_SQL, "op8_rule_counts": OP8_COUNTS_SQL, "op9_decontaminate": OP9_SQL, "op10_chat_format": OP10_SQL}
