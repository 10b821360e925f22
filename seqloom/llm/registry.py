"""The queries of the training-data operators and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from seqloom.llm.op1_lm_scoring import op1_lm_scores
from seqloom.llm.op2_language import op2_language_id
from seqloom.llm.op3_topk import SQL as TOPK
from seqloom.llm.op3_topk import op3_exact_topk
from seqloom.llm.op4_decontaminate import op4_decontaminate
from seqloom.llm.op5_secrets import SQL as SECRETS
from seqloom.llm.op5_secrets import op5_secret_links
from seqloom.llm.op6_mixing import op6_mix_sources
from seqloom.llm.op7_toxicity import op7_toxicity
from seqloom.llm.op8_simhash import op8_simhash_groups
from seqloom.llm.op9_html import op9_extract_html
from seqloom.llm.op10_token_counts import op10_token_counts


def queries():
    operators = (
        op1_lm_scores, op2_language_id, op3_exact_topk, op4_decontaminate, op5_secret_links,
        op6_mix_sources, op7_toxicity, op8_simhash_groups, op9_extract_html, op10_token_counts,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    own = {"op3_exact_topk": TOPK, "op5_secret_links": SECRETS}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
