"""Registered queries of this subpackage and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from provaudit.llm.bpe_codec import op8_bpe_codec
from provaudit.llm.gru_lm import op4_gru_lm
from provaudit.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from provaudit.llm.hard_negatives import op13_hard_negatives
from provaudit.llm.hashing_search import op5_multi_index
from provaudit.llm.packing import op6_packing
from provaudit.llm.quality import op3_quality
from provaudit.llm.revisits import ORACLE as REVISITS_SQL
from provaudit.llm.revisits import op1_revisits
from provaudit.llm.simhash import op9_simhash
from provaudit.llm.sketch import op2_bottom_k
from provaudit.llm.spelling import op11_spelling
from provaudit.llm.tier_packing import op12_tier_packing
from provaudit.llm.token_counts import op10_token_counts
from provaudit.llm.toxicity import op7_toxicity

QUERIES = {q.__name__: q for q in (op1_revisits, op2_bottom_k, op3_quality, op4_gru_lm, op5_multi_index, op6_packing, op7_toxicity, op8_bpe_codec, op9_simhash, op10_token_counts, op11_spelling, op12_tier_packing, op13_hard_negatives)}

ORACLES: dict[str, str] = {"op1_revisits": REVISITS_SQL, "op13_hard_negatives": HARD_NEGATIVES_SQL}
