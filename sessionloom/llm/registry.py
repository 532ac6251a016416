"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from sessionloom.llm import oracles
from sessionloom.llm.bpe import op2_byte_bpe
from sessionloom.llm.embedding_dedup import op10_rp_forest
from sessionloom.llm.kneser_ney import op6_kneser_ney
from sessionloom.llm.language_id import op8_language_mixture
from sessionloom.llm.media_avi import op1_avi_shots
from sessionloom.llm.ngram_join import op5_ngram_jaccard
from sessionloom.llm.packing import op4_best_fit_packing
from sessionloom.llm.secrets import op3_secret_scan
from sessionloom.llm.substring_dedup import op7_substring_dedup
from sessionloom.llm.url_rules import op9_url_rules

QUERIES: dict[str, Callable] = {
    "op1_avi_shots": op1_avi_shots,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_mixture": op8_language_mixture,
    "op9_url_rules": op9_url_rules,
    "op10_rp_forest": op10_rp_forest,
}
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_rp_forest": oracles.NEAR_VECTORS,
}
