"""The registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, merkle, quality_rules, vector_codes
from .decontaminate import op4_containment_search
from .language_id import op3_byte_gru
from .license_scan import op5_template_join
from .line_dedup import op8_fuzzy_lines
from .merkle import op12_block_manifest
from .mixing import op6_soft_mixing
from .quality import op2_fourier_quality
from .quality_rules import op11_robust_outliers
from .secret_scan import op10_decoding_worklist
from .simhash_dedup import op1_simhash_pivots
from .token_output import op7_dac_tokens
from .topk_search import op9_blockmax_bm25
from .vector_codes import op13_exponion_codes

QUERIES = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_fourier_quality": op2_fourier_quality,
    "op3_byte_gru": op3_byte_gru,
    "op4_containment_search": op4_containment_search,
    "op5_template_join": op5_template_join,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_dac_tokens": op7_dac_tokens,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_blockmax_bm25": op9_blockmax_bm25,
    "op10_decoding_worklist": op10_decoding_worklist,
    "op11_robust_outliers": op11_robust_outliers,
    "op12_block_manifest": op12_block_manifest,
    "op13_exponion_codes": op13_exponion_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_containment_search": decontaminate.oracle_sql(),
    "op5_template_join": license_scan.oracle_sql(),
    "op11_robust_outliers": quality_rules.oracle_sql(),
    "op12_block_manifest": merkle.oracle_sql(),
    "op13_exponion_codes": vector_codes.oracle_sql(),
}
