"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op8_bottom_k
from .kneser_ney import op7_kneser_ney
from .language import op4_language_id
from .mixing import OP1_SQL, op1_mix
from .packing import op2_best_fit
from .quality import op6_quality_rules
from .simhash import op9_simhash
from .suffixes import op5_suffix_dedup
from .token_counts import op3_token_counts
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_best_fit": op2_best_fit,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_bottom_k": op8_bottom_k,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op1_mix": OP1_SQL}
