"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP3_SQL, op3_decontamination
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP10_SQL, op10_source_mixing
from .near_duplicates import op5_near_duplicates
from .quality_rules import op7_quality_rules
from .resampling import op4_importance_resampling
from .sql import OP5_SQL, OP8_SQL
from .substring_dedup import op8_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op6_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_near_duplicates": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_source_mixing": OP10_SQL,
}
