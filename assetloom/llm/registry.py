"""The queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe_round_trip
from .licenses import OP6_SQL, op6_license_scan
from .neardup import OP3_SQL, op3_near_duplicates
from .packing import op10_best_fit_packing
from .pii import op1_personal_data
from .quality import OP8_SQL, op8_quality_rules
from .qualitymodel import op13_quality_classifier
from .ranking import OP11_SQL, op11_ranked_search
from .suffixdedup import OP4_SQL, op4_suffix_array_dedup
from .tokencount import op5_token_counts
from .topk import OP2_SQL, op2_exact_top_k
from .trie import OP12_SQL, op12_conversation_trie
from .urls import op9_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_personal_data, op2_exact_top_k, op3_near_duplicates, op4_suffix_array_dedup, op5_token_counts, op6_license_scan, op7_bpe_round_trip, op8_quality_rules, op9_url_filter, op10_best_fit_packing, op11_ranked_search, op12_conversation_trie, op13_quality_classifier]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op6_license_scan": OP6_SQL, "op8_quality_rules": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_conversation_trie": OP12_SQL}
