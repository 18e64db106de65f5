"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, merkle, prefix_trie
from .best_fit import op7_best_fit
from .bpe_lexicon import op9_bpe
from .exact_dedup import op1_exact_dedup
from .license_scan import op8_license_scan
from .merkle import op12_merkle_manifest
from .near_dedup import op4_near_dedup
from .piece_spans import op11_piece_spans
from .pii import op6_pii
from .prefix_trie import op13_prefix_trie
from .quality import op10_quality_rules
from .suffix_tree_lm import op3_suffix_tree_lm
from .toxicity import op5_toxicity
from .url_filter import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_url_filter, op3_suffix_tree_lm, op4_near_dedup, op5_toxicity, op6_pii, op7_best_fit, op8_license_scan, op9_bpe, op10_quality_rules, op11_piece_spans, op12_merkle_manifest, op13_prefix_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op12_merkle_manifest": merkle.SQL, "op13_prefix_trie": prefix_trie.SQL}
