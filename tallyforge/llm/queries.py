"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, prefix_trie, topk_search
from .bpe import op3_bpe
from .html_text import op6_html_text
from .jaccard_join import op13_jaccard_join
from .language_id import op9_language_id
from .packing import op2_packing
from .quality import op7_quality
from .quality_rules import op4_quality_rules
from .simhash import op8_simhash
from .substring_dedup import op1_substring_dedup
from .token_files import op5_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_packing": op2_packing,
        "op3_bpe": op3_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_files": op5_token_files,
        "op6_html_text": op6_html_text,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_language_id": op9_language_id,
        "op10_topk": topk_search.op10_topk,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_divergence": divergence.op12_divergence,
        "op13_jaccard_join": op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": topk_search.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_divergence": divergence.ORACLE}
