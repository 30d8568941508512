"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideloom.llm.fertility import op1_tokenizer_fertility
from tideloom.llm.licenses import op9_signature_rules
from tideloom.llm.neardup import op2_order_minhash
from tideloom.llm.neighbours import op3_robust_pruned_graph
from tideloom.llm.packing import op6_sum_of_squares_packing
from tideloom.llm.pieces import op10_batched_viterbi
from tideloom.llm.quality import op8_random_indexing_quality
from tideloom.llm.repeats import op5_fingerprint_log
from tideloom.llm.sharding import op7_differencing_shards
from tideloom.llm.sql import BASE_COUNTS, OP4, OP5, PHRASE_PLACES
from tideloom.llm.urls import op4_redirect_equivalence



def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1."""
    return op1_tokenizer_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9."""
    return op9_signature_rules(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokenizer_fertility": op1_tokenizer_fertility,
    "op2_order_minhash": op2_order_minhash,
    "op3_robust_pruned_graph": op3_robust_pruned_graph,
    "op4_redirect_equivalence": op4_redirect_equivalence,
    "op5_fingerprint_log": op5_fingerprint_log,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_differencing_shards": op7_differencing_shards,
    "op8_random_indexing_quality": op8_random_indexing_quality,
    "op9_signature_rules": op9_signature_rules,
    "op10_batched_viterbi": op10_batched_viterbi,
    # what SQL can say of op1 and op9
    "base_counts": base_counts,
    "phrase_places": phrase_places,
}
#: The others run through vocabularies, sketches, graphs, models or a choice of equals; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_redirect_equivalence": OP4, "op5_fingerprint_log": OP5, "base_counts": BASE_COUNTS, "phrase_places": PHRASE_PLACES}
