"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from aeris.llm import (ann, byte_bpe, decontamination, licenses, negatives, packing, periodic, pii, sharding, simhash,
                       substrings, toxicity, urls)
from aeris.llm.common import ship_code


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_simhash_anchors": simhash.op1_simhash_anchors,
    "op2_rotated_bits": ann.op2_rotated_bits,
    "op3_minimax_cuts": sharding.op3_minimax_cuts,
    "op4_concat_and_cut": packing.op4_concat_and_cut,
    "op5_disclosure": pii.op5_disclosure,
    "op6_url_vocabulary": urls.op6_url_vocabulary,
    "op7_winnowing": decontamination.op7_winnowing,
    "op8_count_min": substrings.op8_count_min,
    "op9_noisy_channel": toxicity.op9_noisy_channel,
    "op10_minhash_windows": licenses.op10_minhash_windows,
    "op11_merge_replay": byte_bpe.op11_merge_replay,
    "op12_four_russians": negatives.op12_four_russians,
    "op13_block_convolution": periodic.op13_block_convolution,
}.items()}

ORACLE: dict[str, str] = {
    "op3_minimax_cuts": sharding.ORACLE_SQL,
    "op6_url_vocabulary": urls.ORACLE_SQL,
    "op7_winnowing": decontamination.ORACLE_SQL,
    "op8_count_min": substrings.ORACLE_SQL,
    "op10_minhash_windows": licenses.ORACLE_SQL,
    "op12_four_russians": negatives.ORACLE_SQL,
}
