"""The queries of this subpackage, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import lines, media, mixing, quality, rans, rotation, simhash, substrings, token_counts, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_winnowing": winnowing.op2_winnowing,
        "op3_progressive_jpeg": media.op3_progressive_jpeg,
        "op4_rans_tokens": rans.op4_rans_tokens,
        "op5_deletion_neighbourhood": lines.op5_deletion_neighbourhood,
        "op6_pu_quality": quality.op6_pu_quality,
        "op7_perspective_rotation": rotation.op7_perspective_rotation,
        "op8_suffix_array": substrings.op8_suffix_array,
        "op9_pareto_mix": mixing.op9_pareto_mix,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_winnowing": winnowing.WINNOWING_SQL,
        "op7_perspective_rotation": rotation.ROTATION_SQL,
        "op9_pareto_mix": mixing.MIX_SQL.format(docs="documents"),
    }
