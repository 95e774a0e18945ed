"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_middle, html_text, language, line_dedup, mixing, multiset, packing, quality, shard, simhash, spelling, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ecoc_language": language.op1_ecoc_language,
        "op2_pack": packing.op2_pack,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_mix": mixing.op4_mix,
        "op5_host_paths": html_text.op5_host_paths,
        "op6_line_frequency": quality.op6_line_frequency,
        "op7_token_files": token_files.op7_token_files,
        "op8_multiset_hash": multiset.op8_multiset_hash,
        "op9_simhash": simhash.op9_simhash,
        "op10_virtual_slots": shard.op10_virtual_slots,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_spelling": spelling.op12_spelling,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op6_line_frequency": quality.ORACLE_SQL, "op13_fill_middle": fill_middle.ORACLE_SQL}
