"""The registered queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, mixing, near_dedup, pages, periodic, quality, rules, secrets, spelling, toxicity, vector_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_rules": rules.op6_rules,
    "op7_html": pages.op7_html,
    "op8_superminhash": near_dedup.op8_superminhash,
    "op9_revisits": warc.op9_revisits,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_vectors": vector_dedup.op12_vectors,
    "op13_periods": periodic.op13_periods,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op8_superminhash": near_dedup.OP8_SQL,
    "op9_revisits": warc.OP9_SQL,
    "op12_vectors": vector_dedup.OP12_SQL,
}
