"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import chat, graph, hilbert, hmm, licenses, minhash, mixing, packing, quality, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_hmm": hmm.op2_hmm,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_graph": graph.op8_graph,
    "op9_hilbert": hilbert.op9_hilbert,
    "op10_chat": chat.op10_chat,
}

ORACLE_SQL: dict[str, str] = {"op1_minhash": minhash.ORACLE, "op5_mixing": mixing.ORACLE, "op8_graph": graph.ORACLE, "op9_hilbert": hilbert.ORACLE, "op10_chat": chat.ORACLE}
