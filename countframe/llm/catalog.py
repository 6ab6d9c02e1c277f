"""The registered queries of the operators, with their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage with ``query`` and ``ORACLE_SQL``
MODULES = {
    "op1_decontaminate": "q1_decontaminate",
    "op2_toxicity": "q2_toxicity",
    "op3_language": "q3_language",
    "op4_mixing": "q4_mixing",
    "op5_linededup": "q5_linededup",
    "op6_quality": "q6_quality",
    "op7_licenses": "q7_licenses",
    "op8_jaccard": "q8_jaccard",
    "op9_chat": "q9_chat",
    "op10_fingerprint": "q10_fingerprint",
    "op11_substrings": "q11_substrings",
    "op12_vectorcode": "q12_vectorcode",
    "op13_runs": "q13_runs",
}


def _module(name: str):
    return importlib.import_module(f"countframe.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: _module(name).ORACLE_SQL for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
