"""Registry of the core queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators.nested import flatten_exports, piece_keys
from quillspan.plans import oracle_exports, queries_notes, queries_text
from quillspan.session import read

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "p1_found"


def _p1_conversations(spark, d):
    return flatten_exports(read(spark, d, "raw_exports"))["conversations"].distinct()


def _p1_messages(spark, d):
    return flatten_exports(read(spark, d, "raw_exports"))["messages"].distinct()


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda spark, d: piece_keys(read(spark, d, "raw_exports")),
        "p1_conversations": _p1_conversations,
        "p1_messages": _p1_messages,
    } | queries_text.queries() | queries_notes.queries()


def oracle_sql() -> dict[str, str]:
    return queries_text.oracle_sql() | queries_notes.oracle_sql() | oracle_exports.oracle_sql()
