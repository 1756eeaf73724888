"""Queries of the text problems (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import leaks, mojibake, tokenize


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_column(table(spark, sf, "documents"))


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.contained_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_matches(spark, sf).select("doc_id", "item_id")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_restored(spark, sf).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_matches, p8_found, p8_restored)}
SQL: dict[str, str] = {}
