"""Queries over deeply nested records (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.operators.flatten import linked_entries, related_tables
from lattica.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_entries(table(spark, sf_dir, "disease_label_to_node_multi"))


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of items with its key."""
    return related_tables(table(spark, sf_dir, "disease_label_to_node_multi"), "item")[0]


def p2_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of all entries with their own and their entry's key."""
    return related_tables(table(spark, sf_dir, "disease_label_to_node_multi"), "property")[0]


def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose JSON breaks off."""
    return related_tables(table(spark, sf_dir, "disease_label_to_node_multi"), "reject")[0]


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_items, p2_properties, p2_rejects)}


def oracle_sql() -> dict[str, str]:
    return {}
