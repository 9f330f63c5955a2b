"""Typing of untyped nodes: candidate predicates, verdicts applied in two stages, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types an alignment may name, with their labels.
TYPE_LABELS = {"diseases": "Disease", "signs_symptoms": "Symptoms", "diagnostic_tests": "DiagnosticTest", "pacing": "PatientCharacteristics", "treatments": "TreatmentIntervention"}
TYPED, FAILED = "TYPED_BY_ONTOLOGY_ALIGNMENT", "FAILED"
MERGED, TYPED_BEFORE = "MERGED_BY_KNOWLEDGE_DISAMBIGUATION", "TYPED_BY_KNOWLEDGE_DISAMBIGUATION"


def untyped(labels: Column) -> Column:
    """Nodes with a single label."""
    return F.size(labels) == 1


def ontology_candidate(ontology_id: Column) -> Column:
    """Nodes that carry an ontology id."""
    return F.coalesce(ontology_id, F.lit("")) != ""


def typed_candidate(labels: Column, ontology_id: Column) -> Column:
    """Nodes that carry an ontology id and more labels than one."""
    return ontology_candidate(ontology_id) & (F.size(labels) > 1)


def apply_alignment(verdicts: DataFrame, key: str, types: dict[str, str] = TYPE_LABELS) -> DataFrame:
    """(key, status, ontology_id, label, target): what an ontology verdict makes of each node.

    verdicts: key, ontology_type, selected_id, selected_node. An unknown type
    fails and changes nothing; without a selected entry or with half of one the
    node gets a temporary id, else the entry's id and an edge to its node.
    """
    kind = F.lower(F.trim("ontology_type"))
    known = kind.isin(*types)
    chosen = (F.trim(F.coalesce("selected_id", F.lit(""))) != "") & F.col("selected_node").isNotNull()
    temp = F.concat(F.lit("TEMP_"), kind, F.lit("_"), F.col(key).cast("string"))
    table = F.create_map(*[F.lit(v) for kv in types.items() for v in kv])
    return verdicts.select(
        key,
        F.when(F.coalesce(known, F.lit(False)), TYPED).otherwise(FAILED).alias("status"),
        F.when(known, F.when(chosen, F.trim("selected_id")).otherwise(temp)).alias("ontology_id"),
        F.try_element_at(table, kind).alias("label"),
        F.when(known & chosen, F.col("selected_node")).alias("target"),
    )


def two_stage_alignment(nodes: DataFrame, disambiguated: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """(key, status): merged or typed by the first stage (key, action), else what the second makes of the node; without any verdict it failed.

    All nodes are judged on one snapshot, so a merge isn't seen by others.
    """
    first = disambiguated.select(key, F.when(F.col("action") == "MERGED", MERGED).when(F.col("action") == "TYPED", TYPED_BEFORE).alias("_first"))
    second = apply_alignment(verdicts, key).select(key, F.col("status").alias("_second"))
    return nodes.select(key).join(first, key, "left").join(second, key, "left").select(key, F.coalesce("_first", "_second", F.lit(FAILED)).alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """(status, n), with the number of all nodes as total_untyped."""
    return statuses.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total_untyped")).alias("status"), "n")
