"""Queries of the training-data operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.canonical_duplicates import repeats

    return repeats(table(spark, sf_dir, "nodes"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.canonical_duplicates import collapse

    return collapse(table(spark, sf_dir, "nodes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.name_mapping import map_names

    return map_names(table(spark, sf_dir, "entity_mapping_cache"), table(spark, sf_dir, "ontology_entity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.scan_repair import findings

    return findings(table(spark, sf_dir, "chapter"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.scan_repair import repaired

    return repaired(table(spark, sf_dir, "chapter"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.components import verdict_groups

    return verdict_groups(table(spark, sf_dir, "disease_label_to_node_multi"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.tree_split import boundaries

    return boundaries(table(spark, sf_dir, "chapter"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.tree_split import pieces

    return pieces(table(spark, sf_dir, "chapter"))


def p6_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.tree_split import sections

    return sections(table(spark, sf_dir, "chapter"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.container_fill import fill_documents

    return fill_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.truncation import cut_documents

    return cut_documents(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.truncation import source_shares

    return source_shares(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_collapsed, p3_found, p4_found, p4_text, p5_found, p6_found, p6_pieces, p6_sections, p7_ids, p8_containers, p9_found, p9_shares)
    return {f.__name__: f for f in found}


#: Links of an item's counted nodes, then the smallest node reachable from each, by recursion.
_P5 = """
WITH RECURSIVE e AS (
  SELECT item_id, unnest(mappings) AS m FROM disease_label_to_node_multi
), c AS (
  SELECT DISTINCT item_id, CAST(regexp_extract(m.node_id, '^\\s*(?:node)?[\\s:#n_-]*0*(\\d+)(?:\\.0*)?\\s*$', 1) AS BIGINT) AS v FROM e
  WHERE upper(trim(m.relation_type)) IN ('EXACT', 'MAPS_TO') AND regexp_matches(m.node_id, '^\\s*(?:node)?[\\s:#n_-]*\\d+(?:\\.0*)?\\s*$')
), l AS (
  SELECT DISTINCT a.v AS a, b.v AS b FROM c a JOIN c b USING (item_id)
), r AS (
  SELECT a AS root, a AS v FROM l UNION SELECT r.root, l.b FROM r JOIN l ON r.v = l.a
)
SELECT min(root) AS group_id, v AS node_id FROM r GROUP BY v
"""


#: fold() in SQL: what is neither letter nor digit goes, but for < and >, and points between digits (hidden as chr(1)).
_LOW = r"regexp_replace(lower(COALESCE({c}, '')), '[\p{{Cf}}\x00\x02-\x08\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
_POINTS = r"regexp_replace(regexp_replace({x}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(1) || '\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(1) || '\2', 'g')"
_FIELD = "(?:finding|lead|phase|grade|value)"


def _folded(x: str) -> str:
    return rf"replace(regexp_replace({_POINTS.format(x=x)}, '[^\p{{L}}\p{{Nd}}<>\x01]', '', 'g'), chr(1), '.')"


def _fielded(c: str) -> str:
    """fold_fields() in SQL."""
    low = _LOW.format(c=c)
    parts = rf"string_split(regexp_replace({low}, '(^|[^\p{{L}}\p{{Nd}}])({_FIELD}[\s\x0b\p{{Z}}]*[:=])', '\1' || chr(2) || '\2', 'g'), chr(2))"
    keyed = f"list_transform(list_filter(list_transform({parts}, lambda p: {_folded('p')}), lambda p: p <> ''), lambda p: {{'o': COALESCE(list_position(['finding', 'lead', 'phase', 'grade', 'value'], regexp_extract(p, '^{_FIELD}')), 0), 'p': p}})"
    return rf"CASE WHEN regexp_matches({low}, '^[^\p{{L}}\p{{Nd}}<>]*{_FIELD}[\s\x0b\p{{Z}}]*[:=]') THEN array_to_string(list_transform(list_sort({keyed}), lambda s: s.p), '') ELSE {_folded(low)} END"


_LEGIBLE = r"regexp_matches(COALESCE({c}, ''), '[\p{{L}}\p{{Nd}}]')"
_KEYS = f"""K AS (SELECT node_id, name, node_type, source, CASE WHEN {_LEGIBLE.format(c='name')} AND {_LEGIBLE.format(c='node_type')} THEN least(a, b) || '|' || greatest(a, b) END AS k FROM (SELECT *, {_fielded('name')} AS a, {_fielded('node_type')} AS b FROM nodes))"""
_P1 = f"WITH {_KEYS} SELECT keep_id, CAST(node_id AS BIGINT) AS node_id FROM (SELECT node_id, CAST(min(node_id) OVER (PARTITION BY k) AS BIGINT) AS keep_id FROM K WHERE k IS NOT NULL) WHERE keep_id <> node_id"
_P1_COLLAPSED = f"WITH {_KEYS}, C AS (SELECT min(node_id) AS node_id, count(*) AS copies FROM K WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT node_id, 1 FROM K WHERE k IS NULL) SELECT CAST(node_id AS BIGINT) AS keep_id, copies, name, node_type, source FROM C JOIN K USING (node_id)"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_collapsed": _P1_COLLAPSED, "p5_found": _P5}
