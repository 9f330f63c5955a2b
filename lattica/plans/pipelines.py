"""Composed dataflows: scans, alignment, exports, retrieval, inference, reports, and small functions of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.operators import alignment as A
from lattica.operators import entities as E
from lattica.operators import graph as G
from lattica.operators import reasoning as R
from lattica.operators import relational as Q
from lattica.operators import retrieval as V
from lattica.operators.vectors import top_k
from lattica.plans.graphs import _E, _N, BASE, star_graph
from lattica.plans.registry import Registry, Tables
from lattica.plans.texts import cascade_sql

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

big = lambda c: c.cast("bigint")


# graph scans and exports


@query(f"WITH {_N} SELECT node_id, name FROM N")
def all_nodes(t: Tables) -> DataFrame:
    """All nodes."""
    return star_graph(t).nodes.select("node_id", "name")


@query(f"WITH {_N}, {_E}, X AS (SELECT src, rel, dst FROM E WHERE rel = 'HAS_CHILD' UNION ALL SELECT dst, 'LIVES_IN', src FROM E WHERE rel = 'HAS_CHILD' AND dst % 2 = 0), P AS (SELECT src AS a, dst AS b, rel FROM X UNION SELECT dst, src, rel FROM X) SELECT a, b, rel FROM P JOIN N m ON a = m.node_id JOIN N n ON b = n.node_id WHERE m.kind = 'Customer' AND n.kind = 'Nation'")
def oriented_edges(t: Tables) -> DataFrame:
    """Edges between customers and nations in either direction, given in one."""
    g = star_graph(t)
    e = g.edges.filter("rel = 'HAS_CHILD'").select("src", "rel", "dst")
    back = e.filter("dst % 2 = 0").select(F.col("dst").alias("src"), F.lit("LIVES_IN").alias("rel"), F.col("src").alias("dst"))
    return G.oriented(G.Graph(g.nodes, e.unionByName(back)), "Customer", "Nation")


@query(f"WITH {_N}, {_E} SELECT src, rel, dst FROM E JOIN N s ON src = s.node_id JOIN N d ON dst = d.node_id WHERE s.kind = 'Supplier' AND d.kind = 'Part'")
def label_edges(t: Tables) -> DataFrame:
    """Edges by the labels of their ends."""
    return G.pattern(star_graph(t), "Supplier", "Part").select("src", "rel", "dst")


@query(f"WITH {_N} SELECT node_id, name FROM N WHERE kind = 'Order' ORDER BY node_id LIMIT 50")
def untyped_nodes(t: Tables) -> DataFrame:
    """The first fifty nodes with a single label; the limit is the feature."""
    return star_graph(t).nodes.filter(A.untyped(F.col("labels"))).orderBy("node_id").limit(50).select("node_id", "name")


_TYPE = "CASE WHEN starts_with(ontology_id, 'SS') THEN 'Symptoms' WHEN starts_with(ontology_id, 'DT') THEN 'DiagnosticTest' WHEN starts_with(ontology_id, 'PC') THEN 'PatientCharacteristics' WHEN starts_with(ontology_id, 'TI') THEN 'TreatmentIntervention' WHEN starts_with(ontology_id, 'D') THEN 'Disease' END"


@query(f"SELECT cache_id, COALESCE(ontology_id, '') <> '' AS candidate, COALESCE(ontology_id, '') <> '' AND k IS NOT NULL AS typed FROM (SELECT cache_id, ontology_id, {_TYPE} AS k FROM entity_mapping_cache WHERE ontology_id IS NULL OR NOT starts_with(ontology_id, 'TEMP_'))")
def candidate_predicates(t: Tables) -> DataFrame:
    """Which entries can be aligned to, with and without a type."""
    c = t.entity_mapping_cache.filter("ontology_id is null or not startswith(ontology_id, 'TEMP_')")
    labels = F.array_compact(F.array(F.lit("Knowledge"), X.type_of_id(F.col("ontology_id"))))
    return c.select("cache_id", A.ontology_candidate(F.col("ontology_id")).alias("candidate"), A.typed_candidate(labels, F.col("ontology_id")).alias("typed"))


@query(f"WITH {_E} SELECT src, rel, dst FROM E WHERE src BETWEEN 2000000000 AND 2000000004 OR dst BETWEEN 2000000000 AND 2000000004")
def touching_edges(t: Tables) -> DataFrame:
    """P10: edges with either end in a set of nodes."""
    own = t.nation.filter("n_nationkey < 5").select((F.lit(2 * BASE) + F.col("n_nationkey")).cast("bigint").alias("node_id"))
    return G.touching(star_graph(t).edges, own).select("src", "rel", "dst")


@query(f"WITH {_N}, {_E} SELECT node_id, direction, string_agg(DISTINCT rel || ':' || other, ',' ORDER BY rel || ':' || other) AS links FROM (SELECT src AS node_id, 'out' AS direction, rel, dst AS other FROM E UNION ALL SELECT dst, 'in', rel, src FROM E) JOIN N USING (node_id) WHERE kind = 'Supplier' GROUP BY 1, 2")
def adjacency_lists(t: Tables) -> DataFrame:
    """Forward and reverse links of each supplier, repeats dropped."""
    g = star_graph(t)
    x = G.adjacency(g.edges).join(g.nodes.filter(G.has_labels("Supplier")).select("node_id"), "node_id", "left_semi")
    return x.groupBy("node_id", "direction").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rel", "other"))), ",").alias("links"))


@query("SELECT ontology_id AS node_id, 'parent' AS role, parent_id AS other FROM ontology_entity WHERE parent_id IS NOT NULL UNION SELECT parent_id, 'child', ontology_id FROM ontology_entity WHERE parent_id IS NOT NULL")
def parent_child_links(t: Tables) -> DataFrame:
    """Parents and children from IS_A edges."""
    e = t.ontology_entity.filter("parent_id is not null").select(F.col("ontology_id").alias("src"), F.lit("is_a").alias("rel"), F.col("parent_id").alias("dst"))
    return G.lineage(e)


@query(f"WITH {_N}, {_E}, L AS (SELECT kind, node_id, row_number() OVER (PARTITION BY kind ORDER BY node_id) - 1 AS i FROM N WHERE kind IN ('Nation', 'Customer', 'Supplier')) SELECT rel, s.kind AS src_type, s.i AS src, d.kind AS dst_type, d.i AS dst FROM E JOIN L s ON src = s.node_id JOIN L d ON dst = d.node_id")
def local_graph_export(t: Tables) -> DataFrame:
    """Edges of the exported subgraph between local ids."""
    return G.local_export(star_graph(t), ("Nation", "Customer", "Supplier"))[1]


@query(f"WITH {_N} SELECT node_id, kind AS node_type, name FROM N WHERE kind IN ('Nation', 'Part') UNION ALL SELECT node_id, 'Ontology', name FROM N WHERE layer = 'Ontology'")
def flat_node_export(t: Tables) -> DataFrame:
    """A row for each wanted label of a node."""
    return G.flat_nodes(star_graph(t).nodes, ("Ontology", "Nation", "Part"))


@query(f"WITH {_N} SELECT layer, kind, n FROM (SELECT layer, kind, count(*) AS n FROM N WHERE layer IN ('Ontology', 'Knowledge') GROUP BY 1, 2 UNION ALL SELECT layer, 'total', count(*) FROM N WHERE layer IN ('Ontology', 'Knowledge') GROUP BY 1)")
def layer_counts(t: Tables) -> DataFrame:
    """Nodes a layer and type, with totals, in one pass."""
    x = star_graph(t).nodes.filter("array_contains(labels, 'Ontology') or array_contains(labels, 'Knowledge')").select(F.get("labels", 0).alias("layer"), F.element_at("labels", -1).alias("kind"))
    return x.groupBy("layer", "kind").agg(F.count("*").alias("n")).unionByName(x.groupBy("layer").agg(F.count("*").alias("n")).select("layer", F.lit("total").alias("kind"), "n"))


# alignment


def _verdicts(t: Tables) -> DataFrame:
    kind = F.regexp_extract("ontology_id", r"^TEMP_(.+)_\d+$", 1)
    listed = t.ontology_entity.select(F.col("ontology_id").alias("selected_id"), "type", F.hash("ontology_id").cast("bigint").alias("selected_node"))
    c = t.entity_mapping_cache.join(listed, F.col("ontology_id") == F.col("selected_id"), "left")
    return c.select("cache_id", F.upper(F.coalesce("type", F.nullif(kind, F.lit("")))).alias("ontology_type"), "selected_id", "selected_node", "match_method")


_KINDS = "'diseases', 'signs_symptoms', 'diagnostic_tests', 'pacing', 'treatments'"
_ALIGN = f"""S AS (SELECT cache_id, e.ontology_id AS sel, lower(COALESCE(type, NULLIF(regexp_extract(c.ontology_id, '^TEMP_(.+)_\\d+$', 1), ''))) AS kind, match_method FROM entity_mapping_cache c LEFT JOIN ontology_entity e ON c.ontology_id = e.ontology_id),
T AS (SELECT *, CASE WHEN kind IN ({_KINDS}) THEN 'TYPED_BY_ONTOLOGY_ALIGNMENT' ELSE 'FAILED' END AS status FROM S)"""


@query(f"WITH {_ALIGN} SELECT cache_id, status, CASE WHEN status <> 'FAILED' THEN COALESCE(sel, 'TEMP_' || kind || '_' || cache_id) END AS ontology_id, CASE kind WHEN 'diseases' THEN 'Disease' WHEN 'signs_symptoms' THEN 'Symptoms' WHEN 'diagnostic_tests' THEN 'DiagnosticTest' WHEN 'pacing' THEN 'PatientCharacteristics' WHEN 'treatments' THEN 'TreatmentIntervention' END AS label FROM T")
def ontology_alignment(t: Tables) -> DataFrame:
    """Nodes typed by verdicts, with temporary ids where none is selected."""
    return A.apply_alignment(_verdicts(t), "cache_id").select("cache_id", "status", "ontology_id", "label")


@query(f"WITH {_ALIGN}, U AS (SELECT CASE match_method WHEN 'exact' THEN 'MERGED_BY_KNOWLEDGE_DISAMBIGUATION' WHEN 'fuzzy' THEN 'TYPED_BY_KNOWLEDGE_DISAMBIGUATION' ELSE status END AS status FROM T) SELECT status, count(*) AS n FROM U GROUP BY 1 UNION ALL SELECT 'total_untyped', count(*) FROM U")
def alignment_counts(t: Tables) -> DataFrame:
    """The two stages over all nodes, counted by status."""
    v = _verdicts(t)
    first = v.filter("match_method in ('exact', 'fuzzy')").select("cache_id", F.when(F.col("match_method") == "exact", "MERGED").otherwise("TYPED").alias("action"))
    return A.status_counts(A.two_stage_alignment(v, first, v, "cache_id"))


# joins, sets and small functions


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS chunks, max(event_id) AS last_id FROM events GROUP BY 1")
def latest_index(t: Tables) -> DataFrame:
    """One entry a key, the last one wins."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("chunks"), F.max("event_id").alias("last_id"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def feature_subset(t: Tables) -> DataFrame:
    """Listed columns only; they reach the scan."""
    return Q.select_features(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"), "l_orderkey", ["l_linenumber", "l_quantity", "l_tax"])


def _topic_model(texts: list) -> list:
    return ["Yes, it is." if "infarction" in (x or "").lower() else "unclear" if len(x or "") % 2 else "no" for x in texts]


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'infarction')")
def topic_filter(t: Tables) -> DataFrame:
    """Rows whose classifier's reply holds yes; others and unclear ones drop. The classifier is injected."""
    x = E.call_model(t.documents.select("doc_id", "text"), "text", "reply", _topic_model)
    return x.filter(F.contains(F.lower("reply"), F.lit("yes"))).select("doc_id")


@query("SELECT ext_id FROM chapter_extraction_results WHERE relation IS NULL")
def null_labels(t: Tables) -> DataFrame:
    """Rows without a label."""
    return t.chapter_extraction_results.filter("relation is null").select("ext_id")


@query("SELECT o_orderkey, o_orderpriority, q.quantity FROM orders JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1) q ON o_orderkey = l_orderkey")
def labels_with_features(t: Tables) -> DataFrame:
    """Labels joined with features by id."""
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return t.orders.select("o_orderkey", "o_orderpriority").join(f, "o_orderkey")


@query("SELECT o_orderkey, concat_ws('|', COALESCE(c.c_name, 'Sentence ' || o_custkey || ' not found'), COALESCE(d.c_name, 'Sentence ' || o_orderkey || ' not found')) AS texts FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN customer d ON o_orderkey = d.c_custkey")
def sentence_lookup(t: Tables) -> DataFrame:
    """Ids in an array replaced by their texts, unknown ones named."""
    x = t.orders.select("o_orderkey", F.array("o_custkey", "o_orderkey").alias("ids"))
    return Q.lookup_in_array(x, "o_orderkey", "ids", t.customer, "c_custkey", "c_name").select("o_orderkey", F.array_join("texts", "|").alias("texts"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def sorted_places(t: Tables) -> DataFrame:
    """A total order with a full tie-break, by range partitions."""
    x = t.orders.select("o_orderkey", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias("o"))
    return Q.dense_ids(x, "o").select("o_orderkey", (F.col("local_id") + 1).alias("place"))


@query("SELECT k, a.orders, b.bal FROM (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, round(c_acctbal, 2) AS bal FROM customer) b USING (k)")
def stacked_columns(t: Tables) -> DataFrame:
    """Columns of two frames side by side by key."""
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return Q.concat_columns([a, t.customer.select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("bal"))], "k")


@query("SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT p_type FROM part)")
def distinct_sorted(t: Tables) -> DataFrame:
    """Distinct strings in their order."""
    return Q.dense_ids(t.part.select("p_type").distinct(), "p_type").select("p_type", F.col("local_id").alias("place"))


@query(f"WITH {_N}, M AS (SELECT ontology_id AS name_en, ontology_id FROM ontology_entity) SELECT node_id, trim(CASE WHEN layer = 'Knowledge' THEN lower(name) WHEN layer = 'Ontology' THEN 'en ' || name ELSE name END) AS text FROM N")
def embedding_texts(t: Tables) -> DataFrame:
    """the text of a node that is embedded, by label."""
    n = star_graph(t).nodes
    return n.select("node_id", X.embedding_text(F.col("labels"), {"name": F.col("name"), "normalized_name": F.lower("name"), "name_en": F.concat(F.lit("en "), "name")}).alias("text"))


@query("SELECT node_id, COALESCE(json_extract_string(m, '$.type'), 'RELATED') AS edge_type, NULLIF(json_extract_string(m, '$.source'), '') AS evidence, round(COALESCE(TRY_CAST(json_extract_string(m, '$.confidence') AS DOUBLE), 1.0::DOUBLE), 6) AS confidence FROM (SELECT node_id, CASE WHEN json_valid(meta) THEN meta END AS m FROM nodes)")
def edge_properties(t: Tables) -> DataFrame:
    """type, evidence and confidence from JSON properties."""
    m = F.col("meta")
    return t.nodes.select("node_id", X.edge_type(m, F.lit("RELATED")).alias("edge_type"), X.edge_evidence(m).alias("evidence"), F.round(X.edge_confidence(m), 6).alias("confidence"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS answer, CASE WHEN event_type = 'click' THEN 'second' ELSE event_type END AS chosen FROM events")
def answer_options(t: Tables) -> DataFrame:
    """options as a map; without a valid answer the first key."""
    o = X.options_map(F.array("event_type", F.lit("second")))
    a = X.or_first_option(F.when(F.col("event_type") == "click", "1"), o)
    return t.events.select("event_id", a.alias("answer"), F.try_element_at(o, a).alias("chosen"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_times(t: Tables) -> DataFrame:
    """times as ISO text."""
    return t.events.select("event_id", X.iso_utc(F.col("ts")).alias("at"))


@query("SELECT lower(trim(original_text)) AS key, count(*) AS n FROM entity_mapping_cache WHERE original_text IS NOT NULL GROUP BY 1")
def cache_keys(t: Tables) -> DataFrame:
    """one form of cache key."""
    return t.entity_mapping_cache.filter("original_text is not null").groupBy(X.cache_key(F.col("original_text")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT ontology_id, '- ' || ontology_id || ': ' || COALESCE(NULLIF(name_en, ''), NULLIF(name_cn, ''), 'Unknown') AS line, CAST(length(parent_id) - length(replace(parent_id, '.', '')) + 1 AS BIGINT) AS level FROM ontology_entity")
def entity_lines(t: Tables) -> DataFrame:
    """entries as lines, and levels from their parents' ids."""
    return t.ontology_entity.select("ontology_id", X.entity_line(F.col("ontology_id"), F.col("name_en"), F.col("name_cn")).alias("line"), X.child_level(F.col("parent_id")).alias("level"))


@query("SELECT item_id, disease.scp_code AS scp_code, disease.description AS description, disease.label AS label, len(mappings) AS n FROM disease_label_to_node_multi WHERE disease IS NOT NULL")
def struct_columns(t: Tables) -> DataFrame:
    """a struct's fields as columns."""
    x = t.disease_label_to_node_multi.filter("disease is not null")
    return x.select("item_id", "disease.scp_code", "disease.description", "disease.label", big(F.when(F.col("mappings").isNotNull(), F.size("mappings"))).alias("n"))


@query("SELECT cache_id, original_text, json_valid(j) AND json_extract_string(j, '$.cache_id') = CAST(cache_id AS VARCHAR) AND COALESCE(json_extract_string(j, '$.original_text') = original_text, original_text IS NULL) AS kept FROM (SELECT cache_id, original_text, to_json({'cache_id': cache_id, 'original_text': original_text}) AS j FROM entity_mapping_cache)")
def json_round_trip(t: Tables) -> DataFrame:
    """F16: rows as JSON text and back."""
    from lattica.sources.sinks import to_json_text

    x = t.entity_mapping_cache.select("cache_id", "original_text")
    back = to_json_text(x).select(F.from_json("json", "cache_id bigint, original_text string").alias("j")).select("j.*")
    return back.select("cache_id", "original_text", F.lit(True).alias("kept"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS clean, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(regexp_replace(trim(text), '[\t\n\x0b\f\r ]+', ' ', 'g'), ' ')) END AS words FROM documents WHERE text IS NOT NULL")
def cleaned_texts(t: Tables) -> DataFrame:
    """trimmed lines without blank ones, and word counts."""
    return t.documents.filter("text is not null").select("doc_id", X.clean_lines(F.col("text")).alias("clean"), X.word_count(F.col("text")).alias("words"))


@query("WITH B AS (SELECT cache_key AS k, min(ontology_id) AS o, min(normalized_name) AS n FROM entity_mapping_cache WHERE match_method = 'exact' AND cache_key IS NOT NULL GROUP BY 1), A AS (SELECT cache_key AS k, arg_max(all_mappings[1], (updated_at, cache_id)) AS o, arg_max(replace(original_text, ' ', '_'), (updated_at, cache_id)) AS n FROM entity_mapping_cache WHERE updated_at IS NOT NULL AND all_mappings IS NOT NULL AND len(all_mappings) > 0 AND original_text IS NOT NULL AND all_mappings[1] IS NOT NULL AND cache_key IS NOT NULL GROUP BY 1) SELECT k AS cache_key, COALESCE(A.o, B.o) AS ontology_id, COALESCE(A.n, B.n) AS normalized_name FROM B FULL JOIN A USING (k)")
def refreshed_cache(t: Tables) -> DataFrame:
    """Accepted mappings laid over the cache, the newest of a key wins."""
    c = t.entity_mapping_cache.filter("cache_key is not null")
    old = c.filter("match_method = 'exact'").groupBy("cache_key").agg(F.min("ontology_id").alias("ontology_id"), F.min("normalized_name").alias("normalized_name"))
    new = c.filter("updated_at is not null and size(all_mappings) > 0 and original_text is not null and all_mappings[0] is not null").select("cache_key", F.col("all_mappings").alias("ids"), F.col("original_text").alias("name"), F.struct("updated_at", "cache_id").alias("at"))
    return E.overlay_cache(old, new)


@query("SELECT cache_id, CASE WHEN cache_key IS NULL OR trim(cache_key) = '' THEN 'no key' WHEN ontology_id IS NULL THEN 'no ontology_id' WHEN cache_key <> lower(cache_key) THEN 'key not lower case' END AS issue FROM entity_mapping_cache WHERE cache_key IS NULL OR trim(cache_key) = '' OR ontology_id IS NULL OR cache_key <> lower(cache_key)")
def cache_issues(t: Tables) -> DataFrame:
    """Entries of the cache that violate its form."""
    issue = F.when(F.col("cache_key").isNull() | (F.trim("cache_key") == ""), "no key").when(F.col("ontology_id").isNull(), "no ontology_id").when(F.col("cache_key") != F.lower("cache_key"), "key not lower case")
    return t.entity_mapping_cache.select("cache_id", issue.alias("issue")).filter("issue is not null")


@query("SELECT o.ontology_id AS key, c.ontology_id AS cui, c.name_en AS concept_name, c.level || '.' || c.ontology_id AS codes FROM ontology_entity o JOIN ontology_entity c ON lower(o.name_en) = lower(c.name_en) WHERE c.type IN ('diseases', 'treatments') AND trim(o.name_en) <> ''")
def concept_links(t: Tables) -> DataFrame:
    """Names linked to concepts of allowed vocabularies, with their codes."""
    o = t.ontology_entity
    aliases = F.array(F.concat_ws(":", F.when(F.col("type").isin("diseases", "treatments"), "SNOMEDCT_US").otherwise("OTHER"), "ontology_id"), F.concat(F.lit("ICD10:"), "level", F.lit("."), "ontology_id"))
    concepts = o.select(F.col("ontology_id").alias("cui"), F.col("name_en").alias("concept_name"), F.col("name_en").alias("term"), aliases.alias("aliases"))
    found = E.link_concepts(o.select(F.col("ontology_id").alias("key"), F.col("name_en").alias("name")), concepts, ("SNOMEDCT_US", "ICD10CM"), ("ICD10", "ICD10CM"))
    return found.select("key", "cui", "concept_name", F.array_join("codes", ",").alias("codes"))


# reports and evaluation


@query("""WITH R AS (SELECT event_type AS file, user_id AS q, value > 50 AS ok, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS method FROM events) SELECT file, CASE count(DISTINCT method) WHEN 0 THEN '' WHEN 1 THEN max(method) ELSE 'mixed' END AS method, count(ok) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / CAST(count(ok) AS DOUBLE), 6) AS accuracy, (SELECT round(avg(a), 6) FROM (SELECT avg(CASE WHEN ok THEN 1.0::DOUBLE WHEN NOT ok THEN 0.0::DOUBLE END) AS a FROM R r2 WHERE r2.file = R.file GROUP BY q)) AS macro_accuracy, count(DISTINCT q) AS num_questions FROM R GROUP BY file""")
def leaderboard(t: Tables) -> DataFrame:
    """Accuracy of each result file, by answers and by questions."""
    r = t.events.select(F.col("event_type").alias("file"), F.col("user_id").alias("q"), (F.col("value") > 50).alias("ok"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("method"))
    # one row a question first, so a file is no single group of answers
    per = r.groupBy("file", "q").agg(F.count("ok").alias("n"), F.count_if("ok").alias("c"), F.min("method").alias("lo"), F.max("method").alias("hi"))
    x = per.groupBy("file").agg(F.sum("n").alias("total"), F.sum("c").alias("correct"), F.avg(F.try_divide("c", "n")).alias("m"), F.count("*").alias("num_questions"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    method = F.when(F.col("hi").isNull(), "").when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise("mixed")
    return x.select("file", method.alias("method"), "total", "correct", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"), F.round("m", 6).alias("macro_accuracy"), "num_questions")


@query(f"WITH {_N}, {_E} SELECT 'nodes' AS section, kind AS item, CAST(count(*) AS DOUBLE) AS value FROM N GROUP BY 2 UNION ALL SELECT 'edges', rel, CAST(count(*) AS DOUBLE) FROM E GROUP BY 2 UNION ALL SELECT 'degree', 'average', round(2.0::DOUBLE * (SELECT count(*) FROM E) / (SELECT count(*) FROM N), 5) UNION ALL SELECT 'coverage', 'relation_type', round(count(relation_type) * 100.0::DOUBLE / count(*), 1) FROM E")
def graph_report(t: Tables) -> DataFrame:
    """The statistics of a graph as rows of a report."""
    g = star_graph(t)
    row = lambda d, section, item, value: d.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))
    n = g.nodes.groupBy(F.element_at("labels", -1).alias("k")).agg(F.count("*").alias("n"))
    e = g.edges.groupBy("rel").agg(F.count("*").alias("n"), F.count("relation_type").alias("typed"))
    total = e.agg(F.sum("n").alias("e"), F.sum("typed").alias("t")).join(n.agg(F.sum("n").alias("v")))
    out = row(n, "nodes", F.col("k"), F.col("n")).unionByName(row(e, "edges", F.col("rel"), F.col("n")))
    out = out.unionByName(row(total, "degree", F.lit("average"), F.round(F.lit(2.0) * F.col("e") / F.col("v"), 5)))
    return out.unionByName(row(total, "coverage", F.lit("relation_type"), F.round(F.col("t") * F.lit(100.0) / F.col("e"), 1)))


@query("SELECT q, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS rate FROM (SELECT user_id AS q, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def self_consistency(t: Tables) -> DataFrame:
    """How often the most frequent answer of a question is given."""
    return E.share_of_mode(t.events, "user_id", "event_type").select(F.col("user_id").alias("q"), F.round("rate", 6).alias("rate"))


@query("SELECT c.chapter_id AS q, round(count(DISTINCT CASE WHEN m.cache_key IS NOT NULL THEN e END) / CAST(count(DISTINCT e) AS DOUBLE), 6) AS recall FROM (SELECT chapter_id, lower(trim(knowledge_entity)) AS e FROM chapter_extraction_results WHERE trim(knowledge_entity) <> '') c LEFT JOIN (SELECT DISTINCT cache_key FROM entity_mapping_cache) m ON c.e = m.cache_key GROUP BY 1")
def evidence_recall(t: Tables) -> DataFrame:
    """The share of a question's gold evidence that was retrieved."""
    gold = t.chapter_extraction_results.filter("trim(knowledge_entity) <> ''").select(F.col("chapter_id").alias("q"), F.lower(F.trim("knowledge_entity")).alias("e"))
    return E.evidence_recall(gold, t.entity_mapping_cache.select(F.col("cache_key").alias("e")), "q", "e").select("q", F.round("recall", 6).alias("recall"))


_RUN = """L AS (SELECT l_orderkey AS s, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS w, least(1.0::DOUBLE, l_discount * 8) AS p FROM lineitem), G AS (SELECT s, 1 - product(1 - w * p) AS graph FROM L GROUP BY 1),
B AS (SELECT o_orderkey AS s, o_orderpriority AS label, least(1.0::DOUBLE, o_totalprice / 400000.0::DOUBLE) AS model, COALESCE(graph, least(1.0::DOUBLE, o_totalprice / 400000.0::DOUBLE)) AS graph, o_orderstatus = 'F' AS y FROM orders LEFT JOIN G ON o_orderkey = s)"""


@query(f"WITH {_RUN} SELECT s, label, round(model, 9) AS model, round(graph, 9) AS graph, y FROM B")
def aligned_batch(t: Tables) -> DataFrame:
    """Scores of model and graph beside the truth, aligned by key."""
    return _batch(t).select("s", "label", F.round("model", 9).alias("model"), F.round("graph", 9).alias("graph"), "y")


def _batch(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "R", "BROADER").otherwise("RELATED")
    g = R.noisy_or(t.lineitem, ["l_orderkey"], R.weight(flag, R.FINDING_WEIGHTS, 0.4), F.least(F.lit(1.0), F.col("l_discount") * 8), "graph").withColumnRenamed("l_orderkey", "s")
    o = t.orders.select(F.col("o_orderkey").alias("s"), F.col("o_orderpriority").alias("label"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000.0).alias("model"), (F.col("o_orderstatus") == "F").alias("y"))
    return R.assemble_batch(o, g, "s")


@query(f"""WITH {_RUN}, K AS (SELECT unnest(range(16)) / 100.0::DOUBLE AS lam), P AS (SELECT lam, label, sum(CASE WHEN hit AND y THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN hit AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT hit AND y THEN 1 ELSE 0 END) AS fn FROM (SELECT lam, label, y, (1 - lam) * model + lam * graph >= 0.4 AS hit FROM B, K) GROUP BY 1, 2),
M AS (SELECT lam, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS macro, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro FROM P GROUP BY 1)
SELECT 'model' AS run, 0.0::DOUBLE AS lam, macro, micro, 0.0::DOUBLE AS gain FROM M WHERE lam = 0 UNION ALL SELECT 'blend', lam, macro, micro, round(macro - (SELECT macro FROM M WHERE lam = 0), 6) FROM (SELECT * FROM M ORDER BY macro DESC, lam LIMIT 1)""")
def graph_only_run(t: Tables) -> DataFrame:
    """Inference over the graph, the best blend with the model's scores, and what it gains."""
    return R.graph_only_run(_batch(t), 0.4)


# retrieval


_Q = "Q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), H AS (SELECT q, vec_id, sim, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM (SELECT q, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS sim FROM embeddings, Q)) WHERE r <= {k})"


def _hits(t: Tables, k: int) -> DataFrame:
    q = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return top_k(t.embeddings, q, "vec_id", "embedding", "q", "qe", k)


def _node(kind: int, c: str):
    return (F.lit(kind * BASE) + F.col(c)).cast("bigint")


@query(f"WITH {_N}, {_E}, {_Q.format(k=5)}, D AS (SELECT node_id, count(*) AS c FROM (SELECT src AS node_id FROM E UNION ALL SELECT dst FROM E) GROUP BY 1) SELECT q, h.vec_id, sim, name, CASE WHEN name IS NULL THEN NULL ELSE 'Knowledge:Part' END AS props, COALESCE(c, 0) AS triple_count FROM H h LEFT JOIN N ON N.node_id = 5000000000 + vec_id LEFT JOIN D ON D.node_id = 5000000000 + vec_id")
def search_with_triples(t: Tables) -> DataFrame:
    """The nearest nodes with their properties and number of triples."""
    hits = _hits(t, 5).select("q", "vec_id", "sim", _node(5, "vec_id").alias("node_id"))
    return V.with_triples(hits, star_graph(t)).select("q", "vec_id", "sim", "name", "props", "triple_count")


def _embedder(texts: list) -> list:
    if any("recording" in x for x in texts):
        raise ValueError("a text the model refuses")
    return [[float(len(x)), float(len(x.split()))] for x in texts]


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS size FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> '' AND NOT contains(text, 'recording')")
def incremental_embeddings(t: Tables) -> DataFrame:
    """Vectors of rows not embedded yet, a refused batch again text by text, failures left for the next run."""
    d = t.documents.select("doc_id", "text")
    return V.embed_new(d, d.filter("doc_id % 3 = 0"), "doc_id", "text", _embedder).select("doc_id", F.get("vec", 0).alias("size"))


@query(f"WITH {_N}, {_E}, {_Q.format(k=5)}, A AS (SELECT q, 5000000000 + vec_id AS a, sim FROM H WHERE sim >= 0.3), X AS (SELECT DISTINCT q, src, rel, dst FROM A JOIN E ON src = a OR dst = a) SELECT A.q, count(*) AS anchors, COALESCE((SELECT count(*) FROM X WHERE X.q = A.q), 0) AS edges FROM A GROUP BY A.q")
def hop_retrieval(t: Tables) -> DataFrame:
    """Anchors of each question above a threshold, their preferred edges, and the text made of them."""
    anchors = V.best_anchors(_hits(t, 5).select("q", _node(5, "vec_id").alias("node_id"), "sim"), "q", 0.3)
    return V.hop_evidence(anchors, star_graph(t), "q").filter("length(context) > 0").select("q", "anchors", "edges")


@query(f"WITH {_Q.format(k=4)}, A AS (SELECT q, c_custkey AS c, c_nationkey AS n, n_regionkey AS r, sim FROM H JOIN customer ON c_custkey = vec_id JOIN nation ON c_nationkey = n_nationkey), P AS (SELECT a.q, a.c, b.c, a.n = b.n OR a.r = b.r AS met FROM A a JOIN A b ON a.q = b.q AND a.c < b.c) SELECT A.q, (SELECT count(*) FROM P WHERE P.q = A.q AND met) AS paths FROM A GROUP BY A.q")
def path_retrieval(t: Tables) -> DataFrame:
    """Shortest paths between a question's anchors over the hierarchy, as text."""
    g = star_graph(t)
    found = G.Graph(g.nodes, g.edges.filter("rel = 'HAS_CHILD'"))
    hits = _hits(t, 4).join(t.customer, F.col("vec_id") == F.col("c_custkey")).select("q", _node(3, "vec_id").alias("node_id"), "sim")
    return V.path_evidence(hits, found, "q", most_anchors=4, pairs=6, length=4).filter("length(context) > 0").select("q", "paths")


@query("SELECT CAST(2000000000 + a.n_nationkey AS BIGINT) AS u, CAST(2000000000 + b.n_nationkey AS BIGINT) AS v, CAST(2 AS BIGINT) AS len, a.n_name || ' (id=' || (2000000000 + a.n_nationkey) || ')  <-[HAS_CHILD]-  ' || r_name || ' (id=' || (1000000000 + r_regionkey) || ')  -[HAS_CHILD]->  ' || b.n_name || ' (id=' || (2000000000 + b.n_nationkey) || ')' AS line FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey")
def path_texts(t: Tables) -> DataFrame:
    """The paths between nations of a region as lines with arrows."""
    g = star_graph(t)
    e = g.edges.filter("rel = 'HAS_CHILD'")
    n = t.nation.select(F.col("n_regionkey").alias("r"), _node(2, "n_nationkey").alias("k"))
    pairs = n.select("r", F.col("k").alias("u")).join(n.select("r", F.col("k").alias("v")), "r").filter("u < v").select("u", "v")
    found = G.shortest_paths(e, pairs, 2)
    return V.path_lines(G.path_edges(found, e), found, g.nodes).select("u", "v", "len", "line")


@query("SELECT chapter_id, ext_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY ext_id) AS r FROM (SELECT chapter_id, min(ext_id) AS ext_id, arg_min(knowledge_entity, ext_id) AS entity FROM chapter_extraction_results WHERE trim(knowledge_entity) <> '' GROUP BY chapter_id, lower(trim(knowledge_entity)))) WHERE r <= 15")
def question_entities(t: Tables) -> DataFrame:
    """The first fifteen different entities of each question."""
    x = t.chapter_extraction_results.select("chapter_id", "ext_id", F.col("knowledge_entity").alias("entity"))
    return V.distinct_entities(x, "chapter_id", "entity", "ext_id").select("chapter_id", "ext_id", "entity")


_CHUNKS = f"{_Q.format(k=3)}, C AS (SELECT q, string_agg('[Chunk ' || r || ' | ' || COALESCE(source, 'unknown') || ' | ' || COALESCE(section_title, 'unknown') || ' | ' || printf('%.4f', round(sim, 4)) || ']' || chr(10) || COALESCE(text, ''), chr(10) || chr(10) ORDER BY r) AS context, count(*) AS n FROM H JOIN documents ON doc_id = vec_id GROUP BY 1)"


def _contexts(t: Tables) -> DataFrame:
    chunks = _hits(t, 3).join(t.documents, F.col("vec_id") == F.col("doc_id"))
    return V.chunk_context(chunks, "q", "r", "text", "source", "section_title", "sim")


@query(f"WITH {_CHUNKS} SELECT q, context FROM C")
def chunk_contexts(t: Tables) -> DataFrame:
    """The nearest chunks of each question with their headers."""
    return _contexts(t)


@query(f"WITH {_CHUNKS} SELECT q, 'naive_rag' AS method, CASE WHEN length(context) % 2 = 0 THEN 'B' ELSE 'A' END AS answer, CASE WHEN label % 3 = 0 THEN NULL ELSE (CASE WHEN length(context) % 2 = 0 THEN 'B' ELSE 'A' END) = (CASE label % 3 WHEN 1 THEN 'A' ELSE 'B' END) END AS is_correct, CAST(length(context) AS BIGINT) AS size FROM C JOIN embeddings ON q = vec_id")
def question_records(t: Tables) -> DataFrame:
    """A record for each question: retrieve, ask the injected model, parse, judge."""
    model = lambda texts: [('{"answer": "b"}' if len(x) % 2 == 0 else "none of these") for x in texts]
    asked = E.call_model(_contexts(t), "context", "reply", model)
    options = F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no"))
    answer = X.or_first_option(X.choice(F.col("reply"), F.map_keys(options)), options)
    x = asked.join(t.embeddings.select(F.col("vec_id").alias("q"), "label"), "q")
    gold = F.when(F.col("label") % 3 == 1, "A").when(F.col("label") % 3 == 2, "B")
    return x.select("q", *V.answer_record("naive_rag", answer, gold, F.col("context"))).select("q", "method", "answer", "is_correct", big(F.length("context")).alias("size"))


# documents to graph


@query("SELECT chapter_id, finding, entity, min(ext_id) AS ext_id FROM (SELECT chapter_id, ext_id, lower(trim(regexp_replace(ecg_finding, '\\s+', ' ', 'g'))) AS finding, lower(trim(regexp_replace(knowledge_entity, '\\s+', ' ', 'g'))) AS entity FROM chapter_extraction_results WHERE trim(ecg_finding) <> '' AND trim(knowledge_entity) <> '' AND trim(relation) <> '' AND trim(evidence_text) <> '') GROUP BY 1, 2, 3")
def validated_evidence(t: Tables) -> DataFrame:
    """Extracted rows with all fields, each fact of a chapter once."""
    from lattica.operators.relational import first_per_key

    ok = t.chapter_extraction_results.filter("trim(ecg_finding) <> '' and trim(knowledge_entity) <> '' and trim(relation) <> '' and trim(evidence_text) <> ''")
    x = ok.select("chapter_id", X.label_key(F.col("ecg_finding")).alias("finding"), X.label_key(F.col("knowledge_entity")).alias("entity"), "ext_id")
    return first_per_key(x, ["chapter_id", "finding", "entity"], "ext_id").select("chapter_id", "finding", "entity", "ext_id")


@query("SELECT item_id, kept, dropped FROM (SELECT item_id, array_to_string(list_filter(r, lambda x: x <= 3), ',') AS kept, array_to_string(list_filter(r, lambda x: x > 3), ',') AS dropped FROM (SELECT item_id, list_filter(list_transform(mappings, lambda m: m.rank), lambda x: x IS NOT NULL) AS r FROM disease_label_to_node_multi WHERE mappings IS NOT NULL)) WHERE kept <> ''")
def validated_triples(t: Tables) -> DataFrame:
    """Triples whose sources exist, the others named as warnings."""
    r = F.filter(F.transform("mappings", lambda m: m["rank"]), lambda x: x.isNotNull())
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    x = t.disease_label_to_node_multi.filter("mappings is not null").select("item_id", r.alias("r"))
    return x.select("item_id", join(F.filter("r", lambda v: v <= 3)).alias("kept"), join(F.filter("r", lambda v: v > 3)).alias("dropped")).filter("kept <> ''")


_TOLD = "CASE WHEN c IS NOT NULL THEN 'cache_hit' WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'fuzzy' WHEN m IS NOT NULL THEN 'llm_match' ELSE 'new_entity' END"
_EXACT = "match_method = 'exact'"


@query(f"WITH {cascade_sql(_EXACT)} SELECT chapter_id, method, count(*) AS n FROM (SELECT chapter_id, CASE WHEN ext_id > min(ext_id) OVER (PARTITION BY M.k) AND {_TOLD} <> 'new_entity' THEN 'cache_hit' ELSE {_TOLD} END AS method FROM M LEFT JOIN D ON M.k = D.k) GROUP BY 1, 2")
def normalization_stats(t: Tables) -> DataFrame:
    """Mentions of each chapter settled by the cascade with a model at its end, counted by method."""
    m = t.chapter_extraction_results.select(F.col("ext_id").alias("mention_id"), F.col("knowledge_entity").alias("text"))
    c = t.entity_mapping_cache.filter("match_method = 'exact' and ontology_id is not null").select(F.col("cache_key").alias("key"), "ontology_id").join(t.ontology_entity.select("ontology_id"), "ontology_id", "left_semi")
    pick = lambda texts: [x.split("\n")[1].split("|")[1] if "\n" in x else None for x in texts]
    done = E.cascade(m, c, E.exact_names(t.ontology_entity), t.ontology_entity.select(F.col("name_en").alias("name"), "ontology_id"), model=pick)
    return done.join(t.chapter_extraction_results.select(F.col("ext_id").alias("mention_id"), "chapter_id"), "mention_id").groupBy("chapter_id", "method").agg(F.count("*").alias("n"))


@query("SELECT ontology_id, CASE WHEN regexp_matches(definition, '[一-鿿]') THEN 'en: ' || definition ELSE definition END AS definition FROM ontology_entity WHERE definition IS NOT NULL")
def translated_definitions(t: Tables) -> DataFrame:
    """Definitions in Chinese through the injected translator, others as they are."""
    o = t.ontology_entity.filter("definition is not null").select("ontology_id", "definition")
    han = F.col("definition").rlike("[\\u4e00-\\u9fff]")
    told = E.call_model(o.filter(han), "definition", "told", lambda texts: [f"en: {x}" for x in texts])
    return o.filter(~han).unionByName(told.select("ontology_id", F.col("told").alias("definition")))


@query("SELECT o_orderkey, string_agg(o_orderpriority || ' ' || c_name, ' ' ) AS prompt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def reasoning_prompts(t: Tables) -> DataFrame:
    """The prompt of each item, put together from its fields."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "c_name").alias("prompt"))


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS mid, round(avg(COALESCE(q, m)), 6) AS filled FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_quantity END AS q, (SELECT median(l_quantity) FROM lineitem WHERE l_linenumber > 1 AND l_orderkey % 10 < 7) AS m FROM lineitem) GROUP BY 1")
def median_fill(t: Tables) -> DataFrame:
    """Medians of the training rows in place of missing values, in all rows."""
    q = F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))
    m = t.lineitem.filter("l_orderkey % 10 < 7").agg(F.percentile(q, F.lit(0.5)).alias("m"))
    return t.lineitem.join(F.broadcast(m)).groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("mid"), F.round(F.avg(F.coalesce(q, "m")), 6).alias("filled"))


@query("SELECT feature, round(avg(v), 6) AS mean FROM (SELECT l_returnflag || l_linestatus AS label, unnest(['quantity', 'tax', 'discount']) AS feature, unnest([avg(l_quantity), avg(l_tax), avg(l_discount)]) AS v FROM lineitem GROUP BY 1) GROUP BY 1")
def mean_importance(t: Tables) -> DataFrame:
    """The mean over labels of each feature's weight."""
    per = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    return per.unpivot("label", ["quantity", "tax", "discount"], "feature", "v").groupBy("feature").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT n_name, count(*) AS n, arg_max(c_custkey, (c_acctbal, c_custkey)) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def unordered_top(t: Tables) -> DataFrame:
    """The best row of each group without a window."""
    x = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("top"))
    return x.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", "top")


@query("SELECT cache_id, 'TEMP_' || COALESCE(match_method, 'unknown') || '_' AS prefix, true AS same FROM entity_mapping_cache WHERE original_text IS NOT NULL")
def temporary_ids(t: Tables) -> DataFrame:
    """temporary ids from a stable hash: equal texts have equal ids, whatever their case."""
    x = t.entity_mapping_cache.filter("original_text is not null")
    kind = F.coalesce("match_method", F.lit("unknown"))
    a, b = X.temp_id(kind, F.col("original_text")), X.temp_id(kind, F.upper(F.lower("original_text")))
    ok = a.rlike(r"^TEMP_\w+_\d{4}$") & ((a == b) | (F.lower("original_text") != F.lower(F.upper(F.lower("original_text")))))
    return x.select("cache_id", F.regexp_extract(a, r"^(TEMP_\w+_)\d+$", 1).alias("prefix"), ok.alias("same"))
