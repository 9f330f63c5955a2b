"""Graph queries over a graph view of the star schema and over the alignment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators.relational import first_per_key
from lattica.plans.registry import Registry, Tables

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

BASE = 1_000_000_000


def _id(offset: int, c: str):
    return (F.lit(offset * BASE) + F.col(c)).cast("bigint")


def star_graph(t: Tables) -> G.Graph:
    """Regions, nations, customers, suppliers, parts and orders as nodes; hierarchy and trade as edges."""
    kinds = (("region", 1, "r_regionkey", "r_name", ("Ontology", "Region")), ("nation", 2, "n_nationkey", "n_name", ("Ontology", "Nation")), ("customer", 3, "c_custkey", "c_name", ("Knowledge", "Customer")), ("supplier", 4, "s_suppkey", "s_name", ("Knowledge", "Supplier")), ("part", 5, "p_partkey", "p_name", ("Knowledge", "Part")), ("orders", 6, "o_orderkey", "o_orderstatus", ("Order",)))
    nodes = None
    for name, o, key, label, labels in kinds:
        x = getattr(t, name).select(_id(o, key).alias("node_id"), F.array(*map(F.lit, labels)).alias("labels"), F.col(label).alias("name"))
        nodes = x if nodes is None else nodes.unionByName(x)
    none = F.lit(None).cast("string")
    edge = lambda d, a, rel, b, kind=none: d.select(a.alias("src"), F.lit(rel).alias("rel"), b.alias("dst"), kind.alias("relation_type"))
    flag = F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "R", "BROADER").otherwise("RELATED")
    made = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max(flag).alias("k"))
    parts = (
        edge(t.nation, _id(1, "n_regionkey"), "HAS_CHILD", _id(2, "n_nationkey")),
        edge(t.customer, _id(2, "c_nationkey"), "HAS_CHILD", _id(3, "c_custkey")),
        edge(t.supplier, _id(2, "s_nationkey"), "HAS_CHILD", _id(4, "s_suppkey")),
        edge(t.orders, _id(3, "o_custkey"), "INDICATES", _id(6, "o_orderkey")),
        edge(t.lineitem.select("l_suppkey", "l_partkey").distinct(), _id(4, "l_suppkey"), "TREATS", _id(5, "l_partkey")),
        edge(made, _id(6, "l_orderkey"), "MEASURES", _id(5, "l_partkey"), F.col("k")),
    )
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return G.Graph(nodes, edges)


_E = """E AS (SELECT 1000000000 + n_regionkey AS src, 'HAS_CHILD' AS rel, 2000000000 + n_nationkey AS dst, CAST(NULL AS VARCHAR) AS relation_type FROM nation
UNION ALL SELECT 2000000000 + c_nationkey, 'HAS_CHILD', 3000000000 + c_custkey, NULL FROM customer UNION ALL SELECT 2000000000 + s_nationkey, 'HAS_CHILD', 4000000000 + s_suppkey, NULL FROM supplier
UNION ALL SELECT 3000000000 + o_custkey, 'INDICATES', 6000000000 + o_orderkey, NULL FROM orders UNION ALL SELECT DISTINCT 4000000000 + l_suppkey, 'TREATS', 5000000000 + l_partkey, NULL FROM lineitem
UNION ALL SELECT 6000000000 + l_orderkey, 'MEASURES', 5000000000 + l_partkey, max(CASE l_returnflag WHEN 'A' THEN 'EXACT' WHEN 'R' THEN 'BROADER' ELSE 'RELATED' END) FROM lineitem GROUP BY l_orderkey, l_partkey)"""
_N = """N AS (SELECT 1000000000 + r_regionkey AS node_id, 'Region' AS kind, 'Ontology' AS layer, r_name AS name FROM region UNION ALL SELECT 2000000000 + n_nationkey, 'Nation', 'Ontology', n_name FROM nation
UNION ALL SELECT 3000000000 + c_custkey, 'Customer', 'Knowledge', c_name FROM customer UNION ALL SELECT 4000000000 + s_suppkey, 'Supplier', 'Knowledge', s_name FROM supplier
UNION ALL SELECT 5000000000 + p_partkey, 'Part', 'Knowledge', p_name FROM part UNION ALL SELECT 6000000000 + o_orderkey, 'Order', 'Order', o_orderstatus FROM orders)"""
_TWO = """U AS (SELECT src AS a, dst AS b FROM E UNION SELECT dst, src FROM E), A0 AS (SELECT node_id AS anchor_id, node_id FROM N WHERE kind = 'Region'),
A1 AS (SELECT * FROM A0 UNION SELECT anchor_id, b FROM A0 JOIN U ON node_id = a), K AS (SELECT DISTINCT anchor_id, src, rel, dst FROM A1 JOIN E ON src = node_id OR dst = node_id)"""


def _regions(g: G.Graph) -> DataFrame:
    return g.nodes.filter(G.has_labels("Region")).select("node_id")


@query(f"WITH {_N} SELECT node_id, name FROM N WHERE layer = 'Knowledge' AND kind <> 'Part'")
def label_scan(t: Tables) -> DataFrame:
    """Label conjunction and negation."""
    return star_graph(t).nodes.filter(G.has_labels("Knowledge") & ~G.has_labels("Part")).select("node_id", "name")


@query(f"WITH {_N} SELECT label, count(*) AS n FROM (SELECT layer AS label FROM N WHERE kind <> 'Order' UNION ALL SELECT kind FROM N) GROUP BY 1")
def catalog_counts(t: Tables) -> DataFrame:
    """Nodes a label, in one pass."""
    return star_graph(t).nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_N}, {_E} SELECT s.kind AS src_kind, rel, d.kind AS dst_kind, count(*) AS n, count(relation_type) AS typed FROM E JOIN N s ON src = s.node_id JOIN N d ON dst = d.node_id GROUP BY 1, 2, 3")
def triple_patterns(t: Tables) -> DataFrame:
    """Counts of (label, relation, label)."""
    g = star_graph(t)
    kind = lambda c: g.nodes.select(F.col("node_id").alias(c), F.element_at("labels", -1).alias(c + "_kind"))
    return g.edges.join(kind("src"), "src").join(kind("dst"), "dst").groupBy("src_kind", "rel", "dst_kind").agg(F.count("*").alias("n"), F.count("relation_type").alias("typed"))


@query(f"WITH {_N}, {_E} SELECT (SELECT count(*) FROM N) AS nodes, (SELECT count(*) FROM E) AS edges, round(2.0::DOUBLE * (SELECT count(*) FROM E) / (SELECT count(*) FROM N), 5) AS degree, round(2.0::DOUBLE * (SELECT count(*) FROM E) / (SELECT sum(CASE WHEN kind = 'Order' THEN 1 ELSE 2 END) FROM N), 5) AS degree_by_label")
def average_degree(t: Tables) -> DataFrame:
    """Mean degree by nodes and by label memberships."""
    g = star_graph(t)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.sum(F.size("labels")).alias("m"))
    e = g.edges.agg(F.count("*").alias("edges"))
    return n.join(e).select("nodes", "edges", F.round(F.lit(2.0) * F.col("edges") / F.col("nodes"), 5).alias("degree"), F.round(F.lit(2.0) * F.col("edges") / F.col("m"), 5).alias("degree_by_label"))


@query(f"WITH {_N}, {_E} SELECT N.node_id, other, rel, direction FROM N JOIN (SELECT src AS node_id, dst AS other, rel, 'out' AS direction FROM E UNION ALL SELECT dst, src, rel, 'in' FROM E) x ON N.node_id = x.node_id WHERE kind = 'Nation'")
def one_hop(t: Tables) -> DataFrame:
    """Triples of a node with their true direction."""
    g = star_graph(t)
    seed = g.nodes.filter(G.has_labels("Nation")).select("node_id")
    return G.either_way(g.edges).join(seed, "node_id", "left_semi").select("node_id", "other", "rel", "direction")


@query(f"WITH {_N}, {_E}, {_TWO} SELECT anchor_id, src, rel, dst FROM K")
def khop_edges(t: Tables) -> DataFrame:
    """Edges within two hops of every region."""
    g = star_graph(t)
    return G.khop_edges(g.edges, _regions(g), 2)


@query(f"WITH {_N}, {_E}, {_TWO}, B AS (SELECT *, rel IN ('INDICATES', 'MEASURES', 'TREATS') AS p FROM K) SELECT anchor_id, src, rel, dst FROM B WHERE CASE WHEN anchor_id IN (SELECT anchor_id FROM B WHERE p) THEN p ELSE rel = 'HAS_CHILD' END")
def khop_preferred(t: Tables) -> DataFrame:
    """Preferred relations, else the hierarchy."""
    g = star_graph(t)
    return G.preferred_or_fallback(G.khop_edges(g.edges, _regions(g), 2)).select("anchor_id", "src", "rel", "dst")


@query(f"WITH {_N}, {_E}, X AS (SELECT DISTINCT s.node_id AS anchor_id, e.dst AS node_id FROM N s JOIN E e ON e.src = s.node_id WHERE s.kind = 'Supplier'), Y AS (SELECT node_id, count(DISTINCT anchor_id) AS support FROM X GROUP BY 1) SELECT node_id, support FROM Y WHERE support >= 3 UNION ALL SELECT node_id, 1 FROM N WHERE kind = 'Supplier' AND node_id IN (SELECT anchor_id FROM X)")
def kofm_intersection(t: Tables) -> DataFrame:
    """Nodes near at least three suppliers; anchors stay."""
    g = star_graph(t)
    found = G.pattern(g, "Supplier", "Part").select(F.col("src").alias("anchor_id"), "src", "rel", "dst")
    return G.shared_neighbours(found, 3)


def _nation_pairs(t: Tables) -> DataFrame:
    """Pairs of nations of a region; nation is a table of fixed size."""
    n = t.nation.select(F.col("n_regionkey").alias("r"), _id(2, "n_nationkey").alias("k"))
    return n.select("r", F.col("k").alias("u")).join(n.select("r", F.col("k").alias("v")), "r").select("u", "v")


@query("""SELECT CAST(2000000000 + a.n_nationkey AS BIGINT) AS u, CAST(2000000000 + b.n_nationkey AS BIGINT) AS v, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 ELSE 2 END AS len,
CASE WHEN a.n_nationkey = b.n_nationkey THEN CAST(2000000000 + a.n_nationkey AS VARCHAR) ELSE concat_ws('>', 2000000000 + a.n_nationkey, 1000000000 + a.n_regionkey, 2000000000 + b.n_nationkey) END AS path FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def shortest_paths(t: Tables) -> DataFrame:
    """Shortest undirected paths over the hierarchy between the nations of a region."""
    g = star_graph(t)
    pairs = _nation_pairs(t)
    found = G.shortest_paths(g.edges.filter("rel = 'HAS_CHILD'"), pairs, 4)
    return found.select("u", "v", "len", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""SELECT u, v, pos, src, dst, pos = 0 AS reversed FROM (SELECT CAST(2000000000 + a.n_nationkey AS BIGINT) AS u, CAST(2000000000 + b.n_nationkey AS BIGINT) AS v, pos, CAST(1000000000 + a.n_regionkey AS BIGINT) AS src,
CAST(2000000000 + CASE WHEN pos = 0 THEN a.n_nationkey ELSE b.n_nationkey END AS BIGINT) AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey, (SELECT unnest([0, 1]) AS pos))""")
def path_steps(t: Tables) -> DataFrame:
    """The edge and direction of each step of the paths between nations."""
    g = star_graph(t)
    e = g.edges.filter("rel = 'HAS_CHILD'")
    pairs = _nation_pairs(t)
    return G.path_edges(G.shortest_paths(e, pairs, 2).filter("len > 0"), e).select("u", "v", "pos", "src", "dst", "reversed")


@query("""WITH RECURSIVE d AS (SELECT ontology_id AS node_id, 0 AS depth FROM ontology_entity WHERE parent_id IS NULL AND ontology_id IN (SELECT parent_id FROM ontology_entity) UNION ALL SELECT o.ontology_id, d.depth + 1 FROM ontology_entity o JOIN d ON o.parent_id = d.node_id) SELECT node_id, depth FROM d""")
def hierarchy_depth(t: Tables) -> DataFrame:
    """Depth below the roots of the ontology."""
    e = t.ontology_entity.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.lit("HAS_CHILD").alias("rel"), F.col("ontology_id").alias("dst"))
    return G.depths(e)


@query("""SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS node_id, CAST(1000000000 + r_regionkey AS BIGINT) AS root FROM region UNION ALL SELECT 2000000000 + n_nationkey, 1000000000 + n_regionkey FROM nation
UNION ALL SELECT 3000000000 + c_custkey, 1000000000 + n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 4000000000 + s_suppkey, 1000000000 + n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def synonym_groups(t: Tables) -> DataFrame:
    """Groups joined by the hierarchy."""
    g = star_graph(t)
    nodes = g.nodes.filter(~G.has_labels("Part") & ~G.has_labels("Order"))
    return G.synonym_groups(g.edges.filter("rel = 'HAS_CHILD'"), nodes)


_M = "M AS (SELECT 2000000000 + n_nationkey AS old, 2000000000 + min(n_nationkey) OVER (PARTITION BY n_regionkey) AS new FROM nation)"


@query(f"""WITH {_E}, {_M}, X AS (SELECT COALESCE(a.new, src) AS s, rel, COALESCE(b.new, dst) AS d, relation_type, a.new IS NOT NULL OR b.new IS NOT NULL AS moved FROM E LEFT JOIN (SELECT * FROM M WHERE old <> new) a ON src = a.old LEFT JOIN (SELECT * FROM M WHERE old <> new) b ON dst = b.old)
SELECT s AS src, rel, d AS dst, max(relation_type) AS relation_type FROM X WHERE NOT (moved AND s = d) GROUP BY 1, 2, 3""")
def entity_merge(t: Tables) -> DataFrame:
    """Nations of a region merged into the first."""
    g = star_graph(t)
    first = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m"))
    merges = t.nation.join(first, "n_regionkey").filter("n_nationkey <> m").select(_id(2, "n_nationkey").alias("old"), _id(2, "m").alias("new"))
    return G.merge_nodes(g, merges).edges


@query("""SELECT k, created, updated FROM (SELECT COALESCE(o.k, n.k) AS k, COALESCE(o.created, n.created) AS created, COALESCE(n.updated, o.updated) AS updated FROM (SELECT o_custkey AS k, min(o_orderdate) AS created, min(o_orderdate) AS updated FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o
FULL JOIN (SELECT o_custkey AS k, min(o_orderdate) AS created, max(o_orderdate) AS updated FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) n ON o.k = n.k)""")
def upsert_nodes(t: Tables) -> DataFrame:
    """Upsert that keeps created and refreshes updated."""
    when = F.col("o_orderdate")
    old = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min(when).alias("created"), F.min(when).alias("updated"))
    new = t.orders.filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min(when).alias("created"), F.max(when).alias("updated"))
    return G.upsert_nodes(old, new, "k", "created", "updated")


@query(f"""WITH {_E}, O AS (SELECT src, rel, dst, relation_type FROM E WHERE rel = 'MEASURES'), P AS (SELECT 6000000000 + l_orderkey AS src, 'MEASURES' AS rel, 5000000000 + l_partkey AS dst, max('STATUS_' || l_linestatus) AS relation_type FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2, 3)
SELECT src, rel, dst, relation_type FROM P UNION ALL SELECT src, rel, dst, relation_type FROM O WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.src = O.src AND P.dst = O.dst)""")
def overlay_edges(t: Tables) -> DataFrame:
    """Edges merged by ends and type, later properties win."""
    new = t.lineitem.filter("l_quantity > 40").select(_id(6, "l_orderkey").alias("src"), F.lit("MEASURES").alias("rel"), _id(5, "l_partkey").alias("dst"), F.concat(F.lit("STATUS_"), "l_linestatus").alias("relation_type"))
    return G.overlay_edges(star_graph(t).edges.filter("rel = 'MEASURES'"), new)


@query("""SELECT ext_id, f.node_id AS src, rel, d.node_id AS dst FROM (SELECT ext_id, lower(trim(ecg_finding)) AS a, upper(trim(relation)) AS rel, lower(trim(knowledge_entity)) AS b FROM chapter_extraction_results WHERE relation IS NOT NULL) x
JOIN (SELECT lower(trim(name)) AS name, min(node_id) AS node_id FROM nodes WHERE node_type = 'ECGFinding' AND name IS NOT NULL GROUP BY 1) f ON a = f.name JOIN (SELECT lower(name_en) AS name, min(ontology_id) AS node_id FROM ontology_entity GROUP BY 1) d ON b = d.name""")
def typed_edges(t: Tables) -> DataFrame:
    """Edges built from names, only where the ends have the right types."""
    x = t.chapter_extraction_results.filter("relation is not null").select("ext_id", F.lower(F.trim("ecg_finding")).alias("a"), F.upper(F.trim("relation")).alias("rel"), F.lower(F.trim("knowledge_entity")).alias("b"))
    f = t.nodes.filter("node_type = 'ECGFinding' and name is not null").groupBy(F.lower(F.trim("name")).alias("a")).agg(F.min("node_id").alias("src"))
    d = t.ontology_entity.groupBy(F.lower("name_en").alias("b")).agg(F.min("ontology_id").alias("dst"))
    return x.join(f, "a").join(d, "b").select("ext_id", "src", "rel", "dst")


@query("""SELECT name, arg_min(kind, ord) AS kind, CAST(row_number() OVER (ORDER BY min(ord)) AS BIGINT) AS node_no FROM (SELECT name_en AS name, 'ontology' AS kind, '1' || ontology_id AS ord FROM ontology_entity UNION ALL SELECT ecg_finding, 'finding', '2' || lpad(CAST(ext_id AS VARCHAR), 12, '0') FROM chapter_extraction_results
WHERE ecg_finding IS NOT NULL UNION ALL SELECT knowledge_entity, 'entity', '3' || lpad(CAST(ext_id AS VARCHAR), 12, '0') FROM chapter_extraction_results WHERE knowledge_entity IS NOT NULL) GROUP BY name""")
def first_name_ids(t: Tables) -> DataFrame:
    """Surrogate ids in order of first occurrence over several sources."""
    from lattica.operators.relational import dense_ids

    c = t.chapter_extraction_results
    ext = F.lpad(F.col("ext_id").cast("string"), 12, "0")
    rows = t.ontology_entity.select(F.col("name_en").alias("name"), F.lit("ontology").alias("kind"), F.concat(F.lit("1"), "ontology_id").alias("ord"))
    rows = rows.unionByName(c.filter("ecg_finding is not null").select(F.col("ecg_finding").alias("name"), F.lit("finding").alias("kind"), F.concat(F.lit("2"), ext).alias("ord")))
    rows = rows.unionByName(c.filter("knowledge_entity is not null").select(F.col("knowledge_entity").alias("name"), F.lit("entity").alias("kind"), F.concat(F.lit("3"), ext).alias("ord")))
    first = first_per_key(rows, ["name"], "ord").select("ord", "name", "kind")
    return dense_ids(first, "ord").select("name", "kind", (F.col("local_id") + 1).alias("node_no"))


@query(f"""WITH {_N}, {_E}, X AS (SELECT n.node_id AS anchor_id, CASE WHEN e.src = n.node_id THEN 0 ELSE 1 END AS o, e.rel, e.src, e.dst, s.name AS sn, d.name AS dn FROM N n JOIN E e ON e.src = n.node_id OR e.dst = n.node_id JOIN N s ON e.src = s.node_id JOIN N d ON e.dst = d.node_id WHERE n.kind = 'Nation'),
R AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY o, rel, dst, src) AS r FROM X) SELECT anchor_id, string_agg(CASE WHEN o = 0 THEN '-[' || rel || ']-> ' || dn ELSE '<-[' || rel || ']- ' || sn END, chr(10) ORDER BY r) AS context, count(*) AS lines FROM R WHERE r <= 40 GROUP BY 1""")
def context_lines(t: Tables) -> DataFrame:
    """Each nation's edges as lines of text, at most 40."""
    g = star_graph(t)
    return G.linearize(G.khop_edges(g.edges, g.nodes.filter(G.has_labels("Nation")).select("node_id"), 1), g.nodes, 40)


@query("""SELECT node_type, n FROM (SELECT CASE WHEN x LIKE '%finding%label%' OR x = 'findinglabel' THEN 'FindingLabel' WHEN x = 'ecgfinding' THEN 'ECGFinding' WHEN x = 'diseaselabel' THEN 'DiseaseLabel' WHEN x = 'disease' THEN 'Disease' ELSE 'other' END AS node_type, count(*) AS n FROM (SELECT lower(regexp_replace(node_type, '[^A-Za-z]', '', 'g')) AS x FROM nodes) GROUP BY 1)""")
def node_type_summary(t: Tables) -> DataFrame:
    """Nodes a cleaned type."""
    x = F.lower(F.regexp_replace("node_type", "[^A-Za-z]", ""))
    kind = F.when(x == "findinglabel", "FindingLabel").when(x == "ecgfinding", "ECGFinding").when(x == "diseaselabel", "DiseaseLabel").when(x == "disease", "Disease").otherwise("other")
    return t.nodes.groupBy(kind.alias("node_type")).agg(F.count("*").alias("n"))


@query("""SELECT keys, count(*) AS n FROM (SELECT array_to_string(list_sort(json_keys(CAST(meta AS JSON))), ',') AS keys FROM nodes WHERE meta IS NOT NULL AND json_valid(meta)) GROUP BY 1""")
def property_key_sets(t: Tables) -> DataFrame:
    """Sets of property keys."""
    keys = F.array_join(F.array_sort(F.json_object_keys("meta")), ",")
    return t.nodes.filter("meta is not null").select(keys.alias("keys")).filter("keys is not null").groupBy("keys").agg(F.count("*").alias("n"))
