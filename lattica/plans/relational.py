"""Joins, aggregations, windows, set operations and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.relational import (
    align_strict,
    best_per_key,
    first_per_key,
    insert_if_absent,
    missing_keys,
    next_child_ids,
    reconcile_orphans,
    sliced,
    unique_or_mixed,
)
from lattica.plans.registry import Registry, Tables

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql


@query("""SELECT o.o_orderpriority, n.n_name, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS solvent
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def edge_pattern_join(t: Tables) -> DataFrame:
    """Pattern of two hops with conditional counts."""
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("o_orderpriority", "n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.k IS NOT NULL THEN 'already_linked' WHEN e.ontology_id IS NOT NULL THEN 'linked' ELSE 'not_found' END AS status
FROM entity_mapping_cache m LEFT JOIN ontology_entity e ON m.ontology_id = e.ontology_id LEFT JOIN (SELECT DISTINCT ontology_id AS k FROM entity_mapping_cache WHERE match_method = 'exact' AND ontology_id IS NOT NULL) o ON m.ontology_id = o.k) GROUP BY 1""")
def link_status(t: Tables) -> DataFrame:
    """Linking with a status for every row."""
    done = t.entity_mapping_cache.filter("match_method = 'exact' and ontology_id is not null").select(F.col("ontology_id").alias("k")).distinct()
    x = t.entity_mapping_cache.select("ontology_id").join(t.ontology_entity.select(F.col("ontology_id").alias("e")), F.col("ontology_id") == F.col("e"), "left")
    x = x.join(done, F.col("ontology_id") == F.col("k"), "left")
    return x.groupBy(F.when(F.col("k").isNotNull(), "already_linked").when(F.col("e").isNotNull(), "linked").otherwise("not_found").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT c.c_name, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_custkey LIMIT 10""")
def equality_preview(t: Tables) -> DataFrame:
    """A product under an equality, planned as an equi-join; ten rows are the feature."""
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).orderBy("c_custkey").limit(10).select("c_name", "n_name")


@query("""SELECT l.l_orderkey, s.local_id AS src, p.local_id AS dst, count(*) AS n FROM lineitem l
JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS local_id FROM supplier) s ON l.l_suppkey = s.s_suppkey
JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS local_id FROM part WHERE p_size > 25) p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3""")
def local_ids_remap(t: Tables) -> DataFrame:
    """Dense local ids and remapped edge ends; unmatched edges drop."""
    from lattica.operators.relational import dense_ids

    s = dense_ids(t.supplier.select("s_suppkey"), "s_suppkey").select("s_suppkey", F.col("local_id").alias("src"))
    p = dense_ids(t.part.filter("p_size > 25").select("p_partkey"), "p_partkey").select("p_partkey", F.col("local_id").alias("dst"))
    x = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_orderkey", "src", "dst").agg(F.count("*").alias("n"))


@query("""SELECT c.c_custkey, c.c_acctbal, t.total FROM customer c JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) t ON c.c_custkey = t.o_custkey""")
def align_ids(t: Tables) -> DataFrame:
    """Alignment on common ids."""
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_acctbal", "total")


@query("""SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def align_ids_strict(t: Tables) -> DataFrame:
    """Alignment that fails unless both sides hold the same ids."""
    r = t.nation.select(F.col("n_regionkey").alias("r_regionkey")).distinct()
    return t.nation.join(align_strict(t.region, r, "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("""SELECT 'orders' AS side, count(*) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'customers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def completeness(t: Tables) -> DataFrame:
    """Ids one side lacks."""
    o, c = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    side = lambda name, d: d.agg(F.count("*").alias("missing")).select(F.lit(name).alias("side"), "missing")
    return side("orders", missing_keys(o, c, "k")).unionByName(side("customers", missing_keys(c, o, "k")))


@query("""SELECT v.name, COALESCE(e.ontology_id, '-1') AS ontology_id FROM (SELECT DISTINCT lower(trim(regexp_replace(normalized_name, '\\s+', ' ', 'g'))) AS name FROM entity_mapping_cache WHERE normalized_name IS NOT NULL) v
LEFT JOIN (SELECT lower(name_en) AS k, min(ontology_id) AS ontology_id FROM ontology_entity GROUP BY 1) e ON v.name = e.k""")
def vocabulary_alignment(t: Tables) -> DataFrame:
    """Names of a vocabulary to ids, -1 where missing."""
    from lattica.functions.text import label_key

    v = t.entity_mapping_cache.filter("normalized_name is not null").select(label_key(F.col("normalized_name")).alias("name")).distinct()
    e = t.ontology_entity.groupBy(F.lower("name_en").alias("k")).agg(F.min("ontology_id").alias("ontology_id"))
    return v.join(e, v["name"] == e["k"], "left").select("name", F.coalesce("ontology_id", F.lit("-1")).alias("ontology_id"))


@query("""SELECT cache_id, ontology_id, name_en FROM (SELECT cache_id, e.ontology_id, name_en, row_number() OVER (PARTITION BY cache_id ORDER BY e.ontology_id) AS r
FROM (SELECT cache_id, lower(original_text) AS t FROM entity_mapping_cache WHERE length(original_text) > 3) m JOIN ontology_entity e ON contains(t, name_en) OR contains(name_en, t)) WHERE r = 1""")
def substring_first_match(t: Tables) -> DataFrame:
    """First entry, in list order, that holds or is held. The list side is checked before it is broadcast."""
    from lattica.operators.relational import first_containment

    texts = t.entity_mapping_cache.filter("length(original_text) > 3").select("cache_id", F.lower("original_text").alias("t"))
    vocab = t.ontology_entity.select("ontology_id", "name_en")
    return first_containment(texts, vocab, "cache_id", "t", "name_en", "name_en", "ontology_id").select("cache_id", "ontology_id", "name_en")


@query("""SELECT a.concept, a.name, b.kind, d.definition FROM (SELECT ontology_id AS concept, name_en AS name FROM ontology_entity WHERE name_en LIKE '%block%' AND level = 2) a
LEFT JOIN (SELECT ontology_id, type AS kind FROM ontology_entity WHERE type <> 'pacing') b ON a.concept = b.ontology_id
LEFT JOIN (SELECT ontology_id, definition FROM ontology_entity WHERE definition IS NOT NULL) d ON a.concept = d.ontology_id ORDER BY length(a.name), a.concept LIMIT 20""")
def term_lookup(t: Tables) -> DataFrame:
    """Terminology lookup, shortest names first; twenty rows are the feature."""
    o = t.ontology_entity
    a = o.filter(F.col("name_en").like("%block%") & (F.col("level") == 2)).select(F.col("ontology_id").alias("concept"), F.col("name_en").alias("name"))
    b = o.filter("type <> 'pacing'").select(F.col("ontology_id").alias("bk"), F.col("type").alias("kind"))
    d = o.filter("definition is not null").select(F.col("ontology_id").alias("dk"), "definition")
    x = a.join(b, F.col("concept") == F.col("bk"), "left").join(d, F.col("concept") == F.col("dk"), "left")
    return x.orderBy(F.length("name"), "concept").limit(20).select("concept", "name", "kind", "definition")


@query("""SELECT c.ontology_id, c.parent_id, CASE WHEN p.ontology_id IS NULL AND c.parent_id IS NOT NULL THEN 'orphan' WHEN c.parent_id IS NULL THEN 'root' ELSE 'child' END AS state
FROM ontology_entity c LEFT JOIN ontology_entity p ON c.parent_id = p.ontology_id""")
def tree_orphans(t: Tables) -> DataFrame:
    """Parents by self-join, orphans reported."""
    return reconcile_orphans(t.ontology_entity.select("ontology_id", "parent_id"), "ontology_id", "parent_id")


@query("""SELECT c.id, count(e.event_id) AS events, CAST(COALESCE(sum(e.event_id), 0) AS BIGINT) AS ids FROM chapter c LEFT JOIN events e ON e.event_id BETWEEN c.start_page AND c.end_page GROUP BY 1""")
def toc_range_join(t: Tables) -> DataFrame:
    """Pages within each chapter's range, by an equi-join on page buckets."""
    from lattica.operators.relational import range_join

    pages = t.events.select(F.col("event_id").alias("page"))
    toc = t.chapter.select("id", F.col("start_page").cast("bigint").alias("lo"), F.col("end_page").cast("bigint").alias("hi"))
    hits = range_join(pages, toc, "page", "lo", "hi", 32).groupBy("id").agg(F.count("*").alias("events"), F.sum("page").alias("ids"))
    return toc.select("id").join(hits, "id", "left").select("id", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("ids", F.lit(0)).alias("ids"))


@query("""SELECT c.id, COALESCE(x.findings, '') AS findings FROM chapter c LEFT JOIN (SELECT chapter_id, string_agg(DISTINCT ecg_finding, '|' ORDER BY ecg_finding) AS findings FROM chapter_extraction_results WHERE trim(ecg_finding) <> '' GROUP BY 1) x ON c.id = x.chapter_id""")
def left_collect(t: Tables) -> DataFrame:
    """Left join with an ordered list, empty where missing."""
    x = t.chapter_extraction_results.filter("trim(ecg_finding) <> ''").groupBy("chapter_id").agg(F.array_join(F.array_sort(F.collect_set("ecg_finding")), "|").alias("findings"))
    return t.chapter.select("id").join(x, F.col("id") == F.col("chapter_id"), "left").select("id", F.coalesce("findings", F.lit("")).alias("findings"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def insert_absent(t: Tables) -> DataFrame:
    """Rows whose key the target lacks."""
    new = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return insert_if_absent(new, t.orders.filter("o_orderpriority = '2-HIGH'"), ["o_custkey"], ["o_orderkey"], distinct=False)


@query("""SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(c_mktsegment) FROM customer WHERE c_acctbal > 0) AS with_prop, round((SELECT count(c_mktsegment) FROM customer WHERE c_acctbal > 0) * 100.0::DOUBLE / (SELECT count(*) FROM customer), 1) AS pct""")
def coverage_pct(t: Tables) -> DataFrame:
    """Share of rows that carry a property."""
    x = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("prop"))
    return x.agg(F.count("*").alias("n"), F.count("prop").alias("with_prop"), F.round(F.count("prop") * F.lit(100.0) / F.count("*"), 1).alias("pct"))


@query("""SELECT COALESCE(lang, 'Unknown') AS lang, n FROM (SELECT lang, count(DISTINCT record_key) AS n FROM documents GROUP BY lang) ORDER BY n DESC, lang NULLS LAST LIMIT 5""")
def distinct_topk(t: Tables) -> DataFrame:
    """Distinct counts a group, largest first; a null group is named after grouping."""
    x = t.documents.groupBy("lang").agg(F.countDistinct("record_key").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("lang")).limit(5)
    return x.select(F.coalesce("lang", F.lit("Unknown")).alias("lang"), "n")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(median(l_quantity), 6) AS mid, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2""")
def group_summary(t: Tables) -> DataFrame:
    """A10: counts, sums, medians and means of groups."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("mid"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


@query("""SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) WHERE n >= 50 ORDER BY n DESC, event_type LIMIT 20""")
def frequent_values(t: Tables) -> DataFrame:
    """Value counts above a least frequency, twenty at most."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).filter("n >= 50").orderBy(F.desc("n"), "event_type").limit(20)


@query("""SELECT method, count(*) AS n FROM (SELECT match_method AS method FROM entity_mapping_cache UNION ALL SELECT CASE WHEN all_mappings IS NOT NULL AND len(all_mappings) > 1 THEN 'multiple' ELSE 'single' END FROM entity_mapping_cache) GROUP BY 1""")
def method_counters(t: Tables) -> DataFrame:
    """Counters of two columns in one pass."""
    multi = F.when(F.coalesce(F.size("all_mappings"), F.lit(-1)) > 1, "multiple").otherwise("single")
    return t.entity_mapping_cache.select(F.explode(F.array(F.col("match_method"), multi)).alias("method")).groupBy("method").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, CASE count(DISTINCT o_orderpriority) WHEN 0 THEN '' WHEN 1 THEN max(o_orderpriority) ELSE 'mixed' END AS priority FROM orders GROUP BY 1""")
def unique_or_mixed_value(t: Tables) -> DataFrame:
    """A group's only value, else mixed."""
    return t.orders.groupBy("o_custkey").agg(unique_or_mixed("o_orderpriority").alias("priority"))


@query("""SELECT round(avg(acc), 6) AS macro, round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS micro, count(*) AS groups, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_groups FROM (
SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ok, count(value) AS n, avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM events GROUP BY 1)""")
def accuracy_micro_macro(t: Tables) -> DataFrame:
    """Accuracy over all answers, and the mean over questions."""
    ok = (F.col("event_type") == "purchase").cast("double")
    per = t.events.groupBy("user_id").agg(F.sum(ok).alias("ok"), F.count("value").alias("n"), F.avg(ok).alias("acc"))
    return per.agg(F.round(F.avg("acc"), 6).alias("macro"), F.round(F.sum("ok") / F.sum("n"), 6).alias("micro"), F.count("*").alias("groups"), F.count_if(F.col("n") == 0).alias("empty_groups"))


@query("""SELECT level, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(id, (length(text), id)) AS longest FROM chapter WHERE text IS NOT NULL GROUP BY 1""")
def section_stats(t: Tables) -> DataFrame:
    """Sizes a level and the longest chapter."""
    n = F.length("text").cast("bigint")
    return t.chapter.filter("text is not null").groupBy("level").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.max_by("id", F.struct(n, "id")).alias("longest"))


@query("""SELECT chapter_id, CASE WHEN length(x) > 5000 THEN substr(x, 1, 5000) || '...' ELSE x END AS joined FROM (SELECT chapter_id, array_to_string(list(evidence_text ORDER BY ext_id)[1:3], ' | ') AS x FROM chapter_extraction_results WHERE evidence_text IS NOT NULL GROUP BY 1)""")
def evidence_join(t: Tables) -> DataFrame:
    """The first three texts of a group, joined and cut beyond 5,000 characters. Rows are ranked before collecting, so no list grows beyond three."""
    w = Window.partitionBy("chapter_id").orderBy("ext_id")
    first = t.chapter_extraction_results.filter("evidence_text is not null").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    x = first.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "evidence_text"))), lambda s: s["evidence_text"]), " | ").alias("x"))
    from lattica.functions.text import preview

    return x.select("chapter_id", preview(F.col("x"), 5000).alias("joined"))


@query("""SELECT vec_id, label, r FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r <= 3""")
def rank_in_group(t: Tables) -> DataFrame:
    """The three largest of each group."""
    w = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    return t.embeddings.withColumn("r", F.row_number().over(w).cast("bigint")).filter("r <= 3").select("vec_id", "label", "r")


@query("""SELECT cache_key, cache_id, ontology_id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY updated_at DESC NULLS LAST, cache_id DESC) AS r FROM entity_mapping_cache) WHERE r = 1""")
def newest_per_key(t: Tables) -> DataFrame:
    """The newest entry of a key; max_by combines before the shuffle, so a hot key is no burden."""
    return best_per_key(t.entity_mapping_cache, ["cache_key"], F.struct(F.col("updated_at").isNotNull(), "updated_at", "cache_id"), ["cache_id", "ontology_id"])


@query("""SELECT chapter_id, lower(trim(ecg_finding)) AS finding, min(ext_id) AS ext_id FROM chapter_extraction_results WHERE ecg_finding IS NOT NULL AND trim(ecg_finding) <> '' GROUP BY 1, 2""")
def first_of_key(t: Tables) -> DataFrame:
    """The first row of a key, blank keys left out."""
    x = t.chapter_extraction_results.filter("ecg_finding is not null and trim(ecg_finding) <> ''").select("chapter_id", F.lower(F.trim("ecg_finding")).alias("finding"), "ext_id")
    return first_per_key(x, ["chapter_id", "finding"], "ext_id").select("chapter_id", "finding", "ext_id")


@query("""SELECT id, book, start_page, CAST(greatest(start_page, COALESCE(lead(start_page) OVER (PARTITION BY book ORDER BY start_page, id) - 1, start_page + 2)) AS INTEGER) AS end_est FROM chapter WHERE start_page IS NOT NULL""")
def chapter_end_pages(t: Tables) -> DataFrame:
    """A chapter ends before the next begins; the last has two pages more."""
    own = t.chapter.filter("start_page is not null").select("id", "book", "start_page")
    x = sliced(own, ["book"], [F.col("start_page"), F.col("id")], ahead=1)
    w = Window.partitionBy("book", "_slice").orderBy("_n")
    end = F.greatest("start_page", F.coalesce(F.lead("start_page").over(w) - 1, F.col("start_page") + 2))
    return x.select("_own", "id", "book", "start_page", end.cast("int").alias("end_est")).filter("_own").drop("_own")


@query("""SELECT parent_id, ext, parent_id || '.' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS child_id FROM (SELECT e.ontology_id AS parent_id, m.cache_id AS ext, COALESCE(mx, 0) + row_number() OVER (PARTITION BY e.ontology_id ORDER BY m.cache_id) AS n FROM ontology_entity e
JOIN entity_mapping_cache m ON m.ontology_id = e.ontology_id LEFT JOIN (SELECT parent_id, max(CAST(regexp_extract(ontology_id, '\\.(\\d+)$', 1) AS BIGINT)) AS mx FROM ontology_entity WHERE regexp_matches(ontology_id, '\\.\\d+$') GROUP BY 1) x ON x.parent_id = e.ontology_id)""")
def next_children(t: Tables) -> DataFrame:
    """The next free child ids below each parent, in order of arrival."""
    arrivals = t.entity_mapping_cache.select(F.col("ontology_id").alias("parent_id"), F.col("cache_id").alias("ext"))
    return next_child_ids(t.ontology_entity, arrivals, "ext")


@query("""SELECT source, n_docs FROM (SELECT source, n_docs, sum(n_docs) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT source, count(*) AS n_docs FROM documents WHERE source IS NOT NULL GROUP BY 1)) WHERE run <= (SELECT count(*) * 2 // 5 FROM documents)""")
def running_budget(t: Tables) -> DataFrame:
    """Groups in order until a budget of two fifths of all rows is spent."""
    from lattica.operators.relational import within_budget

    return within_budget(t.documents.filter("source is not null").groupBy("source").agg(F.count("*").alias("n_docs")), "source", "n_docs", t.documents.count() * 2 // 5).select("source", "n_docs")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000""")
def id_intersection(t: Tables) -> DataFrame:
    """Common ids."""
    return t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey").intersect(t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT k, count(*) AS n, string_agg(src, '+' ORDER BY src) AS srcs FROM (SELECT DISTINCT k, src FROM (SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)) GROUP BY 1""")
def union_distinct(t: Tables) -> DataFrame:
    """Union and its distinct rows."""
    x = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))).distinct()
    return x.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("src")), "+").alias("srcs"))


@query("""SELECT part, count(*) AS n FROM (SELECT doc_id, CASE WHEN r <= 0.7::DOUBLE * t THEN 'train' WHEN r <= 0.8::DOUBLE * t THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id) AS r, count(*) OVER () AS t FROM documents)) GROUP BY 1""")
def seeded_split(t: Tables) -> DataFrame:
    """A seeded split into disjoint shares that cover all ids."""
    from lattica.operators.relational import split_ids

    return split_ids(t.documents.select("doc_id"), "doc_id", {"train": 0.7, "val": 0.1, "test": 0.2}, seed=7).groupBy("part").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND regexp_matches(o_orderpriority, '^(1|2)-')""")
def membership_regex(t: Tables) -> DataFrame:
    """Membership by semi-join, prefix by regular expression."""
    c = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.filter(F.col("o_orderpriority").rlike("^(1|2)-")).join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT ext_id, upper(trim(relation)) AS relation FROM chapter_extraction_results WHERE upper(trim(relation)) IN ('STRONG_EVIDENCE_FOR', 'WEAK_EVIDENCE_FOR', 'CONTRAINDICATES', 'SPECIFIC_FOR')""")
def relation_whitelist(t: Tables) -> DataFrame:
    """Allowed relations only."""
    r = F.upper(F.trim("relation"))
    return t.chapter_extraction_results.filter(r.isin("STRONG_EVIDENCE_FOR", "WEAK_EVIDENCE_FOR", "CONTRAINDICATES", "SPECIFIC_FOR")).select("ext_id", r.alias("relation"))


@query("""SELECT item_id, kept FROM (SELECT item_id, array_to_string(list_filter(list_transform(mappings, lambda m: m.node_id), lambda n: regexp_matches(n, '^[0-9]+$') AND len(n) < 4), ',') AS kept FROM disease_label_to_node_multi WHERE mappings IS NOT NULL) WHERE kept <> ''""")
def array_filter_keep(t: Tables) -> DataFrame:
    """Array elements that pass; rows with none left drop."""
    ids = F.filter(F.transform("mappings", lambda m: m["node_id"]), lambda n: n.rlike("^[0-9]+$") & (F.length(n) < 4))
    return t.disease_label_to_node_multi.filter("mappings is not null").select("item_id", F.array_join(ids, ",").alias("kept")).filter("kept <> ''")


@query("""SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'qa_item') AND length(trim(text)) > 0""")
def incremental_exclusion(t: Tables) -> DataFrame:
    """What isn't processed yet and has text."""
    done = t.documents.filter("source = 'qa_item'").select("doc_id")
    return t.documents.filter("length(trim(text)) > 0").join(done, "doc_id", "left_anti").select("doc_id")


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, n_name), (r_name), ())""")
def rollup_levels(t: Tables) -> DataFrame:
    """Grouping sets."""
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events""")
def moving_average(t: Tables) -> DataFrame:
    """Frames and lag."""
    x = sliced(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], [F.col("ts"), F.col("event_id")], back=2)
    w = Window.partitionBy("user_id", "_slice").orderBy("_n")
    y = x.select("_own", "event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.lag("event_id").over(w).alias("prior"))
    return y.filter("_own").drop("_own")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_hours(t: Tables) -> DataFrame:
    """Tumbling windows over event time, as the streaming form in lattica.streaming computes them."""
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
