"""Text, document and entity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.functions.python_text import PROTECTED, balanced_json_udf, batches_udf, fuzzy_ratio_udf, sentences_udf
from lattica.operators import entities as E
from lattica.plans.registry import Registry, Tables
from lattica.sources import documents as D

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql


@query(r"""SELECT doc_id, s AS sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS n FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS k FROM (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL)) WHERE trim(s) <> ''""")
def sentence_split(t: Tables) -> DataFrame:
    """sentences of all documents."""
    x = t.documents.filter("text is not null").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))
    return x.select("doc_id", "sentence", (F.col("n") + 1).cast("bigint").alias("n"))


_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _guarded(column: str) -> str:
    """SQL that hides the points of abbreviations."""
    out = column
    for a in PROTECTED:
        out = f"replace({out}, '{a}', '{a.replace('.', chr(0xE000))}')"
    return out


_PIECES = rf"list_filter(list_transform(string_split(regexp_replace({_guarded('text')}, '([.!?][\"'']*)({_SPACES}|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: replace(regexp_replace(x, '^{_SPACES}+|{_SPACES}+$', '', 'g'), '{chr(0xE000)}', '.')), lambda x: length(x) > 3)"
_FOLD = "list_reduce(list_transform({x}, lambda s: {{'done': []::VARCHAR[], 'cur': s}}), lambda a, b: CASE WHEN length(a.cur) + {gap} + length(b.cur) <= 1200 THEN {{'done': a.done, 'cur': a.cur || {glue} || b.cur}} ELSE {{'done': list_append(a.done, a.cur), 'cur': b.cur}} END)"
_S3 = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(f"""SELECT id, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, unnest(c) AS chunk FROM (SELECT id, list_append(r.done, r.cur) AS c FROM (SELECT id, {_FOLD.format(x='x', gap=1, glue="' '")} AS r FROM (SELECT id, {_S3} AS x FROM chapter WHERE text IS NOT NULL) WHERE len(x) > 0))""")
def chunk_pack(t: Tables) -> DataFrame:
    """Sentences packed into chunks."""
    x = t.chapter.filter("text is not null").select("id", F.posexplode(X.chunks(X.sentences(F.col("text")), 1200)).alias("chunk_index", "chunk"))
    return x.select("id", "chunk_index", "chunk")


@query(f"""SELECT id, CAST(unnest(range(len(c))) AS INTEGER) AS batch_no, unnest(c) AS batch FROM (SELECT id, list_append(r.done, r.cur) AS c FROM (SELECT id, {_FOLD.format(x='x', gap=2, glue='chr(10)')} AS r FROM
(SELECT id, list_transform(s, lambda v, i: '[' || i || '] ' || v) AS x FROM (SELECT id, {_PIECES} AS s FROM chapter WHERE text IS NOT NULL)) WHERE len(x) > 0))""")
def numbered_batches(t: Tables) -> DataFrame:
    """Sentences of all chapters, numbered and packed."""
    return t.chapter.filter("text is not null").select("id", F.posexplode(batches_udf("text")).alias("batch_no", "batch"))


@query(f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS n, unnest(s) AS sentence FROM (SELECT doc_id, {_PIECES} AS s FROM documents WHERE text IS NOT NULL)")
def protected_sentences(t: Tables) -> DataFrame:
    """sentences with abbreviations protected."""
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(sentences_udf("text")).alias("n", "sentence"))


@query(r"""SELECT node_id, regexp_replace(regexp_replace(name, '[\t\n\x0b\r\f ]+', ' ', 'g'), '^ | $', '', 'g') AS squeezed, lower(regexp_replace(regexp_replace(name, '[\t\n\x0b\r\f ]+', ' ', 'g'), '^ | $', '', 'g')) AS label FROM nodes WHERE name IS NOT NULL""")
def whitespace_normal(t: Tables) -> DataFrame:
    """squeezed white space and label keys."""
    x = t.nodes.filter("name is not null")
    return x.select("node_id", X.squeeze(F.col("name")).alias("squeezed"), X.label_key(F.col("name")).alias("label"))


@query(r"""SELECT cache_id, CASE WHEN COALESCE(r, '') = '' THEN 'RELATED_TO' WHEN regexp_matches(r, '^[0-9]') THEN 'REL_' || r ELSE r END AS rel FROM (SELECT cache_id, regexp_replace(regexp_replace(regexp_replace(upper(trim(original_text)), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS r FROM entity_mapping_cache)""")
def relation_names(t: Tables) -> DataFrame:
    """relation types from free text."""
    return t.entity_mapping_cache.select("cache_id", X.relation_name(F.col("original_text")).alias("rel"))


_TYPES = """CASE WHEN regexp_matches(ontology_id, '^TEMP_[a-zA-Z_]+_\\d+') THEN CASE lower(regexp_extract(ontology_id, '^TEMP_([a-zA-Z_]+)_\\d+', 1)) WHEN 'diseases' THEN 'Disease' WHEN 'disease' THEN 'Disease' WHEN 'symptoms' THEN 'Symptoms' WHEN 'treatments' THEN 'TreatmentIntervention' WHEN 'treatment' THEN 'TreatmentIntervention'
WHEN 'intervention' THEN 'TreatmentIntervention' WHEN 'examinations' THEN 'DiagnosticTest' WHEN 'diagnostic_test' THEN 'DiagnosticTest' WHEN 'patient_characteristics' THEN 'PatientCharacteristics' END
WHEN starts_with(ontology_id, 'SS') THEN 'Symptoms' WHEN starts_with(ontology_id, 'DT') THEN 'DiagnosticTest' WHEN starts_with(ontology_id, 'PC') THEN 'PatientCharacteristics' WHEN starts_with(ontology_id, 'TI') THEN 'TreatmentIntervention' WHEN starts_with(ontology_id, 'D') THEN 'Disease' END"""


@query(f"SELECT cache_id, {_TYPES} AS kind FROM entity_mapping_cache")
def types_of_ids(t: Tables) -> DataFrame:
    """Node types from ids."""
    return t.entity_mapping_cache.select("cache_id", X.type_of_id(F.col("ontology_id")).alias("kind"))


@query(r"""SELECT id, CASE WHEN regexp_matches(trim(title), '^\d') THEN regexp_extract(trim(title), '^(\d+(?:\.\d+)*)', 1) ELSE lpad(CAST(level AS VARCHAR), 3, '0') END AS no, CAST(least(greatest(CAST(floor(start_page / 120.0::DOUBLE * 100) AS BIGINT) + 1, 1), 100) AS BIGINT) AS page FROM chapter""")
def chapter_numbers(t: Tables) -> DataFrame:
    """chapter numbers and estimated pages."""
    return t.chapter.select("id", X.chapter_number(F.col("title"), F.col("level")).alias("no"), X.estimated_page(F.col("start_page"), F.lit(120.0)).alias("page"))


@query(r"""SELECT event_id, CAST(json_extract_string(regexp_extract('reply: ' || props || ' end', '(?s)\{.*\}', 0), '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL""")
def json_extract(t: Tables) -> DataFrame:
    """an object inside a reply."""
    reply = F.concat(F.lit("reply: "), "props", F.lit(" end"))
    return t.events.filter("props is not null").select("event_id", F.get_json_object(X.json_object(reply), "$.k").cast("bigint").alias("k"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE props IS NOT NULL""")
def json_repair(t: Tables) -> DataFrame:
    """Fenced replies with comments and trailing commas, repaired and balanced."""
    reply = F.concat(F.lit("```json\n[{\"v\": "), "props", F.lit(", \"type\": \""), "event_type", F.lit("\", /* note */ },]\n```"))
    item = F.from_json(balanced_json_udf(X.json_repair(reply)), "array<struct<v struct<k bigint>, type string>>")
    return t.events.filter("props is not null").withColumn("i", F.explode(item)).select("event_id", F.col("i.v.k").alias("k"), F.col("i.type").alias("event_type"))


@query(r"""SELECT a.ontology_id AS a, b.ontology_id AS b, round(CASE WHEN x = y THEN 1.0::DOUBLE WHEN contains(x, y) OR contains(y, x) THEN 0.8::DOUBLE ELSE len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) * 1.0::DOUBLE / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) END, 6) AS sim FROM (SELECT *, lower(name_en) AS x FROM ontology_entity) a JOIN (SELECT *, lower(name_en) AS y FROM ontology_entity) b ON a.parent_id = b.ontology_id""")
def term_similarities(t: Tables) -> DataFrame:
    """similarity of each term to its parent's."""
    up = t.ontology_entity.select(F.col("ontology_id").alias("b"), F.col("name_en").alias("nb"))
    x = t.ontology_entity.select(F.col("ontology_id").alias("a"), F.col("name_en").alias("na"), F.col("parent_id").alias("b"))
    return x.join(up, "b").select("a", "b", F.round(X.term_similarity(F.col("na"), F.col("nb")), 6).alias("sim"))


def indel_ratio(a: str, b: str) -> str:
    """SQL of the indel ratio of two texts: rows of the longest common subsequence, each the running maximum of what a character of `a` adds to the row before."""
    match = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END))"
    zeros = f"list_transform(string_split({b}, ''), lambda d: 0)"
    row = "list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(r[i], CASE WHEN m[i] = 1 THEN COALESCE(r[i - 1], 0) + 1 ELSE 0 END))))"
    return f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * list_reduce(list_prepend({zeros}, {match}), lambda r, m: {row})[-1] / (length({a}) + length({b})) END"


@query(f"SELECT cache_id, round({indel_ratio('a', 'b')}, 6) AS ratio FROM (SELECT cache_id, lower(original_text) AS a, lower(normalized_name) AS b FROM entity_mapping_cache WHERE original_text IS NOT NULL AND normalized_name IS NOT NULL)")
def fuzzy_ratios(t: Tables) -> DataFrame:
    """indel ratio of each typed text and its normalised name."""
    x = t.entity_mapping_cache.filter("original_text is not null and normalized_name is not null")
    return x.select("cache_id", F.round(fuzzy_ratio_udf(F.lower("original_text"), F.lower("normalized_name")), 6).alias("ratio"))


def cascade_sql(cache: str) -> str:
    """CTEs of the name cascade up to D (k, c, e, f, m): ids by cache, exact name, fuzzy name, and the nearest name at all."""
    return f"""M AS (SELECT ext_id, chapter_id, knowledge_entity AS text, lower(trim(knowledge_entity)) AS k FROM chapter_extraction_results), T AS (SELECT DISTINCT k FROM M WHERE k <> ''),
C AS (SELECT lower(trim(cache_key)) AS k, min(ontology_id) AS c FROM entity_mapping_cache WHERE {cache} AND ontology_id IN (SELECT ontology_id FROM ontology_entity) GROUP BY 1),
X AS (SELECT lower(trim(name)) AS k, min(ontology_id) AS e FROM (SELECT name_en AS name, ontology_id FROM ontology_entity UNION ALL SELECT name_cn, ontology_id FROM ontology_entity) GROUP BY 1),
P AS (SELECT lower(trim(name_en)) AS n, min(ontology_id) AS f FROM ontology_entity GROUP BY 1), O AS (SELECT k, c, e FROM T LEFT JOIN C USING (k) LEFT JOIN X USING (k)),
S AS (SELECT k, n, f, {indel_ratio('k', 'n')} AS s FROM O, P WHERE c IS NULL AND e IS NULL),
D AS (SELECT O.k, c, e, z.f, z.m FROM O LEFT JOIN (SELECT k, arg_max(f, (s, reverse(n))) FILTER (WHERE s >= 80) AS f, arg_max(f, (s, -rank)) FILTER (WHERE s >= 1) AS m FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS rank FROM S) GROUP BY 1) z ON O.k = z.k)"""


_METHOD = "CASE WHEN c IS NOT NULL THEN 'cache_hit' WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'fuzzy' ELSE 'new_entity' END"


@query(f"WITH {cascade_sql('true')} SELECT ext_id AS mention_id, text, COALESCE(c, e, f) AS ontology_id, CASE WHEN ext_id > min(ext_id) OVER (PARTITION BY M.k) AND {_METHOD} <> 'new_entity' THEN 'cache_hit' ELSE {_METHOD} END AS method FROM M LEFT JOIN D ON M.k = D.k")
def name_cascade(t: Tables) -> DataFrame:
    """Mentions settled by cache, exact and fuzzy names."""
    m = t.chapter_extraction_results.select(F.col("ext_id").alias("mention_id"), F.col("knowledge_entity").alias("text"))
    c = t.entity_mapping_cache.filter("ontology_id is not null").select(F.col("cache_key").alias("key"), "ontology_id").join(t.ontology_entity.select("ontology_id"), "ontology_id", "left_semi")
    return E.cascade(m, c, E.exact_names(t.ontology_entity), t.ontology_entity.select(F.col("name_en").alias("name"), "ontology_id"))


@query(r"""SELECT route, count(*) AS n FROM (SELECT CASE WHEN NOT COALESCE(o_totalprice / 400000, 0) > 0.8 THEN 'manual' WHEN o_orderstatus = 'F' THEN 'adopted' WHEN o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' THEN 'mapped' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'manual' END AS route FROM orders) GROUP BY 1""")
def review_routes(t: Tables) -> DataFrame:
    """Routes of reviewed suggestions."""
    action = F.when(F.col("o_orderstatus") == "F", "adopt").when(F.col("o_orderstatus") == "O", " MAP").otherwise("reject")
    target = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return t.orders.groupBy(E.review_route(action, target, F.col("o_totalprice") / 400000).alias("route")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents WHERE contains(lower(text), 'atrial')""")
def keyword_preview(t: Tables) -> DataFrame:
    """Keyword search with previews."""
    return t.documents.filter(F.contains(F.lower("text"), F.lit("atrial"))).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(r"""SELECT ontology_id, regexp_matches(COALESCE(definition, name_cn), '[一-鿿]') AS han, COALESCE(definition, name_cn) AS text FROM ontology_entity""")
def han_predicate(t: Tables) -> DataFrame:
    """Chinese text by script, over the first text present."""
    text = F.coalesce("definition", "name_cn")
    return t.ontology_entity.select("ontology_id", text.rlike("[\\u4e00-\\u9fff]").alias("han"), text.alias("text"))


@query(r"""SELECT title, count(*) AS n FROM (SELECT COALESCE(NULLIF(trim(section_title), ''), 'unknown') AS title FROM documents) GROUP BY 1""")
def section_titles(t: Tables) -> DataFrame:
    """section titles read from a heading line."""
    line = F.concat(F.lit("x\nSection: "), F.trim("section_title"))
    return t.documents.groupBy(X.section_title(F.coalesce(line, F.lit(""))).alias("title")).agg(F.count("*").alias("n"))


@query()
def markdown_chapters(t: Tables) -> DataFrame:
    """Chapters and parents of documents under headings made of title and section."""
    md = F.concat(F.lit("preamble\n# "), F.coalesce("source", F.lit("none")), F.lit("\n## "), F.coalesce("section_title", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return D.markdown_chapters(t.documents.select("doc_id", md.alias("md")), "doc_id", "md").select("doc_id", "chapter_no", "level", "title", "parent_no", F.length("text").alias("size"))


@query()
def html_sections(t: Tables) -> DataFrame:
    """Sections of chapters set as pages."""
    page = F.concat(F.lit("<html><body><nav>menu</nav><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n\n", "<p>"), F.lit("<script>x</script></body>"))
    return D.html_sections(t.chapter.filter("source_format = 'html'").select("id", page.alias("page")), "id", "page").select("id", "ord", "kind", "level", "path", F.length("text").alias("size"))


@query(r"""SELECT q, answer, answer = gold AS correct FROM (SELECT event_id AS q, CASE WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'B' WHEN event_type = 'error' THEN NULL ELSE 'C' END AS answer, CASE WHEN value > 50 THEN 'A' ELSE 'B' END AS gold FROM events)""")
def choice_parse(t: Tables) -> DataFrame:
    """answer letters from replies, valid ones only."""
    reply = F.when(F.col("event_type") == "view", F.lit('{"answer": " a "}')).when(F.col("event_type") == "click", F.lit("I'd say B)")).when(F.col("event_type") == "error", F.lit("unclear")).otherwise(F.lit("(C) fits"))
    valid = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    fixed = F.when(F.col("event_type") == "click", F.lit("B)")).otherwise(reply)
    a = X.choice(fixed, valid)
    gold = F.when(F.col("value") > 50, "A").otherwise("B")
    return t.events.select(F.col("event_id").alias("q"), a.alias("answer"), (a == gold).alias("correct"))
