"""Queries that write files from the tables and read them back, so that every reader and sink meets whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.operators import models as M
from lattica.plans.registry import Registry, Tables
from lattica.session import scratch_path
from lattica.sources import documents as D
from lattica.sources import readers as S
from lattica.sources import sinks as K

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"


def _customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def _texts(df: DataFrame, path: str) -> None:
    """One text file a row; each of `df`'s rows (name, value) is a partition, so a file holds one value whole."""
    df.select("name", "value").write.partitionBy("name").option("lineSep", "\n").text(path)


def _lists(t: Tables, wrap: str = "%s") -> DataFrame:
    """A JSON text for every thousand customer keys, so that no file grows with the table."""
    own = F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal")))
    return t.customer.groupBy(F.floor(F.col("c_custkey") / 1000).alias("name")).agg(F.format_string(wrap, own).alias("value"))


_ALL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


@query(_ALL)
def json_arrays(t: Tables) -> DataFrame:
    """All files of a folder, each a JSON array of records."""
    path = scratch_path(t.spark, "arrays")
    _texts(_lists(t), path)
    return S.json_records(t.spark, path, _CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query(_ALL)
def json_envelopes(t: Tables) -> DataFrame:
    """Items of {meta, items} files."""
    path = scratch_path(t.spark, "envelopes")
    _texts(_lists(t, '{"meta": {"v": 1}, "items": %s}'), path)
    return S.json_envelope(t.spark, path, _CUSTOMER.replace(" bigint", ":bigint").replace(" string", ":string").replace(" int", ":int").replace(" double", ":double")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query(_ALL)
def json_results(t: Tables) -> DataFrame:
    """Files that hold a list or {results: list}."""
    path = scratch_path(t.spark, "results")
    lists = _lists(t).withColumn("value", F.when(F.col("name") % 2 == 0, F.col("value")).otherwise(F.format_string('{"results": %s}', "value")))
    _texts(lists, path)
    item = _CUSTOMER.replace(" bigint", ":bigint").replace(" string", ":string").replace(" int", ":int").replace(" double", ":double")
    return S.json_list_or_results(t.spark, path, item).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT count(*) AS n FROM customer WHERE false")
def json_missing(t: Tables) -> DataFrame:
    """A file that is missing, as an empty frame."""
    return S.json_records(t.spark, scratch_path(t.spark, "absent"), _CUSTOMER, missing_ok=True).agg(F.count("*").alias("n"))


@query(_ALL)
def json_lines(t: Tables) -> DataFrame:
    """JSON lines written and read."""
    path = scratch_path(t.spark, "lines")
    K.write_json(_customers(t), path)
    return t.spark.read.schema(_CUSTOMER).json(path)


@query(_ALL)
def csv_files(t: Tables) -> DataFrame:
    """CSV with required columns, written and read."""
    path = scratch_path(t.spark, "csv")
    K.write_csv(_customers(t), path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return S.csv_table(t.spark, path, _CUSTOMER, "c_custkey", "c_name")


@query("SELECT c_custkey, c_name, 'csv' AS kind FROM customer UNION ALL SELECT c_custkey, c_name, 'parquet' FROM customer")
def base_path_scan(t: Tables) -> DataFrame:
    """Parquet where it exists, else CSV."""
    base = scratch_path(t.spark, "base")
    own = _customers(t)
    K.write_csv(own, f"{base}/a.csv", own.columns)
    K.write_csv(own.limit(0), f"{base}/b.csv", own.columns)
    K.write_parquet(own, f"{base}/b.parquet")
    read = lambda x, kind: S.parquet_or_csv(t.spark, f"{base}/{x}", _CUSTOMER).select("c_custkey", "c_name", F.lit(kind).alias("kind"))
    return read("a", "csv").unionByName(read("b", "parquet"))


@query("SELECT s, label, round(p, 6) AS p FROM (SELECT o_orderkey AS s, o_orderpriority AS label, least(1.0::DOUBLE, o_totalprice / 1000000.0::DOUBLE) AS p FROM orders)")
def probability_matrix(t: Tables) -> DataFrame:
    """A matrix in long form, written, read, and checked to hold probabilities."""
    path = scratch_path(t.spark, "matrix")
    K.write_parquet(t.orders.select(F.col("o_orderkey").alias("s"), F.col("o_orderpriority").alias("label"), F.least(F.lit(1.0), F.col("o_totalprice") / 1_000_000).alias("p")), path)
    return S.check_probabilities(t.spark.read.parquet(path), "p").select("s", "label", F.round("p", 6).alias("p"))


@query("SELECT o_orderkey, 'test_annot' AS wanted FROM orders WHERE o_orderkey % 10 = 9 UNION ALL SELECT o_orderkey, 'train' FROM orders WHERE o_orderkey % 10 < 7")
def split_scan(t: Tables) -> DataFrame:
    """Rows of a split, or of the split it falls back on."""
    path = scratch_path(t.spark, "splits")
    split = F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 9, "val").otherwise("test")
    K.write_parquet(t.orders.select("o_orderkey", split.alias("split")), path, ["split"])
    read = lambda s, *f: S.split_files(t.spark, path, s, f).select("o_orderkey", F.lit(s).alias("wanted"))
    return read("train").unionByName(read("test_annot", "test"))


@query("SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS size FROM embeddings")
def vector_scan(t: Tables) -> DataFrame:
    """Vectors beside their metadata, of one size."""
    return S.check_vectors(t.embeddings, "embedding").select("vec_id", "label", F.size("embedding").cast("bigint").alias("size"))


@query("SELECT o_orderkey AS f0, o_custkey AS f1, o_orderpriority AS f17 FROM orders WHERE o_orderkey % 3 <> 0")
def delimited_scan(t: Tables) -> DataFrame:
    """Pipe-delimited lines with at least eighteen fields; shorter ones drop."""
    path = scratch_path(t.spark, "delimited")
    long_ = F.concat_ws("|", "o_orderkey", "o_custkey", *[F.lit("x")] * 15, "o_orderpriority", F.lit("more"))
    t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("|", "o_orderkey", "o_custkey")).otherwise(long_).alias("value")).write.text(path)
    names = [f"f{i}" for i in range(18)]
    return S.delimited(t.spark, path, names).select(F.col("f0").cast("bigint").alias("f0"), F.col("f1").cast("bigint").alias("f1"), "f17")


@query("SELECT ontology_id, replace(array_to_string(list_transform(string_split(COALESCE(type, 'none'), '_'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ''), ' ', '') AS category FROM ontology_entity")
def ontology_files(t: Tables) -> DataFrame:
    """Entries of several files, each tagged with the category its file's name gives."""
    path = scratch_path(t.spark, "ontology")
    o = t.ontology_entity.select("ontology_id", F.coalesce("type", F.lit("none")).alias("type"))
    names = sorted(r[0] for r in o.select("type").distinct().collect())  # the types of the list, a few
    parts = None
    for n in names:
        o.filter(F.col("type") == n).select("ontology_id").write.json(f"{path}/{n}.json")
        x = t.spark.read.schema("ontology_id string").json(f"{path}/{n}.json").withColumn("file", F.lit(f"{n}.json"))
        parts = x if parts is None else parts.unionByName(x)
    return parts.select("ontology_id", S.source_type(parts).alias("category"))


@query("SELECT c_custkey, c_mktsegment AS route FROM customer")
def routed_outputs(t: Tables) -> DataFrame:
    """One write that parts its rows by route."""
    path = scratch_path(t.spark, "routes")
    K.write_routes(t.customer.select("c_custkey", F.col("c_mktsegment").alias("route")), path, "route")
    return t.spark.read.parquet(path).select("c_custkey", F.col("route").cast("string").alias("route"))


@query("SELECT c_custkey, 'new' AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'backup' FROM customer")
def replaced_table(t: Tables) -> DataFrame:
    """A table replaced, its old version kept beside it."""
    path = scratch_path(t.spark, "table")
    K.replace_table(t.customer.select("c_custkey"), path)
    backup = K.replace_table(t.customer.filter("c_custkey % 2 = 0").select("c_custkey"), path)
    read = lambda p, v: t.spark.read.parquet(p).select("c_custkey", F.lit(v).alias("version"))
    return read(path, "new").unionByName(read(backup, "backup"))


@query("SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1")
def repeated_appends(t: Tables) -> DataFrame:
    """Rows appended twice stand once."""
    path = scratch_path(t.spark, "appends")
    K.write_new(t.customer.filter("c_custkey % 2 = 0").select("c_custkey"), path, ["c_custkey"])
    K.write_new(t.customer.select("c_custkey"), path, ["c_custkey"])
    return t.spark.read.parquet(path).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT '## Customers' || chr(10) || chr(10) || '| r_name | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) || chr(10) AS report FROM (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def markdown_report(t: Tables) -> DataFrame:
    """A summary as a Markdown table."""
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.spark.createDataFrame([(K.report(x.groupBy("r_name").agg(F.count("*").alias("n")).orderBy("r_name"), "Customers"),)], "report string")


# pages


def _pages(t: Tables) -> DataFrame:
    """Orders as pages: metadata, two sections, a table, a picture twice, links to a part that exists and to one that doesn't."""
    return t.orders.select(
        "o_orderkey",
        F.concat(
            F.lit("<html><head><title>Order "), "o_orderkey", F.lit("</title><meta name='citation_author' content='A. "), "o_custkey", F.lit("'><meta name='citation_doi' content='10.1/"), "o_orderkey",
            F.lit("'><style>p {}</style></head><body><nav><p>menu</p></nav><h1>Head</h1><p>First  "), "o_orderpriority", F.lit("</p><h2>Sub</h2><ul><li>item "), "o_orderstatus",
            F.lit("</li></ul><table><caption>Prices</caption><tr><th>k</th><th>v</th></tr><tr><td>"), "o_orderkey", F.lit("</td><td>"), "o_custkey",
            F.lit("</td></tr></table><img src='/p/"), "o_custkey", F.lit(".png' alt='x'><img src='/p/"), "o_custkey", F.lit(".png'><a href='#s1'>to</a><a href='#s9'>off</a><div id='s1'>Part "), "o_orderstatus", F.lit("</div><script>var x;</script></body></html>"),
        ).alias("page"),
    )


@query("SELECT o_orderkey, ord, kind, level, path, text FROM (SELECT o_orderkey, 0 AS ord, 'heading' AS kind, 1 AS level, 'Head' AS path, 'Head' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'p', 1, 'Head', 'First ' || o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'heading', 2, 'Head / Sub', 'Sub' FROM orders UNION ALL SELECT o_orderkey, 3, 'li', 2, 'Head / Sub', '- item ' || o_orderstatus FROM orders)")
def page_sections(t: Tables) -> DataFrame:
    """Headings, paragraphs and list items of live pages with the headings above them."""
    return D.html_sections(_pages(t), "o_orderkey", "page")


@query("SELECT o_orderkey, ord, kind, level, path, text FROM (SELECT o_orderkey, 0 AS ord, 'p' AS kind, 0 AS level, 'Untitled' AS path, 'before ' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'heading', 2, o_orderpriority, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'li', 1, o_orderpriority, '- item' FROM orders)")
def chapter_sections(t: Tables) -> DataFrame:
    """The body of a publisher's chapter without its figures."""
    page = F.concat(F.lit("<body><p>top</p><div data-article-body='true'><p>before "), "o_orderkey", F.lit("</p><div class='c-article-table'><p>cell</p></div><h2>"), "o_orderpriority", F.lit("</h2><ul><li>item</ul><script>x</script></div><p>after</p></body>"))
    return D.html_sections(t.orders.select("o_orderkey", page.alias("page")), "o_orderkey", "page", "chapter")


@query("SELECT o_orderkey, ord, kind, level, path, text FROM (SELECT o_orderkey, 0 AS ord, 'heading' AS kind, 1 AS level, 'Long' AS path, 'Long' AS text, o_orderkey % 2 = 0 AS long FROM orders UNION ALL SELECT o_orderkey, 1, 'p', 1, 'Long', repeat('text ', 30) || o_orderkey, o_orderkey % 2 = 0 FROM orders) WHERE long UNION ALL SELECT o_orderkey, ord, kind, level, path, text FROM (SELECT o_orderkey, 0 AS ord, 'p' AS kind, 0 AS level, '' AS path, 'side' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'heading', 1, 'Long', 'Long' FROM orders UNION ALL SELECT o_orderkey, 2, 'p', 1, 'Long', 'short' FROM orders) WHERE o_orderkey % 2 <> 0")
def saved_sections(t: Tables) -> DataFrame:
    """The longest container of a saved page, else the page."""
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.repeat(F.lit("text "), 30), F.col("o_orderkey").cast("string"))).otherwise("short")
    page = F.concat(F.lit("<body><div class='content'><p>side</p></div><main><h1>Long</h1><p>"), body, F.lit("</p></main></body>"))
    return D.html_sections(t.orders.select("o_orderkey", page.alias("page")), "o_orderkey", "page", "saved")


@query("SELECT o_orderkey, 0 AS table_ix, row_ix, 'Prices' AS caption, CASE row_ix WHEN 0 THEN 'k|v' ELSE o_orderkey || '|' || o_custkey END AS cells FROM orders, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS row_ix)")
def page_tables(t: Tables) -> DataFrame:
    """Rows of tables with their captions."""
    return D.html_tables(_pages(t), "o_orderkey", "page").select("o_orderkey", "table_ix", "row_ix", "caption", F.array_join("cells", "|").alias("cells"))


@query("SELECT o_orderkey, 'http://h/p/' || o_custkey || '.png' AS url, 'x' AS alt FROM orders")
def page_images(t: Tables) -> DataFrame:
    """Pictures by absolute address, each once a page."""
    return D.html_images(_pages(t), "o_orderkey", "page", "http://h/a/b.html")


@query("SELECT o_orderkey, 'Order ' || o_orderkey AS title, 'A. ' || o_custkey AS authors, '10.1/' || o_orderkey AS doi FROM orders")
def page_metadata(t: Tables) -> DataFrame:
    """Title, authors and identifier of pages."""
    return D.html_metadata(_pages(t), "o_orderkey", "page").select("o_orderkey", "title", F.array_join("authors", ";").alias("authors"), "doi")


@query("SELECT o_orderkey, 's1' AS anchor, 'Part ' || o_orderstatus AS text FROM orders")
def page_anchors(t: Tables) -> DataFrame:
    """Parts of a page that its links point to."""
    return D.html_anchor_sections(_pages(t), "o_orderkey", "page")


@query("SELECT o_orderkey, concat_ws(chr(10), 'Order ' || o_orderkey, 'menu', 'Head', 'First ' || o_orderpriority, 'Sub', 'item ' || o_orderstatus || 'Prices', 'kv', o_orderkey || o_custkey || 'tooff', 'Part ' || o_orderstatus) AS text FROM orders")
def page_texts(t: Tables) -> DataFrame:
    """A page's text without markup."""
    return D.html_text(_pages(t), "o_orderkey", "page")


@query("SELECT c_custkey, chapter_no, level, title, parent_no, text FROM (SELECT c_custkey, CAST(0 AS BIGINT) AS chapter_no, NULL::INTEGER AS level, NULL AS title, NULL::BIGINT AS parent_no, 'before' AS text FROM customer UNION ALL SELECT c_custkey, 1, 1, c_name, NULL, 'body' FROM customer UNION ALL SELECT c_custkey, 2, 3, c_mktsegment, 1, 'a' || chr(10) || 'b' FROM customer UNION ALL SELECT c_custkey, 3, 2, 'Last', 1, '' FROM customer)")
def markdown_tree(t: Tables) -> DataFrame:
    """Chapters of Markdown with their parents; text before the first heading is chapter 0."""
    md = F.concat(F.lit("before\n# "), "c_name", F.lit("\nbody\n\n### "), "c_mktsegment", F.lit("\n a \nb\n## Last"))
    x = D.markdown_chapters(t.customer.select("c_custkey", md.alias("md")), "c_custkey", "md")
    return x.select("c_custkey", F.col("chapter_no").cast("bigint").alias("chapter_no"), "level", "title", F.col("parent_no").cast("bigint").alias("parent_no"), "text")


@query("SELECT c_custkey, line_no, CASE line_no WHEN 3 THEN 'first' ELSE c_name END AS line FROM customer, (SELECT CAST(unnest([3, 6]) AS INTEGER) AS line_no)")
def ruled_bodies(t: Tables) -> DataFrame:
    """Lines after a rule, without blank ones and further rules."""
    text = F.concat(F.lit("title\nsource\n=====\nfirst\n\n=====\n"), "c_name")
    return D.body_after_rule(t.customer.select("c_custkey", text.alias("body")), "c_custkey", "body").select("c_custkey", "line_no", "line")


# models


def _samples(t: Tables) -> DataFrame:
    """Orders with numeric features, one of them sometimes missing, and two labels."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count("*").cast("double").alias("lines"))
    x = t.orders.join(lines, "o_orderkey")
    return x.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("quantity")).alias("quantity"), "discount", "lines", (F.col("lines") > 4).cast("int").alias("long"), (F.col("quantity") > 25).cast("int").alias("heavy"))


@query()
def stacked_probabilities(t: Tables) -> DataFrame:
    """Probabilities out of fold by boosted trees a label, folds even in each combination of labels; scored on rows the models never saw."""
    x = _samples(t)
    p = M.out_of_fold(x, "o_orderkey", ["quantity", "discount", "lines"], ["long", "heavy"], folds=2, rounds=3, depth=3)
    truth = x.unpivot("o_orderkey", ["long", "heavy"], "label", "y")
    return p.join(truth, ["o_orderkey", "label"]).groupBy("label").agg(F.count("*").alias("n"), F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


@query()
def selected_features(t: Tables) -> DataFrame:
    """Features by their mean importance over labels with enough positives."""
    models = M.fit_labels(_samples(t), ["quantity", "discount", "lines"], ["long", "heavy"], min_pos=50, rounds=3, depth=3)
    return t.spark.createDataFrame(M.select_features(models, ["quantity", "discount", "lines"], 2), "feature string, importance double")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL")
def text_scan(t: Tables) -> DataFrame:
    """Lines of texts."""
    return t.documents.filter("text is not null").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@query("SELECT chapter_id, '- ' || string_agg(DISTINCT x, chr(10) || '- ' ORDER BY x) AS listing FROM (SELECT chapter_id, trim(ecg_finding) AS x FROM chapter_extraction_results WHERE trim(ecg_finding) <> '') GROUP BY 1")
def entity_listing(t: Tables) -> DataFrame:
    """the flat list of a chapter's findings."""
    x = t.chapter_extraction_results.filter("trim(ecg_finding) <> ''").select("chapter_id", F.trim("ecg_finding").alias("x")).distinct()
    return x.groupBy("chapter_id").agg(F.concat(F.lit("- "), F.array_join(F.array_sort(F.collect_list("x")), "\n- ")).alias("listing"))


@query("SELECT cache_id, CASE WHEN regexp_matches(original_text, '[一-鿿]') THEN 'zh' ELSE 'other' END AS script, upper(substr(trim(original_text), 1, 1)) AS initial FROM entity_mapping_cache WHERE trim(original_text) <> ''")
def script_tags(t: Tables) -> DataFrame:
    """Values by script."""
    x = t.entity_mapping_cache.filter("trim(original_text) <> ''")
    return x.select("cache_id", F.when(F.col("original_text").rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("other").alias("script"), F.upper(F.substring(F.trim("original_text"), 1, 1)).alias("initial"))


@query("SELECT id, no FROM (SELECT id, CASE WHEN regexp_matches(trim(title), '^\\d') THEN regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)', 1) ELSE lpad(CAST(start_page AS VARCHAR), 3, '0') END AS no FROM chapter WHERE start_page < 1000)")
def chapter_ids(t: Tables) -> DataFrame:
    """chapter ids from titles, else from their page."""
    return t.chapter.filter("start_page < 1000").select("id", X.chapter_number(F.col("title"), F.col("start_page")).alias("no"))
