import json

import pytest

from lattica.sources import documents, readers, sinks
from lattica.streaming import windows

PAGE = """<html><head><title>A page</title><meta name="citation_author" content="X"><meta name="citation_doi" content="10/1"></head><body><nav><p>menu</p></nav>
<h1>Top &amp; more</h1><p>First<b>bold</b><p>second <script>no()</script>text<ul><li>one<li>two</ul><h2 id="sec">Below</h2><div class="figure-box"><p>aside</p></div><p>deep
<table><caption>Cap</caption><tr><th>a<th>b<tr><td>1<td>2</table><img src="/i.png" alt="pic"><img src="/i.png"><a href="#sec">go</a></body>"""


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    got = [(r.kind, r.level, r.path, r.text) for r in documents.html_sections(df, "id", "html").orderBy("id", "ord").collect()]
    assert got == [("heading", 1, "Top & more", "Top & more"), ("p", 1, "Top & more", "Firstbold"), ("p", 1, "Top & more", "second text"), ("li", 1, "Top & more", "- one"), ("li", 1, "Top & more", "- two"), ("heading", 2, "Top & more / Below", "Below"), ("p", 2, "Top & more / Below", "deep")]
    assert [(r.caption, r.cells) for r in documents.html_tables(df, "id", "html").orderBy("row_ix").collect()] == [("Cap", ["a", "b"]), ("Cap", ["1", "2"])]
    assert [(r.url, r.alt) for r in documents.html_images(df, "id", "html", "http://h/x").collect()] == [("http://h/i.png", "pic")]
    meta = documents.html_metadata(df, "id", "html").filter("id = 1").first()
    assert (meta.title, meta.authors, meta.doi) == ("A page", ["X"], "10/1")
    assert [r.anchor for r in documents.html_anchor_sections(df, "id", "html").collect()] == ["sec"]
    assert "no()" not in documents.html_text(df, "id", "html").filter("id = 1").first().text


def test_markdown(spark):
    text = "before\n# A\none\n\ntwo\n### B\nx\n## C\n# D"
    rows = documents.markdown_chapters(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t").filter("id = 1").orderBy("chapter_no").collect()
    assert [(r.chapter_no, r.level, r.title, r.parent_no, r.text) for r in rows] == [(0, None, None, None, "before"), (1, 1, "A", None, "one\ntwo"), (2, 3, "B", 1, "x"), (3, 2, "C", 1, ""), (4, 1, "D", None, "")]
    body = documents.body_after_rule(spark.createDataFrame([(1, "head\n====\na\n\n=x\nb")], "id int, t string"), "id", "t")
    assert [r.line for r in body.orderBy("line_no").collect()] == ["a", "b"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"x": 3}]}))
    (tmp_path / "e.json").write_text(json.dumps({"meta": {}, "items": [{"x": 4}]}))
    assert readers.json_records(spark, f"{tmp_path}/a.json", "x int").count() == 2
    assert readers.json_records(spark, f"{tmp_path}/none.json", "x int", missing_ok=True).count() == 0
    assert sorted(r.x for r in readers.json_list_or_results(spark, f"{tmp_path}/[ab].json", "x int").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="neither a list"):
        readers.json_list_or_results(spark, f"{tmp_path}/e.json", "x int").collect()
    assert [(r.file, r.x) for r in readers.json_envelope(spark, f"{tmp_path}/e.json", "x int").collect()] == [("e.json", 4)]
    (tmp_path / "m.rrf").write_text("\n".join(["|".join(map(str, range(20))), "1|2"]))
    assert [tuple(r) for r in readers.delimited(spark, f"{tmp_path}/m.rrf", ["a", "b"]).collect()] == [("0", "1")]
    (tmp_path / "t.csv").write_text("id,p\n1,0.5\n")
    assert readers.parquet_or_csv(spark, f"{tmp_path}/t", "id int, p double").count() == 1
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.csv_table(spark, f"{tmp_path}/t.csv", "id int, p double", "z")
    with pytest.raises(ValueError, match="no probability"):
        readers.check_probabilities(spark.createDataFrame([(1.5,)], "p double"), "p")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, route string")
    path = str(tmp_path / "t")
    assert sinks.write_new(df, path, ["k"]) == 2 and sinks.write_new(df, path, ["k"]) == 0
    assert sinks.replace_table(df.limit(1), path).endswith("backup-1") and spark.read.parquet(path).count() == 1
    sinks.write_routes(df, str(tmp_path / "r"), "route")
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["route=a", "route=b"]
    sinks.write_csv(df, str(tmp_path / "c"), ["k"])
    assert "| k | route |" in sinks.report(df, "T")


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streams_equal_batches(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    run(windows.tumbling(windows.event_stream(spark, sf_dir)), "tumbling", "complete")
    want = {(r.event_type, r.hour): r.n for r in events.selectExpr("event_type", "date_trunc('hour', ts) as hour").groupBy("event_type", "hour").count().withColumnRenamed("count", "n").collect()}
    assert {(r.event_type, r.hour): r.n for r in spark.table("tumbling").collect()} == want
    run(windows.running_counts(windows.event_stream(spark, sf_dir)), "counts", "update")
    assert {r.user_id: r.n for r in spark.table("counts").collect()} == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    run(windows.sessions(windows.event_stream(spark, sf_dir)), "sessions", "complete")
    assert sum(r.n for r in spark.table("sessions").collect()) == events.count()


def test_variants_of_sections(spark):
    long = "word " * 40
    pages = [(1, f"<p>x</p><div data-article-body='true'><p>a<div class='c-article-table'><p>no</p></div><h1>H</h1><p>b</div><p>c"), (2, f"<div id='main'><p>short</p></div><article><section class='section'><p>{long}</p></section><p>end</p></article><p>out</p>"), (3, "<p>only</p>"), (4, None), (5, "<div class='content'><p>unclosed " + long)]
    df = spark.createDataFrame(pages, "id int, html string")
    got = lambda v: {i: [(r.path, r.text) for r in sorted(documents.html_sections(df, "id", "html", v).filter(f"id = {i}").collect(), key=lambda r: r.ord)] for i in range(1, 6)}
    chapter, saved = got("chapter"), got("saved")
    assert chapter[1] == [("Untitled", "a"), ("H", "H"), ("H", "b")] and chapter[2] == chapter[3] == chapter[4] == []
    assert saved[2] == [("", long.strip()), ("", "end")] and saved[3] == [("", "only")] and saved[4] == [] and saved[5] == [("", f"unclosed {long}".strip())]
