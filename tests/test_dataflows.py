import importlib
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from lattica import session
from lattica.functions import text as X
from lattica.functions.python_text import batches, split_sentences
from lattica.operators import alignment, entities, graph, relational, retrieval, vectors
from lattica.operators.skew import lookup_join
from lattica.sources import sinks


def test_a_lost_module_is_an_error(monkeypatch):
    real = importlib.import_module

    def without(lost):
        def load(name, *a):
            if name == lost or name.startswith(lost + "."):
                raise ModuleNotFoundError(f"No module named {lost!r}", name=lost)
            return real(name, *a)

        return load

    for lost in ("lattica.plans.graphs", "lattica.functions.text", "lattica.operators.skew", "numpy"):
        monkeypatch.setattr(__spark_entry__.importlib, "import_module", lambda name, *a, lost=lost: without(lost)(lost) if name == "lattica.llm.queries" or name == lost else real(name, *a))
        with pytest.raises(ModuleNotFoundError):
            __spark_entry__.queries()
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", without("lattica.llm"))
    left = __spark_entry__.queries()
    assert "noisy_or_part" in left and not any(q.startswith("p1_") for q in left)


def test_a_cluster_needs_a_shared_folder(spark):
    nowhere = SimpleNamespace(isDefined=lambda: False)
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nowhere))))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y"))
    assert session.shared_folder(named) == "hdfs://x/y"


def test_staged_tables_are_removed(spark):
    x = session.staged(spark.range(5))
    folder = x._scratch.removeprefix("file:")
    while folder.startswith("//"):
        folder = folder[1:]
    assert x.count() == 5 and os.path.isdir(folder)
    session.release(x)
    assert not os.path.isdir(folder)
    session.release(x)


def test_lookup_join(spark):
    big = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3), ("z", 4)], "k string, v int")
    small = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
    want = sorted(map(str, big.join(small, "k", "left").select("k", "v", "w").collect()))
    for bound in (5, 1):
        assert sorted(map(str, lookup_join(big, small, "k", "left", bound).select("k", "v", "w").collect())) == want


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), k, rng.randrange(10)) for k in rng.sample(range(10_000), 600)]
    got = relational.running(spark.createDataFrame(rows, "key string, o int, v int"), ["key"], [F.col("o")], s=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, o, v in rows if k == r.key and o <= r.o]
        assert (r.s, r.n) == (sum(before), len(before))
    assert relational.running(spark.createDataFrame([], "key string, o int, v int"), ["key"], [F.col("o")], s=F.col("v")).collect() == []


def test_slices_see_their_neighbours(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a"]), k, rng.randrange(100)) for k in rng.sample(range(10_000), 200)]
    x = relational.sliced(spark.createDataFrame(rows, "key string, o int, v int"), ["key"], [F.col("o")], back=2, ahead=1, size=7)
    w = Window.partitionBy("key", "_slice").orderBy("_n")
    got = x.select("_own", "key", "o", F.sum("v").over(w.rowsBetween(-2, 1)).alias("s"), F.lead("o").over(w).alias("nxt")).filter("_own").collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((o, v) for k, o, v in rows if k == r.key)
        i = own.index(next(x for x in own if x[0] == r.o))
        assert r.s == sum(v for _, v in own[max(0, i - 2) : i + 2]) and r.nxt == (own[i + 1][0] if i + 1 < len(own) else None)


def test_first_containment(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    vocab = [(f"{k:03d}", word(rng.randrange(2, 6)), word(rng.randrange(3, 9))) for k in range(40)] + [("900", None, None), ("901", "", "")]
    texts = [(k, word(rng.randrange(1, 12))) for k in range(200)] + [(500, None), (501, "c")]
    want = {k: next((o for o, n, other in sorted(vocab) if n and n in t or other and t in other), None) for k, t in texts if t}
    v, d = spark.createDataFrame(vocab, "o string, n string, other string"), spark.createDataFrame(texts, "k int, t string")
    for block in (1000, 7):
        got = {r.k: r.o for r in relational.first_containment(d, v, "k", "t", "n", "other", "o", block).collect()}
        assert got == {k: o for k, o in want.items() if o}
    assert relational.first_containment(d, v.filter("false"), "k", "t", "n", "other", "o").collect() == []


def test_top_k_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(120)]
    rows[7] = (7, rows[3][1])
    df = spark.createDataFrame([*rows, (999, None)], "id bigint, v array<double>")
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    sim = lambda a, b: round(dot(a, b) / ((dot(a, a) ** 0.5 + 1e-12) * (dot(b, b) ** 0.5 + 1e-12)), 6) + 0.0
    want = {(q, k, r) for q, qv in rows if q % 20 == 0 for r, (_, k) in enumerate(sorted((-sim(v, qv), k) for k, v in rows)[:5], 1)}
    for block in (4096, 2):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert {(r.q, r.id, r.r) for r in vectors.top_k(df, asked, "id", "v", "q", "qv", 5).collect()} == want
    assert vectors.top_k(df, asked.filter("false"), "id", "v", "q", "qv", 5).collect() == []
    assert vectors.top_k(df.filter("false"), asked, "id", "v", "q", "qv", 5).collect() == []


def test_depths_beyond_any_limit_and_cycles(spark):
    chain = [(k, "HAS_CHILD", k + 1) for k in range(70)] + [(0, "HAS_CHILD", 50), (500, "HAS_CHILD", 501), (501, "HAS_CHILD", 500), (501, "HAS_CHILD", 502), (5, "OTHER", 900)]
    got = {r.node_id: r.depth for r in graph.depths(spark.createDataFrame(chain, "src int, rel string, dst int")).collect()}
    assert got == {k: k for k in range(71)}


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [(k, ["Knowledge", "Part"] if k % 2 else ["Ontology", "Site"], f"n{k}") for k in range(8)]
    edges = [(0, "CAUSES", 1, None), (1, "CAUSES", 0, None), (2, "HAS_CHILD", 3, None), (1, "IS_A", 3, None), (1, "IS_A", 3, "x"), (3, "instantiates", 5, None), (4, "TREATS", 5, None)]
    return graph.Graph(spark.createDataFrame(nodes, "node_id bigint, labels array<string>, name string"), spark.createDataFrame(edges, "src bigint, rel string, dst bigint, relation_type string"))


def test_edge_views(spark, small_graph):
    g = small_graph
    assert {(r.a, r.b, r.rel) for r in graph.oriented(g, "Part", "Site").collect()} == {(1, 0, "CAUSES"), (3, 2, "HAS_CHILD"), (5, 4, "TREATS")}
    assert len(graph.touching(g.edges, spark.createDataFrame([(1,), (0,), (1,)], "node_id bigint")).collect()) == 4
    assert {(r.node_id, r.role, r.other) for r in graph.lineage(g.edges).collect()} == {(1, "parent", 3), (3, "child", 1), (3, "parent", 5), (5, "child", 3)}
    assert len([r for r in graph.adjacency(g.edges).collect() if r.node_id == 1]) == 3
    assert {(r.node_id, r.node_type) for r in graph.flat_nodes(g.nodes, ("Ontology", "Site", "None")).collect()} == {(k, t) for k in (0, 2, 4, 6) for t in ("Ontology", "Site")}
    nodes, edges = graph.local_export(g, ("Part", "Site"))
    assert {(r.node_type, r.node_id, r.local_id) for r in nodes.collect()} == {("Part" if k % 2 else "Site", k, k // 2) for k in range(8)}
    assert ("TREATS", "Site", 2, "Part", 2) in {tuple(r) for r in edges.collect()}


def test_alignment_verdicts(spark):
    rows = [(1, " Diseases ", "D1", 7), (2, "diseases", None, None), (3, "diseases", " ", 7), (4, "pacing", "P1", None), (5, "planets", "D1", 7), (6, None, "D1", 7)]
    v = spark.createDataFrame(rows, "k int, ontology_type string, selected_id string, selected_node bigint")
    got = {r.k: (r.status == alignment.TYPED, r.ontology_id, r.label, r.target) for r in alignment.apply_alignment(v, "k").collect()}
    assert got == {1: (True, "D1", "Disease", 7), 2: (True, "TEMP_diseases_2", "Disease", None), 3: (True, "TEMP_diseases_3", "Disease", None), 4: (True, "TEMP_pacing_4", "PatientCharacteristics", None), 5: (False, None, None, None), 6: (False, None, None, None)}
    first = spark.createDataFrame([(1, "MERGED"), (2, "TYPED"), (3, "NONE")], "k int, action string")
    statuses = alignment.two_stage_alignment(spark.range(1, 8).select(F.col("id").cast("int").alias("k")), first, v, "k")
    assert {r.k: r.status for r in statuses.collect()} == {1: alignment.MERGED, 2: alignment.TYPED_BEFORE, 3: alignment.TYPED, 4: alignment.TYPED, 5: alignment.FAILED, 6: alignment.FAILED, 7: alignment.FAILED}
    assert {r.status: r.n for r in alignment.status_counts(statuses).collect()}["total_untyped"] == 7


def test_retrieval_texts(spark, small_graph):
    g = small_graph
    anchors = spark.createDataFrame([("a", 1, 0.9), ("a", 3, 0.5), ("b", 6, 0.7)], "q string, node_id bigint, sim double")
    got = {r.q: r for r in retrieval.hop_evidence(anchors, g, "q").collect()}
    assert got["a"].anchors == 2 and got["a"].context.startswith("[Chunk 1] [Anchor] 1\n-[CAUSES]-> n0\nn0 -[CAUSES]->") and got["b"].edges == 0 and got["b"].context == "(No graph evidence retrieved.)"
    assert "Chunk 2" in got["a"].context and "Chunk 2" not in retrieval.hop_evidence(anchors, g, "q", budget=4).filter("q = 'a'").first().context
    paths = {r.q: r for r in retrieval.path_evidence(anchors, g, "q").collect()}
    assert paths["a"].paths == 1 and paths["a"].context == "[Chunk 1] [Path] n1 (id=1)  -[IS_A]->  n3 (id=3)" and paths["b"].paths == 0
    hits = retrieval.with_triples(anchors, g).collect()
    assert {(r.node_id, r.props, r.triple_count) for r in hits} == {(1, "Knowledge:Part", 4), (3, "Knowledge:Part", 4), (6, "", 0)}
    found = retrieval.find_anchors(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "node_id bigint, vec array<double>"), spark.createDataFrame([("a", "x", [3.0, 1.0]), ("a", "y", [2.9, 1.0])], "q string, entity string, qvec array<double>"), "q", 0.9, 2)
    assert {(r.q, r.node_id) for r in found.collect()} == {("a", 3), ("a", 2)}


def test_entities_and_records(spark):
    rows = [("a", 1, "AF"), ("a", 2, " af "), ("a", 3, "MI"), ("a", 4, None), ("a", 5, " "), ("b", 1, "x"), (None, 1, "y")]
    got = retrieval.distinct_entities(spark.createDataFrame(rows, "q string, o int, text string"), "q", "text", "o", 2)
    assert {(r.q, r.o) for r in got.collect()} == {("a", 1), ("a", 3), ("b", 1), (None, 1)}
    x = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A"), ("A", None)], "a string, g string").select(*retrieval.answer_record("m", F.col("a"), F.col("g"), F.lit("c")))
    assert [r.is_correct for r in x.collect()] == [True, False, False, None]


def test_embed_new_retries_and_leaves_failures(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    rows = [(1, "one"), (2, "bad"), (3, "three"), (4, None), (5, " "), (6, "done")]
    got = retrieval.embed_new(spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame([(6,)], "k int"), "k", "t", embed, batch=3)
    assert {r.k: r.vec for r in got.collect()} == {1: [3.0], 3: [5.0]}


def test_lookup_in_array(spark):
    x = spark.createDataFrame([(1, [2, 9, 2]), (2, []), (3, None)], "k int, ids array<int>")
    names = spark.createDataFrame([(2, "two")], "id int, name string")
    assert {r.k: r.texts for r in relational.lookup_in_array(x, "k", "ids", names, "id", "name").collect()} == {1: ["two", "Sentence 9 not found", "two"], 2: [], 3: None}
    with pytest.raises(ValueError, match="missing columns: b"):
        relational.select_features(names, "id", ["name", "b"])


def test_cascade_with_model(spark):
    mentions = spark.createDataFrame([(1, "strial fibrillation"), (2, "Heart Block"), (3, "cached"), (4, "something else"), (5, "something else"), (6, None), (7, "zz")], "mention_id int, text string")
    cache = spark.createDataFrame([("cached", "C1")], "key string, ontology_id string")
    names = spark.createDataFrame([("atrial fibrillation", "D1"), ("heart block", "D2"), ("something", "D3")], "name string, ontology_id string")
    asked = []

    def model(prompts):
        asked.extend(prompts)
        return ["D9" if p.startswith("something else") else None for p in prompts]

    got = {r.mention_id: (r.ontology_id, r.method) for r in entities.cascade(mentions, cache, names, model=model).collect()}
    assert got == {1: ("D1", "fuzzy"), 2: ("D2", "exact"), 3: ("C1", "cache_hit"), 4: ("D9", "llm_match"), 5: ("D9", "cache_hit"), 6: (None, "new_entity"), 7: (None, "new_entity")}


def test_sentences_of_the_state_machine():
    assert split_sentences("The U.S. trial ended early. Dr. Who, e.g. at 9 a.m. came! \"Why?\" he said.") == ["The U.S. trial ended early.", "Dr. Who, e.g. at 9 a.m. came!", '"Why?"', "he said."]
    assert split_sentences("See Fig. 2 now. Ok. No. 5 is it") == ["See Fig.", "2 now.", "5 is it"]
    assert split_sentences(None) == split_sentences("  ") == [] and split_sentences("1.5 mg." * 3 + " x" * 50_000)[0].endswith("mg.")
    assert batches(["abcd"] * 3, 19) == ["[1] abcd\n[2] abcd", "[3] abcd"]


def test_small_functions(spark):
    one = lambda *cols: spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    s = F.lit
    assert list(one(*[X.type_of_id(s(x)) for x in ("TEMP_diseases_1", "TEMP_Diagnostic_Test_22", "TEMP_planets_1", "SS1", "D1", "X1")])) == ["Disease", "DiagnosticTest", None, "Symptoms", "Disease", None]
    assert list(one(X.term_similarity(s("AF"), s("af")), X.term_similarity(s("ABC"), s("xabcx")), X.term_similarity(s("ab"), s("bc")))) == [1.0, 0.8, pytest.approx(1 / 3)]
    props = s('{"type": "T", "evidence_text": "", "sentence": "s", "similarity": "0.5"}')
    assert list(one(X.edge_type(props, s("R")), X.edge_type(s("{}"), s("R")), X.edge_evidence(props), X.edge_confidence(props), X.edge_confidence(s(None).cast("string")))) == ["T", "R", "s", 0.5, 1.0]
    assert one(X.clean_lines(s(" a1 \n\n b2 ")))[0] == "a1\nb2"


def test_report_says_what_it_leaves_out(spark):
    assert sinks.report(spark.range(5), "T", 2).endswith("3 more rows\n") and "more" not in sinks.report(spark.range(2), "T", 2)
