import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import entities, graph, reasoning, relational
from lattica.operators.skew import salted_join


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(1)
    big = spark.createDataFrame([(rng.choice([1, 1, 1, rng.randrange(50), None]), k) for k in range(2000)], "k bigint, v bigint")
    small = spark.createDataFrame([(k, k * 10) for k in range(0, 50, 2)], "k bigint, w bigint")
    for how in ("inner", "left"):
        a = sorted(map(str, salted_join(big, small, "k", how, 6).select("k", "v", "w").collect()))
        assert a == sorted(map(str, big.join(small, "k", how).select("k", "v", "w").collect()))


def test_dense_ids(spark):
    keys = random.Random(2).sample(range(10_000), 500)
    got = relational.dense_ids(spark.createDataFrame([(k,) for k in keys], "k int"), "k", 7).collect()
    assert sorted((r.k, r.local_id) for r in got) == [(k, i) for i, k in enumerate(sorted(keys))]
    assert relational.dense_ids(spark.createDataFrame([], "k int"), "k").collect() == []


def test_range_join(spark):
    rng = random.Random(3)
    points, ranges = [(rng.randrange(200),) for _ in range(100)], [(k, a := rng.randrange(200), a + rng.randrange(-5, 60)) for k in range(40)]
    got = relational.range_join(spark.createDataFrame(points, "p int"), spark.createDataFrame([*ranges, (99, None, 5)], "id int, lo int, hi int"), "p", "lo", "hi", 16)
    assert sorted((r.id, r.p) for r in got.collect()) == sorted((i, p) for (p,) in points for i, a, b in ranges if a <= p <= b)


def test_next_child_ids(spark):
    ontology = spark.createDataFrame([("A", None), ("A.002", "A"), ("A.007", "A"), ("B", None), ("A.007.998", "A.007")], "ontology_id string, parent_id string")
    arrivals = spark.createDataFrame([("B", 1), ("A", 2), ("A", 3), ("A.007", 4), ("A.007", 5), ("A.007", 6), ("", 7), (None, 8), ("Z", 9), *[("A.002", k) for k in range(10, 1110)]], "parent_id string, ext int")
    got = {r.ext: r.child_id for r in relational.next_child_ids(ontology, arrivals, "ext").collect()}
    assert [got.pop(k, None) for k in range(1, 10)] == ["B.001", "A.008", "A.009", "A.007.999", "A.007.1000", "A.007.1001", None, None, None]
    assert got == {k: f"A.002.{k - 9:03d}" for k in range(10, 1110)}


def test_evidence_join_keeps_5000_characters(spark):
    from types import SimpleNamespace

    from lattica.plans.relational import evidence_join

    rows = [("a", k, f"{k}" * 300) for k in (1, 2, 3, 4)] + [("b", 1, "x" * 5001), ("c", 1, "x" * 5000), ("d", 1, None), ("d", 2, "y")]
    t = SimpleNamespace(chapter_extraction_results=spark.createDataFrame(rows, "chapter_id string, ext_id int, evidence_text string"))
    got = {r.chapter_id: r.joined for r in evidence_join(t).collect()}
    assert got == {"a": " | ".join(c * 300 for c in "123"), "b": "x" * 5000 + "...", "c": "x" * 5000, "d": "y"}


def test_strict_alignment_fails_on_other_ids(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="ids differ"):
        relational.align_strict(a, b, "k")


def random_edges(rng, n, m):
    return sorted({(rng.randrange(n), rng.choice(["CAUSES", "HAS_CHILD", "OTHER"]), rng.randrange(n)) for _ in range(m)})


def edge_frame(spark, edges):
    return spark.createDataFrame([(a, r, b, None) for a, r, b in edges], "src bigint, rel string, dst bigint, relation_type string")


def trails(edges, anchor, k):
    out, stack = set(), [(anchor, ())]
    while stack:
        at, used = stack.pop()
        for e in edges:
            if e not in used and at in (e[0], e[2]) and len(used) < k:
                out.add(e)
                stack.append((e[2] if e[0] == at else e[0], (*used, e)))
    return out


def test_khop_equals_trail_enumeration(spark):
    rng = random.Random(4)
    edges = random_edges(rng, 9, 14) + [(3, "OTHER", 3)]
    got = graph.khop_edges(edge_frame(spark, edges), spark.createDataFrame([(k,) for k in range(9)], "node_id bigint"), 3).collect()
    assert {(r.anchor_id, (r.src, r.rel, r.dst)) for r in got} == {(a, e) for a in range(9) for e in trails(edges, a, 3)}


def test_shortest_paths(spark):
    rng = random.Random(5)
    edges = random_edges(rng, 12, 14)
    near = {k: {e[2] if e[0] == k else e[0] for e in edges if k in (e[0], e[2])} - {k} for k in range(12)}

    def best(u, v):
        level = [[u]]
        for _ in range(5):
            if hits := [p for p in level if p[-1] == v]:
                return min(hits)
            level = [p + [n] for p in level for n in near[p[-1]] if n not in p]
        return None

    pairs = list(itertools.combinations(range(12), 2)) + [(1, 1)]
    got = {(r.u, r.v): r.path for r in graph.shortest_paths(edge_frame(spark, edges), spark.createDataFrame(pairs, "u bigint, v bigint"), 4).collect()}
    want = {p: best(*p) for p in pairs}
    assert {p: len(x) for p, x in got.items()} == {p: len(x) for p, x in want.items() if x} and all(got[p] == x for p, x in want.items() if x)


def test_synonym_groups(spark):
    e = edge_frame(spark, [(k, "MAPPED_TO", k + 1) for k in range(20)] + [(40, "MAPPED_TO", 30), (50, "MAPPED_TO", 50)])
    nodes = spark.createDataFrame([(k,) for k in (*range(21), 30, 40, 50, 60)], "node_id bigint")
    got = {r.node_id: r.root for r in graph.synonym_groups(e, nodes).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 40: 30, 50: 50, 60: 60}


def test_metrics_against_pairwise_definitions(spark):
    rng = random.Random(6)
    rows = [(lab, rng.randrange(8) / 10, rng.random() < 0.4) for lab in "ab" for _ in range(60)] + [("c", 0.5, True)]
    df = spark.createDataFrame(rows, "label string, p double, y boolean")
    auc = {r.label: r.auroc for r in reasoning.auroc(df, ["label"]).collect()}
    for lab in "ab":
        pos, neg = [p for x, p, y in rows if x == lab and y], [p for x, p, y in rows if x == lab and not y]
        assert abs(auc[lab] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) < 1e-9
    assert auc["c"] is None
    fit = {r.label: (r.tau, r.f1) for r in reasoning.fit_thresholds(df, "label").collect()}
    for lab in "ab":
        own = [(p, y) for x, p, y in rows if x == lab]
        f1 = lambda t: 2 * sum(p >= t - 1e-11 and y for p, y in own) / (sum(y for _, y in own) + sum(p >= t - 1e-11 for p, _ in own))
        top = max(round(f1(k / 200), 12) for k in range(201))
        assert fit[lab] == (min(k / 200 for k in range(201) if round(f1(k / 200), 12) == top), pytest.approx(top))
    assert fit["c"] == (0.5, None)


def test_noisy_or_with_a_zero_factor(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 0.5, 0.5), (2, 0.0, 0.9), (3, 0.5, None)], "k int, w double, p double")
    assert {r.k: r.e for r in reasoning.noisy_or(df, ["k"], F.col("w"), F.col("p"), "e").collect()} == {1: 1.0}


def test_cascade(spark):
    mentions = spark.createDataFrame([(1, "Atrial flutter"), (2, "atrial flutter "), (3, "Atrial fluter"), (4, "unknown thing"), (5, "in cache"), (6, None), (7, " ")], "mention_id int, text string")
    got = {r.mention_id: (r.ontology_id, r.method) for r in entities.cascade(mentions, spark.createDataFrame([("In Cache", "C1")], "key string, ontology_id string"), spark.createDataFrame([("atrial flutter", "D1")], "name string, ontology_id string")).collect()}
    assert got == {1: ("D1", "exact"), 2: ("D1", "cache_hit"), 3: ("D1", "fuzzy"), 4: (None, "new_entity"), 5: ("C1", "cache_hit"), 6: (None, "new_entity"), 7: (None, "new_entity")}


def test_cascade_finds_names_with_another_first_letter(spark):
    texts = ["inferior myocardial infarction", "left ventricular hypertrophy", "aortic stenosis", "trial flutter"]
    names = ["old inferior myocardial infarction", "ventricular hypertrophy", "mild aortic stenosis", "atrial flutter", "tricuspid stenosis"]
    mentions = spark.createDataFrame(list(enumerate(texts)), "mention_id int, text string")
    cache = spark.createDataFrame([], "key string, ontology_id string")
    got = {r.text: (r.ontology_id, r.method) for r in entities.cascade(mentions, cache, spark.createDataFrame([(n, n) for n in names], "name string, ontology_id string")).collect()}
    assert got == {t: (n, "fuzzy") for t, n in zip(texts, names, strict=False)}


def test_injected_model(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r.o for r in entities.call_model(df, "t", "o", lambda xs: [x * 2 for x in xs]).orderBy("t").collect()] == ["aa", "bb"]
