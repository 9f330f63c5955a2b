import random

from lattica.llm.components import connected_groups, verdict_groups


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            find(a if b is None else b) if (a is not None or b is not None) else None
            continue
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in root)


def groups(spark, edges):
    return sorted((r.group_id, r.node_id) for r in connected_groups(spark.createDataFrame(edges, "a bigint, b bigint")).collect())


def test_chain_star_loops_and_nulls(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 300), (None, None), (5, 4), (5, 4)]
    assert groups(spark, edges) == brute(edges)


def test_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    assert groups(spark, edges) == brute(edges)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_verdicts(spark):
    schema = "item_id bigint, mappings array<struct<relation_type string, node_id string>>, label string, group_id int"
    rows = [
        (1, [(" exact", "12.0"), ("MAPS_TO ", "#0007"), ("RELATED", "99"), None], "x", 1), (2, [("Exact", "node:7"), ("EXACT", "n3")], None, None),
        (3, [("EXACT", "nan"), ("EXACT", None), (None, "5"), ("INEXACT", "6")], None, 2), (4, None, None, None), (5, [], None, None), (6, [("maps_to", " 50\t")], None, 3),
    ]
    got = sorted((r.group_id, r.node_id) for r in verdict_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(3, 3), (3, 7), (3, 12), (50, 50)]
