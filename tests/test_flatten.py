import json

from lattica.operators.flatten import flatten, linked_entries, node_digits, parse_raw, read_table, write_tables
from lattica.session import scratch_path

SCHEMA = """item_id bigint, disease struct<scp_code:string,description:string,statement_category:string,label:string>, top_k int, generated_at string,
mappings array<struct<edge_type:string,relation_type:string,reason:string,rank:int,node_id:string,similarity:double,node_text:string,node_properties:map<string,string>>>,
candidates array<struct<rank:int,node_id:bigint,similarity:double,text:string,properties:map<string,string>>>, notes string, raw string, tag string, payload int"""


def item(i, disease=None, mappings=None, candidates=None, raw=None):
    return (i, disease, None, None, mappings, candidates, None, raw, "clash", 1)


def mapping(node, props=None):
    return (None, "EXACT", None, 1, node, 0.5, "t", props)


def rows(spark, items):
    got = linked_entries(spark.createDataFrame(items, SCHEMA)).collect()
    return sorted((r.item_id, r.scp_code, r.kind, r.ord, r.node_id, r.ontology_id) for r in got)


def test_columns(spark):
    items = [
        item(1, (" AB1 ", None, None, None), [mapping(" 12.0", {"ontology_id": " D1 "}), None, mapping("nan")], [(1, 7, 0.1, "x", None), None]),
        item(2, None, None, []), item(3, None, [mapping("node:0005", {"name": "x"})], None), item(3, None, [mapping("node:0005", {"name": "x"})], None),
    ]
    assert rows(spark, items) == [(1, "AB1", "candidate", 0, "7", ""), (1, "AB1", "mapping", 0, "12", "D1"), (1, "AB1", "mapping", 2, "", ""), (3, "", "mapping", 0, "5", ""), (3, "", "mapping", 0, "5", "")]


def test_shapes_of_raw(spark):
    entry = {"node_id": "#9", "node_properties": json.dumps({"ontology_id": "D9"})}
    shapes = [
        {"disease": {"scpCode": "S"}, "mappings": [{"nodeId": 9, "nodeProperties": [{"key": "ontology_id", "value": "D9"}]}]}, {"scp_code": "S", "mappings": {"2": None, "1": entry}}, {"item": {"disease": {"scp_code": "S"}, "mappings": entry}},
        {"meta": {"k": 1}, "items": [{"disease": {"scp_code": "S"}, "mappings": [{"node": {"id": "n9", "properties": {"ontology_id": "D9"}}}]}]},
    ]
    items = [item(k, raw=json.dumps(s)) for k, s in enumerate(shapes)] + [item(10, raw="```json\n" + json.dumps(shapes[0], indent=1) + "\n```"), item(11, raw=json.dumps(json.dumps(shapes[0])))]
    assert rows(spark, items) == [(k, "S", "mapping", 0, "9", "D9") for k in (0, 1, 2, 3, 10, 11)]


def test_broken_blank_and_empty(spark):
    assert rows(spark, [item(1, raw='{"mappings": [{"node_id": 1'), item(2, raw=" "), item(3, raw="[]"), item(4, raw="3")]) == []
    assert linked_entries(spark.createDataFrame([], SCHEMA)).collect() == []
    assert parse_raw('{"a": "' + "x" * 1_000_000) is None


def test_tables_keep_parent_links(spark):
    path = scratch_path(spark, "t")
    write_tables(flatten(spark.createDataFrame([item(1, ("A", "d", None, None), [mapping("3", {"ontology_id": "D1", "k": "v"})], None), item(2, raw="{")], SCHEMA)), path)
    top, sub, prop, bad = (read_table(spark, path, t).collect() for t in ("item", "mapping", "property", "reject"))
    assert [r.item_id for r in top] == [1] and sub[0].parent == top[0].pk and {p.parent for p in prop} == {sub[0].pk} and len(prop) == 2 and [r.item_id for r in bad] == [2]


def test_node_notations():
    assert [node_digits(x) for x in (5, 5.0, "05", "n5", "#5", "node:5", " 5\t", "5.0", "5.5", "x", None, True, float("nan"), -1, "")] == ["5"] * 8 + [""] * 7
