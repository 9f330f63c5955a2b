"""Deeply nested semi-structured records as related flat tables (problem 2).

One depth-first visit of each record emits rows tagged with their table,
carrying primary key, parent key and payload; the rows are written once,
partitioned by tag, and each tag is read back under its own schema. Typed
columns are visited by one JVM expression, JSON texts by a Python visitor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import scratch_path

#: Payload columns of each tag; a tagged row has those of all tags, null where its tag lacks them.
SCHEMAS = {
    "item": "item_id bigint, scp_code string, description string, statement_category string, label string, top_k int, generated_at string, notes string",
    "mapping": "item_id bigint, scp_code string, ord int, node_id string, ontology_id string, edge_type string, relation_type string, reason string, rank int, similarity double, node_text string",
    "candidate": "item_id bigint, scp_code string, ord int, node_id string, ontology_id string, rank int, similarity double, text string",
    "property": "item_id bigint, kind string, ord int, key string, value string",
    "reject": "item_id bigint, reason string",
}
_PAYLOAD = {name: kind for part in SCHEMAS.values() for name, kind in (c.split() for c in part.split(", "))}
TAGGED = ", ".join(["tag string", "pk string", "parent string", *(f"{n} {t}" for n, t in _PAYLOAD.items())])
#: Spellings that stand for a missing value.
MISSING = frozenset(("", "nan", "none", "null", "n/a", "na"))

_FENCE = re.compile(r"^\s*```[A-Za-z]*[ \t]*\r?\n?|\r?\n?\s*```\s*$")
_NODE = re.compile(r"(?:(?:node|n)[\s:#_-]*|#\s*)*0*(\d+)(?:\.0*)?", re.I)


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def node_digits(value) -> str:
    """The integer a node id stands for in any notation, in plain digits; '' if it is none."""
    if value is None or isinstance(value, bool):
        return ""
    if isinstance(value, float):
        return str(int(value)) if value == value and abs(value) < 1e18 and value == int(value) and value >= 0 else ""
    m = _NODE.fullmatch(str(value).strip())
    return m[1] if m else ""


def _text(value) -> str:
    if value is None or isinstance(value, (dict, list)):
        return ""
    out = str(value).strip()
    return "" if out.lower() in MISSING else out


def _load(value):
    """JSON in a string, else the value itself; None where it can't be read."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return None
    return value


def _properties(value) -> dict:
    """Properties as a dict from an object, JSON text, or a list of key/value pairs."""
    value = _load(value)
    if isinstance(value, list):
        pairs = {}
        for e in value:
            if isinstance(e, dict) and "key" in e:
                pairs[str(e["key"])] = e.get("value")
            elif isinstance(e, (list, tuple)) and len(e) == 2:
                pairs[str(e[0])] = e[1]
            elif isinstance(e, dict):
                pairs.update(e)
        return pairs
    return value if isinstance(value, dict) else {}


def _entries(value) -> list:
    """Entries in order: a list as it stands, an object keyed by number by its numbers, a lone entry alone."""
    value = _load(value) if isinstance(value, str) else value
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value:
        if all(re.fullmatch(r"\s*\d+\s*", str(k)) for k in value):
            return [v for _, v in sorted(value.items(), key=lambda kv: int(kv[0]))]
        return [value]
    return []


def parse_raw(raw: str) -> list[dict] | None:
    """Items of an exporter's JSON, keys in snake case at the item's levels; None if the JSON breaks off."""
    body = raw.lstrip("﻿").strip()
    body = _FENCE.sub("", _FENCE.sub("", body))
    try:
        value = json.loads(body)
        while isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        return None
    stack, items = [value], []
    while stack:
        v = stack.pop(0)
        if isinstance(v, list):
            stack = [*v, *stack]
        elif isinstance(v, dict):
            inner = next((v[k] for k in ("items", "item", "results", "data") if isinstance(v.get(k), (dict, list)) and "mappings" not in v and "candidates" not in v and "disease" not in v), None)
            if inner is not None:
                stack.insert(0, inner)
            else:
                items.append(v)
    return items


def _own(entry: dict) -> dict:
    """An entry under the names of the columns, whichever spelling or nesting its exporter used."""
    flat = {_snake(k): v for k, v in entry.items()}
    node = flat.pop("node", None)
    if isinstance(node, dict):
        node = {_snake(k): v for k, v in node.items()}
        flat.setdefault("node_id", node.get("id", node.get("node_id")))
        flat.setdefault("properties", node.get("properties", node.get("node_properties")))
        flat.setdefault("text", node.get("text"))
    elif node is not None:
        flat.setdefault("node_id", node)
    if flat.get("node_id") is None and "id" in flat:
        flat["node_id"] = flat["id"]
    own = flat.get("node_properties") if flat.get("node_properties") is not None else flat.get("properties")
    flat["props"] = _properties(own)
    return flat


def _number(value, kind):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return None


def visit(item_id: int, item: dict, pk: str) -> Iterator[tuple[str, str, str | None, dict]]:
    """Depth-first: (tag, pk, parent, payload) of an item, its mappings and candidates, and their properties."""
    top = {_snake(k): v for k, v in item.items()}
    disease = _load(top.get("disease")) if isinstance(top.get("disease"), str) else top.get("disease")
    disease = {_snake(k): v for k, v in disease.items()} if isinstance(disease, dict) else {}
    get = lambda k: _text(disease.get(k)) or _text(top.get(k))
    scp = get("scp_code")
    yield "item", pk, None, {
        "item_id": item_id, "scp_code": scp, **{k: get(k) for k in ("description", "statement_category", "label")},
        "top_k": _number(top.get("top_k"), int), "generated_at": _text(top.get("generated_at")), "notes": _text(top.get("notes")),
    }
    for kind, field in (("mapping", "mappings"), ("candidate", "candidates")):
        for n, entry in enumerate(_entries(top.get(field))):
            if not isinstance(entry, dict):
                continue
            e = _own(entry)
            own = {"item_id": item_id, "scp_code": scp, "ord": n, "node_id": node_digits(e.get("node_id")), "ontology_id": _text(e["props"].get("ontology_id", e["props"].get("ontologyId"))), "rank": _number(e.get("rank"), int), "similarity": _number(e.get("similarity"), float)}
            names = ("edge_type", "relation_type", "reason", "node_text") if kind == "mapping" else ("text",)
            key = f"{pk}/{kind}/{n}"
            yield kind, key, pk, own | {k: _text(e.get(k)) for k in names}
            for k, v in e["props"].items():
                yield "property", f"{key}/{k}", key, {"item_id": item_id, "kind": kind, "ord": n, "key": str(k), "value": None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
_TAGGED_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in TAGGED.split(", "))])
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The types of the columns, for tables that lack one.
_ENTRY = "edge_type string, relation_type string, reason string, rank int, node_id string, similarity double, node_text string, text string, node_properties map<string,string>, properties map<string,string>"
FIELDS = {"disease": "struct<scp_code:string,description:string,statement_category:string,label:string>", "top_k": "int", "generated_at": "string", "mappings": f"array<struct<{_ENTRY}>>", "candidates": f"array<struct<{_ENTRY}>>", "notes": "string"}


def _clean(x: Column) -> Column:
    """_text() on the JVM side."""
    t = F.regexp_replace(x.cast("string"), f"^{_SPACE}+|{_SPACE}+$", "")
    return F.when(t.isNull() | F.lower(t).isin(*MISSING), "").otherwise(t)


def _digits(x: Column) -> Column:
    """node_digits() on the JVM side."""
    return F.coalesce(F.regexp_extract(x.cast("string"), rf"(?iU)^{_SPACE}*(?:(?:node|n)[\s:#_-]*|#\s*)*0*(\d+)(?:\.0*)?{_SPACE}*$", 1), F.lit(""))


def _visited(items: DataFrame) -> DataFrame:
    """visit() of typed columns as one expression: each item becomes the array of its tagged rows, depth first, and is exploded once."""
    kinds = {**FIELDS, "item_id": "bigint"}
    own = items.select(*[F.col(c) if c in items.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    inner = lambda c: {f.name for f in own.schema[c].dataType.elementType.fields} if hasattr(own.schema[c].dataType, "elementType") and hasattr(own.schema[c].dataType.elementType, "fields") else set()
    diseased = {f.name for f in own.schema["disease"].dataType.fields}
    of = lambda k: _clean(F.col("disease")[k]) if k in diseased else F.lit("")
    own = own.withColumn("scp_code", of("scp_code"))
    pk = F.col("item_id").cast("string")

    def row(tag: str, own_key: Column, parent_key: Column, **payload: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), own_key.alias("pk"), parent_key.cast("string").alias("parent"), *[payload.get(n, F.lit(None)).cast(t).alias(n) for n, t in _PAYLOAD.items()])

    nothing = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ':') for c in TAGGED.split(', '))}>>")

    def entries(kind: str, field: str, names: tuple[str, ...]) -> Column:
        has = inner(field)

        def rows(e: Column, n: Column) -> Column:
            props = e["node_properties"] if "node_properties" in has else e["properties"] if "properties" in has else F.lit(None).cast("map<string,string>")
            if {"node_properties", "properties"} <= has:
                props = F.coalesce(e["node_properties"], e["properties"])
            key = F.concat_ws("/", pk, F.lit(kind), n.cast("string"))
            get = lambda k: _clean(e[k]) if k in has else F.lit("")
            num = lambda k: e[k] if k in has else F.lit(None)
            oid = F.when(F.map_contains_key(props, "ontology_id"), props["ontology_id"]).otherwise(props["ontologyId"])
            top = row(kind, key, pk, item_id=F.col("item_id"), scp_code=F.col("scp_code"), ord=n, node_id=_digits(e["node_id"]) if "node_id" in has else F.lit(""), ontology_id=_clean(oid), rank=num("rank"), similarity=num("similarity"), **{k: get(k) for k in names})
            below = F.transform(F.coalesce(F.map_entries(props), F.map_entries(F.create_map().cast("map<string,string>"))), lambda p: row("property", F.concat_ws("/", key, p["key"]), key, item_id=F.col("item_id"), kind=F.lit(kind), ord=n, key=p["key"], value=p["value"]))
            return F.when(e.isNotNull(), F.concat(F.array(top), below)).otherwise(nothing)

        return F.coalesce(F.flatten(F.transform(field, rows)), nothing)

    top = row("item", pk, F.lit(None), item_id=F.col("item_id"), scp_code=F.col("scp_code"), description=of("description"), statement_category=of("statement_category"), label=of("label"), top_k=F.col("top_k"), generated_at=_clean(F.col("generated_at")), notes=_clean(F.col("notes")))
    every = F.concat(F.array(top), entries("mapping", "mappings", ("edge_type", "relation_type", "reason", "node_text")), entries("candidate", "candidates", ("text",)))
    return own.select(F.inline(every))


def _visit_raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = parse_raw(raw)
            if found is None:
                out.append({"tag": "reject", "pk": str(i), "item_id": i, "reason": "raw can't be read as JSON"})
            for k, item in enumerate(found or ()):
                out += [{"tag": t, "pk": key, "parent": up, **d} for t, key, up, d in visit(i, item, f"{i}.{k}" if k else str(i))]
        yield pa.RecordBatch.from_pylist(out, schema=_TAGGED_ARROW)


def flatten(items: DataFrame) -> DataFrame:
    """Tagged rows (tag, pk, parent, payload columns) of all items, in one pass without a shuffle.

    A non-null, non-blank `raw` is read in place of the columns; if its JSON
    breaks off the item gives one `reject` row, and of several items in one
    `raw` the later ones have keys of their own (7.1, 7.2). Null arrays and
    null entries give no rows, but null entries count in positions. Missing
    columns count as null, further columns are ignored. Typed columns are
    visited on the JVM side, only `raw` in Python.
    """
    if "raw" not in items.columns:
        return _visited(items)
    written = F.coalesce(F.regexp_replace("raw", f"{_SPACE}+", ""), F.lit("")) != ""
    read = items.filter(written).select(F.col("item_id").cast("bigint"), F.col("raw").cast("string"))
    return _visited(items.filter(~written)).unionByName(read.mapInArrow(_visit_raw, TAGGED))


def write_tables(tagged: DataFrame, path: str) -> None:
    """One write of all tags, each into its own partition folder."""
    tagged.write.partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A tag's rows under its schema, with pk and parent; empty if the tag has no rows."""
    rows = spark.read.schema(f"pk string, parent string, {SCHEMAS[tag]}, tag string").parquet(path).filter(F.col("tag") == tag)
    return rows.drop("tag")


def related_tables(items: DataFrame, *tags: str) -> list[DataFrame]:
    """The flat tables of the given tags, each with pk and parent, after one pass over the items."""
    path = scratch_path(items.sparkSession, "flat")
    write_tables(flatten(items), path)
    return [read_table(items.sparkSession, path, t) for t in tags]


def linked_entries(items: DataFrame) -> DataFrame:
    """(item_id, scp_code, kind, ord, node_id, ontology_id) of each mapping and candidate."""
    kinds = ("mapping", "candidate")
    parts = [x.select("item_id", "scp_code", F.lit(k).alias("kind"), "ord", "node_id", "ontology_id") for k, x in zip(kinds, related_tables(items, *kinds), strict=True)]
    return parts[0].unionByName(parts[1])
