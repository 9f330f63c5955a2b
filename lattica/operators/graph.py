"""Property-graph operators over (nodes, edges) frames.

nodes: node_id, labels ARRAY<STRING>, name; edges: src, rel, dst, relation_type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import release, staged

#: Relations a traversal prefers, and the one it falls back on.
PREFERRED = ("AFFECTS", "ASSOCIATED_WITH", "CAUSES", "DIAGNOSES", "INDICATES", "IS_SPECIFIC_FOR", "MEASURES", "PART_OF", "PRECEDES", "PREVENTS", "SUPPORTS", "TREATS")
FALLBACK = "HAS_CHILD"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def has_labels(*labels: str) -> Column:
    """All labels at once."""
    out = F.array_contains("labels", labels[0])
    for x in labels[1:]:
        out = out & F.array_contains("labels", x)
    return out


def pattern(g: Graph, src: str, dst: str, rel: str | None = None) -> DataFrame:
    """Edges between labelled ends, in their own direction."""
    ends = lambda label, c: g.nodes.filter(has_labels(label)).select(F.col("node_id").alias(c))
    e = g.edges.filter(F.col("rel") == rel) if rel else g.edges
    return e.join(ends(src, "src"), "src", "left_semi").join(ends(dst, "dst"), "dst", "left_semi")


def either_way(edges: DataFrame) -> DataFrame:
    """(node_id, other, rel, direction) of each edge from both ends; a self loop counts once each way."""
    out = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "rel", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(back)


def within_hops(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor_id, node_id, dist): nodes up to `hops` undirected steps from each anchor (node_id in `anchors`)."""
    step = either_way(edges).select(F.col("node_id").alias("at"), F.col("other").alias("next")).distinct()
    seen = anchors.select(F.col("node_id").alias("anchor_id"), "node_id").distinct().withColumn("dist", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        grown = front.join(step, front["node_id"] == step["at"]).select("anchor_id", F.col("next").alias("node_id")).distinct()
        front = grown.join(seen, ["anchor_id", "node_id"], "left_anti").withColumn("dist", F.lit(k))
        seen = seen.unionByName(front)
        if k < hops:
            seen, front = staged(seen), staged(front)
    return seen


def khop_edges(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor_id, src, rel, dst): edges on some trail of at most `hops` from the anchor: those at a node within hops - 1."""
    near = within_hops(edges, anchors, hops - 1).select("anchor_id", "node_id")
    out = edges.join(near, edges["src"] == near["node_id"]).select("anchor_id", "src", "rel", "dst")
    back = edges.join(near, edges["dst"] == near["node_id"]).select("anchor_id", "src", "rel", "dst")
    return out.unionByName(back).distinct()


def preferred_or_fallback(found: DataFrame, group: str = "anchor_id") -> DataFrame:
    """Preferred relations of a group if it has any, else its fallback ones, else nothing."""
    best = found.groupBy(group).agg(F.max(F.col("rel").isin(*PREFERRED)).alias("_any"))
    return found.join(best, group).filter(F.when(F.col("_any"), F.col("rel").isin(*PREFERRED)).otherwise(F.col("rel") == FALLBACK)).drop("_any")


def shared_neighbours(found: DataFrame, k: int) -> DataFrame:
    """(node_id, support): ends of edges near at least k anchors; the anchors themselves always stay."""
    ends = found.select("anchor_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    own = found.select("anchor_id", F.col("anchor_id").alias("node_id")).distinct()
    support = ends.unionByName(own).distinct().groupBy("node_id").agg(F.count("*").alias("support"))
    return support.join(own.select("node_id").distinct().withColumn("_own", F.lit(True)), "node_id", "left").filter((F.col("support") >= k) | F.col("_own")).select("node_id", "support")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(u, v, len, path): one undirected shortest path of at most `most` edges per pair, the smallest by node ids.

    The frontier keeps one path for each (pair, node), so a hub adds rows by
    its degree once, not by paths; pairs already met leave the search.
    """
    step = either_way(edges).select(F.col("node_id").alias("at"), F.col("other").alias("next")).filter("at <> next").distinct()
    open_ = pairs.select("u", "v").distinct()
    front = open_.withColumns({"node_id": F.col("u"), "path": F.array("u")})
    seen = front.select("u", "v", "node_id")
    done = front.filter("u = v").select("u", "v", F.lit(0).alias("len"), "path")
    front = front.filter("u <> v")
    for k in range(1, most + 1):
        grown = front.join(step, front["node_id"] == step["at"]).select("u", "v", F.col("next").alias("node_id"), F.concat("path", F.array("next")).alias("path"))
        grown = grown.join(seen, ["u", "v", "node_id"], "left_anti").groupBy("u", "v", "node_id").agg(F.min("path").alias("path"))
        grown = staged(grown)
        met = grown.filter("node_id = v").select("u", "v", F.lit(k).alias("len"), "path")
        done = done.unionByName(met)
        front = grown.join(met.select("u", "v"), ["u", "v"], "left_anti")
        seen = seen.unionByName(grown.select("u", "v", "node_id"))
        if front.isEmpty():
            break
    return done


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, pos, src, rel, dst, reversed): the edge of each step, forward before backward, preferred types first."""
    steps = paths.select("u", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct(i.alias("pos"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("s")).filter("s.b is not null").select("u", "v", "s.*")
    fwd = steps.join(edges, (steps["a"] == edges["src"]) & (steps["b"] == edges["dst"])).withColumn("reversed", F.lit(False))
    back = steps.join(edges, (steps["b"] == edges["src"]) & (steps["a"] == edges["dst"])).withColumn("reversed", F.lit(True))
    rank = F.struct("reversed", (~F.col("rel").isin(*PREFERRED)).alias("p"), "rel")
    return fwd.unionByName(back).groupBy("u", "v", "pos").agg(F.min_by(F.struct("src", "rel", "dst", "reversed"), rank).alias("e")).select("u", "v", "pos", "e.*")


def depths(edges: DataFrame, rel: str = FALLBACK) -> DataFrame:
    """(node_id, depth): the longest directed path from a root.

    A node below a cycle has no longest path: nodes are settled level by level
    once all their parents are, so such nodes and those on cycles get none.
    """
    e = staged(edges.filter(F.col("rel") == rel).filter("src <> dst").select("src", "dst").distinct())
    roots = e.select(F.col("src").alias("node_id")).join(e.select(F.col("dst").alias("node_id")), "node_id", "left_anti").distinct()
    level, found, depth = staged(roots), [], 0
    while not level.isEmpty():
        found.append(level.withColumn("depth", F.lit(depth)))
        # edges of settled parents go; children without a remaining edge are settled next
        rest = staged(e.join(level.select(F.col("node_id").alias("src")), "src", "left_anti"))
        freed = e.join(level.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        level = staged(freed.join(rest.select(F.col("dst").alias("node_id")), "node_id", "left_anti"))
        release(e)
        e, depth = rest, depth + 1
    out = found[0] if found else roots.withColumn("depth", F.lit(0))
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def oriented(g: Graph, a: str, b: str) -> DataFrame:
    """(a, b, rel): edges between two kinds of nodes in either direction, given in one, each once."""
    there = pattern(g, a, b).select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel")
    back = pattern(g, b, a).select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel")
    return there.unionByName(back).distinct()


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in the set (node_id), each row once (P10)."""
    own = nodes.select("node_id").distinct()
    here = edges.join(own, edges["src"] == own["node_id"], "left_semi")
    there = edges.join(own, edges["dst"] == own["node_id"], "left_semi").join(own, edges["src"] == own["node_id"], "left_anti")
    return here.unionByName(there)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, direction, rel, other): both directions of each edge, repeats dropped."""
    return either_way(edges).select("node_id", "direction", "rel", "other").distinct()


def lineage(edges: DataFrame, kinds: tuple[str, ...] = ("IS_A", "INSTANTIATES")) -> DataFrame:
    """(node_id, role, other): parents and children of each node; an edge's source is the child."""
    e = edges.filter(F.upper("rel").isin(*kinds)).select("src", "dst").distinct()
    return e.select(F.col("src").alias("node_id"), F.lit("parent").alias("role"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node_id"), F.lit("child").alias("role"), F.col("src").alias("other")))


def flat_nodes(nodes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row for each wanted label of a node."""
    return nodes.select("node_id", F.explode(F.array_intersect("labels", F.array(*map(F.lit, labels)))).alias("node_type"), "name")


def local_export(g: Graph, labels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(node_type, node_id, local_id) of each label, numbered from 0 by id, and (rel, src_type, src, dst_type, dst) of the edges between them."""
    from lattica.operators.relational import dense_ids

    parts = [dense_ids(g.nodes.filter(has_labels(x)).select("node_id").distinct(), "node_id").select(F.lit(x).alias("node_type"), "node_id", "local_id") for x in labels]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type"), F.col("local_id").alias(f"{c}_local"))
    edges = g.edges.join(end("src"), "src").join(end("dst"), "dst").select("rel", "src_type", F.col("src_local").alias("src"), "dst_type", F.col("dst_local").alias("dst"))
    return nodes, edges


def synonym_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, root): smallest id of the nodes each is joined with (G12), by contracting edges to smaller neighbours."""
    state = staged(nodes.select("node_id", F.col("node_id").alias("root")))
    links = staged(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    while not links.isEmpty():
        up = staged(links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        while True:
            top = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = staged(up.join(top, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            up = nxt.select("v", "p")
            if nxt.filter("moved").isEmpty():
                break
        to = lambda c: up.select(F.col("v").alias(c), F.col("p").alias("r" + c))
        m = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        links = staged(m.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        state = staged(state.join(to("root"), "root", "left").select("node_id", F.coalesce("rroot", "root").alias("root")))
    return state


def merge_nodes(g: Graph, merges: DataFrame) -> Graph:
    """Edges of merged nodes (old -> new) redirected, edges between the two dropped, repeats overlaid by the largest relation_type, old nodes removed."""
    to = lambda c: merges.select(F.col("old").alias(c), F.col("new").alias("_" + c))
    e = g.edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    e = e.select(F.coalesce("_src", "src").alias("src"), "rel", F.coalesce("_dst", "dst").alias("dst"), "relation_type", (F.col("_src").isNotNull() | F.col("_dst").isNotNull()).alias("moved"))
    e = e.filter(~(F.col("moved") & (F.col("src") == F.col("dst")))).groupBy("src", "rel", "dst").agg(F.max("relation_type").alias("relation_type"))
    return Graph(g.nodes.join(merges.select(F.col("old").alias("node_id")), "node_id", "left_anti"), e)


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """Old and new rows by key: created stays, updated is the new one's."""
    n = new.select(key, F.col(created).alias("_c"), F.col(updated).alias("_u"))
    return old.select(key, created, updated).join(n, key, "full_outer").select(key, F.coalesce(created, "_c").alias(created), F.coalesce("_u", updated).alias(updated))


def overlay_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (src, rel, dst); properties of new ones win."""
    both = old.select("src", "rel", "dst", "relation_type", F.lit(0).alias("_o")).unionByName(new.select("src", "rel", "dst", "relation_type", F.lit(1).alias("_o")))
    return both.groupBy("src", "rel", "dst").agg(F.max_by("relation_type", F.struct("_o", "relation_type")).alias("relation_type"))


def linearize(found: DataFrame, names: DataFrame, budget: int) -> DataFrame:
    """(anchor_id, context, lines): outgoing edges by type and end, then incoming ones, as lines up to the budget of each anchor.

    Lines are ranked and cut before they are collected, so a hub's text stays within the budget.
    """
    n = lambda c: names.select(F.col("node_id").alias(c), F.col("name").alias(c + "_name"))
    x = found.join(n("src"), "src").join(n("dst"), "dst")
    out = F.col("src") == F.col("anchor_id")
    line = F.when(out, F.format_string("-[%s]-> %s", "rel", "dst_name")).otherwise(F.format_string("<-[%s]- %s", "rel", "src_name"))
    w = Window.partitionBy("anchor_id").orderBy(F.when(out, 0).otherwise(1), "rel", "dst", "src")
    top = x.withColumns({"line": line, "r": F.row_number().over(w)}).filter(F.col("r") <= budget)
    return top.groupBy("anchor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n").alias("context"), F.count("*").alias("lines"))
