"""Problem 5: consolidating pairwise matches into groups.

Minimum labels travel along the edges and pointer jumping shortens the chains
of labels; every round is written to the shared checkpoint folder and the rounds end when no edge joins
two labels any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import release, staged

#: Verdicts that say a label and a node are the same.
SAME = ("EXACT", "MAPS_TO")


def _jump(pointers: DataFrame) -> DataFrame:
    """Pointer jumping: (v, p) with p replaced by the end of its chain; each pass halves the chains."""
    earlier = None
    while True:
        ahead = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumped = staged(pointers.join(ahead, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        if earlier is not None:
            release(earlier)
        earlier, pointers = jumped, jumped.select("v", "p")
        if jumped.filter("moved").isEmpty():
            return pointers


def connected_groups(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(group_id, node_id): the smallest id each node is linked to, directly or indirectly.

    `edges` has columns a and b (BIGINT), in any direction, repeated or not;
    self loops only name a vertex, rows with a null end are no link but name
    their other end. `vertices` (node_id) adds nodes without links.

    A round works on the labels that edges still join: each takes the smallest
    label beside it, chains of labels are jumped to their ends, and the edges
    are rewritten with those. Every label with a smaller neighbour vanishes in
    its round, its pointer goes into a forest that is jumped once at the end.
    The minimum of a hub is combined before the shuffle; in the joins one side
    has unique keys, so a hub's rows on the other are split by AQE.
    """
    both = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    named = both.select(F.explode(F.array("a", "b")).alias("node_id"))
    if vertices is not None:
        named = named.unionByName(vertices.select(F.col("node_id").cast("bigint").alias("node_id")))
    nodes = named.filter("node_id is not null").distinct()
    pairs = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links = staged(pairs(both.filter("a is not null and b is not null")))
    forest: DataFrame | None = None
    while not links.isEmpty():
        step = _jump(links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        forest = step if forest is None else forest.unionByName(step)
        to = lambda c: step.select(F.col("v").alias(c), F.col("p").alias("r" + c))
        moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
        earlier, links = links, staged(pairs(moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
        release(earlier)
    if forest is None:
        return nodes.select(F.col("node_id").alias("group_id"), "node_id")
    ends = _jump(forest).select(F.col("v").alias("node_id"), F.col("p").alias("group_id"))
    return nodes.join(ends, "node_id", "left").select(F.coalesce("group_id", "node_id").alias("group_id"), "node_id")


def node_number(text):
    """The integer a node id stands for in any of its notations (12, " 12", 12.0, 0012, #12, n12, node:12), else null."""
    digits = F.regexp_extract(text.cast("string"), r"^[\s\p{Z}]*(?i:(?:node|n)[\s:#_-]*|#\s*)*0*(\d{1,18})(?:\.0*)?[\s\p{Z}]*$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def verdict_links(items: DataFrame, verdicts=SAME) -> DataFrame:
    """Star edges (a, b) of each item: its smallest counted node to each of its counted nodes.

    Null entries, entries without verdict or without a node id don't count;
    an item's single node gives a self loop, which names it.
    """
    kind = lambda e: F.upper(F.regexp_replace(e["relation_type"], r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    ids = F.array_distinct(
        F.filter(F.transform(F.filter("mappings", lambda e: e.isNotNull() & kind(e).isin(*verdicts)), lambda e: node_number(e["node_id"])), lambda v: v.isNotNull())
    )
    own = items.select(ids.alias("ids")).filter(F.size("ids") > 0)
    return own.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"))


def verdict_groups(items: DataFrame) -> DataFrame:
    """(group_id, node_id) of every node with a counted verdict."""
    return connected_groups(verdict_links(items))
