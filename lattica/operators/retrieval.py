"""Evidence retrieval: anchors by vector search, their subgraphs, paths between them, and the text made of these."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators.vectors import anchor_pairs, top_k


def distinct_entities(entities: DataFrame, question: str, text: str, order: str, most: int = 15) -> DataFrame:
    """The first entity of each text of a question, letter case aside, at most `most` in order (V10); blank texts are none."""
    rest = [c for c in entities.columns if c != question]
    first = entities.filter(F.trim(text) != "").groupBy(question, F.lower(F.trim(text)).alias("_k")).agg(F.min_by(F.struct(*rest), order).alias("_e")).select(question, "_e.*")
    r = F.row_number().over(Window.partitionBy(question).orderBy(order))
    return first.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def with_triples(hits: DataFrame, g: G.Graph, key: str = "node_id") -> DataFrame:
    """Hits with name, properties and number of 1-hop triples of their nodes (V03, V04): a node's properties are given for Knowledge nodes only."""
    names = g.nodes.select(F.col("node_id").alias(key), "name", F.when(F.array_contains("labels", "Knowledge"), F.array_join("labels", ":")).otherwise("").alias("props"))
    degrees = G.either_way(g.edges).join(hits.select(F.col(key).alias("node_id")).distinct(), "node_id", "left_semi").groupBy(F.col("node_id").alias(key)).agg(F.count("*").alias("triple_count"))
    return hits.join(names, key, "left").join(degrees, key, "left").withColumn("triple_count", F.coalesce("triple_count", F.lit(0)))


def best_anchors(hits: DataFrame, question: str, least: float) -> DataFrame:
    """Hits (question, node_id, sim) above the threshold, the best of each node."""
    return hits.filter(F.col("sim") >= least).groupBy(question, "node_id").agg(F.max("sim").alias("sim"))


def find_anchors(vectors: DataFrame, entities: DataFrame, question: str, least: float, k: int) -> DataFrame:
    """best_anchors() of each question's entities (question, entity, qvec) among vectors (node_id, vec)."""
    ids = entities.select(F.struct(question, "entity").alias("q"), "qvec")
    hits = top_k(vectors, ids, "node_id", "vec", "q", "qvec", k).select(F.col(f"q.{question}").alias(question), "node_id", "sim")
    return best_anchors(hits, question, least)


def hop_evidence(anchors: DataFrame, g: G.Graph, question: str, hops: int = 1, budget: int = 180) -> DataFrame:
    """(question, anchors, edges, context): the preferred edges near each anchor as text.

    Blocks of anchors follow their similarity; the first that exceeds the
    budget of lines and all after it are left out, a question without edges
    says so.
    """
    found = G.preferred_or_fallback(G.khop_edges(g.edges, anchors.select("node_id").distinct(), hops))
    near = anchors.join(found, anchors["node_id"] == found["anchor_id"]).select(question, "node_id", "sim", "src", "rel", "dst")
    names = lambda c: g.nodes.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name"))
    own = near.filter("src = node_id or dst = node_id").join(names("src"), "src", "left").join(names("dst"), "dst", "left")
    out = F.col("src") == F.col("node_id")
    line = F.when(out, F.format_string("-[%s]-> %s", "rel", "dst_name")).otherwise(F.format_string("%s -[%s]->", "src_name", "rel"))
    w = Window.partitionBy(question, "node_id").orderBy(F.when(out, 0).otherwise(1), "rel", "dst", "src")
    lines = own.withColumns({"line": line, "r": F.row_number().over(w)}).filter(F.col("r") <= budget)
    blocks = lines.groupBy(question, "node_id", "sim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n").alias("block"), F.count("*").alias("n"))
    run = F.sum(F.col("n") + 1).over(Window.partitionBy(question).orderBy(F.desc("sim"), "node_id"))
    order = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("sim"), "node_id"))
    kept = blocks.withColumns({"run": run, "o": order}).filter(F.col("run") <= budget)
    text = kept.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.format_string("[Chunk %d] [Anchor] %d\n%s", "o", "node_id", "block").alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))
    counts = anchors.groupBy(question).agg(F.count("*").alias("anchors"))
    edges = near.select(question, "src", "rel", "dst").distinct().groupBy(question).agg(F.count("*").alias("edges"))
    return counts.join(edges, question, "left").join(text, question, "left").select(question, "anchors", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("context", F.lit("(No graph evidence retrieved.)")).alias("context"))


def path_lines(steps: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """(u, v, len, preferred, line): each path as one line with arrows by direction (G09, G11). Steps come from path_edges()."""
    n = names.select("node_id", "name")
    at = paths.select("u", "v", F.posexplode("path").alias("k", "node_id")).join(n, "node_id", "left")
    part = at.join(steps.select("u", "v", (F.col("pos") + 1).alias("k"), "rel", "reversed"), ["u", "v", "k"], "left")
    shown = F.format_string("%s (id=%d)", F.coalesce("name", F.col("node_id").cast("string")), "node_id")
    arrow = F.when(F.col("k") == 0, shown).when(F.col("reversed"), F.concat(F.lit("  <-["), "rel", F.lit("]-  "), shown)).otherwise(F.concat(F.lit("  -["), "rel", F.lit("]->  "), shown))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", arrow.alias("t")))), lambda s: s["t"]), "")
    return part.groupBy("u", "v").agg((F.count("*") - 1).alias("len"), F.count_if(F.col("rel").isin(*G.PREFERRED)).alias("preferred"), line.alias("line"))


def path_evidence(anchors: DataFrame, g: G.Graph, question: str, most_anchors: int = 8, pairs: int = 30, length: int = 6, budget: int = 180) -> DataFrame:
    """(question, paths, context): shortest paths between the best pairs of a question's anchors as text, shorter and more preferred ones first, within the budget of lines."""
    chosen = anchor_pairs(anchors, question, "node_id", "sim", most_anchors, pairs).select(question, F.col("a").alias("u"), F.col("b").alias("v"))
    found = G.shortest_paths(g.edges, chosen.select("u", "v"), length).filter("len > 0")
    lines = path_lines(G.path_edges(found, g.edges), found, g.nodes)
    own = chosen.join(lines, ["u", "v"])
    w = Window.partitionBy(question).orderBy("len", F.desc("preferred"), "u", "v")
    kept = own.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= budget)
    text = kept.groupBy(question).agg(F.count("*").alias("paths"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.format_string("[Chunk %d] [Path] %s", "r", "line").alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))
    return anchors.select(question).distinct().join(text, question, "left").select(question, F.coalesce("paths", F.lit(0)).alias("paths"), F.coalesce("context", F.lit("(No graph evidence retrieved.)")).alias("context"))


def chunk_context(chunks: DataFrame, question: str, rank: str, text: str, file: str, section: str, score: str) -> DataFrame:
    """(question, context): chunks with a header each, in the order of their rank (V11, F38); a question has as many as its search gave."""
    header = F.format_string("[Chunk %d | %s | %s | %.4f]\n%s", F.col(rank), F.coalesce(file, F.lit("unknown")), F.coalesce(section, F.lit("unknown")), F.round(score, 4), F.coalesce(text, F.lit("")))
    return chunks.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), header.alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))


def answer_record(method: str, answer: Column, gold: Column, context: Column) -> list[Column]:
    """The columns of a result record (V12): a missing gold answer leaves the judgement open."""
    return [F.lit(method).alias("method"), answer.alias("answer"), F.when(gold.isNotNull(), F.coalesce(answer == gold, F.lit(False))).alias("is_correct"), context.alias("context")]


def embed_new(texts: DataFrame, done: DataFrame, key: str, text: str, embed: Callable[[list[str]], list], batch: int = 100) -> DataFrame:
    """(key, vec): vectors of the rows that `done` lacks and that have text.

    The model gets `batch` texts at a time; if that fails it gets each alone,
    and a text that fails again is left out, to be tried in the next run.
    """

    def run(frames):
        for f in frames:
            out = []
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                try:
                    vectors = embed(part[text].tolist())
                except Exception:
                    vectors = []
                    for x in part[text]:
                        try:
                            vectors.append(embed([x])[0])
                        except Exception:
                            vectors.append(None)
                out += [(k, v) for k, v in zip(part[key], vectors, strict=True) if v is not None]
            yield pd.DataFrame(out, columns=[key, "vec"])

    kind = dict(texts.dtypes)[key]
    new = texts.filter(F.trim(text) != "").join(done.select(key).distinct(), key, "left_anti").select(key, text)
    return new.mapInPandas(run, f"`{key}` {kind}, vec array<double>")
