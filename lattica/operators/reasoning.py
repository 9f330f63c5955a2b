"""Probability propagation and evaluation over long frames (sample, label, p)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vectors import clip, logit, sigmoid
from lattica.operators.relational import running

#: Weights by mapping verdict of findings and of labels, and by relation of evidence.
FINDING_WEIGHTS = {"EXACT": 1.0, "NARROWER": 0.8, "BROADER": 0.6, "RELATED": 0.1, "NONE": 0.0}
LABEL_WEIGHTS = {"EXACT": 1.0, "BROADER": 0.8, "NARROWER": 0.6, "RELATED": 0.1, "NONE": 0.0}
EVIDENCE_WEIGHTS = {"INDICATES": 1.0, "IS_SPECIFIC_FOR": 0.9, "SUPPORTS": 0.7, "ASSOCIATED_WITH": 0.6}


def weight(kind: Column, table: dict[str, float], default: float) -> Column:
    """Weight of a type in any case, the default for others and null."""
    m = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(F.element_at(m, F.upper(F.trim(kind))), F.lit(default))


def noisy_or(df: DataFrame, keys: list[str], w: Column, p: Column, name: str) -> DataFrame:
    """1 - product of (1 - w p) a key, over positive weights; partial products are formed before the shuffle."""
    return df.withColumns({"_w": w, "_p": p}).filter("_w > 0 and _p is not null").groupBy(*keys).agg((1.0 - F.product(1.0 - F.col("_w") * F.col("_p"))).alias(name))


def fuse(prior: Column, evidence: Column, alpha: float = 1.0) -> Column:
    """Log-odds fusion of prior and evidence."""
    return sigmoid(logit(prior) + F.lit(alpha) * logit(evidence))


def blend(model: Column, graph: Column, lam: Column) -> Column:
    """Convex blend, clipped to [0, 1]."""
    return clip((1.0 - lam) * model + lam * graph, 0.0, 1.0)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2.0 * tp, 2.0 * tp + fp + fn)


def counts_by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, pos, neg): rows a distinct score, combined before the shuffle; what follows works on scores, not on rows."""
    return df.groupBy(*keys, "p").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc): Mann-Whitney with half for ties; null with one class only (M07). Sums run over range partitions, so a label is no single task."""
    c = running(counts_by_score(df, keys), keys, [F.col("p")], _below=F.col("neg"))
    x = c.withColumn("_u", F.col("pos") * (F.col("_below") - F.col("neg") / 2))
    return x.groupBy(*keys).agg(F.try_divide(F.sum("_u"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ap): sum of recall gains times precision over falling scores; null without a positive."""
    x = running(counts_by_score(df, keys), keys, [-F.col("p")], _tp=F.col("pos"), _n=F.col("pos") + F.col("neg"))
    return x.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("_tp") / F.col("_n")), F.sum("pos").cast("double")).alias("ap"))


def fit_thresholds(df: DataFrame, key: str, grid: int = 201, default: float = 0.5, min_pos: int = 1, prefer: str = "higher_recall") -> DataFrame:
    """(key, tau, f1): the grid threshold with the best F1 of each label.

    Scores fall into grid cells and cells are cumulated, so rows aren't
    multiplied by the grid. Among equal F1 the lowest threshold wins, under
    higher_precision the most precise, then the lowest.
    """
    cell = F.floor(F.col("p") * (grid - 1) + 1e-9).cast("int")  # the highest threshold that p reaches
    c = df.filter("p is not null").groupBy(key, F.least(F.greatest(cell, F.lit(0)), F.lit(grid - 1)).alias("g")).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    total = c.groupBy(key).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    full = total.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).join(c, [key, "g"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy(key).orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    x = full.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    prec, _, f1 = scores(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"))
    first = F.struct(F.round(f1, 12).alias("f"), (F.round(prec, 12) if prefer == "higher_precision" else F.lit(0.0)).alias("q"), (-F.col("g")).alias("t"))
    best = x.groupBy(key).agg(F.max(first).alias("b"), F.first("P").alias("P"), F.first("N").alias("N"))
    ok = (F.col("P") >= min_pos) & (F.col("N") > 0)
    return best.select(key, F.when(ok, -F.col("b.t") / (grid - 1)).otherwise(default).alias("tau"), F.when(ok, F.col("b.f")).alias("f1"))


def assemble_batch(model: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """The rows of `model` (key, label, model, y) with the graph's score beside them, the model's where the graph has none; joined by key, so rows can't shift."""
    return model.join(graph.select(key, F.col("graph").alias("_g")), key, "left").withColumn("graph", F.coalesce("_g", "model")).drop("_g")


def graph_only_run(batch: DataFrame, threshold: float, grid: tuple[float, ...] = tuple(k / 100 for k in range(16))) -> DataFrame:
    """(run, lam, macro, micro, gain): the model alone and its best blend with the graph's scores, by macro F1 over labels.

    batch: label, model, graph, y. The grid is exploded within rows and counted
    at once, one pass over the batch.
    """
    x = batch.withColumn("lam", F.explode(F.array(*[F.lit(float(k)) for k in grid])))
    hit = blend(F.col("model"), F.col("graph"), F.col("lam")) >= threshold
    c = x.groupBy("lam", "label").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    f1 = lambda tp, fp, fn: scores(tp, fp, fn)[2]
    m = c.groupBy("lam").agg(F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("macro"), F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro"))
    base = m.filter("lam = 0").select(F.col("macro").alias("_base"))
    best = m.orderBy(F.desc("macro"), "lam").limit(1).join(base)
    return m.filter("lam = 0").select(F.lit("model").alias("run"), "lam", "macro", "micro", F.lit(0.0).alias("gain")).unionByName(best.select(F.lit("blend").alias("run"), "lam", "macro", "micro", F.round(F.col("macro") - F.col("_base"), 6).alias("gain")))
