"""Reasoning and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import codes, truth

from lattica.operators import reasoning as R
from lattica.operators import vectors as V
from lattica.plans.registry import Registry, Tables

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql



def _flag():
    return F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "R", "BROADER").otherwise("RELATED")


def _probability():
    return F.least(F.lit(1.0), F.col("l_discount") * 8)


_W = "CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END"
_Q = "least(1.0::DOUBLE, l_discount * 8)"


def _evidence(t: Tables, key: str) -> DataFrame:
    return R.noisy_or(t.lineitem, [key], R.weight(_flag(), R.FINDING_WEIGHTS, 0.4), _probability(), "e")


@query(f"SELECT l_partkey, round(1 - product(1 - {_W} * {_Q}), 6) AS evidence FROM lineitem GROUP BY 1")
def noisy_or_part(t: Tables) -> DataFrame:
    """Evidence of each part."""
    return _evidence(t, "l_partkey").select("l_partkey", F.round("e", 6).alias("evidence"))


_S = f"S AS (SELECT l_orderkey, 1 - product(1 - {_W} * {_Q}) AS e FROM lineitem GROUP BY 1)"
_OW = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.9::DOUBLE WHEN '3' THEN 0.7::DOUBLE WHEN '4' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END"


def _relation():
    return F.element_at(F.create_map(*[F.lit(x) for x in ("1", "INDICATES", "2", "IS_SPECIFIC_FOR", "3", "SUPPORTS", "4", "ASSOCIATED_WITH")]), F.substring("o_orderpriority", 1, 1))


def _second(t: Tables) -> DataFrame:
    x = t.orders.join(_evidence(t, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.noisy_or(x, ["o_custkey"], R.weight(_relation(), R.EVIDENCE_WEIGHTS, 0.5), F.col("e") * 0.1, "e2")


@query(f"WITH {_S} SELECT o_custkey, round(1 - product(1 - {_OW} * e * 0.1::DOUBLE), 6) AS evidence FROM orders JOIN S ON o_orderkey = l_orderkey GROUP BY 1")
def noisy_or_two_stage(t: Tables) -> DataFrame:
    """Order evidence carried on to customers."""
    return _second(t).select("o_custkey", F.round("e2", 6).alias("evidence"))


_L = "(ln(least(greatest(x, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)) - ln(1 - least(greatest(x, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))"


@query(f"WITH {_S}, T AS (SELECT o_custkey, 1 - product(1 - {_OW} * e * 0.1::DOUBLE) AS e2 FROM orders JOIN S ON o_orderkey = l_orderkey GROUP BY 1) SELECT c_custkey, round(1 / (1 + exp(-({_L.replace('x', '(0.05::DOUBLE + 0.9::DOUBLE * c_nationkey / 25)').replace('e(0.05::DOUBLE + 0.9::DOUBLE * c_nationkey / 25)p', 'exp')} + {_L.replace('(x', '(COALESCE(e2, 0)')}))), 6) AS p FROM customer LEFT JOIN T ON c_custkey = o_custkey")
def prior_evidence_fusion(t: Tables) -> DataFrame:
    """Priors and evidence fused in log odds; missing evidence counts as 0."""
    prior = F.lit(0.05) + F.lit(0.9) * F.col("c_nationkey") / 25
    x = t.customer.join(_second(t), F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", F.round(R.fuse(prior, F.coalesce("e2", F.lit(0.0))), 6).alias("p"))


@query(f"SELECT p_partkey, round(COALESCE(e, p_size / 50.0::DOUBLE), 6) AS p FROM part LEFT JOIN (SELECT l_partkey, 1 - product(1 - {_W} * {_Q}) AS e FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def project_back(t: Tables) -> DataFrame:
    """Labels without neighbours keep the model's probability."""
    x = t.lineitem.filter("l_returnflag = 'A' and l_quantity > 45")
    e = R.noisy_or(x, ["l_partkey"], R.weight(_flag(), R.FINDING_WEIGHTS, 0.4), _probability(), "e")
    return t.part.join(e, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.round(F.coalesce("e", F.col("p_size") / F.lit(50.0)), 6).alias("p"))


def _labelled(t: Tables) -> DataFrame:
    """Scores and truths of documents: p from the length, truth from a late load; the source is the label."""
    return t.documents.filter("source is not null and n_chars is not null").select("doc_id", F.col("source").alias("label"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("p"), (F.pmod(F.length("source") + F.col("n_chars"), F.lit(3)) == 0).alias("y"))


_D = "D AS (SELECT doc_id, source AS label, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p, (length(source) + n_chars) % 3 = 0 AS y FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL)"


@query(f"WITH {_D}, L AS (SELECT label, sum(CASE WHEN p >= 0.2 AND y THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.2 AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < 0.2 AND y THEN 1 ELSE 0 END) AS fn FROM D GROUP BY 1) SELECT label, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, (SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) FROM L) AS macro, (SELECT round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM L) AS micro FROM L")
def multilabel_f1(t: Tables) -> DataFrame:
    """F1 of each label, macro and micro."""
    hit = F.col("p") >= 0.2
    c = _labelled(t).groupBy("label").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    f1 = R.scores(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    micro = R.scores(F.sum("tp"), F.sum("fp"), F.sum("fn"))[2]
    return c.select("label", F.round(f1, 6).alias("f1")).join(c.agg(F.round(F.avg(f1), 6).alias("macro"), F.round(micro, 6).alias("micro")))


@query(f"WITH {_D}, A AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE AS r FROM D) SELECT label, round((sum(CASE WHEN y THEN r END) - sum(CASE WHEN y THEN 1 ELSE 0 END) * (sum(CASE WHEN y THEN 1 ELSE 0 END) + 1) / 2.0::DOUBLE) / (CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN y THEN 0 ELSE 1 END)), 6) AS auroc FROM A GROUP BY 1")
def auroc_by_label(t: Tables) -> DataFrame:
    """Area under the curve a label."""
    return R.auroc(_labelled(t), ["label"]).select("label", F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_D}, C AS (SELECT label, p, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM D GROUP BY 1, 2), W AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM C WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT label, round(sum(pos * 1.0::DOUBLE * tp / seen) / sum(pos), 6) AS ap FROM W GROUP BY 1")
def average_precision_by_label(t: Tables) -> DataFrame:
    """Average precision a label."""
    return R.average_precision(_labelled(t), ["label"]).select("label", F.round("ap", 6).alias("ap"))


@query(f"WITH {_D}, G AS (SELECT unnest(range(201)) AS g), X AS (SELECT label, g, sum(CASE WHEN y AND p >= g / 200.0::DOUBLE - 1e-11::DOUBLE THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT y AND p >= g / 200.0::DOUBLE - 1e-11::DOUBLE THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y THEN 0 ELSE 1 END) AS neg FROM D, G GROUP BY 1, 2), F AS (SELECT label, g, pos, neg, round(CASE WHEN pos + tp + fp = 0 THEN 0::DOUBLE ELSE 2.0::DOUBLE * tp / (pos + tp + fp) END, 12) AS f1 FROM X) SELECT label, CASE WHEN pos >= 1 AND neg > 0 THEN round(g / 200.0::DOUBLE, 6) ELSE 0.5::DOUBLE END AS tau, CASE WHEN pos >= 1 AND neg > 0 THEN round(f1, 6) END AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, g) AS r FROM F) WHERE r = 1")
def thresholds_fit(t: Tables) -> DataFrame:
    """The best of 201 thresholds a label."""
    return R.fit_thresholds(_labelled(t), "label").select("label", F.round("tau", 6).alias("tau"), F.round("f1", 6).alias("f1"))


@query(f"WITH {_D}, B AS (SELECT k / 100.0::DOUBLE AS lam, label, (1 - k / 100.0::DOUBLE) * p + k / 100.0::DOUBLE * (1 - p) >= 0.2 AS hit, y FROM D, (SELECT unnest(range(16)) AS k)), C AS (SELECT lam, label, sum(CASE WHEN hit AND y THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN hit AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT hit AND y THEN 1 ELSE 0 END) AS fn FROM B GROUP BY 1, 2), M AS (SELECT lam, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS macro FROM C GROUP BY 1) SELECT lam, macro FROM M ORDER BY macro DESC, lam LIMIT 1")
def blend_grid_best(t: Tables) -> DataFrame:
    """The blend weight with the best macro F1; the grid is exploded within rows and combined at once."""
    x = _labelled(t).withColumn("lam", F.explode(F.array(*[F.lit(k / 100.0) for k in range(16)])))
    hit = R.blend(F.col("p"), 1.0 - F.col("p"), F.col("lam")) >= 0.2
    c = x.groupBy("lam", "label").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    m = c.groupBy("lam").agg(F.round(F.avg(R.scores(F.col("tp"), F.col("fp"), F.col("fn"))[2]), 6).alias("macro"))
    return m.orderBy(F.desc("macro"), "lam").limit(1)


@query(f"WITH {_D}, A AS (SELECT label, avg(p) AS a, avg(CASE WHEN y THEN p END) AS b FROM D GROUP BY 1) SELECT CASE WHEN b - a > 0.02 THEN 'A' WHEN b - a < -0.02 THEN 'C' ELSE 'B' END AS grp, count(*) AS n, round(sum(b - a), 6) AS total, round(median(b - a), 6) AS mid FROM A GROUP BY 1")
def delta_groups(t: Tables) -> DataFrame:
    """Labels grouped by the change between two scores."""
    a = _labelled(t).groupBy("label").agg(F.avg("p").alias("a"), F.avg(F.when(F.col("y"), F.col("p"))).alias("b")).withColumn("d", F.col("b") - F.col("a"))
    grp = F.when(F.col("d") > 0.02, "A").when(F.col("d") < -0.02, "C").otherwise("B")
    return a.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("total"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("mid"))


@query("WITH C AS (SELECT o_orderkey, CAST(unnest(regexp_extract_all('[(' || o_custkey || ', 100.0), (' || o_orderkey || ', 0.0), (x, 1)]', '\\(\\s*(\\d+)\\s*,', 1)) AS BIGINT) AS code FROM orders) SELECT o_orderkey, count(DISTINCT code) AS codes, CAST(sum(DISTINCT code) AS BIGINT) AS total FROM C GROUP BY 1")
def coded_list_parse(t: Tables) -> DataFrame:
    """Codes of a list literal, bad items skipped."""
    text = F.concat(F.lit("[("), "o_custkey", F.lit(", 100.0), ("), "o_orderkey", F.lit(", 0.0), (x, 1)]"))
    x = t.orders.select("o_orderkey", codes(text).alias("c"))
    return x.select("o_orderkey", F.size("c").cast("bigint").alias("codes"), F.aggregate("c", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


@query("SELECT user_id, count(*) AS labels, CAST(sum(y) AS BIGINT) AS positive, max(y) > 0 AS observed FROM (SELECT u.user_id, v.event_type, CASE WHEN e.n IS NULL THEN 0 ELSE 1 END AS y FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view') v LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.event_type = v.event_type) GROUP BY 1")
def observed_mask(t: Tables) -> DataFrame:
    """Multi-hot labels over the vocabulary, and whether any label is observed. Zeros are filled by count, not by a product of keys."""
    vocab = t.events.filter("event_type <> 'view'").agg(F.countDistinct("event_type").alias("labels"))
    own = t.events.groupBy("user_id").agg(F.countDistinct(F.when(F.col("event_type") != "view", F.col("event_type"))).alias("positive"))
    return own.join(vocab).select("user_id", "labels", "positive", (F.col("positive") > 0).alias("observed"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def matrix_stats(t: Tables) -> DataFrame:
    """Shape and range of a matrix in long form."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, CASE WHEN lower(trim(x)) IN ('true', '1') THEN true WHEN lower(trim(x)) IN ('false', '0') THEN false END AS ok FROM (SELECT event_id, CASE event_type WHEN 'view' THEN ' TRUE' WHEN 'click' THEN '0' WHEN 'error' THEN 'maybe' ELSE '1' END AS x FROM events)")
def truth_values(t: Tables) -> DataFrame:
    """booleans from their spellings."""
    x = F.when(F.col("event_type") == "view", " TRUE").when(F.col("event_type") == "click", "0").when(F.col("event_type") == "error", "maybe").otherwise("1")
    return t.events.select("event_id", truth(x).alias("ok"))


_QV = "Q AS (SELECT vec_id AS q, label AS ql, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0)"


def _asked(t: Tables) -> DataFrame:
    """The stated queries: every row whose id is divisible by 20, searched among all rows."""
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("embedding").alias("qe"))


def _near(t: Tables, k: int) -> DataFrame:
    top = V.top_k(t.embeddings, _asked(t), "vec_id", "embedding", "q", "qe", k)
    return top.join(t.embeddings.select("vec_id", "label"), "vec_id").join(_asked(t).select("q", "ql"), "q")


@query(f"WITH {_QV}, X AS (SELECT q, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS sim FROM embeddings, Q) SELECT q, vec_id, sim, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM X) WHERE r <= 5")
def cosine_topk(t: Tables) -> DataFrame:
    """The five nearest vectors of each query vector."""
    return V.top_k(t.embeddings, _asked(t), "vec_id", "embedding", "q", "qe", 5).select("q", "vec_id", "sim", F.col("r").cast("bigint").alias("r"))


@query(f"WITH {_QV}, X AS (SELECT q, ql, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS sim FROM embeddings, Q) SELECT q, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM X) WHERE r <= 30 AND sim >= 0.1 AND vec_id <> q AND label <> ql")
def threshold_candidates(t: Tables) -> DataFrame:
    """Top k first, then threshold, self and type."""
    return _near(t, 30).filter("sim >= 0.1 and vec_id <> q and label <> ql").select("q", "vec_id", "sim")


@query(f"WITH {_QV}, X AS (SELECT q, ql, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS sim FROM embeddings, Q), T AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM X) SELECT q, vec_id, CASE WHEN label = ql THEN 'EXACT' WHEN abs(label - ql) = 1 THEN 'RELATED' ELSE 'NONE' END AS verdict FROM T WHERE r <= 8 AND abs(label - ql) <= 1")
def align_verdicts(t: Tables) -> DataFrame:
    """Verdicts on the eight nearest, NONE dropped."""
    verdict = F.when(F.col("label") == F.col("ql"), "EXACT").when(F.abs(F.col("label") - F.col("ql")) == 1, "RELATED").otherwise("NONE")
    return _near(t, 8).select("q", "vec_id", verdict.alias("verdict")).filter("verdict <> 'NONE'")


@query("SELECT label, a, b, score FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(x.s + y.s, 6) AS score, row_number() OVER (PARTITION BY x.label ORDER BY round(x.s + y.s, 6) DESC, x.vec_id DESC, y.vec_id DESC) AS k FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS s FROM embeddings)) x JOIN (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS s FROM embeddings)) y ON x.label = y.label AND x.r < y.r WHERE x.r <= 4 AND y.r <= 4) WHERE k <= 3")
def anchor_pairs(t: Tables) -> DataFrame:
    """The best pairs among each group's four best anchors."""
    s = t.embeddings.select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("s"))
    return V.anchor_pairs(s, "label", "vec_id", "s", 4, 3)
