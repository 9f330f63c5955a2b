"""Exact top-k search and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent to the workers at once; more are searched in blocks.
BLOCK = 4096


def _nearest(matrix, k: int):
    """The k best keys of each query in a partition, ties by key: one matrix product a batch, what can't be among the best is dropped at once."""
    import numpy as np
    import pyarrow as pa

    unit = matrix / (np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) + 1e-12)

    def best(q, key, sim):
        order = np.lexsort((key, -sim, q))
        q, key, sim = q[order], key[order], sim[order]
        first = np.r_[True, q[1:] != q[:-1]]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = place < k
        return q[keep], key[keep], sim[keep]

    def run(batches):
        found = None
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1)
            ok = rows.is_valid()
            keys, rows = keys.filter(ok), rows.filter(ok)
            if not len(keys):
                continue
            v = rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(keys), -1)
            v = v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12)
            sims = np.round(v @ unit.T, 6)
            least = np.partition(sims, len(sims) - k, axis=0)[len(sims) - k] if len(sims) > k else np.full(sims.shape[1], -2.0)
            i, q = np.nonzero(sims >= least)
            new = (q, keys.to_numpy(zero_copy_only=False)[i], sims[i, q])
            found = best(*new) if found is None else best(*(np.concatenate(x) for x in zip(found, new, strict=True)))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["_qi", "_key", "sim"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vec: str, q: str, qvec: str, k: int) -> DataFrame:
    """(q, key, sim, r): the k most similar vectors of each query, similarity to 6 digits, ties by key (an integer).

    Queries are a stated set, searched in blocks of at most BLOCK: a block is
    a matrix sent to the workers, a batch of vectors is multiplied with it at
    once, and each partition gives its own k best, so what is shuffled is
    bounded by queries, k and partitions. Null vectors are left out.
    """
    import numpy as np

    spark = vectors.sparkSession
    own = vectors.select(F.col(key).cast("bigint").alias("_key"), F.col(vec).cast("array<double>").alias("_v"))
    asked = queries.select(F.col(q).alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).filter("_v is not null")
    parts = max(1, -(-queries.count() // BLOCK))
    best: DataFrame | None = None
    for b in range(parts):
        block = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("_q"), F.lit(parts)) == b)
        rows = block.collect()
        if not rows:
            continue
        names = spark.createDataFrame([(i, r["_q"]) for i, r in enumerate(rows)], asked.select(F.lit(0).alias("_qi"), "_q").schema)
        found = own.mapInArrow(_nearest(np.array([r["_v"] for r in rows], dtype="float64"), k), "_qi int, _key bigint, sim double")
        x = found.join(F.broadcast(names), "_qi").select(F.col("_q").alias(q), F.col("_key").alias(key), "sim")
        best = x if best is None else best.unionByName(x)
    if best is None:
        best = asked.select(F.col("_q").alias(q), F.lit(0).cast("bigint").alias(key), F.lit(0.0).alias("sim")).limit(0)
    w = Window.partitionBy(q).orderBy(F.desc("sim"), key)
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)


def anchor_pairs(scored: DataFrame, group: str, key: str, score: str, anchors: int, pairs: int) -> DataFrame:
    """(group, a, b, score): the best pairs of each group's best anchors by summed score, ties by falling ids."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    top = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= anchors)
    a = top.select(group, F.col(key).alias("a"), F.col(score).alias("sa"), F.col("r").alias("ra"))
    b = top.select(group, F.col(key).alias("b"), F.col(score).alias("sb"), F.col("r").alias("rb"))
    x = a.join(b, group).filter("ra < rb").select(group, "a", "b", F.round(F.col("sa") + F.col("sb"), 6).alias("score"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc("a"), F.desc("b")))
    return x.withColumn("k", k).filter(F.col("k") <= pairs).drop("k")
