"""Problem 8: filling fixed-capacity containers with items.

Documents are range-sorted by size; equal sizes form classes of consecutive
ranks, and containers of equal gap form classes of consecutive numbers. In
rounds from the largest size on, each class of documents is matched with the
smallest gap that holds it (its successor among the sorted gaps), conflicts
go by rank, gaps are updated, and new containers are opened for the rest.
Both kinds of classes are bounded by the capacity, not by the corpus, so the
sweep runs over a small table; the documents meet it in one broadcast join.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import TOKENIZERS, count_tokens
from lattica.session import cut_lineage, staged

CAPACITY = 2048


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over classes: rows (size, rank_from, rank_to, container_from, per_container, offset), and the number of containers.

    Documents of a size with ranks in [rank_from, rank_to) go, per_container
    at a time, to consecutive containers; the first lies at token `offset`.
    """
    gaps: list[int] = []
    classes: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap not in classes:
            classes[gap] = []
            bisect.insort(gaps, gap)
        own = classes[gap]
        if own and own[-1][0] + own[-1][1] == first:
            own[-1] = (own[-1][0], own[-1][1] + n)
        else:
            own.append((first, n))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap]
                    del gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = gap // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each, capacity - gap))
                put(gap - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # the last container of the class takes what remains
                plan.append((size, rank, rank + left, first + full, left, capacity - gap))
                put(gap - left * size, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                put(gap, first + full, n - full)
    return plan, opened


def fill(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "tokens", partitions: int | None = None) -> DataFrame:
    """(id, part, container_id, first_token, tokens, at): each document's place.

    A document above the capacity is split: its full parts fill containers of
    their own, the rest is placed like any other. `first_token` is where the
    part begins in the document, `at` where it begins in its container. Null
    and empty documents take no room: they lie at the start of a container
    picked by their rank. Ties go by id; repeated ids are placed separately.
    """
    spark = sizes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = sizes.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint").alias("all_tokens"))
    cut = own.withColumns({"whole": F.floor(F.col("all_tokens") / capacity), "tokens": F.col("all_tokens") % capacity})
    ordered = cut_lineage(cut.repartitionByRange(n, F.desc("tokens"), id_col).sortWithinPartitions(F.desc("tokens"), id_col))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = ordered.withColumns({"p": F.spark_partition_id(), "row": row})
    # one row a partition and size class: at most partitions + capacity rows
    ends = place.groupBy("p", "tokens").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.sum("whole").alias("w")).collect()
    counts: dict[int, int] = {}
    base = []
    wholes = 0
    for r in sorted(ends, key=lambda r: (r["p"], r["first"])):
        base.append((r["p"], r["tokens"], counts.get(r["tokens"], 0) - r["first"]))
        counts[r["tokens"]] = counts.get(r["tokens"], 0) + r["n"]
        wholes += int(r["w"] or 0)
    plan, opened = best_fit_plan({s: c for s, c in counts.items()}, capacity)
    starts = F.broadcast(spark.createDataFrame(base or [(0, 0, 0)], "p int, tokens bigint, shift bigint"))
    steps = F.broadcast(spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "tokens bigint, rank_from bigint, rank_to bigint, container_from bigint, each bigint, offset bigint"))
    ranked = place.join(starts, ["p", "tokens"]).withColumn("rank", F.col("row") + F.col("shift"))
    inside = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    rest = ranked.filter("tokens > 0").join(steps, (ranked["tokens"] == steps["tokens"]) & inside).drop(steps["tokens"])
    rest = rest.select(
        id_col, F.col("whole").cast("int").alias("part"),
        (F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).cast("bigint").alias("container_id"),
        (F.col("whole") * capacity).cast("bigint").alias("first_token"), F.col("tokens").cast("int"),
        (F.col("offset") + F.col("tokens") * ((F.col("rank") - F.col("rank_from")) % F.col("each"))).cast("int").alias("at"),
    )
    empty = ranked.filter("tokens = 0 and whole = 0").select(
        id_col, F.lit(0).alias("part"), (F.col("rank") % max(opened, 1)).cast("bigint").alias("container_id"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).alias("tokens"), F.lit(0).alias("at")
    )
    # full parts: numbered by partition offsets and the running sum inside a partition's long documents
    long_ = ranked.filter("whole > 0").select(id_col, "p", "row", "whole")
    full = long_.select(id_col, F.posexplode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("i", "part"))
    full_sorted = cut_lineage(full.select(id_col, "part").repartitionByRange(n, id_col, "part"))
    per = {r["p"]: r["n"] for r in full_sorted.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    at, shifts = opened, []
    for p in sorted(per):
        shifts.append((p, at))
        at += per[p]
    shift = F.broadcast(spark.createDataFrame(shifts or [(0, 0)], "p int, shift bigint"))
    full_placed = full_sorted.withColumns({"p": F.spark_partition_id(), "row": row}).join(shift, "p").select(
        id_col, F.col("part").cast("int"), (F.col("row") + F.col("shift")).alias("container_id"), (F.col("part").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).alias("tokens"), F.lit(0).alias("at")
    )
    return rest.unionByName(full_placed).unionByName(empty)


def fill_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """fill() of documents sized in tokens of the public vocabulary; each text is encoded once, as the sampling of the ranges reads the sizes too."""
    return fill(staged(count_tokens(documents, folder=folder), "sizes"), capacity)
