"""Problem 1: duplicates hidden by formatting differences.

Canonical keys are built with JVM expressions, records are range-partitioned
and sorted by (key, id), and one scan over adjacent rows compares full keys.
A key that fills several partitions is stitched over their borders from one
summary row per partition, so no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import cut_lineage, release, staged

#: Labels of the fields a name may consist of, in their usual order.
FIELD_LABELS = ("finding", "lead", "phase", "grade", "value")
_POINT = "\u0001"
_INVISIBLE = r"[\p{Cf}\p{Cc}&&[^\s\u0001]]"


def fold(text: Column) -> Column:
    """Lower case, letters and digits only; < and > and points between digits stay."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _INVISIBLE, "")
    dots = F.regexp_replace(low, r"(?<=\p{Nd})\.(?=\p{Nd})", _POINT)
    kept = F.regexp_replace(dots, r"[^\p{L}\p{Nd}<>\u0001]", "")
    return F.translate(kept, _POINT, ".")


def fold_fields(text: Column, labels: Sequence[str] = FIELD_LABELS) -> Column:
    """fold() of a text, with labelled fields ("label: x; label= y") in the order of `labels`.

    The text counts as labelled if it starts with a label (signs before it
    are ignored); any other text is folded as it stands.
    """
    names = "|".join(labels)
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _INVISIBLE, "")
    parts = F.split(low, rf"(?<![\p{{L}}\p{{Nd}}])(?=(?:{names})[\s\p{{Z}}]*[:=])")
    folded = F.filter(F.transform(parts, fold), lambda p: p != "")
    ranks = F.lit(0)
    order = F.array(*[F.lit(x) for x in labels])
    keyed = F.transform(
        folded,
        lambda p: F.struct(
            F.coalesce(F.array_position(order, F.regexp_extract(p, rf"^({names})", 1)), ranks).cast("int").alias("o"),
            p.alias("p"),
        ),
    )
    joined = F.concat_ws("", F.transform(F.array_sort(keyed), lambda s: s["p"]))
    labelled = low.rlike(rf"^[^\p{{L}}\p{{Nd}}<>]*(?:{names})[\s\p{{Z}}]*[:=]")
    return F.when(labelled, joined).otherwise(fold(text))


def legible(text: Column) -> Column:
    """Whether a text has a letter or digit."""
    return F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{Nd}]")


def record_key(name: Column, kind: Column, labels: Sequence[str] = FIELD_LABELS) -> Column:
    """One key for the unordered pair of name and type; null where either side must not count.

    A row whose name has neither letter nor digit has no key, and neither has
    one whose type column is as empty (the name may stand in either column).
    """
    a, b = fold_fields(name, labels), fold_fields(kind, labels)
    return F.when(legible(name) & legible(kind), F.concat(F.least(a, b), F.lit("\u0000"), F.greatest(a, b)))


def _scan(carry: dict[int, tuple[str, int]]):
    """Adjacent comparison over sorted batches: the id of the first row of each row's run."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, first = carry.get(TaskContext.get().partitionId(), (None, None))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0), batch.column(1)
            values = ids.to_numpy(zero_copy_only=False)
            new = np.ones(len(values), dtype=bool)
            new[0] = keys[0].as_py() != key
            if len(values) > 1:
                new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(new, np.arange(len(values)), -1))
            keep = np.where(at >= 0, values[np.maximum(at, 0)], first if first is not None else 0)
            key, first = keys[len(keys) - 1].as_py(), int(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype("int64")), ids.cast(pa.int64())], ["keep_id", "node_id"])

    return run


def runs(df: DataFrame, key: Column, id_col: str, partitions: int | None = None) -> DataFrame:
    """(keep_id, node_id) for each row with a non-null key; keep_id is the run's smallest id.

    Rows are range-partitioned by (key, id): a key with a third of all rows
    spreads over a third of the partitions. The driver sees one row per
    partition (last key and the id where that run starts), never the groups.
    Nulls have no run; repeated ids are adjacent rows of one run.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys are made once, as the sampling of the ranges reads them too
    keyed = staged(df.select(key.alias("_key"), F.col(f"`{id_col}`").cast("bigint").alias("_id")).filter("_key is not null and _id is not null"), "keys")
    ordered = cut_lineage(keyed.repartitionByRange(n, "_key", "_id").sortWithinPartitions("_key", "_id"))
    release(keyed)
    # one row a partition: its first key, its last key and the smallest id of that key, combined before the shuffle
    ends = (
        ordered.groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min("_key").alias("head"), F.max(F.struct("_key", (-F.col("_id")).alias("start"))).alias("tail"))
        .select("p", "head", F.col("tail._key").alias("tail"), (-F.col("tail.start")).alias("start"))
        .collect()
    )
    carry: dict[int, tuple[str, int]] = {}
    last: tuple[str, int] | None = None
    seen = {r["p"]: r for r in ends}
    for p in range(max(seen, default=-1) + 1):
        if last is not None:
            carry[p] = last
        if p in seen:
            _, head, key_, start = seen[p]
            last = last if last is not None and last[0] == key_ == head else (key_, start)
    return ordered.mapInArrow(_scan(carry), "keep_id bigint, node_id bigint")


def repeats(nodes: DataFrame) -> DataFrame:
    """(keep_id, node_id) of every node that repeats a record with a smaller id."""
    return runs(nodes, record_key(F.col("name"), F.col("node_type")), "node_id").filter("keep_id <> node_id")


def collapse(nodes: DataFrame) -> DataFrame:
    """One representative for each record with its exact number of copies: keep_id, copies, name, node_type, source.

    A row without key repeats no other and stands for itself, so the copies add up to the rows.
    """
    counts = runs(nodes, record_key(F.col("name"), F.col("node_type")), "node_id").groupBy("keep_id").agg(F.count("*").alias("copies"))
    own = nodes.select(F.col("node_id").cast("bigint").alias("keep_id"), "name", "node_type", "source")
    lone = own.filter(~(legible(F.col("name")) & legible(F.col("node_type"))))
    return counts.join(own, "keep_id").unionByName(lone.withColumn("copies", F.lit(1).cast("bigint")))
