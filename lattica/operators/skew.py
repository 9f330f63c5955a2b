"""Joins that survive keys holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, slices: int) -> DataFrame:
    """Keys with more rows than a slice's share; at most `slices` of them, so the result is bounded."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * slices > F.col("_total")).select(key)


#: Rows a lookup table may have to be broadcast.
MAX_LOOKUP = 200_000


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", bound: int = MAX_LOOKUP) -> DataFrame:
    """Equi-join with a table of unique keys: broadcast if it is counted to have at most `bound` rows, else salted, so that no key of `big` ends in one task."""
    if small.limit(bound + 1).count() <= bound:
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, how)


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", slices: int = 24) -> DataFrame:
    """Equi-join on `key` in which rows of heavy keys of `big` spread over `slices` salts.

    `small` holds few rows a key (usually one); only its rows of heavy keys are
    repeated, so the added volume is at most slices**2 rows. Null keys match nothing.
    """
    heavy = F.broadcast(heavy_keys(big, key, slices).withColumn("_heavy", F.lit(True)))
    left = big.join(heavy, key, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).otherwise(F.lit(0))
    )
    right = small.join(heavy, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_heavy").join(right.drop("_heavy"), [key, "_salt"], how).drop("_salt")
