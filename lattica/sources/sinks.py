"""Writing frames: versions swapped at the end, routes, incremental runs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import scratch_path
from lattica.sources.readers import exists


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with header and a fixed list of columns."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, by partition columns if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def replace_table(df: DataFrame, path: str) -> str | None:
    """Write beside the old version, move that to path.backup-<n>, then move the new one in; gives the backup's path."""
    spark = df.sparkSession
    fresh = f"{path}.new"
    df.write.mode("overwrite").parquet(fresh)
    p = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    backup = None
    if exists(spark, path):
        n = 1
        while exists(spark, f"{path}.backup-{n}"):
            n += 1
        backup = f"{path}.backup-{n}"
        fs.rename(p(path), p(backup))
    fs.rename(p(fresh), p(path))
    return backup


def write_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys the target lacks (K07); gives their number."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    staging = scratch_path(spark, "append")
    df.write.parquet(staging)
    rows = spark.read.schema(df.schema).parquet(staging)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def write_routes(df: DataFrame, path: str, route: str) -> None:
    """One write, a folder for each route."""
    df.write.mode("overwrite").partitionBy(route).parquet(path)


def report(df: DataFrame, title: str, most: int = 200) -> str:
    """A small summary as a Markdown table (K08); beyond `most` rows its last line says how many more there are."""
    rows = df.limit(most + 1).collect()
    more = df.count() - most if len(rows) > most else 0
    head = "| " + " | ".join(df.columns) + " |"
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    rest = ["", f"{more} more rows"] if more else []
    return "\n".join([f"## {title}", "", head, "|" + " --- |" * len(df.columns), *body, *rest]) + "\n"


def to_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text, times in ISO form (F16)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
