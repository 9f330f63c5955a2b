"""Files as frames, with schemas given and structure checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators.relational import require_columns


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_records(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False) -> DataFrame:
    """A JSON array of records, or JSON lines (S01, S27); a missing path is empty only if that is allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_envelope(spark: SparkSession, path: str, item: str, field: str = "items") -> DataFrame:
    """The items of {meta, items: [...]} files, one row each, with their file."""
    x = spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).json(path)
    return x.select(F.col("_metadata.file_name").alias("file"), F.explode(field).alias("_i")).select("file", "_i.*")


def json_list_or_results(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Records of files that hold a list or {results: list}; anything else is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    top = F.from_json("value", f"array<struct<{item}>>")
    inner = F.from_json("value", f"results array<struct<{item}>>")["results"]
    rows = F.when(F.col("value").rlike(r"^\s*\["), top).otherwise(inner)
    checked = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("neither a list nor results in "), "file"))).otherwise(rows)
    return raw.select("file", F.explode(checked).alias("_i")).select("file", "_i.*")


def csv_table(spark: SparkSession, path: str, schema: str, *required: str) -> DataFrame:
    """CSV with header under a schema; required columns must be named there."""
    return require_columns(spark.read.schema(schema).csv(path, header=True), *required)


def parquet_or_csv(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """base.parquet if it exists, else base.csv."""
    return spark.read.parquet(f"{base}.parquet") if exists(spark, f"{base}.parquet") else csv_table(spark, f"{base}.csv", schema)


def split_files(spark: SparkSession, root: str, split: str, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a split partition, else of its first fallback that has rows."""
    data = spark.read.parquet(root)
    for s in (split, *fallbacks):
        part = data.filter(F.col("split") == s)
        if not part.isEmpty():
            return part
    raise ValueError(f"no rows of split {split}")


def check_probabilities(df: DataFrame, p: str, slack: float = 1e-6) -> DataFrame:
    """The frame itself, or an error if a probability is null, no number or outside [0, 1] by more than the slack."""
    bad = df.filter(F.col(p).isNull() | F.isnan(p) | (F.col(p) < -slack) | (F.col(p) > 1 + slack)).limit(1).collect()
    if bad:
        raise ValueError(f"{p} is no probability in {bad[0]}")
    return df


def check_vectors(df: DataFrame, vec: str) -> DataFrame:
    """The frame itself, or an error unless all vectors have one size."""
    sizes = df.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vector sizes from {sizes['a']} to {sizes['b']}")
    return df


def delimited(spark: SparkSession, path: str, names: list[str], least: int = 18) -> DataFrame:
    """Pipe-delimited lines with at least `least` fields, further ones ignored."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).filter(F.size(parts) >= least).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def source_type(df: DataFrame, file: str = "file") -> Column:
    """A CamelCase category from a file's name."""
    from lattica.functions.text import camel

    return camel(F.regexp_replace(F.col(file), r"^.*/|\.[^.]*$", ""))
