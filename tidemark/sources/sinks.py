"""Where results go: JSON trees, CSV exports, checked copies, pruned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_label, findings


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset (tests), a folder in the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse") + "/_checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def json_tree(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per value of by, with texts cleaned of forbidden dashes."""
    kinds = dict(df.dtypes)
    df.select(*[clean_label(F.col(c)).alias(c) if kinds[c] == "string" and c not in by else F.col(c) for c in df.columns]).write.mode("overwrite").partitionBy(*by).json(path)


def csv_export(df: DataFrame, path: str, newest: str) -> None:
    df.orderBy(F.desc(newest)).write.mode("overwrite").option("header", True).csv(path)


def checked_copy(df: DataFrame, path: str) -> int:
    """Writes to a place that must not exist yet, and compares the counts."""
    df.write.mode("errorifexists").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if n != (want := df.count()):
        raise RuntimeError(f"{path} has {n} rows, not {want}")
    return n


def pruned(df: DataFrame, keep: Column) -> DataFrame:
    return df.filter(keep)


def leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which a text holds what must not be published, with the kinds."""
    found = df.withColumn("kinds", F.array_distinct(F.flatten(F.array(*[findings(F.coalesce(F.col(c), F.lit(""))) for c in columns]))))
    return found.filter(F.size("kinds") > 0)
