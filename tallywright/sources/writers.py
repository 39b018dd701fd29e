"""Sinks: whole tables, updates of parts of them, and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str) -> None:
    """A table with its schema, rows or not."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def replaced(old: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of the update, and of the old table whose key the update doesn't hold."""
    return old.join(update.select(key).distinct(), key, "left_anti").unionByName(update, allowMissingColumns=True)


def upserted(old: DataFrame, update: DataFrame, ids: list[str]) -> DataFrame:
    """The update replaces old rows that share any of the ids; columns that one side lacks are null there."""
    kept = reduce(lambda t, k: t.join(update.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti"), ids, old)
    return kept.unionByName(update, allowMissingColumns=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_per(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__k = 1").drop("__k")


def to_retry(done: DataFrame, wanted: DataFrame, key: str, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows that are settled, and wanted rows that failed to be fetched or were never tried."""
    settled = done.filter(~F.coalesce(F.col(reason).startswith("fetch failed"), F.lit(False)))
    return settled, wanted.join(settled, key, "left_anti")


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that the rows fall in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")
