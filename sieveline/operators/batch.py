"""Batches of files: limits, one row for each file whatever becomes of it, and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILES, MAX_BYTES = 20, 20 << 20


def guarded(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (filename, length) with a status: oversize and missing (null length) files fail, too many files are an error."""
    if max_files and files.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    error = F.when(F.col("length").isNull(), "file is missing").when(F.col("length") > max_bytes, "file is too large")
    return files.withColumn("error", error).withColumn("status", F.when(error.isNull(), "success").otherwise("failed"))


def process(files: DataFrame, result: Callable[[DataFrame], DataFrame], key: str = "filename") -> DataFrame:
    """Rows (filename, status, entity_count, result_path, report_path, error). ``result`` maps good files to rows with those columns; a file without one failed."""
    good = result(files.where("status = 'success'"))
    out = files.join(good.select(key, "entity_count", "result_path", "report_path"), key, "left")
    lost = (F.col("status") == "success") & F.col("result_path").isNull()
    return out.select(key, F.when(lost, "failed").otherwise(F.col("status")).alias("status"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "result_path", "report_path", F.when(lost, "no result").otherwise(F.col("error")).alias("error"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Files, successes and failures."""
    return rows.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


def expired(created: Column, now: Column, hours: int = 24) -> Column:
    """Whether a result is older than its time."""
    return created < now - F.make_interval(hours=F.lit(hours))
