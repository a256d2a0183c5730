"""Processing history as a table of files: append what is new, look up, page, filter, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "file_hash"


def new_rows(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows whose hash the history doesn't have, one of each hash, with the ids that follow its largest."""
    if incoming.where(F.col(KEY).isNull()).limit(1).count():
        raise ValueError("a row without a hash can't be stored")
    columns = [c for c in incoming.columns if c != "id"]
    fresh = incoming.join(history.select(KEY), KEY, "left_anti").dropDuplicates([KEY])
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # Ids by hash within buckets, and offsets of buckets: no window over all rows.
    bucket = fresh.withColumn("_b", F.pmod(F.xxhash64(KEY), F.lit(256)))
    within = Window.partitionBy("_b").orderBy(KEY)
    sizes = bucket.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = bucket.withColumn("_r", F.row_number().over(within)).join(F.broadcast(offsets), "_b").crossJoin(F.broadcast(last))
    return numbered.select((F.col("last") + F.col("_o") + F.col("_r")).cast("long").alias("id"), *columns)


def upsert(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """The history with what is new in ``incoming``; a hash that it has keeps its row and id."""
    return history.unionByName(new_rows(history, incoming).select(*history.columns))


def ids_of(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """The ids that incoming hashes have in the history."""
    return incoming.select(KEY).join(history.select(KEY, "id"), KEY, "left")


def with_hash(files: DataFrame) -> DataFrame:
    """Rows of the ``binaryFile`` source with the SHA-256 of their bytes."""
    return files.withColumn(KEY, F.sha2("content", 256))


def find(history: DataFrame, *, filename: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Rows whose file name contains a text (in any case) and whose entities have a type; None and "" ask for all."""
    out = history
    if filename:
        out = out.where(F.contains(F.lower("filename"), F.lit(filename.lower())))
    if entity_type:
        out = out.where(F.exists("entities", lambda e: e["type"] == entity_type))
    return out


def page(history: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of the newest rows first; numbers and sizes below 1 count as 1."""
    number, size = max(1, number), max(1, size)
    return history.orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    """The history without some ids. Files that rows name are left alone."""
    return history.join(ids.select("id"), "id", "left_anti")


def decode(rows: DataFrame, schema: str, *columns: str) -> DataFrame:
    """JSON text columns as values of a schema; text that isn't JSON gives null and stays in ``<name>_text``."""
    for c in columns:
        rows = rows.withColumn(f"{c}_text", F.when(F.try_parse_json(c).isNull(), F.col(c))).withColumn(c, F.from_json(c, schema))
    return rows


def write(history: DataFrame, path: str) -> None:
    """Write a history as a table of its day of creation."""
    history.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")
