"""A folder that files are dropped into, as a stream: detection is a map, so it runs on it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history, rules


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", max_files: int = 16) -> DataFrame:
    """JSON lines of new files, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def entity_rows(docs: DataFrame) -> DataFrame:
    """A row for each entity that rules find in a stream or a table."""
    return rules.exploded(rules.detect(docs), "rules", "doc_id")


def once_each(docs: DataFrame, time_col: str, ttl: str = "600 seconds") -> DataFrame:
    """The first of equal texts within a time, as a cache of results would answer the others."""
    return docs.withColumn("file_hash", F.sha2("text", 256)).withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(["file_hash"])


def counts(entities: DataFrame, time_col: str, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Entities by type in windows of event time."""
    return entities.withWatermark(time_col, late).groupBy(F.window(time_col, every), "type").agg(F.count("*").alias("n"))


def into_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new hashes (file_hash, filename, entities, created_at) to a history. A batch that is run again adds nothing."""
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        try:
            before = history.read(spark, path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = batch.select(F.lit(0).cast("long").alias("id"), *batch.columns).limit(0)
        history.new_rows(before, batch).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
