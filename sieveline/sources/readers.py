"""Readers: JSON lines in three degrees of strictness, text, images, histories of runs, and files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HIDDEN = r"/(?:\.cache|__pycache__)/"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, row, value): the lines of text files without a byte order mark, blank ones left out; ``row`` counts those of a file from 1, blank ones too.

    A line's number is its place within its part of the file and the lines of the parts before, so a large file isn't one task's.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "^﻿", "").alias("value"))
    part = raw.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    sizes = part.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return part.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("row"), "value").where("trim(value) <> ''")


def strict_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are all JSON objects; another line is an error that names its place."""
    where = F.concat_ws(":", "file", "row")
    v = F.try_parse_json("value")
    bad = v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")
    return lines(spark, path).withColumn("value", F.when(bad, F.raise_error(F.concat(where, F.lit(": not a JSON object"))).cast("string")).otherwise(F.col("value")))


def lenient_json_lines(spark: SparkSession, path: str | list[str], source: str) -> DataFrame:
    """Lines that are JSON; others are left out. ``_source`` names where they are from."""
    return lines(spark, path).where(F.try_parse_json("value").isNotNull()).withColumn("_source", F.lit(source))


def counted_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines, with ``malformed``."""
    return lines(spark, path).withColumn("malformed", F.try_parse_json("value").isNull())


def json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, row, value) of files that hold one JSON object, or an array whose members count from 1."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return raw.select("file", F.posexplode(many).alias("i", "v")).select("file", (F.col("i") + 1).alias("row"), F.to_json("v").alias("value"))


def first_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """The first n lines of each file."""
    order = Window.partitionBy("file").orderBy("row")
    return lines(spark, path).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def discover(spark: SparkSession, root: str, patterns: dict[str, list[str]]) -> DataFrame:
    """Rows (file, source): files of a folder tree by name patterns; the first source whose pattern fits has a file, caches have none."""
    found = None
    for rank, (source, globs) in enumerate(patterns.items()):
        for glob in globs:
            part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select(F.col("path").alias("file"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))
            found = part if found is None else found.unionAll(part)
    if found is None:
        raise ValueError("no patterns")
    out = found.where(~F.col("file").rlike(_HIDDEN)).groupBy("file").agg(F.min_by("source", "rank").alias("source"))
    if out.isEmpty():
        raise FileNotFoundError(f"{root} has no file of {patterns}")
    return out


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (file, source): all JSON files of a folder tree, by name; caches are left out."""
    return discover(spark, root, {"raw": ["*.json", "*.jsonl"]}).orderBy("file")


def uploaded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (filename, path, length, content) of listed files, in a batch's form; those that aren't there have nulls."""
    named = spark.createDataFrame([(p,) for p in paths], "given string").withColumn("filename", F.regexp_extract("given", r"([^/]*)$", 1))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))]
    if not there:
        return named.select("filename", F.col("given").alias("path"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    read = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("key"), "length", "content")
    return named.join(read, F.regexp_replace("given", "^[a-z]+:/*", "/") == F.col("key"), "left").select("filename", F.col("given").alias("path"), "length", "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, height, width, channels, mode, data) of decoded images; files that aren't images have height -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*").withColumnRenamed("nChannels", "channels")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, width, height), nulls for files that aren't images."""
    size = lambda c: F.when(F.col(c) > 0, F.col(c))
    return images(spark, path).select("origin", size("width").alias("width"), size("height").alias("height"))


def runs(spark: SparkSession, root: str, parts: tuple[str, ...]) -> DataFrame:
    """Rows (run, <part>) of folders that have all of the JSON files named, each as text."""
    out = None
    for part in parts:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", part).text(root, wholetext=True)
        one = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value").alias(part.split(".")[0]))
        out = one if out is None else out.join(one, "run")
    return out


def texts(spark: SparkSession, *, text: str | None = None, path: str | None = None) -> DataFrame:
    """One row of text: given, or a file's. One of the two is asked for."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a file")
    return spark.createDataFrame([(text,)], "text string") if text is not None else spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
