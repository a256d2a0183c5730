"""Token counts of the documents in flat token files that have no index, by scanning for separators.

A flat file is a run of token ids (little-endian, of 2 or 4 bytes) with an end-of-document id after each document. Files are
listed with their sizes, each is cut into ranges of bytes that may start and end anywhere, and tasks open a file at their
range's place, so no file is read by one task. Each range is searched for the separator at once; what it says is its number
of tokens and the places of its separators. A prefix scan over the ranges of a file gives where a range starts, how many
documents end before it, and where the last separator before it is, so a document that lies across ranges is stitched. The
scan has two levels, ranges within groups of ``GROUP`` ranges and groups within a file, so a large file isn't one task's.

Files are opened through pyarrow's file systems (local and shared folders, HDFS, S3, GCS), by the URI of their folder.

Defined cases: tokens after a file's last separator are a document without an end and get ``ended`` false; two
separators in a row hold an empty document; a file without tokens has no documents; empty blocks do no harm; null data
counts as empty; a file whose size isn't a whole number of ids is an error. Writing files: a null text is an empty document;
rows that repeat an id are documents of their own; a null id is kept; very long texts are taken whole; a vocabulary that holds
the separator is an error; an empty table writes nothing, and a folder without files gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _spec, coder
from .common import Scratch, as_fields, quoted, slices, table

SEPARATOR = 50256
#: Bytes of a range, and ranges of a group of the prefix scan.
RANGE_BYTES = 4 << 20
GROUP = 4096
#: Ranges that a task reads, about.
RANGES_PER_TASK = 8


def width_of(separator: int) -> int:
    """Bytes of an id in files that end documents with ``separator``."""
    return 2 if separator < 1 << 16 else 4


def write_files(df: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """Rows (id, file, doc_index): the documents of ``df`` as flat files, one for each task, in the order of its rows.

    The rows say where each document is, nothing of its length. Files are written when the rows are, so save them; a task that
    runs again writes the same file, under another name until it is whole.
    """
    spec = _spec(df, None, None)
    kind = f"<u{width_of(separator)}"
    rows = df.select(*[c.alias(n) for c, n in zip(quoted(id_col), ("id",), strict=True)], F.coalesce(*quoted(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        c = coder(spec.value)
        if len(c.table) > separator:
            raise ValueError("the vocabulary holds the separator's id")
        end = np.array([separator], kind).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, held = f"{root}/{task:08d}.bin", f"{root}/_{task:08d}.{uuid.uuid4().hex}"
        out, at = None, 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(held)
                for ids in c.encode(part.column("text").to_pylist()):
                    out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes())
                    out.write(end)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "file": pa.array([task] * part.num_rows, pa.int32()), "doc_index": pa.array(range(at, at + part.num_rows), pa.int64())})
                at += part.num_rows
        if out is not None:
            out.close()
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
            fs.move(held, name)

    return rows.mapInArrow(run, as_fields(rows, ["id"], "file int, doc_index bigint"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, size) of a folder's files, from its listing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.isFile()] if fs.exists(at) else []
    return spark.createDataFrame([f for f in found if not f[0].rsplit("/", 1)[1].startswith(("_", "."))], "path string, size long")


def read_ranges(files: DataFrame, *, width: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (file, block, data) of the byte ranges of files (path, size); ``file`` is the path."""
    step = max(width, range_bytes // width * width)
    whole = F.when(F.col("size") % width != 0, F.raise_error(F.concat("path", F.lit(": not a whole number of ids"))).cast("long")).otherwise(F.col("size"))
    cut = files.select("path", whole.alias("size")).where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step))).alias("block"))
    n = files.agg(F.sum(F.ceil(F.col("size") / step)).alias("n")).first()["n"] or 0
    dealt = cut.repartition(max(1, min(int(n), max(int(n) // RANGES_PER_TASK, files.sparkSession.sparkContext.defaultParallelism))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, block in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "block")], strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    data = f.read_at(min(step, size - block * step), block * step)
                yield pa.RecordBatch.from_pydict({"file": [path], "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})

    return dealt.mapInArrow(run, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = 4) -> DataFrame:
    """Rows (file, block, n, seps) that say how many tokens a block has and where its separators are."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer() or b"", f"<u{width}")
                n.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "block": batch.column("block"), "n": pa.array(n, pa.int64()), "seps": pa.array(found, pa.list_(pa.int32()))})

    return blocks.select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, n long, seps array<int>")


def stitch(scanned: DataFrame) -> DataFrame:
    """Rows (file, doc_index, first_token, n_tokens, ended) of the documents. ``scanned`` is read twice: save it before."""
    inner = scanned.withColumn("super", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # Within a group: where a block starts, how many separators and which last one come before.
    local = inner.withColumn("start", zero(F.sum("n").over(before))).withColumn("done", zero(F.sum(F.size("seps").cast("long")).over(before)))
    local = local.withColumn("last", F.when(F.size("seps") > 0, F.col("start") + F.element_at("seps", -1)))
    local = local.withColumn("prev", F.max("last").over(before))
    groups = inner.groupBy("file", "super").agg(F.sum("n").alias("gn"), F.sum(F.size("seps").cast("long")).alias("gs"))
    ends = local.groupBy("file", "super").agg(F.max("last").alias("glast"))
    over = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    shift = groups.join(ends, ["file", "super"]).withColumn("gstart", zero(F.sum("gn").over(over))).withColumn("gdone", zero(F.sum("gs").over(over)))
    shift = shift.withColumn("gprev", F.max(F.col("gstart") + F.col("glast")).over(over)).select("file", "super", "gstart", "gdone", "gprev")
    at = local.join(shift, ["file", "super"]).select("file", "block", "n", "seps", (F.col("start") + F.col("gstart")).alias("start"), (F.col("done") + F.col("gdone")).alias("done"), F.coalesce(F.col("prev") + F.col("gstart"), "gprev", F.lit(-1)).alias("prev"))
    sep = at.select("file", "done", "start", "prev", "seps", F.posexplode("seps").alias("k", "sep"))
    first = F.when(F.col("k") == 0, F.col("prev")).otherwise(F.col("start") + F.get("seps", F.col("k") - 1)) + 1
    whole = sep.select("file", (F.col("done") + F.col("k")).alias("doc_index"), first.alias("first_token"), (F.col("start") + F.col("sep") - first).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = at.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("size"), F.max(F.col("done") + F.size("seps")).alias("done"), F.max(F.greatest("prev", F.when(F.size("seps") > 0, F.col("start") + F.element_at("seps", -1)))).alias("last"))
    open_end = tail.where("size > last + 1").select("file", F.col("done").alias("doc_index"), (F.col("last") + 1).alias("first_token"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionAll(open_end)


def count_tokens(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, width: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (file, doc_index, first_token, n_tokens, ended) of the documents in a folder's flat files. Runs jobs; keeps a table in the shared folder."""
    width = width or width_of(separator)
    blocks = read_ranges(list_files(spark, folder), width=width, range_bytes=range_bytes)
    return stitch(Scratch(spark, "token-scan").save(scan_blocks(blocks, separator=separator, width=width)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files, which are then scanned for their ends: doc_id, file, doc_index, first_token, n_tokens."""
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.base}/files"
    placed = scratch.save(write_files(table(spark, sf_dir, "documents"), folder))
    found = count_tokens(spark, folder).withColumn("file", F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("int"))
    return placed.join(found, ["file", "doc_index"]).select(F.col("id").alias("doc_id"), "file", "doc_index", "first_token", "n_tokens")
