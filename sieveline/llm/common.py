"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a worker takes in hand at once; a single longer text is taken alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark whatever store it is in."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session on one machine may go without: it gets a folder of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(own.get()).rstrip("/")


def quoted(*names: str) -> list[Column]:
    """Columns by their whole names, whatever characters those hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_fields(df: DataFrame, names: Iterable[str], added: str) -> StructType:
    """The schema of columns of ``df`` and those that a string adds; an added one takes the place of one of its name."""
    fields = {c: StructField(c, df.schema[c].dataType) for c in names} | {f.name: f for f in StructType.fromDDL(added)}
    return StructType(list(fields.values()))


class Scratch:
    """Tables in the shared folder that cut lineage; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base, self.n = spark, f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write a DataFrame once, and return it as read from the table."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``save`` whose rows no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + int(n) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, column: str, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``work`` to slices of Arrow batches, bounded by the bytes of ``column``. Columns travel by place, since mapInArrow can't tell names with dots."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns(names), column, limit):
                yield work(part)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)
