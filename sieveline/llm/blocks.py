"""Blocks of rows that ask questions of each other's contents.

Some operators need, for millions of keys in each task, what all other tasks hold for the same keys. As rows of Spark that
costs too much; here a task packs its keys into arrays, one for each of many buckets of the key space, and a row carries an
array. Buckets answer in the order of the question, so an answer needs no keys. Blocks are kept in a table that is bucketed
by block, so answers come back without moving the blocks again. No array is larger than a block or a bucket, and their
numbers grow with the input.
"""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Files of the table of blocks at most, as Spark allows; beyond, a file holds several blocks, which are still worked on one by one.
MAX_BUCKETS = 100_000


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values()), 1)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of ``pack``."""
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def release() -> None:
    """Give memory that is no longer used back to the system, so that what waits between groups is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def mix(keys: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integer keys."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Blocks:
    """A table of blocks, bucketed by its column ``block``."""

    def __init__(self, scratch: Scratch, df: DataFrame) -> None:
        spark = scratch.spark
        self.scratch = scratch
        scratch.n += 1
        self.name, path = f"blocks_{uuid.uuid4().hex}", f"{scratch.base}/{scratch.n}"
        raw = scratch.save(df)
        self.count = raw.count()
        n = min(MAX_BUCKETS, max(self.count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        raw.write.bucketBy(n, "block").sortBy("block").option("path", path).option("compression", "zstd").saveAsTable(self.name)
        scratch.drop(raw)
        self.df = spark.table(self.name)

    def with_answers(self, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Each block with the answers to it: ``work`` gets both as Arrow tables."""

        def run(block: pa.Table, given: pa.Table) -> pa.Table:
            try:
                return work(block, given)
            finally:
                release()

        return self.df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def answered(answers: pa.Table, order: np.ndarray, name: str = "answer") -> np.ndarray:
    """Answers, in the order of the entries that were asked for."""
    parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
    got = np.concatenate([unpack(d)[name] for _, d in parts]) if parts else np.empty(0, np.uint8)
    out = np.empty(len(order), got.dtype)
    out[order] = got
    return out


QUESTION = "block long, bucket int, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def question_batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of questions as Arrow batches."""
    if rows:
        yield from pa.Table.from_pylist(rows, _ARROW).to_batches()


def question_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _ARROW)


def of_bucket(asked: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """All rows of each bucket at once."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return work(t)
        finally:
            release()

    return asked.groupBy("bucket").applyInArrow(run, schema)


def answer(asked: DataFrame, work: Callable[[list[dict[str, np.ndarray]]], list[dict[str, np.ndarray]]]) -> DataFrame:
    """Rows (block, bucket, data): in each bucket ``work`` answers all that blocks ask it, in their order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        made = work([unpack(d) for d in t.column("data").to_pylist()])
        return pa.Table.from_arrays([t.column("block"), t.column("bucket"), pa.array([pack(**m) for m in made], pa.binary())], schema=_ARROW)

    return of_bucket(asked, run, QUESTION)


def total(df: DataFrame, column: str) -> int:
    """The sum of a column, 0 for no rows."""
    return df.agg(F.sum(column).alias("n")).first()["n"] or 0
