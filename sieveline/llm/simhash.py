"""SimHash near-dedup: fingerprints of word shingles, linked by a grid join on counts of bits.

A 64-bit fingerprint is cut into 16 segments of 4 bits, and the numbers of bits set in them make a point. Two
fingerprints that differ in d bits lie at most d apart in Manhattan distance, so that distance is a lower bound. The
range join for distance 2 uses the unit grid: points at distance 2 or less have a grid point in common that is at most
one step from either, so each point is filed under its own cell and those one step up or down; which steps meet tells
the distance, so each pair is met once. A pair that meets is verified by its exact Hamming distance.

Only distinct fingerprints are joined, so copies cost nothing; each document then takes its fingerprint's component.

Defined cases: a text that is null or without words has fingerprint zero, linked like any other; one with fewer words
than a shingle has its whole sequence as the only shingle; very long texts are taken whole; rows that repeat an id get a
row each; a null id never is a component's id unless the component has no other; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_slices, table
from .components import components

SEGMENTS, SEGMENT_BITS, CELL_BITS = 16, 4, 3
RADIUS = 2
SHINGLE_WORDS = 3
PIECE = 1 << 18


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, ASCII lower-cased and cut at ASCII white space."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, ">u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint: the bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = np.ascontiguousarray(hashes[at : at + PIECE])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows of ``id_col`` and ``fp``, the fingerprint as a bigint."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(shingle_hashes(t, words)) for t in batch.column(text_col).to_pylist()]
        return pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "fp": pa.array(made, pa.int64())})

    return map_slices(df.select(id_col, text_col), text_col, f"`{id_col}` {kind}, fp bigint", work)


def _cell(fp: Column) -> Column:
    """The counts of bits in the segments, each plus 1 (so that a step down stays in its field), packed."""
    out = F.lit(0).cast("long")
    for j in range(SEGMENTS):
        n = F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * j).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
        out = out + F.shiftleft((n + 1).cast("long"), CELL_BITS * j)
    return out


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` of ``nodes`` that differ in 1 to ``radius`` bits; radius 2 at most."""
    if not 1 <= radius <= 2:
        raise ValueError("the unit grid serves a radius of 1 or 2")
    at = nodes.select("fp", _cell(F.col("fp")).alias("cell"))

    def filed(name: str, ways: tuple[int, ...]) -> DataFrame:
        cells = [F.struct(F.col("cell").alias("cell"), F.lit(0).alias("way"))]
        cells += [F.struct((F.col("cell") + w * (1 << CELL_BITS * j)).alias("cell"), F.lit(w * (j + 1)).alias("way")) for w in ways for j in range(SEGMENTS)]
        return at.select(F.col("fp").alias(name), F.explode(F.array(*cells)).alias("c")).select(name, F.col("c.cell").alias("cell"), F.col("c.way").alias(f"way_{name}"))

    # Spark takes an exploded side for as small as the file below it, and by default would broadcast millions of rows.
    met = filed("a", (1,)).join(filed("b", (1, -1)).hint("merge"), "cell")
    same = "way_a = 0 AND way_b = 0 AND a < b"
    one = "way_a = 0 AND way_b < 0"
    two = "(way_a > 0 AND way_b > way_a) OR (way_a > 0 AND way_b < 0 AND way_a <= -way_b)"
    return met.where(f"(({same}) OR ({one}) OR ({two})) AND bit_count(a ^ b) <= {radius}").select("a", "b")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Rows of ``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links. Runs jobs; keeps tables in the shared folder."""
    scratch = Scratch(df.sparkSession, "simhash")
    of = scratch.save(fingerprints(df, id_col=id_col, text_col=text_col, words=words))
    nodes = scratch.save(of.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(nodes, radius), scratch)
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"))
    return of.join(named, "fp").select(id_col, "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, over shingles of 3 words and links at 2 or fewer bits."""
    made = near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
