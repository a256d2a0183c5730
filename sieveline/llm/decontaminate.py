"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A text's tokens are its runs of letters and digits, lower-cased. A mask of fixed positions picks some tokens of a span
and ignores the others, so a seed still hits if an ignored token was replaced. Seeds of all positions of documents and
benchmark items are joined by hash. A hit fixes how the two texts lie on each other; over their overlap, tokens are
compared one to one, and a pair is reported if some ``WINDOW`` consecutive tokens hold ``LEAST`` equal ones or more.
Wherever two tokens of a window differ, one of the masks lies beside them, so no such pair is missed. An item of fewer
tokens than ``WINDOW`` has one seed, of all its tokens, and is reported where all are equal.

The benchmark's seeds are broadcast if their size, which is measured, is at most ``BROADCAST_BYTES``; beyond that they
are joined by a shuffle, and the texts are fetched for the hits.

Defined cases: a null or empty text, or an overlap of fewer tokens than ``WINDOW`` and the item, is never reported; very long texts
are searched whole; rows that repeat an id count as one document whose best overlap is reported; rows with a null id
are reported under null; empty tables give an empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed masks: 1 picks a token, 0 ignores it.
MASKS = ("111010011", "1101001011", "1001110101")
#: The masks of the SQL, which is as it was before the third: pairs that only the third meets aren't in it.
SQL_MASKS = MASKS[:2]
WINDOW, LEAST = 12, 10
BROADCAST_BYTES = 32 << 20


def _tokens(text: Column) -> Column:
    """The hashes of a text's tokens, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, at: str, *keep: str, short: tuple[int, ...] = (), own: bool = False) -> DataFrame:
    """A row (keep, at, key) for each mask and position of the token hashes ``h``. Outer explodes keep filters from being copied below.

    ``short`` are sizes of short items: runs of so many tokens have a key too, with ``own`` only where they are the whole text.
    """
    least = min(*map(len, MASKS), *short)
    each = df.select(*keep, "h", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("h") - least, F.lit(0)))).alias(at))
    pick = lambda n, mask: F.xxhash64(F.lit(n), *[F.get("h", F.col(at) + i) for i, c in enumerate(mask) if c == "1"])
    fits = lambda n: F.size("h") == n if own else F.col(at) + n <= F.size("h")
    long = F.size("h") >= WINDOW if own and short else F.lit(True)
    keys = F.array(*[F.when(long & (F.col(at) + len(m) <= F.size("h")), pick(n, m)) for n, m in enumerate(MASKS)], *[F.when(fits(n), pick(-n, "1" * n)) for n in short])
    return each.select(*keep, "h", at, F.explode_outer(keys).alias("key"))


def _judged(hits: DataFrame) -> DataFrame:
    """Overlaps of the hits (doc_id, item_id, h, bh, diag): the equal tokens, their number, and the most in a window."""
    start = F.greatest(F.col("diag"), F.lit(0))
    length = F.least(F.size("h"), F.col("diag") + F.size("bh")) - start
    pair = F.zip_with(F.slice("h", start + 1, length), F.slice("bh", start - F.col("diag") + 1, length), lambda x, y: (x == y).cast("int"))
    window = F.least(F.lit(WINDOW), F.size("bh"))
    laid = hits.where(length >= window).select("doc_id", "item_id", "diag", window.alias("window"), pair.alias("eq"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("eq") - F.col("window") + 1), lambda i: total(F.slice("eq", i, F.col("window")))))
    need = F.when(F.col("window") < WINDOW, F.col("window")).otherwise(LEAST)
    found = laid.select("doc_id", "item_id", (best >= need).alias("met"), best.alias("best_window"), total(F.col("eq")).alias("n_match"), F.size("eq").alias("n_overlap"), F.greatest("diag", F.lit(0)).alias("first_token"))
    top = F.max(F.struct("met", "best_window", "n_match", "n_overlap", (-F.col("first_token")).alias("back"))).alias("top")
    # Filtered after the aggregate, else the comparison would be copied into the join, whose code couldn't be generated.
    best_of = found.groupBy("doc_id", "item_id").agg(top).where("top.met")
    return best_of.select("doc_id", "item_id", "top.best_window", "top.n_match", "top.n_overlap", (-F.col("top.back")).alias("first_token"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, best_window, n_match, n_overlap, first_token), one for each document and item that overlap."""
    left = docs.select(F.col(id_col).alias("doc_id"), _tokens(F.col(text_col)).alias("h"))
    items = benchmark.select(F.col(item_col).alias("item_id"), _tokens(F.col(item_text_col)).alias("bh"))
    short = tuple(sorted(r["n"] for r in items.select(F.size("bh").alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()))
    right = _seeds(items.withColumn("h", F.col("bh")), "bpos", "item_id", "bh", short=short, own=True).where("key IS NOT NULL").select("key", "item_id", "bpos", "bh")
    size = right.agg(F.sum(F.size("bh") * 8 + 48).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        met = _seeds(left, "dpos", "doc_id", short=short).join(F.broadcast(right), "key")
        return _judged(met.select("doc_id", "item_id", "h", "bh", (F.col("dpos") - F.col("bpos")).alias("diag")))
    # Texts come back by content, so rows that share an id don't mix.
    left = left.withColumn("mark", F.xxhash64("h"))
    met = _seeds(left, "dpos", "doc_id", "mark", short=short).select("doc_id", "mark", "dpos", "key").where("key IS NOT NULL").join(right.select("key", "item_id", "bpos"), "key")
    lying = met.select("doc_id", "mark", "item_id", (F.col("dpos") - F.col("bpos")).alias("diag")).distinct()
    texts = left.select(F.col("mark").alias("m"), F.col("doc_id").alias("d"), "h")
    back = lying.join(texts, (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")))
    known = items.select(F.col("item_id").alias("i"), "bh")
    return _judged(back.join(known, F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "item_id", "h", "bh", "diag"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with the item and the overlap."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seeds(name: str, ident: str) -> str:
    parts = []
    for n, mask in enumerate(SQL_MASKS):
        picked = ", ".join(f"t[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {ident}, p, concat_ws(' ', {n}, {picked}) AS k FROM (SELECT {ident}, t, unnest(range(len(t) - {len(mask)} + 1)) AS p FROM {name} WHERE len(t) >= {len(mask)})")
    return " UNION ALL ".join(parts)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark),
ds AS ({_sql_seeds("d", "doc_id")}),
bs AS ({_sql_seeds("b", "item_id")}),
hit AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diag FROM ds JOIN bs USING (k)),
lain AS (SELECT hit.doc_id, hit.item_id, diag, d.t AS dt, b.t AS bt, greatest(diag, 0) AS s, least(len(d.t), diag + len(b.t)) AS e
  FROM hit JOIN d ON d.doc_id = hit.doc_id JOIN b ON b.item_id = hit.item_id),
cell AS (SELECT doc_id, item_id, diag, s, e, q, CAST(dt[q + 1] = bt[q - diag + 1] AS INT) AS eq FROM (SELECT *, unnest(range(s, e)) AS q FROM lain WHERE e - s >= {WINDOW})),
run AS (SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS w FROM cell),
each AS (SELECT doc_id, item_id, diag, max(CASE WHEN q - s >= {WINDOW - 1} THEN w END) AS best_window, sum(eq) AS n_match, count(*) AS n_overlap, min(s) AS first_token FROM run GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, n_match DESC, n_overlap DESC, first_token) AS r FROM each WHERE best_window >= {LEAST})
SELECT doc_id, item_id, CAST(best_window AS INT) AS best_window, CAST(n_match AS INT) AS n_match, CAST(n_overlap AS INT) AS n_overlap, CAST(first_token AS INT) AS first_token FROM top WHERE r = 1
"""
