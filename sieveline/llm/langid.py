"""Language ID with bit-sliced Bloom filters of n-grams.

Each slot of a filter holds a bitmask with one bit for each language; the AND of an n-gram's slots gives all languages
that contain it at once. A text's n-grams are looked up together, and bits are counted for each language. A filter says
yes by chance at a rate that its own fill tells, so the counts are corrected for that; the largest decides.

Learning: rows with a text and a label. It reads a sample of about ``SAMPLE_PER_LANGUAGE`` rows of each language
(all, if there are fewer), those with the lowest hashes of their ids. Counts of n-grams are summed by Spark, and each
language keeps its ``GRAMS_PER_LANGUAGE`` most frequent n-grams whose share of the language is at least ``LEAST_SHARE``
of what the language that uses it most has.

Defined cases: a text that is null or without a letter gets ``und`` and score 0; a text with letters but no known
n-gram gets the first language in order and score 0; very long texts are taken whole, their windows in pieces; ties go to the
first language in order; a kept column that has the name of a made one is replaced by it; rows without a label teach nothing; without any labelled row all texts get ``und``; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_fields, map_slices, quoted, table

#: Labelled rows of each language that a model is fitted on, about.
SAMPLE_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 20_000
LEAST_SHARE = 0.2
SLOT_BITS = 18
PIECE = 4 << 20
#: ASCII other than letters counts as a space; bytes from 128 on belong to letters.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """The 4-byte windows of a text's lower-cased UTF-8, as unsigned integers, of which the middle ones aren't spaces; a long text's come in pieces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b"  ", np.uint8)
    for at in range(0, len(raw) - 3, PIECE):
        a = raw[at : at + PIECE + 3].astype(np.uint32)
        whole = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24
        yield whole[(a[1:-2] != 32) & (a[2:-1] != 32)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _slots(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of each n-gram."""
    x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (x >> np.uint64(64 - 2 * SLOT_BITS)).astype(np.int64) & ((1 << SLOT_BITS) - 1)


class Model:
    """Languages in order and their filters, 64 languages in each."""

    def __init__(self, by_language: dict[str, np.ndarray]) -> None:
        self.languages = sorted(by_language)
        self.filters, self.rates = [], np.zeros(len(self.languages))
        for at in range(0, len(self.languages), 64):
            part = self.languages[at : at + 64]
            width = np.dtype(f"u{next(b for b in (1, 2, 4, 8) if len(part) <= 8 * b)}")
            rows = np.zeros(1 << SLOT_BITS, width)
            for k, language in enumerate(part):
                for slots in _slots(by_language[language]):
                    np.bitwise_or.at(rows, slots, width.type(1 << k))
            self.filters.append(rows)
            for k in range(len(part)):
                self.rates[at + k] = np.mean((rows >> width.type(k)) & width.type(1)) ** 2

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-grams each language seems to contain, and how many there are."""
        hits, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            n += len(g)
            one, two = _slots(g)
            for f, rows in enumerate(self.filters):
                masks = rows[one] & rows[two]
                for k in range(64 * f, min(64 * f + 64, len(self.languages))):
                    hits[k] += np.count_nonzero(masks & rows.dtype.type(1 << (k - 64 * f)))
        return hits, n

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """The language, a score from 0 to 1 (the share of n-grams that its own set explains), and the number of n-grams."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, 0
        hits, n = self.counts(text)
        true = np.clip((hits - n * self.rates) / (1 - np.minimum(self.rates, 0.999)), 0, None)
        best = int(true.argmax())
        return self.languages[best], float(min(1.0, true[best] / max(n, 1))), n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the score."""
        return self.judge(text)[:2]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the rows of ``labelled`` that have a text and a label."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    spread = 1 << 20
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(spread, -(-spread * per_language // n)))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(spread)) < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, []).extend(grams(text))
            for lang, parts in seen.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "gram": pa.array(values.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2")
    total = Window.partitionBy("lang")
    share = counted.join(F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").select("lang", "gram", "n", (F.col("n") / F.col("all")).alias("share"))
    kept = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= LEAST_SHARE * F.col("most"))
    top = kept.withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= GRAMS_PER_LANGUAGE)
    by: dict[str, list[int]] = {k: [] for k in sizes}
    for r in top.select("lang", "gram").collect():
        by[r["lang"]].append(r["gram"])
    return Model({k: np.array(v, np.uint32) for k, v in by.items()})


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str, str] = ("lang_pred", "score", "n_grams")) -> DataFrame:
    """Rows of ``id_col``, the columns in ``keep``, and three columns ``out``: the language, the score and the number of n-grams."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, *keep]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.judge(t) for t in batch.column(text_col).to_pylist()]
        made = zip(out, (pa.string(), pa.float64(), pa.int64()), strict=True)
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {name: pa.array([x[k] for x in found], kind) for k, (name, kind) in enumerate(made)})

    added = "`{}` string, `{}` double, `{}` bigint".format(*out)
    return map_slices(df.select(*quoted(*dict.fromkeys([*names, text_col]))), text_col, as_fields(df, names, added), work)


def fold(id_col: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned where crc32 of the id modulo 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    made = predict(docs.select("doc_id", "text"), model)
    return made.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
