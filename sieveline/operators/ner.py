"""Sequence labels: predictions of a pluggable model, token runs, windows, BIO spans, and alignment of spans to tokens."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Predictor(Protocol):
    """A model: texts in, one list of (window, token, start, end, label, probability) for each text out."""

    def predict(self, texts: list[str]) -> list[list[tuple[int, int, int, int, str, float]]]: ...


TOKENS = "window int, token int, start int, end int, label string, prob double"


#: A worker's models, by what loads them; None for one that couldn't be made.
_models: dict[str, Predictor | None] = {}


def model_of(load: Callable[[], Predictor | None]) -> Predictor | None:
    """A worker's model, made once. One that can't be made is None, so that rules go on alone."""
    name = f"{load.__module__}.{load.__qualname__}:{hash(getattr(load, '__code__', load))}"
    if name not in _models:
        try:
            _models[name] = load()
        except Exception:  # whatever a model's library raises
            _models[name] = None
    return _models[name]


def predict(df: DataFrame, load: Callable[[], Predictor | None], *, id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """Token rows of a model's predictions. ``load`` runs once in each worker; without a model, or if it fails, there are no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for frame in frames:
            model = model_of(load)
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = model.predict([t or "" for t in part[text_col]]) if model else [[] for _ in range(len(part))]
                yield pd.DataFrame([(i, *row) for i, rows in zip(part[id_col], made, strict=True) for row in rows], columns=[id_col, "window", "token", "start", "end", "label", "prob"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, {TOKENS}")


class Scorer(Protocol):
    """A model that scores tokens: ``tokens(text)`` are (start, end) pairs, ``scores(text, tokens)`` a row of numbers for each, one for each label."""

    labels: list[str]

    def tokens(self, text: str) -> list[tuple[int, int]]: ...

    def scores(self, text: str, tokens: list[tuple[int, int]]) -> np.ndarray: ...


class Windowed:
    """A predictor from a scorer: windows of ``size`` tokens that share ``overlap``, and the likeliest label of each token by softmax."""

    def __init__(self, scorer: Scorer, size: int = 256, overlap: int = 64) -> None:
        if not 0 <= overlap < size:
            raise ValueError("windows overlap by less than their size")
        self.scorer, self.size, self.step = scorer, size, size - overlap

    def windows(self, n: int) -> list[tuple[int, int]]:
        """Where the windows of n tokens start and end; the last ends with the text."""
        out, at = [], 0
        while n:
            out.append((at, min(n, at + self.size)))
            if out[-1][1] == n:
                break
            at += self.step
        return out

    def predict(self, texts: list[str]) -> list[list[tuple[int, int, int, int, str, float]]]:
        out = []
        for text in texts:
            tokens, rows = self.scorer.tokens(text), []
            for w, (a, b) in enumerate(self.windows(len(tokens))):
                x = np.asarray(self.scorer.scores(text, tokens[a:b]), float)
                p = np.exp(x - x.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                rows += [(w, a + k, *tokens[a + k], self.scorer.labels[int(p[k].argmax())], float(p[k].max())) for k in range(b - a)]
            out.append(rows)
        return out


def encoded(df: DataFrame, tokens: Callable[[str], list[tuple[int, int, int]]], size: int = 256, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, mask, starts, ends, truncated) of texts by a tokenizer of (token, start, end), cut or filled with zeros to ``size``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for i, text in zip(f[id_col], f[text_col], strict=True):
                got = tokens(text or "")
                kept, fill = got[:size], [0] * max(0, size - len(got))
                rows.append((i, [t for t, _, _ in kept] + fill, [1] * len(kept) + fill, [s for _, s, _ in kept] + fill, [e for _, _, e in kept] + fill, max(0, len(got) - size)))
            yield pd.DataFrame(rows, columns=[id_col, "ids", "mask", "starts", "ends", "truncated"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>, mask array<int>, starts array<int>, ends array<int>, truncated int")


def alignment_stats(tokens: DataFrame, entities: DataFrame, labelled: DataFrame, types: tuple[str, ...] = ("person", "address", "organization"), id_col: str = "doc_id") -> DataFrame:
    """One row: entities that label tokens, those of other types, those that tokens don't reach, and tokens of no length."""
    begun = labelled.where(F.col("label").startswith("B-")).agg(F.count("*").alias("aligned"))
    wanted = F.col("type").isin(*types)
    counts = entities.agg(F.count_if(wanted).alias("wanted"), F.count_if(~wanted).alias("ignored"))
    flat = tokens.agg(F.count_if(F.col("end") <= F.col("start")).alias("zero_length"))
    return begun.crossJoin(counts).crossJoin(flat).select("aligned", "ignored", (F.col("wanted") - F.col("aligned")).alias("truncated"), "zero_length")


def token_runs(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of tokens as entities (id, window, type, start, end, confidence): a run ends at O, at B-, at another type, or at a gap."""
    label = F.when((F.col("label") == "O") | (F.col("end") <= F.col("start")), None).otherwise(F.regexp_replace("label", "^[BI]-", ""))
    order = Window.partitionBy(id_col, "window").orderBy("token")
    t = tokens.withColumn("type", label).withColumn("before", F.lag("type").over(order)).withColumn("last", F.lag("end").over(order))
    new = F.col("before").isNull() | F.col("label").startswith("B-") | (F.col("type") != F.col("before")) | (F.col("start") > F.col("last"))
    runs = t.withColumn("run", F.sum(F.when(F.col("type").isNotNull() & new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("type IS NOT NULL").groupBy(id_col, "window", "run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("prob").alias("confidence")).drop("run")


def merge_windows(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entities of all windows, equal ones once with the largest confidence."""
    return entities.groupBy(id_col, "type", "start", "end").agg(F.max("confidence").alias("confidence"))


def bio_spans(labels: DataFrame, *, seq: str, pos: str, label: str) -> DataFrame:
    """Spans (seq, type, start, end) of BIO labels, ends exclusive: B- starts one, I- of another type too, O ends it."""
    order = Window.partitionBy(seq).orderBy(pos)
    kind = F.when(F.col(label).rlike("^[BI]-"), F.lower(F.substring(label, 3, 100)))
    t = labels.select(seq, F.row_number().over(order).alias("p"), F.col(label).alias("raw"), kind.alias("type"))
    near = Window.partitionBy(seq).orderBy("p")
    t = t.withColumn("before", F.lag("type").over(near))
    new = F.col("raw").startswith("B-") | F.col("before").isNull() | (F.col("before") != F.col("type"))
    t = t.withColumn("run", F.sum(F.when(F.col("type").isNotNull() & new, 1).otherwise(0)).over(near))
    return t.where("type IS NOT NULL").groupBy(seq, "run", "type").agg((F.min("p") - 1).alias("start"), F.max("p").alias("end")).drop("run")


def align(tokens: DataFrame, entities: DataFrame, types: tuple[str, ...] = ("person", "address", "organization"), id_col: str = "doc_id") -> DataFrame:
    """Labels of tokens (id, token, label): BIO for entities that are wholly visible, O elsewhere, null for tokens of no length.

    Entities of other types, or whose first or last character lies in no token, label nothing. Overlapping entities are an error.
    """
    e = entities.where(F.col("type").isin(*types)).select(id_col, F.col("type").alias("etype"), F.col("start").alias("es"), F.col("end").alias("ee"))
    before = Window.partitionBy(id_col).orderBy("es", "ee").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("clash", F.max("ee").over(before) > F.col("es"))
    e = e.withColumn("es", F.when(F.coalesce("clash", F.lit(False)), F.raise_error("overlapping entities").cast("int")).otherwise(F.col("es"))).drop("clash")
    hit = tokens.where("end > start").join(e, id_col).where("start < ee AND es < end")
    group = Window.partitionBy(id_col, "es", "ee")
    hit = hit.withColumn("low", F.min("start").over(group)).withColumn("high", F.max("end").over(group)).where("low <= es AND high >= ee")
    order = group.orderBy("token")
    labelled = hit.withColumn("n", F.row_number().over(order)).select(id_col, "token", F.concat(F.when(F.col("n") == 1, "B-").otherwise("I-"), F.upper("etype")).alias("hit"))
    return tokens.join(labelled, [id_col, "token"], "left").select(id_col, "token", F.when(F.col("end") <= F.col("start"), None).otherwise(F.coalesce("hit", F.lit("O"))).alias("label"))
