"""Evaluation: spans against a reference, entities of images, text and boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, rectangle
from ..functions.text import similarity


def _rates(tp: str, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    p, r = F.col(tp) / F.greatest(predicted, F.lit(1)), F.col(tp) / F.greatest(truth, F.lit(1))
    return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-12))


def span_counts(predicted: DataFrame, truth: DataFrame, seq: str = "seq") -> DataFrame:
    """tp, fp and fn by type, of spans (seq, type, start, end); equal spans count once."""
    key = [seq, "type", "start", "end"]
    both = predicted.select(*key).distinct().withColumn("p", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "full")
    return both.groupBy("type").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def by_type(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each type."""
    p, r, f = _rates("tp", F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return counts.select(F.lower("type").alias("type"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def overall(counts: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1, and macro F1."""
    total = by_type(counts).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    p, r, f = _rates("tp", F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return total.select(p.alias("precision"), r.alias("recall"), f.alias("micro_f1"), "macro_f1", F.col("tp").alias("exact_matches"), F.col("fn").alias("missed"), F.col("fp").alias("false_positives"))


def partial_overlaps(predicted: DataFrame, truth: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: pairs of spans that overlap, neither of which has an equal in the other set, whatever their types."""
    key = [seq, "type", "start", "end"]
    p, t = predicted.select(*key).distinct(), truth.select(*key).distinct()
    left = p.join(t, key, "left_anti").select(seq, F.col("start").alias("ps"), F.col("end").alias("pe"))
    right = t.join(p, key, "left_anti").select(seq, F.col("start").alias("ts"), F.col("end").alias("te"))
    return left.join(right, seq).where("ps < te AND ts < pe").agg(F.count("*").alias("partial_overlaps"))


def rates_by(groups: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of groups that have truth, predicted and matched."""
    p, r, f = _rates("matched", F.col("predicted"), F.col("truth"))
    return groups.select(key, "truth", "predicted", "matched", p.alias("precision"), r.alias("recall"), f.alias("f1"))


MATCH = "truth_index int, pred_index int, kind string"


def match_entities(rows: DataFrame, image: str = "image", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Pairs (image, truth_index, pred_index, kind) of each image's entity arrays: equal ones first, then where one text holds the other.

    Each choice depends on those before it, so an image's few entities are matched in one function call.
    """
    kind = rows.schema[image].dataType.simpleString()

    def one(truths: list, preds: list) -> list[tuple[int, int, str]]:
        free = dict(enumerate(preds))
        found = []
        tests = (("exact", lambda a, b: a == b), ("partial", lambda a, b: (a or "") in (b or "") or (b or "") in (a or "")))
        waiting = list(enumerate(truths))
        for name, alike in tests:
            left = []
            for i, t in waiting:
                hit = next((j for j, p in free.items() if p["type"] == t["type"] and alike(t["text"], p["text"])), None)
                if hit is None:
                    left.append((i, t))
                else:
                    del free[hit]
                    found.append((i, hit, name))
            waiting = left
        return found

    def run(frames):
        for f in frames:
            out = [(i, *m) for i, t, p in zip(f[image], f[truth], f[predicted], strict=True) for m in one(list(t) if t is not None else [], list(p) if p is not None else [])]
            yield pd.DataFrame(out, columns=[image, "truth_index", "pred_index", "kind"])

    return rows.select(image, truth, predicted).mapInPandas(run, f"`{image}` {kind}, {MATCH}")


def best_coverage(box: Column, boxes: Column) -> Column:
    """The largest IoU of a polygon with any of an array, 0 for none."""
    return F.coalesce(F.array_max(F.transform(boxes, lambda b: iou(rectangle(box), rectangle(b)))), F.lit(0.0))


def covered_by(box: Column, blocks: Column, least: float = 0.05) -> Column:
    """Whether some polygon of an array has more than a little in common with a box."""
    return F.exists(blocks, lambda b: iou(rectangle(box), rectangle(b)) > least)


def confidence_bin(c: Column) -> Column:
    return F.when(c >= 0.9, "0.9-1.0").when(c >= 0.7, "0.7-0.9").otherwise("<0.7")


def coverage_class(score: Column) -> Column:
    return F.when(score >= 0.95, "complete").when(score > 0, "partial").otherwise("missed")


def text_summary(pairs: DataFrame, truth: str, read: str) -> DataFrame:
    """One row: images, mean similarity, and errors by characters."""
    s = similarity(F.col(truth), F.col(read))
    errors = F.bround((1 - s) * F.greatest(F.length(truth), F.length(read), F.lit(1)), 0)
    return pairs.agg(F.count("*").alias("images"), F.avg(s).alias("similarity"), (F.sum(errors) / F.sum(F.greatest(F.length(truth), F.lit(1)))).alias("character_error_rate"))


def error_cases(truth: DataFrame, predicted: DataFrame, seq: str = "seq") -> DataFrame:
    """Spans that only one side has: missed, false_positive, or boundary where the other side has one of the type that overlaps."""
    key = [seq, "type", "start", "end"]
    t, p = truth.select(*key).distinct(), predicted.select(*key).distinct()
    lost, extra = t.join(p, key, "left_anti"), p.join(t, key, "left_anti")

    def judged(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        o = other.select(F.col(seq).alias("s2"), F.col("type").alias("t2"), F.col("start").alias("b2"), F.col("end").alias("e2"))
        near = own.join(o, (F.col(seq) == F.col("s2")) & (F.col("type") == F.col("t2")) & (F.col("start") < F.col("e2")) & (F.col("b2") < F.col("end")), "left_semi").withColumn("error", F.lit("boundary"))
        return near.unionByName(own.join(near.drop("error"), key, "left_anti").withColumn("error", F.lit(name)))

    return judged(lost, p, "missed").unionByName(judged(extra, t, "false_positive"))


def image_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Images' results together, or by type, template or source (a column of ``rows``).

    ``rows`` has an entity of truth or prediction each: truth and predicted (booleans), exact and partial (matches), iou (of a matched truth) and confidence.
    """
    group = rows.groupBy(*([by] if by else []))
    matched = F.count_if(F.col("exact") | F.col("partial"))
    one = group.agg(
        F.count_if("truth").alias("truth"), F.count_if("predicted").alias("predicted"), F.count_if("exact").alias("exact"), F.count_if("partial").alias("partial"), matched.alias("matched"),
        F.count_if(F.col("truth") & ~(F.col("exact") | F.col("partial"))).alias("missed"), F.count_if(F.col("predicted") & ~(F.col("exact") | F.col("partial"))).alias("false_positives"),
        F.coalesce(F.avg(F.when(F.col("truth"), F.coalesce("iou", F.lit(0.0)))), F.lit(0.0)).alias("mean_iou"), F.count_if(F.col("truth") & (F.col("iou") >= 0.95)).alias("complete"),
        F.count_if(F.col("truth") & (F.col("iou") > 0) & (F.col("iou") < 0.95)).alias("partly_covered"),
    )
    p, r, f = _rates("matched", F.col("predicted"), F.col("truth"))
    return one.withColumns({"precision": p, "recall": r, "f1": f})


def image_cases(rows: DataFrame) -> DataFrame:
    """Entities that are missed, false, or matched in part only, with what they are in ``error``."""
    hit = F.col("exact") | F.col("partial")
    error = F.when(F.col("truth") & ~hit, "missed").when(F.col("predicted") & ~hit, "false_positive").when(F.col("partial") & ~F.col("exact"), "partial")
    return rows.withColumn("error", error).where("error IS NOT NULL")
