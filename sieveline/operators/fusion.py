"""Fusion of the detectors' entities, thresholds, and the types that are asked for.

The filter on types stands after fusion, always: an entity of a type that isn't asked for still suppresses those it overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import greedy
from . import context, rules
from .rules import in_place, ranked

#: Fixed order of precedence of the types.
PRECEDENCE = {
    "id_number": 120, "bank_card": 110, "email": 100, "phone": 90, "license_plate": 80, "passport": 70, "address": 60, "person": 55, "company": 52, "school": 52, "hospital": 52, "organization": 50,
    "ip_address": 45, "url": 40, "qq_number": 35, "wechat_id": 30, "postal_code": 25,
}
MODEL_TYPES = ("address", "person", "organization")
WITHOUT_MODEL = 15
ENTITY = "struct<type:string,text:string,normalized_text:string,start:int,end:int,confidence:double,source:string,sources:array<string>,validation:string,original_type:string>"


def entity(e: Column, has: set[str]) -> Column:
    """An entity with all fields; ``has`` names those that it has."""
    field = lambda name, default: F.coalesce(e[name], default) if name in has else default
    source = field("source", F.lit("unknown"))
    return F.struct(
        e["type"].alias("type"), e["text"].alias("text"), field("normalized_text", e["text"]).alias("normalized_text"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"),
        field("confidence", F.lit(0.0)).cast("double").alias("confidence"), source.alias("source"), field("sources", F.array(source)).alias("sources"), field("validation", F.lit("not_applicable")).alias("validation"),
        (e["original_type"] if "original_type" in has else F.lit(None).cast("string")).alias("original_type"),
    )


def normalized(df: DataFrame, column: str) -> Column:
    """An array column's entities with all fields filled in."""
    has = set(df.schema[column].dataType.elementType.fieldNames())
    return F.transform(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), lambda e: entity(e, has))


def merged(found: Column) -> Column:
    """Entities of one type and span as one: the first one's fields, all sources in order, and the largest confidence."""
    same = lambda a, b: (a["type"] == b["type"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])
    firsts = F.filter(found, lambda a, i: ~F.exists(F.slice(found, F.lit(1), i), lambda b: same(a, b)))

    def joined(a: Column) -> Column:
        group = F.filter(found, lambda b: same(a, b))
        sources = F.when(F.size(group) > 1, F.array_sort(F.array_distinct(F.flatten(F.transform(group, lambda b: b["sources"]))))).otherwise(a["sources"])
        return a.withField("sources", sources).withField("confidence", F.array_max(F.transform(group, lambda b: b["confidence"])))

    return F.when(F.size(found) < 2, found).otherwise(F.transform(firsts, joined))


def rank(e: Column) -> list[Column]:
    """What decides between overlapping entities: precedence (0 if validation failed), confidence, length."""
    precedence = F.create_map(*[F.lit(v) for kv in PRECEDENCE.items() for v in kv])
    base = F.coalesce(F.try_element_at(precedence, e["type"]), F.lit(1))
    alone = e["type"].isin(*MODEL_TYPES) & ~F.array_contains(e["sources"], "ner")
    return [F.when(e["validation"] == "failed", 0).otherwise(base - F.when(alone, WITHOUT_MODEL).otherwise(0)), e["confidence"], e["end"] - e["start"]]


def fuse(found: Column) -> Column:
    """An array of entities without overlaps: the best first, sorted by place."""
    return F.when(F.size(found) < 2, found).otherwise(in_place(greedy(ranked(found, rank), ENTITY)))


def above(found: Column, thresholds: dict[str, float], default: float = 0.0) -> Column:
    """Entities at least as confident as their type's threshold."""
    if not thresholds:
        return F.filter(found, lambda e: e["confidence"] >= default)
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv])
    return F.filter(found, lambda e: e["confidence"] >= F.coalesce(F.try_element_at(limit, e["type"]), F.lit(default)))


def of_types(found: Column, types: set[str] | None) -> Column:
    """Entities of the types; all for None, none for an empty set."""
    if types is None:
        return found
    return F.filter(found, lambda e: e["type"].isin(*sorted(types))) if types else F.slice(found, 1, 0)


def detect(df: DataFrame, *, text_col: str = "text", ner_col: str | None = None, thresholds: dict[str, float] | None = None, types: set[str] | None = None) -> DataFrame:
    """``df`` with rules, context and final (and enhanced, if ``ner_col`` names a model's entities)."""
    out = rules.detect(df, text_col, "rules").withColumn("context", context.detect(F.coalesce(F.col(text_col), F.lit(""))))
    parts = ["rules", "context"]
    if ner_col:
        passed = above(F.col(ner_col), thresholds or {})
        out = out.withColumn("enhanced", context.enhance(F.col(text_col), passed))
        parts = ["rules", "enhanced", "context"]
    out = out.withColumn("_all", F.concat(*[normalized(out, p) for p in parts])).withColumn("_merged", merged(F.col("_all")))
    return out.withColumn("final", of_types(fuse(F.col("_merged")), types)).drop("_all", "_merged")
