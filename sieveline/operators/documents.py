"""Documents end to end: images are read by a pluggable engine, its text is searched, entities are mapped to boxes and hidden.

An engine is made once in each worker process and answers for an image with JSON as ``layout.parse`` reads it. Whatever goes
wrong with one image is a warning in its row and leaves the others alone.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion, layout, mapping, raster


class Engine(Protocol):
    """Text recognition: pixels (blue first) in, a result that becomes JSON out."""

    def recognise(self, image: np.ndarray) -> object: ...


@dataclass(frozen=True)
class EngineSettings:
    """What an engine is made with. Named models stand in place of language and version; options that are None aren't passed."""

    language: str = "ch"
    version: str | None = None
    device: str | None = None
    threads: int = 8
    orientation: bool = False
    unwarping: bool = False
    line_orientation: bool = True
    detection_model: str | None = None
    recognition_model: str | None = None
    options: dict[str, float | int | str] = field(default_factory=dict)

    def arguments(self) -> dict[str, object]:
        """The engine's keyword arguments."""
        out: dict[str, object] = {"cpu_threads": self.threads, "use_doc_orientation_classify": self.orientation, "use_doc_unwarping": self.unwarping, "use_textline_orientation": self.line_orientation}
        models = {"text_detection_model_name": self.detection_model, "text_recognition_model_name": self.recognition_model}
        if any(models.values()):
            out |= {k: v for k, v in models.items() if v}
        else:
            out |= {"lang": self.language} | ({"ocr_version": self.version} if self.version else {})
        out |= {k: v for k, v in self.options.items() if v is not None}
        return out | ({"device": self.device} if self.device not in (None, "", "auto") else {})


#: A worker's engines by settings, and its recent results by pixels and settings.
_engines: dict[str, Engine] = {}
_recent: "OrderedDict[str, tuple[float, str]]" = OrderedDict()
KEPT, SECONDS = 32, 600.0


def _result(image: np.ndarray, load: Callable[[dict], Engine], arguments: dict, now: Callable[[], float] = time.monotonic) -> str:
    """An image's result as JSON, from the last ones if it is there and isn't old."""
    made = json.dumps(arguments, sort_keys=True)
    key = hashlib.sha256(made.encode() + str(image.shape).encode() + image.tobytes()).hexdigest()
    for old in [k for k, (t, _) in _recent.items() if now() - t > SECONDS]:
        del _recent[old]
    if key in _recent:
        _recent.move_to_end(key)
        return _recent[key][1]
    if made not in _engines:
        _engines[made] = load(arguments)
    out = json.dumps(_engines[made].recognise(image))
    _recent[key] = (now(), out)
    while len(_recent) > KEPT:
        _recent.popitem(last=False)
    return out


def recognise(images: DataFrame, load: Callable[[dict], Engine], settings: EngineSettings = EngineSettings(), *, id_col: str = "image_id") -> DataFrame:  # noqa: B008
    """Rows (id, result, warning): an engine's JSON for each image (height, width, channels, data); ``[]`` and a warning where it failed."""
    kind, arguments = images.schema[id_col].dataType.simpleString(), settings.arguments()

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    rows.append((r[0], _result(raster.to_array(r[1], r[2], r[3], r[4]), load, arguments), None))
                except Exception as e:  # an engine may raise anything
                    rows.append((r[0], "[]", f"OCR failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[id_col, "result", "warning"])

    return images.select(id_col, "height", "width", "channels", "data").mapInPandas(run, f"`{id_col}` {kind}, result string, warning string")


def cached(images: DataFrame, known: DataFrame, *, id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """What a table of results (key, result) knows about images, and the images that it doesn't know. The key is the SHA-256 of the pixels."""
    keyed = images.withColumn("key", F.sha2("data", 256))
    return keyed.join(known, "key").select(id_col, "key", "result"), keyed.join(known.select("key"), "key", "left_anti")


def coarse_warnings(entities: Column) -> Column:
    """What a reader should know about entities' boxes: those that cover whole blocks, and those that may cover too little."""
    def of(e: Column) -> Column:
        coarse = (e["mapping_quality"] == "coarse") | (e["mapping_strategy"] == "full_block")
        said = F.concat(e["type"], F.lit(": coarse mapping, the whole block is hidden: "), F.coalesce(e["fallback_reason"], F.lit("low_mapping_quality")))
        return F.array_compact(F.array(F.when(coarse, said), F.when(e["mapping_warning"] == "possible_partial_entity_coverage", e["mapping_warning"])))

    return F.flatten(F.transform(entities, of))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, behind a generator of one row: the optimizer doesn't copy the expressions below into each place above that reads them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def read_text(images: DataFrame, results: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Rows (id, ordered, full_text, block_map, warning) of an engine's results in reading order."""
    ordered = settled(layout.reading_order(settled(layout.parse(results, "result"))).select(id_col, "ordered", "warning"))
    return settled(layout.reconstruct(ordered).select(id_col, "ordered", "full_text", "block_map", "warning"))


def process(images: DataFrame, load: Callable[[dict], Engine], settings: EngineSettings = EngineSettings(), *, mapper: mapping.Mapper = mapping.Mapper(), mode: str = "black", types: set[str] | None = None, id_col: str = "image_id") -> DataFrame:  # noqa: B008
    """Rows (id, full_text, entities, warnings, result, mask): images with what was found in them hidden.

    Entities have type, text, start, end, confidence, source, enabled, boxes and how they were mapped.
    """
    texts = read_text(images, recognise(images, load, settings, id_col=id_col), id_col)
    # The outer form keeps the optimizer from copying the detectors into a filter below.
    found = fusion.detect(texts, text_col="full_text", types=types).select(id_col, F.posexplode_outer("final").alias("entity", "e")).where("e IS NOT NULL")
    blocks = texts.select(id_col, F.posexplode("ordered").alias("block_index", "b"))
    parts = layout.span_parts(found.select(id_col, "entity", F.col("e.start").alias("start"), F.col("e.end").alias("end")), texts.select(id_col, F.inline("block_map")), id_col)
    many = parts.groupBy(id_col, "entity").agg((F.count("*") > 1).alias("cross_block"))
    full = parts.join(many, [id_col, "entity"]).join(blocks, [id_col, "block_index"]).join(found.select(id_col, "entity", F.col("e.text").alias("entity_text")), [id_col, "entity"])
    image = F.struct("height", "width", "channels", "data").alias("image")
    full = full.join(images.select(id_col, image), id_col).select(
        id_col, "entity", "block_index", "start", "end", "entity_text", "cross_block", "image", F.col("b.text").alias("block_text"), F.col("b.polygon").alias("block_polygon"), F.col("b.confidence").alias("block_confidence"),
        F.lit("direct").alias("alignment"), F.lit(None).cast("string").alias("forced_reason"),
    )
    mapped = mapping.map_parts(full, mapper).drop("image")
    boxes = layout.map_entities(mapped, id_col, "entity").join(mapped.groupBy(id_col, "entity").agg(F.array_join(F.array_distinct(F.array_compact(F.collect_list("fallback_reason"))), ";").alias("fallback_reason"), F.max("mapping_warning").alias("mapping_warning")), [id_col, "entity"])
    e = F.struct(*[F.col(f"e.{c}").alias(c) for c in ("type", "text", "start", "end", "confidence", "source")], F.lit(True).alias("enabled"), "boxes", "mapping_quality", "mapping_confidence", "mapping_strategy", F.nullif("fallback_reason", F.lit("")).alias("fallback_reason"), "mapping_warning")
    entities = found.join(boxes, [id_col, "entity"]).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("entity", e.alias("e")))), lambda x: x["e"]).alias("entities"))
    whole = texts.select(id_col, "full_text", "warning").join(entities, id_col, "left")
    none = F.array().cast(entities.schema["entities"].dataType)
    whole = whole.withColumn("entities", F.coalesce("entities", none))
    said = F.concat(F.array_compact(F.array("warning")), coarse_warnings(F.col("entities")))
    hidden = regenerate(images, whole, mode, id_col=id_col)
    return whole.select(id_col, "full_text", "entities", said.alias("warnings")).join(hidden, id_col, "left")


def regenerate(images: DataFrame, entities: DataFrame, mode: str, *, id_col: str = "image_id") -> DataFrame:
    """Rows (id, result, mask, error): images hidden anew by stored entities, without reading or searching. Disabled ones stay in sight."""
    shown = entities.select(id_col, F.flatten(F.transform(F.filter("entities", lambda e: F.coalesce(e["enabled"], F.lit(True))), lambda e: e["boxes"])).alias("boxes"))
    return raster.redact_images(images.join(shown, id_col, "left"), mode=mode, id_col=id_col)


def report(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Rows (id, report): everything about a document but its pixels as JSON."""
    keep = [c for c in rows.columns if c not in (id_col, "result", "mask", "data")]
    return rows.select(id_col, F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("report"))


def text_report(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, report): a text and what each detector found as JSON (text, rule, ner, context, final)."""
    got = lambda c: F.col(c) if c in rows.columns else F.array().cast("array<string>")
    return rows.select(id_col, F.to_json(F.struct(F.col(text_col).alias("text"), got("rules").alias("rule"), got("enhanced").alias("ner"), got("context").alias("context"), got("final").alias("final"))).alias("report"))


def edited(entities: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entities (id, ordinal, type, ...) with what a table of edits (id, ordinal, type, enabled) says; edits of rows that aren't there are passed over."""
    base = entities if "enabled" in entities.columns else entities.withColumn("enabled", F.lit(True))
    e = edits.select(id_col, "ordinal", F.col("type").alias("_type"), F.col("enabled").alias("_enabled"))
    return base.join(e, [id_col, "ordinal"], "left").withColumn("type", F.coalesce("_type", "type")).withColumn("enabled", F.coalesce("_enabled", "enabled")).select(*base.columns)


SHOWN = ("enabled", "type", "text", "start", "end", "confidence", "source", "boxes", "mapping_quality", "mapping_confidence", "mapping_strategy", "fallback_reason")


def display(entities: DataFrame, *keep: str) -> DataFrame:
    """Entities as a table shows them: twelve columns, confidences to four digits, boxes as JSON; what is missing is null."""
    def one(c: str) -> Column:
        if c not in entities.columns:
            return (F.lit(True) if c == "enabled" else F.lit(None).cast("string")).alias(c)
        return (F.bround(c, 4) if c.endswith("confidence") else F.to_json(c) if c == "boxes" else F.col(c)).alias(c)

    return entities.select(*keep, *map(one, SHOWN))


#: Fixed names of what a performance record holds, whatever was measured.
STAGES = ("callback_wait", "image_decode", "image_preprocess", "ocr", "detection", "ner", "fusion", "coordinate_mapping", "redaction", "preview_generation", "json_generation", "database_write", "frontend_payload_prepare", "total")
COUNTERS = ("ocr_calls", "detection_calls", "mapping_calls", "redaction_calls")


def performance(rows: DataFrame, stages: str = "stages", counters: str = "counters", id_col: str = "request_id") -> DataFrame:
    """Records of one shape: a column for each stage (seconds, 0 if not measured) and counter. Anything else in the maps, texts too, is left out."""
    take = lambda m, k, kind: F.coalesce(F.try_element_at(m, F.lit(k)).cast(kind), F.lit(0).cast(kind))
    return rows.select(id_col, *[F.round(take(F.col(stages), k, "double"), 6).alias(k) for k in STAGES], *[take(F.col(counters), k, "long").alias(k) for k in COUNTERS])


def settings_row(settings: EngineSettings) -> dict:
    """Settings as a plain dictionary, for reports."""
    return asdict(settings)
