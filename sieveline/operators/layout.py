"""OCR output: parsing, reading order, text with its map to blocks, and the boxes of entities.

Blocks are structs of text, confidence, polygon and block_index. The map from text to blocks is a relation (block_index,
block_start, block_end); rows for single characters follow from it where they are asked for.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import geometry as G
from ..functions.text import is_cjk, weights_before

BLOCK = "struct<text:string,confidence:double,polygon:array<array<double>>>"
_POINTS = "array<array<double>>"


def parse(df: DataFrame, json_col: str, *, scale: tuple[Column, Column] | None = None, out: str = "blocks") -> DataFrame:
    """Blocks of OCR results as JSON text: {"res": {rec_texts, rec_scores, rec_polys or dt_polys}} or pages of [polygon, [text, score]]."""
    v = F.try_parse_json(json_col)
    root = F.when(F.try_variant_get(v, "$[0].res", "variant").isNotNull(), F.try_variant_get(v, "$[0].res", "variant")).otherwise(F.coalesce(F.try_variant_get(v, "$.res", "variant"), F.try_variant_get(v, "$[0]", "variant")))
    polys = F.coalesce(F.try_variant_get(root, "$.rec_polys", f"array<{_POINTS}>"), F.try_variant_get(root, "$.dt_polys", f"array<{_POINTS}>"))
    new = F.transform(F.arrays_zip(F.try_variant_get(root, "$.rec_texts", "array<string>").alias("t"), F.try_variant_get(root, "$.rec_scores", "array<double>").alias("s"), polys.alias("p")), lambda z: F.struct(z["t"].alias("text"), z["s"].alias("confidence"), z["p"].alias("polygon")))
    # One level deeper, an array of pages; else one page.
    line = lambda x: F.struct(F.try_variant_get(x, "$[1][0]", "string").alias("text"), F.try_variant_get(x, "$[1][1]", "double").alias("confidence"), F.try_variant_get(x, "$[0]", _POINTS).alias("polygon"))
    flat, nested = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$[0]", "array<variant>")
    paged = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$[0][0][1][0]", "variant")) == "STRING", F.lit(False))
    old = F.transform(F.when(paged, nested).otherwise(flat), line)
    is_new = F.try_variant_get(root, "$.rec_texts", "array<string>").isNotNull()
    got = F.filter(F.coalesce(F.when(is_new, new).otherwise(old), F.array().cast(f"array<{BLOCK}>")), lambda b: b["text"].isNotNull() & b["polygon"].isNotNull())
    if scale:
        got = F.transform(got, lambda b: b.withField("polygon", F.transform(b["polygon"], lambda p: F.array(p[0] * scale[0], p[1] * scale[1]))))
    return df.withColumn(out, got)


def reading_order(df: DataFrame, blocks: str = "blocks", out: str = "ordered") -> DataFrame:
    """Blocks line by line: a block joins the first line whose mean centre is near its own, from top to bottom.

    A line's mean moves with each block that joins, so lines are a fold over a document's blocks.
    """
    top = lambda b: F.array_min(F.transform(b["polygon"], lambda p: p[1]))
    left = lambda b: F.array_min(F.transform(b["polygon"], lambda p: p[0]))
    low = lambda b: F.array_max(F.transform(b["polygon"], lambda p: p[1]))
    centre = lambda b: F.aggregate(b["polygon"], F.lit(0.0), lambda s, p: s + p[1]) / F.size(b["polygon"])
    heights = F.sort_array(F.transform(blocks, lambda b: low(b) - top(b)))
    n = F.size(heights)
    middle = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    first = F.sort_array(F.transform(blocks, lambda b, i: F.struct(top(b).alias("top"), left(b).alias("left"), i.alias("i"), centre(b).alias("centre"), b.alias("b"))))
    lines0 = F.array().cast("array<struct<line:int,sum:double,n:int,top:double>>")
    placed0 = F.array().cast("array<struct<line:int,left:double,seq:int,i:int>>")

    def step(acc: Column, x: Column) -> Column:
        fits = F.filter(acc["lines"], lambda r: F.abs(x["centre"] - r["sum"] / r["n"]) <= acc["tol"])
        line = F.coalesce(F.get(fits, F.lit(0))["line"], F.size(acc["lines"]))
        known = F.size(fits) > 0
        grown = F.transform(acc["lines"], lambda r: F.when(r["line"] == line, F.struct(r["line"].alias("line"), (r["sum"] + x["centre"]).alias("sum"), (r["n"] + 1).alias("n"), r["top"].alias("top"))).otherwise(r))
        fresh = F.concat(acc["lines"], F.array(F.struct(line.alias("line"), x["centre"].alias("sum"), F.lit(1).alias("n"), x["top"].alias("top"))))
        put = F.concat(acc["placed"], F.array(F.struct(line.alias("line"), x["left"].alias("left"), F.size(acc["placed"]).alias("seq"), x["i"].alias("i"))))
        return F.struct(acc["tol"].alias("tol"), F.when(known, grown).otherwise(fresh).alias("lines"), put.alias("placed"))

    start = F.struct(F.greatest(F.lit(4.0), F.coalesce(middle, F.lit(0.0)) * 0.6).alias("tol"), lines0.alias("lines"), placed0.alias("placed"))
    folded = df.withColumn("_fold", F.aggregate(first, start, step))
    keyed = F.sort_array(F.transform("_fold.placed", lambda p: F.struct(F.element_at(F.col("_fold.lines"), p["line"] + 1)["top"].alias("t"), p["line"].alias("line"), p["left"].alias("left"), p["seq"].alias("seq"), p["i"].alias("i"))))
    made = F.transform(keyed, lambda k, n: F.element_at(F.col(blocks), k["i"] + 1).withField("block_index", n))
    return folded.withColumn(out, made).drop("_fold")


def reconstruct(df: DataFrame, blocks: str = "ordered") -> DataFrame:
    """``df`` with full_text, the blocks' texts by lines, and block_map, an array of (block_index, block_start, block_end)."""
    texts = F.transform(blocks, lambda b: b["text"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<block_index:int,block_start:int,block_end:int>>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("block_index"), acc["at"].alias("block_start"), (acc["at"] + F.length(t)).alias("block_end")))).alias("out"))
    return df.withColumn("full_text", F.array_join(texts, "\n")).withColumn("block_map", F.aggregate(texts, start, step, lambda acc: acc["out"]))


def char_map(df: DataFrame, id_col: str) -> DataFrame:
    """A row for each character: (id, char_index, block_index, offset_in_block), the last two null for line breaks."""
    chars = df.where(F.length("full_text") > 0).select(F.col(id_col), "block_map", F.explode(F.sequence(F.lit(0), F.length("full_text") - 1)).alias("char_index"))
    hit = F.get(F.filter("block_map", lambda m: (m["block_start"] <= F.col("char_index")) & (F.col("char_index") < m["block_end"])), F.lit(0))
    return chars.select(id_col, "char_index", hit["block_index"].alias("block_index"), (F.col("char_index") - hit["block_start"]).alias("offset_in_block"))


def span_parts(entities: DataFrame, block_rows: DataFrame, id_col: str) -> DataFrame:
    """Where an entity (id, entity, start, end) lies in blocks (id, block_index, block_start, block_end): an equi-join on the document, ranges compared within."""
    e = entities.select(id_col, "entity", F.col("start").alias("es"), F.col("end").alias("ee"))
    return e.join(block_rows, id_col).where("es < block_end AND block_start < ee").select(id_col, "entity", "block_index", (F.greatest("es", "block_start") - F.col("block_start")).alias("start"), (F.least("ee", "block_end") - F.col("block_start")).alias("end"))


#: Punctuation that counts as ASCII.
_ASCII = str.maketrans({"，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")"})


def normal_with_map(text: str) -> tuple[str, list[int]]:
    """A text in NFKC and lower case without white space, and where each of its characters came from."""
    pairs = [(c, i) for i, raw in enumerate(text or "") for c in normalize("NFKC", raw).translate(_ASCII).lower() if not c.isspace()]
    return "".join(c for c, _ in pairs), [i for _, i in pairs]


@F.pandas_udf(StringType())
def normal(text: pd.Series) -> pd.Series:
    """A text in NFKC and lower case without white space."""
    return text.map(lambda t: None if t is None else normal_with_map(t)[0])


def find_in_blocks(pairs: DataFrame, id_col: str, least: float = 0.75) -> DataFrame:
    """Where a text is in blocks that it isn't mapped to: all places where it stands in normal form, else the most similar window.

    ``pairs`` has (id, entity, value, block_index, text), one row for each block of the entity's document.
    """
    kind = pairs.schema[id_col].dataType.simpleString()

    def scan(frames):
        for f in frames:
            out = []
            for i, e, value, b, text in zip(f[id_col], f["entity"], f["value"], f["block_index"], f["text"], strict=True):
                target, (hay, place) = normal_with_map(value)[0], normal_with_map(text)
                at = hay.find(target) if target else -1
                while at >= 0:
                    out.append((i, e, b, place[at], place[at + len(target) - 1] + 1, "normalized", 1.0))
                    at = hay.find(target, at + 1)
                width = max(len(value or ""), 1) + 2
                for s in range(len(text or "") if target and target not in hay else 0):
                    end = min(len(text), s + width)
                    score = SequenceMatcher(None, target, normal_with_map(text[s:end])[0]).ratio()
                    if score >= least:
                        out.append((i, e, b, s, end, "fuzzy", score))
            yield pd.DataFrame(out, columns=[id_col, "entity", "block_index", "start", "end", "alignment", "score"])

    found = pairs.select(id_col, "entity", "value", "block_index", "text").mapInPandas(scan, f"`{id_col}` {kind}, entity int, block_index int, start int, end int, alignment string, score double")
    group = Window.partitionBy(id_col, "entity")
    exact = F.max((F.col("alignment") == "normalized").cast("int")).over(group)
    best = F.row_number().over(group.orderBy(F.desc("score"), "block_index", "start"))
    marked = found.withColumn("_exact", exact).withColumn("_best", best).where("(alignment = 'normalized') OR (_exact = 0 AND _best = 1)")
    n = F.count("*").over(group)
    reason = F.when(F.col("alignment") == "fuzzy", "fuzzy_text_match").when(n > 1, "non_unique_normalized_match").otherwise("normalized_alignment_without_span")
    return marked.withColumn("reason", reason).drop("_exact", "_best")


def map_parts(parts: DataFrame, *, strict: bool = True, pad_x: float = 4.0, pad_y: float = 3.0, least_confidence: float = 0.72, least_width: float = 3.0, least_height: float = 3.0, full_block: bool = True) -> DataFrame:
    """Boxes of parts without an image.

    ``parts`` has block_text, block_polygon, block_confidence, start, end, entity_text, alignment (direct, normalized, fuzzy), forced_reason and cross_block;
    the result adds polygon, mapping_confidence, mapping_quality, mapping_strategy and fallback_reason.
    """
    text, poly, start, end = F.col("block_text"), F.col("block_polygon"), F.col("start"), F.col("end")
    total = F.greatest(weights_before(text, F.length(text)), F.lit(1e-9))
    p = parts.withColumn("_low", weights_before(text, start) / total).withColumn("_high", weights_before(text, end) / total)
    aligned = F.substring(text, start + 1, end - start)
    exact = (normal(aligned) == normal(F.col("entity_text"))) | F.col("cross_block")
    base = F.lit(0.10) + F.when(F.col("alignment") == "direct", 0.25).otherwise(0.12) + F.when(exact, 0.20).otherwise(0.0)
    base = base + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("block_confidence", F.lit(0.0)))) * 0.15 + F.when(~F.col("cross_block"), 0.15).otherwise(0.0) + 0.10
    digit = F.substring(text, end + 1, F.lit(1)).rlike("(?U)^\\d$") & is_cjk(aligned)
    conf = base - F.when(digit, 0.18).otherwise(0.0)
    conf = F.when(F.col("cross_block"), F.least(conf, F.lit(0.60))).otherwise(conf)
    conf = F.when(F.col("alignment") == "fuzzy", F.least(conf, F.lit(0.55))).otherwise(conf)
    p = p.withColumn("_c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))).withColumn("_digit", digit)
    px, py = G.padding(G.dimensions(poly)["height"], strict, pad_x, pad_y, F.col("_c") < least_confidence)
    p = p.withColumn("_poly", G.between(poly, F.col("_low"), F.col("_high"), px, py))
    size = G.dimensions(F.col("_poly"))
    small = (size["width"] < least_width) | (size["height"] < least_height)
    p = p.withColumn("_small", small).withColumn("_c", F.when(small, F.least("_c", F.lit(0.40))).otherwise(F.col("_c")))
    reasons = F.array_distinct(F.array_compact(F.array(
        F.col("forced_reason"), F.when(F.col("_digit"), "unreliable_name_number_boundary"), F.when(F.col("cross_block"), "cross_block_entity"), F.when(F.col("alignment") == "fuzzy", "fuzzy_text_match"),
        F.when(F.col("_small"), "box_below_minimum_size"), F.when(F.col("_c") < least_confidence, "mapping_confidence_below_threshold"),
    )))
    p = p.withColumn("_reasons", reasons)
    whole = F.lit(strict and full_block) & (F.size("_reasons") > 0)
    return p.select(
        *parts.columns, F.when(whole, poly).otherwise(F.col("_poly")).alias("polygon"), F.bround("_c", 4).alias("mapping_confidence"), F.when(whole, "coarse").otherwise("estimated").alias("mapping_quality"),
        F.when(whole, "full_block").otherwise("weighted").alias("mapping_strategy"), F.nullif(F.array_join("_reasons", ";"), F.lit("")).alias("fallback_reason"),
    )


def map_entities(mapped: DataFrame, *key: str) -> DataFrame:
    """Entities of mapped parts: all boxes in order, the worst quality and confidence, one strategy or ``multi_block``."""
    worst = F.when(F.max((F.col("mapping_quality") == "coarse").cast("int")) == 1, "coarse").when(F.max((F.col("mapping_quality") == "refined").cast("int")) == 1, "refined").otherwise("estimated")
    strategies = F.collect_set("mapping_strategy")
    return mapped.groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("block_index", "start", "polygon"))), lambda b: b["polygon"]).alias("boxes"), worst.alias("mapping_quality"), F.min("mapping_confidence").alias("mapping_confidence"),
        F.when(F.size(strategies) == 1, strategies[0]).otherwise("multi_block").alias("mapping_strategy"),
    )
