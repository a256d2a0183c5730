"""Images and their annotations: manifests, samples, profiles, and what lacks the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import piece
from ..functions.text import strip

#: Fixed suffixes of image files.
IMAGE_SUFFIX = r"(?i)\.(?:png|jpe?g|bmp|webp|tiff?)$"


def numbered(prefix: str, n: Column) -> Column:
    """A name of six digits: prefix_000001."""
    return F.format_string(f"{prefix}_%06d", n.cast("long"))


def samples(records: DataFrame, *, id_col: str = "id", text_col: str = "text", row_col: str = "row") -> DataFrame:
    """Records whose text isn't blank; one without an id is named by its row."""
    named = F.coalesce(F.nullif(strip(F.col(id_col).cast("string")), F.lit("")), numbered("sample", F.col(row_col)))
    return records.where(F.length(strip(F.col(text_col))) > 0).withColumn(id_col, named)


def manifest(rows: DataFrame, constants: dict[str, str], *, row_col: str = "row", image_col: str = "image") -> DataFrame:
    """Annotations as a test manifest: constant columns, ``image_path`` for the image, and ids by row from 1."""
    out = rows.withColumnRenamed(image_col, "image_path").withColumn("id", numbered("image_test", F.col(row_col)))
    return out.withColumns({k: F.lit(v) for k, v in constants.items()})


def image_tree(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows (path, group, metadata) of the image files of a tree; the folder is the group, its first JSON file the metadata or null."""
    split = files.select(F.col(path_col).alias("path"), F.regexp_extract(path_col, r"^(.*)/[^/]*$", 1).alias("folder"))
    first = split.where(F.col("path").rlike(r"(?i)\.json$")).groupBy("folder").agg(F.min("path").alias("metadata"))
    images = split.where(F.col("path").rlike(IMAGE_SUFFIX))
    return images.join(first, "folder", "left").select("path", F.regexp_extract("folder", r"([^/]*)$", 1).alias("group"), "metadata")


def without_annotation(images: DataFrame, annotations: DataFrame, on: str = "image") -> DataFrame:
    """Images that no annotation names."""
    return images.select(on).distinct().join(annotations.select(on).distinct(), on, "left_anti")


def problems(rows: DataFrame) -> DataFrame:
    """Rows (image, error, entity) of annotations (image, width, height, text, entities with type, text, start, end, boxes).

    An image without a size is missing or unreadable and nothing else is said of it.
    """
    sized = F.col("width").isNotNull()
    e = rows.where(sized).select("image", "width", "height", F.col("text").alias("whole"), F.posexplode("entities").alias("entity", "e"))
    wrong = ~piece(F.col("whole"), F.col("e.start"), F.col("e.end")).eqNullSafe(F.col("e.text"))
    empty = F.coalesce(F.size("e.boxes"), F.lit(0)) <= 0
    good = lambda b: (F.size(b) == 4) & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= F.col("width")) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= F.col("height"))
    out = F.when(~empty, F.size(F.filter("e.boxes", lambda b: ~F.coalesce(good(b), F.lit(False))))).otherwise(0)
    each = F.concat(F.when(wrong, F.array(F.lit("span_mismatch"))).otherwise(F.array().cast("array<string>")), F.when(empty, F.array(F.lit("empty_boxes"))).otherwise(F.array().cast("array<string>")), F.array_repeat(F.lit("box_out_of_bounds"), out))
    lost = rows.where(~sized).select("image", F.lit("missing_image").alias("error"), F.lit(None).cast("int").alias("entity"))
    return e.select("image", F.explode(each).alias("error"), "entity").unionByName(lost)


def profile(rows: DataFrame) -> DataFrame:
    """One row about annotations: how many, entities that cross lines (more than one box) or have none, images without entities, templates and types as sorted maps."""
    seen = rows.where("width IS NOT NULL")
    n = F.coalesce(F.size("entities"), F.lit(0))
    boxes = lambda keep: F.sum(F.size(F.filter("entities", keep)))
    some = F.coalesce("entities", F.array().cast(rows.schema["entities"].dataType))
    one = seen.withColumn("entities", some).agg(
        F.count("*").alias("readable"), F.count_if(n <= 0).alias("negative_samples"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"),
        F.coalesce(boxes(lambda e: F.size(e["boxes"]) > 1), F.lit(0)).alias("cross_line_entities"), F.coalesce(boxes(lambda e: F.coalesce(F.size(e["boxes"]), F.lit(0)) <= 0), F.lit(0)).alias("empty_boxes"),
    )
    every = rows.agg(F.count("*").alias("annotations"))
    templates = sorted_counts(rows.withColumn("template", F.coalesce("template", F.lit("unknown"))), "template")
    types = sorted_counts(seen.select(F.explode("entities.type").alias("type")), "type")
    return every.crossJoin(one).crossJoin(templates.select(F.col("counts").alias("by_template"))).crossJoin(types.select(F.col("counts").alias("by_type")))


def sorted_counts(rows: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """One row whose ``counts`` maps each value of ``key`` to its number of rows (or the sum of ``n``), in the order of the keys."""
    each = rows.groupBy(key).agg((F.sum(n) if n else F.count("*")).alias("n"))
    return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("value"))))).alias("counts"))


def merged_boxes(chars: DataFrame, *key: str, pad: float = 3.0) -> DataFrame:
    """Boxes of lines from those of characters (key, line, x1, y1, x2, y2): one for each line, wider by ``pad`` on all sides."""
    return chars.groupBy(*key, "line").agg((F.min("x1") - pad).alias("x1"), (F.min("y1") - pad).alias("y1"), (F.max("x2") + pad).alias("x2"), (F.max("y2") + pad).alias("y2"))


def wrapped(chars: DataFrame, *key: str, width: float, height: float) -> DataFrame:
    """Characters (key, pos, ch, advance) laid out in lines no wider than ``width``: adds line and a box. A line break starts a line; one wider than that stands alone.

    Lines depend on those before, so a text's characters are a fold.
    """
    row = F.struct("pos", "ch", "advance")
    texts = chars.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("cs"))
    none = F.array().cast("array<struct<pos:int,line:int,x1:double,x2:double>>")
    start = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("x"), none.alias("out"))

    def step(acc: Column, c: Column) -> Column:
        brk = c["ch"] == "\n"
        new = (acc["x"] > 0) & (acc["x"] + c["advance"] > width)
        line = F.when(brk | new, acc["line"] + 1).otherwise(acc["line"])
        x1 = F.when(brk | new, F.lit(0.0)).otherwise(acc["x"])
        x2 = F.when(brk, F.lit(0.0)).otherwise(x1 + c["advance"])
        put = F.array(F.struct(c["pos"].cast("int").alias("pos"), line.alias("line"), x1.alias("x1"), x2.alias("x2")))
        return F.struct(line.alias("line"), x2.alias("x"), F.when(brk, acc["out"]).otherwise(F.concat(acc["out"], put)).alias("out"))

    laid = texts.select(*key, F.explode(F.aggregate("cs", start, step, lambda acc: acc["out"])).alias("c"))
    return laid.select(*key, "c.pos", "c.line", "c.x1", (F.col("c.line") * height).alias("y1"), "c.x2", ((F.col("c.line") + 1) * height).alias("y2"))


def first_ids(cases: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The rows of the first n ids, for artifacts that are made of a few."""
    return cases.join(F.broadcast(cases.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


def history(steps: DataFrame, *, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """The mean loss of each epoch."""
    return steps.groupBy(epoch).agg(F.avg(loss).alias("loss"))


def early_stopping(epochs: DataFrame, metric: str, patience: int, *, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """``epochs`` with the best metric so far, how many epochs are stale, and whether training stops there. Only a strict gain counts."""
    order = Window.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = before.isNull() | (F.col(metric) > before)
    out = epochs.withColumn("_at", F.row_number().over(order)).withColumn("_gain", F.when(gain, F.col("_at")))
    out = out.withColumn("best", F.max(metric).over(order)).withColumn("stale", F.col("_at") - F.max("_gain").over(order))
    return out.withColumn("stop", F.col("stale") >= patience).drop("_at", "_gain")
