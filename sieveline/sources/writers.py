"""Writers: JSON lines, CSV, frozen sets, reports and archives."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An object for each row, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str) -> None:
    """A report with a header, whose first name starts with a byte order mark for spreadsheets."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def frozen(df: DataFrame, path: str) -> bool:
    """Write a set once. Where it is there with the same rows nothing is written; with other rows it is an error. Returns whether it wrote."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("errorifexists").parquet(path)
        return True
    if not same_rows(spark.read.parquet(path), df):
        raise ValueError(f"{path} is frozen and has other rows")
    return False


def file_hashes(df: DataFrame) -> DataFrame:
    """Rows (path, sha256) of the ``binaryFile`` source."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def private_report(results: DataFrame) -> DataFrame:
    """Results without a text in them: lengths, types, boxes if the entities have them, and the start of the input's hash."""
    boxed = "boxes" in results.schema["entities"].dataType.elementType.fieldNames()
    safe = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), F.length(e["text"]).alias("length"), e["start"].alias("start"), e["end"].alias("end"), *([e["boxes"].alias("boxes")] if boxed else [])))
    return results.select(F.left(F.sha2("text", 256), F.lit(12)).alias("input_id"), F.length("text").alias("n_chars"), safe.alias("entities"))


def summary_json(row: DataFrame) -> str:
    """A one-row table as JSON text."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("j")).first()["j"]


def json_files(df: DataFrame, path: str, name: str, value: str) -> DataFrame:
    """Rows (path) of files ``<name>.json`` in a folder that all workers share, each with a row's JSON text. Written whole, then renamed, so a task that runs again does no harm."""

    def run(frames):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for f in frames:
            out = []
            for n, v in zip(f[name], f[value], strict=True):
                at, held = f"{root}/{n}.json", f"{root}/.{n}.{uuid.uuid4().hex}"
                with fs.open_output_stream(held) as o:
                    o.write((v or "null").encode())
                fs.move(held, at)
                out.append(at)
            yield pd.DataFrame({"path": out})

    return df.select(name, value).mapInPandas(run, "path string")


def image_files(df: DataFrame, path: str, stem: str, mode: str, *, images: tuple[str, ...] = ("result", "preview", "mask")) -> DataFrame:
    """Rows (stem, <image>_path...) of PNG files ``<stem>_<ten digits>_<mode, preview or mask>.png``; names are new, so no input is overwritten."""

    def run(frames):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                made, mark = [r[0]], uuid.uuid4().hex[:10]
                for k, kind in enumerate(images):
                    at = f"{root}/{r[0]}_{mark}_{mode if kind == 'result' else kind}.png"
                    if r[k + 1] is None:
                        at = None
                    else:
                        with fs.open_output_stream(at) as o:
                            o.write(bytes(r[k + 1]))
                    made.append(at)
                rows.append(made)
            yield pd.DataFrame(rows, columns=["stem", *[f"{k}_path" for k in images]])

    return df.select(safe_name(F.col(stem), "image").alias("stem"), *images).mapInPandas(run, "stem string, " + ", ".join(f"{k}_path string" for k in images))


def archive(files: DataFrame, limit: int = 1 << 30) -> bytes:
    """Small result files (name, content) as a ZIP. It is made where the driver runs, so their size is checked first."""
    size = files.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
    if size > limit:
        raise ValueError(f"{size} bytes are too many for an archive")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.orderBy("name").toLocalIterator():
            z.writestr(r["name"], bytes(r["content"]))
    return out.getvalue()
