"""Documents to layout tables: files go through a decoder given by the caller, whose page dictionaries become tables.

A page dictionary has `rect`, `blocks` (type 0 holds lines with `bbox` and `spans`), `images` (each with its `rects`, or null where
they could not be read), `drawings` and `tables` (`bbox`, `cells` row by row, `texts`). Rectangles are four numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G

#: A file's bytes to its page dictionaries, in order.
Decoder = Callable[[bytes], Iterable[dict]]

_BOX = "array<double>"
PAGE_DICT = (
    f"struct<rect: {_BOX}, rotation: int, blocks: array<struct<type: int, lines: array<struct<bbox: {_BOX}, spans: array<struct<text: string, size: double, font: string, flags: int>>>>>>, "
    f"images: array<struct<rects: array<{_BOX}>>>, drawings: array<struct<rect: {_BOX}, fill: {_BOX}, color: {_BOX}>>, "
    f"tables: array<struct<bbox: {_BOX}, row_count: int, col_count: int, cells: array<array<{_BOX}>>, texts: array<array<string>>>>>"
)


def from_json_lines(raw: bytes) -> Iterable[dict]:
    """A decoder of files with a page dictionary as JSON in each line."""
    return [json.loads(line) for line in raw.decode().splitlines() if line.strip()]


def decoded(files: DataFrame, decoder: Decoder = from_json_lines) -> DataFrame:
    """Files (path, content) to pages (path, page_no, page); a file that cannot be decoded gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, k, json.dumps(p), None) for k, p in enumerate(decoder(raw))]
                except Exception as e:  # a decoder's errors are of any kind, and are a file's result
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "page_no", "page", "error"])

    out = files.select("path", "content").mapInArrow(run, "path string, page_no int, page string, error string")
    return out.withColumn("page", F.from_json("page", PAGE_DICT))


def read(spark: SparkSession, folder: str, suffix: str = "jsonl", decoder: Decoder = from_json_lines) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return decoded(files, decoder)


def _rect(a: Column) -> Column:
    return F.when(a.isNotNull(), G.rect(*[F.get(a, k) for k in range(4)]))


def _each(pages: DataFrame, part: str, name: str) -> DataFrame:
    return pages.select("doc_id", "page_no", F.posexplode(f"page.{part}").alias(name, "x"))


def tables(pages: DataFrame) -> dict[str, DataFrame]:
    """Pages (doc_id, page_no, page) as the engine's tables: pages, lines, images, drawings, tables, cells."""
    lines = pages.select("doc_id", "page_no", F.flatten(F.transform(F.filter("page.blocks", lambda b: b["type"] == 0), lambda b: b["lines"])).alias("ls"))
    lines = lines.select("doc_id", "page_no", F.posexplode("ls").alias("line_no", "x")).where(F.size("x.spans") > 0)
    places = F.flatten(F.transform(F.filter("page.images", lambda i: i["rects"].isNotNull()), lambda i: i["rects"]))
    images = pages.select("doc_id", "page_no", F.posexplode(places).alias("image_no", "r"))
    found = _each(pages, "tables", "table_no")
    cells = found.select("doc_id", "page_no", "table_no", F.posexplode("x.cells").alias("row_idx", "row"), "x.texts")
    cells = cells.select("doc_id", "page_no", "table_no", "row_idx", F.posexplode("row").alias("col_idx", "box"), "texts")
    return {
        "pages": pages.select("doc_id", "page_no", _rect(F.col("page.rect")).alias("rect"), F.coalesce("page.rotation", F.lit(0)).alias("rotation")),
        "lines": lines.select("doc_id", "page_no", "line_no", _rect(F.col("x.bbox")).alias("bbox"), "x.spans"),
        "images": images.select("doc_id", "page_no", "image_no", _rect(F.col("r")).alias("rect")),
        "drawings": _each(pages, "drawings", "drawing_no").select("doc_id", "page_no", "drawing_no", _rect(F.col("x.rect")).alias("rect"), "x.fill", "x.color"),
        "tables": found.select("doc_id", "page_no", "table_no", _rect(F.col("x.bbox")).alias("rect"), F.col("x.row_count").alias("n_rows"), F.col("x.col_count").alias("n_cols")),
        "cells": cells.select("doc_id", "page_no", "table_no", "row_idx", "col_idx", _rect(F.col("box")).alias("bbox"), F.get(F.get("texts", F.col("row_idx")), F.col("col_idx")).alias("text")),
    }
