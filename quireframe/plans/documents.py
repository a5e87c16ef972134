"""Files of a folder to documents beside them: what a pass of the watcher works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import grids, measure as M, translate as T
from ..schema import PAGE
from ..sources import decode, files, store
from . import pages as W, watch


def outputs(done: W.Run, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents as they are written (path, page_no, page): each page's rectangle, what is put on it in order, what is erased before, and the title."""
    put = F.struct("region_no", "para", "col_idx", "kind", "text", "rect", "size", "pinned")
    texts = done.translation.placements.groupBy(*PAGE).agg(F.sort_array(F.collect_list(put)).alias("placements"))  # a page's
    gone = done.translation.redactions.groupBy(*PAGE).agg(F.sort_array(F.collect_list("rect")).alias("redactions"))
    d = pages.select(*PAGE, "rect").join(docs.select("doc_id", "output"), "doc_id").join(done.titles.select("doc_id", "title"), "doc_id")
    d = d.join(texts, PAGE, "left").join(gone, PAGE, "left")
    return d.select(F.col("output").alias("path"), "page_no", F.to_json(F.struct("title", "rect", "placements", "redactions")).alias("page"))


def with_grids(tables: dict[str, DataFrame], strategy: str) -> dict[str, DataFrame]:
    """Layout tables whose tables are those found by their drawn lines."""
    found, cells = grids.find_tables(tables["drawings"], tables["lines"], strategy)
    return tables | {"tables": store.written(found, "found-tables"), "cells": store.written(cells, "found-cells")}


def work(
    folder: str, backend: T.Backend = T.identity, decoder: decode.Decoder = decode.from_json_lines, temperature: float = 0.0, measurer: M.Measurer | None = None, strategy: str | None = None, log_path: str | None = None
) -> watch.Work:
    """What a pass does with its files: each is decoded and worked on, its document published beside it; a file that cannot be decoded is an
    error, one that cannot be worked on is unsupported. What is said goes to log_path."""

    def run(todo: DataFrame) -> DataFrame:
        named = store.written(todo.select("file_key", "path", "output", F.xxhash64("path").alias("doc_id")), "files")
        read = store.written(files.pages_of(named, decoder).withColumn("page", F.from_json("page", decode.PAGE_DICT)), "decoded")
        bad = read.where("error is not null").select("path", F.col("error").alias("message"))
        failed = bad.join(named, "path").select("file_key", F.lit("error").alias("outcome"), "message")
        good = named.join(bad.select("path"), "path", "left_anti")
        if good.isEmpty():
            return failed
        tables = decode.tables(read.where("error is null").join(good.select("path", "doc_id"), "path").select("doc_id", "page_no", "page"))
        if strategy is not None:
            tables = with_grids(tables, strategy)
        none = F.lit(None).cast("string")
        done = W.run(good.select("doc_id", "path", none.alias("title"), F.lit(False).alias("needs_pass")), tables, backend, temperature, measurer=measurer)
        files.write(outputs(done, good, tables["pages"]), folder)
        if log_path is not None:
            done.translation.events.write.mode("append").parquet(f"{log_path}/events")
        ok = done.outcomes.join(good.select("doc_id", "file_key"), "doc_id").select("file_key", "outcome", "message")
        return ok.unionByName(failed)

    return run
