"""python -m quireframe check|translate|overlay|watch IN OUT: layout tables, or page dictionaries as JSON lines, to result tables; or a folder
whose new documents are worked on, pass after pass."""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import grids, ingest, translate as T
from .plans import documents, page_stats as S, pages as W, watch
from .sources import decode, files, store


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quireframe")
    p.add_argument("command", choices=("check", "translate", "overlay", "watch"))
    p.add_argument("source", help="a folder with parquet tables, or with .jsonl files of page dictionaries")
    p.add_argument("target", help="a folder for the result tables; of watch, for its state and logs")
    p.add_argument("--pages", help="as 1-3,7; of every document")
    p.add_argument("--reformat-only", action="store_true", help="flow and fit the texts as they are")
    p.add_argument("--temp", type=float, default=0.0)
    p.add_argument("--seed", type=int, default=0, help="of the model")
    p.add_argument("--model", help="module:function of a loader of models, called with the seed; without it texts stay as they are, or go by the glossary")
    p.add_argument("--glossary", help="a JSON file of words and their translations")
    p.add_argument("--no-tables", action="store_true")
    p.add_argument("--table-strategy", choices=("given", *grids.STRATEGIES), default="given", help="tables as they are given, or found by their drawn lines")
    p.add_argument("--force", action="store_true", help="does nothing, for callers that still give it")
    p.add_argument("--interval", type=float, default=10.0, help="seconds between two passes of watch")
    p.add_argument("--passes", type=int, default=0, help="of watch; without it there is no end")
    return p


def backend_of(o: argparse.Namespace) -> T.Backend:
    if o.model:
        module, _, name = o.model.partition(":")
        return T.seeded(getattr(importlib.import_module(module), name), o.seed)
    if o.glossary:
        with open(o.glossary, encoding="utf-8") as f:
            return T.glossary(json.load(f))
    return T.identity


def tables(spark: SparkSession, source: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Layout tables, the documents (doc_id, path, title, needs_pass), and those that could not be decoded (path, message)."""
    none = F.lit(None).cast("string")
    if store.exists(spark, f"{source}/lines.parquet"):
        t = {name: spark.read.parquet(f"{source}/{name}.parquet") for name in ("pages", "lines", "images", "drawings", "tables", "cells")}
        docs = t["pages"].select("doc_id").distinct().select("doc_id", F.col("doc_id").cast("string").alias("path"), none.alias("title"), F.lit(False).alias("needs_pass"))
        return t, docs, docs.where("false").select("path", none.alias("message"))
    read = store.written(files.read(spark, source).withColumn("page", F.from_json("page", decode.PAGE_DICT)), "decoded")
    pages = read.where("error is null").select(F.xxhash64("path").alias("doc_id"), "path", "page_no", "page")
    docs = pages.select("doc_id", "path").distinct().select("doc_id", "path", none.alias("title"), F.lit(False).alias("needs_pass"))
    return decode.tables(pages.select("doc_id", "page_no", "page")), docs, read.where("error is not null").select("path", F.col("error").alias("message"))


def watched(o: argparse.Namespace, spark: SparkSession) -> None:
    """Passes over a folder; each has the next number and goes on where the one before it ended."""
    strategy = None if o.table_strategy == "given" else o.table_strategy
    work = documents.work(o.source, backend_of(o), temperature=o.temp, strategy=strategy, log_path=o.target)
    n = 0
    while True:
        version = 1 + max((v for v in map(ingest.version_of, store.children(spark, f"{o.target}/state")) if v is not None), default=0)
        done = watch.folder(spark, o.source, f"{o.target}/state", o.target, work, time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()), version, "jsonl")
        print(f"pass {version}: {done.results.count()} file(s)")
        n += 1
        if n == o.passes:
            return
        time.sleep(o.interval)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = options().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quireframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "watch":
        return watched(o, spark)
    t, docs, bad = tables(spark, o.source)
    out = {"undecoded": bad}
    if o.pages:
        wanted, out["page_warnings"] = ingest.chosen_pages(t["pages"].select("doc_id", "page_no"), o.pages)
        wanted = store.written(wanted, "wanted")
        if wanted.isEmpty():
            raise ValueError(f"no pages in {o.pages!r}")
        t = {k: d.join(wanted, ["doc_id", "page_no"], "left_semi") for k, d in t.items()}
    if o.table_strategy != "given":
        t = documents.with_grids(t, o.table_strategy)
    if o.command == "translate":
        done = W.run(docs, t, backend_of(o), o.temp, o.reformat_only, use_tables=not o.no_tables)
        out |= {"placements": done.translation.placements, "redactions": done.translation.redactions, "events": done.translation.events, "outcomes": done.outcomes, "titles": done.titles}
    else:
        a = W.analyze(t["lines"], t["pages"], t["drawings"], t["images"], None if o.no_tables else t["tables"])
        out |= {"report": W.report(a)} if o.command == "check" else {"overlay": S.overlay(a)}
    for name, d in out.items():
        d.write.mode("overwrite").parquet(f"{o.target}/{name}")


if __name__ == "__main__":
    main()
