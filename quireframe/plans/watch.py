"""One pass over a drop folder: what is new is worked on, and the state, the results and the retries of the next pass follow."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest
from ..sources import store

#: Files (file_key, path, output) to what came of them: file_key, outcome (success, error, unsupported) and message.
Work = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pass:
    state: DataFrame
    results: DataFrame
    retries: DataFrame


def plan(files: DataFrame, state: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Pending files with what to do: done where the output is there already, copying where the gate has not passed them, else work."""
    todo = ingest.pending(files, state).withColumn("output", ingest.output_path(F.col("path")))
    there = files.select(F.col("path").alias("out")).distinct()
    todo = todo.join(there, F.col("output") == F.col("out"), "left")
    passed = F.lit(True)
    if verdicts is not None:
        todo = todo.join(verdicts.select("path", "verdict"), "path", "left")
        passed = F.coalesce(F.col("verdict") == "stable", F.lit(False))
    what = F.when(F.col("out").isNotNull(), "done").when(~passed, "copying").otherwise("work")
    return todo.select("file_key", "path", "output", what.alias("action"))


def run(todo: DataFrame, state: DataFrame, came: DataFrame, now: str) -> Pass:
    """What follows from a plan, the state before it (file_key, status, attempts, error) and what came of the files worked on; those being
    copied burn no attempt and ask for a retry."""
    at = F.lit(now).cast("timestamp")
    old = state.select("file_key", F.col("attempts").alias("before"))
    met = todo.join(came.select("file_key", "outcome", "message"), "file_key", "left").join(old, "file_key", "left")
    ok = (F.col("action") == "done") | (F.coalesce("outcome", F.lit("")) == "success")
    tries = F.coalesce("before", F.lit(0)) + F.coalesce((F.col("outcome") == "error").cast("int"), F.lit(0))
    status = F.when(ok, "done").when((F.col("outcome") == "unsupported") | (tries >= ingest.MOST_ATTEMPTS), "failed").otherwise("pending")
    counted = F.when(ok | (F.col("outcome") == "unsupported"), 0).otherwise(tries)
    fresh = met.where("action = 'done' or outcome is not null")
    fresh = fresh.select("file_key", status.alias("status"), counted.cast("int").alias("attempts"), F.when(~ok, F.col("message")).alias("error"))
    kept = state.select("file_key", "status", "attempts", "error").join(fresh.select("file_key"), "file_key", "left_anti")
    said = F.when(F.col("outcome") == "success", "ok").otherwise(F.concat_ws(": ", "outcome", "message"))
    out = F.when(F.col("outcome") == "success", F.col("output")).otherwise("")
    results = met.where("outcome is not null").select(at.alias("ts"), F.col("path").alias("input"), out.alias("output"), said.alias("status"))
    return Pass(kept.unionByName(fresh), results, ingest.retry_marks(todo.where("action = 'copying'").select("file_key", at.alias("ts"))))


class Busy(RuntimeError):
    """Another pass holds the folder."""


@contextlib.contextmanager
def lock(spark: SparkSession, path: str) -> Iterator[None]:
    """One pass at a time: a lock file that only one can create. It goes with the driver's JVM, should the pass not end."""
    fs, at = store.folder(spark, f"{path}/_lock")
    if not fs.createNewFile(at):
        raise Busy(path)
    fs.deleteOnExit(at)
    try:
        yield
    finally:
        fs.delete(at, False)


def remove_parts(spark: SparkSession, path: str, suffix: str = ".part") -> int:
    """Deletes half-written files that a killed run left below a folder; for a pass that holds the lock."""
    fs, at = store.folder(spark, path)
    found, gone = fs.listFiles(at, True), 0
    while found.hasNext():
        f = found.next().getPath()
        if f.getName().endswith(suffix):
            gone += fs.delete(f, False)
    return gone


def look(spark: SparkSession, files: DataFrame, log_path: str, now: str) -> DataFrame:
    """Verdicts on the files of a listing, from this sight of them and those of earlier passes. Sights are kept in a table; those before a
    file was given up count no more once its retry is due, and until then it is left alone."""
    at = F.lit(now).cast("timestamp")
    path = f"{log_path}/sights"
    files.select("path", at.alias("ts"), "length", F.col("modificationTime").alias("modified")).write.mode("append").parquet(path)
    seen = spark.read.schema(SIGHTS).parquet(path)
    marks = spark.read.schema(MARKS).parquet(f"{log_path}/marks") if store.exists(spark, f"{log_path}/marks") else spark.createDataFrame([], MARKS)
    last = marks.groupBy("path").agg(F.max("due").alias("due"))
    fresh = seen.join(files.select("path"), "path", "left_semi").join(last, "path", "left").where("due is null or ts >= due").drop("due")
    verdicts = store.written(ingest.gate(fresh), "verdicts")
    gone = verdicts.where("verdict in ('slow', 'empty')").select("path", F.col("known_at").alias("ts"), (at + F.make_dt_interval(secs=F.lit(ingest.RETRY_DELAY_S))).alias("due"))
    gone.write.mode("append").parquet(f"{log_path}/marks")
    return verdicts


SIGHTS = "path string, ts timestamp, length bigint, modified timestamp"
MARKS = "path string, ts timestamp, due timestamp"


def folder(spark: SparkSession, path: str, state_path: str, log_path: str, work: Work, now: str, version: int, suffix: str = "pdf") -> Pass:
    """A pass over a folder with its state and its logs in files: only files that the gate has passed are worked on. What came of the
    work is written first, so it is done once."""
    with lock(spark, log_path):
        remove_parts(spark, path)
        state = ingest.load_state(spark, state_path)
        files = store.written(ingest.list_files(spark, path, suffix), "listing")
        todo = plan(files, state, look(spark, ingest.pending(files, state), log_path, now))
        outcomes = f"{log_path}/outcomes/version={version}"
        new = todo.where("action = 'work'").select("file_key", "path", "output")
        none = F.lit(None).cast("string")
        came = new.select("file_key", none.alias("outcome"), none.alias("message")).where("false") if new.isEmpty() else work(new)
        came.select("file_key", "outcome", "message").write.mode("overwrite").parquet(outcomes)
        done = run(todo, state, spark.read.parquet(outcomes), now)
        ingest.save_state(spark, done.state, state_path, version)
        ingest.log_result(done.results, f"{log_path}/results")
        return done
