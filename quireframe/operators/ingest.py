"""Incremental file intake: listing, keys, what is pending, the attempts of each file, run logs."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schema import FILE_STATE
from ..sources import store

# Fixed values of the intake.
MOST_ATTEMPTS, RETRY_DELAY_S, STALE_S, SUFFIX = 3, 150, 450, "_en"
CHARS_A_PAGE = 50
CHECKS, EMPTY_S, MOST_S, LOG_BYTES = 2, 5.0, 120.0, 5 << 20


def file_key(path: Column, length: Column, modified: Column) -> Column:
    return F.concat_ws(":", path, length.cast("string"), F.unix_seconds(modified).cast("string"))


def is_output(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")).endswith(SUFFIX)


def output_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]+)$", f"{SUFFIX}$1")


def list_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """All files of a kind below a folder, however their suffix is written, with their keys; contents are not read. Empty files are not
    there, as Spark's file sources pass over them: they are seen as soon as they have bytes."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime").where(F.lower("path").endswith(f".{suffix.lower()}")).withColumn("file_key", file_key(F.col("path"), F.col("length"), F.col("modificationTime")))


def pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are no output and neither done nor failed."""
    over = state.where("status in ('done', 'failed')").select("file_key")
    return files.where(~is_output(F.col("path"))).join(over, "file_key", "left_anti")


def already_there(files: DataFrame) -> DataFrame:
    """Files whose output is in the listing."""
    outs = files.select(F.col("path").alias("out"))
    return files.join(outs, output_path(F.col("path")) == F.col("out"), "left_semi")


def fold_attempts(events: DataFrame, key: str = "file_key", order: list[str] | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """State of each file after its attempts: outcome is success, error, unsupported or copying.

    Success ends a file as done and unsupported as failed; the `most`-th error in a row fails it; copying counts for nothing.
    An end is final until a new key comes. Expressed with windows: an attempt counts while no end is before it.
    """
    w = Window.partitionBy(key).orderBy(*(order or ["ts"]))
    e = events.where("outcome <> 'copying'").withColumn("errors", F.sum((F.col("outcome") == "error").cast("int")).over(w))
    ends = F.col("outcome").isin("success", "unsupported") | ((F.col("outcome") == "error") & (F.col("errors") >= most))
    e = e.withColumn("ends", ends.cast("int")).withColumn("ended", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = e.where("ended = 0")
    done = F.max((F.col("outcome") == "success").cast("int")) == 1
    failed = F.max("ends") == 1
    return live.groupBy(key).agg(
        F.when(done, "done").when(failed, "failed").otherwise("pending").alias("status"), F.when(done, 0).otherwise(F.max("errors")).cast("int").alias("attempts")
    )


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def gate(observations: DataFrame, key: str = "path", checks: int = CHECKS, interval_s: float = 1.0, empty_s: float = EMPTY_S, most_s: float = MOST_S) -> DataFrame:
    """Of files seen again and again (ts, length, modified): whether they may be opened, and when that was known.

    A file that is not empty when first seen and was last written more than checks * interval before is stable at once. Else it is stable
    at the `checks`-th sight in a row of one size that is not zero. It is given up as empty when it has been empty for empty_s
    seconds, and as too slow most_s seconds after the first sight; whichever comes first. Otherwise it is waiting.
    """
    seen, so_far = Window.partitionBy(key).orderBy("ts", "length"), Window.partitionBy(key)
    s = _seconds
    same = F.coalesce((F.col("length") == F.lag("length").over(seen)) & (F.col("length") > 0), F.lit(False))
    o = observations.select(key, "ts", "length", (s(F.col("ts")) - s(F.col("modified")) > checks * interval_s).alias("old"))
    o = o.withColumn("nth", F.row_number().over(seen)).withColumn("same", same.cast("int")).withColumn("start", F.min(s(F.col("ts"))).over(so_far))
    o = o.withColumn("runs", F.sum(1 - F.col("same")).over(seen)).withColumn("fills", F.sum((F.col("length") > 0).cast("int")).over(seen))
    o = o.withColumn("again", F.sum("same").over(Window.partitionBy(key, "runs").orderBy("ts", "length")))
    since = F.min(F.when(F.col("length") == 0, s(F.col("ts")))).over(Window.partitionBy(key, "fills"))
    now = s(F.col("ts"))
    verdict = F.when((F.col("nth") == 1) & F.col("old") & (F.col("length") > 0), "stable").when(now - F.col("start") >= most_s, "slow").when((F.col("length") == 0) & (now - since >= empty_s), "empty")
    o = o.withColumn("verdict", verdict.when(F.col("again") >= checks, "stable"))
    first = F.min(F.when(F.col("verdict").isNotNull(), F.struct("nth", "verdict", "ts")))
    return o.groupBy(key).agg(first.alias("f")).select(key, F.coalesce("f.verdict", F.lit("waiting")).alias("verdict"), F.col("f.ts").alias("known_at"))


def retry_marks(failures: DataFrame, key: str = "file_key", stale_s: int = STALE_S, delay_s: int = RETRY_DELAY_S) -> DataFrame:
    """Retries that get scheduled: one at a time, since a mark keeps others away until it is stale. A key's times are folded in order."""
    times = failures.groupBy(key).agg(F.sort_array(F.collect_list("ts")).alias("at"))  # a key's failures
    none = F.array().cast(f"array<{dict(failures.dtypes)['ts']}>")
    late = lambda kept, t: _seconds(t) - _seconds(F.element_at(kept, -1)) >= stale_s
    kept = F.aggregate("at", none, lambda a, t: F.when(F.size(a) == 0, F.array(t)).when(late(a, t), F.array_append(a, t)).otherwise(a))
    d = times.select(key, F.explode(kept).alias("ts"))
    return d.select(key, "ts", (F.col("ts") + F.make_dt_interval(secs=F.lit(delay_s))).alias("due"))


def progress_lines(events: DataFrame) -> DataFrame:
    """Events (ts, message) as lines `[HH:MM:SS] message`."""
    return events.select("ts", F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), "message").alias("value"))


def rotated(lines: DataFrame, col: str = "value", most: int = LOG_BYTES) -> DataFrame:
    """The progress log as a run finds it: emptied if it has passed its size, line ends counted."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length(col) + 1), F.lit(0)).alias("bytes"))  # one row
    return lines.join(F.broadcast(size.where(F.col("bytes") <= most)), how="cross").drop("bytes")


def preflight(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document (page rows with text and needs_pass): unsupported, warn or ok."""
    from ..functions import text as X

    g = pages.groupBy(key).agg(F.max("needs_pass").alias("locked"), F.count("page_no").alias("n_pages"), F.sum(F.length(X.strip(F.coalesce("text", F.lit(""))))).alias("n_chars"))
    verdict = F.when(F.col("locked") | (F.col("n_pages") == 0) | (F.col("n_chars") == 0), "unsupported").when(F.col("n_chars") < CHARS_A_PAGE * F.col("n_pages"), "warn").otherwise("ok")
    return g.select(key, "n_pages", "n_chars", verdict.alias("verdict"))


def preflight_message() -> Column:
    """What is said of a checked document (path, needs_pass, n_pages, n_chars, verdict); null where all is well."""
    few = F.concat(F.lit("WARNING: "), "path", F.lit(" has very little extractable text ("), F.col("n_chars").cast("string"), F.lit(" chars across "), F.col("n_pages").cast("string"), F.lit(" page(s)); output may be near-empty"))
    why = F.when(F.col("needs_pass"), " is password-protected; decrypt it first").when(F.col("n_pages") == 0, " has no pages").otherwise(" has no extractable text (image-only scan?) -- run OCR (e.g. ocrmypdf) first")
    return F.when(F.col("verdict") == "unsupported", F.concat("path", why)).when(F.col("verdict") == "warn", few)


# Fixed value: a part of a page range.
RANGE_PART = r"(\d+)(?:\s*-\s*(\d+))?"


def page_parts(spec: str) -> list[tuple[str, int, int]]:
    """The parts of a comma list of numbers and ranges from 1, with their first and last page; empty parts are passed over."""
    parts = []
    for part in filter(None, map(str.strip, spec.split(","))):
        m = re.fullmatch(RANGE_PART, part)
        a, b = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if a < 1 or b < a:
            raise ValueError(f"not a page range: {part!r}")
        parts.append((part, a, b))
    return parts


def page_range(spec: str | None, n_pages: int) -> tuple[list[int], list[str]]:
    """Pages, from 0, that a spec names in a document of n_pages; and what is said about parts without pages."""
    if not spec:
        return list(range(n_pages)), []
    parts = page_parts(spec)
    pages = sorted({p for _, a, b in parts for p in range(a - 1, min(b, n_pages))})
    if not pages:
        raise ValueError(f"no pages in {spec!r}")
    return pages, [f"no pages in {part}" for part, a, _ in parts if a > n_pages]


def chosen_pages(pages: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """Of each document (doc_id, page_no), the pages that a spec names; and (doc_id, message) of parts that name none of its pages."""
    parts = page_parts(spec)
    inside = reduce(lambda x, y: x | y, [F.col("page_no").between(a - 1, b - 1) for _, a, b in parts], F.lit(False))
    n = pages.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n"))
    said = F.array(*[F.when(F.col("n") < a, F.lit(f"no pages in {part}")) for part, a, _ in parts], F.lit(None).cast("string"))
    return pages.where(inside), n.select("doc_id", F.explode(F.array_compact(said)).alias("message"))


# Kinds of log lines, first match wins.
LOG_KINDS = [("warning", "WARNING"), ("overflow", "OVERFLOW"), ("rescaled", "rescaled"), ("skipped", "skipped"), ("translated", "translated"), ("page", "^[Pp]age "), ("start", "^[Ss]tart"), ("done", "^[Dd]one")]


def parse_log(rows: DataFrame, col: str = "value") -> DataFrame:
    """Lines `[HH:MM:SS] message` with their seconds of the day and kind."""
    at = lambda k: F.try_to_number(F.regexp_extract(col, r"^\[(\d\d):(\d\d):(\d\d)\] ", k), F.lit("99")).cast("int")
    message = F.regexp_extract(col, r"^\[\d\d:\d\d:\d\d\] (.*)$", 1)
    kind = F.lit("other")
    for name, pattern in reversed(LOG_KINDS):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    return rows.where(F.col(col).rlike(r"^\[\d\d:\d\d:\d\d\] ")).select((at(1) * 3600 + at(2) * 60 + at(3)).alias("second"), message.alias("message"), kind.alias("kind"))


def log_result(rows: DataFrame, path: str) -> None:
    """Appends results as CSV, status on one line."""
    flat = F.trim(F.regexp_replace("status", r"\s+", " "))
    rows.withColumn("status", flat).select("ts", "input", "output", "status").write.mode("append").option("header", True).csv(path)


def save_state(spark: SparkSession, state: DataFrame, path: str, version: int) -> None:
    """A version of the state as a folder of its own, which readers see when it is whole."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of the state that can be read whole; nothing where there is none. Columns that an older version lacks are empty."""
    for version in sorted((v for v in map(version_of, store.children(spark, path)) if v is not None), reverse=True):
        state = spark.read.schema(FILE_STATE).parquet(f"{path}/version={version}").fillna("pending", ["status"]).fillna(0, ["attempts"])
        try:
            state.write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError):  # half written, or no state at all
            continue
        return state
    return spark.createDataFrame([], FILE_STATE)


def version_of(name: str) -> int | None:
    """The number of a version, from its folder's name."""
    m = re.fullmatch(r"version=(\d+)", name)
    return int(m[1]) if m else None
