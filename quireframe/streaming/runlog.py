"""What a run log says over time, as batches or streams: sessions of work on a file, and attempts with what came of them.

In streams both follow the rows' own times. Lines may be late by as much as `late`; later ones are dropped, and what was kept for a file goes
when no line can change it any more. A batch has no late lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

GAP, LATE, WITHIN = "30 minutes", "10 minutes", "15 minutes"


def sessions(lines: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Lines (path, ts, kind) to sessions: stretches of lines on one file that are no more than `gap` apart, with their first and last line and how
    many lines, warnings and errors there were."""
    n = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    s = lines.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "path")
    return s.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("lines"), n("warning", "warnings"), n("error", "errors")).drop("w")


def outcomes(attempts: DataFrame, results: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """Attempts (path, ts, attempt) with each result (path, ts, outcome) of their file that came after them and within that time; an attempt that
    nothing came of stands alone, in a stream as soon as nothing can come of it any more."""
    a = attempts.select("path", F.col("ts").alias("started"), "attempt").withWatermark("started", late)
    r = results.select(F.col("path").alias("of"), F.col("ts").alias("ended"), "outcome").withWatermark("ended", late)
    near = F.expr(f"of = path AND ended >= started AND ended <= started + INTERVAL {within}")
    return a.join(r, near, "left_outer").drop("of")
