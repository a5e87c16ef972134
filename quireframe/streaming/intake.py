"""The intake as a stream: attempts arrive, the state of each file follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import MOST_ATTEMPTS

OUTPUT = "file_key string, status string, attempts int"


def step(status: str, attempts: int, outcome: str, most: int = MOST_ATTEMPTS) -> tuple[str, int]:
    """State after one more attempt; done and failed are final."""
    if status != "pending" or outcome == "copying":
        return status, attempts
    if outcome == "success":
        return "done", 0
    attempts += outcome == "error"
    return ("failed" if outcome == "unsupported" or attempts >= most else "pending"), attempts


def attempt_states(attempts: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """A stream of (file_key, ts, outcome) to a stream of file states, one row a file and batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for outcome in rows["outcome"]:
            status, n = step(status, int(n), outcome, most)
        state.update((status, n))
        yield pd.DataFrame({"file_key": [key[0]], "status": [status], "attempts": [n]})

    return attempts.groupBy("file_key").applyInPandasWithState(run, OUTPUT, "status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def retry_marks(failures: DataFrame, delay: str = "150 seconds", stale: str = "450 seconds") -> DataFrame:
    """One outstanding retry a file within the time after which a mark is stale."""
    marks = failures.withWatermark("ts", stale).dropDuplicatesWithinWatermark(["file_key"])
    return marks.withColumn("due", F.col("ts") + F.expr(f"INTERVAL {delay}"))
