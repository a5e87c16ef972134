"""A drop folder as a stream: sights of files and what came of work on them go in, what is to be done comes out, and timers do the rest.

Each file is a key with its state: seen (the gate watches its size), working, resting (given up for now, until its retry is due), done or
failed. The gate's limits and the retries are timers, so they fire without a further sight. Sights and outcomes are files in a folder each,
which a file source reads, so a run that is killed between two batches goes on where its checkpoint stands. The same rules as in
`operators.ingest.gate` and `fold_attempts` hold; a file that was replaced (size or time differs) begins anew, whatever its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.ingest import CHECKS, EMPTY_S, MOST_ATTEMPTS, MOST_S, RETRY_DELAY_S

SIGHTS = "path string, ts timestamp, length bigint, modified timestamp"
OUTCOMES = "path string, ts timestamp, file_key string, outcome string, message string"
#: What is to be done or known: work, empty, slow, retry (it is looked at again), done, failed, pending (an attempt failed, others are left).
ACTIONS = "path string, file_key string, ts timestamp, action string, attempts int, due timestamp"
_STATE = "status string, file_key string, attempts int, first double, last bigint, again int, empty double, due double"
_NEW = {"status": "seen", "file_key": None, "attempts": 0, "first": None, "last": None, "again": 0, "empty": None, "due": None}


def _second(ts: datetime) -> float:
    return ts.timestamp()


def _ts(second: float | None) -> datetime | None:
    return None if second is None else datetime.fromtimestamp(second, timezone.utc)


class Intake(StatefulProcessor):
    """The states of files, keyed by path."""

    def __init__(self, checks: int = CHECKS, interval_s: float = 1.0, empty_s: float = EMPTY_S, most_s: float = MOST_S, delay_s: float = RETRY_DELAY_S, most: int = MOST_ATTEMPTS, ttl_ms: int | None = None):
        self.checks, self.old_s, self.empty_s, self.most_s, self.delay_s, self.most, self.ttl_ms = checks, checks * interval_s, empty_s, most_s, delay_s, most, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _STATE, self.ttl_ms)

    def _at(self, second: float) -> None:
        self.handle.registerTimer(int(second * 1000))

    def _given_up(self, path: str, s: dict, verdict: str, now: float) -> Row:
        s.update(status="resting", due=now + self.delay_s)
        self._at(s["due"])
        return Row(path=path, file_key=s["file_key"], ts=_ts(now), action=verdict, attempts=s["attempts"], due=_ts(s["due"]))

    def _late(self, s: dict, now: float) -> str | None:
        if s["first"] is None:
            return None
        if now - s["first"] >= self.most_s:
            return "slow"
        return "empty" if s["empty"] is not None and now - s["empty"] >= self.empty_s else None

    def _seen(self, path: str, s: dict, r: Row) -> Row | None:
        now, n, modified = _second(r.ts), r.length, _second(r.modified)
        key = f"{path}:{n}:{int(modified)}"
        if s["status"] != "seen" and (s["status"] == "resting" or s["file_key"] == key):
            return None
        if s["status"] != "seen":  # replaced
            s.update(_NEW)
        s["file_key"] = key
        stable = False
        if s["first"] is None:
            s.update(first=now, again=0)
            stable = n > 0 and now - modified > self.old_s
            self._at(now + self.most_s)
        elif (late := self._late({**s, "empty": s["empty"] if n == 0 else None}, now)) is not None:
            s["last"] = n
            return self._given_up(path, s, late, now)
        else:
            s["again"] = s["again"] + 1 if n > 0 and n == s["last"] else 0
            stable = s["again"] >= self.checks
        if n == 0 and s["empty"] is None:
            s["empty"] = now
            self._at(now + self.empty_s)
        elif n > 0:
            s["empty"] = None
        s["last"] = n
        if not stable:
            return None
        s.update(status="working", first=None, empty=None)
        return Row(path=path, file_key=key, ts=_ts(now), action="work", attempts=s["attempts"], due=None)

    def _came(self, path: str, s: dict, r: Row) -> Row | None:
        if s["status"] != "working" or r.file_key != s["file_key"]:
            return None
        s["attempts"] = 0 if r.outcome in ("success", "unsupported") else s["attempts"] + (r.outcome == "error")
        s["status"] = "done" if r.outcome == "success" else "failed" if r.outcome == "unsupported" or s["attempts"] >= self.most else "resting"
        if s["status"] == "resting":
            s["due"] = _second(r.ts) + self.delay_s
            self._at(s["due"])
        action = "pending" if s["status"] == "resting" else s["status"]
        return Row(path=path, file_key=s["file_key"], ts=r.ts, action=action, attempts=s["attempts"], due=_ts(s["due"]) if action == "pending" else None)

    def _load(self) -> dict:
        return dict(zip(_NEW, self.file.get(), strict=True)) if self.file.exists() else dict(_NEW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, path = self._load(), key[0]
        for r in sorted(rows, key=lambda r: (r.ts, r.outcome is not None, r.length or 0)):  # of one file and batch
            out = self._seen(path, s, r) if r.outcome is None else self._came(path, s, r)
            if out is not None:
                yield out
        self.file.update(tuple(s.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, path, now = self._load(), key[0], expiredTimerInfo.getExpiryTimeInMs() / 1000
        if s["status"] == "seen" and (late := self._late(s, now)) is not None:
            yield self._given_up(path, s, late, now)
        elif s["status"] == "resting" and s["due"] is not None and int(s["due"] * 1000) <= int(now * 1000):
            kept = {"file_key": s["file_key"], "attempts": s["attempts"]}
            s.update({**_NEW, **kept})
            yield Row(path=path, file_key=s["file_key"], ts=_ts(now), action="retry", attempts=s["attempts"], due=None)
        else:
            return
        self.file.update(tuple(s.values()))


def actions(sights: DataFrame, outcomes: DataFrame, replay: bool = False, delay: str = "0 seconds", **limits) -> DataFrame:
    """What is to be done, from streams of sights and outcomes. Timers follow the clock, and what is known of a file goes a month after it was last
    seen; in a replay they follow the times of the rows, which may be late by `delay`."""
    none = F.lit(None).cast("string")
    every = sights.select("path", "ts", "length", "modified", none.alias("file_key"), none.alias("outcome"))
    every = every.unionByName(outcomes.select("path", "ts", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified"), "file_key", "outcome"))
    if replay:
        return every.withWatermark("ts", delay).groupBy("path").transformWithState(Intake(**limits), ACTIONS, "append", "eventTime")
    return every.groupBy("path").transformWithState(Intake(ttl_ms=30 * 86_400_000, **limits), ACTIONS, "append", "processingTime")


def sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two streams of a folder: `path/sights` and `path/outcomes`, each with files of rows."""
    return tuple(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/{name}") for name, schema in (("sights", SIGHTS), ("outcomes", OUTCOMES)))
