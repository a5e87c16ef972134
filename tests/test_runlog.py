"""Run logs as streams, with late lines; sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from quireframe.plans import sketches
from quireframe.schema import LINES
from quireframe.streaming import runlog

LOG = "path string, ts double, kind string"


def batches(spark, path, parts, schema):
    """A stream that meets the parts one after another, each as a file."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{path}/{k:03}")
    return spark.readStream.schema(schema.replace("ts double", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drained(spark, df, out):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out)
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(out)


def second(c):
    return F.unix_seconds(c)


def test_sessions_with_late_lines(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    parts = [
        [("a", 0.0, "start"), ("a", 100.0, "warning"), ("b", 50.0, "error")],
        [("a", 1000.0, "start"), ("b", 1900.0, "start")],
        [("a", 950.0, "error"), ("a", 1300.0, "done")],  # late by less than the watermark
        [("a", 10.0, "error"), ("c", 5000.0, "start")],  # late by more: dropped
        [("end", 99_999.0, "done")],
        [("end", 999_999.0, "done")],
    ]
    got = drained(spark, runlog.sessions(batches(spark, str(tmp_path / "in"), parts, LOG), "400 seconds", "1000 seconds"), str(tmp_path / "out"))
    cols = ["path", second("first").alias("first"), second("last").alias("last"), "lines", "warnings", "errors"]
    kept = [r for p in parts for r in p if r != ("a", 10.0, "error")]
    every = runlog.sessions(spark.createDataFrame(kept, LOG).withColumn("ts", F.timestamp_seconds("ts")), "400 seconds")
    wanted = sorted(tuple(r) for r in every.select(*cols).collect() if r.path != "end")
    assert sorted(tuple(r) for r in got.select(*cols).collect() if r.path != "end") == wanted
    assert wanted[:2] == [("a", 0, 100, 2, 1, 0), ("a", 950, 1300, 3, 0, 1)] and len(wanted) == 5
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_attempts_and_results_of_two_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    starts, ends = "path string, ts double, attempt int", "path string, ts double, outcome string"
    a = [[("a", 1.0, 1), ("b", 10.0, 1)], [("a", 600.0, 2), ("c", 700.0, 1)], [("z", 50_000.0, 1)], [("z", 500_000.0, 1)]]
    r = [[("a", 30.0, "error")], [("a", 610.0, "success"), ("b", 900.0, "error")], [("z", 50_000.0, "ok")], [("z", 500_000.0, "ok")]]
    got = drained(spark, runlog.outcomes(batches(spark, str(tmp_path / "a"), a, starts), batches(spark, str(tmp_path / "r"), r, ends), "5 minutes", "1000 seconds"), str(tmp_path / "out"))
    flat = lambda parts, schema: spark.createDataFrame([x for p in parts for x in p], schema).withColumn("ts", F.timestamp_seconds("ts"))
    cols = ["path", second("started").alias("s"), "attempt", second("ended").alias("e"), "outcome"]
    wanted = sorted((tuple(x) for x in runlog.outcomes(flat(a, starts), flat(r, ends), "5 minutes").select(*cols).collect() if x.path != "z"), key=str)
    assert sorted((tuple(x) for x in got.select(*cols).collect() if x.path != "z"), key=str) == wanted
    assert wanted == sorted([("a", 1, 1, 30, "error"), ("a", 600, 2, 610, "success"), ("b", 10, 1, None, None), ("c", 700, 1, None, None)], key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sketches_put_together_against_exact_figures(spark, tmp_path):
    rnd = random.Random(14)
    rows = [(d, 0, k, (0.0, rnd.uniform(0, 800), 10.0, 900.0), [("x" * rnd.randint(1, 300) + str(rnd.randint(0, 20_000)), 9.0, "f", 0)]) for d in range(20) for k in range(600)]
    lines = spark.createDataFrame(rows, LINES)
    sketches.sketched(lines).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    for some in (range(20), range(3, 9), [4]):
        r = sketches.figures(sketches.united(stored.where(F.col("doc_id").isin(list(some))))).first()
        own = [(x[4][0][0], x[3][1]) for x in rows if x[0] in some]
        assert r.lines == len(own) and abs(r.different - len({t for t, _ in own})) <= 0.06 * len({t for t, _ in own})
        for got, values in ((r.letters, [len(t) for t, _ in own]), (r.tops, [y for _, y in own])):
            for q, v in zip(sketches.SHARES, got, strict=True):
                rank = sum(x <= v for x in values) / len(values)
                below = sum(x < v for x in values) / len(values)
                assert below - 0.04 <= q <= rank + 0.04
    whole = sketches.figures(sketches.sketched(lines, [])).first()
    assert whole.different == pytest.approx(sketches.figures(sketches.united(stored)).first().different, rel=0.02) and whole.lines == 12_000
    none = sketches.figures(sketches.united(sketches.sketched(lines.where("false")))).first()
    assert none.lines is None or none.lines == 0
