"""The drop folder as a stream: the gate and retries by timers, against the batch operators, and over a restart."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quireframe.operators import ingest
from quireframe.streaming import watcher as S


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def add(spark, path, name, rows, schema):
    """A file of rows, for a source to find."""
    times = [c for c in ("ts", "modified") if c in schema]
    plain = schema.replace("timestamp", "double")
    df = spark.createDataFrame(rows, plain).withColumns({c: F.timestamp_seconds(c) for c in times})
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def go(spark, path, out, **options):
    """All that is there now, from where the checkpoint stands."""
    sights, outcomes = S.sources(spark, path)
    q = S.actions(sights, outcomes, **options).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/actions")
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return [(r.path, r.action, r.ts.timestamp(), r.attempts, None if r.due is None else r.due.timestamp()) for r in spark.read.schema(S.ACTIONS).parquet(f"{out}/actions").orderBy("ts", "path").collect()]


def test_gate_by_timers_is_the_gate_of_the_batch(spark, tmp_path):
    rnd, rows, path = random.Random(6), [], str(tmp_path)
    for k in range(150):
        t = 1000
        for _ in range(rnd.randint(1, 12)):
            rows.append((f"f{k}", float(t), rnd.choice([0, 0, 5, 5, 9]), float(t - rnd.choice([0, 0, 1, 3]))))
            t += rnd.choice([1, 1, 2, 4, 40])
    add(spark, path, "sights", rows, S.SIGHTS)
    add(spark, path, "sights", [("end", 9000.0, 1, 9000.0)], S.SIGHTS)  # brings the time so far
    add(spark, path, "outcomes", [], S.OUTCOMES)
    seen = spark.read.schema(S.SIGHTS).parquet(f"{path}/sights").where("path <> 'end'")
    wanted = {r.path: (r.verdict, r.known_at.timestamp() if r.known_at else None) for r in ingest.gate(seen).collect()}
    first = {}
    for p, action, ts, _, due in go(spark, path, str(tmp_path / "out"), replay=True):
        if action != "retry":
            first.setdefault(p, (action, ts, due))
    first.pop("end", None)
    for p, (verdict, at) in wanted.items():
        if verdict == "stable":
            assert first[p][:2] == ("work", at)
        elif verdict != "waiting":
            assert first[p] == (verdict, at, at + 150)
        else:  # no sight says more, so its time is up by the clock alone
            assert first[p][0] in ("slow", "empty") and first[p][1] > max(r[1] for r in rows if r[0] == p)
    assert {v for v, _ in wanted.values()} == {"stable", "slow", "empty", "waiting"}


def test_retries_attempts_and_a_restart(spark, tmp_path):
    path, out = str(tmp_path), str(tmp_path / "out")
    key = lambda p, n, m: f"{p}:{n}:{m}"
    sight = lambda *rows: add(spark, path, "sights", [(p, float(t), n, float(m)) for p, t, n, m in rows], S.SIGHTS)
    came = lambda *rows: add(spark, path, "outcomes", [(p, float(t), k, o, "why") for p, t, k, o in rows], S.OUTCOMES)
    sight(("a", 100, 7, 50), ("grows", 100, 5, 100), ("grows", 101, 9, 101), ("void", 100, 0, 100))
    came()
    got = go(spark, path, out, replay=True)
    assert [x[:3] for x in got if x[1] == "work"] == [("a", "work", 100.0)]
    sight(("grows", 102, 9, 101), ("grows", 103, 9, 101), ("other", 120, 1, 120))
    came(("a", 104, key("a", 7, 50), "error"), ("b", 104, "never seen", "success"))
    got = go(spark, path, out, replay=True)  # as after a kill: nothing is done twice
    assert [x[:3] for x in got if x[1] == "work"] == [("a", "work", 100.0), ("grows", "work", 103.0)]
    assert [x for x in got if x[0] == "a"][1] == ("a", "pending", 104.0, 1, 254.0)
    came(("grows", 121, key("grows", 9, 101), "success"))
    sight(("a", 200, 7, 50), ("grows", 200, 9, 101), ("late", 300, 1, 300))  # neither is due
    got = go(spark, path, out, replay=True)
    assert [x[1] for x in got if x[0] == "grows"] == ["work", "done"]
    assert [(x[1], x[2]) for x in got if x[0] == "void"] == [("empty", 105.0), ("retry", 255.0)]
    assert [(x[1], x[2]) for x in got if x[0] == "a"] == [("work", 100.0), ("pending", 104.0), ("retry", 254.0)]
    sight(("a", 310, 7, 50), ("void", 310, 3, 260), ("grows", 310, 12, 305))
    came(("a", 311, key("a", 7, 50), "error"), ("void", 311, key("void", 3, 260), "unsupported"))
    sight(("x", 500, 1, 500))
    got = go(spark, path, out, replay=True)
    assert [(x[1], x[2]) for x in got if x[0] == "void"][2:] == [("work", 310.0), ("failed", 311.0)]
    assert [(x[1], x[3]) for x in got if x[0] == "a"][3:] == [("work", 1), ("pending", 2), ("retry", 2)]
    sight(("a", 510, 7, 50), ("void", 510, 3, 260))
    came(("a", 511, key("a", 7, 50), "error"))
    sight(("a", 512, 7, 50), ("a", 513, 8, 400))  # failed for good, until another file takes its place
    sight(("y", 600, 1, 600))
    got = go(spark, path, out, replay=True)
    assert [(x[1], x[3]) for x in got if x[0] == "a"][6:] == [("work", 2), ("failed", 3), ("work", 0)]
    assert len([x for x in got if x[0] == "void"]) == 4


def test_timers_of_the_clock(spark, tmp_path):
    path, out = str(tmp_path), str(tmp_path / "out")
    now = spark.sql("select unix_millis(current_timestamp()) / 1000d").first()[0]
    add(spark, path, "sights", [("void", now, 0, now), ("old", now, 4, now - 60)], S.SIGHTS)
    add(spark, path, "outcomes", [], S.OUTCOMES)
    sights, outcomes = S.sources(spark, path)
    name = f"t{uuid.uuid4().hex}"
    q = S.actions(sights, outcomes, empty_s=0.5, delay_s=1.0).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{out}/c").trigger(processingTime="1 second").start()
    for _ in range(60):
        got = {(r.path, r.action) for r in spark.table(name).collect()}
        if ("void", "retry") in got or q.exception() is not None:
            break
        q.awaitTermination(1)
    q.stop()
    assert got >= {("old", "work"), ("void", "empty"), ("void", "retry")}
