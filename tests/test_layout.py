"""Columns, order, obstacles and placement on small pages made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quireframe.operators import ingest, layout as L, paragraphs as P, reflow as R
from quireframe.plans.page_stats import page_stats
from quireframe.schema import LINES, RECT


def page(spark, rows, size=10.0):
    return spark.createDataFrame([(1, 0, k, (x0, y0, x1, y0 + size), [(f"line {k} of text", size, "f", 0)]) for k, (x0, y0, x1) in enumerate(rows)], LINES)


def test_one_and_two_columns(spark):
    assert L.columns(page(spark, [(90.0 if k % 3 == 0 else 72.0, 50.0 + 14 * k, 400.0) for k in range(25)])).count() == 0
    two = page(spark, [(x, 50.0 + 14 * k, x + 200) for x in (72.0, 320.0) for k in range(15)])
    assert [(r.lo, r.hi) for r in L.columns(two).orderBy("col_no").collect()] == [(72.0, 272.0), (320.0, 520.0)]


def test_heading_above_columns(spark):
    rows = [(72.0, 20.0, 520.0)] + [(x, 60.0 + 14 * k, x + 200) for x in (72.0, 320.0) for k in range(10)]
    r = L.regions(L.assigned(page(spark, rows))).orderBy("region_no").collect()
    assert [(x.kind, x.rect.x0, x.n_lines) for x in r] == [("spanning", 72.0, 1), ("text", 72.0, 10), ("text", 320.0, 10)]


def test_order_of_rows_does_not_matter(spark):
    rows = page(spark, [(72.0 + 18 * (k % 4 == 0), 50.0 + 14 * k + 9 * (k // 5), 300.0) for k in range(20)])
    a = page_stats(rows).collect()
    b = page_stats(rows.orderBy(F.desc("line_no")).repartition(3)).collect()
    assert a == b and len(a) == 1


def test_empty(spark):
    assert page_stats(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.parametrize("rects,n", [([(0, 0, 10, 10), (12, 0, 20, 10), (40, 0, 50, 10)], 2), ([(0, 0, 10, 10), (30, 0, 40, 10), (8, 8, 32, 12)], 1), ([], 0)])
def test_merge(rects, n):
    assert len(L.merge_rects(rects, 4.0)) == n


def test_reflow_of_what_fits_moves_nothing_twice(spark):
    para = P.paragraphs(page(spark, [(72.0, 50.0 + 30 * k, 300.0) for k in range(5)])).withColumn("pinned", F.col("para") == 5)
    ys = [r.y for r in R.reflow(para).orderBy("para").collect()]
    assert ys == sorted(ys) and ys[0] == 50.0 and ys[-1] == 170.0


def test_clear_of_obstacles(spark):
    o = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(20.0).alias("y1")))
    f = lambda y: R.clear_of(F.lit(y), F.lit(5.0), F.lit(10.0), F.lit(40.0), o)
    assert tuple(spark.range(1).select(f(0.0), f(8.0), f(21.0)).first()) == (0.0, 21.5, 21.0)


def test_clear_of_many_obstacles_and_long_chains(spark):
    def brute(y, h, x0, x1, obs, limit):
        for _ in range(32):
            moved = False
            for a, t, b, u in obs:
                if b > x0 and a < x1 and y < u and y + h > t:
                    y, moved = u + R.MIN_GAP, True
            if not moved or y + h > limit:
                return y
        return y

    aside = [(100.0, 10.0 * k, 150.0, 10.0 * k + 9) for k in range(40)]
    chain = [(0.0, 10.0 * k, 50.0, 10.0 * k + 9) for k in range(40)]
    cases = [aside + [(0.0, 10.0, 50.0, 20.0)], chain[:6][::-1], chain[::-1], chain, chain[:40:3]]
    for obs in cases:
        for limit in (1e9, 35.0):
            o = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)]) for r in obs])
            got = spark.range(1).select(R.clear_of(F.lit(8.0), F.lit(5.0), F.lit(10.0), F.lit(40.0), o, F.lit(limit))).first()[0]
            assert got == brute(8.0, 5.0, 10.0, 40.0, obs, limit)


@pytest.mark.parametrize("spec,n,wanted", [(None, 10, list(range(10))), ("1-5", 10, [0, 1, 2, 3, 4]), ("1,3,5-6", 10, [0, 2, 4, 5]), ("1-3,99", 5, [0, 1, 2])])
def test_page_range(spec, n, wanted):
    assert ingest.page_range(spec, n)[0] == wanted


@pytest.mark.parametrize("spec", ["99", "abc", "3-1", "0"])
def test_bad_page_range(spec):
    with pytest.raises(ValueError):
        ingest.page_range(spec, 5)


def test_attempts(spark):
    e = [("a", 1, "error"), ("a", 2, "error"), ("a", 3, "error"), ("a", 4, "success"), ("b", 1, "error"), ("b", 2, "copying"), ("b", 3, "success"), ("c", 1, "unsupported"), ("d", 1, "error")]
    got = {r.file_key: (r.status, r.attempts) for r in ingest.fold_attempts(spark.createDataFrame(e, "file_key string, ts int, outcome string")).collect()}
    assert got == {"a": ("failed", 3), "b": ("done", 0), "c": ("failed", 0), "d": ("pending", 1)}


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert ingest.load_state(spark, path).count() == 0
    for v in (1, 2):
        ingest.save_state(spark, spark.createDataFrame([("k", "done", v, None)], "file_key string, status string, attempts int, error string"), path, v)
    assert [r.attempts for r in ingest.load_state(spark, path).collect()] == [2]


def test_stream_of_attempts(spark, tmp_path):
    from quireframe.streaming.intake import attempt_states

    schema = "file_key string, ts long, outcome string"
    rows = [("a", 1, "error"), ("a", 2, "success"), ("b", 1, "unsupported"), ("c", 1, "error")]
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = attempt_states(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("attempt_states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("attempt_states").collect()} == {("a", "done", 0), ("b", "failed", 0), ("c", "pending", 1)}


def test_listing_and_keys(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.PDF", "a_en.pdf", "c.txt", "sub/d.pdf"):
        (tmp_path / name).write_bytes(b"x")
    files = ingest.list_files(spark, str(tmp_path))
    assert files.count() == 4
    assert ingest.pending(files, spark.createDataFrame([], "file_key string, status string")).count() == 3
    assert [r.path.rsplit("/", 1)[1] for r in ingest.already_there(files).collect()] == ["a.pdf"]


def test_large_pages_by_tiles(spark):
    rnd, rows = random.Random(21), []
    for doc, (n, size) in enumerate(((400, 6.0), (300, 20.0), (500, 2.0), (40, 150.0), (1, 5.0))):
        for _ in range(n):
            x, y = rnd.uniform(-50, 900), rnd.uniform(0, 700)
            rows.append((doc, 0, (x, y, x + rnd.uniform(0.1, size), y + rnd.uniform(0.1, size))))
    rows += [(9, 0, (10.0 * k, 5.0, 10.0 * k + 9.0, 8.0)) for k in range(200)]  # a chain through all tiles
    df = spark.createDataFrame(rows, f"doc_id long, page_no int, rect {RECT}")
    for pad in (4.0, 1.0):
        got = {}
        for r in L.tiled_unions(df, pad, tile_rects=8).orderBy("doc_id", "k").collect():
            got.setdefault(r.doc_id, []).append((r.x0, r.y0, r.x1, r.y1))
        assert {d: sorted(L.merge_rects([r for k, _, r in rows if k == d], pad)) for d in got} == got and set(got) == {0, 1, 2, 3, 4, 9}
    both = [sorted((r.doc_id, r.k, tuple(r.rect)) for r in L.merged(df, "drawing", most=m).collect()) for m in (450, 10_000)]
    assert both[0] == both[1]
    tasks = L.merged(df.where("doc_id = 0"), "drawing", most=100)
    assert tasks.count() == sum(d == 0 for d, _, _ in both[1])


def test_outside_by_cells(spark):
    rnd = random.Random(31)

    def rects(n, sizes, reach):
        out = []
        for _ in range(n):
            x, y = rnd.choice([rnd.uniform(-reach, reach), 256.0 * rnd.randint(-4, 4)]), rnd.choice([rnd.uniform(-reach, reach), 2048.0 * rnd.randint(-1, 1)])
            out.append((x, y, x + rnd.choice(sizes), y + rnd.choice(sizes)))
        return out

    sizes = (0.0, 1.0, 30.0, 256.0, 257.0, 900.0, 2048.0, 3000.0, 50_000.0, -20.0)
    rows = [(d, 0, k, r) for d, reach in ((1, 400), (2, 5000), (3, 40_000)) for k, r in enumerate(rects(500, sizes, reach))] + [(1, 0, 900, None), (4, 0, 1, (0.0, 0.0, 5.0, 5.0)), (None, 0, 2, (0.0, 0.0, 5.0, 5.0))]
    far = [(1, 0, 901, (1e9, 1e9, 1e9 + 5, 1e9 + 5)), (1, 0, 902, (1e9 + 90, 1e9, 1e9 + 95, 1e9 + 5)), (1, 0, 903, (float("nan"), 0.0, 1.0, 1.0))]
    stops = [(d, 0, r) for d, reach in ((1, 400), (2, 5000), (3, 40_000)) for r in rects(12, sizes[1:6] + (-20.0, 40_000.0 if d == 3 else 5.0), reach)]
    stops += [(1, 0, None), (1, 0, (1e9 + 1, 1e9 + 1, 1e9 + 2, 1e9 + 2)), (7, 0, (0.0, 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows + far, f"doc_id long, page_no int, k int, rect {RECT}")
    by = spark.createDataFrame(stops, f"doc_id long, page_no int, rect {RECT}")
    meet = lambda a, b: a and b and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    wanted = sorted((str(d), k) for d, _, k, r in rows + far[:2] if not any(d == e and meet(r, s) for e, _, s in stops))
    got = sorted((str(r.doc_id), r.k) for r in L.outside_by_cells(df, by).collect())
    assert [x for x in got if x[1] != 903] == wanted and 100 < len(wanted) < 1400 and ("1", 901) not in wanted
    assert got == sorted((str(r.doc_id), r.k) for r in L.outside(df, by).collect())
    assert L.outside_by_cells(df.where("false"), by).count() == 0 and L.outside_by_cells(df, by.where("false")).count() == df.count()


def test_a_hot_page_is_shared_among_tasks(spark):
    from pyspark.sql import functions as F

    at = lambda c: (F.col("id") * c % 600).cast("double")
    page = spark.range(4000).select(F.floor(F.col("id") / 9999).alias("doc_id"), F.floor(F.col("id") / 8888).alias("page_no"), F.struct(at(7).alias("x0"), at(11).alias("y0"), (at(7) + 3).alias("x1"), (at(11) + 3).alias("y1")).alias("rect"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        tasks = lambda f: f(page, page.where("rect.x0 = 0")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks(L.outside) == 1 and tasks(L.outside_by_cells) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_table_function(spark):
    from quireframe.functions import tables

    tables.register(spark)
    rows = [(d, 0, k, f"text {d} " * (k + 1), (72.0, 50.0 + 30 * k, 272.0, 70.0 + 30 * k), 10.0, k == 0, k == 2, None, None, "kept") for d in (1, 2) for k in range(5)]
    para = spark.createDataFrame(rows, f"doc_id long, page_no int, para long, text string, bbox {RECT}, size double, single_line boolean, pinned boolean, leading double, slack_x1 double, more string")
    got = spark.sql("SELECT * FROM reflow(TABLE({p})) ORDER BY doc_id, para", p=para.repartition(3))
    wanted = R.reflow(para.withColumn("indent", F.lit(0.0))).orderBy("doc_id", "para").collect()
    assert got.columns[-4:] == ["more", "x1", "y", "h"] and [(r.doc_id, r.para, r.x1, round(r.y, 6), r.h) for r in got.collect()] == [(r.doc_id, r.para, r.x1, round(r.y, 6), r.h) for r in wanted]
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM reflow(TABLE({p}))", p=para.drop("size")).collect()


def operators(df, *names):
    """How many of some operators a query's plan has."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*()0123456789").startswith(names) for line in plan.splitlines())


def test_texts_are_not_sorted_for_each_rule(spark):
    lines = page(spark, [(x, 50.0 + 14 * k, x + 200) for x in (72.0, 320.0) for k in range(15)])
    placed = L.assigned(lines)
    assert operators(placed, "Sort ", "Window ") == 0
    assert operators(P.paragraphs(lines), "Sort ", "Window ") == 0
    assert operators(P.paragraphs(placed, ["doc_id", "page_no", "band_no", "part", "region_col"]), "Sort ", "Window ") == 0


def test_lines_that_stand_alike_are_one_run_and_blocks_are_told_by_their_first_line(spark):
    """Equal lines, a block of two lines and one of its own, lines in any order, pages without columns beside them."""
    rows = [(72.0, 20.0, 520.0), (72.0, 32.0, 520.0)] + [(x, 60.0 + 14 * (k % 7), x + 200) for x in (72.0, 320.0) for k in range(14)] + [(72.0, 300.0, 520.0)]
    lines = page(spark, rows).unionByName(page(spark, rows[2:9]).withColumn("page_no", F.lit(1))).orderBy(F.desc("line_no")).repartition(3)
    r = L.regions(L.assigned(lines.drop("spans"))).orderBy("page_no", "region_no").collect()
    assert [(x.page_no, x.kind, x.n_lines, x.rect.y0, x.rect.y1) for x in r] == [
        (0, "spanning", 2, 20.0, 42.0), (0, "text", 14, 42.0, 300.0), (0, "text", 14, 42.0, 300.0), (0, "spanning", 1, 300.0, 310.0), (1, "text", 7, 60.0, 154.0)
    ]
