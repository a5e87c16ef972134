"""Layout tables derived from the plain `documents` table, by formulas that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from . import store

LINES_A_PAGE, PAGE_RECT = 40, (0.0, 0.0, 612.0, 792.0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def lines(docs: DataFrame, columns: int = 1) -> DataFrame:
    """Lines with spans: every fifth ends in a hyphen, every eleventh starts with a footnote marker, every thirteenth is italic."""
    base = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    n, d = F.col("line_no"), F.col("doc_id")
    i = n % LINES_A_PAGE
    base = base.select(
        "doc_id", F.floor(n / LINES_A_PAGE).cast("int").alias("page_no"), n.cast("int").alias("line_no"), i.alias("i"),
        F.when((d + n) % 5 == 0, F.concat("raw", F.lit("-"))).otherwise(F.col("raw")).alias("text"),
        F.when(i == 0, 14.0).when((d * 7 + n) % 9 == 0, 9.0).otherwise(11.0).alias("size"),
        F.when((d + n) % 4 == 0, 18.0).otherwise(0.0).alias("indent"),
        F.when((d + n) % 11 == 0, (n % 99 + 1).cast("string")).alias("mark"), F.when((d + n) % 13 == 0, 2).otherwise(0).alias("flags"),
    )
    if columns == 1:
        x0 = 72.0 + F.col("indent")
        x1 = x0 + 0.5 * F.col("size") * F.least(F.length("text"), F.lit(80))
    else:
        x0 = F.when(F.col("i") == 0, 72.0).otherwise(72.0 + 248.0 * (F.col("i") % 2))
        x1 = F.when(F.col("i") == 0, 512.0).otherwise(x0 + 200.0 - 4.0 * (F.length("text") % 5))
    y0 = 72.0 + 15.0 * F.col("i") + 12.0 * F.floor(F.col("i") / 6)
    span = lambda text, size, flags: F.struct(text.alias("text"), size.alias("size"), F.lit("serif").alias("font"), flags.cast("int").alias("flags"))
    body = span(F.col("text"), F.col("size"), F.col("flags"))
    spans = F.when(F.col("mark").isNull(), F.array(body)).otherwise(F.array(span(F.col("mark"), F.lit(6.5), F.lit(1)), body))
    return base.select("doc_id", "page_no", "line_no", G.rect(x0, y0, x1, y0 + F.col("size")).alias("bbox"), spans.alias("spans"))


def pages(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page_no").distinct().select("doc_id", "page_no", G.rect(*map(F.lit, PAGE_RECT)).alias("rect"), F.lit(0).alias("rotation"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from order lines: an order is a page, a line a drawing."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, n, p = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")
    x0, y0 = (p % 50) * 10.0, n * 90.0
    fill = F.when(p % 7 == 0, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.5)))
    return t.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), n.alias("drawing_no"),
        G.rect(x0, y0, x0 + q * 6.0, y0 + (p % 30) * 4.0).alias("rect"), fill.alias("fill"), F.lit(None).cast("array<double>").alias("color"),
    )


def _when(rows: DataFrame, name: str, cases: list[tuple[Column, tuple]], *more: str) -> DataFrame:
    """A row for each case that holds on a page: its number, a rectangle, and further columns."""
    entry = lambda k, values: F.struct(F.lit(k).alias(name), G.rect(*[v if isinstance(v, Column) else F.lit(v) for v in values[:4]]).alias("rect"), *[v.alias(m) if isinstance(v, Column) else F.lit(v).alias(m) for v, m in zip(values[4:], more, strict=True)])
    every = F.array(*[F.when(cond, entry(k, values)) for k, (cond, values) in enumerate(cases)])
    return rows.select("doc_id", "page_no", F.inline(F.array_compact(every)))


def page_images(pages: DataFrame) -> DataFrame:
    """On every fourth page two images a hair apart; a speck on every second."""
    k = (F.col("doc_id") + F.col("page_no")) % 4
    return _when(pages, "image_no", [(k == 1, (330.0, 400.0, 400.0, 450.0)), (k == 1, (400.5, 400.0, 470.0, 450.0)), (k <= 1, (10.0, 10.0, 12.0, 12.0))])


def page_drawings(pages: DataFrame) -> DataFrame:
    """On every fourth page three drawings that are one figure, a rule and a white box; on every eighth one that covers the page."""
    k = F.col("doc_id") + F.col("page_no")
    white, grey = F.array(*[F.lit(1.0)] * 3), F.array(*[F.lit(0.5)] * 3)
    some = [(90.0, 300.0, 130.0, 340.0), (133.0, 300.0, 170.0, 360.0), (160.0, 362.0, 260.0, 400.0), (300.0, 100.0, 301.0, 400.0)]
    cases = [(k % 4 == 2, (*r, grey)) for r in some] + [(k % 4 == 2, (72.0, 420.0, 400.0, 480.0, white)), (k % 8 == 2, (*PAGE_RECT, grey))]
    return _when(pages, "drawing_no", cases, "fill").withColumn("color", F.lit(None).cast("array<double>"))


def page_tables(pages: DataFrame) -> DataFrame:
    """On every third page a table in the left column, on every sixth one across; single rows, which are none, on every second."""
    d, k = F.col("doc_id"), F.col("doc_id") + F.col("page_no")
    y = 222.0 + (d % 4) * 30.0
    return _when(pages, "table_no", [(k % 3 == 0, (72.0, y, 300.0, y + 60.0, 3, 3)), (k % 6 == 0, (72.0, 500.0, 512.0, 560.0, 2, 2)), (k % 2 == 0, (72.0, 600.0, 512.0, 640.0, 1, 4))], "n_rows", "n_cols")


def cell_boxes(tables: DataFrame) -> DataFrame:
    """Boxes of each table's cells; one of them is missing in some tables."""
    n = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    grid = tables.select("*", F.explode(n("n_rows")).alias("row_idx")).select("*", F.explode(n("n_cols")).alias("col_idx"))
    r = F.col("rect")
    w, h = G.width(r) / F.col("n_cols"), G.height(r) / F.col("n_rows")
    x, y = r["x0"] + w * F.col("col_idx"), r["y0"] + h * F.col("row_idx")
    gone = (F.col("row_idx") == 1) & (F.col("col_idx") == 1) & ((F.col("doc_id") + F.col("page_no")) % 2 == 1)
    return grid.select("doc_id", "page_no", "table_no", "row_idx", "col_idx", F.when(~gone, G.rect(x, y, x + w, y + h)).alias("bbox"))


def grid_drawings(tables: DataFrame) -> DataFrame:
    """The lines of each table's grid as thin drawings: those across in two pieces that touch, those down in a piece a row; on every second page
    one piece is missing, so that two places are one cell."""
    r = F.col("rect")
    w, h = G.width(r) / F.col("n_cols"), G.height(r) / F.col("n_rows")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n))
    line = lambda x0, y0, x1, y1: G.rect(x0 - 0.5, y0 - 0.5, x1 + 0.5, y1 + 0.5)
    y = r["y0"] + h * F.col("k")
    mid = G.mid_x(r)
    across = tables.select("*", upto(F.col("n_rows")).alias("k")).select("doc_id", "page_no", F.explode(F.array(line(r["x0"], y, mid, y), line(mid, y, r["x1"], y))).alias("rect"))
    x, top = r["x0"] + w * F.col("k"), r["y0"] + h * F.col("row")
    gone = (F.col("table_no") == 0) & (F.col("k") == 2) & (F.col("row") == 1) & ((F.col("doc_id") + F.col("page_no")) % 2 == 1)
    down = tables.select("*", upto(F.col("n_cols")).alias("k")).select("*", upto(F.col("n_rows") - 1).alias("row")).where(~gone).select("doc_id", "page_no", line(x, top, x, top + h).alias("rect"))
    black = F.array(*[F.lit(0.0)] * 3)
    return across.unionByName(down).select("doc_id", "page_no", F.lit(0).alias("drawing_no"), "rect", black.alias("fill"), F.lit(None).cast("array<double>").alias("color"))


def cell_texts(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of cells: a number, two words, a word with space around, nothing; words come from the document."""
    k, i = (F.col("row_idx") + F.col("col_idx")) % 4, F.col("row_idx") * 7 + F.col("col_idx") * 3 + F.col("page_no")
    word = lambda n: F.get("ws", (n % F.size("ws")).cast("int"))
    text = F.when(k == 0, ((F.col("doc_id") + F.col("page_no")) % 1000).cast("string")).when(k == 1, F.concat(word(i), F.lit(" "), word(i + 1))).when(k == 2, F.concat(F.lit("  "), word(i), F.lit("  ")))
    d = boxes.drop("bbox").join(store.dealt(docs.select("doc_id", F.split("text", " ").alias("ws"))), "doc_id")
    return d.select("doc_id", "page_no", "table_no", "row_idx", "col_idx", text.alias("text"))
