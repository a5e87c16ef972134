"""Tables by their drawn lines: segments are joined to edges, edges cross, and the faces between crossings are cells.

All of it is windows and joins keyed by the page. Segments of nearly one height (or one abscissa) are brought to their mean, those that touch
on it become one edge. From a crossing whose edges go on to the right and down, the next crossing to the right where an edge goes down and
the next one below where an edge goes right are two further corners; where the edges through them cross too, there is a face. A cell that spans
several places of the grid is a face like any other, and the places that it covers have no box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G, text as X
from ..schema import PAGE
from . import layout as L
from .cells import CELL

#: Up to so thick a drawing is a line; so near are heights the same, and ends joined; ways that a line is taken for a border.
THICK, SNAP, JOIN = 3.0, 3.0, 3.0
STRATEGIES = ("lines", "lines_strict")


def segments(drawings: DataFrame, strict: bool = False) -> DataFrame:
    """(page, across, pos, lo, hi): thin drawings, and the four sides of boxes; with strict only of boxes that have a border of their own."""
    r = F.col("rect")
    white = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    unseen = lambda c: F.col(c).isNull() | (F.col(c) == white)
    flat, narrow = G.height(r) <= THICK, G.width(r) <= THICK
    side = lambda across, pos, lo, hi: F.struct(F.lit(across).alias("across"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"))
    box = F.array(side(True, r["y0"], r["x0"], r["x1"]), side(True, r["y1"], r["x0"], r["x1"]), side(False, r["x0"], r["y0"], r["y1"]), side(False, r["x1"], r["y0"], r["y1"]))
    if strict:
        box = F.when(~unseen("color"), box)
    line = F.when(flat & ~narrow, F.array(side(True, G.mid_y(r), r["x0"], r["x1"]))).when(narrow & ~flat, F.array(side(False, G.mid_x(r), r["y0"], r["y1"]))).when(~flat & ~narrow, box)
    return drawings.where(~(unseen("fill") & unseen("color"))).select(*PAGE, F.inline(line))


def edges(segs: DataFrame) -> DataFrame:
    """Segments that lie on one line and touch, as edges (page, across, edge, pos, lo, hi)."""
    at = [*PAGE, "across"]
    order = Window.partitionBy(*at).orderBy("pos")
    d = segs.withColumn("new", (F.col("pos") - F.lag("pos", 1).over(order) > SNAP).cast("int"))
    d = d.withColumn("line", F.sum(F.coalesce("new", F.lit(0))).over(order)).withColumn("pos", F.avg("pos").over(Window.partitionBy(*at, "line")))
    along = Window.partitionBy(*at, "line").orderBy("lo", "hi")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("piece", F.coalesce((F.col("lo") > reach + JOIN).cast("int"), F.lit(0))).withColumn("piece", F.sum("piece").over(along))
    whole = d.groupBy(*at, "line", "piece").agg(F.first("pos").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.withColumn("edge", F.row_number().over(Window.partitionBy(*at).orderBy("line", "piece"))).drop("line", "piece")


def crossings(found: DataFrame) -> DataFrame:
    """Where edges cross (page, h, v, x, y), and whether they go on from there to the right and down."""
    h = found.where("across").select(*PAGE, F.col("edge").alias("h"), F.col("pos").alias("y"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))
    v = found.where("not across").select(*PAGE, F.col("edge").alias("v"), F.col("pos").alias("x"), F.col("lo").alias("vlo"), F.col("hi").alias("vhi"))
    within = lambda p, lo, hi: F.col(p).between(F.col(lo) - JOIN, F.col(hi) + JOIN)
    met = h.join(v, PAGE).where(within("x", "hlo", "hhi") & within("y", "vlo", "vhi"))
    return met.select(*PAGE, "h", "v", "x", "y", (F.col("hhi") > F.col("x") + SNAP).alias("right"), (F.col("vhi") > F.col("y") + SNAP).alias("down"))


def faces(points: DataFrame) -> DataFrame:
    """Boxes (page, bbox) between crossings, each with no edge through it from its corner on."""
    before = lambda *w, by: Window.partitionBy(*PAGE, *w).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  what comes later on the edge
    p = points.withColumn("r", F.min(F.when(F.col("down"), F.struct("x", "v"))).over(before("h", by="x"))).withColumn("b", F.min(F.when(F.col("right"), F.struct("y", "h"))).over(before("v", by="y")))
    corner = p.where(F.col("right") & F.col("down") & F.col("r").isNotNull() & F.col("b").isNotNull())
    other = points.select(*PAGE, F.col("h").alias("bh"), F.col("v").alias("rv"))
    closed = corner.withColumn("bh", F.col("b.h")).withColumn("rv", F.col("r.v")).join(other, [*PAGE, "bh", "rv"], "left_semi")
    return closed.select(*PAGE, G.rect(F.col("x"), F.col("y"), F.col("r.x"), F.col("b.y")).alias("bbox"))


def texts_in(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells with the text of the lines whose middle lies in them, from the top; empty where there is none."""
    line = lines.select(*PAGE, F.col("bbox").alias("at"), X.line_text(F.col("spans")).alias("t"))
    b, m = F.col("bbox"), F.col("at")
    inside = (G.mid_x(m) >= b["x0"]) & (G.mid_x(m) < b["x1"]) & (G.mid_y(m) >= b["y0"]) & (G.mid_y(m) < b["y1"])
    own = cells.where(b.isNotNull()).select(*CELL, "bbox").join(line, PAGE).where(inside).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("at.y0", "at.x0", "t"))).alias("ls"))  # a cell's
    own = own.select(*CELL, F.array_join(F.transform("ls", lambda r: r["t"]), "\n").alias("text"))
    out = cells.join(own, CELL, "left")
    return out.withColumn("text", F.when(b.isNotNull(), F.coalesce("text", F.lit(""))))


def find_tables(drawings: DataFrame, lines: DataFrame | None = None, strategy: str = "lines") -> tuple[DataFrame, DataFrame]:
    """Tables (page, table_no, rect, n_rows, n_cols) of two cells at least, numbered from the top, and their cells (bbox, text) at all places of
    their grids; a place that another cell covers has neither."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    cells = faces(crossings(edges(segments(drawings, strategy == "lines_strict")))).withColumn("rect", F.col("bbox"))
    whole = L.merged(cells, "table").select(*PAGE, "k", F.col("rect").alias("whole"))
    c, t = F.col("bbox"), F.col("whole")
    own = cells.drop("rect").join(whole, PAGE).where((c["x0"] >= t["x0"]) & (c["y0"] >= t["y0"]) & (c["x1"] <= t["x1"]) & (c["y1"] <= t["y1"]))
    table = Window.partitionBy(*PAGE, "k")
    nth = lambda e: (F.dense_rank().over(table.orderBy(c[e])) - 1).cast("int")
    own = own.withColumn("row_idx", nth("y0")).withColumn("col_idx", nth("x0"))
    tables = own.groupBy(*PAGE, "k", "whole").agg(F.count("*").alias("n"), (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")).where("n > 1")
    tables = tables.withColumn("table_no", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("whole.y0", "whole.x0", "k")) - 1).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = tables.select(*PAGE, "k", "table_no", "n_cols", upto("n_rows").alias("row_idx")).select(*PAGE, "k", "table_no", "row_idx", upto("n_cols").alias("col_idx"))
    placed = grid.join(own.select(*PAGE, "k", "row_idx", "col_idx", "bbox"), [*PAGE, "k", "row_idx", "col_idx"], "left").select(*CELL, "bbox")
    placed = texts_in(placed, lines) if lines is not None else placed.withColumn("text", F.lit(None).cast("string"))
    return tables.select(*PAGE, "table_no", F.col("whole").alias("rect"), "n_rows", "n_cols"), placed
