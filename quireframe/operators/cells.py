"""Cells of tables: their texts and boxes brought together, their fonts, translation and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..schema import PAGE
from ..sources import store
from . import measure as M, reflow as R
from .paragraphs import FALLBACK_SIZE
from .translate import Backend, answered, identity, said, try_events

CELL = [*PAGE, "table_no", "row_idx", "col_idx"]


def matched(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells (bbox, text) from a matrix of texts and one of boxes, by row and column; boxes without a text are left out."""
    return boxes.select(*CELL, "bbox").join(store.dealt(texts.select(*CELL, "text")), CELL)


def with_fonts(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells with the size of most characters of the lines that meet their box, and whether that is one line; 10 points and one line
    where there is none."""
    found = cells.select(*CELL, "bbox").where(F.col("bbox").isNotNull()).join(store.dealt(lines.select(*PAGE, "line_no", F.col("bbox").alias("box"), "spans")), PAGE).where(G.intersects(F.col("bbox"), F.col("box")) & (F.size("spans") > 0))
    own = found.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("line_no", "spans"))).alias("ls"))  # a cell's lines
    own = own.select(*CELL, X.dominant_span_size(F.flatten(F.transform("ls", lambda r: r["spans"]))).alias("seen"), (F.size("ls") == 1).alias("one"))
    return cells.join(store.dealt(own), CELL, "left").withColumn("size", F.coalesce("seen", F.lit(FALLBACK_SIZE))).withColumn("single_line", F.coalesce("one", F.lit(True))).drop("seen", "one")


def translated(cells: DataFrame, lines: DataFrame, backend: Backend = identity, temperature: float = 0.3, measurer: M.Measurer | None = None) -> DataFrame:
    """Cells that are translated, with their inner box, answer, tries and the size at which it fits. Numbers, units and dashes are never asked
    for; a cell with a bad answer (reason) keeps its source and gets no size. With a measurer the answers are written, before it is asked."""
    asked = answered(R.usable_cells(with_fonts(cells, lines)), backend, temperature, retry=False)
    if measurer is None:
        size = F.when(F.col("reason").isNull(), R.fit_size(F.col("answer"), F.col("size"), F.col("inner")))
        return asked.select(*CELL, "inner", "text", "answer", "reason", "tries", size.alias("size"))
    asked = store.written(asked, "answered-cells")
    fitted = R.measured_cells(asked.where("reason is null").select(*CELL, F.col("answer").alias("text"), "size", "inner"), CELL, measurer)
    return asked.select(*CELL, "inner", "text", "answer", "reason", "tries").join(store.dealt(fitted.select(*CELL, "size")), CELL, "left")


def events(done: DataFrame, tables: DataFrame) -> DataFrame:
    """What a run says of the cells of tables (page, table_no): of each call, that a cell keeps its source, and how many of a table got a
    translation, those without any too."""
    cell = F.concat(F.lit("    cell r"), F.col("row_idx").cast("string"), F.lit("c"), F.col("col_idx").cast("string"), F.lit(": "), said(F.col("reason")), F.lit(" -- keeping source text"))
    kept = F.when(F.col("reason").isNotNull(), F.struct(F.lit("cell").alias("kind"), cell.alias("message")))
    rows = F.array_compact(F.concat(try_events(F.get("tries", F.lit(0))), F.array(kept)))
    each = done.select(*CELL, F.posexplode(rows).alias("nth", "e")).select(*CELL, "nth", "e.kind", "e.message")
    n = F.coalesce("cells", F.lit(0)).cast("string")
    total = tables.select(*PAGE, "table_no").join(store.dealt(counts(done)), [*PAGE, "table_no"], "left")
    none = F.lit(None).cast("int")
    total = total.select(*PAGE, "table_no", none.alias("row_idx"), none.alias("col_idx"), F.lit(0).alias("nth"), F.lit("table").alias("kind"), F.concat(F.lit("  table: "), n, F.lit(" cell(s) translated")).alias("message"))
    return each.unionByName(total)


def counts(done: DataFrame) -> DataFrame:
    """How many cells of each table got a translation."""
    return done.where("reason is null").groupBy(*PAGE, "table_no").agg(F.count("*").alias("cells"))
