"""The page report: paragraphs, sizes, margins, near-empty paragraphs, regions, columns, obstacles and tables of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..operators import layout as L, paragraphs as P
from ..schema import PAGE
from ..sources import store
from .pages import Analysis


def page_stats(lines: DataFrame) -> DataFrame:
    """The report of pages of lines alone, without drawings or tables."""
    placed = L.assigned(lines)
    region = [*PAGE, "band_no", "part", "region_col"]
    para = P.paragraphs(placed.where("region_kind <> 'unassigned'"), region)
    seen = F.collect_set(F.struct("band_no", "part", "region_col"))  # a page's regions: each has a paragraph
    stats = para.groupBy(*PAGE).agg(
        F.count("*").alias("paragraphs"), F.max("size").alias("body_size"), P.count_where(X.near_empty(F.col("text"))).alias("near_empty"),
        F.size(seen).alias("regions"), F.greatest(F.lit(1), F.max("region_col")).alias("columns"),
    )
    out = stats.join(P.modal_margin(lines).withColumnRenamed("margin", "modal_margin"), PAGE).withColumn("obstacles", F.lit(0)).withColumn("tables", F.lit(0))
    return out.select(*PAGE, *[F.col(c).cast("bigint").alias(c) for c in ("paragraphs", "near_empty", "regions", "columns", "obstacles", "tables")], "body_size", "modal_margin")


def overlay(a: Analysis) -> DataFrame:
    """Labelled boxes of a page's parts, for drawing: obstacles, gutters, regions and tables, paragraphs of text regions."""
    none = F.lit(None).cast("string")
    boxes = lambda d, kind, color, label, rect: d.select(*PAGE, F.lit(kind).alias("kind"), color.alias("color"), label.alias("label"), rect.alias("rect"))
    own = a.placed.where("region_kind <> 'unassigned'")
    table = F.col("kind") == "table"
    name = F.concat(F.lit("R"), F.col("region_no").cast("string"), F.lit(":"), F.when(table, "table").otherwise("text"))
    out = boxes(a.regions, "region", F.when(table, "green").otherwise("blue"), name, F.col("rect"))
    area = a.placed.groupBy(*PAGE).agg(G.bounds(F.col("bbox")).alias("area"))
    g = L.gutters(L.columns(a.placed)).join(store.dealt(area), PAGE)
    out = out.unionByName(boxes(g, "gutter", F.lit("orange"), none, G.rect(F.col("x0"), F.col("area.y0"), F.col("x1"), F.col("area.y1"))))
    out = out.unionByName(boxes(P.paragraphs(own, [*PAGE, "band_no", "part", "region_col"]), "paragraph", F.lit("grey"), none, F.col("bbox")))
    return out if a.obstacles is None else out.unionByName(boxes(a.obstacles, "obstacle", F.lit("red"), F.col("kind"), F.col("rect")))
