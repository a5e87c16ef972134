"""Table functions for SQL: `SELECT * FROM reflow(TABLE(paragraphs))`."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.reflow import SLACK_TIMES

NEEDED = ["doc_id", "page_no", "para", "text", "bbox", "size", "single_line", "pinned", "leading", "slack_x1"]


class Reflow:
    """Paragraphs of pages with their new right edge, top and height: what `operators.reflow.reflow` gives, as a fold over the page's rows in order, of
    which only the last one's bottom is kept. Pages and order are asked of Spark by the function itself; other columns pass through."""

    @staticmethod
    def analyze(paragraphs: AnalyzeArgument) -> AnalyzeResult:
        if not paragraphs.isTable:
            raise ValueError("reflow takes a table")
        fields = paragraphs.dataType.fields
        missing = [c for c in NEEDED if c not in {f.name for f in fields}]
        if missing:
            raise ValueError(f"reflow needs the columns {', '.join(missing)}")
        schema = StructType([f for f in fields if f.name not in ("x1", "y", "h")])
        for name in ("x1", "y", "h"):
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page_no")], orderBy=[OrderingColumn("para")])

    def __init__(self):
        self.bottom = self.before = None  # where the last flowing paragraph ends now, and where it ended

    def eval(self, p: Row) -> Iterator[tuple]:
        x1 = p["bbox"]["x1"]
        if p["single_line"]:
            x1 = x1 + SLACK_TIMES * p["size"] if p["slack_x1"] is None else min(x1 + SLACK_TIMES * p["size"], p["slack_x1"] - 2.0)
        lines = max(1.0, float(ceil(len(p["text"]) * p["size"] * 0.5 / max(x1 - p["bbox"]["x0"], 1.0))))
        h = lines * p["size"] * (1.2 if p["leading"] is None else p["leading"])
        y = p["bbox"]["y0"]
        if not p["pinned"]:
            if self.bottom is not None:
                y = self.bottom + (y - self.before)
            self.bottom, self.before = y + h - 0.2 * p["size"], p["bbox"]["y1"]
        yield (*(v for c, v in zip(p.__fields__, p, strict=True) if c not in ("x1", "y", "h")), x1, y, h)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("reflow", udtf(Reflow))
