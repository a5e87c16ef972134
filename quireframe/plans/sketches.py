"""Sketches of documents' statistics that can be stored and put together: how many different lines, and the spread of letters and sizes.

A document's sketch is a few kilobytes however many lines it has. Sketches of any documents, whenever they were made, union to what one
pass over all of their lines would give, so a corpus' figures follow from its stored parts without reading a line again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

#: Logarithm of the registers of a count of different lines (an error of some 1.6 per cent), and the size of a sketch of quantiles (1.3 per cent of rank).
REGISTERS, RANKS = 12, 200
SHARES = (0.1, 0.5, 0.9)


def sketched(lines: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines (doc_id, page_no, bbox, spans) to one row a document, or whatever else they are grouped by: different, letters, tops and how many lines."""
    d = lines.select(*by, X.line_text(F.col("spans")).alias("t"), F.col("bbox.y0").alias("y"))
    return d.groupBy(*by).agg(
        F.hll_sketch_agg("t", REGISTERS).alias("different"), F.kll_sketch_agg_bigint(F.length("t").cast("bigint"), RANKS).alias("letters"), F.kll_sketch_agg_double("y", RANKS).alias("tops"), F.count("*").alias("lines"),
    )


def united(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts put together, for each group."""
    return parts.groupBy(*by).agg(
        F.hll_union_agg("different").alias("different"), F.kll_merge_agg_bigint("letters", RANKS).alias("letters"), F.kll_merge_agg_double("tops", RANKS).alias("tops"), F.sum("lines").alias("lines"),
    )


def figures(sketches: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = SHARES) -> DataFrame:
    """What sketches say: lines, different ones, and the letters and tops below which each of the shares of lines lies."""
    ranks, some = F.array(*map(F.lit, shares)), F.col("lines") > 0  # no rank of nothing
    letters, tops = F.kll_sketch_get_quantile_bigint("letters", ranks), F.kll_sketch_get_quantile_double("tops", ranks)
    return sketches.select(*by, "lines", F.hll_sketch_estimate("different").alias("different"), F.when(some, letters).alias("letters"), F.when(some, tops).alias("tops"))
