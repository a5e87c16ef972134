"""Measuring of texts by a measurer given by the caller, each distinct request once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources import store
from . import workers

#: Rows of (width, text, size, single_line, indent, leading) to (box height, tight height), one each.
Heights = Callable[[Sequence[tuple]], list[tuple[float, float]]]
#: A factory of those, called once in each worker.
Measurer = Callable[[], Heights]
REQUEST = ["width", "text", "size", "single_line", "indent", "leading"]


def by_letters() -> Heights:
    """A stand-in for a renderer: as many lines as the text needs at half the size a letter."""

    def one(width: float, text: str, size: float, single: bool, indent: float, leading: float | None) -> tuple[float, float]:
        box = max(1.0, float(ceil(len(text) * size * 0.5 / max(width, 1.0)))) * size * (1.2 if leading is None else leading)
        return box, box - 0.2 * size

    return lambda rows: [one(*r) for r in rows]


def by_letter_widths() -> Heights:
    """As by_letters, but narrow letters take three tenths of the size and wide ones eight."""

    def one(width: float, text: str, size: float, single: bool, indent: float, leading: float | None) -> tuple[float, float]:
        narrow, wide = sum(map(text.count, "ijl")), sum(map(text.count, "mw"))
        letters = (5 * len(text) - 2 * narrow + 3 * wide) / 5.0
        box = max(1.0, float(ceil(letters * size * 0.5 / max(width, 1.0)))) * size * (1.2 if leading is None else leading)
        return box, box - 0.2 * size

    return lambda rows: [one(*r) for r in rows]


def measured(rows: DataFrame, measurer: Measurer = by_letters) -> DataFrame:
    """Rows with box_h and tight_h. Requests are rounded (widths and indents to a tenth, sizes to a hundredth, leading to a thousandth;
    a leading of 0 is none) and told apart by that, measured once each, written, and joined back."""
    found = _asked(rows.withColumn("__sizes", F.array("size")), measurer)
    return found.withColumns({c: F.get(f"__heights.{c}", F.lit(0)) for c in ("box_h", "tight_h")}).drop("__heights")


def measured_sizes(rows: DataFrame, sizes: str, measurer: Measurer = by_letters) -> DataFrame:
    """Rows with box_hs, the box heights at each of their sizes (an array column), asked for as `measured` does."""
    return _asked(rows.withColumn("__sizes", F.col(sizes)), measurer).withColumn("box_hs", F.col("__heights.box_h")).drop("__heights")


def _asked(rows: DataFrame, measurer: Measurer) -> DataFrame:
    """Rows with what the measurer says of their __sizes. A text goes to where it is measured once, with all sizes that are wanted of it; what is
    written, and joined back by a digest of the request, holds no texts."""
    name = workers.name_of(measurer)
    key = {
        "width": F.round("width", 1).cast("double"), "text": F.col("text"), "single_line": F.col("single_line"), "indent": F.round("indent", 1).cast("double"),
        "leading": F.when(F.col("leading") != 0, F.round("leading", 3)).cast("double"),
    }
    digest = F.unhex(F.sha2(F.to_json(F.struct(*[F.when(c.cast("string").isNotNull(), F.concat(F.lit("="), c.cast("string"))).alias(n) for n, c in key.items()])), 256))
    d = rows.withColumn("__key", digest).withColumn("__sizes", F.transform("__sizes", lambda s: F.round(s, 2).cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights = workers.loaded(name, measurer)
            asked = batch.select(["width", "text", "single_line", "indent", "leading", "sizes"]).to_pylist()
            found = heights([(r["width"], r["text"], s, r["single_line"], r["indent"], r["leading"]) for r in asked for s in r["sizes"]])
            flat = pa.StructArray.from_arrays([batch.column("sizes").flatten(), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], ["size", "box_h", "tight_h"])
            ends = pa.array([0, *accumulate(len(r["sizes"]) for r in asked)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.ListArray.from_arrays(ends, flat)], names=["__key", "__all"])

    one = d.select("__key", *[c.alias(n) for n, c in key.items()], "__sizes").groupBy("__key", *key).agg(F.array_distinct(F.flatten(F.collect_set("__sizes"))).alias("sizes"))  # a text's
    told = one.mapInArrow(run, "__key binary, __all array<struct<size: double, box_h: double, tight_h: double>>")
    told = store.written(told, "measured")
    same = lambda x, s: x["size"].eqNullSafe(s)
    own = F.transform("__sizes", lambda s: F.get(F.filter("__all", lambda x: same(x, s)), F.lit(0)))
    return d.join(told, "__key", "left").withColumn("__heights", own).drop("__key", "__sizes", "__all")


def first_pair(pairs: Sequence[tuple[str, str]], exists: Callable[[str], bool] = os.path.exists) -> tuple[str, str]:
    """The first pair of font files (upright, italic) that is there whole, for a measurer or renderer to load."""
    for upright, italic in pairs:
        if exists(upright) and exists(italic):
            return upright, italic
    raise FileNotFoundError(f"none of {len(pairs)} pairs of fonts is there")


def disagreements(rows: DataFrame) -> DataFrame:
    """Of rendered rows (scale), those that came out smaller than measured, with what is said of them."""
    said = F.concat(F.lit("  WARNING: paragraph rendered at "), F.format_number("scale", 2), F.lit("x -- the measure disagreed with the render"))
    return rows.where("scale < 0.999").withColumn("message", said)
