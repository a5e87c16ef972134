"""Measuring, reflowing and fitting paragraphs, and table cells.

Without a measurer heights come from a stand-in for a renderer, a column expression: as many lines as the text needs at half the size a
letter. A measurer (`measure`) is asked for all heights of a step at once, each distinct request once, and its answers are joined back: those
of paragraphs as they are before they flow, those of the smaller scales only for regions that do not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as X
from ..schema import PAGE, RECT
from ..sources import store
from . import measure as M

# Fixed values of the placement rules.
SMALL, SHORT, TIGHT_GAP, SLACK_TIMES = 0.9, 120, 3.0, 1.5
MIN_GAP, LEAST_SCALE, STEP, BOTTOM, JUMPS = 1.5, 0.65, 0.06, 18.0, 32
CELL_INSET, CELL_SCALE, CELL_STEP = 1.0, 0.60, 0.25
SCALES = [1.0, 0.94, 0.88, 0.82, 0.76, 0.70, 0.65]


def box_height(width: Column, text: Column, size: Column, leading: Column) -> Column:
    rows = F.greatest(F.lit(1.0), F.ceil(F.length(text) * size * 0.5 / F.greatest(width, F.lit(1.0))).cast("double"))
    return rows * size * F.coalesce(leading, F.lit(1.2))


def tight_height(width: Column, text: Column, size: Column, leading: Column) -> Column:
    return box_height(width, text, size, leading) - 0.2 * size


def reflow(para: DataFrame, region: list[str] = PAGE, reformat: bool = False, measurer: M.Measurer | None = None) -> DataFrame:
    """Placements: each paragraph right below the one before, at their old distance; pinned ones stay.

    The chain is a sum over a window: the first flowing top, plus heights and gaps so far. A single line may widen to the right, as far
    as slack_x1, the right edge of its column or of the page, if there is such a column. When a page is only formatted anew (reformat), runs of small or short
    paragraphs close up.
    """
    order = Window.partitionBy(*region, "pinned").orderBy("para")
    size, box = F.col("size"), F.col("bbox")
    body = F.max(size).over(Window.partitionBy(*region))
    small, short = size < SMALL * body, F.length("text") < SHORT
    edge = F.col("slack_x1") if "slack_x1" in para.columns else F.lit(None).cast("double")  # least() passes over a null
    x1 = F.when(F.col("single_line"), F.least(box["x1"] + SLACK_TIMES * size, edge - 2.0)).otherwise(box["x1"])
    d = para.withColumn("x1", x1).withColumn("small", small).withColumn("short", short)
    if measurer is None:
        d = d.withColumn("h", box_height(F.col("x1") - box["x0"], F.col("text"), size, F.col("leading"))).withColumn("tight", F.col("h") - 0.2 * size)
    else:
        d = M.measured(d.withColumn("width", F.col("x1") - box["x0"]), measurer).withColumnsRenamed({"box_h": "h", "tight_h": "tight"})
    run = (F.lag("small").over(order) & F.col("small")) | (F.lag("short").over(order) & F.col("short"))
    gap = F.when(F.lit(reformat) & F.coalesce(run, F.lit(False)), TIGHT_GAP).otherwise(box["y0"] - F.lag(box["y1"]).over(order))
    step = F.coalesce(F.lag("tight").over(order) + gap, F.lit(0.0))
    d = d.withColumn("gap", gap).withColumn("step", step)
    y = F.when(F.col("pinned"), box["y0"]).otherwise(F.first(box["y0"]).over(order) + F.sum("step").over(order))
    return d.withColumn("y", y).select(*region, "para", "text", "size", "single_line", "pinned", "indent", "leading", box["x0"].alias("x0"), "x1", "y", "h", "tight", "gap")


def ceilings(regs: DataFrame, pages: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """How far down a region may grow: to the next region or table that starts lower and shares some of its width, else to the page's end."""
    a = regs.select(*keys, "region_no", "rect")
    b = regs.select(*keys, F.col("rect").alias("other"))
    below = (F.col("other.y0") > F.col("rect.y0")) & (G.x_overlap(F.col("rect"), F.col("other")) > 0)
    nearest = a.join(store.dealt(b), keys).where(below).groupBy(*keys, "region_no").agg(F.min("other.y0").alias("next_y"))
    return a.join(store.dealt(nearest), [*keys, "region_no"], "left").join(store.dealt(pages.select(*keys, F.col("rect.y1").alias("page_y1"))), keys).select(*keys, "region_no", F.coalesce("next_y", "page_y1").alias("limit"))


def clear_of(y: Column, h: Column, x0: Column, x1: Column, obstacles: Column, limit: Column | None = None) -> Column:
    """The top of a box moved below every obstacle in its way: passes over all obstacles until none moves it, it ends below the
    limit, or JUMPS passes are done."""
    hit = lambda top, r: (x0 < r["x1"]) & (r["x0"] < x1) & (top < r["y1"]) & (top + h > r["y0"])
    once = lambda top: F.aggregate(obstacles, top, lambda t, r: F.when(hit(t, r), r["y1"] + MIN_GAP).otherwise(t))
    past = lambda t: F.lit(False) if limit is None else F.coalesce(t + h > limit, F.lit(False))
    start = F.struct(y.cast("double").alias("y"), F.lit(False).alias("done"))
    moved = lambda a: F.transform(F.array(once(a["y"])), lambda t: F.struct(t.alias("y"), ((t == a["y"]) | past(t)).alias("done")))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(JUMPS)), start, lambda a, _: F.when(a["done"], a).otherwise(moved(a)), lambda a: a["y"])


def scaled_heights(regions: DataFrame, region: list[str], measurer: M.Measurer) -> DataFrame:
    """Regions with `heights`: of each flowing paragraph of those that do not fit, its heights at all scales, from one request of its text."""
    asked = regions.where(~F.col("fits")).select(*region, F.explode("flow").alias("p"))
    sizes = F.transform(F.array(*map(F.lit, SCALES)), lambda scale: F.col("p.size") * scale)
    asked = asked.select(*region, "p.para", "p.text", "p.single_line", "p.indent", "p.leading", (F.col("p.x1") - F.col("p.x0")).alias("width"), sizes.alias("sizes"))
    found = M.measured_sizes(asked, "sizes", measurer)
    of = found.groupBy(*region).agg(F.transform(F.sort_array(F.collect_list(F.struct("para", "box_hs"))), lambda x: x["box_hs"]).alias("heights"))  # a region's
    return regions.join(store.dealt(of), region, "left")


def fit(placed: DataFrame, limit: DataFrame, region: list[str] = PAGE, obstacles: DataFrame | None = None, measurer: M.Measurer | None = None) -> DataFrame:
    """Placements of regions, squeezed where they end below the limit: size, y and h may change; with the region's scale, the share of
    its gaps that is kept, and what overflows even so.

    limit has a row a region: how far it may grow. Pinned paragraphs below the region's top are a floor, those above it a ceiling.
    Of seven scales the largest at which all flowing paragraphs end above the limit is taken, else the smallest. Gaps shrink first,
    later ones more. With obstacles (page, rect), a paragraph in the way of one moves below it. A region is one row with
    arrays of its paragraphs, folded without a further exchange.
    """
    row = F.struct("para", "text", "size", "single_line", "pinned", "indent", "leading", "x0", "x1", "y", "h")
    g = placed.groupBy(*region).agg(F.sort_array(F.collect_list(row)).alias("ps")).join(store.dealt(limit.select(*region, F.col("limit").alias("end"))), region)
    none = F.array().cast(f"array<{RECT}>")
    if obstacles is not None:
        o = obstacles.select(*PAGE, F.struct("rect.y0", "rect.x0", "rect").alias("o")).groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list("o")), lambda x: x["rect"]).alias("obstacles"))
        g = g.join(store.dealt(o), PAGE, "left").withColumn("obstacles", F.coalesce("obstacles", none))
    else:
        g = g.withColumn("obstacles", none)
    g = g.withColumn("flow", F.filter("ps", lambda p: ~p["pinned"])).withColumn("pins", F.filter("ps", lambda p: p["pinned"]))
    first = F.get("flow", F.lit(0))["y"]
    below = F.array_min(F.transform(F.filter("pins", lambda p: p["y"] > first), lambda p: p["y"] - MIN_GAP))
    above = F.array_max(F.transform(F.filter("pins", lambda p: p["y"] + p["h"] <= first + 1.0), lambda p: p["y"] + p["h"] + MIN_GAP))
    g = g.withColumn("top", F.greatest(first, above)).withColumn("end", F.least("end", below))
    bottom = F.array_max(F.transform("flow", lambda p: p["y"] + p["h"]))
    g = g.withColumn("fits", F.coalesce(bottom <= F.col("end"), F.lit(True))).withColumn("gaps", F.transform("flow", lambda p, k: F.when(k > 0, p["y"] - (F.get("flow", k - 1)["y"] + F.get("flow", k - 1)["h"]))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rest = F.filter("gaps", lambda x: x.isNotNull())
    loose = lambda x: F.greatest(F.lit(0.0), x - MIN_GAP)
    g = g.withColumn("slack", total(F.transform(rest, loose))).withColumn("least_gaps", total(F.transform(rest, lambda x: F.greatest(x, F.lit(MIN_GAP))))).withColumn("n_gaps", F.size(rest))

    if measurer is not None:
        g = scaled_heights(g, region, measurer)

    def laid(nth: Column) -> Column:
        """The region at a scale: heights, share of gaps kept, tops, and what overflows."""
        scale = F.get(F.array(*map(F.lit, SCALES)), nth)
        if measurer is None:
            heights = F.transform("flow", lambda p: box_height(p["x1"] - p["x0"], p["text"], p["size"] * scale, p["leading"]))
        else:
            heights = F.transform("heights", lambda hs: F.get(hs, nth))
        keep = lambda hs: F.when(F.col("slack") <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("end") - F.col("top") - total(hs) - F.col("least_gaps")) / F.col("slack") + 1)))

        def place(a: Column, k: Column, hs: Column, kept: Column) -> Column:
            gap = F.get("gaps", k)
            spent = F.when(k > 0, MIN_GAP + F.greatest(F.lit(0.0), gap - MIN_GAP - loose(gap) * (1 - kept) * (k / F.col("n_gaps")))).otherwise(0.0)
            p, h = F.get("flow", k), F.get(hs, k)
            moved = lambda y: F.when(F.size("obstacles") == 0, y).otherwise(clear_of(y, h, p["x0"], p["x1"], F.col("obstacles"), F.col("end")))
            return F.transform(F.array(moved(a["y"] + spent)), lambda y: F.struct((y + h).alias("y"), F.array_append(a["tops"], y).alias("tops")))[0]

        def whole(hs: Column, kept: Column) -> Column:
            start = F.struct(F.col("top").alias("y"), F.array().cast("array<double>").alias("tops"))
            done = F.aggregate(F.sequence(F.lit(0), F.size("flow") - 1), start, lambda a, k: place(a, k, hs, kept))
            return F.transform(F.array(done), lambda a: F.struct(scale.alias("scale"), kept.alias("keep"), hs.alias("hs"), a["tops"].alias("tops"), (a["y"] - F.col("end")).alias("over")))[0]

        return F.transform(F.array(heights), lambda hs: F.transform(F.array(keep(hs)), lambda kept: whole(hs, kept))[0])[0]

    kind = "struct<scale: double, keep: double, hs: array<double>, tops: array<double>, over: double>"
    best = F.aggregate(F.sequence(F.lit(0), F.lit(len(SCALES) - 1)), F.lit(None).cast(kind), lambda a, k: F.when(F.coalesce(a["over"] <= 0, F.lit(False)), a).otherwise(laid(k).cast(kind)))
    g = g.withColumn("best", F.when(~F.col("fits"), best)).drop("gaps")  # scales after the first good one are not worked out
    out = g.select(*region, F.posexplode(F.concat("flow", "pins")).alias("nth", "p"), "best", F.size("flow").alias("n_flow"))
    moves = F.col("best").isNotNull() & ~F.col("p.pinned")
    put = lambda new, old: F.when(moves, new).otherwise(old)
    return out.select(
        *region, "p.para", "p.text", put(F.col("p.size") * F.col("best.scale"), F.col("p.size")).alias("size"), "p.single_line", "p.pinned", "p.indent", "p.leading", "p.x0", "p.x1",
        put(F.get("best.tops", F.col("nth")), F.col("p.y")).alias("y"), put(F.get("best.hs", F.col("nth")), F.col("p.h")).alias("h"), F.coalesce("best.scale", F.lit(1.0)).alias("scale"),
        F.coalesce("best.keep", F.lit(1.0)).alias("keep"), F.greatest(F.lit(0.0), F.coalesce("best.over", F.lit(0.0))).alias("overflow"),
    )


def fit_page(placed: DataFrame, pages: DataFrame, measurer: M.Measurer | None = None) -> DataFrame:
    """The whole page as one region without obstacles, down to its bottom margin."""
    return fit(placed, pages.select(*PAGE, (F.col("rect.y1") - BOTTOM).alias("limit")), measurer=measurer)


def fit_events(put: DataFrame, region: list[str]) -> DataFrame:
    """What a run says of each region that was squeezed: what overflows even so, or at which scale it fits; nothing where smaller gaps did."""
    size = lambda c: F.format_string("%.2f", c)
    d = put.groupBy(*region).agg(F.max("overflow").alias("over"), F.min("scale").alias("scale"))
    over = F.concat(F.lit("  OVERFLOW: region content overflows by "), F.round("over", 0).cast("long").cast("string"), F.lit("pt even at "), size(F.col("scale")), F.lit("x font scale -- some text may be clipped"))
    scaled = F.concat(F.lit("  region content rescaled to "), size(F.col("scale")), F.lit("x to fit"))
    kind = F.when(F.col("over") > 0, "overflow").when(F.col("scale") < 1, "rescaled")
    return d.select(*region, kind.alias("kind"), F.when(F.col("over") > 0, over).otherwise(scaled).alias("message")).where("kind is not null")


def usable_cells(cells: DataFrame) -> DataFrame:
    """Cells with box, text and something to translate, their white space squeezed; inner is the box without its border."""
    d = cells.where(F.col("bbox").isNotNull() & F.col("text").isNotNull()).withColumn("text", X.squeeze(F.col("text")))
    d = d.withColumn("inner", G.grow(F.col("bbox"), -CELL_INSET))
    return d.where((F.col("text") != "") & ~X.is_not_text(F.col("text")) & ~G.is_empty(F.col("inner")))


def fit_size(text: Column, size: Column, inner: Column) -> Column:
    """The size at which a cell's text fits its inner box, which is inset once more: down by quarter points to 60 per cent, which is taken
    unchecked."""
    w, h = G.width(inner) - 2 * CELL_INSET, G.height(inner) - 2 * CELL_INSET
    good = F.filter(cell_tries(size), lambda s: box_height(w, text, s, F.lit(None).cast("double")) <= h)
    return F.coalesce(F.get(good, 0), CELL_SCALE * size)


def fit_cells(cells: DataFrame, size_col: str = "size") -> DataFrame:
    """Usable cells with the size at which they fit."""
    return usable_cells(cells).withColumn("fit_size", fit_size(F.col("text"), F.col(size_col), F.col("inner"))).drop("inner")


def cell_tries(size: Column) -> Column:
    """Sizes that a cell's text is tried at, from its own down by quarter points, above 60 per cent of it."""
    n = F.floor((size - CELL_SCALE * size) / CELL_STEP).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: size - k * CELL_STEP), lambda s: s > CELL_SCALE * size)


def measured_cells(cells: DataFrame, keys: list[str], measurer: M.Measurer) -> DataFrame:
    """Cells (text, size, inner) with the size at which they fit by a measurer, all sizes of all cells asked for at once."""
    w, h = G.width(F.col("inner")) - 2 * CELL_INSET, G.height(F.col("inner")) - 2 * CELL_INSET
    none = F.lit(None).cast("double")
    asked = cells.select(*keys, "text", w.alias("width"), h.alias("room"), F.lit(True).alias("single_line"), F.lit(0.0).alias("indent"), none.alias("leading"), F.explode(cell_tries(F.col("size"))).alias("size"))
    good = M.measured(asked, measurer).where("box_h <= room").groupBy(*keys).agg(F.max("size").alias("good"))
    return cells.join(store.dealt(good), keys, "left").withColumn("size", F.coalesce("good", CELL_SCALE * F.col("size"))).drop("good")
