"""Columns, spanning lines, obstacles, tables and reading order of pages.

Lines are placed in the row of their page, joins are equi-joins on the page with a range condition on top. A page is a
small, bounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..schema import PAGE
from ..sources import store

# Fixed values of the layout rules.
GUTTER_SHARE, GUTTER_PT, SPAN_LINE, COLUMN_SHARE, COLUMN_LINES, MIN_BODY = 0.035, 10.0, 0.60, 0.12, 3, 6
SPAN_GAP, SPAN_OVERLAP, SLACK = 8.0, 0.25, 1.0
RULE_THICKNESS, LEAST_AREA, MOST_AREA, TABLE_AREA = 3.0, 0.004, 0.85, 400.0
#: Rectangles of a page that are merged at once, and of a tile of a larger page.
PAGE_RECTS, TILE_RECTS = 50_000, 5_000
MERGE_PAD = {"drawing": 4.0, "image": 1.0, "table": 0.5}
#: Cells of a page, by the size of what stands in them, and how far from its origin they reach; what lies beyond stands in the last ones.
CELLS, FAR = (256.0, 2048.0), 20_000.0


def text_lines(lines: DataFrame, clip: Column | None = None) -> DataFrame:
    """Lines that hold spans; with a rectangle, those that meet it."""
    kept = lines.where(F.size("spans") > 0)
    return kept if clip is None else kept.where(G.intersects(F.col("bbox"), clip))


def page_columns(lines: DataFrame, row: Column, keys: list[str] = PAGE) -> DataFrame:
    """A row a page: the bounds of all its lines (area), its lines (ls, each with row's fields, bbox among them) and its columns (cols: lo, hi), from left to right.

    Narrow lines that are less than a gutter apart form a run; wide runs of several lines are columns. A page's lines are brought together
    once and looked at in their row, so that they are not sorted for each rule.
    """
    box = F.col("bbox")
    area = [f(box[a[1:]]).alias(a) for a, f in (("ax0", F.min), ("ay0", F.min), ("ax1", F.max), ("ay1", F.max))]
    d = lines.groupBy(*keys).agg(F.collect_list(row).alias("ls"), *area).withColumn("w", F.col("ax1") - F.col("ax0"))  # a page's lines
    narrow = F.filter(F.transform("ls", lambda l: l["bbox"]), lambda b: G.width(b) < SPAN_LINE * F.col("w"))
    ends = F.transform(narrow, lambda b: F.struct(F.floor(F.greatest(b["x0"], F.col("ax0"))).alias("lo"), F.ceil(F.least(b["x1"], F.col("ax1"))).alias("hi")))
    gutter = F.greatest(F.lit(GUTTER_PT), GUTTER_SHARE * F.col("w"))
    found = F.array().cast("array<struct<lo: double, hi: double>>")
    none = F.lit(None).cast("bigint")
    start = F.struct(found.alias("done"), none.alias("reach"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("bigint").alias("n"), none.alias("lo_before"), none.alias("hi_before"))

    def closed(a: Column) -> Column:
        run = F.struct(a["lo"].cast("double").alias("lo"), a["hi"].cast("double").alias("hi"))
        return F.when(is_column(a["lo"], a["hi"], a["n"]), F.array_append(a["done"], run)).otherwise(a["done"])

    def step(a: Column, b: Column) -> Column:
        same = (b["lo"] == a["lo_before"]) & (b["hi"] == a["hi_before"])  # equal lines stand in one run
        new = a["reach"].isNull() | ((b["lo"] - a["reach"] >= gutter) & ~same)
        now = lambda done, lo, hi, n: F.struct(done.alias("done"), F.greatest(a["reach"], b["hi"]).alias("reach"), lo.alias("lo"), hi.alias("hi"), n.cast("bigint").alias("n"), b["lo"].alias("lo_before"), b["hi"].alias("hi_before"))
        return F.when(new, now(closed(a), b["lo"], b["hi"], F.lit(1))).otherwise(now(a["done"], a["lo"], F.greatest(a["hi"], b["hi"]), a["n"] + 1))

    d = d.withColumn("ends", F.sort_array(ends))
    return d.withColumn("cols", F.when(F.size("ends") >= MIN_BODY, F.aggregate("ends", start, step, closed)).otherwise(found)).drop("ends")


def is_column(lo: Column, hi: Column, n: Column) -> Column:
    """A run is a column if it has width and lines of its own. A line's middle lies in its own run, and in no other, as a gutter is wider than the slack."""
    return (hi - lo >= COLUMN_SHARE * F.col("w")) & (n >= COLUMN_LINES)


def columns(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Columns (col_no, lo, hi) of pages that have at least two."""
    page = page_columns(lines, F.struct("bbox"), keys).where(F.size("cols") >= 2)
    return page.select(*keys, F.posexplode("cols").alias("k", "c")).select(*keys, (F.col("k") + 1).alias("col_no"), "c.lo", "c.hi")


def column_counts(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """How many columns each page has; a page without a split has one."""
    n = columns(lines, keys).groupBy(*keys).agg(F.count("*").alias("n"))
    return lines.select(*keys).distinct().join(store.dealt(n), keys, "left").select(*keys, F.coalesce("n", F.lit(1)).cast("int").alias("columns"))


def gutters(cols: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The bands between neighbouring columns."""
    nxt = F.lead("lo").over(Window.partitionBy(*keys).orderBy("col_no"))
    return cols.withColumn("x1", nxt).where("x1 is not null").select(*keys, "col_no", F.col("hi").alias("x0"), "x1")


def assigned(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Lines with their place: col_no (first column that holds the middle), spanning, and region parts.

    Spanning lines cover a quarter of two columns. They form blocks; bands lie between blocks. band_no, part (0 columns,
    1 block) and col_no order regions; a body line in no band or column has region_kind 'unassigned'. region_rect is the space
    of the line's region: of a column its width and its band's height, of a block the width of all lines and its own height, and
    where there are no columns the bounds of all lines. n_cols counts the page's columns.
    """
    box, own = F.col("bbox"), [c for c in ("line_no", "bbox", "spans") if c in lines.columns]
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    wide = lambda b: F.size(F.filter("cols", lambda c: (F.least(b["x1"], c["hi"]) - F.greatest(b["x0"], c["lo"])) > SPAN_OVERLAP * (c["hi"] - c["lo"]))) >= 2
    held = lambda c: G.mid_x(box).between(c["lo"] - SLACK, c["hi"] + SLACK)
    page = page_columns(lines, F.struct(*own), keys).withColumn("multi", F.size("cols") >= 2)
    across = F.transform(F.filter("ls", lambda l: wide(l["bbox"])), lambda l: F.struct(l["bbox"]["y0"].alias("y0"), l["line_no"].alias("line_no"), l["bbox"]["y1"].alias("y1")))
    page = page.withColumn("blocks", F.when(F.col("multi"), blocks_of(across, dict(lines.dtypes)["line_no"])).otherwise(blocks_of(None, dict(lines.dtypes)["line_no"])))
    d = page.select(*keys, "ax0", "ay0", "ax1", "ay1", "cols", "multi", "blocks", F.inline("ls"))
    d = d.withColumn("spanning", F.col("multi") & wide(box))
    d = d.withColumn("col_no", F.when(F.col("multi"), first(F.transform("cols", lambda c, k: F.when(held(c), k + 1)))))
    at = F.struct(box["y0"].alias("y0"), F.col("line_no").alias("line_no"))
    d = d.withColumn("block", F.when(F.col("spanning"), F.size(F.filter("blocks", lambda b: b["first"] <= at)).cast("bigint")))
    own_block = F.get("blocks", (F.col("block") - 1).cast("int"))
    d = d.withColumn("by0", own_block["by0"]).withColumn("by1", own_block["by1"])
    # bands end at blocks; the last one is open
    my, above = G.mid_y(box), lambda k: F.get("blocks", k - 1)["by1"]
    last = F.get("blocks", F.size("blocks") - 1)
    closed = F.transform("blocks", lambda b, k: F.when(((k == 0) | (my >= above(k))) & (my < b["by0"]), b["block"]))
    d = d.withColumn("band_no", F.coalesce(first(closed), F.when(my >= last["by1"], last["block"] + 1)))
    number = F.when(~F.col("multi"), 1).when(F.col("spanning"), F.col("block")).when(F.size("blocks") == 0, 1).otherwise(F.col("band_no"))
    out = d.withColumn("number", number.cast("int"))
    number, own_col = F.col("number"), F.get("cols", F.col("col_no") - 1)
    top = F.when(number > 1, F.get("blocks", number - 2)["by1"]).otherwise(F.col("ay0"))
    end = F.when(number <= F.size("blocks"), F.get("blocks", number - 1)["by0"]).otherwise(F.col("ay1"))
    space = F.when(~F.col("multi"), G.rect(*map(F.col, ("ax0", "ay0", "ax1", "ay1")))).when(F.col("spanning"), G.rect(F.col("ax0"), F.col("by0"), F.col("ax1"), F.col("by1")))
    space = space.otherwise(G.rect(own_col["lo"], top, own_col["hi"], end))
    lost = F.col("multi") & ~F.col("spanning") & (F.col("col_no").isNull() | number.isNull())
    kind = F.when(lost, "unassigned").when(F.col("spanning"), "spanning").otherwise("text")
    part = F.col("spanning").cast("int")
    col = F.when(F.col("spanning") | ~F.col("multi"), 0).otherwise(F.col("col_no"))
    shown = lambda c, name: F.when(~lost, c).alias(name)
    count = F.when(F.col("multi"), F.size("cols")).otherwise(1)
    return out.select(
        *keys, *own, shown(number.cast("bigint"), "band_no"), shown(part, "part"), shown(col, "region_col"), kind.alias("region_kind"), shown(space, "region_rect"),
        count.alias("n_cols"),
    )


def blocks_of(across: Column | None, line_no: str) -> Column:
    """Blocks (block, from 1, by0, by1, and where their first line stands) of a page's lines across columns (y0, line_no, y1): lines that follow each other closely."""
    empty = F.array().cast(f"array<struct<block: bigint, by0: double, by1: double, first: struct<y0: double, line_no: {line_no}>>>")
    if across is None:
        return empty

    def step(a: Column, l: Column) -> Column:
        last = F.get(a["done"], F.size(a["done"]) - 1)
        gap = l["y0"] - a["y1"]
        new = gap.isNull() | (gap > SPAN_GAP)
        block = lambda n, y0, y1, at: F.struct(n.cast("bigint").alias("block"), y0.alias("by0"), y1.alias("by1"), at.alias("first"))
        own = block(F.size(a["done"]) + 1, l["y0"], l["y1"], F.struct(l["y0"].alias("y0"), l["line_no"].alias("line_no")))
        longer = block(last["block"], F.least(last["by0"], l["y0"]), F.greatest(last["by1"], l["y1"]), last["first"])
        upto = F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0)))
        return F.struct(F.when(new, F.array_append(a["done"], own)).otherwise(F.array_append(upto, longer)).alias("done"), l["y1"].alias("y1"))

    start = F.struct(empty.alias("done"), F.lit(None).cast("double").alias("y1"))
    return F.aggregate(F.sort_array(across), start, step, lambda a: a["done"])


def regions(placed: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Text regions in reading order: band by band, columns from left to right, then the block below."""
    at = ["band_no", "part", "region_col"]
    r = placed.where("region_kind <> 'unassigned'").groupBy(*keys, *at).agg(F.first("region_rect").alias("rect"), F.count("*").alias("n_lines"), F.first("region_kind").alias("kind"), F.first("n_cols").alias("n_cols"))
    return r.withColumn("region_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*at)))


def with_tables(regs: DataFrame, tables: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Regions and tables in one order, numbered anew: a table stands before the first region that starts lower, after tables that start
    higher or further left. Text regions keep their band_no, part and region_col."""
    at = ["band_no", "part", "region_col"]
    lower = tables.select(*keys, "table_no", F.col("rect").alias("trect")).join(store.dealt(regs.select(*keys, F.col("region_no").alias("rn"), F.col("rect").alias("rrect"))), keys, "left")
    slot = lower.groupBy(*keys, "table_no", "trect").agg(F.min(F.when(F.col("rrect.y0") > F.col("trect.y0"), F.col("rn"))).alias("slot"))
    none = [F.lit(None).cast(dict(regs.dtypes)[c]).alias(c) for c in at]
    sort = lambda k, t, r, n: [k.cast("int").alias("k1"), t.alias("k2"), r["y0"].alias("k3"), r["x0"].alias("k4"), n.cast("int").alias("table_no")]
    rows = slot.select(*keys, F.lit("table").alias("kind"), F.col("trect").alias("rect"), *none, *sort(F.coalesce("slot", F.lit(1 << 30)), F.lit(0), F.col("trect"), F.col("table_no")))
    rows = rows.unionByName(regs.select(*keys, "kind", "rect", *at, *sort(F.col("region_no"), F.lit(1), F.col("rect"), F.lit(None))))
    order = Window.partitionBy(*keys).orderBy("k1", "k2", "k3", "k4", "table_no")
    return rows.withColumn("region_no", F.row_number().over(order)).drop("k1", "k2", "k3", "k4")


def usable_tables(tables: DataFrame) -> DataFrame:
    r = F.col("rect")
    return tables.where(~G.is_empty(r) & (G.area(r) >= TABLE_AREA) & (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2))


def outside(rows: DataFrame, blockers: DataFrame, box: str = "rect", blocker_box: str = "rect", keys: list[str] = PAGE) -> DataFrame:
    """Rows whose box meets no blocker of the page; a page's rows stay together, as its lines have to."""
    b = blockers.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(blocker_box).alias("__r"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(store.dealt(b), cond & G.intersects(F.col(box), F.col("__r")), "left_anti")


def outside_by_cells(rows: DataFrame, blockers: DataFrame, box: str = "rect", blocker_box: str = "rect", keys: list[str] = PAGE) -> DataFrame:
    """What `outside` gives, for pages of any number of rows: a page is cut into cells, so that it is shared among tasks. A row stands in one
    cell, that of its first corner on the finest grid whose cells are not smaller than it is (the largest rows stand together); a blocker goes to
    the cells of each grid whose rows can reach it, of which there are 26,000 at most."""
    r, b = F.col(box), F.col(blocker_box)
    near = lambda c: F.least(F.greatest(c, F.lit(-FAR)), F.lit(FAR))
    at = lambda c, cell: F.floor(near(c) / cell)
    place = lambda grid, x, y: F.struct(F.lit(grid).alias("grid"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    size = F.greatest(near(r["x1"]) - near(r["x0"]), near(r["y1"]) - near(r["y0"]))
    last = len(CELLS)
    own, reached = place(last, F.lit(0), F.lit(0)), [F.array(place(last, F.lit(0), F.lit(0)))]
    for grid, cell in reversed(list(enumerate(CELLS))):
        own = F.when(size <= cell, place(grid, at(r["x0"], cell), at(r["y0"], cell))).otherwise(own)
        xs, ys = (F.sequence(at(b[f"{c}0"], cell) - 1, at(b[f"{c}1"], cell)) for c in "xy")
        reached.append(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: place(grid, x, y)))))  # noqa: B023
    every = blockers.where(b.isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], b.alias("__r"), F.explode(F.concat(*reached)).alias("__cell"))
    cond = own == F.col("__cell")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return rows.join(store.dealt(every), cond & G.intersects(r, F.col("__r")), "left_anti")


def plausible_drawings(drawings: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    r = F.col("rect")
    white = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    invisible = F.coalesce(F.col("fill") == white, F.lit(False)) & (F.col("color").isNull() | (F.col("color") == white))
    kept = drawings.where(~G.is_empty(r) & (F.least(G.width(r), G.height(r)) > RULE_THICKNESS) & ~invisible)
    return outside_by_cells(kept, tables) if tables is not None else kept


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0..n-1 that each reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _meeting(group: np.ndarray, box: np.ndarray, pad: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rectangles of one group that meet when one is grown by pad: a sweep over left edges, some pairs at a time. Rows are sorted
    by group and left edge."""
    span = box[:, 2].max() - box[:, 0].min() + pad + 1
    left = group * span + (box[:, 0] - box[:, 0].min())
    ends = np.maximum(np.searchsorted(left, left + (box[:, 2] - box[:, 0]) + pad, side="left"), np.arange(1, len(box) + 1))
    many = ends - np.arange(1, len(box) + 1)
    i = 0
    while i < len(box):
        j = max(i + 1, int(np.searchsorted(np.cumsum(many[i:]), most, side="right")) + i)
        a = np.repeat(np.arange(i, j), many[i:j])
        b = np.arange(len(a)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + a + 1
        p, q = box[a], box[b]
        meet = (group[a] == group[b]) & (p[:, 0] - pad < q[:, 2]) & (q[:, 0] < p[:, 2] + pad) & (p[:, 1] - pad < q[:, 3]) & (q[:, 1] < p[:, 3] + pad)
        yield a[meet], b[meet]
        i = j


def unions(group: np.ndarray, box: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """The coarsest partition of each group's rectangles in which no two unions meet when one is grown by pad: groups and unions,
    sorted. Pieces that meet become their union, until none do; many groups go through together."""
    while True:
        order = np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], group))
        group, box = group[order], box[order]
        if not len(box):
            return group, box
        pairs = [np.concatenate(x) for x in zip(*_meeting(group, box, pad), strict=True)]
        first, of = np.unique(_roots(len(box), *pairs), return_inverse=True)
        if len(first) == len(box):
            return group, box
        joined = np.stack([np.full(len(first), v) for v in (np.inf, np.inf, -np.inf, -np.inf)], axis=1)
        for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
            f.at(joined[:, k], of, box[:, k])
        group, box = group[first], joined


def merge_rects(rects: list[tuple[float, float, float, float]], pad: float) -> list[tuple[float, float, float, float]]:
    """Unions of rectangles of one page."""
    box = np.array(rects, dtype=float).reshape(-1, 4)
    return [tuple(r) for r in unions(np.zeros(len(box), dtype=np.int64), box, pad)[1].tolist()]


def _linked(pad: float, keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of tiles (keys, tile, rects with their ids), all of a batch at once: each rectangle's id with the smallest that it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(keys)
            group = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths(), dtype=np.int64))
            flat = lists.flatten()
            ids = np.asarray(flat.field(0), dtype=np.int64)
            box = np.stack([np.asarray(flat.field(k), dtype=float) for k in range(1, 5)], axis=1) if len(flat) else np.zeros((0, 4))
            order = np.lexsort((ids, box[:, 0], group))
            group, ids, box = group[order], ids[order], box[order]
            root = np.zeros(0, dtype=np.int64)
            if len(ids):
                pairs = [np.concatenate(x) for x in zip(*_meeting(group, box, pad), strict=True)]
                part = _roots(len(ids), *pairs)
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, part, ids)
                root = least[part]
            at = pa.array(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(keys)), pa.array(ids), pa.array(root)], names=[*batch.schema.names[:keys], "id", "root"])

    return run


def tiled_unions(rows: DataFrame, pad: float, keys: list[str] = PAGE, tile_rects: int = TILE_RECTS) -> DataFrame:
    """What `unions` gives, for pages of any number of rectangles: (keys, k, x0, y0, x1, y1). A page is cut into tiles of about tile_rects
    rectangles, each of which goes to all tiles that it meets when grown. In a tile those that hang together take the smallest id among them, a
    rectangle in several tiles the smallest of theirs, and all of one id become their union; so on until no id changes. A link over a border
    is found by the rectangle that lies on both sides."""
    edge = ["x0", "y0", "x1", "y1"]
    now = store.written(rows.select(*keys, F.monotonically_increasing_id().alias("id"), *[F.col(f"rect.{e}").alias(e) for e in edge]), "unions")
    while True:
        page = now.groupBy(*keys).agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"), F.ceil(F.sqrt(F.count("*") / tile_rects)).alias("side"))
        d = now.join(store.dealt(page), keys)
        at = lambda c, low, high, by: F.least(F.greatest(F.floor((c + by - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9)) * F.col("side")), F.lit(0)), F.col("side") - 1)
        span = lambda a, b, low, high: F.explode(F.sequence(at(F.col(a), low, high, -pad), at(F.col(b), low, high, pad)))
        d = d.withColumn("tx", span("x0", "x1", "left", "right")).withColumn("ty", span("y0", "y1", "top", "bottom"))
        tiles = d.groupBy(*keys, "tx", "ty").agg(F.collect_list(F.struct("id", *edge)).alias("rects")).select(*keys, "rects")  # a tile's
        types = dict(now.dtypes)
        schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "id bigint, root bigint"])
        roots = tiles.mapInArrow(_linked(pad, len(keys)), schema).groupBy(*keys, "id").agg(F.min("root").alias("root"))
        after = now.join(store.dealt(roots), [*keys, "id"]).groupBy(*keys, "root").agg(*[f(e).alias(e) for f, e in zip((F.min, F.min, F.max, F.max), edge, strict=True)], F.count("*").alias("n"))
        after = store.written(after, "unions")
        settled = after.where("n > 1").isEmpty()
        store.drop(now)
        if settled:
            order = Window.partitionBy(*keys).orderBy(*edge)
            return after.select(*keys, (F.row_number().over(order) - 1).cast("int").alias("k"), *edge)
        now = store.written(after.select(*keys, F.col("root").alias("id"), *edge), "unions")
        store.drop(after)


def merged(rows: DataFrame, kind: str, keys: list[str] = PAGE, most: int = PAGE_RECTS) -> DataFrame:
    """Obstacles (kind, k, rect): the unions of each page's rectangles, all pages of a batch at once; pages with more than `most` go by tiles."""
    pad = MERGE_PAD[kind]
    large = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys)
    box = G.rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("rect")
    if not large.isEmpty():
        large = store.written(large, "large-pages")
        tiled = tiled_unions(rows.join(large, keys, "left_semi"), pad, keys).select(*keys, F.lit(kind).alias("kind"), "k", box)
        return _merged(rows.join(large, keys, "left_anti"), kind, keys, pad).unionByName(tiled)
    return _merged(rows, kind, keys, pad)


def _merged(rows: DataFrame, kind: str, keys: list[str], pad: float) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
            flat = lists.flatten()
            box = np.stack([np.asarray(flat.field(k), dtype=float) for k in range(4)], axis=1) if len(flat) else np.zeros((0, 4))
            page, box = unions(np.repeat(np.arange(batch.num_rows), sizes), box, pad)
            at = pa.array(page)
            number = np.arange(len(page)) - np.searchsorted(page, page)
            cols = [batch.column(k).take(at) for k in range(len(keys))] + [pa.array(number, pa.int32()), *(pa.array(box[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "k", "x0", "y0", "x1", "y1"])

    page = rows.groupBy(*keys).agg(F.collect_list("rect").alias("rects"))  # a page's drawings
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "k int, x0 double, y0 double, x1 double, y1 double"])
    return page.mapInArrow(run, schema).select(*keys, F.lit(kind).alias("kind"), "k", G.rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("rect"))


def sized_obstacles(obstacles: DataFrame, pages: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Obstacles (kind, k, rect) that take a plausible share of the page, numbered from the top left."""
    p = pages.select(*keys, F.col("rect").alias("page_rect"))
    share = G.area(F.col("rect")) / G.area(F.col("page_rect"))
    kept = obstacles.join(store.dealt(p), keys).where(share.between(LEAST_AREA, MOST_AREA)).drop("page_rect")
    return kept.withColumn("obstacle_no", F.row_number().over(Window.partitionBy(*keys).orderBy("rect.y0", "rect.x0", "kind", "k"))).drop("k")


def obstacles(pages: DataFrame, drawings: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame | None:
    """What text must not cover: merged images and merged drawings outside tables, of plausible size."""
    parts = []
    if images is not None:
        parts.append(merged(images.where(F.col("rect").isNotNull()), "image"))
    if drawings is not None:
        parts.append(merged(plausible_drawings(drawings, tables), "drawing"))
    if not parts:
        return None
    return sized_obstacles(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), pages)
