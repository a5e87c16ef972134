"""Lines to paragraphs: size and margin statistics, sequential rules as windows, joining of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as X
from ..schema import PAGE
from ..sources import store

FALLBACK_SIZE, MARGIN_STEP, GAP_TIMES, SIZE_STEP, SAME_ROW = 10.0, 4.0, 1.7, 1.5, 2.0


def dominant_size(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Per group: the size with the most characters; of equals the one seen first."""
    spans = lines.select(*keys, "line_no", F.posexplode("spans").alias("k", "s"))
    sums = spans.groupBy(*keys, F.col("s.size").alias("size")).agg(F.sum(F.length("s.text")).alias("n"), F.min(F.struct("line_no", "k")).alias("seen"))
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "seen")
    return sums.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, F.col("size").alias("dominant"))


def modal_margin(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Per group: the most frequent left edge; of equals the smallest."""
    return lines.groupBy(*keys).agg(F.mode(F.round(F.col("bbox.x0"), 1), True).alias("margin"))


def numbered(lines: DataFrame, keys: list[str] = PAGE, dominant: str | None = None) -> DataFrame:
    """Paragraphs of each group (para, and its lines in order, ls), with the group's dominant size. dominant names a column with the dominant
    size of something larger than the group, as of its page.

    A paragraph starts at a line of a new row that is indented, starts with a marker, changes size, or follows a gap. A group's lines are
    brought together once and cut in their row, so that no text is sorted or shuffled after that.
    """
    box = F.col("bbox")
    line = F.struct(F.round(box["y0"], 1).alias("y"), F.round(box["x0"], 1).alias("x"), "line_no", "bbox", X.span_parts(F.col("spans")).alias("parts"))
    page = lines.groupBy(*keys).agg(F.collect_list(line).alias("ls"), F.mode(F.round(box["x0"], 1), True).alias("margin"), *([F.first(dominant).alias("dominant")] if dominant else []))  # a group's lines
    none = F.array().cast("array<struct<size: double, n: int>>")
    votes = F.transform("ls", lambda r: F.struct(r["line_no"], r["bbox"], F.coalesce(F.transform(r["parts"], lambda p: F.struct(p["size"], p["n"])), none).alias("votes")))
    page = page if dominant else page.withColumn("dominant", X.dominant_size(F.flatten(F.transform(F.sort_array(votes), lambda r: r["votes"]))))

    def shown(r: Column) -> Column:
        is_marker = lambda p: X.part_marker(p, F.col("dominant")).isNotNull()
        body = X.dominant_size(F.filter(r["parts"], lambda p: ~is_marker(p)))
        marked = F.coalesce(is_marker(F.get(F.filter(r["parts"], lambda p: p["shown"]), 0)), F.lit(False))
        return F.struct(r["x"].alias("x"), r["bbox"].alias("bbox"), r["parts"].alias("parts"), body.alias("body"), marked.alias("marked"))

    page = page.withColumn("ls", F.transform(F.sort_array("ls"), shown))
    known = lambda k: F.filter(F.transform(F.slice("ls", F.lit(1), k), lambda r: r["body"]), lambda z: z.isNotNull())
    size_before = lambda k: F.coalesce(F.get("ls", k - 1)["body"], X.bound(known(k), lambda zs: F.get(zs, F.size(zs) - 1)))

    def start(r: Column, k: Column) -> Column:
        y0, before = r["bbox"]["y0"], F.get("ls", k - 1)["bbox"]
        starts = X.any_of([
            r["x"] > F.col("margin") + MARGIN_STEP, r["marked"], F.coalesce(F.abs(r["body"] - size_before(k)) > SIZE_STEP, F.lit(False)),
            y0 - before["y1"] > GAP_TIMES * F.coalesce(r["body"], F.col("dominant")),
        ])
        return F.when(before["y0"].isNull() | ((F.abs(y0 - before["y0"]) >= SAME_ROW) & starts), k)

    page = page.withColumn("starts", F.array_compact(F.transform("ls", start)))
    cut = F.transform("starts", lambda s, k: F.struct((k + 1).cast("bigint").alias("para"), F.slice("ls", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ls")) - s).alias("ls")))
    return page.select(*keys, "dominant", F.inline(cut))


def paragraphs(lines: DataFrame, keys: list[str] = PAGE, dehyphenate: bool = True, dominant: str | None = None) -> DataFrame:
    """One row a paragraph: text, box, size, whether it is a single line, indent, leading."""
    g = numbered(lines, keys, dominant)
    body = F.flatten(F.transform("ls", lambda r: F.filter(r["parts"], lambda p: X.part_marker(p, F.col("dominant")).isNull())))
    size = F.coalesce(X.dominant_size(body), F.col("dominant"), F.lit(FALLBACK_SIZE))
    n = F.size("ls")
    y = lambda k: F.get("ls", k)["bbox"]["y0"]
    edge = lambda f, c: f(F.transform("ls", lambda r: r["bbox"][c]))
    bbox = G.rect(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    steps = F.when(n > 1, F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda k: y(k) - y(k - 1)), lambda v: v > 0)).otherwise(F.array().cast("array<double>"))
    text = X.tidy_squeezed(X.join_lines(F.transform("ls", lambda r: X.squeeze(X.parts_text(r["parts"], F.col("dominant")))), dehyphenate))
    g = g.select(*keys, "para", text.alias("text"), bbox.alias("bbox"), size.alias("size"), F.array_sort(steps).alias("steps"), (n == 1).alias("single_line"), F.get("ls", 0)["bbox"]["x0"].alias("first_x0"))
    middle = F.get("steps", F.floor(F.size("steps") / 2).cast("int"))  # the upper median
    leading = F.when(~F.col("single_line") & (F.col("size") > 0), F.round(middle / F.col("size"), 3))
    indent = F.when(F.col("single_line"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.col("first_x0") - F.col("bbox.x0")), 1))
    return g.select(*keys, "para", "text", "bbox", "size", "single_line", indent.alias("indent"), leading.alias("leading"))


def furniture(para: DataFrame, pages: DataFrame) -> DataFrame:
    """Paragraphs with `pinned`: short single lines in the head or foot band of the page."""
    band = (F.col("bbox.y1") <= 0.12 * G.height(F.col("rect"))) | (F.col("bbox.y0") >= 0.88 * G.height(F.col("rect")))
    joined = para.join(store.dealt(pages.select(*PAGE, "rect")), PAGE)
    return joined.withColumn("pinned", band & F.col("single_line") & (F.length(X.strip(F.col("text"))) < 80)).drop("rect")


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))
