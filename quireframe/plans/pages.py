"""Whole pages: from lines, drawings, images and tables to regions, and from there to placements, redactions and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import geometry as G, text as X
from ..operators import cells as C, ingest as I, layout as L, measure as M, paragraphs as P, reflow as R, translate as T
from ..schema import PAGE
from ..sources import store

REGION = ["band_no", "part", "region_col"]


@dataclass(frozen=True)
class Analysis:
    """A page's free lines with their places, its regions and tables in reading order, its obstacles and tables."""

    pages: DataFrame
    lines: DataFrame
    placed: DataFrame
    regions: DataFrame
    obstacles: DataFrame | None
    tables: DataFrame | None


def analyze(lines: DataFrame, pages: DataFrame, drawings: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None) -> Analysis:
    """Lines that meet a table belong to it; the others form regions, among which the tables stand by their height. Placed lines are
    written, since regions, paragraphs and counts all start from them."""
    lines = L.text_lines(lines)
    usable = L.usable_tables(tables) if tables is not None else None
    placed = store.written(L.assigned(L.outside(lines, usable, box="bbox") if usable is not None else lines), "placed-lines")
    regions = L.regions(placed)
    if usable is not None:
        regions = L.with_tables(regions, usable)
    else:
        regions = regions.withColumn("table_no", F.lit(None).cast("int"))
    return Analysis(pages, lines, placed, regions.select(*PAGE, "region_no", "kind", "rect", *REGION, "table_no"), L.obstacles(pages, drawings, images, usable), usable)


def report(a: Analysis, texts: bool = True) -> DataFrame:
    """One row a page, those without lines too: paragraphs, near-empty ones, regions, columns, obstacles, tables, body size, margin. All
    that is counted stands in one table of (page, what), which is grouped once. Without texts, no paragraph is made."""
    own = F.col("region_kind") != "unassigned"
    values = {"x0": "double", "n_cols": "int", "size": "double", "near": "boolean"}

    def rows(d: DataFrame, what: str, **known: Column) -> DataFrame:
        return d.select(*PAGE, F.lit(what).alias("what"), *[known.get(v, F.lit(None)).cast(t).alias(v) for v, t in values.items()])

    every = rows(a.pages, "page").unionByName(rows(a.placed, "line", x0=F.when(own, F.round(F.col("bbox.x0"), 1)), n_cols=F.col("n_cols")))
    if texts:
        para = P.paragraphs(a.placed.where(own), [*PAGE, *REGION])
        every = every.unionByName(rows(para, "paragraph", size=F.col("size"), near=X.near_empty(F.col("text"))))
    for name, some in (("region", a.regions), ("obstacle", a.obstacles), ("table", a.tables)):
        if some is not None:
            every = every.unionByName(rows(some, name))
    n = lambda what, name: F.count_if(F.col("what") == what).alias(name)
    out = every.groupBy(*PAGE).agg(
        n("paragraph", "paragraphs"), F.count_if("near").alias("near_empty"), n("region", "regions"), F.coalesce(F.max("n_cols"), F.lit(1)).cast("bigint").alias("columns"),
        n("obstacle", "obstacles"), n("table", "tables"), F.max("size").alias("body_size"), F.mode("x0", True).alias("modal_margin"), n("page", "pages"),
    )
    return out.where("pages > 0").drop("pages")


#: The levels of a report, from the finest to all.
LEVELS = [("doc_id", "page_no", "kind"), ("doc_id", "page_no"), ("doc_id", "kind"), ("doc_id",), ("kind",), ()]


def report_levels(a: Analysis) -> DataFrame:
    """Regions with their paragraphs and letters, summed at each of LEVELS in one pass; level tells them apart (a bit for each of doc_id, page_no
    and kind that is summed over)."""
    para = P.paragraphs(a.placed.where("region_kind <> 'unassigned'"), [*PAGE, *REGION]).groupBy(*PAGE, *REGION).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))
    each = a.regions.select(*PAGE, "kind", *REGION).join(store.dealt(para), [*PAGE, *REGION], "left")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = [[F.col(c) for c in level] for level in LEVELS]
    return each.groupingSets(by, "doc_id", "page_no", "kind").agg(F.grouping_id("doc_id", "page_no", "kind").alias("level"), F.count("*").alias("regions"), of("n").alias("paragraphs"), of("letters").alias("chars"))


@dataclass(frozen=True)
class Translation:
    """Where which text goes, what is erased before that, what the run says in order (`in_order`), and what was counted while its tables were
    written, with no job of its own."""

    placements: DataFrame
    redactions: DataFrame
    events: DataFrame
    metrics: dict[str, int]


#: The order of what is said of a document: its title after its pages, a page's line before its regions', a region's own after its texts'.
ORDER = ["stage", "page_no", "region_no", "row_idx", "col_idx", "nth"]


def in_order(events: DataFrame) -> DataFrame:
    """Events of each document as its log has them."""
    return events.orderBy("doc_id", *[F.asc_nulls_last(c) for c in ORDER])


def lines_of(events: DataFrame, kind: str | None = None, stage: int = 1, **known: Column) -> DataFrame:
    """Events of one kind of source with all columns of the log; what they have no value for is null."""
    types = {"page_no": "int", "region_no": "int", "row_idx": "bigint", "col_idx": "int", "nth": "bigint"}
    cols = [known.get(c, F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return events.select("doc_id", F.lit(stage).alias("stage"), *cols, (F.lit(kind) if kind else F.col("kind")).alias("kind"), "message")


def page_lines(a: Analysis, reports: DataFrame) -> DataFrame:
    """The line that begins a page: its number, which of how many it is, and what stands on it."""
    d = ordinals(a.pages).join(store.dealt(reports), PAGE)
    n = lambda c, what: [F.col(c).cast("string"), F.lit(f" {what}(s)")]
    text = F.concat(
        F.lit("--- page "), (F.col("page_no") + 1).cast("string"), F.lit(" ("), F.col("nth").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(") --- "),
        *n("regions", "region"), F.lit(", "), *n("columns", "column"), F.lit(", "), *n("obstacles", "obstacle"), F.lit(", "), *n("tables", "table"),
    )
    return lines_of(d.select(*PAGE, text.alias("message")), "page", region_no=F.lit(-1))


def paragraphs(a: Analysis, reformat: bool = False) -> DataFrame:
    """Paragraphs of text regions that hold any text, with region_no, whether they are page furniture, and the right edge that a
    single line may widen to. Markers are told by the size of the whole page's text."""
    own = a.placed.where("region_kind <> 'unassigned'")
    size = P.dominant_size(own).withColumnRenamed("dominant", "page_dominant")
    para = P.paragraphs(own.join(store.dealt(size), PAGE), [*PAGE, *REGION], dehyphenate=not reformat, dominant="page_dominant")
    para = para.withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    columns = a.placed.groupBy(*PAGE).agg(F.max("n_cols").alias("n_cols"))
    regions = a.regions.where("table_no is null").select(*PAGE, *REGION, "region_no", F.col("rect").alias("region_rect"))
    para = para.join(store.dealt(columns), PAGE).join(store.dealt(a.pages.select(*PAGE, F.col("rect.x1").alias("page_x1"))), PAGE)
    para = P.furniture(para, a.pages).join(store.dealt(regions), [*PAGE, *REGION])
    para = para.withColumn("slack_x1", F.when(F.col("n_cols") > 1, F.col("region_rect.x1")).otherwise(F.col("page_x1")))
    return para.drop(*REGION, "region_rect", "n_cols", "page_x1")


def translate(
    a: Analysis, cells: DataFrame | None = None, backend: T.Backend = T.identity, temperature: float = 0.3, reformat: bool = False, measurer: M.Measurer | None = None
) -> Translation:
    """Paragraphs go through the backend, flow in their regions and are fitted below obstacles and above whatever comes next; cells are
    fitted into their boxes. With reformat nothing is asked for, and cells stay as they are. Answers are written before anything reads
    them, so the backend is asked once; so are the fitted places, from which both placements and events come."""
    region = [*PAGE, "region_no"]
    para = paragraphs(a, reformat)
    if reformat:
        done, metrics = para.withColumn("output", F.col("text")), {}
    else:
        seen = Observation("translated")
        every = T.translated(para, backend, temperature)
        asked = ~F.col("skipped")
        every = every.observe(seen, F.count("*").alias("paragraphs"), F.count_if(asked).alias("asked"), F.count_if(F.col("calls") > 1).alias("retried"), F.count_if(F.col("reason").isNotNull()).alias("bad"),
                              F.count_if(F.exists("tries", lambda t: t["cut"].isNotNull())).alias("cut"))
        done = store.written(every, "translated")
        metrics = dict(seen.get)
    limit = R.ceilings(a.regions, a.pages).join(store.dealt(a.pages.select(*PAGE, F.col("rect.y1").alias("page_y1"))), PAGE)
    limit = limit.select(*region, F.least("limit", F.col("page_y1") - R.BOTTOM).alias("limit"))
    flowed = R.reflow(done.withColumn("text", F.col("output")), region, reformat, measurer)
    seen = Observation("fitted")
    put = R.fit(flowed, limit, region, a.obstacles, measurer).observe(seen, F.count("*").alias("placed"), F.count_if(F.col("scale") < 1).alias("scaled"), F.count_if(F.col("overflow") > 0).alias("overflowing"))
    put = store.written(put, "fitted")
    metrics |= seen.get
    box = G.rect(F.col("x0"), F.col("y"), F.col("x1"), F.col("y") + F.col("h"))
    cols = lambda kind, number, rect, pinned: [*PAGE, F.lit(kind).alias("kind"), *number, "text", rect.alias("rect"), "size", pinned.alias("pinned")]
    nth = lambda x, y, z: [c.cast("int").alias(n) for c, n in ((x, "region_no"), (y, "para"), (z, "col_idx"))]
    no = F.lit(None)
    placements = put.select(*cols("text", nth(F.col("region_no"), F.col("para"), no), box, F.col("pinned")))
    sources = done.select(*PAGE, F.col("bbox").alias("rect"))
    events = page_lines(a, report(a, texts=False)).unionByName(lines_of(R.fit_events(put, region)))
    if not reformat:
        events = events.unionByName(lines_of(T.events(done, region), row_idx=F.col("para")))
    if cells is not None and not reformat:
        own = C.translated(cells.join(store.dealt(a.tables.select(*PAGE, "table_no")), [*PAGE, "table_no"], "left_semi"), a.lines, backend, temperature, measurer)
        own = store.written(own, "translated-cells")
        at = a.regions.where("table_no is not null").select(*PAGE, "table_no", "region_no")
        good = own.where("reason is null").withColumn("text", F.col("answer")).join(store.dealt(at), [*PAGE, "table_no"])
        placements = placements.unionByName(good.select(*cols("cell", nth(F.col("region_no"), F.col("row_idx"), F.col("col_idx")), F.col("inner"), F.lit(True))))
        events = events.unionByName(lines_of(C.events(own, at).join(store.dealt(at), [*PAGE, "table_no"])))
    rects = sources.unionByName(placements.select(*PAGE, "rect"))
    return Translation(placements, redactions(rects, a.pages, a.obstacles), events, metrics)


@dataclass(frozen=True)
class Run:
    """A run over documents: their titles, and what came of each (success or unsupported, with why), beside what a Translation has."""

    translation: Translation
    titles: DataFrame
    outcomes: DataFrame


def run(
    docs: DataFrame, tables: dict[str, DataFrame], backend: T.Backend = T.identity, temperature: float = 0.0, reformat: bool = False, measurer: M.Measurer | None = None, use_tables: bool = True,
) -> Run:
    """Documents (doc_id, path, title, needs_pass) with their layout tables (`sources.decode.tables`). Those that cannot be worked on, as they are
    locked, have no pages or no text, are turned down before any model is asked; of those with little text a warning is said."""
    page_texts = tables["lines"].groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", X.line_text(F.col("spans")).alias("t")))), lambda r: r["t"]), "\n").alias("text"))  # a page's
    own = docs.select("doc_id", "path", F.coalesce("needs_pass", F.lit(False)).alias("needs_pass"))
    seen = own.join(tables["pages"].select(*PAGE), "doc_id", "left").join(page_texts, PAGE, "left")
    checked = store.written(I.preflight(seen).join(own, "doc_id"), "preflight")
    outcomes = checked.select("doc_id", F.when(F.col("verdict") == "unsupported", "unsupported").otherwise("success").alias("outcome"), I.preflight_message().alias("message"))
    good = checked.where("verdict <> 'unsupported'").select("doc_id")
    t = {name: d.join(good, "doc_id", "left_semi") for name, d in tables.items()}
    a = analyze(t["lines"], t["pages"], t.get("drawings"), t.get("images"), t.get("tables") if use_tables else None)
    done = translate(a, t.get("cells") if use_tables else None, backend, temperature, reformat, measurer)
    warned = lines_of(checked.where("verdict <> 'ok'").select("doc_id", I.preflight_message().alias("message")), "warning", 0)
    titles = docs.join(good, "doc_id", "left_semi").select("doc_id", "title")
    if reformat:
        titles = titles.withColumn("translated", F.lit(False))
        events = done.events.unionByName(warned)
    else:
        asked = store.written(T.titles(titles, backend, temperature), "titles")
        titles = asked.drop("message")
        events = done.events.unionByName(warned).unionByName(lines_of(asked.where("message is not null"), "title", 2))
    return Run(Translation(done.placements, done.redactions, events, done.metrics), titles, outcomes)


def redactions(rects: DataFrame, pages: DataFrame, obstacles: DataFrame | None = None) -> DataFrame:
    """Rectangles to be erased: grown by a point, cut at the page's edges, without those that meet an obstacle."""
    grown, page = G.grow(F.col("rect"), 1.0), F.col("page")
    d = rects.join(store.dealt(pages.select(*PAGE, F.col("rect").alias("page"))), PAGE)
    d = d.select(*PAGE, G.meet(grown, page).alias("rect"))
    d = d.where(~G.is_empty(F.col("rect")))
    return L.outside_by_cells(d, obstacles) if obstacles is not None else d


def ordinals(pages: DataFrame) -> DataFrame:
    """Pages with their place in their document and how many there are."""
    doc = Window.partitionBy("doc_id")
    return pages.select(*PAGE, F.row_number().over(doc.orderBy("page_no")).alias("nth"), F.count("*").over(doc).alias("of"))
