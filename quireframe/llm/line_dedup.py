"""Line dedup by site-relative frequency, in DataFrame operations only.

For each host, the share of its documents that contain a line is set against a boilerplate ratio; lines above
it are dropped wherever the host shows them. A host has fewer such lines than (distinct lines per document) /
ratio, so they fit in one array a host; documents meet them by a join on the host and a salt, of which a host has more the
more documents it has, so that a host of any size is dealt over many tasks (or Spark broadcasts the arrays after measuring
their size).

Defined results: a null text stays null with 0 lines; a null host is a host of its own; blank lines are never dropped;
a line counts once a document, however often it stands there; equal rows are documents of their own; a
host of fewer than `min_pages` documents with the line drops nothing; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

RATIO, MIN_PAGES = 0.2, 5
#: A task gets so many documents of a host, or a share of all documents so large that MOST_BIG hosts at most exceed it.
TASK_PAGES, MOST_BIG = 1000, 10_000


def _prints(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(docs: DataFrame, total: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host that has any: the prints of its boilerplate lines. total has each host's number of pages."""
    base = docs.select(docs[host_col].alias("of"), docs[text_col].alias("text"))
    lines = base.select("of", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    seen = lines.groupBy("of", _prints(F.col("line")).alias("print")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    seen = seen.join(total, F.col("of").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("pages") * ratio)
    return seen.groupBy("host", "pages").agg(F.collect_list("print").alias("drop"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False
) -> DataFrame:
    """The documents without boilerplate lines, whatever their other columns are called; with counts, also __n_lines and __n_dropped."""
    names = docs.columns
    host, text = docs[host_col], docs[text_col]
    total = common.written(docs.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages")), "line-hosts")
    n_docs = total.agg(F.sum("pages")).first()[0] or 0
    most = max(TASK_PAGES, -(-n_docs // MOST_BIG))
    salts = F.ceil(F.col("pages") / most).cast("int")
    big = F.broadcast(total.where(F.col("pages") > most).select(F.col("host").alias("b"), salts.alias("salts")))  # MOST_BIG rows at most
    found = boilerplate(docs, total, host_col, text_col, ratio, min_pages)
    found = found.select(F.col("host").alias("h"), "drop", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    hashable = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), host.alias("host"), F.xxhash64(*hashable).alias("lot"))
    rows = rows.join(big, F.col("host").eqNullSafe(F.col("b")), "left")
    rows = rows.select("row", "host", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod("lot", "salts")).cast("int").alias("salt"))
    met = rows.join(found, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")
    own = F.col("row").getField(text_col)
    lines = F.split(own, "\n")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), _prints(x))))
    n, n_kept = (F.when(own.isNull(), 0).otherwise(F.size(x)) for x in (lines, kept))
    out = [(F.array_join(kept, "\n") if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    if counts:
        out += [n.cast("long").alias("__n_lines"), (n - n_kept).cast("long").alias("__n_dropped")]
    return met.select(*out)
