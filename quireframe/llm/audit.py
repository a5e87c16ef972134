"""How far the sources of a language lie apart in their terms, by joint histograms of counts.

Terms are counted once a language and source. For two sources only how many terms have which two counts matters: terms that both have
are tallied by their pair of counts, and cells where one or both counts are zero follow from the histograms of each source and
the number of terms, by inclusion and exclusion, so no zero is ever a row of its own. The divergence is worked out once a cell of the
tally and multiplied by the cell's terms. All numbers are whole: products that can pass 64 bits are decimals of 38 digits.

Pairs of sources of one language are what is asked for, so a term meets as many pairs as there are sources that have it; those are
tallied before they are dealt.

Defined results: null texts, languages and sources are empty strings; repeated rows and rows that share an id are documents of
their own; a term counts in a document once, however often it stands there, for whether it is kept; a source without kept terms has
its pairs, and so has one whose language keeps none, with value 0; a language with one source has no pairs; ties go by the
bytes of the item; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def probability(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * wide(count + 1), wide(total + terms))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with its occurrences and the documents that have it. A document's terms are put in order, so that the first of
    each kind is known where it stands, and both numbers come from one pass."""
    words = F.sort_array(F.array_remove(F.split(F.translate("text", UPPER, LOWER), GAP), ""))
    rows = docs.withColumn("ws", words).select("lang", "source", F.inline(F.arrays_zip(F.col("ws").alias("term"), F.array_prepend("ws", F.lit(None)).alias("last"))))
    rows = rows.where("term is not null")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("last"))).alias("docs"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    pair = ["lang", "a", "b"]
    side = lambda s, n: kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(n))
    met = side("a", "ca").join(side("b", "cb"), ["lang", "term"]).where("a < b").groupBy(*pair, "ca", "cb").agg(F.count("*").alias("m"))
    single = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    of = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"n{s}"))
    pairs = of("a").join(of("b"), "lang").where("a < b").join(groups.select("lang", "terms").distinct(), "lang")
    zero, m = F.lit(0).cast("long"), F.col("m")
    cell = lambda x, y, n: F.struct(x.alias("ca"), y.alias("cb"), n.alias("m"))

    def cells(rows: DataFrame, *some: Column) -> DataFrame:
        return rows.select(*pair, F.inline(F.array(*some)))

    ca, cb, n = F.col("ca"), F.col("cb"), F.col("n")
    tally = cells(met, cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))
    tally = tally.unionByName(cells(pairs.join(single.withColumnRenamed("source", "a"), ["lang", "a"]), cell(n, zero, m), cell(zero, zero, -m)))
    tally = tally.unionByName(cells(pairs.join(single.withColumnRenamed("source", "b"), ["lang", "b"]), cell(zero, n, m), cell(zero, zero, -m)))
    tally = tally.unionByName(cells(pairs, cell(zero, zero, F.col("terms"))))
    tally = tally.groupBy(*pair, "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    p, q = probability(ca, F.col("na"), F.col("terms")), probability(cb, F.col("nb"), F.col("terms"))
    known = tally.join(pairs, pair).withColumns({"p": p, "q": q})
    p, q = F.col("p"), F.col("q")
    known = known.groupBy(*pair).agg(F.sum(m * divergence(p, q)).alias("ab"), F.sum(m * divergence(q, p)).alias("ba"))
    both = pairs.select(*pair).join(known, pair, "left").fillna(0, ["ab", "ba"])
    one = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value"))
    return both.select("lang", F.inline(F.array(one("a", "b", "ab"), one("b", "a", "ba"))))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per language and source: its distance to each other source of the language (part pair), and the terms that it has more of
    than its language, by what they add to its distance from it (part term, the first `top`)."""
    d = docs.select(*[common.empty_if_null(F.col(c).cast("string")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    term = Window.partitionBy("lang", "term")
    kept = term_counts(d).withColumns({"docs": F.sum("docs").over(term), "every": F.sum("n").over(term), "nth": F.row_number().over(term.orderBy("source"))})
    kept = common.written(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "every", "nth"), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count_if(F.col("nth") == 1).alias("terms"), F.sum("n").alias("lang_total"))
    groups = d.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.written(groups.fillna(0, ["total", "terms", "lang_total"]), "audit-groups")
    own = kept.join(groups, ["lang", "source"])
    own = own.withColumns({"p": probability(F.col("n"), F.col("total"), F.col("terms")), "q": probability(F.col("every"), F.col("lang_total"), F.col("terms"))})
    own = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top))
