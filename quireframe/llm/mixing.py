"""Mixing sources to target weights by the cube method.

Each source has a target size; a document is repeated floor(target / source size) times, and once more with a
probability equal to the fraction. The cube method chooses those: its flight moves the probabilities of units along
the null space of the constraints (number of documents, their total size) until one of them is 0 or 1, so that both
totals stay balanced. Units fly in bounded blocks of one source; the two that a block leaves open, and some held back,
fly again with those of other blocks, until each source has one block left. Only the last two are landed without balance, and
there a source whose target is still missed gets or loses single copies of its last block's units.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without
any words has target 0 and takes nothing; a document is taken 3 times at most; all choices come from hashes
of ids, texts and the seed, so reruns agree; an empty table gives no rows; equal rows are separate units, told apart by a
number. A source with several blocks misses its target where one document outweighs the rest of its block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Most units in a block that flies at once, and the most times a document can be taken.
BLOCK, MOST = 4096, 3
#: One in so many units of a block does not fly before the last one.
HELD = 16


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Target of each source: shares of the total by weight, held at `most` times its size; the excess goes to
    the others by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * size[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


_EPS = 1e-9


def _open(p: np.ndarray) -> np.ndarray:
    return (p > _EPS) & (p < 1 - _EPS)


def fly(p: np.ndarray, x: np.ndarray, draws: Iterator[float]) -> tuple[np.ndarray, list[int]]:
    """The flight over units with probabilities p and sizes x, largest first: new probabilities, and which are still open.

    Each move follows a vector of the null space of (1, ..., 1) and of the sizes: one for the largest open unit, and for the others
    what balances it at the least cost, where a unit that is nearly decided moves little. So large units are decided while many
    small ones can make up for them, and what is left open at the end is small.
    """
    p = np.array(p, dtype=float)
    x = np.asarray(x, dtype=float) / max(1.0, float(np.max(x, initial=1.0)))
    p[~_open(p)] = np.round(p[~_open(p)])
    live = np.flatnonzero(_open(p))
    while len(live) > 2:
        lead, rest = live[0], live[1:]
        w = p[rest] * (1 - p[rest])
        r = x[rest]
        w0, w1, w2 = w.sum(), w @ r, w @ (r * r)
        det = w0 * w2 - w1 * w1
        if det > 1e-12 * w0 * w2:
            u = w * (((x[lead] * w1 - w2) + (w1 - x[lead] * w0) * r) / det)
        else:  # the others have one size
            if x[lead] != r[0]:
                lead, rest = rest[0], rest[1:]  # so they balance each other
                w = p[rest] * (1 - p[rest])
                w0 = w.sum()
            u = -w / w0
        at = np.r_[lead, rest]
        u = np.r_[1.0, u]
        q = p[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            above, below = (1 - q) / np.abs(u), q / np.abs(u)
        up = np.where(u > 0, above, below)
        down = np.where(u > 0, below, above)
        up[u == 0] = down[u == 0] = np.inf
        i, j = int(up.argmin()), int(down.argmin())
        rise = next(draws) * (up[i] + down[j]) < down[j]
        p[at] = np.clip(q + (up[i] if rise else -down[j]) * u, 0.0, 1.0)
        hit = at[i] if rise else at[j]
        p[hit] = np.round(p[hit])
        inside = _open(p[live])
        p[live[~inside]] = np.round(p[live[~inside]])
        live = live[inside]
    return p, live.tolist()


def land(p: np.ndarray, x: np.ndarray, goal: float, room: np.ndarray, live: list[int], draws: Iterator[float]) -> np.ndarray:
    """The last open units go where the total comes nearest to its goal, by lot among equals. What is then missing, where a source has
    too few small units, is made up for by single copies, from the largest unit that fits down; room: copies below and above."""
    p = p.copy()
    if live:
        before = float((p * x).sum() - (p[live] * x[live]).sum())
        options = [np.array(z, dtype=float) for z in itertools.product((0, 1), repeat=len(live))]
        p[live] = min(options, key=lambda z: (abs(goal - before - float((z * x[live]).sum())), next(draws)))
    for _ in range(MOST):
        gap = goal - float((p * x).sum())
        for i in np.flatnonzero(x > 0):  # sizes descend
            if x[i] <= abs(gap) and (p[i] + 1 <= room[1][i] if gap > 0 else p[i] - 1 >= room[0][i]):
                p[i] += np.sign(gap)
                gap -= np.sign(gap) * x[i]
    gap = goal - float((p * x).sum())
    able = np.flatnonzero((x > 0) & (x < 2 * abs(gap)) & ((p + 1 <= room[1]) if gap > 0 else (p - 1 >= room[0])))
    if len(able):
        best = able[np.abs(x[able] - abs(gap)).argmin()]
        p[best] += np.sign(gap)
    return p


def _block(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "h", "unit"], ascending=[False, True, True], kind="stable")
    rng = np.random.default_rng([seed & 0xFFFFFFFF, int(pdf["block"].iloc[0]), len(pdf)])
    draws = iter(rng.random, None)
    x, before, whole = (pdf[c].to_numpy(dtype=float) for c in ("size", "p", "whole"))
    flying = np.ones(len(x), dtype=bool)
    if not last:  # some units of all sizes wait for the source's last block, where they make up for those of other blocks
        waiting = np.flatnonzero((x > 0) & _open(before))
        flying[waiting[HELD - 1 :: HELD]] = flying[waiting[-2:]] = False
    p = before.copy()
    p[flying], live = fly(before[flying], x[flying], draws)
    if last:
        p = land(p, x, float((before * x).sum()), np.stack([-whole, MOST - whole]), live, draws)
    return pdf.assign(p=p)


def _flight(seed: int, last: bool):
    return lambda pdf: _block(pdf, seed, last)


def _name(docs: DataFrame, seed: int, *cols: str) -> Column:
    """A hash of what a document is; a null differs from an empty text."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (docs[c], docs[c].isNull())])


SHARES = "of string, source_size long, target double, ratio double, sid long, blocks long"


def _shares(by: DataFrame, weights: Sequence[float], block: int, at_hand: int) -> DataFrame:
    """Of sources (src, s, n): their places, targets and blocks. Up to at_hand of them are worked out on the driver and broadcast;
    beyond that they stay a table, ranked by ranges, and only sums come to the driver."""
    spark = by.sparkSession
    if by.count() <= at_hand:
        sums = sorted(((r["src"], r["s"], r["n"]) for r in by.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        goal = targets([(s, n) for s, n, _ in sums], weights)
        rows = [(s, size, goal[s], goal[s] / size if size else 0.0, k, max(1, -(-n // block))) for k, (s, size, n) in enumerate(sums)]
        return F.broadcast(spark.createDataFrame(rows, SHARES))
    order = [F.col("src").isNull(), F.col("src")]
    dealt = by.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k"))
    dealt = common.written(dealt, "mix-ranks")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # one row a partition
    before = itertools.accumulate([n for _, n in sizes], initial=0)
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "p int, start long")
    ranked = dealt.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn("sid", F.col("start") + F.col("k"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = common.written(ranked.select("src", "s", "n", "sid", weight.alias("w"), (F.col("s") * MOST).cast("double").alias("top")), "mix-ranked")
    level, held = 0.0, -1
    while True:  # the level rises until no further source is held at its top
        over = F.col("top") < F.lit(level) * F.col("w")
        r = ranked.agg(F.sum("s").alias("all"), F.count_if(over).alias("held"), F.sum(F.when(over, F.col("top"))).alias("gone"), F.sum(F.when(~over, F.col("w"))).alias("rest")).first()
        if r["held"] == held or r["rest"] is None:
            break
        held, level = r["held"], (r["all"] - (r["gone"] or 0.0)) / r["rest"]
    target = F.least("top", F.lit(level) * F.col("w"))
    ratio = F.when(F.col("s") > 0, target / F.col("s")).otherwise(0.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    return ranked.select(F.col("src").alias("of"), F.col("s").alias("source_size"), target.alias("target"), ratio.alias("ratio"), "sid", blocks.alias("blocks"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 7, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", at_hand: int = 10_000,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, h (a hash of its id, text and source), copies, taken. Only ids and sizes are shuffled."""
    text = F.col(text_col)
    units = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("src"),
        F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        _name(docs, seed, id_col, text_col, source_col).alias("h"),
    )
    units = common.written(units, "mix-units")
    by = common.written(units.groupBy("src").agg(F.sum("size").alias("s"), F.count("*").alias("n")), "mix-sources")
    shares = _shares(by, weights, block, at_hand)
    units = units.join(shares, F.col("src").eqNullSafe(F.col("of"))).select("doc_id", "src", "size", "h", "source_size", "target", "ratio", "sid", "blocks")
    whole = F.floor("ratio").cast("long")
    units = units.withColumn("whole", whole).withColumn("p", F.col("ratio") - whole)
    name = F.struct("doc_id", "h")
    fixed = units.where("p < 1e-9")
    open_ = units.where("p >= 1e-9").withColumn("unit", F.xxhash64(name)).withColumn("block", F.pmod("unit", "blocks"))
    schema = "doc_id long, size long, h long, source_size long, target double, sid long, blocks long, whole long, p double, unit long, block long"
    open_ = open_.select(*[c.split()[0] for c in schema.split(", ")])
    done = []
    most = max(1, -(-(by.agg(F.max("n")).first()[0] or 0) // block))
    while True:
        last = most == 1
        flown = open_.groupBy("sid", "block").applyInPandas(_flight(seed, last), schema)
        flown = common.written(flown, "mix-flight")
        if last:
            done.append(flown)
            break
        done.append(flown.where("p = 0 or p = 1"))  # the others are open, and have parts of copies
        left = block // HELD + 4  # of a block
        most = max(1, -(-most * left // block))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("blocks") * left / block)).cast("long")
        open_ = flown.where("p > 0 and p < 1").withColumn("blocks", blocks).withColumn("block", F.pmod("block", "blocks"))
    cols = ["doc_id", "size", "source_size", "target", "h", (F.col("whole") + F.round("p").cast("long")).alias("copies")]
    out = fixed.select(*cols)
    for d in done:
        out = out.unionByName(d.select(*cols))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs, whatever they are called.

    A document meets its choice by the hash of its id, text and source; rows that share it are numbered by a hash of all their
    columns, and each has a choice of its own.
    """
    names = docs.columns
    chosen = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    many = [F.count_if(F.col("copies") >= n).alias(f"n{n}") for n in range(1, MOST + 1)]
    taken = chosen.groupBy(F.col("h").alias("of")).agg(*many).where("n1 > 0")
    whole = F.struct(*[docs[c] for c in names])
    rows = docs.select(whole.alias("row"), _name(docs, seed, id_col, text_col, source_col).alias("h"), F.xxhash64(F.to_json(whole)).alias("tie"))
    same = Window.partitionBy("h").orderBy("tie")
    met = rows.join(taken, F.col("h") == F.col("of")).withColumn("k", F.row_number().over(same))
    n = sum((F.when(F.col("k") <= F.col(f"n{n}"), 1).otherwise(0) for n in range(1, MOST + 1)), F.lit(0))
    met = met.withColumn("n", n).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("again"))
    return met.select(*[F.col("row").getField(c).alias(c) for c in names])
