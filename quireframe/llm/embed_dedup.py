"""Embedding near-dedup by product quantisation.

Coarse inverted lists hold each vector under its nearest centroid, with one code per subspace for what is left of it and the
length of the error that the codes make. Two linked vectors in different lists lie on both sides of the lists' border, so
one of them is no farther from it than half the distance that the threshold allows: a vector is compared with its own list and with
those whose border is that near, and a link that only one end can find counts for both. In a list, distances come from a table of the
query's products with the code words; a row stays if its error could lift it over the threshold, so no
link is lost, and the exact cosine decides. Lists are dealt out in bounded blocks of queries and of
rows; a block gives back counts, and links enough to connect its components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links; vectors of
different lengths have none with each other; equal vectors are linked, and are compared with others once; rows that
share a vec_id share their links; a null vec_id has no component. Other columns are ignored.

`train` fits centroids and code words on SAMPLE vectors at most, those with the smallest hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components

LEAST = 0.95
SAMPLE, MOST_LISTS, SUBSPACES, CODES, BLOCK = 32_768, 4096, 8, 64, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ c.T - half).argmax(axis=1)
    return out


class Quantiser:
    """Centroids, and code words of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = [int(len(sample[0]) * k / min(SUBSPACES, len(sample[0]))) for k in range(min(SUBSPACES, len(sample[0])) + 1)]
        self.words = [kmeans(rest[:, a:b], CODES) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the error of each vector."""
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True)], axis=1)
        seen = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        return lists, codes.astype(np.uint8), np.sqrt(((rest - seen) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, own: np.ndarray, near: float) -> np.ndarray:
        """Which lists x is compared with: its own, and those whose border with it is at most `near` away."""
        c = self.centroids
        size = (c * c).sum(axis=1)
        d = size - 2 * (x @ c.T)
        lead = d - d[np.arange(len(x)), own][:, None]
        between, of = np.unique(own, return_inverse=True)
        between = np.sqrt(np.maximum(size[between][:, None] + size - 2 * (c[between] @ c.T), 0))[of]
        return (lead <= 2 * between * near + 1e-6) | (np.arange(len(c)) == own[:, None])

    def approximate(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with the rows of a list, from the queries' tables."""
        out = np.repeat((x @ self.centroids[at])[:, None], len(codes), axis=1)
        for m, w in enumerate(self.words):
            out += (x[:, self.cuts[m] : self.cuts[m + 1]] @ w.T)[:, codes[:, m]]
        return out


def _units(col: pa.Array, dim: int) -> np.ndarray:
    x = np.array([v.as_py() for v in col], dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(dim: int, q: Quantiser, near: float):
    def run(batches):
        for batch in batches:
            step = max(64, (1 << 20) // len(q.centroids))
            for k in range(0, batch.num_rows, step):
                b = batch.slice(k, step)
                x = _units(b.column(2), dim)
                lists, codes, error = q.encode(x)
                near_by = q.probes(x, lists, near)
                probes, masks = [np.flatnonzero(p).tolist() for p in near_by], [p.tobytes() for p in np.packbits(near_by, axis=1)]
                cols = [b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(lists), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int64())), pa.array(masks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "m", "x", "list", "codes", "error", "probes", "mask"])

    return run


def _compared(q: Quantiser, least: float):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        if not len(queries) or not len(rows):
            return none
        x, y = np.stack(queries["qx"]), np.stack(rows["x"])
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in rows["codes"]])
        maybe = q.approximate(x, int(rows["list"].iloc[0]), codes) >= least - rows["error"].to_numpy() - 1e-9
        i, j = np.nonzero(maybe)
        sure = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            sure[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= least
        a, b = queries["q"].to_numpy(), rows["node"].to_numpy()
        sure &= a[i] != b[j]
        i, j = i[sure], j[sure]
        if not len(i):
            return none
        n = np.bincount(i, weights=rows["m"].to_numpy()[j], minlength=len(a)).astype(np.int64)
        masks = np.unpackbits(np.stack([np.frombuffer(c, dtype=np.uint8) for c in rows["mask"]]), axis=1)
        one = masks[j, queries["qlist"].to_numpy()[i]] == 0  # the row does not look into the query's list, so the link counts for it here
        n_back = np.bincount(j[one], weights=queries["qm"].to_numpy()[i[one]], minlength=len(b)).astype(np.int64)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        hung = [(v, root(v)) for v in list(parent)]
        counted = pd.DataFrame({"a": a[n > 0], "b": a[n > 0], "n": n[n > 0]})
        linked = pd.DataFrame([(u, v, 0) for u, v in hung if u != v], columns=["a", "b", "n"]).astype("int64")
        back = pd.DataFrame({"a": b[n_back > 0], "b": b[n_back > 0], "n": n_back[n_back > 0]})
        return pd.concat([counted, back, linked])

    return run


def _one_length(rows: DataFrame, dim: int, n: int, least: float) -> DataFrame:
    """Of distinct vectors (node, m, v) of one length: (a, a, number of linked vectors) and (a, b, 0) for linked a and b."""
    sample = rows.orderBy(F.xxhash64("node", "v")).limit(SAMPLE).select("v").toArrow().column(0)
    x = _units(sample, dim)
    q = Quantiser(x, max(1, min(MOST_LISTS, math.isqrt(n))))
    far = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    placed = rows.select("node", "m", "v").mapInArrow(_placed(dim, q, far / 2), "node long, m long, x array<double>, list long, codes binary, error double, probes array<long>, mask binary")
    placed = common.written(placed, "quantised")
    asked = placed.select(F.col("node").alias("q"), F.col("m").alias("qm"), F.col("x").alias("qx"), F.col("list").alias("qlist"), F.explode("probes").alias("ql"))
    held = placed.groupBy("list").agg(F.count("*").alias("rows"))  # MOST_LISTS rows at most
    asks = asked.groupBy(F.col("ql").alias("l")).agg(F.count("*").alias("asks"))
    blocks = held.join(asks, F.col("list") == F.col("l")).select("l", F.ceil(F.col("rows") / BLOCK).alias("nb"), F.ceil(F.col("asks") / BLOCK).alias("nq"))
    blocks = F.broadcast(blocks)
    asked = asked.join(blocks, F.col("ql") == F.col("l")).select(
        F.col("ql"), "q", "qm", "qx", "qlist", F.pmod(F.xxhash64("q"), "nq").alias("qqb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("qrb")
    )
    held = placed.join(blocks, F.col("list") == F.col("l")).select(
        "list", "node", "m", "x", "codes", "error", "mask", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod(F.xxhash64(F.lit(1), "node"), "nb").alias("rb")
    )
    return asked.groupBy("ql", "qqb", "qrb").cogroup(held.groupBy("list", "qb", "rb")).applyInPandas(_compared(q, least), "a long, b long, n long")


def groups(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0)
    good &= F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    v = F.transform("v", lambda e: e + F.lit(0.0))  # no negative zeros
    base = base.withColumn("ok", F.coalesce(good, F.lit(False)))
    base = base.select("vec_id", "v", "ok", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    some = base.where("ok")
    classes = some.groupBy(F.col("h1").alias("c1"), F.col("h2").alias("c2")).agg(F.min("vec_id").alias("node"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = common.written(classes, "vectors")
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()  # the lengths that occur, commonly one
    found = None
    for r in lengths:
        part = _one_length(classes.where(F.size("v") == r["dim"]), r["dim"], r["n"], least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = common.written(found, "vector-links")
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("id2")).agg(F.sum("n").alias("others"))
    whole = classes.join(roots, F.col("node") == F.col("id"), "left").join(counts, F.col("node") == F.col("id2"), "left")
    whole = whole.select("c1", "c2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root"))
    out = base.join(whole, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("ok"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
