"""MinHash near-dedup with HyperMinHash registers.

A document's set holds its distinct shingles. The smallest shingle hash of each of 128 buckets is stored as a
register: the number of its leading zeros and the mantissa bits that follow. Buckets without a shingle borrow, along a
fixed order of their own, from one that has any, so registers of two sets agree with the probability of their
similarity. Bands of registers name the candidates; registers' agreement, corrected for chance collisions, drops candidates
far below the threshold; the full sets decide. Small sets fill few buckets, and their registers agree or differ together: no
pair with one is dropped by its registers, and the smallest are also joined by their rarest shingles, whatever their bands.

Groups of copies never meet in all pairs. Documents with equal sets are one node. In each band's bucket
nodes are compared with a few hubs; links make components. Nodes of buckets that still hold several components are
compared across components after that, where their rarest shingles leave it possible that they are similar: no link between
components is lost, and none inside a component is needed.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer words than a shingle has are one
shingle; rows that share a doc_id are one document, linked with whatever any of their texts is (n_shingles is each row's own, and a
wordless one of them stands alone); a null doc_id is linked with nothing, has no component and is kept; equal
texts are linked; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .graph import components

SHINGLE, REGISTERS, ROWS = 5, 128, 4
SIMILAR = 75  # per cent
#: Mantissa bits that are stored beside the number of leading zeros; bands are made of the registers as stored.
STORED_BITS = 10
#: Candidates are dropped below the threshold less so many standard deviations of the estimate.
SLACK = 5.0
#: Pairs with a smaller set than ALL_FILLED are not dropped by their registers; links of smaller sets than SMALL need no bands.
ALL_FILLED, SMALL = 512, 128
HUBS = 3
CHUNK = 1 << 19
#: Shingle hashes that the verification of a batch keeps at hand.
HELD = 1 << 21

_FNV = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, ~space


def _probes() -> np.ndarray:
    rng = np.random.default_rng(11)
    return np.stack([np.r_[i, rng.permutation(np.delete(np.arange(REGISTERS), i))] for i in range(REGISTERS)])


_LOWER, _IN_WORD = _letters()
_PROBES = _probes()


def _word_hashes(block: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in a block of texts that begin at cuts, and the words' hashes."""
    from .suffix_dedup import Prints

    inside = _IN_WORD[block]
    before = np.r_[False, inside[:-1]]
    first = np.zeros(len(block), dtype=bool)
    first[cuts[cuts < len(block)]] = True
    start = np.flatnonzero(inside & (~before | first))
    after = np.r_[inside[1:], False]
    after_first = np.r_[first[1:], True]
    end = np.flatnonzero(inside & (~after | after_first)) + 1
    return start, Prints(_LOWER[block]).of(start, end - start)


def _combine(words: np.ndarray, n: int) -> np.ndarray:
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _FNV + words[k : len(words) - n + 1 + k]
    return common.mix64(h ^ np.uint64(n))


def _of_words(w: np.ndarray, size: int) -> np.ndarray:
    if len(w) == 0:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(_combine(w, min(size, len(w))))


def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, in order; bytes of a few texts at a time."""
    for i, j in common.row_runs(starts, CHUNK):
        a, b = starts[i], starts[j]
        if b - a <= CHUNK:
            at, h = _word_hashes(raw[a:b], starts[i:j] - a)
            bounds = np.searchsorted(at, starts[i : j + 1] - a)
            for k in range(j - i):
                yield _of_words(h[bounds[k] : bounds[k + 1]], size)
        else:  # a long text, cut where words end
            got, k = [], a
            while k < b:
                end = min(b, k + CHUNK)
                if end < b:
                    gaps = np.flatnonzero(~_IN_WORD[raw[k:end]])
                    if len(gaps):
                        end = k + int(gaps[-1]) + 1
                    else:  # a word longer than a block is hashed whole
                        gaps = np.flatnonzero(~_IN_WORD[raw[k:b]])
                        end = k + int(gaps[0]) if len(gaps) else b
                        got.append(_long_word(raw[k:end]))
                        k = end
                        continue
                got.append(_word_hashes(raw[k:end], np.zeros(1, dtype=np.int64))[1])
                k = end
            yield _of_words(np.concatenate(got), size)


def _long_word(word: np.ndarray) -> np.ndarray:
    import hashlib

    return np.frombuffer(hashlib.blake2b(_LOWER[word].tobytes(), digest_size=8).digest(), dtype=np.uint64)


def registers(hashes: np.ndarray, bits: int) -> np.ndarray:
    """128 registers of a set that is not empty: leading zeros times 2**bits, plus so many mantissa bits."""
    h = common.mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    h.sort()
    bucket = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    value = h[first] << np.uint64(7)
    length = np.zeros(len(value), dtype=np.int64)  # bits from the leading one down
    v = value.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = v >= np.uint64(1) << np.uint64(s)
        length += s * big
        v = np.where(big, v >> np.uint64(s), v)
    zeros = np.where(value > 0, 63 - length, 57)
    mantissa = ((value << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - bits)
    own = np.zeros(REGISTERS, dtype=np.uint64)
    own[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(bits)) | mantissa
    have = np.zeros(REGISTERS, dtype=bool)
    have[bucket[first]] = True
    if not have.all():
        source = _PROBES[np.arange(REGISTERS), have[_PROBES].argmax(axis=1)]
        own = own[source]
    return own


def estimate(a: np.ndarray, b: np.ndarray, bits: int = STORED_BITS) -> float:
    """Similarity by agreement of registers, less what different minima agree by chance: equal numbers of leading
    zeros by about one in three, and then equal mantissas by 2**-bits."""
    chance = 2.0**-bits / 3
    return ((a == b).mean() - chance) / (1 - chance)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // ROWS
        salt = common.mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            raw, starts = common.text_views(batch, "text")
            n, sig, stored, keys = [], [], [], []
            for s in shingle_sets(raw, starts, size):
                n.append(len(s))
                if len(s) == 0:
                    sig.append((0, 0))
                    stored.append(None)
                    keys.append(None)
                    continue
                both = [int(common.mix64(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x1234567, 0x89ABCDEF)]
                sig.append(tuple(both))
                own = registers(s, STORED_BITS)
                stored.append(own.astype("<u2").tobytes())
                rows = own.reshape(bands, ROWS)
                h = salt.copy()
                for k in range(ROWS):
                    h = common.mix64(h * _FNV + rows[:, k])
                keys.append(h.view(np.int64))
            a, b = zip(*sig, strict=True) if sig else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(stored, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[x.split()[0] for x in SKETCH.split(", ")],
            )

    return run


SKETCH = "doc_id long, th long, n_shingles long, s1 long, s2 long, regs binary, bands array<long>"


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one length without nulls, as rows of bytes."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=np.uint8)[at : at + len(column) * width].reshape(len(column), width)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_fixed(batch.column(k), 2 * REGISTERS).view("<u2") for k in (2, 3))
            chance = 2.0**-STORED_BITS / 3
            est = ((a == b).mean(axis=1) - chance) / (1 - chance)
            small = np.minimum(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))) < ALL_FILLED
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(small | (est >= least)))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (node, n, regs, text) with the text compressed."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        raw, starts = common.text_views(batch, "text")
        z = pa.array([squeeze(raw[starts[i] : starts[i + 1]]) for i in range(batch.num_rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), z], names=["node", "n", "regs", "z"])


def _set_of(z: bytes, size: int) -> np.ndarray:
    import zstandard

    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), dtype=np.uint8)
    return next(iter(shingle_sets(text, np.array([0, len(text)]), size)))


def _verified(size: int, percent: int):
    """Pairs that the full sets confirm; each text of a batch is cut into shingles once, as long as HELD hashes suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.zeros(batch.num_rows, dtype=bool)
            held: dict[int, np.ndarray] = {}
            total = 0
            for i in np.lexsort((a, b)).tolist():
                both = []
                for name, z in ((int(a[i]), batch.column(2)), (int(b[i]), batch.column(3))):
                    if (got := held.get(name)) is None:
                        got = _set_of(z[i].as_py(), size)
                        if total + len(got) > HELD:
                            held, total = {}, 0
                        held[name] = got
                        total += len(got)
                    both.append(got)
                x, y = sorted(both, key=len)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _tokens(size: int):
    """The shingles of nodes (node, root, z), some documents' in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows, sets, total = [], [], 0

            def cut() -> pa.RecordBatch:
                n = np.array([len(x) for x in sets], dtype=np.int64)  # noqa: B023
                cols = [np.repeat(x, n) for x in (ids[rows], roots[rows], n)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "root", "n", "tok"])  # noqa: B023

            for i in range(batch.num_rows):
                rows.append(i)
                sets.append(_set_of(batch.column(2)[i].as_py(), size))
                total += len(sets[-1])
                if total >= 1 << 16:
                    yield cut()
                    rows, sets, total = [], [], 0
            if rows:
                yield cut()

    return run


def _still_possible(left: DataFrame, size: int, percent: int) -> DataFrame:
    """Of nodes (node, root, z), the pairs from different components that can be similar at all, and some more.

    Similar sets share one of their (1 - threshold) rarest shingles, so early that enough others can follow. Shingles that no other node has lead nowhere, so a
    node with more of them than that has no partner.
    """
    tokens = common.written(left.select("node", "root", "z").mapInArrow(common.tidy(_tokens(size)), "node long, root long, n long, tok long"), "near-tokens")
    often = tokens.groupBy(F.col("tok").alias("t")).agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, F.col("tok") == F.col("t")).groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("by"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("by"))
    place = F.col("k") + 1 + F.col("n") - F.size("by")
    first = shared.where(reach > 0).select("node", "root", "n", F.size("by"), "by", F.posexplode(F.slice("by", F.lit(1), reach.cast("int"))).alias("k", "x"))
    first = first.select("node", "root", "n", place.alias("at"), F.col("x.tok").alias("tok"))
    first = common.written(first, "near-prefixes")
    mixed = first.groupBy(F.col("tok").alias("t")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t")
    first = common.written(first.join(mixed, F.col("tok") == F.col("t"), "left_semi"), "near-shared")  # so that the join below can split hot shingles
    other = first.select(F.col("tok").alias("tok2"), F.col("node").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"))
    # what can be shared from the first shingle in common on must reach what the threshold asks for
    near = (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1) * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("n2"))
    both = first.join(other, (F.col("tok") == F.col("tok2")) & (F.col("root") < F.col("root2")) & near)
    return both.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def _links(pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those that the full sets confirm."""
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    side = lambda c, *x: nodes.select(F.col("node").alias(f"_{c}"), *[F.col(y).alias(f"{y[0]}{c}") for y in x])
    seen = pairs.join(side("a", "regs", "n"), F.col("a") == F.col("_a")).drop("_a").join(side("b", "regs", "n"), F.col("b") == F.col("_b")).select("a", "b", "ra", "rb", "na", "nb")
    likely = common.written(seen.mapInArrow(_likely(least), "a long, b long").distinct(), "likely")
    full = likely.join(side("a", "z"), F.col("a") == F.col("_a")).drop("_a").join(side("b", "z"), F.col("b") == F.col("_b")).select("a", "b", "za", "zb")
    return common.written(full.mapInArrow(common.tidy(_verified(size, percent)), "a long, b long").distinct(), "near-links")


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    text = common.empty_if_null(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    sketch = common.written(base.mapInArrow(common.tidy(_sketch(size)), SKETCH), "sketches")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    # a node is a set; a written number names it, and the smallest of its documents lends it a text
    classes = some.groupBy(F.col("s1").alias("c1"), F.col("s2").alias("c2")).agg(
        F.min(F.struct("doc_id", "th")).alias("low"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")
    )
    classes = common.written(classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "low.doc_id", "low.th", "n", "regs", "bands"), "near-classes")
    same_set = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))
    # rows that share a doc_id are one document, so their sets are linked
    again = common.written(some.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "near-again")
    repeated = not again.isEmpty()
    # sets of one or two shingles are similar to equal sets only
    reps = classes.where("n > 2")
    rows = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("rows")).where("rows > 1")
    met = common.written(rows.join(shared, F.col("key") == F.col("k")).select("key", "node", "n", "rows"), "band-members")
    # hubs of a bucket: the node that meets the most others in all its buckets, and some by lot
    degree = met.groupBy(F.col("node").alias("d")).agg(F.sum("rows").alias("degree"))
    ranked = met.join(degree, F.col("node") == F.col("d"))
    lots = [F.min_by("node", F.xxhash64(F.lit(r), "node")).alias(f"hub{r}") for r in range(1, HUBS)]
    hubs = ranked.groupBy(F.col("key").alias("k")).agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub0"), *lots)
    # a set that is similar to a small one is small_n at most
    small_n = (SMALL - 1) * 100 // percent
    ids = met.select(F.col("node").alias("id")).unionByName(reps.where(F.col("n") <= small_n).select(F.col("node").alias("id"))).distinct()
    # the texts of nodes that share a band with any other, and of small ones
    wanted = reps.join(ids, F.col("node") == F.col("id")).select("node", "n", "regs", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    nodes = base.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t"))).select("node", "n", "regs", "text")
    nodes = nodes.mapInArrow(common.tidy(_packed), "node long, n long, regs binary, z binary")
    nodes = common.written(nodes.dropDuplicates(["node"]) if repeated else nodes, "near-nodes")
    with_hubs = met.join(hubs, F.col("key") == F.col("k")).select("node", F.explode(F.array(*[f"hub{r}" for r in range(HUBS)])).alias("hub"))
    pairs = with_hubs.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    links = _links(pairs, nodes, size, percent)
    if repeated:
        held = some.join(again, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "s1", "s2").distinct()
        held = held.join(classes.select("node", "c1", "c2"), same_set).select("doc_id", "node")
        first = held.groupBy(F.col("doc_id").alias("id")).agg(F.min("node").alias("b"))
        held = held.join(first, F.col("doc_id") == F.col("id")).where("node <> b").select(F.col("node").alias("a"), "b")
        links = common.written(links.unionByName(held).distinct(), "near-links")
    roots = common.written(components(links), "near-roots")
    # what still meets in one bucket from different components, and all small sets
    placed = met.join(roots, F.col("node") == F.col("id"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
    left = placed.join(mixed, F.col("key") == F.col("k"), "left_semi").select(F.col("node").alias("x"), F.col("root").alias("r"))
    small = nodes.where(F.col("n") <= small_n).select(F.col("node").alias("x")).join(roots, F.col("x") == F.col("id"), "left").select("x", F.coalesce("root", "x").alias("r"))
    left = left.unionByName(small).distinct()
    left = nodes.join(left, F.col("node") == F.col("x")).select("node", F.col("r").alias("root"), "z")
    more = _still_possible(left, size, percent)
    rest = _links(more, nodes, size, percent)
    if not rest.isEmpty():
        roots = common.written(components(links.unionByName(rest)), "near-roots")
    whole = classes.select("node", "c1", "c2", "doc_id").join(roots, F.col("node") == F.col("id"), "left").select("c1", "c2", "doc_id", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    whole = whole.join(least, F.col("root") == F.col("r")).select("c1", "c2", "component_id")
    placed = sketch.select("doc_id", "n_shingles", "s1", "s2").join(whole, same_set & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    out = placed.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without near copies of a kept one, with all their columns: one row of each kept doc_id, the first by a hash of
    all columns, since rows that share a doc_id are one document; all rows whose doc_id is null."""
    of, nth = common.unused(docs, "kept_id"), common.unused(docs, "kept_nth")
    per_id = groups(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    kept = common.written(per_id.where("kept").select(of, "rows"), "near-kept")
    left = docs.join(kept.select(of), F.col(id_col).cast("long").eqNullSafe(F.col(of)), "left_semi")
    if kept.where(F.col(of).isNotNull() & (F.col("rows") > 1)).isEmpty():
        return left
    key, row = F.col(id_col).cast("long"), F.xxhash64(F.to_json(F.struct(*docs.columns)))
    number = F.row_number().over(Window.partitionBy(key, F.when(key.isNull(), row)).orderBy(row))
    return left.withColumn(nth, number).where(key.isNull() | (F.col(nth) == 1)).drop(nth)
