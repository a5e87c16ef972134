"""Removal of long repeated passages by a sparse suffix array.

A byte goes if a string of `length` bytes that covers it also starts somewhere else. Sorting the suffix of every
byte is not needed: each start of such a string belongs to one sampled suffix, that of the smallest k-gram hash
in its first `window` places. The choice depends on the string alone, so equal strings belong to suffixes that
lie equally deep in them. A suffix is a row of two tokens, fingerprints of its next bytes: `lead`, of those
that all strings of the suffix share, and `full`, of all bytes of all its strings.

1. Suffixes are dealt out to buckets by ranges of their tokens, with splitters sampled from them, and sorted in each bucket by
   multikey quicksort: by the leading token, and only runs of equal ones by the next. Equal suffixes are counted before and after
   the shuffle, so copies do not crowd a bucket. Equal neighbours in both tokens repeat in all their strings.
   Neighbours equal in the leading token only may repeat in part; so may the first and last run of a bucket,
   whose neighbours stand across the boundary: one row of each kind goes on to step 2.
2. Those suffixes are cut out and looked at more closely: their strings in groups of STEP neighbours, with tokens,
   buckets and runs as above, and where a group may repeat in part, its strings one by one.
3. The repeated starts of a text are joined to it, and what they cover is removed. Texts are shuffled compressed.

Beside that, a shorter sampled suffix whose leading token also stands in another row shows a passage that both share: each
passage of PASSAGE bytes in two rows is seen, no string shorter than PASSAGE - PASSAGE_WINDOW + 1 bytes is. What such
tokens span is left out of `text`, beside the repeats.

Tokens are 64-bit fingerprints, so what counts as equal is equal in 128 bits.

Defined results: a null text is an empty one, nothing of it is removed; a text shorter than `length` is kept; texts of
rows that are equal in all columns repeat each other; a null doc_id is a document like others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common

LENGTH, WINDOW, GRAM, STEP = 400, 256, 16, 16
#: Shared passages: all of so many bytes (some 50 words) have a sampled suffix inside, whose leading token spans a half of them.
PASSAGE, PASSAGE_WINDOW = 255, 128
#: Bytes fingerprinted at once, and the bits that number them.
BLOCK, POS_BITS = 1 << 19, np.uint64(20)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@lru_cache(maxsize=2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of a base and of its inverse modulo 2**64."""
    base = _BASES[which] | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.ones(n, dtype=np.uint64)
        filled = 1
        while filled < n:
            step = np.uint64(pow(b, filled, 1 << 64))
            m = min(filled, n - filled)
            a[filled : filled + m] = a[:m] * step
            filled += m
        out.append(a)
    letters = np.random.default_rng(1 + which).integers(0, 1 << 64, 256, dtype=np.uint64)
    return letters, *out


class Prints:
    """Fingerprints of any substring of a block, from sums over its prefixes."""

    def __init__(self, block: np.ndarray, which: int = 0):
        letters, powers, self._inverse = _powers(which, BLOCK + 1)
        self._sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(letters[block] * powers[: len(block)], out=self._sums[1:])

    def raw(self, at, n):
        return (self._sums[at + n] - self._sums[at]) * self._inverse[at]

    def of(self, at: np.ndarray, n) -> np.ndarray:
        return common.mix64(self.raw(at, n) + np.asarray(n).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def blocks(raw: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of text: bytes, and for each text in it its row, the place in the block and the place in the text.

    Short texts share a block; a long one is cut into blocks that overlap by length - 1 bytes.
    """
    for i, j in common.row_runs(starts, BLOCK):
        a, b = starts[i], starts[j]
        if b - a <= BLOCK:
            yield raw[a:b], np.arange(i, j), starts[i : j + 1] - a, np.zeros(j - i, dtype=np.int64)
            continue
        step = BLOCK - length + 1
        for k in range(a, max(a + 1, b - length + 1), step):
            end = min(b, k + BLOCK)
            yield raw[k:end], np.array([i]), np.array([0, end - k]), np.array([k - a])


def suffixes(block: np.ndarray, bounds: np.ndarray, length: int, window: int, gram: int):
    """Of each sampled suffix of a block: index of its text, first and last start that belong to it, its two tokens, and its place."""
    n = len(block) - length + 1
    sizes = np.diff(bounds)
    if n <= 0 or not (sizes >= length).any():
        return None
    prints = Prints(block)
    g = common.mix64(prints.raw(np.arange(len(block) - gram + 1), gram))
    low = (np.uint64(1) << POS_BITS) - np.uint64(1)
    m = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # of equal hashes the first counts
    span = 1
    while span < window:
        step = min(span, window - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    owner = (m[:n] & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    left = np.repeat(bounds[1:], sizes)[:n] - np.arange(n)
    valid = np.flatnonzero(left >= length)
    owner, text = owner[valid], text[valid]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(valid)] - 1
    s, e, q, t = valid[new], valid[last], owner[new], text[new]
    lead = prints.of(q, length - window + 1)
    full = common.mix64(prints.of(s, e - s + length) + (q - s).astype(np.uint64))
    return t, s, e, lead, full, q


def multikey_quicksort(lead: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The order by both tokens: by the first, then only runs that are equal in it by the second."""
    order = np.argsort(lead, kind="quicksort")
    same = lead[order[1:]] == lead[order[:-1]]
    inside = np.r_[False, same] | np.r_[same, False]
    at = np.flatnonzero(inside)
    if len(at):
        run = np.cumsum(~np.r_[False, same])[at]
        order[at] = order[at][np.lexsort((full[order[at]], run))]
    return order


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SUFFIX = "lead long, full long, key long, base long, s long, e long, n long"
BUCKET = "lead long, full long, key long, base long, s long, e long, part boolean"


def _first_of_runs(lead: np.ndarray, full: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (full[1:] != full[:-1])])


def _rows(arrays):
    """Rows of suffixes from arrays(batch), which gives tuples of lead, full, key, base, s, e; n is the number of equal ones of a
    batch on the first of them, 0 on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(arrays(batch))
            if not got:
                continue
            cols = [np.concatenate(c) for c in zip(*got, strict=True)]
            order = multikey_quicksort(cols[0], cols[1])
            first = _first_of_runs(cols[0][order], cols[1][order])
            n = np.zeros(len(order), dtype=np.int64)
            n[order[first]] = np.diff(np.r_[first, len(order)])
            yield pa.RecordBatch.from_arrays([_signed(cols[0]), _signed(cols[1]), *(pa.array(c.astype(np.int64)) for c in (*cols[2:], n))], names=[x.split()[0] for x in SUFFIX.split(", ")])

    return run


def _sampled(length: int, window: int, gram: int):
    """Suffixes of whole texts (key, text)."""

    def arrays(batch: pa.RecordBatch):
        raw, starts = common.text_views(batch, "text")
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for block, rows, bounds, place in blocks(raw, starts, length):
            if (found := suffixes(block, bounds, length, window, gram)) is not None:
                t, s, e, lead, full, _ = found
                shift = place[t] - bounds[t]
                yield lead, full, keys[rows[t]], np.zeros(len(t), dtype=np.int64), s + shift, e + shift

    return arrays


def _leads(length: int, window: int, gram: int):
    """Leading tokens of sampled suffixes of texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = common.text_views(batch, "text")
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for block, rows, bounds, place in blocks(raw, starts, length):
                if (found := suffixes(block, bounds, length, window, gram)) is not None:
                    t, s, e, lead, _, at = found
                    yield pa.RecordBatch.from_arrays([_signed(lead), pa.array(keys[rows[t]]), pa.array(at + place[t] - bounds[t])], names=["lead", "key", "at"])

    return run


def _sharing(own: DataFrame, length: int, window: int, gram: int) -> DataFrame:
    """Of texts (key, text): where a leading token stands (key, at) that a text of another key has too."""
    leads = common.written(own.mapInArrow(common.tidy(_leads(length, window, gram)), "lead long, key long, at long"), "passage-leads")
    shared = leads.groupBy(F.col("lead").alias("l")).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("l")
    shared = common.written(shared, "passage-shared")  # so that the join below can split hot tokens
    out = common.written(leads.join(shared, F.col("lead") == F.col("l"), "left_semi").select("key", "at"), "passage-places")
    common.drop(leads, shared)
    return out


def groups_of(block: np.ndarray, at: np.ndarray, n: np.ndarray, length: int, window: int, gram: int, step: int):
    """The n starts of each suffix in groups of `step`, cut at the same places from its k-gram on wherever it stands. Suffixes begin
    at `at` in the block; of each group: which suffix, first and last start, tokens."""
    prints = Prints(block)
    g = common.mix64(prints.raw(np.arange(len(block) - gram + 1), gram))
    low = (np.uint64(1) << POS_BITS) - np.uint64(1)
    places = np.arange(window)
    own = ((g[at[:, None] + places] & ~low) | places.astype(np.uint64)).argmin(axis=1)
    shift = -(-window // step) * step
    from_ = (shift - own) // step
    many = (n - 1 + shift - own) // step - from_ + 1
    of = np.repeat(np.arange(len(at)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + from_[of]
    left = k * step - shift + own[of]
    right = left + step - 1
    s, e = np.maximum(left, 0), np.minimum(right, n[of] - 1)
    lead = common.mix64(prints.of(at[of] + right, length - step + 1) + k.astype(np.uint64))
    full = common.mix64(prints.of(at[of] + s, e - s + length) + ((k * step + s - left) * step + e - left).astype(np.uint64))
    return of, s, e, lead, full


def _grouped(length: int, window: int, gram: int, step: int):
    """Groups of the strings of cut-out suffixes (key, s, e, piece)."""

    def arrays(batch: pa.RecordBatch):
        raw, starts = common.text_views(batch, "piece")
        key, s, e = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for i, j in common.row_runs(starts, BLOCK):
            of, a, b, lead, full = groups_of(raw[starts[i] : starts[j]], starts[i:j] - starts[i], e[i:j] - s[i:j] + 1, length, window, gram, step)
            base = s[i:j][of]
            yield lead, full, key[i:j][of], base, a + base, b + base

    return arrays


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (s, e): where each row's begin in the flat arrays (a row more), and those; a null list is empty."""
    flat = column.flatten()
    at = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), out=at[1:])
    return at, *(flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))


def _single(length: int):
    """The strings of groups (key, s, piece, spans) one by one."""

    def arrays(batch: pa.RecordBatch):
        raw, starts = common.text_views(batch, "piece")
        key, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        at, s, e = _spans(batch.column(3))
        for i, j in common.row_runs(starts, BLOCK):
            block = raw[starts[i] : starts[j]]
            first, last = s[at[i] : at[j]], e[at[i] : at[j]]
            many = last - first + 1
            row = np.repeat(np.repeat(np.arange(i, j), np.diff(at[i : j + 1])), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            inside = place - base[row] + starts[row] - starts[i]
            yield *(Prints(block, k).of(inside, length) for k in (0, 1)), key[row], base[row], place, place

    return arrays


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's repeated suffixes (part false) and one row of each kind that may repeat in part (part true)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    cols = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(7)]
    order = multikey_quicksort(cols[0], cols[1])
    lead, full, key, base, s, e, n = (x[order] for x in cols)
    first = _first_of_runs(lead, full)
    n = np.add.reduceat(n, first)
    lead, full, key, base, s, e = (x[first] for x in (lead, full, key, base, s, e))
    same = lead[1:] == lead[:-1]
    part = np.r_[False, same] | np.r_[same, False]
    part |= (lead == lead[0]) | (lead == lead[-1])  # their neighbours may stand in another bucket
    for kind, mask in ((False, n >= 2), (True, part)):
        if mask.any():
            out = [pa.array(x[mask]) for x in (lead, full, key, base, s, e)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(int(mask.sum()), kind))], names=[x.split()[0] for x in BUCKET.split(", ")])


def _sorted_out(source: DataFrame, arrays, what: str) -> tuple[DataFrame, DataFrame]:
    """Starts (key, s, e) of suffixes that repeat in all their strings, and those (key, base, s, e) that may in part."""
    rows = common.written(source.mapInArrow(common.tidy(_rows(arrays)), SUFFIX), f"{what}-rows")
    counted = rows.where("n > 0")
    buckets = counted.repartitionByRange(common.parts(source.sparkSession), "lead", "full").mapInArrow(common.tidy(_bucket), BUCKET)
    buckets = common.written(buckets, what)
    whole = buckets.where("not part").select(F.col("lead").alias("l"), F.col("full").alias("f"))
    every = rows.select("lead", "full", "key", "s", "e")
    repeated = every.join(whole, (F.col("lead") == F.col("l")) & (F.col("full") == F.col("f"))).select("key", "s", "e")
    repeated = common.written(repeated, f"{what}-repeated")
    part = common.written(buckets.where("part").select("key", "base", "s", "e"), f"{what}-part")
    common.drop(rows, buckets)
    return repeated, part


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) with the text compressed."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw, starts = common.text_views(batch, "text")
        for k in range(0, batch.num_rows, 512):
            b = batch.slice(k, 512)
            z = [squeeze(raw[starts[i] : starts[i + 1]]) for i in range(k, k + b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["doc_id", "key", "z"])


def _pieces(length: int):
    """Suffixes of texts (key, z, spans) cut out, as far as their last string reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            at, s, e = _spans(batch.column(2))
            lot = []

            def cut() -> pa.RecordBatch:
                row, first, last, pieces = zip(*lot, strict=True)  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(key[list(row)]), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "s", "e", "piece"])  # noqa: B023

            for i in range(batch.num_rows):
                text = expand(batch.column(1)[i].as_py())
                for a, b in zip(s[at[i] : at[i + 1]].tolist(), e[at[i] : at[i + 1]].tolist(), strict=True):
                    lot.append((i, a, b, text[a : b + length]))
                    if len(lot) == 4096:
                        yield cut()
                        lot = []
            if lot:
                yield cut()

    return run


def _without(text: np.ndarray, gone: np.ndarray, shared: np.ndarray) -> bytes:
    """What is left without the bytes that are gone and those of shared leading tokens."""
    if len(shared):
        turns = np.zeros(len(text) + 1, dtype=np.int32)
        np.add.at(turns, shared, 1)
        np.add.at(turns, shared + PASSAGE - PASSAGE_WINDOW + 1, -1)
        gone = gone | (np.cumsum(turns[:-1]) > 0)
    return text[~gone].tobytes()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean, kept string, text string"


def _removed(length: int, texts: bool, passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            at, s, e = _spans(batch.column(2))
            for i in range(batch.num_rows):
                text = np.frombuffer(expand(batch.column(1)[i].as_py()), dtype=np.uint8)
                first, last = s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]
                shared, first, last = -1 - first[first < 0], first[first >= 0], last[first >= 0]
                gone = np.zeros(len(text), dtype=bool)
                if len(first):
                    turns = np.zeros(len(text) + 1, dtype=np.int32)
                    np.add.at(turns, first, 1)
                    np.add.at(turns, last + length, -1)
                    gone = np.cumsum(turns[:-1]) > 0
                kept = text[~gone].tobytes()
                n_spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                rows.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), len(shared) > 0 if passages else None, kept if texts else None, _without(text, gone, shared) if texts else None))
            n, r, k, h, p, t, u = zip(*rows, strict=True) if rows else ([],) * 7
            shown = [pa.array([None if x is None else x.decode("utf-8", "replace") for x in y], pa.string()) for y in (t, u)]
            cols = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(p, pa.bool_()), *shown]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, passages: bool = True
) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest of what is left, whether it shares a passage with a row of another id or text; where
    texts is set, what is left (kept), and that without the shared passages (text). A character of which some bytes are removed
    shows as a replacement character. Without passages they are not looked for: shares_passage is null, and text is what is left."""
    if window - 1 + gram > length or window < 2:
        raise ValueError("the window and a gram must fit into a string")
    spark = docs.sparkSession
    text = common.empty_if_null(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    own = base.select("key", "text")
    packed = base.select("doc_id", "key", "text").mapInArrow(common.tidy(_packed), "doc_id long, key long, z binary")
    spans_of = lambda d: d.groupBy(F.col("key").alias("of")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # noqa: E731  of one text
    repeated, part = _sorted_out(own, _sampled(length, window, gram), "suffix-buckets")
    picked = packed.join(spans_of(part).hint("merge"), F.col("key") == F.col("of")).select("key", "z", "spans")
    pieces = common.written(picked.mapInArrow(common.tidy(_pieces(length)), "key long, s long, e long, piece binary"), "suffix-pieces")
    common.drop(part)
    more, part = _sorted_out(pieces, _grouped(length, window, gram, min(STEP, window)), "group-buckets")
    groups = part.groupBy(F.col("key").alias("of"), "base").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # of one suffix
    close = pieces.join(groups, (F.col("key") == F.col("of")) & (F.col("s") == F.col("base"))).select("key", "s", "piece", "spans")
    close = common.written(close, "group-pieces")
    common.drop(part, pieces)
    last, part = _sorted_out(close, _single(length), "string-buckets")
    common.drop(part, close)
    found = repeated.unionByName(more).unionByName(last)
    if passages:
        shared = -1 - F.col("at")  # told from starts of repeats by its sign
        found = found.unionByName(_sharing(own, PASSAGE, PASSAGE_WINDOW, GRAM).select("key", shared.alias("s"), shared.alias("e")))
    spans = spans_of(found)
    joined = packed.join(spans.hint("merge"), F.col("key") == F.col("of"), "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(common.tidy(_removed(length, texts, passages)), RESULT)
