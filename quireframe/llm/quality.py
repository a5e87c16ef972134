"""Quality rules: compression bands beside plain counts.

Repetitive text compresses far better, and junk far worse, than prose of the same length. Each
whole text and each fixed chunk of it is compressed with zstandard; a text goes if its ratio
leaves the band for its length, or if too large a share of its chunks leaves the chunk band. The bands are fitted to
a bounded sample of rows that are labelled good, by classes of length; where labels are too few, plain ones stay.

Defined results: a null or empty text has no words, all counts are 0 and it is not kept. Ties and
repeated rows are judged one by one. Other columns are ignored by `measure` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common


@dataclass(frozen=True)
class Bands:
    """(texts shorter than so many bytes, least ratio, most ratio), shortest first."""

    by_length: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 3.0),
        (512, 0.7, 3.0),
        (2048, 1.05, 3.2),
        (8192, 1.2, 3.8),
        (65536, 1.25, 5.0),
        (float("inf"), 1.25, 6.0),
    )
    chunk: int = 2048
    chunk_band: tuple[float, float] = (1.1, 4.0)
    #: A text goes if more than this share of its whole chunks is outside the chunk band.
    chunk_share: float = 0.3
    level: int = 3
    min_words: int = 50
    max_repeat_pct: int = 50


#: Fitted bands: rows sampled, rows a class of length must have, shares of good rows left outside at each end, and the width added.
SAMPLE, LEAST, TAIL, MARGIN = 20_000, 50, 0.002, 0.03
#: Upper ends of the classes of length, two an octave.
CLASSES = tuple(round(2 ** (k / 2)) for k in range(14, 35)) + (float("inf"),)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:  # three ids no longer fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def ratios(text: bytes, chunk: int, squeeze) -> tuple[float, list[float]]:
    """How often a text's bytes exceed its compressed bytes, and the same of its chunks; the last chunk ends where the text ends and may
    overlap the one before, and a text shorter than a chunk has none."""
    starts = list(range(0, len(text) - chunk + 1, chunk))
    if starts and len(text) % chunk:
        starts.append(len(text) - chunk)
    return len(text) / len(squeeze(text)), [chunk / len(squeeze(text[at : at + chunk])) for at in starts]


def judge(text: bytes, bands: Bands, squeeze) -> tuple:
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_CHARS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    failed = n < bands.min_words or 100 * repeats > bands.max_repeat_pct * n
    if not text:
        return n, chars, symbols, dups, repeats, failed, False, None, 0, 0
    ratio, parts = ratios(text, bands.chunk, squeeze)
    low, high = next((a, b) for most, a, b in bands.by_length if len(text) < most)
    n_chunks = len(parts)
    bad = sum(not bands.chunk_band[0] <= r <= bands.chunk_band[1] for r in parts)
    kept = not failed and low <= ratio <= high and bad <= bands.chunk_share * n_chunks
    return n, chars, symbols, dups, repeats, failed, kept, ratio, n_chunks, bad


def fit(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Bands:
    """Bands that all but a few of the rows labelled good (doc_id, quality) lie in: of at most `sample` of them, those with the smallest
    hashes of doc_id and text. Classes with fewer than LEAST rows, and chunks if there are fewer than that, keep the given bands."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    some = good.orderBy(F.xxhash64("id"), "id").limit(sample)
    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            raw, at = common.text_views(batch, "text")
            rows = []
            for i in range(batch.num_rows):
                whole, parts = ratios(raw[at[i] : at[i + 1]].tobytes(), bands.chunk, squeeze)
                rows.append((int(at[i + 1] - at[i]), whole, min(parts, default=None), max(parts, default=None)))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            cols = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] + [pa.float64()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *cols], names=["h", "n", "whole", "least", "most"])

    texts = docs.where(F.length(text_col) > 0).join(F.broadcast(some), F.col(id_col).cast("long") == F.col("id")).select(F.col(text_col).alias("text"), F.xxhash64("id", text_col).alias("h"))
    seen = texts.mapInArrow(common.tidy(run), "h long, n long, whole double, least double, most double")
    seen = seen.orderBy("h", "n", "whole").limit(sample).toPandas()  # bounded by sample, and the same rows in each run where rows share ids
    by_length = []
    for low, high in zip((0, *CLASSES), CLASSES, strict=False):
        x = seen.loc[(seen["n"] >= low) & (seen["n"] < high), "whole"]
        at = next((a, b) for most, a, b in bands.by_length if low < most)
        by_length.append((high, *_limits(x, x, at)))
    chunks = seen.dropna(subset=["least", "most"])
    return replace(bands, by_length=tuple(by_length), chunk_band=_limits(chunks["least"], chunks["most"], bands.chunk_band))


def _limits(least: pd.Series, most: pd.Series, given: tuple[float, float]) -> tuple[float, float]:
    if len(least) < LEAST:
        return given
    return float(least.quantile(TAIL)) / (1 + MARGIN), float(most.quantile(1 - TAIL)) * (1 + MARGIN)


def fitted(spark: SparkSession, sf_dir: str) -> Bands:
    """Bands for the tables in sf_dir, fitted where it has labels."""
    if not common.exists(spark, f"{sf_dir}/labels.parquet"):
        return Bands()
    return fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def measure(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts, the ratios and the verdict. No shuffle; a text at a time in memory."""

    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            raw, at = common.text_views(batch, "text")
            rows = [judge(raw[at[i] : at[i + 1]].tobytes(), bands, squeeze) for i in range(batch.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), common.empty_if_null(F.col(text_col)).alias("text")
    ).mapInArrow(common.tidy(run), SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns; rows that share an id are judged apart."""
    names = docs.columns
    schema = docs.schema

    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            texts = batch.column(names.index(text_col))
            yield batch.filter(pa.array([judge((t.as_py() or "").encode(), bands, squeeze)[6] for t in texts], type=pa.bool_()))

    return docs.mapInArrow(common.tidy(run), schema)
