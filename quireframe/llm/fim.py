"""Fill-in-the-middle texts, cut by bit-parallel operations on big integers.

A text's bytes are translated into class masks with a bit a byte, the first byte highest. A shift tells which letters follow a letter, and
all other bytes that begin a code point, and letters that follow none, begin a token; the set bits are the tokens, and where the k-th one
stands is found by halving the mask and counting. No list of tokens is made.

Defined results: a null text is an empty one; empty texts and texts that contain a sentinel stay as they are (form plain), as does a share of
the others; a null id hashes as an empty one. Rows that share an id are cut by the same fractions. Other columns stay, those called like one of
the result give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are cut, and of those the ones that begin with their suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1
OWN = "n long, form string, prefix_chars long, middle_chars long, output string"


def _class(belongs) -> bytes:
    return bytes(49 if belongs(b) else 48 for b in range(256))  # the digits 1 and 0


_LETTER = _class(lambda b: chr(b).isalpha() and b < 128)
_INNER = _class(lambda b: 0x80 <= b < 0xC0)  # bytes within a code point


def boundaries(raw: bytes) -> int:
    """A bit a byte, the first byte highest, set where a token begins."""
    if not raw:
        return 0
    letter = int(raw.translate(_LETTER), 2)
    return ((1 << len(raw)) - 1) ^ (int(raw.translate(_INNER), 2) | letter & letter >> 1)


def ranked(mask: int, width: int, k: int) -> int:
    """How far from the front the k-th set bit stands, from 0; the width where there are only k."""
    if k >= mask.bit_count():
        return width
    at = 0
    while width > 1:
        back = width >> 1
        front = mask >> back
        n = front.bit_count()
        if k < n:
            mask, width = front, width - back
        else:
            at, k = at + width - back, k - n
            mask, width = mask & ((1 << back) - 1), back
    return at


def draws(key: str, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut(key: str, raw: bytes, seed: int = SEED, share: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the text as it is put out."""
    mask = boundaries(raw)
    n = mask.bit_count()
    h1, h2, h3, h4 = draws(key, seed)
    if not raw or h3 % 100 >= share or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    first, last = (ranked(mask, len(raw), k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:first], raw[first:last], raw[last:]
    chars = [len(x.decode()) for x in (prefix, middle)]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        return n, "spm", *chars, s + suffix + p + prefix + m + middle
    return n, "psm", *chars, p + prefix + s + suffix + m + middle


def transform(
    docs: DataFrame, seed: int = SEED, share: int = CUT, suffix_first: int = SUFFIX_FIRST, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows with n, form, prefix_chars, middle_chars and output. keep names the columns that stay; all do by default."""
    common.lean(docs.sparkSession)
    own = StructType.fromDDL(OWN)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own.names]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in kept]).alias("row"), key.alias("key"), common.empty_if_null(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = common.text_views(batch, "text")
            done = [cut(k, raw[a:b].tobytes(), seed, share, suffix_first) for k, a, b in zip(batch.column(1).to_pylist(), starts[:-1], starts[1:], strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            cols = [pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)]
            out = pa.array([d[4] for d in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, out], names=["row", *own.names])

    schema = StructType([StructField("row", rows.schema["row"].dataType), *own.fields])
    return rows.mapInArrow(common.tidy(run), schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *own.names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = lambda a, b: F.split(F.substring(output, 1 + len(a), 2_147_483_647), f"{b}|{MIDDLE}", -1)
    psm, spm = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    joined = lambda x, order: F.concat(*[x[k] for k in order])
    return F.when(form == "psm", joined(psm, (0, 2, 1))).when(form == "spm", joined(spm, (1, 2, 0))).otherwise(output)
