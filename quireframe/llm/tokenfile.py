"""Token ids as a binary file with a shared zstandard dictionary.

A dataset is a folder in shared storage with two tables. `dictionary` holds the dictionary trained on
serialized id arrays, under its SHA-256. `blocks` holds the file's blocks in ascending doc_id order: each
starts with a magic word, its number of documents and the dictionary's hash, then the offset index
(doc_id, first id, number of ids, offset and length of the frame), then one zstandard frame a document. A
short document is read by one index look-up and one small frame; neighbours are not touched.

A document's frame is made where its text is read. Frames are dealt to shards by ranges of doc_id and sorted there, so
shards follow each other; the start of a shard is the sum of the ids of the shards before it, from one number a shard.

Defined results: a null text is an empty one and holds the end id only; rows that share a doc_id follow
each other, ordered by a hash of the text; a null doc_id comes first; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, units

MAGIC = b"QTB1"
_HEAD, _HEAD_BYTES = "<4sI32s", struct.calcsize("<4sI32s")
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("first", "<u8"), ("n", "<u4"), ("at", "<u8"), ("len", "<u4")])
BLOCK_BYTES, ROW_GROUP = 1 << 20, 16 << 20
#: The dictionary is trained on so many documents, those with the smallest hashes of doc_id, and so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1500, 4096, 32_768
#: nth numbers the rows of a task, so that rows of one doc_id can stand in several shards.
FRAMES = "doc_id long, tie long, nth long, n long, frame binary"
BLOCKS = "shard int, block int, n_docs long, n_ids long, low long, high long, data binary"
#: Words that go through the library as one text, texts that do at once, and units in each generation of the memory.
TOGETHER, AT_ONCE, KEPT = 128, 64, 250_000


class LibraryEncoder:
    """The tokenizers library, over the distinct units of texts where the file is of the kind that units are made for, else over
    whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        split = [p["pattern"].get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.units = units.Encoder(self._units, KEPT) if suffix and split == [units.PATTERN] else None
        vocab = spec["model"]["vocab"]
        if self.units is not None:
            self.ends = np.zeros(max(vocab.values()) + 1 + len(spec.get("added_tokens", [])), dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), AT_ONCE):  # the library's results are much larger than the ids
            out += [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def _units(self, some: list[bytes]) -> list[bytes]:
        """Units of letters alone are one piece each, so many of them go through the library as one text, and its ids are parted
        where words end; other units go one by one."""
        out: list[bytes] = [b""] * len(some)
        words, others = [], []
        for k, u in enumerate(some):
            (words if u.decode().isalpha() else others).append(k)
        lots = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for lot, ids in zip(lots, self._ids([b" ".join(some[k] for k in lot).decode() for lot in lots]), strict=True):
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(lot):  # some letters fall apart into others and marks
                others.extend(lot)
                continue
            data, at = ids.tobytes(), [0, *(4 * at).tolist()]
            for i, k in enumerate(lot):
                out[k] = data[at[i] : at[i + 1]]
        for k, ids in zip(others, self._ids([some[k].decode() for k in others]), strict=True):
            out[k] = ids.tobytes()
        return out

    def rows(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.units is not None:
            yield from self.units.rows(raw, starts)
            return
        for i, j in common.row_runs(starts, units.BLOCK):
            for ids in self._ids([raw[starts[k] : starts[k + 1]].tobytes().decode() for k in range(i, j)]):
                yield ids.tobytes()


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def pack(ids: bytes) -> bytes:
    """Serialized ids: low halves, then high halves if any is set; frames of both kinds start with their number of halves."""
    a = np.frombuffer(ids, dtype="<u4")
    low, high = (a & 0xFFFF).astype("<u2"), (a >> 16).astype("<u2")
    return b"\x02" + low.tobytes() + high.tobytes() if high.any() else b"\x01" + low.tobytes()


def unpack(data: bytes) -> bytes:
    a = np.frombuffer(data, dtype="<u2", offset=1).astype("<u4")
    if data[:1] == b"\x02":
        a = a[: len(a) // 2] | a[len(a) // 2 :] << np.uint32(16)
    return a.astype("<u4").tobytes()


def train(sample: list[bytes]) -> bytes:
    """A dictionary for serialized ids; with too little to train on, the sample itself is the dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICT_BYTES] or b"\x01\x00\x00\x00\x00\x00\x00\x00"


@dataclass(frozen=True)
class Dataset:
    path: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def dictionary(self, spark: SparkSession) -> tuple[bytes, bytes]:
        row = spark.read.parquet(f"{self.path}/dictionary").first()
        return bytes(row["sha256"]), bytes(row["data"])


def _sample(docs: DataFrame, path: str) -> list[bytes]:
    """Serialized ids of windows from anywhere in a bounded sample of documents; only their ids are read to choose them."""
    order = F.xxhash64("doc_id")
    last = docs.where("doc_id is not null").select(order.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return []
    start = F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.length("text") - 8 * SAMPLE_IDS, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where(order <= F.lit(last)).select(F.substring("text", start, F.lit(8 * SAMPLE_IDS)).alias("text")).limit(SAMPLE_DOCS).collect()
    raw = [r["text"].encode() for r in rows]
    starts = np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)]
    out = []
    for x, ids in zip(raw, encoder(path).rows(np.frombuffer(b"".join(raw), dtype=np.uint8), starts), strict=True):
        at = 4 * (zlib.crc32(x) % (max(0, len(ids) // 4 - SAMPLE_IDS) + 1))
        out.append(pack(ids[at : at + 4 * SAMPLE_IDS]))
    return out


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> Dataset:
    """Encodes and writes all documents: one pass over the texts makes a frame of each; only frames are shuffled and sorted."""
    spark = docs.sparkSession
    text = common.empty_if_null(F.col(text_col))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    path = common.fresh_path(spark, "tokens")
    trained = train(_sample(docs, tokenizer))
    digest = hashlib.sha256(trained).digest()
    spark.createDataFrame([(bytearray(digest), bytearray(trained))], "sha256 binary, data binary").write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(trained)
        shared.precompute_compress(level=level)  # else each frame digests the dictionary anew
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        e = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        nth = 0
        for batch in batches:
            k, n, frames, size = 0, [], [], 0

            def rows() -> pa.RecordBatch:
                nonlocal k, n, frames, size, nth
                m = len(frames)
                cols = [batch.column(0).slice(k, m), batch.column(2).slice(k, m), pa.array(range(nth, nth + m), pa.int64()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())]  # noqa: B023
                k, n, frames, size, nth = k + m, [], [], 0, nth + m
                return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FRAMES.split(", ")])

            for ids in e.rows(*common.text_views(batch, "text")):
                n.append(len(ids) // 4 + 1)
                frames.append(squeeze(pack(ids + end)))
                size += len(frames[-1])
                if size >= 8 * BLOCK_BYTES:
                    yield rows()
            yield rows()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, index, frames, at = 0, 0, 0, [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal block, index, frames, at
            head = struct.pack(_HEAD, MAGIC, len(index), digest)
            data = head + np.array(index, dtype=_INDEX).tobytes() + b"".join(frames)
            n, named = sum(x[3] for x in index), [x[0] for x in index if not x[1]]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(index), n, min(named, default=None), max(named, default=None))),
                    pa.array([data], pa.binary()),
                ],
                names=[x.split()[0] for x in BLOCKS.split(", ")],
            )
            block, index, frames, at = block + 1, [], [], 0
            return out

        for batch in batches:
            ids, sizes, shards = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i, (doc, n) in enumerate(zip(ids, sizes, strict=True)):
                shard, frame = shards[i], batch.column(2)[i].as_py()
                index.append((doc or 0, doc is None, first, n, at, len(frame)))
                frames.append(frame)
                first, at = first + n, at + len(frame)
                if at >= BLOCK_BYTES:
                    yield cut()
        if index:
            yield cut()

    # written before it is dealt out, since the range partitioner reads its input twice
    frames = common.written(docs.mapInArrow(common.tidy(encode), FRAMES), "token-frames", "none")
    order = ["doc_id", "tie", "nth"]
    dealt = frames.repartitionByRange(max(common.parts(spark), 1), *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "n", "frame", F.spark_partition_id().alias("shard"))
    blocks = dealt.mapInArrow(common.tidy(assemble), BLOCKS).write.option("compression", "none")
    blocks.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")  # small row groups, as a writer and a reader hold one
    return Dataset(path)


def open_block(data: bytes, digest: bytes) -> tuple[np.ndarray, memoryview]:
    """The index of a block and its frames, after a look at the magic word and the dictionary's hash."""
    magic, n, named = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or named != digest:
        raise ValueError("not a block of this dictionary")
    body = _HEAD_BYTES + n * _INDEX.itemsize
    return np.frombuffer(data, dtype=_INDEX, count=n, offset=_HEAD_BYTES), memoryview(data)[body:]


def read(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """Per document: where its ids start in the whole file, how many, and their CRC-32."""
    digest, trained = dataset.dictionary(spark)
    common.lean(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)).decompress
        for batch in batches:
            for k in range(batch.num_rows):
                index, frames = open_block(batch.column(1)[k].as_py(), digest)
                crc = []
                for x in index:
                    ids = unpack(expand(frames[int(x["at"]) : int(x["at"]) + int(x["len"])]))
                    if len(ids) != 4 * int(x["n"]):
                        raise ValueError("a frame disagrees with the index")
                    crc.append(zlib.crc32(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(index), batch.column(0)[k].as_py()), pa.int32()),
                        pa.array(index["doc_id"].astype(np.int64), pa.int64(), mask=index["null"].astype(bool)),
                        pa.array(index["first"].astype(np.int64)),
                        pa.array(index["n"].astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    blocks = dataset.blocks(spark)
    found = blocks.select("shard", "data").mapInArrow(common.tidy(decode), "shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(base), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def look_up(spark: SparkSession, dataset: Dataset, doc_id: int) -> list[list[int]]:
    """The ids of one document, from the blocks whose range of doc_ids holds it, and there from the frames that the index names."""
    digest, trained = dataset.dictionary(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)).decompress
        for batch in batches:
            for data in batch.column(0):
                index, frames = open_block(data.as_py(), digest)
                for x in index[(index["doc_id"] == doc_id) & (index["null"] == 0)]:
                    ids = np.frombuffer(unpack(expand(frames[int(x["at"]) : int(x["at"]) + int(x["len"])])), dtype="<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["ids"])

    near = dataset.blocks(spark).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    return [r["ids"] for r in near.select("data").mapInArrow(find, "ids array<long>").collect()]
