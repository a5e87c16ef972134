"""A Spark data source of documents, a file each with a line of JSON a page: `spark.read.format("quire")`, `df.write.format("quire")`.

Readers get whole files, some megabytes of them a task. Writers put each document into a folder of their own first, and tell the driver in
their commit message where it belongs; the driver moves them there when all tasks are through, each in one step, so no reader sees half a
document. What failed tasks and lost executors left goes with that folder. Paths are those that pyarrow knows (local ones and URIs).
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .decode import Decoder, from_json_lines

#: Bytes of files in a task, about.
PART_BYTES = 64 << 20
READ = "path string, page_no int, page string, error string"
WRITE = ["path", "page_no", "page"]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def decoded_file(path: str, decoder: Decoder = from_json_lines) -> list[tuple[str, int | None, str | None, str | None]]:
    """A file's pages as rows of READ; one row with its error where it cannot be read or decoded."""
    try:
        fs, at = located(path)
        with fs.open_input_stream(at) as f:
            return [(path, k, json.dumps(p), None) for k, p in enumerate(decoder(f.read()))]
    except Exception as e:  # a decoder's errors are of any kind, and are a file's result
        return [(path, None, None, f"{type(e).__name__}: {e}")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def pages_of(files: DataFrame, decoder: Decoder = from_json_lines) -> DataFrame:
    """The pages of listed files (path, ...), read where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield _batch(decoded_file(path, decoder))

    return files.select("path").mapInArrow(run, READ)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, f".{suffix.lower()}"

    def partitions(self) -> list[Files]:
        fs, at = located(self.root)
        shown = lambda p: self.root.rstrip("/") + p[len(at.rstrip("/")) :]
        hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/"))
        found = [i for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.type == pafs.FileType.File and i.path.lower().endswith(self.suffix) and not hidden(i.path)]
        parts, size = [], PART_BYTES
        for i in sorted(found, key=lambda i: i.path):
            if size + i.size > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(shown(i.path))
            size += i.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield _batch(decoded_file(path))


@dataclass
class Written(WriterCommitMessage):
    """Documents of a task: where each was put, and where it belongs."""

    documents: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staging = located(self.staging)
        fs.create_dir(staging, recursive=True)
        done, now, out = {}, None, None
        try:
            for batch in iterator:
                for path, page in zip(batch.column(WRITE.index("path")).to_pylist(), batch.column(WRITE.index("page")).to_pylist(), strict=True):
                    if path != now:
                        if out is not None:
                            out.close()
                        if path in done:
                            raise ValueError(f"the pages of {path} are not together")
                        now, done[path] = path, f"{self.staging}/{uuid.uuid4().hex}.part"
                        out = fs.open_output_stream(located(done[path])[1])
                    out.write(page.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written([(temp, path) for path, temp in done.items()])

    def commit(self, messages: list[Written]) -> None:
        every = [d for m in messages if m is not None for d in m.documents]
        twice = {p for _, p in every} if len({p for _, p in every}) < len(every) else set()
        if twice:
            self.abort(messages)
            raise ValueError("pages of one document came from several tasks")
        for temp, path in every:
            fs, to = located(path)
            fs.create_dir(posixpath.dirname(to), recursive=True)
            fs.move(located(temp)[1], to)
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        """What is not published goes."""
        fs, staging = located(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class Quire(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", "jsonl"))

    def writer(self, schema, overwrite: bool) -> Writer:
        if schema.names != WRITE:
            raise ValueError(f"documents are written from {WRITE}")
        return Writer(self.options["path"])


def read(spark: SparkSession, folder: str, suffix: str = "jsonl") -> DataFrame:
    """All documents below a folder, as rows of READ."""
    spark.dataSource.register(Quire)
    return spark.read.format("quire").option("suffix", suffix).load(folder)


def write(pages: DataFrame, folder: str) -> None:
    """Pages (path, page_no, page) as documents; each path is a file, replaced in one step if it is there. folder is on the same file system."""
    pages.sparkSession.dataSource.register(Quire)
    pages.select(*WRITE).repartition("path").sortWithinPartitions("path", "page_no").write.format("quire").mode("append").save(folder)
