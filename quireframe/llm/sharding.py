"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows stand on a ring of 65,536 cells by a hash of their id, and each shard has several virtual nodes on it. A row belongs to the next
node clockwise; each shard has a capacity, and what a full shard cannot take goes on clockwise to the next one that has room. Cells
are filled in the order of a hash, as the rows that come first have their place, so a further shard or row changes little.

Only the weight of each cell goes to the driver, a table whose size does not depend on the rows; what comes back says up to
which offset a cell's rows go to which shard. Rows find their offset by a window over their cell. A cell of more than UNIT_ROWS
rows (rows that share an id) is dealt over several units first, so no group of rows with one key lands in a task.

Capacities add up to the total, if no slack is given, so by law `rows` the counts of two shards differ by one at most, and by law `bytes` a
row goes where its first byte does, so sizes differ by some rows at the borders. With slack, shards may take so much more than their
share, and fewer rows leave their own shard.

Defined results: a null text has no bytes and the checksum 0; a null id is a key like any other; rows that share an id, repeated
rows too, are placed one by one, and equal texts are not kept together, as a group of copies may be larger than a shard; an empty table gives no rows.
Columns of the input that are called like one of the result give way to it. `key` is not a law of this operator, as a full shard
moves rows by what other rows weigh; grown_shard is null.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

SHARDS, NODES, CELL_BITS = 40, 128, 16
#: Most rows, about, that are put in order together.
UNIT_ROWS = 100_000
ROW_BYTES = 16
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "home"]


def _hash(what: str) -> int:
    return int.from_bytes(hashlib.sha256(what.encode()).digest()[:8], "big")


def ring(shards: int, nodes: int = NODES) -> tuple[list[int], list[int]]:
    """The cells of all virtual nodes in order, and whose they are."""
    at = sorted((_hash(f"{s}:{v}"), s) for s in range(shards) for v in range(nodes))
    return [h >> 64 - CELL_BITS for h, _ in at], [s for _, s in at]


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    least, more = divmod(total, shards)
    return [-(-int(total * (1 + slack)) // shards)] * shards if slack else [least + (s < more) for s in range(shards)]


def fill(cells: Sequence[tuple[int, int]], shards: int, nodes: int = NODES, slack: float = 0.0) -> list[tuple[int, int, list[int], list[int]]]:
    """Cells with their weights to (cell, own shard, ends, shards): what lies before the first end goes to the first shard, and so on."""
    places, owner = ring(shards, nodes)
    room = capacities(sum(w for _, w in cells), shards, slack)
    after = [*range(1, len(owner)), 0]

    def open_from(k: int) -> int:
        passed = []
        while not room[owner[k]]:
            passed.append(k)
            k = after[k]
        for p in passed:
            after[p] = k
        return k

    out = []
    for cell, weight in sorted(cells, key=lambda c: _hash(f"cell {c[0]}")):
        k = home = bisect.bisect_left(places, cell) % len(places)
        at, ends, to = 0, [], []
        while at < weight:
            k = open_from(k)
            took = min(weight - at, room[owner[k]])
            room[owner[k]] -= took
            at += took
            ends.append(at)
            to.append(owner[k])
        out.append((cell, owner[home], ends, to))
    return out


def _plan(spark: SparkSession, base: DataFrame, weight: str, shards: int, nodes: int, slack: float, unit_rows: int) -> tuple[DataFrame, bool]:
    """The plan of all cells, as many rows at most as there are cells; and whether any cell has several units."""
    seen = base.groupBy("cell").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()
    units = {r.cell: -(-r.n // unit_rows) for r in seen}
    filled = fill([(r.cell, r.w) for r in seen], shards, nodes, slack)
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    cols = [pa.array([f[k] for f in filled], t) for k, t in enumerate(kinds)]
    plan = pa.table([*cols, pa.array([units[f[0]] for f in filled], pa.int64())], names=["cell", "home", "ends", "to", "units"])
    return F.broadcast(spark.createDataFrame(plan)), any(u > 1 for u in units.values())


def assign(
    docs: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.0, nodes: int = NODES, keep: Sequence[str] | None = None, id_col: str = "doc_id",
    text_col: str = "text", unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """Rows with size, text_crc32, law, shard, slot (their place in the shard, from 0), grown_shard and home (the shard they would be in if none
    were ever full). keep names the columns that stay; all do by default."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    spark, text = docs.sparkSession, common.empty_if_null(F.col(text_col))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(id_col), 64 - CELL_BITS).cast("int").alias("cell"), F.xxhash64(id_col, text_col).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    base = common.written(base, "sharding-rows").withColumn("one", F.lit(1).cast("long"))
    weight = "one" if law == "rows" else "size"
    plan, parted = _plan(spark, base, weight, shards, nodes, slack, unit_rows)
    rows = base.join(plan, "cell").withColumn("unit", F.pmod("spread", "units"))
    order = Window.partitionBy("cell", "unit").orderBy("tie", "spread")
    rows = rows.withColumn("at", F.sum(weight).over(order) - F.col(weight)).withColumn("nth", F.row_number().over(order))
    if parted:
        before = Window.partitionBy("cell").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
        part = base.join(plan.where("units > 1"), "cell").groupBy("cell", F.pmod("spread", "units").alias("unit")).agg(F.sum(weight).alias("w"))
        part = part.select("cell", "unit", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))
        rows = rows.join(part, ["cell", "unit"], "left").withColumn("at", F.col("at") + F.coalesce("start", F.lit(0)))
    rows = rows.withColumn("shard", F.get("to", F.size(F.filter("ends", lambda e: e <= F.col("at")))))
    met = rows.groupBy("shard", "cell", "unit").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    so_far = Window.partitionBy("shard").orderBy("cell", "unit").rowsBetween(Window.unboundedPreceding, -1)  # of cells, not of rows
    met = met.select("shard", "cell", "unit", "first", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("past"))
    slot = F.col("past") + F.col("nth") - F.col("first")
    return rows.join(met, ["shard", "cell", "unit"]).select(
        *[F.col("row").getField(c).alias(c) for c in kept], "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home",
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """The rows as files, a folder a shard (`shard=0`, ...), in the order of their slots; a large shard has several files."""
    placed = assign(docs, shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """What was written; of one shard, if it is named, only whose files are read."""
    rows = spark.read.parquet(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)
