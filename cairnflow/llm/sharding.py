"""Sharding by a keyed permutation of row numbers.

Rows are numbered from 0 in ascending order of id and text, whatever the partitioning. A Feistel network with cycle walking
permutes the numbers: halves of equal width are mixed ``ROUNDS`` times under keys drawn from the seed, and what falls on no
row is mixed again until it does. The image ``p`` of a row is its place in the shuffled whole: shard ``p % shards``, slot ``p // shards``. So
shards differ by at most one row, slots have no gaps, and ``Shuffle`` computes the shard and slot of a row, or the row of a
shard and slot, from the row count and the seed alone.

One range sort moves the rows, and their partition's place in the order and place in the partition are written with them;
of that table the driver gets one count for each partition. Rows equal in id and text are told apart by their place in the source, so
a hot id is split too.

Defined results: a null id sorts first; null and empty texts are texts like any other; of rows equal in id and text any
order; other columns are kept, and those named as the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS, SHARDS, SEED = 6, 16, 0
#: ``monotonically_increasing_id`` has the partition above these bits and the place in it below.
_BITS = 33


class Shuffle:
    """The permutation of ``rows`` row numbers under ``seed``, dealt to ``shards``. All calls take and give numpy arrays."""

    def __init__(self, rows: int, shards: int = SHARDS, seed: int = SEED):
        if shards < 1:
            raise ValueError("a shuffle needs at least one shard")
        self.rows, self.shards = rows, shards
        self.half = max(1, ((max(rows, 1) - 1).bit_length() + 1) // 2)
        digest = lambda r: hashlib.sha256(f"{seed}:{rows}:{r}".encode()).digest()[:8]
        self.keys = np.array([int.from_bytes(digest(r), "little") for r in range(ROUNDS)], np.uint64)

    def _mixed(self, side: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (side ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64((1 << self.half) - 1)
        for key in self.keys[::-1] if inverse else self.keys:
            left, right = (right ^ self._mixed(left, key), left) if inverse else (right, left ^ self._mixed(right, key))
        return left << half | right

    def _walked(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if len(x) and (x.min() < 0 or x.max() >= self.rows):
            raise ValueError(f"not all of the numbers are below {self.rows}")
        out = self._network(x.astype(np.uint64), inverse)
        off = np.flatnonzero(out >= np.uint64(self.rows))
        while len(off):
            out[off] = self._network(out[off], inverse)
            off = off[out[off] >= np.uint64(self.rows)]
        return out.astype(np.int64)

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of each row number."""
        at = self._walked(rows, False)
        return at % self.shards, at // self.shards

    def rows_at(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Row number of each shard and slot."""
        return self._walked(np.asarray(slot, np.int64) * self.shards + shard, True)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, np.ndarray]:
    """``docs`` sorted by id and text and written, the name of its column of places, and the number of rows before each partition's
    (the last: of all rows)."""
    at, digest, source = common.unused(docs, "_at", "_digest", "_source")
    src = docs.withColumns({digest: F.xxhash64(F.col(text_col).cast("string")), source: F.monotonically_increasing_id()})
    src = src.orderBy(id_col, digest, source).drop(digest, source).withColumn(at, F.monotonically_increasing_id())
    table = common.written(src, "shards-in-order")
    part = F.shiftright(F.col(at), _BITS).alias("part")
    counts = table.groupBy(part).agg(F.count("*").alias("n")).collect()  # one row a partition
    sizes = np.zeros(max((r.part for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        sizes[r.part] = r.n
    return table, at, np.concatenate([[0], np.cumsum(sizes)])


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``row`` (long, the row number), ``shard`` (int) and ``slot`` (long)."""
    table, at, before = in_order(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast((before, Shuffle(int(before[-1]), shards, seed)))

    @F.arrow_udf("row long, shard int, slot long")
    def place(found: pa.Array) -> pa.Array:
        starts, shuffle = known.value
        found = found.to_numpy(zero_copy_only=False)
        row = starts[found >> _BITS] + (found & ((1 << _BITS) - 1))
        shard, slot = shuffle.placed(row)
        return pa.StructArray.from_arrays([pa.array(row), pa.array(shard.astype(np.int32)), pa.array(slot)], ["row", "shard", "slot"])

    new = ["row", "shard", "slot"]
    (place_col,) = common.unused(table, "_place")
    keep = [c for c in docs.columns if c.lower() not in new]
    return table.withColumn(place_col, place(F.col(at))).select(*keep, *[F.col(f"{place_col}.{c}").alias(c) for c in new])


def write_shards(placed_docs: DataFrame, path: str) -> None:
    """Writes one folder ``shard=k`` for each shard, its files and their rows in the order of slots."""
    ranged = placed_docs.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    with common.batch_rows(placed_docs.sparkSession):
        ranged.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = placed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row",
    )
