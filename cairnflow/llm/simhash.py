"""SimHash near-duplicate grouping by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints within ``max_bits`` differ in at most ``max_bits`` of ``BLOCKS`` blocks, so
they agree on the other blocks. Every distinct fingerprint is filed under each choice of agreeing blocks, fingerprints
under one key are joined and the Hamming distance is verified. Keys with more than ``max_bucket`` fingerprints are not
joined pair by pair: their fingerprints are filed under every word one bit away (and their own). Two words within two
bits share such a neighbour, and two that share one are within two bits, so that path is exact and linear.
Components come from repeated minimum-label steps; every step's labels are written to the shared folder.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows and repeated ids
give one output row each; a null id never names a component unless the component holds null ids only; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Block limits in bits: five blocks of 13, 13, 13, 13 and 12.
BLOCK_BITS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of one text, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a:b], seed)
            for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text, repeats included."""
    h = shingle_hashes(text, shingle, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, digest, fp): one row per input row; digest is the xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view("<i8"))], names=["doc_id", "digest", "fp"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, digest long, fp long")


def _block_keys(max_bits: int) -> F.Column:
    """Array of (which, key): the bits of every choice of blocks that must agree."""
    keys = []
    for n, agree in enumerate(combinations(BLOCK_BITS, len(BLOCK_BITS) - max_bits)):
        mask = sum(((1 << width) - 1) << at for at, width in agree)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("which"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def fingerprint_links(fps: DataFrame, max_bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within ``max_bits`` (at most two)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the exact way for full buckets holds for at most two bits")
    filed = fps.select("fp", F.explode(_block_keys(max_bits)).alias("k")).select("fp", "k.which", "k.key")
    # written, so that the join has plain exchanges on both sides and adaptive execution can split a hot block
    sizes = common.written(filed.groupBy("which", "key").count().where("count > 1"), "simhash-sizes")
    filed = common.written(filed.join(sizes, ["which", "key"]), "simhash-blocks")
    small = filed.where(F.col("count") <= max_bucket).select("which", "key", "fp")
    pairs = (
        small.join(small.withColumnRenamed("fp", "fp2"), ["which", "key"])
        .where("fp < fp2")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    full = filed.where(F.col("count") > max_bucket).select("fp").distinct()
    flips = F.array(F.lit(0), *(F.lit((1 << i) - ((1 << i) >> 63 << 64)) for i in range(64)))
    if max_bits == 1:
        near = full.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("b"))
        stars = near.join(full.select(F.col("fp").alias("b")), "b").where("fp < b").select(F.col("fp").alias("a"), "b")
    elif max_bits == 2:
        near = full.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("at"))
        hubs = near.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
        hubs = common.written(hubs, "simhash-hubs")
        stars = near.join(hubs, "at").where("a < fp").select("a", F.col("fp").alias("b"))
    else:
        return pairs.distinct()
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable. Large-star and small-star steps until nothing changes. The least
    neighbours of each step are written before they are joined, so that adaptive execution can split a hub's edges."""
    spark, kept = edges.sparkSession, common.scratch_path(edges.sparkSession, "cc")
    both = edges.where("a <> b")
    now = common.written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", kept)
    before = None
    for _ in range(max_rounds):
        last, kept = kept, common.scratch_path(spark, "cc")
        with common.scratch_dropped():
            sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = common.written(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
            large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = common.written(large, "cc-large")
            low = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
            star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            now = common.written(star.select("e.u", "e.v").where("u <> v").distinct(), "cc", kept)
        common.drop_path(spark, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, max_bucket: int = 64
) -> DataFrame:
    """(doc_id, fp, component_id, digest, label): component_id is the smallest id among all rows reachable over links;
    label names the component, too, by its smallest fingerprint."""
    rows = common.written(with_fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    fps = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    labels = components(fingerprint_links(fps.select("fp"), max_bits, max_bucket))
    member = fps.join(labels, fps.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    # written, so that joins have plain exchanges on both sides and adaptive execution can split a large component
    member = common.written(member, "simhash-members")
    ids = common.written(member.groupBy("label").agg(F.min("first_id").alias("component_id")), "simhash-components")
    named = member.join(ids, "label").select("fp", "component_id", "label")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "digest", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each component that ``find`` names: that of the smallest id (null last), then text hash.
    The keys to drop are broadcast up to ``broadcast_rows``."""
    rows = find(docs, id_col, text_col, **options)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    keys = common.written(rows.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n")), "simhash-keys")
    first = common.written(keys.groupBy("label").agg(F.min(key).alias("k")).select(F.col("label").alias("of"), "k"), "simhash-first")
    i, d, mine = common.unused(docs, "_id", "_digest", "_mine")
    marked = keys.join(first, F.col("label") == F.col("of")).withColumn("stays", key.eqNullSafe(F.col("k")))
    marked = common.written(marked.select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("n").alias("copies"), "stays"), "simhash-stays")
    digest = F.xxhash64(docs[text_col].cast("string"))
    on = docs[id_col].cast("long").eqNullSafe(F.col(i)) & (digest == F.col(d))

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if common.size_bounded(df, broadcast_rows) else df

    gone = marked.where("not stays").select(i, d)
    twice = marked.where("stays and copies > 1").select(i, d)
    if twice.isEmpty():
        return docs.join(sized(gone), on, "left_anti")
    once = docs.join(sized(gone.unionByName(twice)), on, "left_anti")
    extra = docs.join(sized(twice), on, "left_semi").withColumn(mine, digest)
    return once.unionByName(extra.dropDuplicates([id_col, mine]).drop(mine))


def op9(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
