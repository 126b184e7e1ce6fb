"""Near copies by similarity: SimHash fingerprints in blocks, a Hamming check, then an exact one.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8. One word of 64 bits can't
tell that: at 0.8 fingerprints differ in some ten bits, more than any split into blocks of it can bridge. So a text's
fingerprint is longer and split by shingles: these are dealt by hash to parts, and the SimHash of each part is a block.
Changed shingles spoil only the parts they fall into; if fewer shingles differ than there are parts, a block is shared
(pigeonhole), and sets of up to 64 shingles have so many parts for any pair at 0.8. Larger ones have parts of about six
shingles, of which ``BLOCKS`` are filed: a pair at 0.8 shares one with a computed chance of 0.998, others sooner. The number
of parts follows the size of the set in steps; texts in the upper range of a step are filed under the next one as well.

Texts with equal sets are one node. Nodes that share a block are candidates; those whose whole fingerprints are within
``MOST_BITS`` (asked of sets of 64 shingles or more) and whose sketches allow it are verified on the whole sets. A sketch holds,
for each of ``SKETCH`` buckets, whether an odd number of the set's shingles falls into it; a shingle that only one of two sets
holds turns one bit over, so sketches differ in no more bits than the sets in shingles, and this check loses no pair.

The nodes of a block of more than ``max_bucket`` are first verified against a few hubs, those in the most such blocks. Then pairs of
all blocks, whatever their size, are taken whose nodes are in different components so far: a large group of copies costs a row for each
node and hub, and no link of a block is left out. That step compares a full block's nodes of different components pair by
pair, which adaptive execution splits over tasks; only pairs that pass the checks leave it.

Defined results: null and empty texts are copies of each other; texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, LEAST = 5, 0.8
#: Blocks filed, shingles in a part of larger sets, the fewest that count there, and the sets from which that holds.
BLOCKS, PART, FEWEST, LARGE = 24, 6, 4, 64
MOST_BITS = 24
#: Hubs of each block of more than so many nodes as ``max_bucket`` says.
HUBS = 3
#: Bits of a sketch. It tells nothing of sets of some 2,300 shingles or more, whose limit is above half of it.
SKETCH = 1024
#: The largest set of each step; the steps span the square of 1 / LEAST, so near copies are in one step or the next.
STEPS = [int(5 / LEAST ** (2 * k)) for k in range(60)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _blocks_of_step(found: np.ndarray, step: int) -> np.ndarray:
    """A key for each block of a set under the parts of one step."""
    most = STEPS[step]
    large = most > LARGE
    n_parts = most // PART if large else 2 * most // 9 + 1
    deals = max(1, -(-BLOCKS // n_parts))  # few parts are dealt several times
    salts = _mixed(np.arange(1, deals + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    part = (_mixed(found[None, :] ^ salts[:, None]) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    part = (part + np.arange(deals, dtype=np.uint64)[:, None] * np.uint64(n_parts)).ravel()
    at = np.flatnonzero(part < BLOCKS) if n_parts > BLOCKS else np.arange(len(part))
    at = at[np.argsort(part[at], kind="stable")]
    part = part[at]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    if not len(first):
        return np.empty(0, np.uint64)
    held = np.diff(np.append(first, len(part)))
    bits = np.unpackbits(found[at % len(found)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    words = np.packbits((2 * ones > held[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    keys = _mixed(words ^ _mixed(part[first] * np.uint64(64) + np.uint64(step)))
    return keys[held >= FEWEST] if large else keys


def block_keys(found: np.ndarray) -> np.ndarray:
    """The keys under which a shingle set is filed."""
    if not len(found):
        return np.empty(0, "<i8")
    step = next(k for k, most in enumerate(STEPS) if len(found) <= most)
    keys = [_blocks_of_step(found, step)]
    if len(found) >= LEAST * STEPS[step]:
        keys.append(_blocks_of_step(found, step + 1))
    return np.unique(np.concatenate(keys)).view("<i8")


def _whole(found: np.ndarray) -> int:
    """SimHash of a whole set, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        ones += np.unpackbits(found[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(found)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _sketch(found: np.ndarray) -> np.ndarray:
    """Words of the parities of a set's buckets."""
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _node(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7), "<u8").view("<i8"))


def with_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, node, n, fp, sketch, blocks): one row per input row; ``n`` is the size of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            blocks = [block_keys(s) for s in sets]
            ends = np.cumsum([0, *map(len, blocks)]).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_whole(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<i8"), *blocks]))),
                ],
                names=["doc_id", "digest", "node", "n", "fp", "sketch", "blocks"],
            )

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, digest long, node long, n long, fp long, sketch array<long>, blocks array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """(node, found): the shingle sets of the ``wanted`` (node, digest), from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype("<i4")
            found = np.concatenate([np.empty(0, np.uint64), *sets]).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=["node", "found"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.xxhash64(text).alias("digest"), text.alias("text"))
    if common.size_bounded(wanted, broadcast_rows):
        wanted = F.broadcast(wanted)
    one = src.join(wanted, "digest").select("node", "text").dropDuplicates(["node"])
    return common.written(one.mapInArrow(run, "node long, found array<long>"), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of at least that similarity."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("found_b")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("found").alias("found_a")), "a")
    shared = F.size(F.array_intersect("found_a", "found_b"))
    return both.where(shared / (F.size("found_a") + F.size("found_b") - shared) >= least).select("a", "b")


def _candidates(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b), a the smaller: those of the pairs (node, n, fp, sketch, b, nb, fpb, sketch_b) that pass the size, Hamming and sketch checks."""
    small = F.least("n", "nb")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("fpb")))
    odd = reduce(add, [F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH // 64)])
    near = pairs.where(small / F.greatest("n", "nb") >= least).where((small < LARGE) | (bits <= MOST_BITS))
    # the sets differ in at most (1 - least) / (1 + least) of their sizes' sum
    near = near.where(odd * (1 + least) <= (F.col("n") + F.col("nb")) * (1 - least) + 1e-6)
    return near.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str, least: float = LEAST, max_bucket: int = 32, broadcast_rows: int = 200_000) -> DataFrame:
    """Verified links (a, b) between the ``nodes`` (node, n, fp, sketch, digest, blocks), enough to connect all that share a block and are alike."""
    own = ["node", "n", "fp", "sketch"]
    of = lambda df, *more: df.select("key", *more, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fp").alias("fpb"), F.col("sketch").alias("sketch_b"))
    filed = common.written(nodes.select("node", F.explode("blocks").alias("key")), "near-filed")
    # written, so that a hot key's rows can be split
    sizes = common.written(filed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "near-sizes")
    shared = common.written(filed.join(sizes, "key"), "near-shared")
    base = common.written(shared.join(nodes.select(*own), "node"), "near-blocks")
    wanted = common.written(shared.select("node").distinct().join(nodes.select("node", "digest"), "node"), "near-wanted")
    sets = _sets(docs, wanted, text_col, broadcast_rows)

    # nodes of the most full blocks first: the text that others of a group were made from has spoiled none of them
    full = base.where(F.col("held") > max_bucket)
    central = common.written(full.groupBy("node").agg(F.count("*").alias("full")), "near-central")
    drawn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("full"), F.xxhash64("node"), "node"))
    hubs = common.written(full.join(central, "node").select("key", *own, drawn.alias("k")).where(F.col("k") <= HUBS), "near-hubs")
    tried = common.written(_candidates(full.join(of(hubs), "key").where("node <> b"), least).distinct(), "near-tried")
    first = common.written(_alike(tried, sets, least), "near-first")

    # what hubs leave apart, in all blocks
    labels = common.written(simhash.components(first), "near-parts")
    parts = base.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("held")
    parts = common.written(parts, "near-apart")
    pairs = parts.join(of(parts, F.col("label").alias("label_b")), "key").where("node < b and label <> label_b")
    pairs = common.written(_candidates(pairs, least).distinct(), "near-pairs")
    return first.unionByName(common.written(_alike(pairs, sets, least), "near-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, digest, label): label names the component of near copies."""
    rows = common.written(with_blocks(docs, id_col, text_col), "near-rows")
    one = [F.first(c).alias(c) for c in ("n", "fp", "sketch", "blocks")]
    nodes = common.written(rows.groupBy("node").agg(F.min("digest").alias("digest"), *one), "near-nodes")
    labels = common.written(simhash.components(links(docs, nodes, text_col, **options)), "near-labels")
    return rows.select("doc_id", "digest", "node").join(labels, "node", "left").select("doc_id", "digest", F.coalesce("label", "node").alias("label"))
