"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one text; a window is repeated if its word sequence starts at another place
too. COVER is a difference cover modulo PERIOD: for any two places i and j there is a shift k below PERIOD that brings
both onto cover positions. So two equal windows share a short anchor of ``window - PERIOD + 1`` words that starts at a
cover position in both. Step one hashes anchors at cover positions only and finds those seen twice. Step two extends
every such anchor to all full windows around it, hashes those with 96 bits and finds the ones seen twice: this is exact
but for hash collisions, needs no pairs, and a window that shares no anchor is never hashed in full.

Rows are packed into chunks of about ``CHUNK_BYTES`` of text, written once. Each task sorts the distinct hashes of a chunk
into buckets by value; one row per (chunk, bucket) is shuffled, so a passage that fills a third of the corpus reaches its
bucket once per chunk, and buckets stay even. A bucket answers each chunk with one bit per hash, and the chunk's next step
computes its hashes again and reads the bits. The number of buckets follows the word count of the corpus.

Defined results: null and empty texts have no words; windows do not cross texts; repeated rows are documents of their
own, so equal rows make each other's windows repeated (rows with one id and equal texts are told apart by count); the
hash of no kept words is that of the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A perfect difference set: every residue modulo 21 is the difference of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WINDOW = 35
#: Text in one chunk, and hashes in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 1 << 20, 8 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096, 2 * len(have[0]) if have else 0)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[base] = (tables[0], tables[1])
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(33))


def run_hashes(codes: np.ndarray, starts: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of ``length`` codes from each of ``starts``: differences of one running sum of codes times powers."""
    powers, inverse = _power_table(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=sums[1:])
    return _mixed((sums[starts + length] - sums[starts]) * inverse[starts])


def difference_places(starts: np.ndarray) -> np.ndarray:
    """Those of ``starts`` on cover positions."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    return starts[cover[starts % PERIOD]]


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Whether each word lies in a window that begins at one of ``starts``."""
    mark = np.zeros(n_words + 1, np.int64)
    mark[starts] += 1
    mark[starts + window] -= 1  # starts are distinct, and so are their ends
    return np.cumsum(mark[:n_words]) > 0


_memo = _Hashes()


class Chunk:
    """The words of some documents, and the hashes that stand for their windows."""

    def __init__(self, body: bytes, window: int):
        self.window = window
        self.docs = [x.split() for x in zstandard.decompress(body).split(b"\n")]
        self.bounds = np.cumsum([0, *map(len, self.docs)])
        n = int(self.bounds[-1])
        self.codes = np.fromiter((_memo[w] for doc in self.docs for w in doc), np.uint64, n)
        #: End of the document of each word.
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.starts = np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def anchors(self) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(places, hashes) of the anchors in documents of at least one window."""
        length = self.window - PERIOD + 1
        place = np.arange(len(self.codes))
        fits = (place + length <= self.ends) & (self.ends - self.starts >= self.window)
        place = difference_places(place[fits])
        return place, (run_hashes(self.codes, place, length),)

    def windows(self, places: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(starts, hashes) of all full windows that hold an anchor starting at one of ``places``."""
        mark = np.zeros(len(self.codes) + 1, np.int64)
        low = np.maximum(places - PERIOD + 1, self.starts[places])
        high = np.minimum(places, self.ends[places] - self.window)
        np.add.at(mark, low[low <= high], 1)
        np.add.at(mark, high[low <= high] + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        second = run_hashes(self.codes, starts, self.window, _BASES[1])
        return starts, (run_hashes(self.codes, starts, self.window), (second >> np.uint64(32)).astype(np.uint32))


class Blocks:
    """The distinct ones of some hashes, in order, cut into buckets by the leading bits of the first."""

    def __init__(self, hashes: tuple[np.ndarray, ...], n_buckets: int):
        n = len(hashes[0])
        order = np.lexsort(hashes[::-1])
        hashes = tuple(h[order] for h in hashes)
        new = np.ones(n, bool)
        if n:
            new[1:] = np.logical_or.reduce([h[1:] != h[:-1] for h in hashes])
        at = np.flatnonzero(new)
        #: Where each of the given hashes is among the distinct ones.
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.twice = np.diff(np.append(at, n)) > 1
        self.hashes = tuple(h[at] for h in hashes)
        bucket = (self.hashes[0] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        self.edges = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))

    def rows(self, chunk: int) -> Iterator[tuple]:
        for b in np.flatnonzero(np.diff(self.edges)).tolist():
            part = slice(self.edges[b], self.edges[b + 1])
            yield b, chunk, np.packbits(self.twice[part]).tobytes(), *(h[part].tobytes() for h in self.hashes)

    def flags(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """For each hash given at first, the bit that its bucket answered."""
        seen = np.zeros(len(self.twice), bool)
        for b, bits in answers:
            lo, hi = self.edges[b], self.edges[b + 1]
            seen[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        return seen[self.of]


def _pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, n_words, body): body is one line of words per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lines: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            body = b"\n".join(lines)
            n = sum(x.count(b" ") + 1 for x in lines if x)
            number = int.from_bytes(os.urandom(8), "little") >> 1
            cols = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([zstandard.compress(body, 3)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "n_words", "body"])

        for b in common.slices(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                lines.append(b" ".join((text or "").encode("utf-8", "surrogatepass").split()))
                size += len(lines[-1])
                if size >= chunk_bytes:
                    yield packed()
                    ids, lines, size = [], [], 0
        if ids:
            yield packed()

    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(run, "chunk long, ids array<long>, n_words long, body binary")


_BLOCK = "bucket int, chunk long, twice binary, h1 binary, h2 binary"
_ANSWER = "chunk long, step int, bucket int, bits binary"


def _block_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "twice", "h1", "h2"])


def seen_again(blocks: pa.Table, step: int) -> pa.Table:
    """Answers of one bucket: a bit for each hash of each block, set if the hash has another place."""
    first = [np.frombuffer(x, np.uint64) for x in blocks["h1"].to_pylist()]
    sizes = [len(x) for x in first]
    hashes = [np.concatenate(first)]
    second = blocks["h2"].to_pylist()
    if any(second):
        hashes.append(np.concatenate([np.frombuffer(x, np.uint32) for x in second]))
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(blocks["twice"].to_pylist(), sizes, strict=True)]).astype(bool)
    order = np.lexsort(hashes[::-1])
    same = np.logical_and.reduce([h[order][1:] == h[order][:-1] for h in hashes])
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
    n = len(sizes)
    return pa.table([blocks["chunk"], pa.array([step] * n, pa.int32()), blocks["bucket"], pa.array(bits, pa.binary())], names=["chunk", "step", "bucket", "bits"])


def _answers(blocks: DataFrame, step: int) -> DataFrame:
    return blocks.groupBy("bucket").applyInArrow(lambda t: seen_again(t, step), _ANSWER)


def _of_step(answers: pa.Table, step: int) -> list[tuple[int, bytes]]:
    return [(b, x) for s, b, x in zip(*(answers[c].to_pylist() for c in ("step", "bucket", "bits")), strict=True) if s == step]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per input row; kept is the words that no repeated window covers,
    joined by one space."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    chunks = common.written(_pack(docs, id_col, text_col, chunk_bytes), "substring-chunks")
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words * 8 // bucket_bytes))

    def anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, hashes = Chunk(body, window).anchors()
                yield from _block_table([(*row, b"") for row in Blocks(hashes, n_buckets).rows(number)]).to_batches()

    def window_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, body in zip(left["chunk"].to_pylist(), left["body"].to_pylist(), strict=True):
            chunk = Chunk(body, window)
            places, hashes = chunk.anchors()
            _, full = chunk.windows(places[Blocks(hashes, n_buckets).flags(_of_step(right, 1))])
            rows += Blocks(full, n_buckets).rows(number)
        return _block_table(rows)

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for ids, body in zip(left["ids"].to_pylist(), left["body"].to_pylist(), strict=True):
            chunk = Chunk(body, window)
            places, hashes = chunk.anchors()
            starts, full = chunk.windows(places[Blocks(hashes, n_buckets).flags(_of_step(right, 1))])
            starts = starts[Blocks(full, n_buckets).flags(_of_step(right, 2))]
            gone = covered(starts, len(chunk.codes), window)
            for k, (i, words) in enumerate(zip(ids, chunk.docs, strict=True)):
                mine = gone[chunk.bounds[k] : chunk.bounds[k + 1]]
                n = int(mine.sum())
                kept = words if not n else [w for w, g in zip(words, mine.tolist(), strict=True) if not g]
                out.append((i, len(words), n, b" ".join(kept)))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    first = common.written(_answers(chunks.select("chunk", "body").mapInArrow(anchor_blocks, _BLOCK), 1), "substring-anchors")
    blocks = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(window_blocks, _BLOCK)
    second = common.written(_answers(blocks, 2), "substring-windows")
    both = first.unionByName(second)
    out = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP6 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as k from d, lateral (select unnest(range(1, len(w) - 33)) as i)),
s as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as c from x) where c > 1),
g as (select distinct doc_id, i + j as p from s, (select unnest(range(35)) as j)),
p as (select doc_id, w[p] as word, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
k as (
  select doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(word, ' ' order by p.p) filter (g.p is null) as kept
  from p left join g using (doc_id, p) group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
