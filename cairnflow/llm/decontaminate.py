"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words are the lower-case runs of letters, digits and underscores. An item of n words is in a document if some span of
consecutive words of the document is within ``k = floor((1 - similarity) * n)`` word edits of it.

An item with few edits is looked for as one window of its own size, a longer one in segments, so that k edits leave at
least one segment with ``SEGMENT_EDITS`` edits or fewer (k edits over s segments: one has k / s at most). Windows of each
segment size are first thinned by a condition that any such window meets: of its runs of g words (g = 1, 2, 3) at least
``n - g + 1 - g * edits`` are also in a segment of this size, since one edit breaks g runs. The CGK walk copies the
current word and steps on by a random bit of (step, word), so that few edits lead to few differing steps; each repetition
samples some steps as its key, and window and segment are candidates if they agree on a key. The number of repetitions
is chosen by trials on one segment with as many edits as the worst spread of k edits leaves it, so that an item is found with
probability ``recall`` wherever its edits are; if no number reaches it, this is an error. An item without edits is always found. Around each candidate the exact word edit distance of the whole
item to the best span is computed.

Items are taken in blocks of about ``BLOCK_WORDS`` words. ``PASS_BLOCKS`` blocks at most are broadcast at a time, and
each such pass reads all documents once; nothing of the documents is shuffled but the items found.

Defined results: items without a word match nothing; where k is 0 (four words or fewer, at 0.8) an item is found word for
word; null texts have no words; equal rows of one id and text are one document; a document and an item give one row, with
the nearest span, of several that which ends first, then the shortest (among the spans around candidates); an empty table
on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIMILARITY, RECALL = 0.8, 0.98
#: Words of the items in one block, and blocks in one broadcast.
BLOCK_WORDS, PASS_BLOCKS = 50_000, 20
#: Edits in the segment that is looked for, steps in a key, and the most repetitions.
SEGMENT_EDITS, SAMPLED, MOST_REPEATS = 2, 3, 256
_WORD = re.compile(r"\w+")
_FOUND = "doc_id long, digest long, item long, start int, n_words int, distance int"


class _Codes(dict):
    """Word to 64-bit hash other than zero, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        if len(self) < 150_000:
            self[word] = h
        return h


_memo = _Codes()


def codes_of(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def run_codes(codes: np.ndarray, g: int) -> np.ndarray:
    """A code for each run of g words along the last axis."""
    n = max(codes.shape[-1] - g + 1, 0)
    x = codes[..., :n].copy()
    for k in range(1, g):
        x = x * np.uint64(0x9E3779B97F4A7C15) + codes[..., k : n + k]
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(offset, words) of the segments of an item of n words, of which one holds ``SEGMENT_EDITS`` of k edits at most."""
    count = min(n, -(-(k + 1) // (SEGMENT_EDITS + 1)))
    cuts = [i * n // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def runs_needed(n: int, edits: int) -> dict[int, int]:
    return {g: n - g + 1 - g * edits for g in (1, 2, 3)}


def walk_keys(windows: np.ndarray, repeats: int, first: int = 0, sampled: int = SAMPLED, seed: int = 8) -> np.ndarray:
    """Keys of windows of one size (rows of codes): one column for each repetition from ``first`` on."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
    rows = np.arange(m)
    keys = np.empty((m, repeats - first), np.uint64)
    for r in range(first, repeats):
        rnd = np.random.default_rng((seed, n, r))
        odd = rnd.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        wanted = set(rnd.choice(2 * n, min(sampled, 2 * n), replace=False).tolist())
        at = np.zeros(m, np.int64)
        key = np.full(m, np.uint64((n << 20) + r))
        for step in range(max(wanted) + 1):
            word = padded[rows, at]
            if step in wanted:
                key = (key ^ word) * np.uint64(0x94D049BB133111EB)
                key ^= key >> np.uint64(32)
            at = np.minimum(at + (word * odd[step] >> np.uint64(63)).astype(np.int64), n)
        keys[:, r - first] = key
    return keys


def edited(codes: np.ndarray, k: int, rnd: np.random.Generator, kinds: int = 3, only: int | None = None, places: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` after k random edits, and each word's place before (-1: new). An edit is a replacement, a deletion or an insertion;
    of these the first ``kinds``, or the one numbered ``only``. ``places`` are those of the edits in ``codes``, else random ones."""
    out = list(zip(codes.tolist(), range(len(codes)), strict=True))
    for i in range(k):
        if places is None:
            at = int(rnd.integers(len(out)))
        else:
            at = next((j for j, (_, p) in enumerate(out) if p >= places[i]), len(out) - 1)
        kind = int(rnd.integers(kinds)) if only is None else only
        new = (int(rnd.integers(1, 1 << 63)), -1)
        if kind == 0:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return np.array([c for c, _ in out], np.uint64), np.array([p for _, p in out])


def _shared_runs(windows: np.ndarray, own: np.ndarray, g: int) -> np.ndarray:
    a, b = run_codes(windows, g), run_codes(own, g)
    return (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)


@lru_cache(maxsize=10_000)
def _repeats(n: int, k: int, recall: float, trials: int) -> int:
    rnd = np.random.default_rng((7, n, k))
    own, windows = [], []
    for t in range(3 * trials):
        segment, after = rnd.integers(1, 1 << 63, n).astype(np.uint64), rnd.integers(1, 1 << 63, n).astype(np.uint64)
        text, place = edited(segment, k, rnd, only=t % 3)
        left = np.flatnonzero(place >= 0)  # the window from the first word of the segment that is left
        text = np.concatenate([text[int(left[0]) if len(left) else 0 :], after])
        own.append(segment)
        windows.append(text[:n])
    own, windows, kind = np.stack(own), np.stack(windows), np.arange(3 * trials) % 3
    thin = np.logical_and.reduce([np.ones(3 * trials, bool), *[_shared_runs(windows, own, g) >= need for g, need in runs_needed(n, k).items() if need > 0]])
    found = np.zeros(3 * trials, bool)
    for r in range(MOST_REPEATS):
        found |= thin & (walk_keys(windows, r + 1, r) == walk_keys(own, r + 1, r))[:, 0]
        if min(found[kind == x].mean() for x in range(3)) >= recall:
            return r + 1
    raise ValueError(f"segments of {n} words with {k} edits aren't found with probability {recall} in {MOST_REPEATS} repetitions")


def repeats_for(n: int, recall: float = RECALL, similarity: float = SIMILARITY, trials: int = 200) -> int:
    """Repetitions that find items of n words after k edits with probability ``recall``, wherever the edits are: enough for the
    worst case, in which the one segment that must have few edits has as many as that allows and all others more. Replacements, deletions and
    insertions are tried each by themselves."""
    k = edits_allowed(n, similarity)
    parts = segments(n, k)
    edits = k // len(parts)
    return max((_repeats(size, edits, recall, trials) for size in {size for _, size in parts}), default=1) if edits else 1


def best_spans(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of the span of each row of ``texts`` that is nearest to the item in the same row; of equal
    ones that which ends first, then the shortest. Beyond ``most`` edits start and end are 0. Zeros in texts fill up."""
    m, n = items.shape
    ends = _edit_rows(items, texts, np.zeros(texts.shape[1] + 1, np.int32))
    distance, end, start = ends.min(axis=1), ends.argmin(axis=1), np.zeros(m, np.int64)
    near = np.flatnonzero(distance <= most)
    end[distance > most] = 0
    if len(near):
        width = min(n + most, texts.shape[1])
        at = end[near, None] - 1 - np.arange(width)
        back = np.where(at >= 0, texts[near[:, None], np.maximum(at, 0)], np.uint64(0))
        rows = _edit_rows(items[near, ::-1], back, np.arange(width + 1, dtype=np.int32))
        start[near] = end[near] - (rows == distance[near, None]).argmax(axis=1)
    return distance, start, end


def _edit_rows(items: np.ndarray, texts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Last rows of the edit matrices of the rows of ``items`` and ``texts`` whose first rows are ``first``."""
    steps = np.arange(texts.shape[1] + 1, dtype=np.int32)
    before = np.tile(first, (len(items), 1))
    for i in range(items.shape[1]):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (texts != items[:, i : i + 1]))
        # an insertion costs one for each column that it moves on
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    return before


class Block:
    """Some items, and what tells where documents may hold one: runs of words and keys of the segments of each size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], recall: float, similarity: float):
        self.names = np.array([i for i, _ in items], np.int64)
        self.items = [c for _, c in items]
        self.edits = np.array([edits_allowed(len(c), similarity) for c in self.items])
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        most, repeats = defaultdict(int), defaultdict(int)
        for k, codes in enumerate(self.items):
            parts = segments(len(codes), int(self.edits[k]))
            wanted = repeats_for(len(codes), recall, similarity)
            for offset, size in parts:
                by_size[size].append((k, offset))
                most[size] = max(most[size], int(self.edits[k]) // len(parts))
                repeats[size] = max(repeats[size], wanted)
        n_runs = sum(map(len, self.items))
        self.shift = np.uint64(64 - max(12, (8 * n_runs).bit_length()))
        #: By g and the head of a run's code: a bit for each size (of 16 in turn) of which a segment holds such a run.
        self.tables = {g: np.zeros(1 << (64 - int(self.shift)), np.uint16) for g in (1, 2, 3)}
        self.sizes, keys, owner, offsets = [], [], [], []
        for rank, (size, own) in enumerate(sorted(by_size.items())):
            codes = np.stack([self.items[k][offset : offset + size] for k, offset in own])
            for g, table in self.tables.items():
                np.bitwise_or.at(table, (run_codes(codes, g) >> self.shift).ravel(), np.uint16(1 << rank % 16))
            self.sizes.append((size, np.uint16(rank % 16), runs_needed(size, most[size]), repeats[size]))
            keys.append(walk_keys(codes, repeats[size]).ravel())
            owner.append(np.repeat([k for k, _ in own], repeats[size]))
            offsets.append(np.repeat([offset for _, offset in own], repeats[size]))
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys = np.concatenate(keys)[order]
        self.owner, self.offsets = np.concatenate(owner)[order], np.concatenate(offsets)[order]

    def windows(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(size, repetitions, starts) of the windows that hold enough runs; ``ends``: end of each word's document."""
        held = {g: table[run_codes(codes, g) >> self.shift] for g, table in self.tables.items()}
        some = {g: np.flatnonzero(held[g]) for g in held}
        for n, bit, needs, repeats in self.sizes:
            g = 3 if needs[3] >= 2 else 2 if needs[2] >= 1 else 1
            at = some[g][(held[g][some[g]] >> bit & np.uint16(1)).astype(bool)]
            if len(at) < needs[g]:
                continue
            # between the first and the last of so many runs there is room in a window: all starts that take both in
            first, last = at[: len(at) - needs[g] + 1], at[needs[g] - 1 :]
            near = last - first <= n - g
            low, high = np.maximum(last[near] - (n - g), 0), first[near]
            length = high - low + 1
            starts = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
            starts = np.unique(starts)
            starts = starts[starts < len(codes)]
            starts = starts[starts + n <= ends[starts]]
            for a in range(0, len(starts), 20_000):
                part = starts[a : a + 20_000]
                for g, need in needs.items():
                    if need > 0 and len(part):
                        own = held[g][part[:, None] + np.arange(n - g + 1)] >> bit & np.uint16(1)
                        part = part[own.sum(axis=1) >= need]
                if len(part):
                    yield n, repeats, part

    def candidates(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, where it would begin, a place inside the document), one row for each agreement."""
        for n, repeats, starts in self.windows(codes, ends):
            for a in range(0, len(starts), 5000):
                part = starts[a : a + 5000]
                keys = walk_keys(codes[part[:, None] + np.arange(n)], repeats).ravel()
                low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                at = np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
                place = np.repeat(part[hit // repeats], count)
                both = np.unique(np.stack([self.owner[at], place - self.offsets[at], place], axis=1), axis=0)
                if len(both):
                    yield both[:, 0], both[:, 1], both[:, 2]

    def found(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (document, item, distance, end, words, start) of the items found in the documents whose bounds are given."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        got = list(self.candidates(codes, ends))
        if not got:
            return np.zeros((0, 6), np.int64)
        item, begin, place = (np.concatenate(x) for x in zip(*got, strict=True))
        doc = np.searchsorted(bounds, place, side="right") - 1
        order = np.lexsort((begin, item, doc))
        item, begin, doc = item[order], begin[order], doc[order]
        # candidates no further apart than the edits allowed are verified as one
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(begin) > self.edits[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        item, doc = item[first], doc[first]
        sizes = np.array([len(c) for c in self.items])[item]
        low = np.maximum(begin[first] - self.edits[item], bounds[doc])
        high = np.minimum(begin[last] + sizes + self.edits[item], bounds[doc + 1])
        rows = []
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            mine = mine[np.argsort((high - low)[mine], kind="stable")]
            while len(mine):
                width = int((high - low)[mine[-1]])
                now, mine = mine[-max(1, 1_000_000 // (width + 1)) :], mine[: -max(1, 1_000_000 // (width + 1))]
                at = low[now, None] + np.arange(width)
                texts = np.where(at < high[now, None], codes[np.minimum(at, len(codes) - 1)], np.uint64(0))
                most = int(self.edits[item[now[0]]])
                distance, start, end = best_spans(np.stack([self.items[k] for k in item[now].tolist()]), texts, most)
                ok = distance <= most
                base = (low - bounds[doc])[now]
                rows.append(np.stack([doc[now], item[now], distance, base + end, end - start, base + start], axis=1)[ok])
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))] if len(rows) else rows


def scan(docs: DataFrame, blocks: list[Block], id_col: str, text_col: str, words_at_once: int = 400_000) -> DataFrame:
    """(doc_id, digest, item, start, n_words, distance) of the items of these blocks in all documents."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def found(ids: list, digests: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bounds = np.cumsum([0, *map(len, texts)])
        codes = np.concatenate(texts)
        for block in shared if len(codes) else ():
            rows = block.value.found(codes, bounds)
            cols = [
                pa.array([ids[d] for d in rows[:, 0].tolist()], pa.int64()),
                pa.array([digests[d] for d in rows[:, 0].tolist()], pa.int64()),
                pa.array(block.value.names[rows[:, 1]]),
                *(pa.array(rows[:, k].astype(np.int32)) for k in (5, 4, 2)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        digests: list = []
        texts: list[np.ndarray] = []
        size = 0
        for b in common.slices(batches):
            for i, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(i)
                digests.append(digest)
                texts.append(codes_of(text))
                size += len(texts[-1])
                if size >= words_at_once:
                    yield from found(ids, digests, texts)
                    ids, digests, texts, size = [], [], [], 0
        if ids:
            yield from found(ids, digests, texts)
        _memo.clear()  # the worker lives on to other stages

    src = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(text_col).cast("string"))
    return src.mapInArrow(run, _FOUND)


def _passes(rows: Iterable, recall: float, similarity: float, block_words: int, pass_blocks: int) -> Iterator[list[Block]]:
    """Blocks of the items (name, text), as many at a time as are broadcast together."""
    blocks: list[Block] = []
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for name, text in rows:
        codes = codes_of(text)
        if len(codes):
            held.append((name, codes))
            size += len(codes)
        if size >= block_words:
            blocks.append(Block(held, recall, similarity))
            held, size = [], 0
        if len(blocks) == pass_blocks:
            yield blocks
            blocks = []
    if held:
        blocks.append(Block(held, recall, similarity))
    if blocks:
        yield blocks


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """(doc_id, digest, item_id, start, n_words, distance): the items found in the documents; the span found begins at word
    ``start`` and has ``n_words`` words. ``digest`` is the xxhash64 of the text. ``similarity`` is from 0.5 to 1."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity is from 0.5 to 1")
    spark = docs.sparkSession
    text = F.col(item_text_col).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("text"), F.xxhash64(text).alias("item"))
    items = common.written(items.where("text is not null").distinct(), "leak-items")
    distinct = items.select("item", "text").dropDuplicates(["item"])
    found = spark.createDataFrame([], _FOUND)
    for blocks in _passes(distinct.toLocalIterator(), recall, similarity, block_words, pass_blocks):
        found = found.unionByName(common.written(scan(docs, blocks, id_col, text_col), "leak-found"))
    best = found.groupBy("doc_id", "digest", "item").agg(F.min(F.struct("distance", (F.col("start") + F.col("n_words")).alias("e"), "n_words", "start")).alias("b"))
    return best.join(items.select("item", "item_id"), "item").select("doc_id", "digest", "item_id", "b.start", "b.n_words", "b.distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """``docs`` without the documents in which an item was found. Their keys are broadcast up to ``broadcast_rows``."""
    found = find_items(docs, benchmark, id_col, text_col, **options)
    i, d = common.unused(docs, "_id", "_digest")
    gone = common.written(found.select(F.col("doc_id").alias(i), F.col("digest").alias(d)).distinct(), "leak-docs")
    if common.size_bounded(gone, broadcast_rows):
        gone = F.broadcast(gone)
    on = docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(d))
    return docs.join(gone, on, "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    found = find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance")
