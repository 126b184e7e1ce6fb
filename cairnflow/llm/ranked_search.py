"""Ranked lexical search of many items over all documents, by sort-based accumulation.

Items are taken in blocks of bounded size. For a block, one scan of the documents finds the items' terms in them: a row of
(term numbers, occurrences) for each document, written. From that table come the counts that the weights need. Then its rows are
partitioned by ranges of their ordinals, and each task goes through its range in slices: the matched (item, document, impact)
of a slice are concatenated as arrays, their packed keys (item above document) are radix-sorted, and the impacts of equal keys are summed by
one ``reduceat``. Heaps keep the best documents of each item, so a task returns at most ``k`` rows an item, whatever the range holds.

Term and score (integers but for the logarithm): a term is a run of ASCII letters, digits and characters beyond ASCII, with
A-Z lower-cased. N documents have a term, L terms are in all of them, n in one of them, df documents hold a term, tf times each. Weight
w = floor(1000 ln((2N + 2) / (2df + 1))); m = 25 + 75 n N div L; score = sum of w (10^9 tf div (1000 tf + 8 m)) over the
item's terms, repeats included.

Defined results: null and empty texts have no term; an item without terms or matches has no rows; a null doc_id sorts first among equal
scores; repeated documents are ranked each; equal rows of items count once, and of different texts under one item_id each is
ranked by itself; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Bytes of item texts in a block (at least one item): bounds what is broadcast and what a task holds for each item.
BLOCK_BYTES = 1 << 22
BLOCK_ITEMS = 10_000
#: Matched (item, document, impact) of a slice, about.
SLICE = 1 << 20

_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TERM_BYTES = _TERM_BYTES[:65] + _TERM_BYTES[97:123] + _TERM_BYTES[91:]


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split() if text else []


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Indexes that sort unsigned keys, equal ones in order: numpy's stable sort of 16-bit numbers is a radix sort, and one
    pass for each 16 bits of the largest key, low ones first, sorts the whole."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for low in range(16, int(keys.max()).bit_length() if len(keys) else 0, 16):
        digit = ((keys >> np.uint64(low)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Items:
    """A block of items: their ids, and for each term number the items that hold it and how often."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        self.numbers: dict[bytes, int] = {}
        held = [(self.numbers.setdefault(t, len(self.numbers)), k, c) for k, (_, text) in enumerate(rows) for t, c in Counter(terms(text)).items()]
        held.sort()
        term, self.item, self.times = (np.array(x, np.int64) for x in (zip(*held, strict=True) if held else ([], [], [])))
        self.starts = np.searchsorted(term, np.arange(len(self.numbers) + 1))

    def match(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """(terms in the text, numbers of the items' terms there, occurrences of each)."""
        found = terms(text)
        counts = Counter(filter(None.__ne__, map(self.numbers.get, found)))
        return len(found), list(counts), list(counts.values())


class Best:
    """The ``k`` best documents of each item: highest scores, then smallest ids."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list[int | None], doc: np.ndarray) -> None:
        able = np.flatnonzero(score >= self.floor[item])
        for i, s, d in zip(item[able].tolist(), score[able].tolist(), doc[able].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, ids[d] is None, -(ids[d] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]


def _ints(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], pa.int32()))


def postings(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, found, tf, at): for each document with a term the items' terms in it, written; ``at`` is its ordinal."""
    known = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = [(i, *known.value.match(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            ids, n, found, tf = ([r[c] for r in rows if r[1]] for c in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), _ints(found), _ints(tf)], names=["doc_id", "n", "found", "tf"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = src.mapInArrow(run, "doc_id long, n long, found array<int>, tf array<int>")
    return common.written(found.withColumn("at", F.monotonically_increasing_id()), "search-postings")


def accumulated(items: Items, weights: np.ndarray, n: np.ndarray, m: np.ndarray, lengths: np.ndarray, found: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the documents of a slice; ``found`` and ``tf`` hold ``lengths`` entries a document."""
    doc = np.repeat(np.arange(len(n)), lengths)
    impact = weights[found] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    item, per = common.gathered(items.item, items.starts, found)
    times, _ = common.gathered(items.times, items.starts, found)
    keys = (item * len(n) + np.repeat(doc, per)).astype(np.uint64)
    impact = np.repeat(impact, per) * times
    if not len(keys):
        return keys.astype(np.int64), keys.astype(np.int64), impact
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys = keys[first].astype(np.int64)
    return keys // len(n), keys % len(n), np.add.reduceat(impact[order], first)


def _ranked_block(docs: DataFrame, rows: list[tuple[int | None, str | None]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark, items = docs.sparkSession, Items(rows)
    table = postings(docs, items, id_col, text_col)
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.numbers), np.int64)
    for r in table.select(F.explode("found").alias("t")).groupBy("t").count().toLocalIterator():  # one row a term of the block
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    known = spark.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = known.value
        per_term, best = np.diff(items.starts), Best(len(items.ids), k)
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            lengths = b.column(2).value_lengths().to_numpy()
            found, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            matched = common.sums_of_runs(per_term[found], lengths)
            at = 0
            while at < len(n):  # as many documents as hold SLICE matches, and at least one
                to = max(at + 1, int(np.searchsorted(matched, matched[at] + SLICE, "right")) - 1)
                part = slice(ends[at], ends[to])
                item, doc, score = accumulated(items, weights, n[at:to], m[at:to], lengths[at:to], found[part], tf[part])
                best.add(item, score, ids[at:to], doc)
                at = to
        out = [(k, items.ids[k], None if none else -d, s) for k, heap in enumerate(best.heaps) for s, none, d in heap]
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        names, kinds = ["item_no", "item_id", "doc_id", "score"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        common.give_back()

    ranged = table.repartitionByRange("at").select("doc_id", "n", "found", "tf")
    found = ranged.mapInArrow(run, "item_no int, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), "doc_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    return common.written(out, "search-ranked")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        if block and (size + len(r.t or "") > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t or "")
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k_block, block in enumerate(_blocks(items, item_col, item_text_col)):
        part = _ranked_block(docs, block, k, id_col, text_col)
        out = out.unionByName(part) if k_block else part
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_OP13 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
s as (select count(*) as nd, sum(len(t))::bigint as nt from d where len(t) > 0),
p as (select doc_id, len(t) as n, unnest(t) as term from d),
f as (select doc_id, n, term, count(*) as tf from p group by doc_id, n, term),
g as (select term, count(*) as df from f group by term),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*) as times from i group by item_id, term),
r as (
  select item_id, doc_id, sum(times * floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::bigint as score
  from q join g using (term) join f using (term), s group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""
