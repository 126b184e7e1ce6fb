"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, neighbouring pairs and pairs with one word between, and the words' stems (their first
letters, ``STEMS`` of them), hashed into ``BUCKETS``. Labelled rows are dealt to shards of about ``SHARD_ROWS`` rows or
``SHARD_BYTES`` of text; each shard runs FTRL-proximal over its rows with a rate for every coordinate, leaves out coordinates seen in fewer than ``MIN_SEEN`` rows, and L1 leaves few weights. The shards' weights
are averaged (a weight that few shards hold counts for less), and the non-zero ones, at most ``BUCKETS``, are broadcast to
score all texts.

Training takes at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of id and text. All texts are scored in full.

Defined results: null and empty texts have the constant feature only; without labelled rows every score is 0.5; labels
that are null do not count, and of several labels of one id the largest does; repeated rows are learned from once and
scored each; a null id is
never held out and never labelled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SHARD_ROWS, SHARD_BYTES, MAX_LABELLED, EPOCHS, MIN_SEEN = 1 << 20, 10_000, 64 << 20, 40_000, 8, 5
#: Letters of the stems of a word.
STEMS = (3, 4, 5)
#: Rates and penalties of FTRL-proximal, chosen by training on one half of the rows that are not held out (ids
#: with remainder 0) and looking at the other half (remainder 2); see the README.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


class Words:
    """Hashes of words and of their stems, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        self.at: dict[str, int] = {}
        self.most = most
        self.rows = np.empty((1 << 12, 1 + len(STEMS)), np.uint64)

    def _place(self, word: str) -> int:
        place = self.at[word] = len(self.at)
        if place == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        digest = xxhash.xxh3_64_intdigest
        self.rows[place] = [digest(word.encode("utf-8", "surrogatepass")), *(digest(f"stem{k} {word[:k]}".encode("utf-8", "surrogatepass")) for k in STEMS)]
        return place

    def of(self, text: str | None) -> np.ndarray:
        """A row for each word of a text: its hash, and those of its stems."""
        if len(self.at) > self.most:
            self.at.clear()
        words, known = _WORD.findall((text or "").lower()), self.at
        places = np.array([known[w] if w in known else self._place(w) for w in words], np.int64)
        return self.rows[places]


_words = Words()


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(44)).astype(np.int32) % np.int32(BUCKETS - 1) + np.int32(1)


def hashed(text: str | None) -> np.ndarray:
    """Buckets of all n-grams, skip-grams and stems of one text, repeats included; bucket 0 is the constant."""
    rows = _words.of(text)
    c = rows[:, 0]
    first, second, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pairs, skips = c[:-1] * first ^ c[1:] * second, c[:-2] * skip ^ c[2:] * first
    return np.concatenate([np.zeros(1, np.int32), _bucket(rows.ravel()), _bucket(pairs), _bucket(skips)])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) that are not zero after ``epochs`` passes over the rows (distinct buckets each)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen = np.zeros(BUCKETS, np.int32)
    for x in rows:
        seen[x] += 1
    rows = [x[seen[x] >= MIN_SEEN] for x in rows]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            more = ni + g * g
            z[x] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[x] = more
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """All weights, by bucket; zero for most."""
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    ids = ids.where("_id is not null and _label is not null").where(~held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
    # the hash of id and text stands for a row, so that only the rows chosen carry their texts
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(F.col(id_col).cast("long"), text, F.lit("order")).alias("_order"))
    marks = src.select("_id", "_order", F.octet_length("_text").alias("_bytes")).join(common.written(ids, "toxic-ids"), "_id").distinct()
    marks = common.written(marks, "toxic-rows")
    n, size = marks.agg(F.count("*"), F.sum("_bytes")).first()
    share = min(1.0, max_labelled / max(n, 1))
    shards = max(1, -(-min(n, max_labelled) // SHARD_ROWS), -(-int((size or 0) * share) // SHARD_BYTES))
    if share < 1:
        marks = marks.where(F.pmod("_order", F.lit(1_000_000)) < int(1_000_000 * share))
    rows = src.drop("_id").join(F.broadcast(marks), "_order")  # about max_labelled rows
    # shards by the text's hash as well, so that copies of one labelled row don't meet in one
    rows = rows.dropDuplicates(["_order"]).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_order", kind="stable")
        features = [np.unique(hashed(t)) for t in part["_text"]]
        at, w = ftrl(features, part["_label"].to_numpy(float))
        return pd.DataFrame({"bucket": at, "weight": w})

    each = rows.groupBy("_shard").applyInPandas(train, "bucket long, weight double")
    held = F.greatest(F.count("*"), F.lit(shards / 2))
    mean = each.groupBy("bucket").agg((F.sum("weight") / held).alias("weight"))
    out = np.zeros(BUCKETS, np.float32)
    for r in mean.toLocalIterator():  # BUCKETS rows at most
        out[r.bucket] = r.weight
    return out


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.float32)
        table[shared.value[0]] = shared.value[1]
        for b in common.slices(batches):
            sums = []
            for t in b.column(1).to_pylist():
                x = hashed(t)
                sums.append(table[np.unique(x[table[x] != 0])].sum(dtype=np.float64))
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(run, "doc_id long, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
