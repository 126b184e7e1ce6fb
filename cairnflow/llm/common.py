"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR. ``bytes.split()`` splits at the same six.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of words of a text column; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's ``spark.checkpoint.dir``. Where that is unset, a session of
    one machine (``local``) gets a local folder, which becomes its checkpoint folder too; a cluster raises an error, as
    its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables of this process, oldest first.
_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted by ``scratch_dropped`` or at the end of the process."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def scratch_dropped(*keep: str) -> Iterator[None]:
    """Deletes the scratch tables written inside, but for those at the paths in ``keep``. Nothing lazy that reads them may be
    used afterwards."""
    first = len(_scratch)
    try:
        yield
    finally:
        inside = _scratch[first:]
        _scratch[first:] = [x for x in inside if x[1] in keep]
        for spark, path in inside:
            if path not in keep:
                drop_path(spark, path)


@atexit.register
def _drop_all() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        with contextlib.suppress(Exception):  # the gateway may be gone by then
            drop_path(spark, path)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is executed inside goes to Python ``rows`` rows at a time at most; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = path or scratch_path(df.sparkSession, name)
    with batch_rows(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with marks behind those that ``df`` has as columns already."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than it needs to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


class Lists:
    """Short lists of numbers by key, found by one lookup per key and gathered by numpy.

    Lists of new keys come from ``make``, which gets the new keys of a call at once and returns (all numbers, lengths).
    Up to ``most`` keys are remembered from call to call."""

    def __init__(self, make: Callable[[list], tuple[np.ndarray, np.ndarray]], kind: str, most: int):
        self.make, self.most = make, most
        self.flat = np.empty(1 << 16, kind)
        self.starts = np.zeros(1 << 12, np.int64)
        new: list = []

        class Places(dict):
            def __missing__(self, key: Hashable) -> int:
                place = self[key] = len(self)
                new.append(key)
                return place

        self.places, self.new = Places(), new

    def _added(self, values: np.ndarray, lengths: np.ndarray) -> None:
        have = len(self.places) - len(lengths)
        end = int(self.starts[have])
        if len(self.places) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(lengths) + 1), np.int64)])
        while end + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.starts[have + 1 : have + 1 + len(lengths)] = end + np.cumsum(lengths)
        self.flat[end : end + len(values)] = values

    def of(self, keys: Iterable, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(all numbers, lengths) of the lists of ``n`` keys in a row."""
        at = np.fromiter(map(self.places.__getitem__, keys), np.int64, n)
        if self.new:
            self._added(*self.make(self.new))
        out = gathered(self.flat, self.starts, at)
        if len(self.places) > self.most:
            for key in self.new:
                del self.places[key]
        self.new.clear()
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, lengths) of the lists ``flat[starts[i]:starts[i + 1]]`` for the places ``at`` in a row."""
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    index = np.repeat(starts[at] - ends + lengths, lengths)
    index += np.arange(len(index))
    return flat[index], lengths


def sums_of_runs(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running ends: the sum of ``values`` up to the end of each run of ``counts`` values, with a zero in front."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[np.concatenate([[0], np.cumsum(counts)])]


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that Arrow and the C library hold unused to the system: a worker lives on to the next stage, beside
    others in its executor."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few texts are Python objects at a time. In the end the
    worker gives back what it holds unused."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()

