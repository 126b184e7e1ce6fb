"""Session helpers: the shared scratch folder and checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a session of one machine gets a local folder that becomes
    it; a cluster raises an error, as its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables of this process.
_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder; what is written there is deleted at the end of the process."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _drop_scratch() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        with contextlib.suppress(Exception):  # the gateway may be gone by then
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the scratch folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows a task, where sorts of them take turns.
TASK_ROWS = 250_000


def tasks_of(df: DataFrame, rows: int | None = None) -> int:
    """Number of tasks for which each has ``rows`` (else ``TASK_ROWS``) rows of ``df`` or fewer, with groups that are small beside that; at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or TASK_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
