"""Streaming additions: files to chunks as they arrive, and stage latencies by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import chunking
from ..sources.parsers import parsed
from ..sources.store import ChunkStore


def chunks_of(sections: DataFrame, budget: int = 512) -> DataFrame:
    """Chunk rows of the sections of files; tables become chunks of their own."""
    items = F.sort_array(F.collect_list(F.struct("pos", "text")))
    per_file = sections.where("kind = 'section'").groupBy("path").agg(F.transform(items, lambda x: x["text"]).alias("parts"))
    body = per_file.select("path", F.posexplode(chunking.merged_sections(F.col("parts"), budget)).alias("pos", "chunk")).withColumn("kind", F.lit("text"))
    tables = sections.where("kind = 'table'").select("path", "pos", F.col("text").alias("chunk"), F.lit("table").alias("kind"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return body.unionByName(tables).select(
        text.chunk_id(name, F.col("pos"), F.col("chunk"), F.col("kind")).alias("id"), text.document_id(F.col("path")).alias("doc_id"), name.alias("docnm_kwd"),
        F.array_join(text.tokens(text.title_of(name)), " ").alias("title_tks"), F.col("kind").alias("doc_type_kwd"), F.col("chunk").alias("content_with_weight"),
        F.array_join(text.tokens(text.without_table_tags(F.col("chunk"))), " ").alias("content_ltks"), F.lit("flat").alias("chunk_type_kwd"),
    )


def ingest(spark: SparkSession, folder: str, store: ChunkStore, kb: str, checkpoint: str, budget: int = 512) -> StreamingQuery:
    """Files that arrive in ``folder`` become chunks of ``kb``. A batch that is run again writes the same ids."""
    store.create(kb)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(kb, chunks_of(parsed(batch), budget))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_windows(events: DataFrame, ts: str, stage: str, ms: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, stage, n, avg_ms, max_ms) by tumbling windows; with a watermark where the table streams."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, width), F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("avg_ms"), F.max(ms).alias("max_ms"))
    return g.select(F.col("window.start").alias("window_start"), "stage", "n", "avg_ms", "max_ms")


def stage_sessions(events: DataFrame, ts: str, key: str, gap: str | Column = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): events of one key that lie within ``gap`` of each other."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
