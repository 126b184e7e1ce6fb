"""Chunk store on Parquet: knowledge bases, upserts, deletes and lookups.

Every change of a knowledge base writes a new version of its rows and then a line in the log; readers take the version
that the log names last. So a reader never sees half a change, and a failed one leaves no trace."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters
from ..schema import CHUNK, as_chunks

LOG = "seq long, kb_id string, display_name string, folder string, meta string, version string, dropped boolean"


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def bases(self) -> DataFrame:
        """The last line of each knowledge base that is there."""
        w = Window.partitionBy("kb_id").orderBy(F.desc("seq"), F.desc("version"))
        return self._log().withColumn("_n", F.row_number().over(w)).where("_n = 1 and not dropped").drop("_n", "dropped")

    def _base(self, kb: str) -> dict | None:
        row = self.bases().where(F.col("kb_id") == kb).first()
        return row.asDict() if row else None

    def _note(self, kb: str, dropped: bool = False, **change) -> None:
        old = self._base(kb) or {"display_name": kb, "folder": "/", "meta": "{}", "version": None}
        row = {**old, **change}
        line = (time.time_ns(), kb, row["display_name"], row["folder"], row["meta"], row["version"], dropped)
        self.spark.createDataFrame([line], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def create(self, kb: str, display_name: str | None = None, folder: str = "/") -> bool:
        """Whether it was made; a base that is there stays as it is."""
        if self._base(kb):
            return False
        self._note(kb, display_name=display_name or kb, folder=folder)
        return True

    def drop(self, kb: str) -> bool:
        there = self._base(kb) is not None
        if there:
            self._note(kb, dropped=True, version=None)
        return there

    def exists(self, kb: str) -> bool:
        return self._base(kb) is not None

    def meta(self, kb: str) -> dict:
        return json.loads((self._base(kb) or {"meta": "{}"})["meta"])

    def merge_meta(self, kb: str, **values) -> None:
        self._note(kb, meta=json.dumps({**self.meta(kb), **values}, sort_keys=True))

    def chunks(self, kbs: list[str]) -> DataFrame:
        """Rows of the named bases; absent ones have none."""
        out = self.spark.createDataFrame([], CHUNK)
        rows = self.bases().where(F.col("kb_id").isin(kbs) & F.col("version").isNotNull()).collect() if kbs else []
        for r in rows:
            out = out.unionByName(self.spark.read.schema(CHUNK).parquet(f"{self.root}/chunks/{r.kb_id}/{r.version}"))
        return out

    def counts(self) -> DataFrame:
        """(kb_id, display_name, n)"""
        bases = self.bases()
        n = self.chunks([r.kb_id for r in bases.select("kb_id").collect()]).groupBy("kb_id").agg(F.count("*").alias("n"))
        return bases.join(n, "kb_id", "left").select("kb_id", "display_name", F.coalesce("n", F.lit(0)).alias("n"))

    def _replace(self, kb: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/chunks/{kb}/{version}")
        self._note(kb, version=version)

    def upsert(self, kb: str, rows: DataFrame) -> None:
        """New rows take the place of those with their id; of new rows with one id the last by content stays."""
        w = Window.partitionBy("id").orderBy(F.desc_nulls_last("content_with_weight"))
        new = as_chunks(rows.drop("kb_id").withColumn("kb_id", F.lit(kb)))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("seq", F.lit(1))
        old = self.chunks([kb]).withColumn("seq", F.lit(0))
        self._replace(kb, filters.upserted(old, new).drop("seq"))

    def delete(self, kb: str, conditions: dict) -> int:
        """Rows deleted."""
        old = self.chunks([kb])
        left = filters.deleted(old, conditions)
        n = old.count() - left.count()
        if n:
            self._replace(kb, left)
        return n

    def get(self, kb: str, ids: DataFrame, fields: list[str]) -> DataFrame:
        return filters.by_ids(self.chunks([kb]), ids).select("id", *fields)
