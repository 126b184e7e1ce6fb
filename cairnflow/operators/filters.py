"""Row filters of the search layer, and upsert and delete as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import checked_broadcast


def by_conditions(df: DataFrame, conditions: dict) -> DataFrame:
    """Equal to a value or in a list; conditions with an empty value are skipped."""
    for name, value in conditions.items():
        if value:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def without_parents(df: DataFrame) -> DataFrame:
    return df.where(~F.col("chunk_type_kwd").eqNullSafe("parent"))


def without_graph_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("knowledge_graph_kwd", F.lit("")).isin("entity", "relation"))


def named(df: DataFrame, names: str, name_col: str = "docnm_kwd") -> DataFrame:
    """Rows whose document name is in a comma-separated list; all rows for an empty list."""
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()]
    return df.where(F.col(name_col).isin(wanted)) if wanted else df


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Point lookup: rows whose id is in ``ids``, repeated ids once."""
    return df.join(checked_broadcast(ids.select(id_col).distinct()), id_col, "left_semi")


def under_folder(df: DataFrame, folder: str, col: str = "folder") -> DataFrame:
    """Rows in a folder or below; "/" holds all."""
    spec = df.sparkSession.range(1).select(text.normal_folder(F.lit(folder))).first()[0]
    return df if spec == "/" else df.where((F.col(col) == spec) | F.col(col).startswith(spec + "/"))


def under_tool_folder(df: DataFrame, folder: str, col: str = "folder") -> DataFrame:
    """The tool's reading of a folder: trailing slashes go, so "/" holds the root alone."""
    spec = folder.rstrip("/") or "/"
    return df.where((F.col(col) == spec) | F.col(col).startswith(spec + "/"))


def upserted(old: DataFrame, new: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Old and new rows, of each id the one with the largest sequence number; new ones win ties. Of several new rows of one number that
    with the least values stays, so that every run keeps the same."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c, kind in both.dtypes if c not in (id_col, seq_col, "_new") and "map<" not in kind]
    w = Window.partitionBy(id_col).orderBy(F.desc(seq_col), F.desc("_new"), *rest)
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def deleted(df: DataFrame, conditions: dict) -> DataFrame:
    """``df`` without the rows that meet all conditions; no condition deletes nothing."""
    parts: list[Column] = []
    for name, value in conditions.items():
        if value:
            parts.append(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df.where(~F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))) if parts else df


def deleted_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` without the rows that meet the condition; rows for which it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def with_total(df: DataFrame, total_col: str = "total") -> DataFrame:
    """``df`` with the number of its rows, which is one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(total_col))))


def moved_folder(df: DataFrame, old: str, new: str, col: str = "folder") -> DataFrame:
    """``df`` with the folder ``old`` and those below it under the path ``new``."""
    old, new = "/" + old.strip("/"), "/" + new.strip("/")
    below = (F.col(col) == old) | F.col(col).startswith(old + "/")
    return df.withColumn(col, F.when(below, F.concat(F.lit(new), F.substring(col, len(old) + 1, 1_000_000))).otherwise(F.col(col)))


def projected(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """The id and the listed fields, without rows in which all of them are null."""
    return df.select(id_col, *fields).dropna("all", subset=fields)
