"""Column types by name suffix, and the canonical chunk schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed suffixes.
SUFFIX_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "flt": T.DoubleType(),
    "tks": T.StringType(),
    "ltks": T.StringType(),
    "kwd": T.StringType(),
    "id": T.StringType(),
    "ids": T.ArrayType(T.StringType()),
    "weight": T.StringType(),
    "list": T.StringType(),
}
VECTOR_SIZES = (512, 768, 1024, 1536)


def type_of(name: str) -> T.DataType | None:
    """The type that a column's name asks for; None if the name has no known suffix."""
    if m := re.fullmatch(r".*_(\d+)_vec", name):
        return T.ArrayType(T.FloatType()) if int(m[1]) in VECTOR_SIZES else None
    return SUFFIX_TYPES.get(name.rpartition("_")[2])


CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kb_id", "doc_id", "docnm_kwd", "title_tks", "doc_type_kwd", "content_with_weight", "content_ltks", "content_sm_ltks", "chunk_type_kwd", "parent_id_kwd", "mom_with_weight", "knowledge_graph_kwd", "entity_name_kwd", "entity_type_kwd", "target_entity_kwd")]
    + [T.StructField("pagerank_flt", T.DoubleType()), T.StructField("important_kwd", T.ArrayType(T.StringType())), T.StructField("question_kwd", T.ArrayType(T.StringType())), T.StructField("question_tks", T.StringType())]
    + [T.StructField("page_num_int", T.ArrayType(T.IntegerType())), T.StructField("top_int", T.ArrayType(T.IntegerType())), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def as_chunks(df: DataFrame) -> DataFrame:
    """``df`` with all columns of the chunk schema, absent ones null; unknown columns are an error."""
    if unknown := set(df.columns) - set(CHUNK.fieldNames()):
        raise ValueError(f"no chunk columns: {sorted(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK])


def checked_types(df: DataFrame) -> DataFrame:
    """``df`` if every column with a known suffix has its type or an array of it."""
    for f in df.schema:
        want = type_of(f.name)
        if want and f.dataType != want and f.dataType != T.ArrayType(want):
            raise TypeError(f"{f.name} is {f.dataType.simpleString()}, not {want.simpleString()}")
    return df
