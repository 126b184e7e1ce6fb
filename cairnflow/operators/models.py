"""Models that the caller gives, run over columns: embedding of texts, and extraction of entities and relations.

A model comes as a factory, which a task calls once in its worker; it then gets texts in batches of bounded size. A batch that fails gives
rows with the error in place of a result, so that a bad answer neither ends the job nor disappears; the rows can be filtered by ``error``
and asked again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Texts in one call, tokens of a text that an embedder gets, characters that an extractor gets, and the shortest text that it is asked about.
BATCH, EMBEDDED_TOKENS, EXTRACTED_CHARS, SHORTEST = 16, 8191, 4000, 20

Embedder = Callable[[list[str]], list[list[float]]]
Extractor = Callable[[str], dict]


def called(factory: Callable[[], Callable], batch: int, ask: Callable[[Callable, list[str]], list], kind: pa.DataType):
    """An iterator of Arrow batches of texts to (result, error), ``batch`` texts a call; null texts aren't asked about."""
    schema = pa.struct([("result", kind), ("error", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for b in batches:
            out = []
            for at in range(0, len(b), batch):
                texts = b.slice(at, batch).to_pylist()
                asked = [t for t in texts if t is not None]
                try:
                    results = iter([(r, None) for r in ask(model, asked)])
                except Exception as e:  # noqa: BLE001  (whatever a model raises becomes the rows' error)
                    results = iter([(None, f"{type(e).__name__}: {e}")] * len(asked))
                out += [{"result": None, "error": None} if t is None else dict(zip(("result", "error"), next(results), strict=True)) for t in texts]
            yield pa.array(out, schema)

    return run


def embedded(df: DataFrame, text_col: str, factory: Callable[[], Embedder], batch: int = BATCH, out_col: str = "embedding") -> DataFrame:
    """``df`` with ``out_col`` (array<float>) and ``error``. Texts are cut to ``EMBEDDED_TOKENS``; null and blank ones count as a space."""

    def ask(model: Embedder, texts: list[str]) -> list[list[float]]:
        vectors = model(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [[float(x) for x in v] for v in vectors]

    run = called(factory, batch, ask, pa.list_(pa.float32()))

    @F.arrow_udf("result array<float>, error string")
    def vectors_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    cut = text.truncated(F.col(text_col), EMBEDDED_TOKENS)
    asked = F.when(F.trim(F.coalesce(cut, F.lit(""))) == "", F.lit(" ")).otherwise(cut)
    out = df.withColumn("_answer", vectors_of(asked))
    return out.withColumns({out_col: F.col("_answer.result"), "error": F.col("_answer.error")}).drop("_answer")


def hash_embedder(dims: int = 64) -> Callable[[], Embedder]:
    """An embedder without a model: each token adds one, plus or minus, at a place that its hash draws; unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts, strict=True):
            for token in re.findall(r"\w+", t.lower()):
                h = hashlib.md5(token.encode()).hexdigest()
                row[int(h[:7], 16) % dims] += 1 if int(h[7], 16) < 8 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return lambda: embed


_FOUND = pa.struct([
    ("entities", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("description", pa.string())]))),
    ("relations", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("description", pa.string())]))),
])


def _texts_of(items: object, names: tuple[str, ...]) -> list[dict]:
    """The dicts among ``items`` with their fields as text, other fields and other items left out."""
    rows = [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return [{n: None if x.get(n) is None else str(x[n]) for n in names} for x in rows]


def extracted(chunks: DataFrame, factory: Callable[[], Extractor], id_col: str = "id", text_col: str = "content_with_weight") -> DataFrame:
    """(chunk_id, entities, relations, error) of the chunks of at least ``SHORTEST`` characters without white space around; the
    extractor gets ``EXTRACTED_CHARS`` of a text and answers {entities: [{name, type, description}], relations: [{source, target,
    description}]}. What is no such answer gives no entities."""

    def ask(model: Extractor, texts: list[str]) -> list[dict]:
        out = []
        for t in texts:
            answer = model(t)
            answer = answer if isinstance(answer, dict) else {}
            out.append({"entities": _texts_of(answer.get("entities"), ("name", "type", "description")), "relations": _texts_of(answer.get("relations"), ("source", "target", "description"))})
        return out

    run = called(factory, 1, ask, _FOUND)
    entity, relation = "array<struct<name:string,type:string,description:string>>", "array<struct<source:string,target:string,description:string>>"

    @F.arrow_udf(f"result struct<entities:{entity},relations:{relation}>, error string")
    def found_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    long = F.length(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")) >= SHORTEST
    out = chunks.where(long).select(F.col(id_col).alias("chunk_id"), found_in(F.substring(text_col, 1, EXTRACTED_CHARS)).alias("a"))
    return out.select("chunk_id", "a.result.entities", "a.result.relations", "a.error")


def _said(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def entities_of(found: DataFrame) -> DataFrame:
    """(name, type, description, chunk_id, pos) of ``extracted`` rows; those without a name are left out, a missing type is OTHER."""
    rows = found.select("chunk_id", F.posexplode("entities").alias("pos", "x")).select("chunk_id", "pos", "x.*").where("name <> ''")
    return rows.select(_said("name").alias("name"), F.upper(F.trim(F.coalesce("type", F.lit("OTHER")))).alias("type"), _said("description").alias("description"), "chunk_id", "pos")


def relations_of(found: DataFrame) -> DataFrame:
    """(source, target, description, chunk_id, pos) of ``extracted`` rows with both ends."""
    rows = found.select("chunk_id", F.posexplode("relations").alias("pos", "x")).select("chunk_id", "pos", "x.*").where("source <> '' and target <> ''")
    return rows.select(_said("source").alias("source"), _said("target").alias("target"), _said("description").alias("description"), "chunk_id", "pos")
