"""Questions put to a given model before they are asked: rewriting for graph search, keywords and translations, a second try.

A model is asked each different question once (trimmed, letter case apart), in batches in tasks, and its answers are written before they
are used: that is the cache. A failure gives what the question says itself, and its ``error``. Null questions count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import models
from ..shared import written

#: Answers a dict for a question: target_types, entities, keywords, translated (lists of texts) and intent.
Rewriter = Callable[[str], dict]

LISTS = ("target_types", "entities", "keywords", "translated")
_ANSWER = pa.struct([*[(n, pa.list_(pa.string())) for n in LISTS], ("intent", pa.string())])
#: Shorter questions have no keywords to find.
SHORTEST = 2
#: How the row with the graph's text is called.
GRAPH_ID, GRAPH_NAME, GRAPH_KIND = "graph_context", "[知识图谱]", "knowledge_graph"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _answered(questions: DataFrame, text_col: str, factory: Callable[[], Rewriter], shortest: int = 0) -> DataFrame:
    """``questions`` with ``_q``, the trimmed question, and ``_a`` (result, error), null for shorter ones."""

    def ask(model: Rewriter, asked: list[str]) -> list[dict]:
        out = []
        for t in asked:
            said = model(t)
            if not isinstance(said, dict):
                raise TypeError("the answer is no dict")
            texts = {n: [str(x) for x in said[n] if x is not None] if isinstance(said.get(n), list) else None for n in LISTS}
            out.append(texts | {"intent": None if said.get("intent") is None else str(said["intent"])})
        return out

    run = models.called(factory, 1, ask, _ANSWER)
    lists = ",".join(f"{n}:array<string>" for n in LISTS)

    @F.arrow_udf(f"result struct<{lists},intent:string>, error string")
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    asked = questions.withColumn("_q", _trimmed(F.col(text_col))).withColumn("_key", F.lower("_q"))
    distinct = asked.where(F.length("_q") >= shortest).groupBy("_key").agg(F.min("_q").alias("_one"))
    said = written(distinct.select("_key", answers("_one").alias("_a")), "answers")
    return asked.join(said, "_key", "left").drop("_key")


def rewritten(questions: DataFrame, factory: Callable[[], Rewriter], text_col: str = "text") -> DataFrame:
    """``questions`` with target_types (upper case), entities, keywords, intent and error. What an answer lacks: no types and entities, the
    question's words, the question. Where the model fails the question is the only entity."""
    t = _answered(questions, text_col, factory)
    got = lambda n: F.col(f"_a.result.{n}")
    failed = F.col("_a.error").isNotNull()
    words = F.filter(F.split("_q", r"[\s\p{Z}]+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    return t.withColumns({
        "target_types": F.coalesce(F.transform(got("target_types"), lambda x: F.upper(x)), none),
        "entities": F.when(failed, F.array("_q")).otherwise(F.coalesce(got("entities"), none)),
        "keywords": F.coalesce(got("keywords"), words),
        "intent": F.coalesce(got("intent"), F.col("_q")),
        "error": F.col("_a.error"),
    }).drop("_q", "_a")


def enhanced(questions: DataFrame, factory: Callable[[], Rewriter], text_col: str = "text") -> DataFrame:
    """``questions`` with keywords, translated, enhanced_text (the question and its translations) and error. Questions of fewer than two
    characters aren't asked about; they and those where the model fails stay as they are."""
    t = _answered(questions, text_col, factory, SHORTEST)
    none = F.array().cast("array<string>")
    translated = F.coalesce(F.col("_a.result.translated"), none)
    said = F.array_join(F.concat(F.array("_q"), translated), " ")
    return t.withColumns({"keywords": F.coalesce("_a.result.keywords", none), "translated": translated, "enhanced_text": said, "error": F.col("_a.error")}).drop("_q", "_a")


def asked_again(questions: DataFrame, ask: Callable[[DataFrame], DataFrame], factory: Callable[[], Rewriter], text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """The hits that ``ask`` gives, with ``asked``: 1, or 2 for those of questions that had none and were asked again with their
    translations. The model is asked about those alone; hits of the first try are written, as they are looked up twice."""
    first = written(ask(questions), "hits")
    without = questions.join(first.select(id_col).distinct(), id_col, "left_anti")
    better = enhanced(without, factory, text_col).where(F.size("translated") > 0)
    better = better.withColumn(text_col, F.col("enhanced_text")).select(*questions.columns)
    return first.withColumn("asked", F.lit(1)).unionByName(ask(better).withColumn("asked", F.lit(2)))


def with_graph(hits: DataFrame, context: DataFrame) -> DataFrame:
    """``hits`` and, unless it is blank, a row with the text of ``context`` (one row: context) at a ``sim`` of 1; ``is_graph_context`` tells it, so
    that order by it and ``sim`` puts it first."""
    row = {"id": F.lit(GRAPH_ID), "content_with_weight": F.col("context"), "docnm_kwd": F.lit(GRAPH_NAME), "doc_type_kwd": F.lit(GRAPH_KIND), "sim": F.lit(1.0)}
    own = context.where(_trimmed(F.col("context")) != "").select(*[v.alias(n) for n, v in row.items() if n in hits.columns])
    return hits.withColumn("is_graph_context", F.lit(False)).unionByName(own.withColumn("is_graph_context", F.lit(True)), allowMissingColumns=True)
