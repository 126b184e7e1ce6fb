"""Retrieval plans: one lazy plan from chunks to a page of hits, and the text that a model is given."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors, weights
from ..operators import aggregates, filters, fulltext, ranking
from ..shared import checked_broadcast, written


@dataclass(frozen=True)
class Search:
    """What a retrieval asks for."""

    tokens: list[str]
    vector: list[float] | None = None
    kb_ids: tuple[str, ...] = ()
    doc_ids: tuple[str, ...] = ()
    threshold: float = 0.2
    vector_weight: float = 0.3
    page: int = 1
    size: int = 30
    topk: int = 1024
    min_match: float = 0.3


def candidates(chunks: DataFrame, search: Search) -> DataFrame:
    """Filtered rows, the ``topk`` nearest by cosine where there is a vector; parents only without one. A search without
    tokens and vector takes every row."""
    rows = filters.by_conditions(chunks, {"kb_id": list(search.kb_ids), "doc_id": list(search.doc_ids)})
    if search.vector is None:
        return rows
    return ranking.vector_topk(filters.without_parents(rows), search.vector, search.topk, score_col="cos").drop("cos")


def by_text(chunks: DataFrame, search: Search, text_col: str = "content_with_weight") -> DataFrame:
    """Full-text hits with ``sim``; asked again with a lower share of terms where none is found."""
    for share in (search.min_match, 0.1):
        hits = ranking.bm25(chunks, text.tokens(F.col(text_col)), search.tokens, "id", min_match=share)
        if not hits.isEmpty():
            break
    return chunks.join(hits.select("id", F.col("score").alias("sim")), "id")


def retrieve(chunks: DataFrame, search: Search, text_col: str = "content_with_weight", vector_col: str = "embedding") -> DataFrame:
    """A page of hits with ``sim``: candidates, fusion, threshold, the best child of each parent, page, parents' text."""
    rows = candidates(chunks, search)
    if search.vector is None:
        hits = by_text(rows, search, text_col)
    else:
        words = lambda c: F.when(F.col(c).isNotNull(), F.split(c, " "))
        bag = ranking.token_bag(F.coalesce(words("content_ltks"), text.tokens(F.col(text_col))), words("title_tks"), F.col("important_kwd"), words("question_tks"))
        hits = ranking.hybrid_scores(rows, search.vector, search.tokens, vector_col, bag, 1 - search.vector_weight, search.vector_weight)
        hits = ranking.above(hits, search.threshold, search.vector_weight)
    # ids and scores alone are ranked; the page's rows are looked up afterwards
    scores = [c for c in ("cos", "tok", "sim") if c in hits.columns]
    best = ranking.best_per_parent(hits.select("id", "parent_id_kwd", *scores), "parent_id_kwd", "id")
    best = written(ranking.page(best, search.page, search.size, F.desc("sim"), "id"), "page-ids").select(F.col("id").alias("_id"), *scores)
    found = filters.by_conditions(chunks, {"kb_id": list(search.kb_ids), "doc_id": list(search.doc_ids)})
    found = found if search.vector is None else filters.without_parents(found)
    hits = found.drop(*scores).join(F.broadcast(best), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    hits = written(hits.orderBy(F.desc("sim"), "id").limit(search.size), "page")  # a page, looked up twice below
    return ranking.with_parent_text(hits, chunks.where("chunk_type_kwd = 'parent'"), "parent_id_kwd", text_col)


def documents_of(hits: DataFrame) -> DataFrame:
    return aggregates.hits_by_document(hits, "docnm_kwd", "doc_id", "sim", "id").orderBy(F.desc("n"), "name")


def context_text(hits: DataFrame, k: int, text_col: str = "content_with_weight", name_col: str = "docnm_kwd", score_col: str = "sim") -> DataFrame:
    """One row: ``[i] (name) text`` of the best k hits."""
    best = hits.orderBy(F.desc(score_col), "id").limit(k)
    items = F.sort_array(F.collect_list(F.struct((-F.col(score_col)).alias("o"), "id", F.col(name_col).alias("name"), F.col(text_col).alias("body"))))
    lines = F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(x["name"], F.lit("")), F.lit(") "), F.coalesce(x["body"], F.lit(""))))
    return best.agg(items.alias("items")).select(F.array_join(lines, "\n\n").alias("context"))


def sources_of(hits: DataFrame, score_col: str = "sim") -> DataFrame:
    """(id, name, kind, score) with kind local, graph or web."""
    kind = F.when(F.col("doc_type_kwd") == "web_search", "web").when(F.col("doc_type_kwd") == "knowledge_graph", "graph").otherwise("local")
    return hits.select("id", F.col("docnm_kwd").alias("name"), kind.alias("kind"), F.round(score_col, 4).alias("score"))


def query_tokens(question: str) -> list[str]:
    """Tokens of one question, on the driver."""
    import re

    return re.findall(r"\w+", question.translate(str.maketrans(text.FULL_WIDTH, text.HALF_WIDTH)).lower())


def query_string(question: str, synonyms: Mapping[str, list[str]] | None = None) -> str:
    """The question in the query language: words with their weights, their synonyms as phrases with a quarter of it,
    neighbours as phrases with twice the larger."""
    own = weights.query_weights(query_tokens(text.without_urls_in(question)))
    also = lambda t, w: "".join(f' "{s}"^{w / 4:.4f}' for s in (synonyms or {}).get(t, []) if s.strip())
    words = [f"({t}^{w:.4f}{also(t, w)})" for t, w in own]
    pairs = [f'"{a} {b}"^{2 * max(v, w):.4f}' for (a, v), (b, w) in zip(own, own[1:], strict=False)]
    return " ".join(words + pairs)


def hybrid_many(index: fulltext.Index, field: str, questions: DataFrame, rows: DataFrame, topk: int = 1024, token_weight: float = 0.7, vector_weight: float = 0.3) -> DataFrame:
    """(query_id, id, cos, tok, sim) for many ``questions`` (query_id, text, vector) over ``rows`` (id, embedding) and the ``field``
    of an index. Candidates of a question are its ``topk`` nearest rows and all that hold some of its words; a row without a vector
    has cosine 0. Where no candidate has any cosine, sim is the token similarity alone."""
    keys = fulltext.similarity_keys(questions, "query_id", "text")
    least = keys.groupBy("query_id").agg((1e-9 / (1e-9 + F.sum("weight"))).alias("least"))  # no word at all
    near = ranking.vector_topk_many(rows, questions, topk).select("query_id", "id")
    tokens = fulltext.token_similarities(index, keys, field)
    both = near.withColumn("near", F.lit(True)).join(tokens, ["query_id", "id"], "full")
    vector = lambda c: F.col(c).cast("array<double>")
    both = both.join(rows.select("id", vector("embedding").alias("e")), "id", "left")
    asked = questions.select("query_id", vector("vector").alias("q")).join(least, "query_id", "left")
    both = both.join(checked_broadcast(asked), "query_id")
    cos = F.coalesce(vectors.cosine(F.col("e"), F.col("q")), F.lit(0.0))
    scored = both.select("query_id", "id", cos.alias("cos"), F.coalesce("tok", "least", F.lit(1.0)).alias("tok"))
    scored = written(scored, "hybrid")
    total = scored.groupBy("query_id").agg(F.sum("cos").alias("total"))
    fused = F.col("cos") * vector_weight + F.col("tok") * token_weight
    out = scored.join(checked_broadcast(total), "query_id")
    return out.withColumn("sim", F.when(F.col("total") == 0, F.col("tok")).otherwise(fused)).drop("total")
