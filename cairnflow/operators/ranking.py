"""Search and ranking: top-k, full-text scores, hybrid fusion, parent dedupe, paging, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors, weights
from ..shared import checked_broadcast


#: Ids and scores of so many rows are broadcast.
BROADCAST_ROWS = 100_000


def vector_topk(df: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "id", least: float | None = None, score_col: str = "sim") -> DataFrame:
    """The k rows nearest to ``query`` by cosine, ties by id; ids name rows. Filters put before it reach the scan. Ids and scores alone
    are sorted in one task; the rows are then taken by them, so that no task reads the k best rows of all others."""
    out = df.withColumn(score_col, vectors.cosine_to(F.col(vector_col), query))
    if least is not None:
        out = out.where(F.col(score_col) >= least)
    best = out.orderBy(F.desc(score_col), id_col).limit(k).select(F.col(id_col).alias("_id"), F.col(score_col).alias("_score"))
    best = F.broadcast(best) if k <= BROADCAST_ROWS else best
    return out.join(best, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(score_col) == F.col("_score")), "left_semi")


#: Rows whose likeness to a block of queries is held at a time.
SLICE_ROWS = 500


def vector_topk_many(rows: DataFrame, queries: DataFrame, k: int, vector_col: str = "embedding", id_col: str = "id", query_block: int = 1000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(query_id, id, sim): the k rows nearest to each of the ``queries`` (query_id, vector) by cosine to nine digits, ties by
    id. Queries are taken in blocks, of which one is broadcast at a time against all rows; a task takes ``slice_rows`` rows at a time, keeps the
    k best for each query so far and sends on no more than these. A zero vector is at 0 from all; rows and queries without a vector are left out."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    schema = f"query_id long, {id_col} {kind}, sim double"
    src = rows.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def best_of(block: list[tuple[int, list[float]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(([i for i, _ in block], _units(np.array([v for _, v in block], float))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, units = shared.value
            best, held, type_ = np.empty((0, len(names))), None, None
            for b in batches:
                type_ = b.schema.field(0).type
                for start in range(0, b.num_rows, slice_rows):
                    part = b.slice(start, slice_rows)
                    sims = np.round(_units(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)) @ units.T, 9)
                    ids = np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False)[:, None], sims.shape)
                    sims, ids = np.concatenate([best, sims]), ids if held is None else np.concatenate([held, ids])
                    order = np.lexsort((ids, -sims), axis=0)[:k]
                    best, held = np.take_along_axis(sims, order, 0), np.take_along_axis(ids, order, 0)
            if held is None:
                return
            for at in range(0, len(names), slice_rows):
                own = slice(at, at + slice_rows)
                query = np.repeat(np.array(names)[own], len(best))
                cols = [pa.array(query), pa.array(held[:, own].T.ravel(), type_), pa.array(best[:, own].T.ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", id_col, "sim"])

        return src.mapInArrow(run, schema)

    out, block = spark.createDataFrame([], schema), []
    for r in queries.where("vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == query_block:
            out, block = out.unionByName(best_of(block)), []
    if block:
        out = out.unionByName(best_of(block))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), id_col)
    return out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _units(vectors_: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors_, axis=1, keepdims=True)
    return vectors_ / np.where(norms == 0, 1, norms)


def term_frequencies(docs: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """(id, term, tf, n_tokens)"""
    t = docs.select(F.col(id_col), tokens.alias("tokens"))
    t = t.select(id_col, F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("term"))
    return t.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("n_tokens"))


def bm25(docs: DataFrame, tokens: Column, terms: list[str], id_col: str, k1: float = 1.2, b: float = 0.75, min_match: float = 0.0) -> DataFrame:
    """(id, score, n_matched) of documents that hold at least ``min_match`` of the terms. Only the query's terms are
    shuffled; counts over the corpus are one row."""
    sized = docs.select(F.col(id_col), tokens.alias("tokens"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    wanted = F.array(*map(F.lit, terms))
    hits = sized.select(id_col, F.size("tokens").alias("len"), F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term"))
    tf = hits.groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # a row per query term, and one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = scored.groupBy(id_col).agg(F.sum(part).alias("score"), F.count("*").alias("n_matched"))
    return out.where(F.col("n_matched") >= min_match * len(set(terms)))


def token_bag(content: Column, title: Column | None = None, important: Column | None = None, questions: Column | None = None) -> Column:
    """Distinct content tokens, the title twice, important words five times, question words six times."""
    parts = [F.array_distinct(content)]
    for extra, times in ((title, 2), (important, 5), (questions, 6)):
        if extra is not None:
            parts.append(F.flatten(F.array_repeat(F.coalesce(extra, F.array().cast("array<string>")), times)))
    return F.concat(*parts)


def hybrid_scores(df: DataFrame, query: list[float], query_tokens: list[str], vector_col: str, bag: Column, token_weight: float = 0.7, vector_weight: float = 0.3) -> DataFrame:
    """``df`` with cos, tok and sim. Where no candidate has any cosine, sim is the token similarity alone; whether that
    holds is one row, broadcast."""
    out = df.withColumns({"cos": vectors.cosine_to(F.col(vector_col), query), "tok": weights.token_similarity(bag, weights.query_terms(query_tokens))})
    total = out.agg(F.sum("cos").alias("_total"))
    fused = F.col("cos") * vector_weight + F.col("tok") * token_weight
    return out.crossJoin(F.broadcast(total)).withColumn("sim", F.when(F.col("_total") == 0, F.col("tok")).otherwise(fused)).drop("_total")


def above(df: DataFrame, threshold: float, vector_weight: float, score_col: str = "sim") -> DataFrame:
    return df.where(F.col(score_col) >= (threshold if vector_weight > 0 else 0.0))


def best_per_parent(df: DataFrame, parent_col: str, id_col: str, score_col: str = "sim") -> DataFrame:
    """The best row of each parent; rows without a parent all stay."""
    w = Window.partitionBy(parent_col, F.when(F.col(parent_col).isNull(), F.col(id_col))).orderBy(F.desc(score_col), id_col)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_parent_text(hits: DataFrame, parents: DataFrame, parent_col: str, text_col: str, id_col: str = "id") -> DataFrame:
    """Hits with their parents' text where there is one. For a written page of hits: their ids are broadcast, so that few
    parents are read and nothing is shuffled."""
    wanted = hits.select(F.col(parent_col).alias("_parent")).where("_parent is not null").distinct()
    p = parents.select(F.col(id_col).alias("_parent"), F.col(text_col).alias("_text")).join(checked_broadcast(wanted), "_parent", "left_semi")
    out = hits.join(p, F.col(parent_col) == F.col("_parent"), "left")
    return out.withColumn(text_col, F.coalesce("_text", text_col)).drop("_parent", "_text")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """Rows of one page, first page 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def reranked(hits: DataFrame, scorer: Callable[[Column], Column] | None, text_col: str, k: int, id_col: str = "id", score_col: str = "sim", graph_flag: str | None = None) -> DataFrame:
    """Hits by the scorer, or without one by 1 - 0.01 * place; rows flagged as graph context stay in front."""
    order = Window.orderBy(F.desc(score_col), id_col)  # the hits of one query: a page and its over-fetch
    score = scorer(F.col(text_col)) if scorer else 1 - 0.01 * (F.row_number().over(order) - 1)
    graph = F.coalesce(F.col(graph_flag), F.lit(False)) if graph_flag else F.lit(False)
    out = hits.withColumn("_graph", graph).withColumn("rerank_score", F.when(F.col("_graph"), F.lit(1.0)).otherwise(score))
    return out.orderBy(F.desc("_graph"), F.desc("rerank_score"), id_col).limit(k).drop("_graph")


def overfetched(hits: DataFrame, scorer: Callable[[Column], Column] | None, text_col: str, k: int, times: int = 3, id_col: str = "id", score_col: str = "sim") -> DataFrame:
    """The k best by the scorer of the ``times`` * k best hits: no more rows are scored."""
    best = hits.orderBy(F.desc(score_col), id_col).limit(times * k)
    return reranked(best, scorer, text_col, k, id_col, score_col)
