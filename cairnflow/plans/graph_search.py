"""Graph search: entities by vector and by type, relations by vector, paths, and the text that a model is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, ranking
from ..shared import written


@dataclass(frozen=True)
class GraphHits:
    """Ranked entities and relations, paths from the best entities, and one row of text."""

    entities: DataFrame
    relations: DataFrame
    paths: DataFrame
    context: DataFrame


def entities_of(rows: DataFrame) -> DataFrame:
    cols = {"name": "entity_name_kwd", "type": "entity_type_kwd", "description": "content_with_weight", "pagerank": "pagerank_flt"}
    return rows.where("knowledge_graph_kwd = 'entity'").select(F.lower("entity_name_kwd").alias("key"), *[F.col(c).alias(n) for n, c in cols.items()], "embedding", "id")


def relations_of(rows: DataFrame) -> DataFrame:
    cols = {"source": "entity_name_kwd", "target": "target_entity_kwd", "description": "content_with_weight", "pagerank": "pagerank_flt"}
    return rows.where("knowledge_graph_kwd = 'relation'").select(*[F.col(c).alias(n) for n, c in cols.items()], "embedding", "id")


def nearest(rows: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k nearest with ``sim`` as an index of cosines scores it, (1 + cosine) / 2; rows without a vector are left out."""
    near = ranking.vector_topk(rows.where("embedding is not null"), vector, k)
    return near.withColumn("sim", (F.col("sim") + 1) / 2)


def search(rows: DataFrame, vector: list[float] | None, types: list[str], hops: int = 2, k_entities: int = 20, k_typed: int = 50, k_relations: int = 20) -> GraphHits:
    """``rows`` are chunk rows of the knowledge bases asked. Entities come from the vector and from the types (ranked by
    PageRank, similarity 0), relations from the vector, paths from the best five entities. At most ``k_entities`` +
    ``k_typed`` + ``k_relations`` rows are held; only the edges are shuffled."""
    entities, relations = entities_of(rows), relations_of(rows)
    none = F.lit(None).cast("double")
    typed = graph.by_type(entities, types, k_typed).withColumn("sim", none)
    near = nearest(entities, vector, k_entities) if vector else entities.limit(0).withColumn("sim", none)
    found = written(graph.ranked_entities(near.unionByName(typed).drop("key")).drop("embedding"), "graph-entities")
    near_relations = nearest(relations, vector, k_relations) if vector else relations.limit(0).withColumn("sim", none)
    told = written(graph.ranked_relations(near_relations).drop("embedding"), "graph-relations")
    edges = relations.select(F.lower("source").alias("src"), F.lower("target").alias("dst"))
    paths = graph.expanded(edges, entities.select("key", "pagerank"), found, hops, score_col="score")
    return GraphHits(found, told, paths, graph.context(found, told, paths))
