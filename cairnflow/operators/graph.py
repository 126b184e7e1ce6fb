"""Knowledge graph: building, PageRank, neighbourhoods, ranking and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import checked_broadcast, written


def node_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def build(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Entities of one key: the first name and type, the longest description. Ends of relations that no
    entity names become nodes of type OTHER. Parallel relations: the last description. Both inputs have ``seq``."""
    e = entities.withColumn("key", node_key(F.col("name")))
    nodes = e.groupBy("key").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"),
        F.min_by("description", F.struct(-F.length("description"), F.col("seq"))).alias("description"), F.min_by("chunk_id", "seq").alias("chunk_id"),
    )
    r = relations.select(node_key(F.col("source")).alias("src"), node_key(F.col("target")).alias("dst"), "source", "target", "description", "chunk_id", "seq")
    edges = r.groupBy("src", "dst").agg(F.max_by("description", "seq").alias("description"), F.max_by("chunk_id", "seq").alias("chunk_id"))
    ends = r.select(F.explode(F.array(*[F.struct(F.col(k).alias("key"), F.col(n).alias("name"), "chunk_id", "seq") for k, n in (("src", "source"), ("dst", "target"))])).alias("x")).select("x.*")
    ends = ends.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min_by("chunk_id", "seq").alias("chunk_id"))
    more = ends.join(nodes.select("key"), "key", "left_anti").select("key", "name", F.lit("OTHER").alias("type"), F.lit("").alias("description"), "chunk_id")
    return nodes.unionByName(more), edges


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, check_every: int = 10) -> DataFrame:
    """(key, pagerank), the largest being 1. Directed, without weights; ends without out-edges spread evenly. Stops when
    ranks move by less than ``tolerance`` per node on the whole, which is looked at every ``check_every`` rounds. A round
    reads the ranks twice, so each is written: the plan stays as small as one round."""
    ids = written(nodes.select("key").distinct(), "rank-nodes")
    n = ids.count()
    if not n:
        return nodes.sparkSession.createDataFrame([], "key string, pagerank double")
    e = edges.select("src", "dst").distinct()
    e = written(e.withColumn("degree", F.count("*").over(Window.partitionBy("src"))), "rank-edges")
    sinks = written(ids.join(e.select(F.col("src").alias("key")).distinct(), "key", "left_anti"), "rank-sinks")
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, iterations + 1):
        lost = ranks.join(sinks, "key", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        flow = e.join(ranks, e.src == ranks.key).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        new = ids.join(flow, ids.key == flow.dst, "left").crossJoin(F.broadcast(lost))  # lost is one row
        new = new.select("key", ((1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        old, ranks = ranks, written(new, "ranks")
        if tolerance is not None and k % check_every == 0:
            moved = ranks.join(old.select("key", F.col("rank").alias("old")), "key").agg(F.sum(F.abs(F.col("rank") - F.col("old"))))
            if moved.first()[0] < n * tolerance:
                break
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("key", (F.col("rank") / F.col("top")).alias("pagerank"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, key, hop): nodes within ``hops`` steps of each seed along edges in either direction, at the least number."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select(F.col("key").alias("seed"), "key", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(both, F.col("key") == F.col("src")).select("seed", F.col("dst").alias("key")).distinct()
        front = written(step.join(seen.select("seed", "key"), ["seed", "key"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def by_type(entities: DataFrame, types: list[str], k: int) -> DataFrame:
    """The k entities of the given types with the largest PageRank."""
    return entities.where(F.col("type").isin([t.upper() for t in types])).orderBy(F.desc("pagerank"), "key").limit(k)


def expanded(edges: DataFrame, ranks: DataFrame, entities: DataFrame, hops: int = 2, seeds: int = 5, per_seed: int = 20, score_col: str = "sim") -> DataFrame:
    """(seed, key, hop, pagerank): of the best ``seeds`` entities, their ``per_seed`` neighbours with most PageRank."""
    chosen = entities.orderBy(F.desc(score_col), "key").limit(seeds).select("key")
    near = neighbours(edges, checked_broadcast(chosen), hops).join(ranks, "key")
    w = Window.partitionBy("seed").orderBy(F.desc("pagerank"), "key")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_seed).drop("_n")


def fused(score: Column, pagerank: Column) -> Column:
    """Similarity times PageRank, at least a hundredth; a row without a score counts as 0."""
    return F.coalesce(score, F.lit(0.0)) * F.greatest(F.coalesce(pagerank, F.lit(0.0)), F.lit(0.01))


def ranked_entities(hits: DataFrame, name_col: str = "name", score_col: str = "sim", rank_col: str = "pagerank") -> DataFrame:
    """One row per name, whatever its case: the one with the best fused score."""
    t = hits.withColumns({"key": F.lower(name_col), "score": fused(F.col(score_col), F.col(rank_col))})
    w = Window.partitionBy("key").orderBy(F.desc("score"), name_col)
    return t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "key")


def ranked_relations(hits: DataFrame, score_col: str = "sim", rank_col: str = "pagerank") -> DataFrame:
    """One row per pair of ends: the best by fused score."""
    t = hits.withColumns({"pair": F.concat_ws("|", F.lower("source"), F.lower("target")), "score": fused(F.col(score_col), F.col(rank_col))})
    w = Window.partitionBy("pair").orderBy(F.desc("score"), "description")
    return t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "pair")


def context(entities: DataFrame, relations: DataFrame, paths: DataFrame) -> DataFrame:
    """One row with the text that tells a model of the graph: at most 10 entities, 15 relations and 10 paths."""
    ent = entities.orderBy(F.desc("score"), "key").limit(10).select(F.lit(1).alias("part"), (-F.col("score")).alias("o"), F.col("key").alias("t"), F.format_string("%s|%s|%.3f|%s", "name", "type", "pagerank", "description").alias("line"))
    rel = relations.orderBy(F.desc("score"), "pair").limit(15).select(F.lit(2).alias("part"), (-F.col("score")).alias("o"), F.col("pair").alias("t"), F.format_string("%s|%s|%s", "source", "target", "description").alias("line"))
    hop = paths.orderBy("hop", "seed", "key").limit(10).select(F.lit(3).alias("part"), F.col("hop").cast("double").alias("o"), F.concat_ws("|", "seed", "key").alias("t"), F.format_string("%s -> %s (%d)", "seed", "key", "hop").alias("line"))
    lines = ent.unionByName(rel).unionByName(hop)  # 35 rows at most
    items = F.sort_array(F.collect_list(F.struct("part", "o", "t", "line")))
    return lines.agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("context"))


def graph_rows(nodes: DataFrame, edges: DataFrame, kb: str) -> DataFrame:
    """Entities and relations as chunk rows. Parallel relations keep rows of their own: the id holds the description."""
    ent = nodes.select(F.concat(F.lit("entity_"), F.substring(F.md5("key"), 1, 16)).alias("id"), F.lit("entity").alias("knowledge_graph_kwd"), F.col("name").alias("entity_name_kwd"), F.col("type").alias("entity_type_kwd"), F.lit(None).cast("string").alias("target_entity_kwd"), F.col("description").alias("content_with_weight"), "pagerank_flt")
    rid = F.substring(F.md5(F.concat_ws("_", "src", "dst", "description")), 1, 16)
    rel = edges.select(F.concat(F.lit("relation_"), rid).alias("id"), F.lit("relation").alias("knowledge_graph_kwd"), F.col("src").alias("entity_name_kwd"), F.lit(None).cast("string").alias("entity_type_kwd"), F.col("dst").alias("target_entity_kwd"), F.col("description").alias("content_with_weight"), F.lit(None).cast("double").alias("pagerank_flt"))
    return ent.unionByName(rel).withColumn("kb_id", F.lit(kb))


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes and edges as JSON lines below ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load(spark: SparkSession, path: str, node_schema: str, edge_schema: str = "src string, dst string, description string") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what ``save`` wrote."""
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")
