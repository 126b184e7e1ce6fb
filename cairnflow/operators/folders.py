"""Folder trees and hierarchies by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shared import checked_broadcast, written


def folder_tree(folders: DataFrame, bases: DataFrame) -> DataFrame:
    """(path, parent, name, depth, n_bases, n_rows, all_bases, all_rows): every folder that is reached from ``/`` over the ``folders``
    (path) and those of the ``bases`` (folder, n_rows), with the bases in it and below it."""
    spark = folders.sparkSession
    paths = folders.select("path").unionByName(bases.select(F.coalesce("folder", F.lit("/")).alias("path")))
    paths = paths.select(text.normal_folder(F.col("path")).alias("path")).where("path <> '/'").distinct()
    parent = F.regexp_replace("path", "/[^/]*$", "")
    # a folder is reached if all folders above it are there
    steps = paths.where("path not like '%//%'").select(F.col("path").alias("own"), F.explode(text.ancestors(F.col("path"))).alias("path"))
    depth = F.size(text.ancestors(F.col("path"))).cast("int")
    reached = steps.join(paths, "path", "left_semi").groupBy(F.col("own").alias("path")).agg(F.count("*").alias("n")).where(F.col("n") == depth)
    top = spark.range(1).select(F.lit("/").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    tree = top.unionByName(reached.select("path", F.when(parent == "", "/").otherwise(parent).alias("parent"), depth.alias("depth")))
    held = bases.select(text.normal_folder(F.coalesce("folder", F.lit("/"))).alias("path"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    own = held.groupBy("path").agg(F.count("*").alias("n_bases"), F.sum("n_rows").alias("n_rows"))
    above = own.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("/")), text.ancestors(F.col("path"))))).alias("path"), "n_bases", "n_rows")
    below = above.groupBy("path").agg(F.sum("n_bases").alias("all_bases"), F.sum("n_rows").alias("all_rows"))
    out = tree.join(own, "path", "left").join(below, "path", "left")
    name = F.when(F.col("path") == "/", "/").otherwise(F.regexp_extract("path", "([^/]*)$", 1))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_bases", "n_rows", "all_bases", "all_rows")]
    return out.select("path", "parent", name.alias("name"), "depth", *counts)


def ancestors_of(nodes: DataFrame) -> DataFrame:
    """(id, names): the names from each of the ``nodes`` (id, parent, name) up to its root. A parent that is no node ends a walk;
    nodes must not form a ring. One join a level, each written: as many rows and levels as there are."""
    known = nodes.select(F.col("id").alias("up"), F.col("parent").alias("above"), F.col("name").alias("own"), F.lit(True).alias("found"))
    walk, done = nodes.select("id", F.col("parent").alias("up"), F.array("name").alias("names")), []
    while True:
        wanted = walk.where("up is not null").select("up").distinct()
        step = walk.join(checked_broadcast(known.join(checked_broadcast(wanted), "up", "left_semi")), "up", "left")
        step = written(step, "walk")
        if not step.where("found and up = id").isEmpty():
            raise ValueError("nodes form a ring")
        done.append(step.where("found is null").select("id", "names"))
        walk = step.where("found").select("id", F.col("above").alias("up"), F.concat("names", F.array("own")).alias("names"))
        if walk.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).groupBy("id").agg(F.max_by("names", F.size("names")).alias("names"))
