"""Aggregates: document counts, stage latencies, votes, repeated lines."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def documents_by_count(df: DataFrame, name_col: str, limit: int = 500) -> DataFrame:
    """(name, n): the ``limit`` names with most rows."""
    return df.groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def hits_by_document(hits: DataFrame, name_col: str, doc_col: str, score_col: str, id_col: str) -> DataFrame:
    """(name, n, doc_id): hits by document name, with the id of its best hit."""
    best = F.min_by(doc_col, F.struct(-F.col(score_col), F.col(id_col)))
    return hits.groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n"), best.alias("doc_id"))


def stage_stats(df: DataFrame, stage_col: str, ms_col: str, order: list[Column | str], recent: int = 100) -> DataFrame:
    """Per stage: rows in all, and over the last ``recent`` the mean, least, most, p50, p95 (by place, not interpolated)
    and last. The window keeps a bounded number of rows per stage before anything is gathered."""
    desc = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    last = df.withColumn("_n", F.row_number().over(Window.partitionBy(stage_col).orderBy(*desc))).where(F.col("_n") <= recent)
    times = F.sort_array(F.collect_list(ms_col))
    out = last.groupBy(stage_col).agg(times.alias("t"), F.max_by(ms_col, -F.col("_n")).alias("last"))
    n = F.size("t")
    at = lambda i: F.round(F.element_at("t", (i + 1).cast("int")), 1)
    mean = F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / n, 1)
    stats = out.select(
        F.col(stage_col), n.alias("recent"), mean.alias("avg_ms"), at(F.lit(0)).alias("min_ms"), at(n - 1).alias("max_ms"),
        at(F.floor(n / 2)).alias("p50_ms"), at(F.least(F.floor(n * 0.95), n - 1)).alias("p95_ms"), F.round("last", 1).alias("last_ms"),
    )
    return stats.join(df.groupBy(stage_col).agg(F.count("*").alias("count")), stage_col)


def last_value(df: DataFrame, stage_col: str, ms_col: str, *order: str) -> DataFrame:
    return df.groupBy(stage_col).agg(F.max_by(ms_col, F.struct(*order)).alias("last_ms"))


def family_votes(lines: DataFrame, doc_col: str, text: Column, families: list[list[str]], eligible: Column) -> DataFrame:
    """(doc, votes, family): how many lines match a pattern of each family, and the first family with most; -1 for none."""
    hits = [F.sum(F.when(eligible & text.rlike("^(?:" + "|".join(f) + ")"), 1).otherwise(0)) for f in families]
    out = lines.groupBy(doc_col).agg(F.array(*hits).alias("votes"))
    most = F.array_max("votes")
    return out.withColumn("family", F.when(most > 0, F.array_position("votes", most) - 1).otherwise(-1).cast("int"))


def most_frequent(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """(group, value): the value with most rows, ties by the smallest."""
    n = df.groupBy(group_col, value_col).agg(F.count("*").alias("n"))
    return n.groupBy(group_col).agg(F.min_by(value_col, F.struct(-F.col("n"), F.col(value_col))).alias(value_col))


def without_repeats(df: DataFrame, text_col: str, among: Column) -> DataFrame:
    """``df`` less all rows whose text occurs more than once among the eligible rows."""
    seen = df.where(among).groupBy(text_col).agg(F.count("*").alias("n")).where("n > 1").select(text_col)
    return df.join(seen, text_col, "left_anti")


def max_normalised(df: DataFrame, col: str) -> DataFrame:
    """``col`` over its largest value, which is one row, broadcast."""
    top = df.agg(F.max(col).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(col, F.when(F.col("_top") > 0, F.col(col) / F.col("_top")).otherwise(F.col(col))).drop("_top")


def outcome_counts(df: DataFrame, status_col: str, statuses: list[str]) -> DataFrame:
    """One row with a count for each status."""
    return df.agg(*[F.count_if(F.col(status_col) == s).alias(s) for s in statuses])


def usual_title_level(levels: DataFrame, doc_col: str, pos_col: str, level_col: str, most: int) -> DataFrame:
    """(doc, level): the level that most lines have of those up to ``most``, of several the one met first; ``most`` + 1 where none has."""
    own = F.col(level_col) <= most
    counted = levels.groupBy(doc_col, level_col).agg(F.count("*").alias("n"), F.min(pos_col).alias("first"))
    return counted.groupBy(doc_col).agg(F.coalesce(F.max_by(F.when(own, F.col(level_col)), F.when(own, F.struct("n", -F.col("first")))), F.lit(most + 1)).alias(level_col))


#: Code points of white space, and ranges of those of Chinese, Japanese and Korean characters and of ASCII marks.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
ASIAN = ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0xAC00, 0xD7AF))
MARKS = ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def font_garbled(chars: DataFrame, keys: list[str], text_col: str = "text", font_col: str = "font", least: int = 20) -> DataFrame:
    """(keys, garbled) of pages by their characters: at least three in ten are of a font subset, fewer than one in twenty Chinese,
    Japanese or Korean, and more than four in ten ASCII marks, as where a font maps its glyphs to these. Pages of fewer than ``least``
    characters other than white space are not."""
    text, code = F.coalesce(F.col(text_col), F.lit("")), F.col("_code")
    white = code.isin(*WHITE) & ((F.length(text) == 1) | text.rlike(r"^\s*$"))  # the rest of a text is looked at where it begins with white space
    seen = chars.withColumn("_code", F.ascii(text)).where((text != "") & ~white)
    within = lambda *ranges: functools.reduce(lambda a, b: a | b, [code.between(*r) for r in ranges])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    plus = F.instr(font_col, "+")
    subset = plus.between(3, 7) & F.col(font_col).rlike(r"^[A-Z0-9]{2,6}\+")
    asian, marks = within(*ASIAN), within(*MARKS)
    out = seen.groupBy(*keys).agg(F.count("*").alias("n"), share(subset).alias("subset"), share(asian).alias("asian"), share(marks).alias("marks"))
    return out.select(*keys, ((F.col("n") >= least) & (F.col("subset") >= 0.3) & (F.col("asian") < 0.05) & (F.col("marks") > 0.4)).alias("garbled"))
