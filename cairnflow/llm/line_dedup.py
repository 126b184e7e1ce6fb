"""Line dedup by overlapping windows of consecutive lines. DataFrame functions only.

A text is split at LF. Every run of ``window`` consecutive lines is hashed (two independent 64-bit hashes of the lines'
own hashes). The first place of a window is the one with the smallest (doc_id, row digest, line number); at every later
place all its lines are covered. Covered lines go, so overlapping repeated windows merge into one removed span. Tables are
broadcast only when counted and below ``broadcast_rows``.

Defined results: null text stays null (no lines); a text with fewer lines than ``window`` is never changed; an empty text
has one empty line; equal rows with one id count as one document, and each keeps its row; a null id sorts first; blank
lines count as lines; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _window_keys(lines: Column, window: int) -> Column:
    """Array of (h1, h2), one for each run of ``window`` lines in order. Each step hashes all runs by one line more, so the
    work grows with the lines."""
    n = F.size(lines)

    def runs(salt: list[Column]) -> Column:
        own = F.transform(lines, lambda x: F.xxhash64(*salt, x))
        out = own
        for k in range(1, window):
            out = F.zip_with(out, F.slice(own, k + 1, n), lambda a, b: F.xxhash64(*salt, a, b))
        return F.slice(out, 1, n - window + 1)

    return F.when(n >= window, F.zip_with(runs([]), runs([F.lit("second")]), lambda a, b: F.struct(a.alias("h1"), b.alias("h2"))))


def repeated_line_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, digest, gone): per document the array of line positions that later occurrences cover. Documents without
    any are absent; ``digest`` tells rows with one id but different texts apart."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.split(F.col(text_col), "\n").alias("lines"))
    w = src.select("doc_id", "digest", F.posexplode(_window_keys(F.col("lines"), window)).alias("pos", "w"))
    w = w.select("doc_id", "digest", "pos", "w.h1", "w.h2")
    place = F.struct("doc_id", "digest", "pos")
    seen = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = common.written(seen.where("not first <=> last").select("h1", "h2", "first"), "lines-again")
    # Both sides of a shuffled join are then plain exchanges, so that adaptive execution can split a hot window's rows.
    later = w.join(F.broadcast(again) if common.size_bounded(again, broadcast_rows) else again, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("starts"))
    spans = F.transform("starts", lambda s: F.sequence(s, s + F.lit(window - 1)))
    return covered.select("doc_id", "digest", F.array_distinct(F.flatten(spans)).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with ``text_col`` less its covered lines, plus ``lines_total`` and ``lines_removed`` (both long)."""
    gone = common.written(repeated_line_positions(docs, id_col, text_col, window, broadcast_rows), "lines-gone")
    small = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= 10 * broadcast_rows
    i, d, g, lines = common.unused(docs, "_gone_id", "_gone_digest", "_gone", "_lines")
    gone = gone.toDF(i, d, g)
    on = docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(d))
    both = docs.join(F.broadcast(gone) if small else gone, on, "left")
    # lines are a column of their own, so that no step below splits the text again for each line
    both = both.withColumn(lines, F.split(F.col(text_col), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
    text = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda k: F.get(F.col(lines), k)), "\n"))
    new = {
        "lines_total": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "lines_removed": F.coalesce(F.size(g), F.lit(0)).cast("long"),
    }
    keep = [c for c in docs.columns if c not in new]
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in keep], *[v.alias(c) for c, v in new.items()])


def op7(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_total", "lines_removed")


ORACLE_OP7 = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null),
w as (
  select doc_id, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c from l window d as (partition by doc_id order by pos)),
r as (
  select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as rn from w where c is not null),
g as (select distinct doc_id, pos + k as pos from r, (values (0), (1), (2)) s(k) where rn > 1),
k as (
  select l.doc_id, string_agg(line, chr(10) order by l.pos) filter (where g.pos is null) as text,
         count(*) as lines_total, count(g.pos) as lines_removed
  from l left join g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
       coalesce(lines_total, 0)::bigint as lines_total, coalesce(lines_removed, 0)::bigint as lines_removed
from documents d left join k on d.doc_id = k.doc_id
"""
