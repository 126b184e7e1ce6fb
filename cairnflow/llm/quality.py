"""Quality rules: in-text counts and cross-document line frequency.

Per text: words, characters in words, symbols, repeated lines and words in repeated three-word windows. Then every
normalised line (trimmed, lower case, white-space runs as one space; lines without a word are left out) is hashed, and
for each host the distinct documents holding it are counted; rows of one id and text are one document. A line is
boilerplate and removed if it is held by at least ``min_docs`` documents and more than ``max_share`` of its host's documents,
or by at least ``many_docs`` documents of the host, however large that is. A document that loses more than ``max_lost`` of
its words that way is depleted and rejected; one that fails the base rules is rejected too.

Counts are summed where lines are hashed, before the shuffle. A document meets its own boilerplate lines only, so no row
grows with its host.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows and ids each give a
row; an empty table gives an empty result; other columns are ignored or, in ``apply_rules``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
MAX_SHARE = 0.05
MANY_DOCS = 1000
MAX_LOST = 0.75

#: Fixed values of the symbol rule.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_NOT_STARTS = bytes(range(0x80, 0xC0))


def base_counts(text: str | None, spans: int = 3) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    joined = b"".join(words)
    chars = len(joined.translate(None, _NOT_STARTS))
    symbols = len(joined.translate(None, _NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= spans:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        key = code[: n - spans + 1].copy()
        for k in range(1, spans):  # renumbered after each step, so that keys stay exact
            key = key * len(ids) + code[k : n - spans + 1 + k]
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        twice = np.bincount(key)[key] > 1
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, np.flatnonzero(twice), 1)
        np.add.at(cover, np.flatnonzero(twice) + spans, -1)
        repeated = int((np.cumsum(cover[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """(hash, words) of the distinct normalised lines; words counts all copies of the line in the text."""
    found: dict[int, int] = {}
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if words := line.lower().split():
            h = xxhash.xxh3_64_intdigest(b" ".join(words))
            h -= (h >> 63) << 64
            found[h] = found.get(h, 0) + len(words)
    return list(found), list(found.values())


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _counted(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, digest, the counts, lines): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column(2).to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            lines = [line_hashes(t) for t in texts]
            sizes = np.cumsum([0, *(len(x[0]) for x in lines)]).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array([h for x in lines for h in x[0]], pa.int64()), pa.array([h for x in lines for h in x[1]], pa.int64())],
                names=["line", "words"],
            )
            arrays = [b.column(0), b.column(1), b.column(3), *(pa.array(counts[:, k]) for k in range(5))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(sizes), flat)], names=out_names)

    out_names = ["doc_id", "host", "digest", *(x.split()[0] for x in _COUNTS.split(", ")), "lines"]
    src = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col)).alias("digest"),
    )
    return src.mapInArrow(run, f"doc_id long, host string, digest long, {_COUNTS}, lines array<struct<line:long,words:long>>")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table), to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if common.size_bounded(df, rows) else df


_KEY = ["doc_id", "host", "digest"]


def _on(left: list[Column], right: list[str]) -> Column:
    """Whether (id, host, digest) on the left are those in the columns named on the right."""
    return left[0].eqNullSafe(F.col(right[0])) & left[1].eqNullSafe(F.col(right[1])) & (left[2] == F.col(right[2]))


def frequent_lines(
    counted: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS, broadcast_rows: int = 200_000
) -> DataFrame:
    """(host, line) of the boilerplate lines."""
    rows = counted.select("host", F.lit(1).alias("n"), "lines.line")
    again = counted.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1")
    again = common.written(again.toDF("i", "h", "g", "n"), "quality-again")
    if not again.isEmpty():  # rows of one document count once: all but one of them are taken off
        one = counted.select(*_KEY, "lines.line").join(_bounded(again, broadcast_rows), _on([F.col(c) for c in _KEY], ["i", "h", "g"]))
        rows = rows.unionByName(one.dropDuplicates(_KEY).select("host", (1 - F.col("n")).alias("n"), "line"))
    held = rows.select("host", "n", F.explode("line").alias("line")).groupBy("host", "line").agg(F.sum("n").alias("held"))
    held = common.written(held.where(F.col("held") >= min_docs), "quality-held")
    docs = common.written(rows.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("docs")), "quality-hosts")
    over = held.join(_bounded(docs, broadcast_rows), F.col("host").eqNullSafe(F.col("h")))
    return over.where((F.col("held") > max_share * F.col("docs")) | (F.col("held") >= many_docs)).select("host", "line")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_lost: float = MAX_LOST,
    broadcast_rows: int = 200_000, **limits,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, boilerplate). verdicts: one row per input row with the counts, base_failed, n_lost_words, boilerplate (the
    hashes of the document's boilerplate lines, null if it has none) and kept. ``limits`` are those of ``frequent_lines``."""
    counted = common.written(_counted(docs, id_col, text_col, host_col), "quality")
    over = common.written(frequent_lines(counted, broadcast_rows=broadcast_rows, **limits), "quality-lines")
    base = counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    cols = [*_KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keyed = _bounded(over.select(F.col("host").alias("h"), F.col("line").alias("l")), broadcast_rows)
    lines = counted.select(*_KEY, F.explode("lines").alias("x")).select(*_KEY, "x.line", "x.words")
    hit = lines.join(keyed, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    # rows with one id, host and text hold the same lines: the largest count of a line is that of one of them
    lost = hit.groupBy(*_KEY, "line").agg(F.max("words").alias("words"))
    lost = lost.groupBy(*_KEY).agg(F.sum("words").alias("n_lost_words"), F.collect_list("line").alias("boilerplate"))
    lost = lost.select(F.col("doc_id").alias("i"), F.col("host").alias("h"), F.col("digest").alias("g"), "n_lost_words", "boilerplate")
    out = base.select(*cols).join(lost, _on([F.col(c) for c in _KEY], ["i", "h", "g"]), "left")
    out = out.withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)))
    kept = ~F.col("base_failed") & ~(F.col("n_lost_words") > max_lost * F.col("n_words"))
    return out.select(*cols, "n_lost_words", "boilerplate", kept.alias("kept")), over


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_rows: int = 200_000, **limits
) -> DataFrame:
    """``docs`` without the rejected documents and without boilerplate lines; other columns as they are. What the rules
    change (one row per document rejected or with boilerplate) is broadcast up to ``broadcast_rows`` documents and ten
    times as many lines, and joined by a shuffle beyond."""
    verdicts, _ = judge(docs, id_col, text_col, host_col, broadcast_rows=broadcast_rows, **limits)
    i, h, g, keep, drop = names = common.unused(docs, "_id", "_host", "_digest", "_kept", "_drop")
    changed = verdicts.where("not kept or boilerplate is not null").select(*_KEY, "kept", F.when(F.col("kept"), F.col("boilerplate")))
    changed = common.written(changed.toDF(*names).dropDuplicates([i, h, g]), "quality-changed")
    small = (changed.agg(F.sum(F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)))).first()[0] or 0) <= 10 * broadcast_rows
    key = [docs[id_col].cast("long"), docs[host_col].cast("string"), F.xxhash64(docs[text_col])]
    both = docs.join(_bounded(changed, broadcast_rows) if small else changed, _on(key, [i, h, g]), "left")

    @F.pandas_udf("string")
    def without(texts, lines):
        out = []
        for text, gone in zip(texts, lines, strict=True):
            gone = set(gone.tolist())
            keep = []
            for line in text.split("\n"):
                h = xxhash.xxh3_64_intdigest(normal_line(line.encode("utf-8", "surrogatepass")))
                if not line.strip() or h - ((h >> 63) << 64) not in gone:
                    keep.append(line)
            out.append("\n".join(keep))
        return type(texts)(out, dtype=object)

    both = both.where(F.coalesce(F.col(keep), F.lit(True)))
    text = F.col(text_col)
    cleaned = F.when(F.col(drop).isNull(), text).otherwise(without(F.when(F.col(drop).isNull(), "").otherwise(text), F.coalesce(drop, F.array().cast("array<long>"))))
    return both.select(*[cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    verdicts, _ = judge(common.table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


ORACLE_OP10 = r"""
with d as (select doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from d, lateral (select unnest(range(1, len(w) - 1)) as i)),
r as (
  select doc_id, count(distinct i + j) as n
  from (select doc_id, i, count(*) over (partition by doc_id, k) as c from t), (values (0), (1), (2)) v(j) where c > 1 group by doc_id),
l as (
  select * from (select doc_id, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw
    from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from documents)) where len(lw) > 0),
dup as (select doc_id, count(*) - count(distinct line) as n from l group by doc_id),
n as (
  select doc_id, source, text, len(lw) as n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from l),
h as (select source, count(distinct (doc_id, text)) as docs from documents group by source),
o as (
  select source, norm from (select source, norm, count(distinct (doc_id, text)) as held from n group by source, norm) join h using (source)
  where held >= 10 and held > 0.05 * docs or held >= 1000),
lost as (select doc_id, sum(n) as n from n join o using (source, norm) group by doc_id),
c as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_lost_words
  from d left join r using (doc_id) left join dup using (doc_id) left join lost using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select *, not base_failed and not n_lost_words > 0.75 * n_words as kept from b
"""
