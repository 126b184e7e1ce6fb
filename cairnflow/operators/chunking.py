"""Chunking: from documents or their sections to chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import written
from .html_blocks import unescaped

#: Heading patterns by family, from the highest level down. Fixed values.
BULLETS: list[list[str]] = [
    ["第[零一二三四五六七八九十百0-9]+(分?编|部分)", "第[零一二三四五六七八九十百0-9]+章", "第[零一二三四五六七八九十百0-9]+节", "第[零一二三四五六七八九十百0-9]+条", "[\\(（][零一二三四五六七八九十百]+[\\)）]"],
    ["第[0-9]+章", "第[0-9]+节", "[0-9]{0,2}[\\. 、]", "[0-9]{0,2}\\.[0-9]{0,2}[^a-zA-Z/%~-]", "[0-9]{0,2}\\.[0-9]{0,2}\\.[0-9]{0,2}", "[0-9]{0,2}\\.[0-9]{0,2}\\.[0-9]{0,2}\\.[0-9]{0,2}"],
    ["第[零一二三四五六七八九十百0-9]+章", "第[零一二三四五六七八九十百0-9]+节", "[零一二三四五六七八九十百]+[ 、]", "[\\(（][零一二三四五六七八九十百]+[\\)）]", "[\\(（][0-9]{0,2}[\\)）]"],
    ["PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", "Chapter (I+V?|VI*|XI|IX|X)", "Section [0-9]+", "Article [0-9]+"],
    ["#[^#]", "##[^#]", "###", "####", "#####", "######"],
]
PACKED_TOKENS = 218
MANUAL_DEPTH = 2
#: Layouts of a paper's parts that begin with a mark, and that are dropped.
PAPER_MARKED, PAPER_DROPPED = ("abstract", "title"), ("header", "footer")
#: How numbered questions begin. Fixed values.
QUESTIONS = ["第([零一二三四五六七八九十百0-9]+)问", "第([零一二三四五六七八九十百0-9]+)条", "[\\(（]([零一二三四五六七八九十百]+)[\\)）]", "第([0-9]+)问", "第([0-9]+)条", "([0-9]{1,2})[\\. 、]", "([零一二三四五六七八九十百]+)[ 、]", "[\\(（]([0-9]{1,2})[\\)）]", "QUESTION (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", "QUESTION (I+V?|VI*|XI|IX|X)", "QUESTION ([0-9]+)"]


def sections(docs: DataFrame, id_col: str, text_col: str, separator: str = r"\n\s*\n") -> DataFrame:
    """(id, pos, section): trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(F.col(text_col), separator), lambda x: F.trim(x)), lambda s: s != "")
    return docs.select(F.col(id_col), F.posexplode(parts).alias("pos", "section"))


def merged_sections(parts: Column, budget: int, overlap: int = 0) -> Column:
    """Greedy merge of an array of sections: a new chunk opens where the last one already exceeds ``budget`` tokens, so
    chunks overshoot. Each section starts with a line feed. With an ``overlap`` in percent the limit is that much lower and
    a chunk begins with as large a tail of the one before, without position tags and not counted. A fold within the row:
    nothing is shuffled."""
    limit = budget * (100 - overlap) / 100
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"), F.lit(0).alias("n"))

    def step(state: Column, part: Column) -> Column:
        line = F.concat(F.lit("\n"), part)
        size = text.token_count(line)
        opens = (state["last"] != "") & (state["n"] > limit)
        done = F.when(opens, F.concat(state["done"], F.array(state["last"]))).otherwise(state["done"])
        opened = line
        if overlap:
            before = text.without_tags(state["last"])
            opened = F.concat(F.substring(before, F.floor(F.length(before) * (100 - overlap) / 100).cast("int") + 1, F.length(before)), line)
        last = F.when(opens, opened).otherwise(F.concat(state["last"], line))
        return F.struct(done.alias("done"), last.alias("last"), F.when(opens, size).otherwise(state["n"] + size).cast("int").alias("n"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["last"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def naive_chunks(docs: DataFrame, id_col: str, text_col: str, budget: int = 512, separator: str = r"\n\s*\n") -> DataFrame:
    """(id, pos, chunk)"""
    parts = F.filter(F.transform(F.split(F.col(text_col), separator), lambda x: F.trim(x)), lambda s: s != "")
    return docs.select(F.col(id_col), F.posexplode(merged_sections(parts, budget)).alias("pos", "chunk"))


def delimited_chunks(docs: DataFrame, id_col: str, text_col: str, delimiters: list[str]) -> DataFrame:
    """(id, pos, chunk): split at the delimiters, longest first, and not merged."""
    pattern = "|".join(re.escape(d) for d in sorted(set(delimiters), key=len, reverse=True))
    parts = F.filter(F.split(F.col(text_col), pattern), lambda s: F.trim(s) != "")
    return docs.select(F.col(id_col), F.posexplode(F.transform(parts, lambda s: F.concat(F.lit("\n"), s))).alias("pos", "chunk"))


def backticked(spec: str) -> list[str]:
    """Delimiters quoted in backticks."""
    return re.findall(r"`([^`]+)`", spec)


def child_texts(parent: Column, child_chars: int, marks: str = "。；！？") -> Column:
    """Children of a parent's text: cut behind every sentence mark, and before the mark where the text in front of it has
    ``child_chars`` characters or more; trimmed, without blank ones."""
    pattern = f"[^{marks}]{{{child_chars},}}|[^{marks}]*[{marks}]|[^{marks}]+"
    return F.filter(F.transform(F.regexp_extract_all(parent, F.lit(pattern), F.lit(0)), lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda s: s != "")


#: Bytes of text a task where rows repeat it. Parquet writes the different values of a column once a file while they are below 1 MiB; tasks are dealt by chance, so they get less.
REPEATED_BYTES = 640_000


def parent_child_chunks(docs: DataFrame, name_col: str, text_col: str, parent_budget: int = 1024, child_chars: int = 512) -> DataFrame:
    """(id, parent_id, kind, pos, child_pos, chunk, mom_with_weight): parents and their children (see ``child_texts``), which
    carry their parent's text. Ids are salted by kind, so a first child never hides its parent. Documents are dealt to tasks of
    ``REPEATED_BYTES``, and a parent's rows stay in its task, so that a written file holds its text once, not once a child."""
    docs = docs.select(name_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parents = naive_chunks(docs.repartition(max(1, -(-size // REPEATED_BYTES))), name_col, text_col, parent_budget).withColumnRenamed("chunk", "parent")
    parents = parents.withColumn("own", text.chunk_id(F.col(name_col), F.col("pos"), F.col("parent"), F.lit("parent")))
    # the parent's own row comes first, then those of its children
    cut = F.posexplode(F.concat(F.array(F.lit(None).cast("string")), child_texts(F.col("parent"), child_chars))).alias("k", "child")
    rows = parents.select("own", name_col, "pos", "parent", cut).withColumn("child_pos", F.when(F.col("k") > 0, F.col("k") - 1))
    below = lambda c: F.when(F.col("k") > 0, c)
    child_id = text.chunk_id(F.col(name_col), F.concat_ws("-", "pos", "child_pos"), F.col("child"), F.lit("child"))
    kind = below(F.lit("child")).otherwise("parent").alias("kind")
    chunk = below(F.col("child")).otherwise(F.col("parent")).alias("chunk")
    return rows.select(below(child_id).otherwise(F.col("own")).alias("id"), below(F.col("own")).alias("parent_id"), kind, name_col, "pos", "child_pos", chunk, below(F.col("parent")).alias("mom_with_weight"))


def qa_pairs(lines: DataFrame, doc_col: str, order: list[str], line_col: str) -> DataFrame:
    """(doc, pair, question, answer) from lines that begin with a question or answer mark. Other lines continue what
    stands above; a second answer replaces the first. Counts over the lines so far make the groups."""
    q = r"(?i)^(问题|Q|Question|问)[\t:： ]+(.*)"
    a = r"(?i)^(答案|回答|A|Answer|答)[\t:： ]+(.*)"
    so_far = Window.partitionBy(doc_col).orderBy(*order)
    t = lines.where(F.trim(line_col) != "")
    t = t.withColumns({"_q": F.col(line_col).rlike(q), "_a": F.col(line_col).rlike(a) & ~F.col(line_col).rlike(q)})
    t = t.withColumn("pair", F.sum(F.col("_q").cast("int")).over(so_far)).where("pair > 0")
    in_pair = Window.partitionBy(doc_col, "pair").orderBy(*order)
    t = t.withColumn("_part", F.sum(F.col("_a").cast("int")).over(in_pair))
    body = F.when(F.col("_q"), F.regexp_extract(line_col, q, 2)).when(F.col("_a"), F.regexp_extract(line_col, a, 2)).otherwise(F.col(line_col))
    items = F.sort_array(F.collect_list(F.struct(*order, F.col("_part").alias("part"), body.alias("body"))))
    g = t.groupBy(doc_col, "pair").agg(items.alias("items"), F.max("_part").alias("last"))
    joined = lambda part: F.array_join(F.transform(F.filter("items", lambda x: x["part"] == part), lambda x: x["body"]), "\n")
    out = g.select(doc_col, "pair", joined(F.lit(0)).alias("question"), F.when(F.col("last") > 0, joined(F.col("last"))).alias("answer"))
    return out.where("question <> '' and answer <> ''")


def qa_chunk(question: Column, answer: Column, english: bool = True) -> Column:
    first, second = ("Question: ", "Answer: ") if english else ("问题：", "回答：")
    return F.concat(F.lit(first), text.without_qa_prefix(question), F.lit("\t" + second), text.without_qa_prefix(answer))


def markdown_sections(lines: DataFrame, doc_col: str, pos_col: str, line_col: str) -> DataFrame:
    """(doc, part, section, tag): a heading and the lines below it; a heading without a body gives none."""
    heading = r"^(#{1,6})\s+(.+)"
    so_far = Window.partitionBy(doc_col).orderBy(pos_col)
    t = lines.withColumn("_h", F.col(line_col).rlike(heading))
    t = t.withColumn("part", F.sum(F.col("_h").cast("int")).over(so_far))
    body = F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct(F.col(pos_col).alias("p"), F.col(line_col).alias("l")))))
    title = F.max(F.when(F.col("_h"), F.trim(F.regexp_extract(line_col, heading, 2))))
    g = t.groupBy(doc_col, "part").agg(title.alias("title"), F.trim(F.array_join(F.transform(body, lambda x: x["l"]), "\n")).alias("body"), F.max("part").alias("_m"))
    last = Window.partitionBy(doc_col)
    g = g.withColumn("_last", F.max("part").over(last)).where("body <> ''")
    tag = F.when(F.col("title").isNull() & (F.col("part") < F.col("_last")), "title").otherwise("text")
    return g.select(doc_col, "part", F.concat_ws("\n", "title", "body").alias("section"), tag.alias("tag"))


def whole_chunks(parts: DataFrame, doc_col: str, pos_col: str, text_col: str, per: list[str] | None = None, joiner: str = "\n\n") -> DataFrame:
    """(doc, [per,] chunk): all parts of a document, or of each page of it, as one chunk."""
    keys = [doc_col, *(per or [])]
    items = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["t"]), joiner).alias("chunk"))


def table_pairs(tables: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pair, question, answer) from the first two cells of the rows of HTML tables, tags taken out and characters decoded; rows with an empty
    one and headings of such tables are left out. ``pair`` is the row's place. Null and broken tables have the rows that can be read."""
    inner = lambda name, c: F.regexp_extract_all(c, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
    said = lambda c: F.regexp_replace(unescaped(F.regexp_replace(c, "<[^>]*>", "")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rows = tables.select(id_col, F.posexplode(inner("tr", F.col(html_col))).alias("pair", "row")).withColumn("cells", inner("td", F.col("row")))
    t = rows.where(F.size("cells") >= 2).select(id_col, "pair", said(F.get("cells", F.lit(0))).alias("question"), said(F.get("cells", F.lit(1))).alias("answer"))
    return t.where((F.col("question") != "") & (F.col("answer") != "") & ~F.lower("question").isin("question", "问题", "q"))


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "_n") -> DataFrame:
    """``rows`` with their number within their group, from 1. Rows are dealt to ranges of (group, order), which are numbered by themselves and
    moved by the rows of the group in the ranges before: a large group is many tasks. Ranges are written, so that a task that is run again
    finds the same; rows of equal order are numbered in any order."""
    ranges = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "numbered")
    counts = ranges.groupBy(*group, "_range").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(F.struct(*group, "_range").alias("_at"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_moved"))
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    t = ranges.withColumn(out, own).join(moved, F.struct(*group, "_range").eqNullSafe(F.col("_at")))
    return t.withColumn(out, F.col(out) + F.col("_moved")).drop("_range", "_at", "_moved")


def _row_html(cells: list[str]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _head_html(cells: list[str]) -> str:
    return "<tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr>"


def table_rows(rows: DataFrame, order: str, cells: list[str], group: list[str]) -> DataFrame:
    """(group, head, order, row): the rows of a table a group as HTML, below a header (``head`` 0) each."""
    body = rows.select(*group, F.lit(1).alias("head"), order, _row_html(cells).alias("row"))
    none = F.lit(None).cast(rows.schema[order].dataType).alias(order)
    return body.unionByName(rows.select(*group).distinct().select(*group, F.lit(0).alias("head"), none, F.lit(_head_html(cells)).alias("row")))


def row_pages(rows: DataFrame, order: list[str], cells: list[str], group: list[str], size: int = 256) -> DataFrame:
    """(group, page, n_rows, html): rows as tables of ``size`` rows with the header repeated."""
    head, row = _head_html(cells), _row_html(cells)
    t = numbered(rows, group, order).withColumn("page", F.floor((F.col("_n") - 1) / size))
    items = F.sort_array(F.collect_list(F.struct("_n", row.alias("r"))))
    html = F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(items, lambda x: x["r"]), ""), F.lit("</table>"))
    return t.groupBy(*group, "page").agg(F.count("*").alias("n_rows"), html.alias("html"))


def row_batches(rows: DataFrame, order: list[str], line_col: str, group: list[str], size: int = 10, english: bool = True) -> DataFrame:
    """(group, batch, chunk): lines of ``size`` rows each, joined by semicolons."""
    items = F.sort_array(F.collect_list(F.struct("_n", F.col(line_col).alias("line"))))
    t = numbered(rows, group, order).withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int"))
    return t.groupBy(*group, "batch").agg(F.array_join(F.transform(items, lambda x: x["line"]), "; " if english else "； ").alias("chunk"))


def row_sentence(headers: dict[str, Column], sheet: str = "") -> Column:
    """``header：value; ...`` of the values that are neither null, empty nor zero, and the sheet's name behind."""
    parts = [F.when(v.isNotNull() & ~v.cast("string").isin("", "0", "0.0", "false"), F.concat(F.lit(h + "："), v.cast("string"))) for h, v in headers.items()]
    line = F.concat_ws("; ", *parts)
    return F.concat(line, F.lit(f" ——{sheet}")) if sheet and "sheet" not in sheet.lower() else line


def _levels(lines: list[str], family: int, tags: list[str] | None = None) -> list[int]:
    """Level of each line: headings of the family from 0 down, then title-like lines tagged as title or head, then body."""
    patterns = [re.compile(p) for p in BULLETS[family]]
    titles, body = len(patterns), len(patterns) + 1

    def level(line: str, tag: str) -> int:
        rest = titles if re.search("title|head", tag or "") and text.looks_like_title(line) else body
        return next((k for k, p in enumerate(patterns) if p.match(line.strip())), rest)

    return [level(line, tag) for line, tag in zip(lines, tags or [""] * len(lines), strict=True)]


def hierarchy_paths(lines: list[str], family: int, depth: int, tags: list[str] | None = None) -> list[list[str]]:
    """Each line of the ``depth`` deepest levels (body, title-like, lowest headings and so on) below the nearest heading above
    of every higher level. A heading that stands before the next higher one takes that one's place; headings used in a path
    are not emitted alone. Lines of the second highest level have no path."""
    level = _levels(lines, family, tags)
    body = len(BULLETS[family]) + 1
    used: set[int] = set()
    out = []
    for wanted in range(body, max(body - depth, -1), -1):
        above: dict[int, int] = {}
        for k, own in enumerate(level):
            if own == wanted and k not in used:
                chain = [k]
                for higher in range(own - 1, -1, -1) if own != 1 else ():
                    if higher in above:
                        if chain[-1] < above[higher]:  # found in an earlier section
                            chain.pop()
                        chain.append(above[higher])
                used.update(chain)
                out.append([lines[i] for i in reversed(chain)])
            above[own] = k
    return out


def packed_paths(paths: list[list[str]], budget: int = PACKED_TOKENS) -> list[str]:
    """Paths as chunks; lines without a path are packed while they fit the budget."""
    size = lambda s: int(sum(1.5 if "一" <= c <= "鿿" else 0.25 for c in s))
    out: list[list[str]] = []
    room = 0
    for p in paths:
        n = size(p[0]) if len(p) == 1 else budget
        if len(p) == 1 and out and n < room:
            out[-1] += p
            room -= n
        else:
            out.append(list(p))
            room = budget - n
    return ["\n".join(x) for x in out]


def tree_chunks_of(lines: list[str], family: int, depth: int, tags: list[str] | None = None) -> list[str]:
    """Every lowest heading with its lines, below its higher headings and theirs. Headings count down to the ``depth``-th level
    that the text has (body only where there is nothing else); deeper lines belong to the heading above. Lines before the
    first heading are a chunk."""
    level = _levels(lines, family, tags)
    present = sorted(set(level))
    if not present:
        return []
    limit = present[min(depth, len(present)) - 1]
    if limit > len(BULLETS[family]) and len(present) > 1:
        limit = present[-2]
    path: list[tuple[int, list[str]]] = [(-1, [])]  # lines before all headings, dropped at the first one
    out: list[str] = []

    def close() -> None:
        if held := [x for _, part in path for x in part]:
            out.append("\n".join(held))

    for line, own in zip(lines, level, strict=True):
        if own > limit:
            path[-1][1].append(line)
            continue
        if path[-1][0] == -1 or own <= path[-1][0]:
            close()
            path = [node for node in path if -1 < node[0] < own]
        path.append((own, [line]))
    close()
    return out


def _per_document(docs: DataFrame, id_col: str, lines: Column, chunks_of: Callable[[list[str], int], list[str]], family_col: str) -> DataFrame:
    """(id, pos, chunk) of the lines of each document, without those of one character or only digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, own, family in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2], strict=True):
                rows += [(i, k, c) for k, c in enumerate(chunks_of(list(own), int(family)))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "chunk"])

    kind = dict(docs.dtypes)[id_col]
    shown = lambda x: F.trim(F.split_part(x, F.lit("@"), F.lit(1)))
    held = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: (F.length(shown(x)) > 1) & ~shown(x).rlike("^[0-9]+$"))
    return docs.where(F.col(family_col) >= 0).select(id_col, held.alias("_lines"), family_col).mapInPandas(run, f"{id_col} {kind}, pos int, chunk string")


def _lines_of(text_col: str) -> Column:
    return F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x))


def hierarchical_chunks(docs: DataFrame, id_col: str, text_col: str, family_col: str, depth: int = 3) -> DataFrame:
    """(id, pos, chunk) of texts with a heading family (see ``voted_families``); none for family -1."""
    return _per_document(docs, id_col, _lines_of(text_col), lambda lines, family: packed_paths(hierarchy_paths(lines, family, depth)), family_col)


def tree_chunks(docs: DataFrame, id_col: str, text_col: str, family_col: str, depth: int = 3) -> DataFrame:
    return _per_document(docs, id_col, _lines_of(text_col), lambda lines, family: tree_chunks_of(lines, family, depth), family_col)


def voted_families(docs: DataFrame, id_col: str, text_col: str, lines: Column | None = None) -> DataFrame:
    """``docs`` with the heading family that most lines vote for, -1 for none. Within the row, nothing is shuffled."""
    lines = _lines_of(text_col) if lines is None else lines
    fits = lambda family: F.size(F.filter(lines, lambda x: ~text.is_bullet_like(x) & x.rlike("^(?:" + "|".join(family) + ")")))
    votes = F.array(*[fits(f) for f in BULLETS])
    most = F.array_max("_votes")
    out = docs.withColumn("_votes", votes)
    return out.withColumn("family", F.when(most > 0, F.array_position("_votes", most) - 1).otherwise(-1).cast("int")).withColumnRenamed("_votes", "votes")


def question_family(lines: Column) -> Column:
    """Number of the first form of question that a line of the array has; -1 for none."""
    has = lambda p: F.exists(lines, lambda x: ~text.is_bullet_like(x) & x.rlike("^" + p))
    found = F.coalesce(*[F.when(has(p), k) for k, p in enumerate(QUESTIONS)], F.lit(-1))
    return F.coalesce(F.when(lines.isNull(), -1), found)


STRATEGIES = ("naive", "laws", "book", "table", "presentation", "one", "qa", "manual", "paper")


def strategy_of(name: Column, wanted: Column) -> Column:
    """The strategy a document is cut by: slides always by page, an unknown one as ``naive``."""
    known = F.coalesce(F.when(wanted.isin(*STRATEGIES), wanted), F.lit("naive"))
    return F.when(F.lower(name).rlike(r"[.]pptx?$"), F.lit("presentation")).otherwise(known)


def layout_of(tag: Column) -> Column:
    """The layout in a part's tag: what stands before its position."""
    return F.lower(F.trim(F.substring_index(tag, "@@", 1)))


def page_chunks(parts: DataFrame, doc_col: str, pos_col: str, text_col: str, tag_col: str) -> DataFrame:
    """(doc, pos, chunk): a chunk a page; the page's number stands in the part's tag. Parts without one come last, each
    for itself."""
    tag = F.coalesce(F.col(tag_col), F.lit(""))
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t, p in ((tag, r"'page_number'\s*:\s*([0-9]+)"), (F.lower(tag), "pn[=:_]?([0-9]+)"))]
    number = F.coalesce(*found).cast("long")
    t = parts.where(F.trim(text_col) != "").select(doc_col, pos_col, text_col, F.coalesce(number.isNull().cast("int"), F.lit(1)).alias("_last"), F.coalesce(number, F.col(pos_col).cast("long")).alias("_page"))
    items = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t"))))
    pages = t.groupBy(doc_col, "_last", "_page").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("chunk"))
    at = F.row_number().over(Window.partitionBy(doc_col).orderBy("_last", "_page")) - 1
    return pages.select(doc_col, at.alias("pos"), "chunk")


def chunked(parts: DataFrame, name_col: str, pos_col: str, text_col: str, tag_col: str, strategy_col: str, budget: int = 512, depth: int = 3) -> DataFrame:
    """(name, kind, pos, chunk) of parsed parts, each document by its own strategy (see ``strategy_of``). Parts tagged
    ``table`` are chunks of kind ``table`` as they are; positions count within a kind. Laws and manuals go by paths of headings (manuals by
    two levels), books by the tree of headings, all by the budget where no heading family is found. Papers lose references, headers and
    footers, told by their tags, and mark titles and abstracts. A document's parts meet in one row."""
    t = parts.where(F.trim(text_col) != "").withColumn("_strategy", strategy_of(F.col(name_col), F.col(strategy_col)))
    is_table = F.coalesce(F.col(tag_col) == "table", F.lit(False))
    body, tables = t.where(~is_table), t.where(is_table)
    by = Window.partitionBy(name_col).orderBy(pos_col)
    outs = [tables.select(name_col, F.lit("table").alias("kind"), (F.row_number().over(by) - 1).alias("pos"), F.col(text_col).alias("chunk"))]
    flat = lambda df: df.select(name_col, F.lit("text").alias("kind"), "pos", "chunk")
    outs.append(flat(page_chunks(body.where("_strategy = 'presentation'"), name_col, pos_col, text_col, tag_col)))
    outs.append(flat(whole_chunks(body.where("_strategy = 'one'"), name_col, pos_col, text_col).withColumn("pos", F.lit(0))))
    lines = body.where("_strategy = 'qa'").select(name_col, pos_col, F.posexplode(F.split(text_col, "\n")).alias("_line", "_text"))
    pairs = qa_pairs(lines, name_col, [pos_col, "_line"], "_text")
    outs.append(flat(pairs.select(name_col, (F.col("pair") - 1).cast("int").alias("pos"), qa_chunk(F.col("question"), F.col("answer")).alias("chunk"))))
    kind = F.when(F.col("_strategy") == "paper", layout_of(F.coalesce(F.col(tag_col), F.lit(""))))
    said = F.concat(F.when(kind.isin(*PAPER_MARKED), F.concat(F.lit("["), F.upper(kind), F.lit("] "))).otherwise(""), F.trim(text_col))
    items = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), said.alias("t"))))
    held = body.where("_strategy in ('naive', 'table', 'laws', 'book', 'manual', 'paper')").where(~F.coalesce(kind.contains("reference") | kind.isin(*PAPER_DROPPED), F.lit(False)))
    held = held.groupBy(name_col, "_strategy").agg(F.transform(items, lambda x: x["t"]).alias("_parts"))
    held = voted_families(held, name_col, text_col, F.col("_parts"))
    plain = held.where("_strategy in ('naive', 'table', 'paper') or family < 0").select(name_col, F.posexplode(merged_sections(F.col("_parts"), budget)).alias("pos", "chunk"))
    outs.append(flat(plain))
    paths = lambda most: lambda own, family: packed_paths(hierarchy_paths(own, family, most))
    for strategy, cut in (("laws", paths(depth)), ("manual", paths(MANUAL_DEPTH)), ("book", lambda own, family: tree_chunks_of(own, family, depth))):
        outs.append(flat(_per_document(held.where(F.col("_strategy") == strategy), name_col, F.col("_parts"), cut, "family")))
    return reduce(DataFrame.unionByName, outs)
