"""HTML as blocks of text and tables, and their packing into chunks: windows over tags; rows of tables are packed as they stream by.

A page is read as a run of tags and texts. Open elements are depths: running sums of opened and closed tags, of which closings
without an opening are taken out. A document is one group, whose rows are its tags and texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from .pages import schema_of, starts_of

#: Elements that are blocks of text, marks of headings (five for the fourth level too), elements without an end.
BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", "section", "aside", "ul", "ol", "li", "table", "pre", "code", "blockquote", "figure", "figcaption"]
HEADINGS = {"h1": "#", "h2": "##", "h3": "###", "h4": "#####", "h5": "#####", "h6": "######"}
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Elements besides whose tags end an open paragraph.
ENDS_P = ["address", "body", "center", "details", "dd", "dialog", "dl", "dt", "fieldset", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "search", "summary"]
#: Names of characters, those of U+00A0 to U+00FF in their order.
LATIN_1 = """nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm
raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve
Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc
euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml""".split()
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…", "euro": "€", "trade": "™"}
NAMED |= {n: chr(0xA0 + k) for k, n in enumerate(LATIN_1)}

NO_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\z)"
TOKEN = r"</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<"
STYLE = r"""(?i)\sstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"


def unescaped(text: Column) -> Column:
    """Named (``NAMED``) and numbered characters decoded, with or without their semicolon; numbers that are no character are U+FFFD, unknown
    names stay."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(part: Column) -> Column:
        name = F.regexp_replace(part, "^&|;$", "")
        hexadecimal = F.substring(name, 2, 1).isin("x", "X")
        number = F.when(hexadecimal, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.conv(F.substring(name, 2, 7), 10, 10)).cast("int")
        fits = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        numbered = part.rlike("^&#[0-9xX]")
        return F.when(numbered, char).when(F.length(part) > 1, F.when(part.startswith("&"), F.coalesce(F.try_element_at(names, name), part)).otherwise(part)).otherwise(part)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one), "")).otherwise(text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _with_depths(df: DataFrame, id_col: str, of: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each name of ``of``: how many tags of those that it tells are open behind each token."""
    w = Window.partitionBy(id_col).orderBy("k")
    step = lambda told: F.when(told, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    df = df.withColumns({f"_sum_{n}": F.sum(step(told)).over(w) for n, told in of.items()})
    lowest = {n: F.min(f"_sum_{n}").over(w) for n in of}
    return df.withColumns({n: F.col(f"_sum_{n}") - F.least(F.lit(0), low) for n, low in lowest.items()}).drop(*[f"_sum_{n}" for n in of])


def tags(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, k, token, name, closes, in_table, table, tables): tags and texts in order; ``name`` is null for text. ``tables`` counts the
    outermost tables so far."""
    clean = F.regexp_replace(F.col(html_col), NO_TEXT, "")
    t = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))).alias("k", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    t = t.withColumns({"name": F.when(F.col("token").rlike("^<."), name), "closes": F.col("token").startswith("</")})
    t = _with_depths(t, id_col, {"open_tables": F.coalesce(F.col("name") == "table", F.lit(False))})
    w = Window.partitionBy(id_col).orderBy("k")
    before = F.coalesce(F.lag("open_tables").over(w), F.lit(0))
    begins = (F.col("open_tables") == 1) & (before == 0)
    t = t.withColumn("tables", F.sum(begins.cast("int")).over(w))
    return t.withColumn("in_table", (F.col("open_tables") > 0) | (before > 0))


def html_tables(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, content): the outermost tables of ``tags`` as HTML without styles, characters decoded."""
    rows = F.sort_array(F.collect_list(F.struct("k", "token")))
    t = tokens.where("in_table").groupBy(id_col, (F.col("tables") - 1).cast("int").alias("pos")).agg(rows.alias("rows"))
    parts = F.transform("rows", lambda x: F.when(x["token"].startswith("<"), F.regexp_replace(x["token"], STYLE, "")).otherwise(x["token"]))
    return t.select(id_col, "pos", unescaped(F.array_join(parts, "")).alias("content"))


def html_blocks(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, content): the text of ``tags`` outside tables by blocks, in order from 0.

    A text belongs to the innermost open element of ``BLOCKS``; neighbouring texts of one block are joined by spaces, text of none to
    the block before it (where there is none yet, it is a block of its own). Text that stands in a heading itself begins with the
    heading's mark. A paragraph ends at any tag of a block, a list item at the next of its list; other elements are closed by their
    own tags. Pages without text have no blocks.
    """
    inner = [b for b in BLOCKS if b not in ("p", "li", "table")]
    name, opens = F.col("name"), ~F.col("closes")
    is_in = lambda names: F.coalesce(name.isin(names), F.lit(False))
    out = ~F.col("in_table")
    any_tag = F.coalesce(name != "", F.lit(False)) & ~is_in([*VOID, "p", "li"])
    t = _with_depths(tokens, id_col, {"depth": is_in(inner) & out, "all_open": any_tag & out})
    w, level = Window.partitionBy(id_col).orderBy("k"), Window.partitionBy(id_col, "depth").orderBy("k")
    last = lambda when, *cols, over: F.last(F.when(when, F.struct(*cols)), ignorenulls=True).over(over)
    ends = is_in([*[b for b in BLOCKS if b != "code"], *ENDS_P])
    t = t.withColumn("p", last(ends, "k", "depth", (opens & (name == "p")).alias("on"), over=w))
    t = t.withColumns({"c": last(is_in(inner) & opens, "k", "name", "all_open", over=level), "l": last(is_in(["li"]), "k", opens.alias("on"), over=level)})
    t = t.where("name is null and not in_table").withColumn("text", _stripped(unescaped(F.col("token")))).where("text <> ''")
    # a document's first level has no element: what was opened on it last is none's
    c = F.when(F.col("depth") > 0, F.col("c"))
    in_p = F.col("p.on") & (F.col("p.depth") == F.col("depth")) & (F.col("p.k") > F.coalesce(c["k"], F.lit(-1)))
    in_li = F.col("l.on") & (F.col("l.k") > F.coalesce(c["k"], F.lit(-1)))
    t = t.withColumn("block", F.when(in_p, F.col("p.k")).when(in_li, F.col("l.k")).otherwise(c["k"]))
    marks = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    mark = F.when((F.col("block") == c["k"]) & (F.col("all_open") == c["all_open"]), F.try_element_at(marks, c["name"]))
    t = t.withColumn("text", F.concat_ws(" ", mark, "text"))
    earlier = F.last("block", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("block").isNotNull() & ~F.col("block").eqNullSafe(earlier)
    t = t.withColumn("g", F.sum(new.cast("int")).over(w))
    items = F.sort_array(F.collect_list(F.struct("k", "text")))
    out = t.groupBy(id_col, "g").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("content"))
    return out.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("g")) - 1).alias("pos"), "content")


def packed(rows: DataFrame, group: list[str], order: list[str], budget: int, separator: str = "", front: str = "", end: str = "") -> DataFrame:
    """(group, pos, chunk): neighbouring pieces (text, n, alone) of a group in their ``order``, joined while they hold ``budget`` tokens (``n``) or
    fewer; a larger piece, and one with ``alone``, is a chunk by itself. Pieces stream through the fold, which holds those of one chunk."""
    rows = rows.select(*group, *[c for c in order if c not in group], "text", "n", "alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before the batch
        held: list[str] = []
        total, pos, closed = 0, 0, False

        def chunks(owners: pa.Table, at: list[int], places: list[int], made: list[str]) -> Iterator[pa.RecordBatch]:
            out = owners.select(group).take(pa.array(at, pa.int64()))
            out = out.append_column("pos", pa.array(places, pa.int32())).append_column("chunk", pa.array(made, pa.string()))
            yield from out.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            both = pa.Table.from_batches([b] if last is None else [last, b])
            begins = np.zeros(both.num_rows, bool)
            begins[starts_of(both, group)] = True
            ahead = both.num_rows - b.num_rows
            begins[0] = begins[0] and not ahead
            at, places, made = [], [], []
            for k, (text, n, alone, first) in enumerate(zip(*[b.column(c).to_pylist() for c in ("text", "n", "alone")], begins[ahead:].tolist(), strict=True), ahead):
                if held and (first or closed or alone or total + n > budget):
                    at.append(k - 1)
                    places.append(pos)
                    made.append(front + separator.join(held) + end)
                    held, total, pos = [], 0, pos + 1
                pos = 0 if first else pos
                held.append(text)
                total, closed = total + n, alone
            if made:
                yield from chunks(both, at, places, made)
            last = b.slice(b.num_rows - 1)
        if held:
            yield from chunks(pa.Table.from_batches([last]), [0], [pos], [front + separator.join(held) + end])

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema_of(rows.select(*group), "pos int", "chunk string"))


def packed_blocks(blocks: DataFrame, id_col: str, budget: int = 512, pos_col: str = "pos", text_col: str = "content") -> DataFrame:
    """(id, pos, chunk): neighbouring blocks joined by line feeds while they hold ``budget`` tokens or fewer. A larger block stands alone,
    cut to chunks of ``budget`` tokens each, which are its lower-case words joined by spaces."""
    words = texts.tokens(F.col(text_col))
    rows = blocks.select(id_col, F.col(pos_col).alias("pos"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), words.alias("words"))
    large = F.size("words") > budget
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / budget).cast("int")),
        lambda k: F.struct(F.array_join(F.slice("words", k * budget + 1, budget), " ").alias("text"), F.lit(budget).alias("n"), F.lit(True).alias("alone")),
    )
    whole = F.array(F.struct("text", F.size("words").alias("n"), F.lit(False).alias("alone")))
    rows = rows.select(id_col, "pos", F.when(large, cut).otherwise(whole).alias("cut"))
    pieces = rows.select(id_col, F.col("pos").alias("_pos"), F.posexplode("cut").alias("_k", "piece")).select(id_col, "_pos", "_k", "piece.*")
    return packed(pieces, [id_col], ["_pos", "_k"], budget, "\n").where("chunk <> ''")


def packed_rows(rows: DataFrame, group: list[str], order: list[str], row_col: str, budget: int = 512) -> DataFrame:
    """(group, pos, chunk): the rows of each group's table in their ``order`` as tables of ``budget`` tokens or fewer, tags counted; a larger
    row is one alone."""
    text = F.col(row_col)
    pieces = rows.select(*group, *order, text.alias("text"), F.size(texts.tokens(text)).alias("n"), F.lit(False).alias("alone"))
    return packed(pieces, group, order, budget, front="<table>", end="</table>")


def table_parts(tables: DataFrame, id_col: str, html_col: str, budget: int = 512) -> DataFrame:
    """(id, pos, chunk): each table cut between rows into tables of ``budget`` tokens or fewer, tags counted; a larger row is one alone.
    Tables within cells are cut with their rows; tables without rows give nothing."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr\b[^>]*>.*?</tr\s*>"), F.lit(0))
    return packed_rows(tables.select(id_col, F.posexplode(found).alias("_k", "_row")), [id_col], ["_k"], "_row", budget)


def page_chunks(pages: DataFrame, id_col: str, html_col: str, budget: int = 512) -> DataFrame:
    """(id, part, pos, chunk): the packed blocks of each page (part 0), then its tables whole (part 1)."""
    tokens = tags(pages, id_col, html_col)
    chunks = packed_blocks(html_blocks(tokens, id_col), id_col, budget).select(id_col, F.lit(0).alias("part"), "pos", "chunk")
    tables = html_tables(tokens, id_col).select(id_col, F.lit(1).alias("part"), "pos", F.col("content").alias("chunk"))
    return chunks.unionByName(tables)
