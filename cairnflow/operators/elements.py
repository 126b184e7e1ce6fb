"""Elements of Markdown texts, and the text around tables: windows over lines and sentences, nothing but DataFrame functions.

Both keep to one document for a group, whose rows are lines or sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line of each kind looks like, and the marks that end a sentence.
HEADER, ITEM, QUOTE, FENCE, INDENTED = r"^#{1,6}\s+.*$", r"^\s*([-*+]|\d+\.)\s+.*$", r"^\s*>", r"^\s*```", r"^\s+\w+"
SENTENCE = r"([。!?？；！\n]|\. )"


def markdown_elements(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, element, kind, content, start_line, end_line): headers, fenced code blocks, lists, quotes and paragraphs of each text, in
    order from 0.

    A fence opens and the next one closes (an open one holds the rest). Lists and quotes go on over blank lines, lists over indented words
    too; a paragraph goes on over blank lines unless the next line begins something else. Null texts have no elements.
    """
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "content"))
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(id_col).orderBy("line")
    text = F.col("content")
    fences = F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0))
    t = lines.withColumn("fence", text.rlike(FENCE) & ~text.rlike(HEADER)).withColumn("coded", fences % 2 == 1)
    own = F.when(F.col("coded") | F.col("fence"), "code").when(text.rlike(HEADER), "header").when(text.rlike(ITEM), "list").when(text.rlike(QUOTE), "quote")
    own = own.when(text.rlike(r"^\s*$"), "blank").when(text.rlike(INDENTED), "indented").otherwise("text")
    t = t.withColumn("own", own).withColumn("opens", F.col("fence") & ~F.col("coded"))
    # an indented line belongs to a list where that is the last thing begun, else it is text
    anchor = F.last(F.when(~F.col("own").isin("blank", "indented"), F.col("own")), ignorenulls=True).over(before)
    t = t.withColumn("kind", F.when(F.col("own") == "indented", F.when(anchor == "list", "list").otherwise("text")).otherwise(F.col("own")))
    earlier = F.last(F.when(F.col("kind") != "blank", F.col("kind")), ignorenulls=True).over(before)
    t = t.withColumn("earlier", earlier)
    starts = F.when(F.col("kind") == "blank", False).when(F.col("kind") == "code", F.col("opens")).when(F.col("kind") == "header", True).otherwise(~F.col("kind").eqNullSafe(F.col("earlier")))
    following = F.lead("own").over(order).isin("header", "code", "list", "quote")
    kept = F.when(F.col("kind") == "blank", F.coalesce(F.col("earlier").isin("list", "quote") | ((F.col("earlier") == "text") & ~F.coalesce(following, F.lit(False))), F.lit(False))).otherwise(True)
    t = t.withColumns({"starts": starts, "kept": kept})
    t = t.withColumn("element", (F.sum(F.col("starts").cast("int")).over(order) - 1).cast("int")).where("kept")
    rows = F.sort_array(F.collect_list(F.struct("line", "content")))
    out = t.groupBy(id_col, "element").agg(F.min_by("kind", "line").alias("kind"), rows.alias("rows"), F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    return out.select(id_col, "element", "kind", F.array_join(F.transform("rows", lambda x: x["content"]), "\n").alias("content"), "start_line", "end_line")


def sentences(blocks: DataFrame, keys: list[str], pos_col: str, text_col: str) -> DataFrame:
    """(keys, pos, k, sentence): each block's text cut behind the marks of ``SENTENCE``; nothing is lost."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SENTENCE, "$1\x00"), "\x00")
    rows = blocks.select(*keys, F.col(pos_col).alias("pos"), F.posexplode(parts).alias("k", "sentence"))
    return rows.where("sentence <> ''")


def _weight(han: Column, all_: Column) -> Column:
    return F.floor(han * 1.5 + (all_ - han) / 4.0)


def table_context(blocks: DataFrame, tables: DataFrame, keys: list[str], budget: int, pos_col: str = "pos", text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(keys, id, upper, lower): the text before and behind each table of a document, whole sentences from the nearest on while those
    nearer hold fewer than ``budget`` tokens. ``blocks`` (keys, pos, text) and ``tables`` (keys, pos, id) share the places; a
    table stands before the block of its own place.

    Distances are differences of running sums of characters, so tokens are those of the joined text. A sentence can only be in the
    context of tables within its reach in characters, and both are joined by strips of that width: work grows with the text.
    """
    reach = 4 * (budget + 1)
    han = F.length("sentence") - F.length(F.regexp_replace("sentence", r"[一-\x{9FFF}]", ""))
    rows = sentences(blocks, keys, pos_col, text_col).select(*keys, "pos", "k", "sentence", F.lit(None).alias("id"), han.alias("han"), F.length("sentence").alias("n"))
    marks = tables.select(*keys, F.col(pos_col).alias("pos"), F.lit(-1).alias("k"), F.lit(None).cast("string").alias("sentence"), F.col(id_col).alias("id"), F.lit(0).alias("han"), F.lit(0).alias("n"))
    w = Window.partitionBy(*keys).orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("id", F.col("id").cast(dict(tables.dtypes)[id_col])).unionByName(marks)
    both = both.withColumns({"to_han": F.sum("han").over(w), "to": F.sum("n").over(w)})
    said = both.where("sentence is not null").select(*keys, "pos", "k", "sentence", (F.col("to_han") - F.col("han")).alias("from_han"), (F.col("to") - F.col("n")).alias("from"), "to_han", "to")
    asked = both.where("sentence is null").select(*keys, "id", F.col("to_han").alias("at_han"), F.col("to").alias("at"))
    strip = F.floor(F.col("at") / reach)
    asked = asked.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    sides = []
    for name, edge in (("upper", "to"), ("lower", "from")):
        near = said.withColumn("strip", F.floor(F.col(edge) / reach)).join(asked, [*keys, "strip"])
        nearer = _weight(F.col("at_han") - F.col("to_han"), F.col("at") - F.col("to")) if name == "upper" else _weight(F.col("from_han") - F.col("at_han"), F.col("from") - F.col("at"))
        side = F.col("to") <= F.col("at") if name == "upper" else F.col("from") >= F.col("at")
        items = F.sort_array(F.collect_list(F.struct("pos", "k", "sentence")))
        got = near.where(side & (nearer < budget)).groupBy(*keys, "id").agg(items.alias("s"))
        sides.append(got.select(*keys, "id", F.trim(F.array_join(F.transform("s", lambda x: x["sentence"]), "")).alias(name)))
    out = tables.select(*keys, F.col(id_col).alias("id"))
    for side in sides:
        out = out.join(side, [*keys, "id"], "left")
    return out.select(*keys, "id", F.coalesce("upper", F.lit("")).alias("upper"), F.coalesce("lower", F.lit("")).alias("lower"))


def with_context(tables: DataFrame, context: DataFrame, keys: list[str], text_col: str, id_col: str = "id") -> DataFrame:
    """``tables`` with the text around them in front of and behind their own."""
    both = tables.join(context.withColumnRenamed("id", id_col), [*keys, id_col], "left")
    whole = F.concat(F.coalesce("upper", F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.coalesce("lower", F.lit("")))
    return both.withColumn(text_col, whole).drop("upper", "lower")
