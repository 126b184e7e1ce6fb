"""Levels of headings and the numbers they are counted by; garbled fonts; points and distances."""

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import levels, vectors
from cairnflow.operators import aggregates, chunking


def test_number_of(spark):
    said = {
        "12": 12, " 7 ": 7, "-3": -3, "One": 1, "twenty-one": 21, "two hundred and five": 205, "three thousand two hundred": 3200, "one million two thousand three": 1_002_003,
        "hundred": 100, "三": 3, "十": 10, "十二": 12, "二十": 20, "一百零五": 105, "两千三百": 2300, "三万二千": 32_000, "一亿零一": 100_000_001, "IV": 4, "xii": 12, "MCMXCIX": 1999,
        "iiii": -1, "": -1, "word": -1, "one word": -1, "99999999999999999999": -1,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", levels.number_of(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == said
    assert spark.createDataFrame([(None,)], "t string").select(levels.number_of(F.col("t")).alias("n")).first().n == -1


@pytest.mark.parametrize("line,level", [("第三章 总则", 1), ("第十条 x", 2), ("二、说明", 3), ("（一）说明", 4), ("3. one", 5), ("1.2 two", 6), ("1.2.3 three", 6), ("What is it?", 9), ("7）seven", 10), ("(8) eight", 11), ("一是这样", 12), ("• point", 12), ("12 (3)", 0), ("ab", None), ("plain text", None)])
def test_line_level(spark, line, level):
    assert spark.createDataFrame([(line,)], "t string").select(levels.line_level(F.col("t")).alias("l")).first().l == level


def test_family_and_title_levels(spark):
    family = chunking.BULLETS[3]
    rows = [("PART ONE", None, "text"), ("Section 3", "Normal", "text"), ("x", "Heading 2", "text"), ("A short head", None, "title"), ("a, sentence.", None, "title"), ("other", None, "text")]
    df = spark.createDataFrame(rows, "t string, style string, layout string")
    got = df.select(levels.family_level(F.col("t"), family, F.col("style")).alias("f"), levels.title_level(F.col("t"), F.col("layout"), family).alias("l")).collect()
    assert [(r.f, r.l) for r in got] == [(1, 0), (3, 2), (2, 5), (5, 4), (5, 5), (5, 5)]


def test_usual_title_level(spark):
    rows = [(1, p, v) for p, v in enumerate([9, 9, 9, 2, 1, 1, 2])] + [(2, 0, 9)]
    df = spark.createDataFrame(rows, "doc long, pos int, level int")
    assert {r.doc: r.level for r in aggregates.usual_title_level(df, "doc", "pos", "level", 4).collect()} == {1: 2, 2: 5}


def test_font_garbled(spark):
    rows = [(1, c, "AB12+F") for c in "#!%&" * 6] + [(2, c, "F") for c in "#!%&" * 6] + [(3, c, "AB12+F") for c in "#!"] + [(4, c, "AB12+F") for c in "#!中" * 9] + [(1, " ", None)]
    df = spark.createDataFrame(rows, "page long, text string, font string")
    assert {r.page: r.garbled for r in aggregates.font_garbled(df, ["page"]).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_points(spark):
    at = spark.range(1).select(*[vectors.rotated_back(F.lit(3), F.lit(4), F.lit(a), F.lit(10), F.lit(20)).alias(f"r{a}") for a in (0, 90, 180, 270)]).first()
    assert [tuple(x) for x in at] == [(3, 4), (6, 3), (7, 16), (4, 17)]


def test_font_garbled_by_code_points(spark):
    """Characters beyond the first plane are Chinese, and a line separator is no white space, as in the SQL."""
    page = lambda p, text: [(p, x, "ABC1+F") for x in text]
    rows = page(1, "#" * 19 + " ") + page(2, "#" * 19 + " ") + page(3, "#" * 18 + "\U00020000" * 2) + page(4, "#" * 20 + "一") + page(5, "#" * 10 + "a" * 15) + page(6, "#" * 18 + "\u2028" * 2)
    df = spark.createDataFrame(rows, "page int, text string, font string")
    assert {r.page: r.garbled for r in aggregates.font_garbled(df, ["page"]).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
