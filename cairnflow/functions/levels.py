"""Levels of headings and the numbers they are counted by, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Forms of numbered lines and their levels, in the order in which they are tried.
LINE_LEVELS = [
    ("第[零一二三四五六七八九十百]+章", 1),
    ("第[零一二三四五六七八九十百]+[条节]", 2),
    ("[零一二三四五六七八九十百]+[、 　]", 3),
    ("[\\(（][零一二三四五六七八九十百]+[）\\)]", 4),
    ("[0-9]+(、|\\.[　 ]|\\.[^0-9])", 5),
    ("[0-9]+\\.[0-9]+(、|[. 　]|[^0-9])", 6),
    ("[0-9]+\\.[0-9]+\\.[0-9]+(、|[ 　]|[^0-9])", 7),
    ("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+(、|[ 　]|[^0-9])", 8),
    (".{0,48}[：:?？]$", 9),
    ("[0-9]+）", 10),
    ("[\\(（][0-9]+[）\\)]", 11),
    ("[零一二三四五六七八九十百]+是", 12),
    ("[⚫•➢✓]", 12),
]
_NUMBERS_ONLY = "^[0-9 ().,%+/-]+$"
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_LARGE = {"thousand": 1000, "million": 10**6, "billion": 10**9}
_WORDS = {w: k for k, w in enumerate(_ONES)} | {w: 10 * k for k, w in enumerate(_TENS, 2)}
_DIGITS = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_WIDE = {"万": 10**4, "亿": 10**8}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def line_level(line: Column) -> Column:
    """Level of a numbered line, 0 for lines of numbers alone, null for others and for those of two characters or fewer."""
    out = F.when(F.length(line) <= 2, F.lit(None).cast("int")).when(line.rlike(_NUMBERS_ONLY), F.lit(0))
    for pattern, level in LINE_LEVELS:
        out = out.when(line.rlike(f"^(?:{pattern})"), F.lit(level))
    return out


def family_level(line: Column, patterns: list[str], style: Column | None = None) -> Column:
    """Level of a line by the ``patterns`` of a heading family, from 1; one more than they are for other lines. A ``style`` named
    ``Heading n`` says the level itself."""
    trimmed = F.trim(F.regexp_replace(line, "　", " "))
    out = F.when(F.lit(False), F.lit(0)) if style is None else F.when(style.rlike(r"^Heading.* [0-9]+$"), F.regexp_extract(style, r"([0-9]+)$", 1).cast("int"))
    for k, pattern in enumerate(patterns, 1):
        out = out.when(trimmed.rlike(f"^(?:{pattern})"), F.lit(k))
    return out.otherwise(F.lit(len(patterns) + 1))


def title_level(line: Column, layout: Column, patterns: list[str]) -> Column:
    """Level of a line in a document of a heading family, from 0: the pattern that it begins with, if it is no mere list item; the number
    of patterns for lines laid out as titles; one more for others."""
    out = F.when(F.lit(False), F.lit(0))
    for k, pattern in enumerate(patterns):
        out = out.when(F.trim(line).rlike(f"^(?:{pattern})") & ~text.is_bullet_like(line), F.lit(k))
    head = layout.rlike("title|head") & text.is_title_like(F.get(F.split(line, "@"), F.lit(0)))
    return out.when(head, F.lit(len(patterns))).otherwise(F.lit(len(patterns) + 1))


def _of(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[key].cast("long")


def _folded(parts: Column, step: Callable[[Column, Column], dict[str, Column]], names: tuple[str, ...], finish: Callable[[Column], Column]) -> Column:
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    return F.aggregate(parts, start, lambda s, x: F.struct(*[step(s, x)[n].cast("long").alias(n) for n in names]), finish)


def number_of(said: Column) -> Column:
    """The number that a text says: digits, English words, Chinese numerals or a Roman numeral; -1 if none."""
    t = F.lower(F.trim(said))
    words = F.filter(F.split(F.regexp_replace(t, "[ -]+", " "), " "), lambda w: (w != "") & (w != "and"))

    def english(s: Column, w: Column) -> dict[str, Column]:
        own, large = _of(_WORDS, w), _of(_LARGE, w)
        part = F.when(w == "hundred", F.greatest(s["part"], F.lit(1)) * 100).when(large.isNotNull(), 0).otherwise(s["part"] + F.coalesce(own, F.lit(0)))
        return {"sum": F.when(large.isNotNull(), s["sum"] + F.greatest(s["part"], F.lit(1)) * large).otherwise(s["sum"]), "part": part}

    def chinese(s: Column, c: Column) -> dict[str, Column]:
        digit, unit, wide = _of(_DIGITS, c), _of(_UNITS, c), _of(_WIDE, c)
        one = F.when((s["digit"] == 0) & (s["part"] == 0), 1).otherwise(s["digit"])  # ten stands for one ten at the front
        part = F.when(wide.isNotNull(), 0).when(unit.isNotNull(), s["part"] + one * unit).otherwise(s["part"])
        total = F.when(wide.isNotNull(), (s["sum"] + s["part"] + s["digit"]) * wide).otherwise(s["sum"])
        return {"sum": total, "part": part, "digit": F.coalesce(digit, F.lit(0))}

    def roman(s: Column, c: Column) -> dict[str, Column]:
        own = _of(_ROMAN, c)
        return {"sum": s["sum"] + own - F.when(own > s["last"], 2 * s["last"]).otherwise(0), "last": own}

    named = F.forall(words, lambda w: w.isin(*_WORDS, "hundred", *_LARGE)) & (F.size(words) > 0)
    out = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long")).when(named, _folded(words, english, ("sum", "part"), lambda s: s["sum"] + s["part"]))
    out = out.when(t.rlike(f"^[{''.join([*_DIGITS, *_UNITS, *_WIDE])}]+$"), _folded(F.split(t, ""), chinese, ("sum", "part", "digit"), lambda s: s["sum"] + s["part"] + s["digit"]))
    valid = t.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (t != "")
    return F.coalesce(out.when(valid, _folded(F.split(t, ""), roman, ("sum", "last"), lambda s: s["sum"])), F.lit(-1).cast("long"))
