"""Text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01 to U+FF5E and the ideographic space, and what they fold to.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Characters with a meaning in the query language.
QUERY_SPECIALS = r'([:\{\}/\[\]\-\*"\(\)\|\+~\^])'


def fold_width(text: Column) -> Column:
    """Full-width characters as their half-width forms."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores after width folding. Text without spaces between words needs a
    dictionary; see ``operators.segmentation``."""
    return F.regexp_extract_all(F.lower(fold_width(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def han_share(text: Column) -> Column:
    """Share of characters in U+4E00 to U+9FFF; null for empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^一-\x{9FFF}]", "")) / n)


def is_chinese(text: Column) -> Column:
    return F.coalesce(han_share(text) > 0.2, F.lit(False))


def is_number(text: Column) -> Column:
    return text.rlike(r"^[0-9.,%/-]+$")


def english_share(text: Column) -> Column:
    """Share of characters that ordinary English text has; null for empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^`a-zA-Z0-9\s.,':;/\"?<>!()\-]", "")) / n)


def token_count(text: Column) -> Column:
    """Estimated model tokens: 1.5 for a Han character, a quarter for any other."""
    han = F.length(F.regexp_replace(text, r"[^一-\x{9FFF}]", ""))
    return F.floor(han * 1.5 + (F.length(text) - han) / 4).cast("int")


def truncated(text: Column, max_tokens: int) -> Column:
    return F.substring(text, 1, 4 * max_tokens)


def without_table_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def title_of(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[a-zA-Z]+$", "")


def chunk_id(name: Column, index: Column, text: Column, kind: Column | None = None) -> Column:
    """md5 of name, place and the first 50 characters. A kind salts the id, so that parents and children differ."""
    parts = [name, index.cast("string"), F.substring(text, 1, 50)]
    return F.md5(F.concat_ws("_", *parts, *([] if kind is None else [kind])))


def document_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 16)


def spaced_scripts(text: Column) -> Column:
    """A space wherever Latin letters and Han characters meet."""
    once = F.regexp_replace(text, r"([A-Za-z]+[0-9]*)([一-\x{9FFF}])", "$1 $2")
    return F.regexp_replace(once, r"([一-\x{9FFF}])([A-Za-z])", "$1 $2")


def escaped_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, QUERY_SPECIALS, r"\\$1"))


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def highlighted(text: Column, terms: list[str]) -> Column:
    """``terms`` set in <em> tags, whatever their case."""
    if not terms:
        return text
    words = "|".join(r"\Q" + t.replace(r"\E", "") + r"\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({words})", "<em>$1</em>")


def normal_folder(path: Column) -> Column:
    """One leading slash, none behind, backslashes turned."""
    p = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/")
    p = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(p, "^/+", "")), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def ancestors(path: Column) -> Column:
    """All prefixes of a normal folder path, itself included; "/" has itself only."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(n == 0, F.array(F.lit("/"))).otherwise(prefixes)


def kb_id(name: Column) -> Column:
    """Lower case, spaces and hyphens as underscores, nothing but [a-z0-9_]; null where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[ -]", "_"), "[^a-z0-9_]", "")
    return F.when(out != "", out)


#: White space, and characters that no font maps: private use, replacement, control, unassigned and lone surrogates.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_GARBLED = r"\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFFD}\x00-\x08\x0E-\x1B\x{80}-\x{84}\x{86}-\x{9F}"


def garbled_share(text: Column) -> Column:
    """Share of garbled characters among those that are no white space; null for blank text."""
    n = F.length(F.regexp_replace(text, f"[{_SPACE}]", ""))
    bad = F.regexp_count(text, F.lit(rf"[{_GARBLED}\p{{Cn}}\p{{Cs}}]"))
    return F.when(n > 0, bad / n)


def is_garbled(text: Column, threshold: float = 0.5) -> Column:
    """Whether a text holds a placeholder of an unmapped glyph, or garbled characters from ``threshold`` on."""
    return F.coalesce(text.rlike(r"\(cid\s*:\s*[0-9]+\s*\)") | (garbled_share(text) >= threshold), F.lit(False))


def is_bullet_like(text: Column) -> Column:
    """Starts like a number or a run of dots and so is no heading bullet."""
    return text.rlike(r"^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})")


def is_title_like(text: Column) -> Column:
    """Short enough and without sentence punctuation; an article heading always is."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    plain = (words <= 12) & ~((~text.contains(" ")) & (F.length(text) >= 32)) & ~text.rlike("[,;，。；！!]")
    return text.rlike("^第[零一二三四五六七八九十百0-9]+条") | plain


def is_caption(text: Column, layout: Column | None = None) -> Column:
    """A line that begins as captions do, or whose layout class says so."""
    begins = F.coalesce(F.trim(text).rlike("^[图表]+[ 0-9:：]{2,}"), F.lit(False))
    return begins if layout is None else begins | F.coalesce(layout.contains("caption"), F.lit(False))


#: Web addresses within a text. Fixed value.
URL = r"(?:https?://|www\.)[a-zA-Z0-9./?#&=_%+-]+"


def without_urls(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, URL, ""))


def without_urls_in(question: str) -> str:
    """``without_urls`` of one question, on the driver."""
    return re.sub(URL, "", question).strip()


def looks_like_title(line: str) -> bool:
    """``is_title_like`` of one string, for folds over lines."""
    plain = len(line.split()) <= 12 and (" " in line or len(line) < 32) and not re.search("[,;，。；！!]", line)
    return bool(re.match("第[零一二三四五六七八九十百0-9]+条", line)) or plain


def without_qa_prefix(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?i)^(问题|答案|回答|user|assistant|Q|A|Question|Answer|问|答)[\t:： ]+", "")


def position_tag(page: Column, x0: Column, x1: Column, top: Column, bottom: Column) -> Column:
    return F.format_string("@@%d\t%.1f\t%.1f\t%.1f\t%.1f##", page, x0, x1, top, bottom)


def position_of(tagged: Column) -> Column:
    """(page, x0, x1, top, bottom) of the first tag; null without one."""
    m = lambda k: F.regexp_extract(tagged, r"@@(\d+)\t([\d.]+)\t([\d.]+)\t([\d.]+)\t([\d.]+)##", k)
    fields = F.struct(m(1).cast("int").alias("page"), *[m(k).cast("double").alias(n) for k, n in ((2, "x0"), (3, "x1"), (4, "top"), (5, "bottom"))])
    return F.when(tagged.rlike(r"@@\d+\t[\d.]+\t[\d.]+\t[\d.]+\t[\d.]+##"), fields)


def without_tags(tagged: Column) -> Column:
    return F.regexp_replace(tagged, r"@@[\t0-9.-]+?##", "")


def fenced_json(text: Column) -> Column:
    """The body of a code fence, or the text itself, for ``from_json``."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(text), r"^\s+|\s+$", "")


def numbers_of(text: Column) -> Column:
    """Tab-separated numbers as an array."""
    return F.transform(F.split(text, "\t"), lambda x: x.try_cast("double"))
