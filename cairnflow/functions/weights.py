"""Term weights: inverse document frequency, kind of token, normalised to a sum of one."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Documents that the dictionary counts are out of; counts of numbers, of unknown Latin words and the least one.
TOTAL, NUMBER_FREQ, LATIN_FREQ, LEAST_FREQ = 10_000_000, 3, 300, 10

#: Words that questions are asked with and that say nothing. Fixed values.
STOP_WORDS = ["请问", "您", "你", "我", "他", "是", "的", "就", "有", "于", "及", "即", "在", "为", "最", "从", "以", "了", "将", "与", "吗", "吧", "中", "#", "什么", "怎么", "哪个", "哪些", "啥", "相关"]
#: A token that begins with one of these is no word. Fixed values.
MARKS = "~—\t @#%!<>,.?\\\":';{}[]_=()|,。?》•●○↓《;‘’:“”【¥ 】…￥!、·()×`&\\/「」"


def frequency(token: Column, known: Column | None = None) -> Column:
    """Dictionary frequency; where the dictionary has none, numbers and Latin words have fixed ones."""
    rest = F.when(token.rlike("^[a-z. -]+$"), F.lit(LATIN_FREQ)).otherwise(F.lit(LEAST_FREQ))
    if known is not None:
        rest = F.when(known > 0, F.greatest(known, F.lit(LEAST_FREQ))).otherwise(rest)
    return F.when(token.rlike("^[0-9. -]{2,}$"), F.lit(NUMBER_FREQ)).otherwise(rest)


def kind_weight(token: Column, classes: Column | None = None) -> Column:
    """Numbers 2, one or two letters 0.01; named classes by ``classes``, else 1."""
    rest = F.lit(1.0) if classes is None else F.coalesce(classes, F.lit(1.0))
    return F.when(token.rlike("^[0-9,.]{2,}$"), F.lit(2.0)).when(token.rlike("^[a-z]{1,2}$"), F.lit(0.01)).otherwise(rest)


def part_weight(token: Column, weights: Column | None = None) -> Column:
    """Part of speech: numbers 2, others by ``weights`` (of a dictionary's tags), else 1."""
    return F.when(token.rlike("^[0-9]+$"), F.lit(2.0)).otherwise(F.lit(1.0) if weights is None else F.coalesce(weights, F.lit(1.0)))


def idf(frequency: Column, total: Column | int = TOTAL) -> Column:
    n = F.lit(total) if isinstance(total, int) else total
    return F.log10(F.lit(10) + (n - frequency + 0.5) / (frequency + 0.5))


def raw_weight(token: Column) -> Column:
    return idf(frequency(token)) * kind_weight(token) * part_weight(token)


def tag_weight(tag: Column) -> Column:
    """Weight of a part-of-speech tag: pronouns, conjunctions and adverbs little, names of places and bodies most."""
    return F.when(tag.isin("r", "c", "d"), 0.3).when(tag.isin("ns", "nt"), 3.0).when((tag == "n") | tag.rlike("^[0-9-]+"), 2.0).otherwise(1.0)


def kept_tokens(tokens: Column, digits: bool = False, stop_words: bool = True) -> Column:
    """Tokens without stop words, single digits (unless ``digits``) and those that begin with a mark."""

    def kept(t: Column) -> Column:
        word = (t != "") & ~F.contains(F.lit(MARKS), F.substring(t, 1, 1))
        word = word & ~t.isin(STOP_WORDS) if stop_words else word
        return word if digits else word & ~t.rlike("^[0-9]$")

    return F.filter(tokens, kept)


def merged_terms(tokens: Column) -> Column:
    """Runs of short tokens (one character, or one or two digits and small letters; no stop words) as terms: up to four
    as one, of longer runs pairs from the front until less than five are left. A short first token joins a longer second one
    that doesn't begin with a Latin letter or digit. Runs are cut at the places of the other tokens, so a row takes time in proportion to
    its tokens."""
    none = F.array().cast("array<string>")
    short = lambda t: (F.length(t) == 1) | t.rlike("^[0-9a-z]{1,2}$")
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  x is made once

    def terms_of(run: Column) -> Column:
        pairs = F.when(F.size(run) < 5, 0).otherwise(F.floor((F.size(run) - 3) / 2)).cast("int")
        numbers = F.when(pairs > 0, F.sequence(F.lit(1), pairs)).otherwise(F.array().cast("array<int>"))
        front = F.transform(numbers, lambda i: F.array_join(F.slice(run, 2 * i - 1, F.lit(2)), " "))
        return F.concat(front, F.array(F.array_join(F.slice(run, 2 * pairs + 1, F.size(run)), " ")))

    def fold(a: Column, begin: Column) -> Column:
        """From the place ``begin`` on: the run before each token that stands alone, and that token; the end counts as one."""
        alone = lambda i: (i == F.size(a)) | ~short(F.get(a, i)) | F.get(a, i).isin(STOP_WORDS)

        def parts(ends: Column) -> Column:
            def part(end: Column, k: Column) -> Column:
                start = F.when(k == 0, begin).otherwise(F.get(ends, k - 1) + 1)
                own = F.when(end < F.size(a), F.array(F.get(a, end))).otherwise(none)
                run = once(F.slice(a, start + 1, end - start), terms_of)
                return F.when(start == end, own).otherwise(F.concat(run, own))

            return F.flatten(F.transform(ends, part))

        return once(F.filter(F.sequence(begin, F.size(a)), alone), parts)

    def whole(a: Column) -> Column:
        first, second = F.get(a, F.lit(0)), F.get(a, F.lit(1))
        head = F.coalesce(short(first) & (F.length(second) > 1) & ~second.rlike("^[0-9a-zA-Z]"), F.lit(False))
        out = F.when(head, F.concat(F.array(F.concat_ws(" ", first, second)), fold(a, F.lit(2)))).otherwise(fold(a, F.lit(0)))
        return F.filter(out, lambda t: t != "")

    return once(tokens, whole)


def joined_latin(text: Column, function_words: list[str] | None = None) -> Column:
    """Parts of a text between white space, neighbours joined where both end in a Latin letter and neither is a function
    word."""
    func = lambda t: t.isin(function_words) if function_words else F.lit(False)

    def step(out: Column, t: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joins = F.coalesce(last.rlike("[a-zA-Z]$") & t.rlike("[a-zA-Z]$") & ~func(last) & ~func(t), F.lit(False))
        head = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.concat_ws(" ", last, t)))).otherwise(F.concat(out, F.array(t)))

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def query_weights(tokens: list[str]) -> list[tuple[str, float]]:
    """Weights of the few tokens of one query, on the driver."""
    raw = []
    for t in tokens:
        freq = NUMBER_FREQ if re.match("[0-9. -]{2,}$", t) else LATIN_FREQ if re.match("[a-z. -]+$", t) else LEAST_FREQ
        kind = 2.0 if re.match("[0-9,.]{2,}$", t) else 0.01 if re.match("[a-z]{1,2}$", t) else 1.0
        part = 2.0 if re.fullmatch("[0-9]+", t) else 1.0
        raw.append(kind * part * math.log10(10 + (TOTAL - freq + 0.5) / (freq + 0.5)))
    total = sum(raw)
    return [(t, w / total if total else 1 / len(tokens)) for t, w in zip(tokens, raw, strict=True)]


def query_terms(tokens: list[str]) -> dict[str, float]:
    """Words at 0.4 of their weights, neighbours joined at 0.6 of the larger."""
    out: dict[str, float] = {}
    weights = query_weights(tokens)
    for k, (t, w) in enumerate(weights):
        out[t] = out.get(t, 0.0) + 0.4 * w
        if k + 1 < len(weights):
            t2, w2 = weights[k + 1]
            out[t + t2] = out.get(t + t2, 0.0) + 0.6 * max(w, w2)
    return out


def token_similarity(tokens: Column, terms: dict[str, float]) -> Column:
    """Share of the query's weight whose words or joined neighbours the document has. A term is there as a token or as two
    tokens in a row that spell it; both are searched in one line of the tokens, set apart by spaces."""

    def share(line: Column) -> Column:
        hit = F.lit(1e-9)
        for k, w in terms.items():
            found = line.contains(f" {k} ")
            for cut in range(1, len(k)):
                found = found | line.contains(f" {k[:cut]} {k[cut:]} ")
            hit = hit + F.when(found, F.lit(w)).otherwise(0.0)
        return hit / F.lit(1e-9 + sum(terms.values()))

    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.element_at(F.transform(F.array(line), share), 1)  # the line is made once


def scripted_similarity(df: Column, n_docs: Column, boost: float = 1.0) -> Column:
    """Score of a term that a document has, however often."""
    return F.lit(boost) * F.log1p((n_docs - df + 0.5) / (df + 0.5)) / F.log1p((n_docs - 0.5) / 1.5)
