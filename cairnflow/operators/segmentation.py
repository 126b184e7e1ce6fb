"""Segmentation of text without spaces by a dictionary table (word, freq, tag), as joins and folds within rows.

Text is cut into runs: Han runs, and runs of other letters, digits and underscores. Each distinct Han run becomes a lattice: its pieces of
up to the dictionary's longest word are joined with the dictionary, and the path of greatest probability is taken, where a single character
that is no word counts once. Of equal paths the one with the longest first word wins. The dictionary is a table like any
other, so its size is bounded by nothing but the cluster; runs are cut once however many documents hold them.

Words of a dictionary without frequency count once; a word given twice has the sum of its frequencies and the tag of its most frequent
row. There is no model for unknown words: their characters come one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, weights
from ..shared import checked_broadcast, written

HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"
#: The share of its rarest part that a compound's frequency is taken for, and the shortest compound.
COMPOUND_PARTS, SHORTEST_COMPOUND = 6, 4


def runs(column: Column) -> Column:
    """Runs of one kind in order, lower-case and width-folded: Han characters, or other letters, digits and underscores."""
    folded = F.lower(text.fold_width(F.coalesce(column, F.lit(""))))
    other = r"(?:(?![\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])[\p{L}\p{N}_])+"
    return F.regexp_extract_all(folded, F.lit(f"({HAN}|{other})"), 1)


def is_han(token: Column) -> Column:
    return token.rlike(f"^{HAN}$")


def dictionary(words: DataFrame) -> DataFrame:
    """(word, freq, tag) with one row a word."""
    rows = words.where("word <> ''").groupBy("word")
    return rows.agg(F.greatest(F.coalesce(F.sum("freq"), F.lit(0)), F.lit(1)).cast("long").alias("freq"), F.max_by("tag", F.struct("freq", "tag")).alias("tag"))


def _lattice(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """(run, edges): for each place from the last to the first the words that begin there, as (len, freq; null: no word)."""
    longest = known.agg(F.max(F.length("word"))).first()[0] or 1
    n = F.length("run")
    places = distinct.select("run", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("i")))
    pieces = places.select("run", "i", F.explode(sizes).alias("len")).withColumn("word", F.substring("run", F.col("i") + 1, F.col("len")))
    found = pieces.join(checked_broadcast(known.select("word", "freq")), "word", "left").where("len = 1 or freq is not null")
    at = found.groupBy("run", "i").agg(F.sort_array(F.collect_list(F.struct("len", "freq"))).alias("e"))
    return at.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("o"), "e"))), lambda x: x["e"]).alias("edges"))


def segmented(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """(run, words, fine): the best path of each distinct Han run, and its fine cuts: the words of two characters, then of three, inside
    each longer word, before the word itself. ``known`` comes from ``dictionary``."""
    total = known.agg(F.coalesce(F.sum("freq"), F.lit(1)).alias("total"))  # one row
    rows = _lattice(distinct, known).crossJoin(F.broadcast(total))
    log_total = F.log(F.col("total").cast("double"))
    start = F.array().cast("array<struct<score:double,len:int>>")

    def step(best: Column, edges: Column) -> Column:
        """``best`` has the paths from the places behind, nearest first."""
        of = lambda e: F.struct((F.log(F.coalesce(e["freq"], F.lit(1)).cast("double")) - log_total + F.coalesce(F.get(best, e["len"] - 1)["score"], F.lit(0.0))).alias("score"), e["len"].alias("len"))
        return F.concat(F.array(F.array_max(F.transform(edges, of))), best)

    rows = rows.withColumn("best", F.aggregate("edges", start, step))
    walk = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,len:int>>").alias("out"))

    def follow(state: Column, i: Column) -> Column:
        size = F.get("best", i)["len"]
        here = state["next"] == i
        return F.struct(F.when(here, i + size).otherwise(state["next"]).alias("next"), F.when(here, F.concat(state["out"], F.array(F.struct(i.alias("at"), size.alias("len"))))).otherwise(state["out"]).alias("out"))

    rows = rows.withColumn("path", F.aggregate(F.sequence(F.lit(0), F.length("run") - 1), walk, follow)["out"])
    piece = lambda at, size: F.substring("run", at + 1, size)

    def inner(word: Column, size: int) -> Column:
        places = F.sequence(word["at"], word["at"] + word["len"] - size)
        held = F.filter(places, lambda i: F.exists(F.get("edges", F.length("run") - 1 - i), lambda e: (e["len"] == size) & e["freq"].isNotNull()))
        none = F.array().cast("array<string>")
        return F.when(word["len"] > size, F.transform(held, lambda i: piece(i, F.lit(size)))).otherwise(none)

    fine = F.flatten(F.transform("path", lambda w: F.concat(inner(w, 2), inner(w, 3), F.array(piece(w["at"], w["len"])))))
    return rows.select("run", F.transform("path", lambda w: piece(w["at"], w["len"])).alias("words"), fine.alias("fine"))


def tokenized(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, fine): the tokens of each text in order, and the fine ones; rows of one id are one text. Texts without a token
    are left out."""
    parts = docs.select(F.col(id_col), F.posexplode(runs(F.col(text_col))).alias("pos", "run"))
    parts = written(parts, "runs")
    cut = written(segmented(parts.where(is_han(F.col("run"))).select("run").distinct(), known), "segmented")
    both = parts.join(checked_broadcast(cut), "run", "left")
    own = F.array("run")
    item = F.struct("pos", F.coalesce("words", own).alias("words"), F.coalesce("fine", own).alias("fine"))
    items = both.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("items"))
    flat = lambda c: F.flatten(F.transform("items", lambda x: x[c]))
    return items.select(id_col, flat("words").alias("tokens"), flat("fine").alias("fine"))


def with_frequency(terms: DataFrame, known: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` with ``freq``, ``tag`` and ``weight``. A number or an unknown Latin word has a fixed frequency; an unknown compound (of
    four characters and more) a sixth of its rarest part of two characters and more, if it has two such parts; at least
    ten. The tag is that of the first word of the term: ``eng`` and ``m`` for Latin words and numbers, ``x`` for unknown ones."""
    distinct = written(terms.select(F.col(term_col).alias("term")).distinct(), "terms")
    parts = distinct.select("term", F.posexplode(runs(F.col("term"))).alias("pos", "run"))
    cut = segmented(parts.where(is_han(F.col("run"))).select("run").distinct(), known)
    words = parts.join(cut, "run", "left").select("term", "pos", F.posexplode(F.coalesce("fine", F.array("run"))).alias("k", "part"), F.get("words", F.lit(0)).alias("first"))
    looked = words.join(known.withColumnRenamed("word", "part").select("part", "freq"), "part", "left")
    parts_of = looked.where(F.length("part") > 1).groupBy("term").agg(F.count("*").alias("n"), F.min(weights.frequency(F.col("part"), F.col("freq"))).alias("rarest"))
    head = words.where("pos = 0 and k = 0").select("term", F.coalesce("first", "part").alias("word"))
    tags = head.join(known.select("word", "tag"), "word", "left")
    kind = F.when(F.col("word").rlike("^[0-9]+$"), "m").when(F.col("word").rlike("^[a-z0-9_]+$"), "eng").otherwise("x")
    tags = tags.select("term", F.coalesce("tag", kind).alias("tag"))
    out = distinct.join(known.select(F.col("word").alias("term"), F.col("freq").alias("own")), "term", "left").join(parts_of, "term", "left").join(tags, "term", "left")
    t = F.col("term")
    compound = F.col("own").isNull() & (F.length("term") >= SHORTEST_COMPOUND) & ~t.rlike("^[a-z. -]+$") & (F.col("n") > 1)
    freq = F.when(t.rlike("^[0-9. -]{2,}$"), F.lit(float(weights.NUMBER_FREQ))).when(compound, F.greatest(F.col("rarest") / COMPOUND_PARTS, F.lit(float(weights.LEAST_FREQ)))).otherwise(weights.frequency(t, F.col("own")).cast("double"))
    tag = F.coalesce("tag", F.lit(""))
    weight = weights.idf(F.col("freq")) * weights.kind_weight(t) * weights.tag_weight(tag)
    out = out.select("term", freq.alias("freq"), tag.alias("tag")).withColumn("weight", weight)
    return terms.join(out.withColumnRenamed("term", term_col), term_col, "left")


def spaced_clauses(questions: DataFrame, known: DataFrame, id_col: str, text_col: str, synonyms: DataFrame | None = None) -> DataFrame:
    """Clauses of questions in scripts without spaces, for ``fulltext.search``: a clause for each part between white space. Its alternatives are
    each word at its share of the part's weight, the word's fine cuts (from two of them on) as a phrase at as much and as a loose
    phrase at half of it, ``synonyms`` (term, synonym) of a word at a fifth, and a loose phrase of all words at 1.5 where there are
    several. Where the part as a whole has synonyms, these count 0.7 and the rest five times."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(text.spaced_scripts(F.lower(text.fold_width(F.coalesce(F.col(text_col), F.lit(""))))), r"\s+"), lambda t: t != "")
    asked = questions.select(F.col(id_col).alias("query_id"), F.posexplode(parts).alias("clause", "part"))
    cut = tokenized(asked.select("part").distinct(), known, "part", "part")
    asked = written(asked.join(cut, "part"), "asked")
    words = asked.select("query_id", "clause", "part", F.posexplode(weights.kept_tokens(F.col("tokens"), digits=True)).alias("k", "term"))
    weighted = with_frequency(words, known)
    whole = F.sum("weight").over(Window.partitionBy("query_id", "clause"))
    weighted = weighted.withColumn("weight", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0))
    fine = tokenized(weighted.where(F.length("term") >= 3).select("term").distinct(), known, "term", "term").select("term", F.filter("fine", lambda t: F.length(t) > 1).alias("fine"))
    weighted = written(weighted.join(fine, "term", "left"), "weighted")
    key = ["query_id", "clause"]
    row = lambda df, kind, words_, slop, weight: df.select(*key, F.lit(kind).alias("kind"), "k", words_.alias("words"), F.lit(slop).alias("slop"), weight.alias("weight"))
    w, cuts = F.col("weight"), weighted.where(F.size("fine") > 1)
    out = row(weighted, 0, F.array("term"), 0, w).unionByName(row(cuts, 1, F.col("fine"), 0, w)).unionByName(row(cuts, 2, F.col("fine"), 2, w / 2))
    several = asked.where(F.size("tokens") > 1).withColumn("k", F.lit(0))
    out = out.unionByName(row(several, 3, F.col("tokens"), 2, F.lit(1.5)))
    if synonyms is not None:
        also = tokenized(synonyms.select("synonym").distinct(), known, "synonym", "synonym").select("synonym", F.col("tokens").alias("other"))
        also = synonyms.distinct().join(also, "synonym").where(F.size("other") > 0)
        out = out.unionByName(row(weighted.join(also, "term"), 4, F.col("other"), 0, w / 5))
        of_whole = asked.join(also.withColumnRenamed("term", "part"), "part").withColumn("k", F.lit(0))
        raised = of_whole.select(*key).distinct().withColumn("times", F.lit(5.0))
        out = out.join(raised, key, "left").withColumn("weight", F.col("weight") * F.coalesce("times", F.lit(1.0))).drop("times")
        out = out.unionByName(row(of_whole, 5, F.col("other"), 0, F.lit(0.7)))
    alt = F.row_number().over(Window.partitionBy(*key).orderBy("kind", "k", F.array_join("words", " "))) - 1
    return out.select(*key, alt.alias("alt"), F.coalesce("words", none).alias("words"), "slop", "weight")
