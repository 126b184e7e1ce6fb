"""Dictionary segmentation against all paths; fine cuts, frequencies of compounds, and questions in scripts without spaces."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import fulltext, segmentation
from cairnflow.shared import scratch_path

WORDS = [("北京", 500, "ns"), ("大学", 800, "n"), ("北京大学", 300, "nt"), ("大学生", 400, "n"), ("学生", 900, "n"), ("生活", 700, "v"), ("京大", 5, "x"), ("活", 60, "v"), ("学", 40, "n"), ("我", 3000, "r"), ("我", 1, "z"), ("研究", 200, "v"), ("研究生", 150, "n"), ("生命", 180, "n"), ("命", 90, "n"), ("起源", 120, "n")]
RUNS = ["北京大学生活", "我", "研究生命起源", "大学生活", "未知词", "学生学生学生", "京大北京大学生", "一丁"]


@pytest.fixture(scope="module")
def known(spark):
    return segmentation.dictionary(spark.createDataFrame(WORDS, "word string, freq long, tag string")).cache()


def freqs():
    out = {}
    for w, n, _ in WORDS:
        out[w] = out.get(w, 0) + n
    return out


def plain_path(run):
    freq, best = freqs(), None
    total = math.log(sum(freq.values()))
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        words, start = [], 0
        for i, c in enumerate([*cuts, True], 1):
            if c:
                words.append(run[start:i])
                start = i
        if all(len(w) == 1 or w in freq for w in words):
            key = (round(sum(math.log(freq.get(w, 1)) - total for w in words), 9), [len(w) for w in words])
            best = max(best, (key, words)) if best else (key, words)
    return best[1]


def plain_fine(words):
    freq, out = freqs(), []
    for w in words:
        for size in (2, 3):
            if len(w) > size:
                out += [w[i : i + size] for i in range(len(w) - size + 1) if w[i : i + size] in freq]
        out.append(w)
    return out


def test_paths_and_fine_cuts(spark, known):
    df = spark.createDataFrame([(r,) for r in RUNS], "run string")
    got = {r.run: (r.words, r.fine) for r in segmentation.segmented(df, known).collect()}
    assert got == {r: (plain_path(r), plain_fine(plain_path(r))) for r in RUNS}
    assert got["北京大学生活"][0] in (["北京大学", "生活"], ["北京", "大学生", "活"])


def test_tokenized(spark, known):
    rows = [(1, "我 读 Ｓpark 4.1，研究生命起源 GPU4北京"), (2, None), (3, ""), (4, "naïve x_1"), (5, "北京大学生活")]
    got = {r.id: r.tokens for r in segmentation.tokenized(spark.createDataFrame(rows, "id long, text string"), known, "id", "text").collect()}
    assert got[1] == ["我", "读", "spark", "4", "1", *plain_path("研究生命起源"), "gpu4", "北京"]
    assert got[4] == ["naïve", "x_1"] and set(got) == {1, 4, 5}
    assert segmentation.tokenized(spark.createDataFrame([], "id long, text string"), known, "id", "text").count() == 0


def test_frequencies_and_tags(spark, known):
    terms = ["北京", "我", "京大", "42", "spark", "北京 大学", "学生生活", "未知词语", "é"]
    got = {r.term: r for r in segmentation.with_frequency(spark.createDataFrame([(t,) for t in terms], "term string"), known).collect()}
    assert {t: got[t].freq for t in terms} == {"北京": 500, "我": 3001, "京大": 10, "42": 3, "spark": 300, "北京 大学": pytest.approx(500 / 6), "学生生活": pytest.approx(700 / 6), "未知词语": 10, "é": 10}
    assert {t: got[t].tag for t in terms} == {"北京": "ns", "我": "r", "京大": "x", "42": "m", "spark": "eng", "北京 大学": "ns", "学生生活": "n", "未知词语": "x", "é": "x"}
    idf = lambda s: math.log10(10 + (10_000_000 - s + 0.5) / (s + 0.5))
    assert got["北京"].weight == pytest.approx(3 * idf(500)) and got["我"].weight == pytest.approx(0.3 * idf(3001)) and got["42"].weight == pytest.approx(2 * idf(3))


def test_spaced_clauses_and_search(spark, known):
    asked = spark.createDataFrame([(1, "北京大学 研究GPU"), (2, None)], "query_id long, text string")
    synonyms = spark.createDataFrame([("北京大学", "京大"), ("研究", "学")], "term string, synonym string")
    rows = segmentation.spaced_clauses(asked, known, "query_id", "text", synonyms).collect()
    assert len({(r.query_id, r.clause, r.alt) for r in rows}) == len(rows) and {r.query_id for r in rows} == {1}
    first = sorted((tuple(r.words), r.slop, round(r.weight, 6)) for r in rows if r.clause == 0)
    # one word, its fine cuts as phrase and loose phrase, its synonym as a word, all five times; the synonym of the whole part
    assert first == sorted([(("北京大学",), 0, 5.0), (("北京", "京大", "大学", "北京大学"), 0, 5.0), (("北京", "京大", "大学", "北京大学"), 2, 2.5), (("京大",), 0, 1.0), (("京大",), 0, 0.7)])
    second = sorted((tuple(r.words), r.slop, round(r.weight, 6)) for r in rows if r.clause == 1)
    third = {(tuple(r.words), r.slop): r.weight for r in rows if r.clause == 2}
    assert second == [(("学",), 0, 0.7), (("学",), 0, 1.0), (("研究",), 0, 5.0)]
    assert third == {(("gpu",), 0): pytest.approx(1)}
    docs = spark.createDataFrame([(1, "北京大学 在 北京"), (2, "研究 学"), (3, "京大 gpu"), (4, "x")], "id long, text string")
    path = scratch_path(spark, "t")
    fulltext.write_index(docs, {"content_ltks": F.split("text", " ")}, "id", path, buckets=2)
    clauses = spark.createDataFrame(rows, "query_id long, clause int, alt int, words array<string>, slop int, weight double")
    hits = {r.id: r for r in fulltext.search(fulltext.open_index(spark, path), clauses, min_match=0.6).collect()}
    assert {i: h.n_matched for i, h in hits.items()} == {1: 1, 2: 1, 3: 2}
