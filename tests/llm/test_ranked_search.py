"""Ranked lexical search: against a plain scorer, SQL, and small blocks and slices."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import oracle
from cairnflow.llm import ranked_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    docs = [(i, Counter(plain_terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if some else None, -s) for r, (s, some, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(n=150):
    rnd = random.Random(8)
    words = ["the", "The", "Éa", "éa", "a1", "42", "中文", "x_y", "don't", " ", "ÀB", "tail", "🙂", "q\x00r", "common"] + [f"w{k}" for k in range(60)]
    text = lambda k: rnd.choice([" ", "\n", "-"]).join(rnd.choice(words) for _ in range(k))
    docs = [(k, text(rnd.randint(0, 60))) for k in range(n)] + [(900 + k, "copy of the common w1 w2") for k in range(40)]
    docs += [(None, "the w1 tail"), (7, None), (8, ""), (9, "..."), (3, "same id"), (3, "w5 w5 w5"), (500, "w7 the " * 30_000)]
    items = [(k, text(rnd.randint(1, 30))) for k in range(12)] + [(50, ""), (51, None), (52, "..."), (53, "nowhere"), (54, "w1 w1 W1"), (55, "w1"), (None, "w2")]
    return docs, items


@pytest.mark.parametrize("slice_,block", [(1 << 20, 10_000), (50, 3)])
def test_against_plain_scores(spark, monkeypatch, slice_, block):
    monkeypatch.setattr(ranked_search, "SLICE", slice_)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    docs, items = made()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    it = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = ranked_search.ranked(df, it)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_radix_order():
    rnd = np.random.default_rng(2)
    for bits in (1, 16, 17, 40, 63):
        keys = rnd.integers(0, 1 << bits, 5000, dtype=np.uint64)
        assert ranked_search.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert len(ranked_search.radix_order(np.array([], np.uint64))) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "doc_id long, item_id long, text string")
    for docs, items in ((none, some), (some, none), (none, none)):
        assert ranked_search.ranked(docs, items).collect() == []
    assert [tuple(r) for r in ranked_search.ranked(some, some).collect()] == plain([(1, "a b")], [(1, "a b")])


def test_query(spark, sf_dir):
    assert oracle.compare(spark, sf_dir, "op13", ranked_search.op13, ranked_search.ORACLE_OP13) is None
