"""Benchmark search against brute force over all spans."""

import random
import re

import numpy as np
import pytest

from cairnflow.llm import decontaminate as dc


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_best(item, text, most):
    """(distance, end, words, start) of the nearest span, by all spans."""
    best = (most + 1, 0, 0, 0)
    for start in range(len(text)):
        for end in range(start + 1, min(len(text), start + len(item) + most) + 1):
            best = min(best, (plain_edits(text[start:end], item), end, end - start, start))
    return best


def test_best_spans():
    rnd = np.random.default_rng(1)
    items, texts = rnd.integers(1, 4, (40, 7)).astype(np.uint64), rnd.integers(1, 4, (40, 15)).astype(np.uint64)
    texts[:20, 11:] = 0
    for most in (1, 3):
        distance, start, end = dc.best_spans(items, texts, most)
        for k in range(40):
            want = plain_best(items[k].tolist(), [x for x in texts[k].tolist() if x], most)
            if want[0] <= most:
                assert (distance[k], end[k], start[k]) == (want[0], want[1], want[3])
            else:
                assert distance[k] > most


def planted(seed=2):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, say(rnd.choice([6, 10, 25, 40]))) for k in range(12)]
    docs, exact = [], []
    for d in range(120):
        i, words = rnd.choice(items)
        words = list(words)
        for _ in range(rnd.randrange(0, dc.edits_allowed(len(words)) + 2)):
            at = rnd.randrange(len(words))
            kind = rnd.randrange(3)
            if kind == 0:
                words[at] = "new"
            elif kind == 1:
                del words[at]
            else:
                words.insert(at, "more")
        docs.append((d, " ".join(say(rnd.randrange(0, 90)) + words + say(rnd.randrange(0, 90)))))
        exact.append(i)
    return docs, items


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        for i, x in items:
            n = len(x)
            k = dc.edits_allowed(n)
            for s in range(len(w) - n + k + 1):
                near = w[s : s + n + k]
                if sum(y in x for y in near) < n - k or near[0] not in x:
                    continue  # the nearest span begins with a word of the item and holds n - k of them
                for e in range(s + n - k, min(s + n + k, len(w)) + 1):
                    c = plain_edits(w[s:e], x)
                    if c <= k:
                        out[d, i] = min(out.get((d, i), (99,)), (c, e, e - s, s))
    return {key: (v[0], v[3], v[2]) for key, v in out.items()}


def test_against_brute_force(spark):
    docs, items = planted()
    docs += [(500, None), (501, ""), (502, "x"), (None, " ".join(items[0][1])), (503, docs[0][1]), (503, docs[0][1])]
    docs += [(504, "lead " * 20_000 + ", ".join(items[1][1]).upper()), (505, "here is One, of TWO: such things")]
    df = spark.createDataFrame([(d, t, 1, "k", 5, 6) for d, t in docs], "doc_id long, text string, start int, key string, _id int, _digest int")
    rows = [(i, " ".join(x)) for i, x in items] + [(90, "one of two"), (93, "such"), (94, "one two"), (91, None), (92, ""), (95, "such"), (95, "such"), (None, "such")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    want = brute([x for x in docs if x[0] != 504], items)
    for words, blocks in ((50_000, 20), (30, 2)):
        got = {(r.doc_id, r.item_id): (r.distance, r.start, r.n_words) for r in dc.find_items(df, bench, block_words=words, pass_blocks=blocks).collect()}
        assert got.pop((504, 1)) == (0, 20_000, len(items[1][1]))
        assert [got.pop((505, i)) for i in (90, 93, 95, None)] == [(0, 2, 3), *[(0, 5, 1)] * 3]
        assert set(got) <= set(want)
        assert len(got) >= 0.97 * len(want)
        assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
        assert {k for k, v in want.items() if v[0] == 0} <= set(got)
    got = {(r.doc_id, r.item_id) for r in dc.find_items(df, bench).collect()}
    clean = dc.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert dc.drop_contaminated(df, bench, broadcast_rows=0).count() == clean.count()
    assert dc.find_items(df.limit(0), bench).count() == 0
    assert dc.find_items(df, bench.limit(0)).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        dc.find_items(df, bench, similarity=0.4)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.9])
def test_other_similarities(spark, similarity):
    docs, items = planted(4)
    items += [(50, ["w1", "w2", "w3", "w4", "w5"])]
    df = spark.createDataFrame(docs[:40], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = dc.find_items(df, bench, similarity=similarity).collect()
    texts = dict(docs)
    for r in got:
        words = re.findall(r"\w+", texts[r.doc_id].lower())[r.start : r.start + r.n_words]
        item = dict(items)[r.item_id]
        assert plain_edits(words, item) == r.distance <= dc.edits_allowed(len(item), similarity)
    assert got


@pytest.mark.parametrize("n", [10, 15, 20, 40, 59, 100, 150, 200, 300, 400])
@pytest.mark.parametrize("kind", ["mixed", "replaced", "shifted"])
def test_recall_at_the_limit(n, kind):
    rnd = np.random.default_rng((3, n))
    k, fresh = dc.edits_allowed(n), lambda m: rnd.integers(1, 1 << 63, m).astype(np.uint64)
    item = fresh(n)
    block, hits, trials = dc.Block([(0, item)], dc.RECALL, dc.SIMILARITY), 0, 60
    for _ in range(trials):
        if kind == "shifted":
            text = np.concatenate([fresh(k), item[: n - k]])
        else:
            text = dc.edited(item, k, rnd, 3 if kind == "mixed" else 1)[0]
        text = np.concatenate([fresh(30), text, fresh(30)])
        hits += len(block.found(text, np.array([0, len(text)])))
    assert hits >= 0.95 * trials


@pytest.mark.parametrize("n", [10, 25, 40, 59, 100, 150, 200, 300, 400])
def test_recall_with_edits_evenly_spread(n):
    """Every segment holds edits, of one kind or mixed."""
    rnd = np.random.default_rng((4, n))
    k, fresh = dc.edits_allowed(n), lambda m: rnd.integers(1, 1 << 63, m).astype(np.uint64)
    item = fresh(n)
    block, trials = dc.Block([(0, item)], dc.RECALL, dc.SIMILARITY), 60
    for only in (0, 1, 2, None):
        hits = 0
        for _ in range(trials):
            places = [int((i + rnd.random()) * n / k) for i in range(k)]
            text = np.concatenate([fresh(30), dc.edited(item, k, rnd, only=only, places=places)[0], fresh(30)])
            hits += len(block.found(text, np.array([0, len(text)])))
        assert hits >= 0.95 * trials, (only, hits)


def test_recall_out_of_reach():
    with pytest.raises(ValueError, match="aren't found"):
        dc.repeats_for(5, recall=1.1, trials=20)


def test_thinning_loses_no_window():
    rnd = np.random.default_rng(5)
    vocab = rnd.integers(1, 1 << 62, 30).astype(np.uint64)
    items = [(k, rnd.choice(vocab, n)) for k, n in enumerate([1, 3, 5, 6, 9, 10, 14])]
    block = dc.Block(items, 0.9, dc.SIMILARITY)
    parts = []
    for _ in range(60):
        codes = items[rnd.integers(len(items))][1]
        parts += [rnd.choice(vocab, rnd.integers(0, 9)), dc.edited(codes, dc.edits_allowed(len(codes)), rnd)[0]]
    codes = np.concatenate(parts)
    found = {(n, s) for n, _, starts in block.windows(codes, np.full(len(codes), len(codes))) for s in starts.tolist()}
    want = set()
    for _, x in items:
        n = len(x)
        for s in range(len(codes) - n + 1):
            if plain_edits(codes[s : s + n].tolist(), x.tolist()) <= dc.edits_allowed(n):
                want.add((n, s))
    assert want and want <= found
