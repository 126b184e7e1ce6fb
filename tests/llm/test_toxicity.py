"""Toxicity: held-out accuracy on planted words, defined results."""

import random
import zlib

import numpy as np

from cairnflow.llm import toxicity


def make(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    bad = ["dreadful", "vile", "rotten"]
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 120))]
        y = int(rnd.random() < 0.15)
        for _ in range(y * rnd.randrange(1, 4)):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(bad).title() + ",")
        rows.append((k, " ".join(words), "x"))
        labels.append((k, 1, y))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, y) for k, _, y in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = make(spark)
    weights = toxicity.fit(docs, labels)
    assert np.count_nonzero(weights) < 20_000
    got = toxicity.score(docs, weights).collect()
    test = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hit = [(r.score >= 0.7) == bool(truth[r.doc_id]) for r in test]
    assert len(test) > 800 and sum(hit) / len(hit) > 0.98


def test_against_plain_ftrl():
    """The update rule written out for one coordinate at a time."""
    rnd = np.random.default_rng(2)
    rows = [np.unique(np.append(0, rnd.integers(1, 40, rnd.integers(1, 12)))) for _ in range(200)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in zip(rows, labels):
            p = 1 / (1 + np.exp(-sum(weight(i) for i in x.tolist())))
            for i, w in [(i, weight(i)) for i in x.tolist()]:
                sigma = ((n.get(i, 0.0) + (p - y) ** 2) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + (p - y) - sigma * w
                n[i] = n.get(i, 0.0) + (p - y) ** 2
    at, w = toxicity.ftrl(rows, labels, epochs=3)
    want = {i: weight(i) for i in z if weight(i)}
    assert set(at.tolist()) == set(want) and len(want) > 1
    assert np.allclose(w, [want[i] for i in at.tolist()])


def test_features():
    """A feature each for words, pairs, skip-pairs and stems; equal stems share theirs."""
    assert len(np.unique(toxicity.hashed("alpha beta gamma"))) == 1 + 3 + 2 + 1 + 9
    a, b = set(toxicity.hashed("running").tolist()), set(toxicity.hashed("runner").tolist())
    assert len(a & b) == 1 + 2
    few, many = toxicity.Words(most=2), " ".join(map(str, range(10_000)))
    assert (toxicity.Words().of(many) == toxicity._words.of(many)).all() and len(np.unique(toxicity._words.of(many)[:, 0])) == 10_000
    assert all((few.of(t) == toxicity._words.of(t)).all() for t in ["a b c d", "c d e", "a b", "x " * 50] * 2)


def test_conflicting_labels_and_copies(spark):
    docs, labels, _ = make(spark, 600)
    both = labels.unionByName(labels.selectExpr("doc_id", "quality", "0 as toxic"))
    assert (toxicity.fit(docs, both) == toxicity.fit(docs, labels)).all()  # the largest label counts
    assert (toxicity.fit(docs.unionByName(docs), labels) == toxicity.fit(docs, labels)).all()
    assert not toxicity.fit(docs.limit(0), labels).any()
    clash = docs.selectExpr("*", "1 as _id", "2 as _text", "3 as _label", "4 as _order", "5 as _shard")
    assert (toxicity.fit(clash, labels) == toxicity.fit(docs, labels)).all()


def test_training_never_sees_held_out_labels(spark):
    docs, labels, _ = make(spark, 400)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert (toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)).all()


def test_defined_results(spark):
    docs, labels, _ = make(spark, 300)
    odd = spark.createDataFrame([(None, "vile"), (1, None), (1, None), (2, ""), (3, "w1 " * 50_000)], "doc_id long, text string")
    weights = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)), max_labelled=100)
    got = toxicity.score(odd, weights).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(odd.limit(0), weights).count() == 0
    got = odd.select(toxicity.held_out(odd.doc_id).alias("h"), "doc_id").collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
