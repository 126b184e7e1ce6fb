"""Near copies at a similarity of 0.8 against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from cairnflow.llm import near_copies


def say(rnd, n):
    return [f"u{rnd.randrange(5000)}" for _ in range(n)]


def changed(rnd, words, n):
    words = list(words)
    for k in rnd.sample(range(len(words)), n):
        words[k] = f"v{rnd.randrange(10**6)}"
    return words


def kept_of_all_pairs(rows):
    """Ids that stay, by comparing all pairs."""
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = sets[i] | sets[j]
            if not union or len(sets[i] & sets[j]) / len(union) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))


@pytest.mark.parametrize("max_bucket", [64, 3])
def test_near_copies(spark, max_bucket):
    rnd, texts = random.Random(5), [None, "", "one two", "one two", "One Two three"]
    for _ in range(12):
        base = say(rnd, rnd.choice([9, 12, 20, 40, 70, 100, 200, 400]))
        texts += [" ".join(changed(rnd, base, min(k, 1 + len(base) // 60 * k))) for k in range(9)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find = near_copies.near_duplicates(docs, max_bucket=max_bucket)
    got = {}
    for r in find.collect():
        got.setdefault(r.label, []).append(r.doc_id)
    assert sorted(map(min, got.values())) == kept_of_all_pairs(rows)


def test_stage_drops_copies_with_changed_words(spark):
    rnd = random.Random(9)
    base = say(rnd, 300)
    texts = [" ".join(w) for w in (base, changed(rnd, base, 4), changed(rnd, base, 5), say(rnd, 300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]


@pytest.mark.parametrize("n", [5, 9, 20, 40, 64, 65, 90, 150, 300, 1000, 5000])
def test_pairs_at_the_limit_share_a_block(n):
    """Sets of a similarity of just 0.8: shared shingles and as many others on both sides as the limit allows."""
    rnd, hits, trials = np.random.default_rng(n), 0, 200
    for _ in range(trials):
        low = rnd.integers(0, n // 9 + 1) if n > 9 else 0
        more = int((n - low) / 0.8) - (n - low) - low  # union less shared and less those on the one side
        pool = rnd.integers(0, 1 << 63, n + max(more, 0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[low:n], pool[n:]]))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        hits += bool(len(np.intersect1d(near_copies.block_keys(a), near_copies.block_keys(b))))
    assert hits >= 0.985 * trials


def test_shared_passage_is_no_copy(spark):
    """Many texts with a passage of half their words: buckets part, and nothing is linked."""
    rnd = random.Random(4)
    passage = say(rnd, 120)
    rows = [(k, " ".join([*say(rnd, 40), *passage, *say(rnd, 60)])) for k in range(300)]
    rows += [(1000 + k, " ".join(changed(rnd, passage, 1))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_duplicates(docs, max_bucket=8).collect()
    assert len({r.label for r in got if r.doc_id < 1000}) == 300
    assert len({r.label for r in got if r.doc_id >= 1000}) == 1


@pytest.mark.parametrize("n,low,high", [(150, 3, 5), (150, 2, 5), (400, 3, 5)])
def test_links_within_a_template_group(spark, n, low, high):
    """Texts of one template, few of which are near copies of each other: of the pairs at 0.8, at least 98 % are in one group."""
    rnd = random.Random(n + low)
    base = say(rnd, 200)
    texts = [changed(rnd, base, rnd.randint(low, high)) for _ in range(n)]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    label = {r.doc_id: r.label for r in near_copies.near_duplicates(docs).collect()}
    pairs = [(i, j) for i in range(n) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert sum(label[i] == label[j] for i, j in pairs) >= 0.98 * len(pairs)


def test_full_blocks_lose_no_link(spark):
    """Blocks of some 500 texts of one template, few of which are near copies of each other or of a hub: of those that share a block, all are linked."""
    rnd = random.Random(3)
    base = say(rnd, 200)
    texts = [" ".join(changed(rnd, base, rnd.randint(3, 5))) for _ in range(900)]
    sets = [near_copies.shingle_set(t) for t in texts]
    blocks = [set(near_copies.block_keys(s).tolist()) for s in sets]
    own = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(900) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) and blocks[i] & blocks[j]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = {r.doc_id: r.label for r in near_copies.near_duplicates(docs).collect()}
    assert len(pairs) > 200
    assert [p for p in pairs if label[p[0]] != label[p[1]]] == []


def test_sketches_differ_no_more_than_sets():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rnd.integers(0, 1 << 63, rnd.integers(10, 3000), dtype=np.uint64))
        a, b = (np.sort(rnd.choice(pool, rnd.integers(1, len(pool) + 1), replace=False)) for _ in range(2))
        bits = np.bitwise_count((near_copies._sketch(a) ^ near_copies._sketch(b)).view(np.uint64)).sum(dtype=int)
        assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2
