"""Line, substring and fingerprint dedup and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from cairnflow.llm import line_dedup, quality, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["é", "ñandú", " x", "<b>"]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage = [text(36), text(60), text(35), text(200)]
    out = []
    for k in range(n):
        parts = [text(rnd.randrange(0, 80))]
        for p in passage:
            if rnd.random() < 0.3:
                parts += [p, text(rnd.randrange(0, 30))]
        out.append((k, rnd.choice([" ", "\n", " \n\t"]).join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, "word"), (n + 3, out[3][1]), (n + 3, out[3][1]), (None, out[4][1]), (n + 5, " ".join(["same"] * 90))]
    out.append((n + 6, text(5000) + " " + passage[1]))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, lines string, n_words int")


def brute_repeats(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 20])
def test_substring_brute_force(spark, chunk_bytes):
    rows = corpus()
    got = substring.remove_repeats(docs_of(spark, rows).repartition(3), chunk_bytes=chunk_bytes)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows), key=str)
    assert any(x[2] for x in got) and any(not x[2] for x in got)


def test_substring_cover():
    d = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert d == set(range(substring.PERIOD))


def test_substring_empty(spark):
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            low[r] = min(low.get(r, i), i)
    return [(i, f"{f:016x}", low.get(find(k))) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))]


@pytest.mark.parametrize("bucket", [0, 1, 64])
def test_simhash_brute_force(spark, bucket):
    rnd = random.Random(3)
    base = [" ".join(f"v{rnd.randrange(90)}" for _ in range(300)) for _ in range(6)]
    rows = [(k, None if k == 7 else "" if k == 8 else b) for k, b in enumerate(base * 2)]
    for k in range(60):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(1, 5)):
            w[rnd.randrange(len(w))] = "new"
        rows.append((200 - k, " ".join(w)))
    rows += [(300, "One"), (301, "one"), (302, "A  b"), (302, "A  b"), (None, base[0]), (None, "alone here now")]
    got = [(r[0], f"{r[1] % 2**64:016x}", r[2]) for r in simhash.near_duplicates(docs_of(spark, rows), max_bucket=bucket).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_simhash_chain(spark):
    """Words in a line two bits apart make one component; full buckets take the star path."""
    rnd = random.Random(1)
    fp, chain = rnd.getrandbits(64), []
    for _ in range(40):
        fp ^= (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        chain.append(fp - (fp >> 63 << 64))
    df = spark.createDataFrame([(x,) for x in set(chain)], "fp long")
    for bucket in (0, 64):
        edges = simhash.fingerprint_links(df, 2, bucket)
        label = simhash.components(edges)
        assert label.select("label").distinct().count() == 1


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_lines_match_sql(spark):
    from cairnflow.llm import common

    rnd = random.Random(2)
    block = ["a", "b", "", "c d"]
    rows = [(k, "\n".join(rnd.choice(block) if rnd.random() < 0.7 else f"u{rnd.random()}" for _ in range(rnd.randrange(1, 14)))) for k in range(50)]
    rows += [(60, None), (61, ""), (62, "\n\n\n\n"), (63, rows[0][1])]
    df = docs_of(spark, rows)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "lines", "n_words", "lines_total", "lines_removed"]
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.sql("create table documents as select * from documents")
    want = con.sql(line_dedup.ORACLE_OP7).fetchall()
    got = [tuple(r) for r in got.select("doc_id", "text", "lines_total", "lines_removed").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert common.written(df.limit(0), "t").count() == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_repeated_and_null_ids(spark):
    t = "1\n2\n3\n4"
    rows = [(None, t), (5, t), (5, t), (6, "0\n" + t)]
    odd = docs_of(spark, rows).selectExpr("*", "1 as _gone", "2 as _gone_id", "3 as _lines", "4 as gone", "5 as pos")
    for limit in (100_000, 0):
        clean = line_dedup.dedup_lines(odd, broadcast_rows=limit)
        assert clean.columns == [*odd.columns, "lines_total", "lines_removed"] and {(r._gone, r._lines) for r in clean.collect()} == {(1, 3)}
    got = {(r.doc_id, r.text, r.lines_removed) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {(None, t, 0), (5, "", 4), (6, "0", 4)}
    assert line_dedup.dedup_lines(docs_of(spark, rows)).count() == 4


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = set()
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            rep.update((k, k + 1, k + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def test_base_counts():
    rnd = random.Random(4)
    for t in [None, "", "a", "a b c a b c", "\n\n", "x\r\nx\r\n", "é ñ z <|>"] + [" ".join(rnd.choice(["a", "b", "é#", "\n", "d\n"]) for _ in range(n)) for n in range(40)]:
        assert quality.base_counts(t) == brute_counts(t)


def test_quality_host_lines(spark):
    rnd = random.Random(6)
    body = lambda: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(k, "Common  LINE here\n" + body(), "h1") for k in range(15)]
    rows += [(100 + k, "common line HERE\n" * 30 + f"only {k}", "h1") for k in range(5)]
    rows += [(200 + k, "Common line here\n" + body(), "h2") for k in range(3)]
    rows += [(300, None, "h1"), (301, "", None), (302, body(), None), (None, body(), "h1")] + [(400, "same words\n" + body(), "h3")] * 30
    extra = ("line", "host", "digest", "_id", "_host", "_digest", "_lines", "_drop", "_kept", "i", "h", "g")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(extra)))
    for rows_limit in (200_000, 0):
        verdicts, over = quality.judge(df, broadcast_rows=rows_limit)
        v = {r.doc_id: r for r in verdicts.collect()}
        assert verdicts.count() == len(rows)
        assert {r.host for r in over.collect()} == {"h1"}
        assert all(v[k].kept for k in [*range(15), 200, 201, 202, 302, None, 400])
        assert not any(v[k].kept for k in (300, 301, *range(100, 105)))
        assert v[0].n_lost_words == 3 and v[200].n_lost_words == 0
        clean = quality.apply_rules(df, broadcast_rows=rows_limit)
        assert clean.columns == df.columns
        texts = {r.doc_id: r.text for r in clean.collect()}
        assert "LINE" not in texts[0] and texts[200].startswith("Common line here") and 100 not in texts
        assert clean.where("doc_id = 400").count() == 30
    assert quality.judge(df.limit(0))[0].count() == 0
    assert quality.apply_rules(df.limit(0)).count() == 0


def test_quality_limits_met_exactly(spark):
    """Ten documents hold a line or nine do, a share of the limit or above it, many documents whatever the share."""
    rnd = random.Random(7)
    body = lambda: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(k, ("ten\n" if k < 10 else "") + ("nine\n" if k < 9 else "") + body(), "a") for k in range(199)] + [(0, None, "a")]
    rows += [(500 + k, ("share\n" if k < 10 else "") + body(), "b") for k in range(200)]
    rows += [(800 + k, ("copy of one text\n" + "t " * 3 + "end\n") + " ".join(f"c{j}" for j in range(60)), "c") for k in range(12)] + [(900 + k, body(), "c") for k in range(100)]
    rows += [(2000 + k, ("many\n" if k < 12 else "") + body(), "d") for k in range(400)] + [(2000, rows[0][1], "d")]
    rows += [(3000, "same row\n" + body(), "e")] * 15 + [(3001, body(), "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.host: set() for r in quality.judge(df, many_docs=12)[1].collect()}
    verdicts, over = quality.judge(df, many_docs=12)
    for r in over.collect():
        got[r.host].add(r.line)
    name = lambda t: quality.line_hashes(t)[0][0]
    assert got["d"] == {name("many")}
    assert "a" not in got and "b" not in got and "e" not in got  # 10 of 200 is no more than a share of 0.05
    assert name("copy of one text") in got["c"]  # twelve documents of one text are twelve
    kept = {(r.doc_id, r.host): r.kept for r in verdicts.collect()}
    assert not any(kept[800 + k, "c"] for k in range(12)) and kept[2000, "d"] and not kept[0, "a"] is None
    base = [(1, " ".join(f"w{k}" for k in range(50)), "z"), (2, " ".join(f"w{k}" for k in range(49)), "z"), (3, " ".join(["a b c a b c"] + [f"w{k}" for k in range(6)]), "z")]
    base += [(4, "x y z x y z " + " ".join(f"q{k}" for k in range(6)) + " " + "r s t r s t r s t r s t r s t r s t r " + " ".join(f"v{k}" for k in range(19)), "z")]
    v = {r.doc_id: r for r in quality.judge(spark.createDataFrame(base, "doc_id long, text string, source string"))[0].collect()}
    assert (v[1].base_failed, v[2].base_failed) == (False, True)
    assert v[4].n_words == 50 and v[4].n_repeat_words == 25 and not v[4].base_failed


def test_long_texts(spark):
    """A text of a megabyte in every operator of this file."""
    long = "\n".join(f"line {k} of a long text that goes on" for k in range(20_000))
    df = docs_of(spark, [(1, long), (2, long), (3, "short one")])
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 180_000, 2: 180_000, 3: 0}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 20_000, 3: 0}
    v = quality.judge(df.withColumn("source", df.lines))[0].collect()
    assert sorted((r.doc_id, r.n_words) for r in v) == [(1, 180_000), (2, 180_000), (3, 2)]
