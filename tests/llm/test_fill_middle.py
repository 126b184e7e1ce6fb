"""Fill-in-middle: against a plain reading of the rule, and exact round trips."""

import hashlib
import random
import re

from cairnflow.llm import common, fill_middle


def plain(key, text):
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    assert "".join(units) == text
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def texts():
    rnd = random.Random(3)
    pieces = ["word", "a", " ", "\n", "<", "<P", "S>", ">", "<|P|>", "é", "中文", "🙂", "\r\n", "12", "\x00", "\x1c", "É", "M>", "<<"]
    made = ["".join(rnd.choice(pieces) for _ in range(n)) for n in range(120)]
    return ["", None, "a<P>b", "<S>", "x <M>", "one", " ", "<", "<P", "é" * 5, *made, "many words " * 50_000]


def test_against_plain_rule(spark):
    rows = [(k * 7, t, "n", k) for k, t in enumerate(texts())] + [(None, "no id at all", "x", 0), (3, "same", "x", 0), (3, "same", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, _made int")
    got = fill_middle.restored(fill_middle.transformed(df)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, _, other in rows:
        n, form, p, m, out = plain("null" if i is None else i, t or "")
        want.append((i, t, other, n, form, p, m, out, sha(out), t or "", sha(t or "")))
    assert got[0].asDict().keys() == {"doc_id", "text", "_made", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "restored_sha256"}
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marks_across_ends():
    for text in ("<" * 9, "<P<S<M>" * 3, "P>S>M>", "><><"):
        for key in range(200):
            _, form, _, _, out = fill_middle.transformed_text(str(key), text)
            assert fill_middle.restored_text(out, form) == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restored(fill_middle.transformed(df)).collect() == []


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in fill_middle.op12(spark, sf_dir).collect()}
    for r in common.table(spark, sf_dir, "documents").collect():
        n, form, p, m, out = plain(r.doc_id, r.text or "")
        g = got.pop(r.doc_id)
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
