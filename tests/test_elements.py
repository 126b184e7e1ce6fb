"""Markdown elements against a plain state machine, table context against a plain walk."""

import math
import random
import re

from cairnflow.operators import elements


def plain_elements(text):
    lines, out, i = text.split("\n"), [], 0
    header, item = (lambda x: re.match(r"#{1,6}\s+", x)), (lambda x: re.match(r"\s*([-*+]|\d+\.)\s+", x))
    fence, quote = (lambda x: x.strip().startswith("```")), (lambda x: x.strip().startswith(">"))
    block = lambda x: header(x) or fence(x) or item(x) or quote(x)
    while i < len(lines):
        x, j = lines[i], i + 1
        if not x.strip():
            i += 1
            continue
        if header(x):
            kind = "header"
        elif fence(x):
            kind = "code"
            while j < len(lines) and not fence(lines[j]):
                j += 1
            j = min(j + 1, len(lines))
        elif item(x):
            kind = "list"
            while j < len(lines) and (item(lines[j]) or not lines[j].strip() or re.match(r"\s+\w+", lines[j])):
                j += 1
        elif quote(x):
            kind = "quote"
            while j < len(lines) and (quote(lines[j]) or not lines[j].strip()):
                j += 1
        else:
            kind = "text"
            while j < len(lines) and not block(lines[j]) and (lines[j].strip() or j + 1 == len(lines) or not block(lines[j + 1])):
                j += 1
        out.append((len(out), kind, "\n".join(lines[i:j]), i, j - 1))
        i = j
    return out


def test_markdown_elements(spark):
    rnd = random.Random(6)
    pieces = ["# Head", "## ", "#no", "text", "more text", "", "", "  ", "- item", "  - sub", "1. one", "  indented word", "  -", "> quote", " > q", "```", "```py", "  ```", "code()", "\tx"]
    texts = [None, "", "\n\n", "# only", *["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in elements.markdown_elements(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.element, r.kind, r.content, r.start_line, r.end_line))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == plain_elements(t or ""), t


def tokens(s):
    han = sum("一" <= c <= "鿿" for c in s)
    return math.floor(han * 1.5 + (len(s) - han) / 4)


def plain_context(blocks, at, budget):
    parts = lambda rows: [x for _, t in rows for x in re.sub(r"([。!?？；！\n]|\. )", "\\1\x00", t or "").split("\x00") if x]
    upper, lower = "", ""
    for s in reversed(parts([b for b in blocks if b[0] < at])):
        if tokens(upper) >= budget:
            break
        upper = s + upper
    for s in parts([b for b in blocks if b[0] >= at]):
        if tokens(lower) >= budget:
            break
        lower += s
    return upper.strip(" "), lower.strip(" ")


def test_table_context(spark):
    rnd = random.Random(7)
    say = lambda: "".join(rnd.choice(["word ", "x", "中文字", "End. ", "。", "!", "long" * 30]) for _ in range(rnd.randint(0, 12)))
    docs = {d: [(p, rnd.choice([say(), None]) if p % 9 == 0 else say()) for p in range(30)] for d in range(6)}
    blocks = spark.createDataFrame([(d, p, t) for d, rows in docs.items() for p, t in rows], "doc long, pos int, text string")
    asked = [(d, p, f"{d}-{p}-{k}", "T") for d in [*docs, 99] for p in (0, 7, 29, 40) for k in range(2)]
    tables = spark.createDataFrame(asked, "doc long, pos int, id string, html string")
    for budget in (1, 8, 200):
        context = elements.table_context(blocks, tables, ["doc"], budget)
        got = {r.id: (r.upper, r.lower) for r in context.collect()}
        assert got == {i: plain_context(docs.get(d, []), p, budget) for d, p, i, _ in asked}
    whole = elements.with_context(tables, context, ["doc"], "html")
    assert {r.id: r.html for r in whole.collect()} == {i: "T".join(got[i]) for _, _, i, _ in asked}
