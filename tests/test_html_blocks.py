"""HTML blocks against a plain stack machine, packing against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from cairnflow.operators import chunking
from cairnflow.operators import html_blocks as hb

INNER = [b for b in hb.BLOCKS if b not in ("p", "li", "table")]


class Plain:
    """A page by a stack of open elements."""

    def __init__(self, html):
        self.stack, self.out, self.tables, self.depth = [], [], [], 0
        html = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", "", html or "")
        for k, token in enumerate(re.findall(r"</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<", html)):
            m = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)", token)
            if m and m[2].lower() == "table" and not m[1]:
                if self.depth == 0:
                    self.tables.append("")
                    self.end_p()
                self.depth += 1
            if self.depth:
                self.tables[-1] += token
                if m and m[2].lower() == "table" and m[1]:
                    self.depth -= 1
            elif m:
                self.tag(k, m[2].lower(), bool(m[1]))
            elif not token.startswith("<!"):
                self.text(token)

    def end_p(self):
        # a paragraph is open on top of the blocks, or an inline block stands on it
        at = [i for i, (n, _) in enumerate(self.stack) if n in INNER or n == "p"]
        if at and self.stack[at[-1]][0] == "p":
            del self.stack[at[-1]]

    def tag(self, k, name, closes):
        if name in ("p", "li", "table") or (name in hb.BLOCKS and name != "code") or name in hb.ENDS_P:
            self.end_p()
        if name in hb.VOID or (name == "p" and closes):
            return
        if name == "li":
            at = [i for i, (n, _) in enumerate(self.stack) if n in INNER]
            low = at[-1] if at else -1
            self.stack = self.stack[: low + 1] + [x for x in self.stack[low + 1 :] if x[0] != "li"]
        if not closes:
            self.stack.append((name, k))
        elif name != "li":
            at = [i for i, (n, _) in enumerate(self.stack) if n == name]
            if at:
                self.stack = self.stack[: at[-1]]

    def text(self, token):
        text = re.sub(r"^\s+|\s+$", "", token.replace("&eacute;", "é").replace("&#8364;", "€").replace("&lt;", "<").replace("&amp;", "&"))
        if not text:
            return
        blocks = [(n, k) for n, k in self.stack if n in hb.BLOCKS]
        parent = self.stack[-1][0] if self.stack else ""
        block = blocks[-1][1] if blocks else None
        if block is not None and parent in hb.HEADINGS:
            text = f"{hb.HEADINGS[parent]} {text}"
        if not self.out or (block is not None and block != self.out[-1][0]):
            self.out.append([block, text])
        else:
            self.out[-1][1] += " " + text


def made(rnd, depth=0):
    """A random page whose elements are closed by their own tags, apart from paragraphs and items."""
    out = []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.choice(["text", "text", "p", "inline", "div", "list", "h", "table", "void", "nav", "junk"] if depth < 4 else ["text"])
        inside = lambda: made(rnd, depth + 1)
        if kind == "text":
            out.append(rnd.choice(["word ", " two words", "\n", "caf&eacute; ", "&#8364;5", "a &lt; b", "x &amp; y", "  "]))
        elif kind == "p":
            out.append("<p class='x'>para " + rnd.choice(["", "<b>bold</b> rest", "<code>code</code> after", "<br>more"]) + rnd.choice(["</p>", "", "</P> tail"]))
        elif kind == "inline":
            out.append(f"<span>{rnd.choice(['in', ' ', '<i>deep</i> less'])}</span>")
        elif kind == "div":
            name = rnd.choice(["div", "ARTICLE", "section", "blockquote", "pre", "figure"])
            out.append(f"<{name}>{inside()}</{name}>")
        elif kind == "list":
            items = "".join(f"<li>{inside()}" + rnd.choice(["</li>", ""]) for _ in range(rnd.randint(0, 3)))
            out.append(f"<ul>{items}</ul>")
        elif kind == "h":
            name = f"h{rnd.randint(1, 6)}"
            out.append(f"<{name}>Head" + rnd.choice(["", "<b>bold</b> on", "<br>line"]) + f"</{name}>")
        elif kind == "table":
            out.append("<table style='a' id=1><tr><td>cell" + rnd.choice(["", "<table><tr><td>in</table>", "<p>x"]) + "</td></tr></table>")
        elif kind == "nav":
            out.append(f"<nav>{inside()}</nav>")
        elif kind == "void":
            out.append(rnd.choice(["<br>", "<img src=x>", "<hr>"]))
        else:
            out.append(rnd.choice(["<!-- <p>no -->", "<script>var t='<p>';</script>", "<style>p{}</style>", "<title>T</title>"]))
    return "".join(out)


def test_html_blocks(spark):
    rnd = random.Random(21)
    pages = [None, "", "text alone", "lead <p>x", "<h4>four</h4>", "</div></ul><p>after stray ends", *[made(rnd) for _ in range(400)], *["<!DOCTYPE html><html><body>" + made(rnd) + "</body></html>" for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    tokens = hb.tags(df, "id", "html").cache()
    got, tables = {}, {}
    for r in hb.html_blocks(tokens, "id").collect():
        got.setdefault(r.id, []).append((r.pos, r.content))
    for r in hb.html_tables(tokens, "id").collect():
        tables.setdefault(r.id, []).append((r.pos, r.content))
    wrong = []
    for k, html in enumerate(pages):
        plain = Plain(html)
        if [c for _, c in sorted(got.get(k, []))] != [c for _, c in plain.out]:
            wrong.append((html, sorted(got.get(k, [])), plain.out))
        assert [c for _, c in sorted(tables.get(k, []))] == [t.replace(" style='a'", "") for t in plain.tables]
    assert not wrong, (len(wrong), min(wrong, key=lambda x: len(x[0])))
    assert sum(map(len, got.values())) > 500 and len(tables) > 50
    assert sorted(hb.page_chunks(df, "id", "html", 5).columns) == ["chunk", "id", "part", "pos"]


def test_unescaped(spark):
    cases = {"a &amp; b": "a & b", "&copy 1": "© 1", "&nope; &": "&nope; &", "&#65;&#x42;&#x1F600;": "AB😀", "&#0;&#xD800;": "��", "&yuml;&nbsp;": "ÿ\xa0", "&amp;lt;": "&lt;", "": "", None: None}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert [(r.a, r.c) for r in df.select("a", hb.unescaped(df.a).alias("c")).collect()] == list(cases.items())


def test_packed_blocks(spark):
    rnd = random.Random(22)
    docs = {d: [" ".join(rnd.choice(["Aa", "b-c", "x"]) for _ in range(rnd.choice([0, 1, 3, 5, 7, 30]))) for _ in range(rnd.randint(0, 12))] for d in range(60)}
    df = spark.createDataFrame([(d, p, t or None) for d, rows in docs.items() for p, t in enumerate(rows)], "id long, pos int, content string")
    got = {}
    for r in hb.packed_blocks(df, "id", 6).collect():
        got.setdefault(r.id, []).append((r.pos, r.chunk))
    for d, blocks in docs.items():
        chunks, now, n = [], [], 0
        for block in blocks:
            words = re.findall(r"\w+", block.lower())
            if n + len(words) > 6 and now:
                chunks.append("\n".join(now))
                now, n = [], 0
            if len(words) > 6:
                chunks += [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
            else:
                now.append(block)
                n += len(words)
        chunks += ["\n".join(now)] if now else []
        assert [c for _, c in sorted(got.get(d, []))] == [c for c in chunks if c], blocks


def test_table_parts(spark):
    row = lambda n: "<tr><td>" + " ".join(["w"] * n) + "</td></tr>"  # noqa: E731  n + 4 tokens
    cases = {0: [3, 3, 3], 1: [50, 1], 2: [1, 50], 3: []}
    df = spark.createDataFrame([(k, "<table id='1'><tbody>" + "\n".join(map(row, v)) + "</tbody></table>") for k, v in cases.items()] + [(4, None)], "id long, html string")
    got = {}
    for r in hb.table_parts(df, "id", "html", 15).collect():
        got.setdefault(r.id, []).append((r.pos, r.chunk))
    table = lambda *ns: "<table>" + "".join(map(row, ns)) + "</table>"
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {0: [table(3, 3), table(3)], 1: [table(50), table(1)], 2: [table(1), table(50)]}


def test_packed_rows_stream(spark):
    """A table of many batches comes in linear time, and its rows don't travel with each of its chunks."""
    rows = spark.range(60_000).selectExpr("id % 2 as g", "id as k", "concat('<tr><td>w', id, '</td></tr>') as r")
    got = {}
    for r in hb.packed_rows(rows, ["g"], ["k"], "r", 12).collect():
        got.setdefault(r.g, []).append((r.pos, r.chunk))
    for g in (0, 1):
        own = [f"<tr><td>w{k}</td></tr>" for k in range(g, 60_000, 2)]
        assert [c for _, c in sorted(got[g])] == ["<table>" + "".join(own[k : k + 2]) + "</table>" for k in range(0, len(own), 2)]
    whole = rows.where("g = 0").groupBy("g").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))
    assert sorted((r.pos, r.chunk) for r in hb.table_parts(whole, "g", "html", 12).collect()) == sorted(got[0])


def test_table_pairs(spark):
    html = "<table><tr><td>Question</td><td>x</td></tr><TR><td a='1'> <b>What</b> &amp;\n why </td><td>so</td><td>more</td></TR><tr><td>one</td></tr><tr><td>q</td><td>1</td></tr><tr><td>a</td><td> </td></tr><tr><td>open"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    assert [tuple(r) for r in chunking.table_pairs(df, "id", "html").collect()] == [(1, 1, "What &\n why", "so")]


def test_numbered(spark):
    rnd = random.Random(51)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), k, f"x{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, _range_of string").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunking.numbered(df, ["g"], ["k"]).collect()
        whole = {r.k: r._n for r in chunking.numbered(df, [], ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for g in ("hot", "a", "b", None):
        assert [r._n for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert whole == {k: k + 1 for k in range(3000)}
    assert set(got[0].asDict()) == {"g", "k", "_range_of", "_n"} and chunking.numbered(df.where("k < 0"), ["g"], ["k"]).count() == 0
