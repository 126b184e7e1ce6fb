"""Unit tests of functions, chunking, graph, layout, plans and routing."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow import schema
from cairnflow.functions import text, vectors, weights
from cairnflow.operators import chunking, filters, graph, layout, ranking
from cairnflow.plans import retrieval, routing


def one(spark, col, value=None):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("c")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (lambda v: text.normal_folder(v), " a\\b/ ", "/a/b"), (lambda v: text.normal_folder(v), "/", "/"), (lambda v: text.normal_folder(v), None, "/"), (lambda v: text.normal_folder(v), "//x//", "/x"),
        (lambda v: text.ancestors(v), "/a/b", ["/a", "/a/b"]), (lambda v: text.ancestors(v), "/", ["/"]), (lambda v: text.kb_id(v), "My KB-1!", "my_kb_1"), (lambda v: text.kb_id(v), "中", None),
        (lambda v: text.tokens(v), "Ａb, c_1 é", ["ab", "c_1", "é"]), (lambda v: text.tokens(v), None, []), (lambda v: text.is_chinese(v), "中文ab", True), (lambda v: text.is_chinese(v), "", False),
        (lambda v: text.token_count(v), "中文abcd", 4), (lambda v: text.is_title_like(v), "第三条 很长,的", True), (lambda v: text.is_title_like(v), "a, b", False),
        (lambda v: text.without_qa_prefix(v), "Question: why", "why"), (lambda v: text.fenced_json(v), "x ```json\n{}\n``` y", "{}"), (lambda v: text.numbers_of(v), "1\t2.5\tx", [1.0, 2.5, None]),
        (lambda v: text.highlighted(v, ["a.b"]), "A.B axb", "<em>A.B</em> axb"), (lambda v: text.is_number(v), "1,2%", True), (lambda v: text.without_tags(v), "t@@1\t1.0\t2.0\t3.0\t4.0##", "t"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f(F.col("v")), value) == want


def test_query_terms():
    terms = weights.query_terms(["big", "data"])
    assert abs(sum(w for _, w in weights.query_weights(["big", "data"])) - 1) < 1e-9
    assert set(terms) == {"big", "data", "bigdata"} and abs(terms["big"] - 0.2) < 1e-9 and abs(terms["bigdata"] - 0.3) < 1e-9


def test_similarity_bounds(spark):
    sim = lambda t: one(spark, weights.token_similarity(text.tokens(F.col("v")), weights.query_terms(["big", "data"])), t)
    assert sim("big data") == pytest.approx(1) and 0 < sim("data") < sim("data big") < 1 and sim("") < 1e-6


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), (None,)], "e array<float>")
    assert [r[0] for r in df.select(vectors.cosine_to(F.col("e"), [2.0, 0.0])).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(vectors.cosine(F.col("e"), F.col("e"))).collect()] == [1.0, 0.0, 0.0]


def test_hybrid_without_cosine(spark):
    df = spark.createDataFrame([("1", [0.0, 0.0], "big"), ("2", [0.0, 0.0], "x")], "id string, e array<float>, v string")
    got = ranking.hybrid_scores(df, [1.0, 0.0], ["big"], "e", text.tokens(F.col("v"))).collect()
    assert [r.sim == r.tok for r in got] == [True, True]


def test_merge_overshoots(spark):
    parts = ["x" * 40] * 10  # ten tokens each and a line feed
    got = one(spark, chunking.merged_sections(F.array(*map(F.lit, parts)), 25))
    assert [c.count("\n") for c in got] == [3, 3, 3, 1] and "".join(got) == "".join("\n" + p for p in parts)
    assert one(spark, chunking.merged_sections(F.array().cast("array<string>"), 25)) == []


def test_parent_child_ids(spark):
    df = spark.createDataFrame([("n", "。".join(["句子" * 30] * 12))], "name string, t string")
    rows = chunking.parent_child_chunks(df, "name", "t", 1000, 50).collect()
    parents = {r.id: r.chunk for r in rows if r.kind == "parent"}
    children = [r for r in rows if r.kind == "child"]
    assert len({r.id for r in rows}) == len(rows) and {r.parent_id for r in children} == set(parents)
    whole = next(iter(parents.values()))
    assert "".join(r.chunk for r in sorted(children, key=lambda r: r.child_pos)) == whole.strip()  # children are trimmed
    assert {r.mom_with_weight for r in children} == {whole}


def test_parent_child_plain(spark):
    """Against a plain loop: several parents, blank and null texts, equal documents."""
    texts = ["一。 二！三" + "x" * 25 + "。。\n\nsecond part\n \n" + "y" * 45, "", " \n\n ", None, "。", "a b。c", "a b。c"]
    rows = [(f"n{i % 6}", t) for i, t in enumerate(texts)]
    want = []
    for _, t in rows:
        # each section is a parent here: with a budget of -1 the one before always exceeds it
        for p, parent in enumerate("\n" + s.strip(" ") for s in re.split(r"\n\s*\n", t or "") if s.strip(" ")):
            want.append(("parent", p, None, parent, None))
            parts = [x.strip() for x in re.findall("[^。；！？]{20,}|[^。；！？]*[。；！？]|[^。；！？]+", parent)]
            want += [("child", p, k, x, parent) for k, x in enumerate(x for x in parts if x)]
    got = chunking.parent_child_chunks(spark.createDataFrame(rows, "name string, t string"), "name", "t", -1, 20)
    assert got.columns == ["id", "parent_id", "kind", "name", "pos", "child_pos", "chunk", "mom_with_weight"]
    got = got.collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.kind, r.pos, r.child_pos, r.chunk, r.mom_with_weight) for r in got), key=key) == sorted(want, key=key)
    assert {r.parent_id for r in got if r.kind == "child"} <= {r.id for r in got if r.kind == "parent"} and not any(r.parent_id for r in got if r.kind == "parent")
    assert chunking.parent_child_chunks(spark.createDataFrame([], "name string, t string"), "name", "t").count() == 0


def test_parent_child_written_once(spark, tmp_path):
    """Files hold a parent's text once, not once a child, however large the table's tasks were (one here)."""
    texts = [(str(i), "。".join(random.Random(i * 1000 + k).randbytes(90).hex() for k in range(160))) for i in range(80)]
    size = sum(len(t.encode()) for _, t in texts)
    chunking.parent_child_chunks(spark.createDataFrame(texts, "name string, t string").coalesce(1), "name", "t").write.parquet(out := str(tmp_path / "out"))
    # the text as parent, as children and as what children carry, and ids
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4 * size
    assert spark.read.parquet(out).where("kind = 'child'").agg(F.sum(F.octet_length("mom_with_weight"))).first()[0] > 150 * size


def test_hierarchy():
    lines = ["# A", "a1", "## B", "b1", "b2", "# C", "c1"]
    assert chunking.hierarchy_paths(lines, 4, 1) == [["# A", "a1"], ["# A", "## B", "b1"], ["# A", "## B", "b2"], ["# C", "c1"]]
    # the title-like level lies between body and the lowest headings, so depth 2 takes no heading of a family
    tagged = chunking.hierarchy_paths(["# A", "Some title", "x, y", "Other title"], 4, 2, ["", "title", "", "head"])
    assert tagged == [["# A", "Some title", "x, y"], ["# A", "Other title"]]
    # only one heading gives way to a higher one found later
    assert chunking.hierarchy_paths(["### c", "## b", "# a", "xx"], 4, 1) == [["# a", "xx"]]
    assert chunking.hierarchy_paths(["## b", "### c", "# a", "xx"], 4, 1) == [["# a", "### c", "xx"]]
    assert chunking.hierarchy_paths([], 4, 3) == []


def plain_tree(lines, level, limit):
    """Chunks of a tree that is built as such and walked."""
    root = {"level": -1, "text": [], "below": []}
    stack = [root]
    for line, own in zip(lines, level, strict=True):
        if own > limit:
            stack[-1]["text"].append(line)
            continue
        while len(stack) > 1 and stack[-1]["level"] >= own:
            stack.pop()
        stack[-1]["below"].append({"level": own, "text": [line], "below": []})
        stack.append(stack[-1]["below"][-1])

    def walk(node, above):
        here = above + node["text"]
        if not node["below"]:
            return [here]
        return [x for n in node["below"] for x in walk(n, here)]

    return (["\n".join(root["text"])] if root["text"] else []) + ["\n".join(x) for n in root["below"] for x in walk(n, [])]


def test_tree_against_a_built_tree():
    assert chunking.tree_chunks_of(["# A", "a1", "## B", "b1", "b2", "# C", "c1"], 4, 2) == ["# A\na1\n## B\nb1\nb2", "# C\nc1"]
    assert chunking.tree_chunks_of(["xx", "yy"], 4, 2) == ["xx", "yy"] and chunking.tree_chunks_of([], 4, 2) == []
    rnd = random.Random(5)
    for _ in range(300):
        lines = [rnd.choice(["# a", "## b", "### c", "body, of it", "more"]) + str(k) for k in range(rnd.randint(1, 14))]
        depth = rnd.randint(1, 4)
        level = [{"# ": 0, "##": 1}.get(x[:2], 9) if not x.startswith("###") else 2 for x in lines]
        present = sorted(set(level))
        limit = present[min(depth, len(present)) - 1]
        if limit == 9 and len(present) > 1:
            limit = present[-2]
        assert chunking.tree_chunks_of(lines, 4, depth) == plain_tree(lines, level, limit)


def test_strategies(spark):
    rows = [
        ("a.pptx", 0, "p2", "pn=2", "laws"), ("a.pptx", 1, "p1", "{'page_number': 1}", "laws"), ("a.pptx", 2, "own", None, "laws"), ("a.pptx", 3, "p2b", "PN_2", "laws"),
        ("b", 0, "# A", "", "laws"), ("b", 1, "one, two", "", "laws"), ("b", 2, "<table/>", "table", "laws"), ("c", 0, "# A", "", "book"), ("c", 1, "xx", "", "book"), ("c", 2, "# B", "", "book"),
        ("d", 0, "plain words", "", "book"), ("d", 1, "more", "", "book"), ("e", 0, "Q: why\nA: so", "", "qa"), ("f", 0, "x", "", "one"), ("f", 1, "y", "", "one"), ("g", 0, "x", "", "odd"), ("g", 1, " ", "", None), ("h", 0, "x", None, None),
    ]
    df = spark.createDataFrame(rows, "name string, pos int, section string, tag string, strategy string")
    got = {(r.name, r.kind, r.pos): r.chunk for r in chunking.chunked(df, "name", "pos", "section", "tag", "strategy").collect()}
    assert got == {
        ("a.pptx", "text", 0): "p1", ("a.pptx", "text", 1): "p2\np2b", ("a.pptx", "text", 2): "own", ("b", "text", 0): "# A\none, two", ("b", "table", 0): "<table/>",
        ("c", "text", 0): "# A\nxx", ("c", "text", 1): "# B", ("d", "text", 0): "\nplain words\nmore", ("e", "text", 0): "Question: why\tAnswer: so", ("f", "text", 0): "x\n\ny", ("g", "text", 0): "\nx", ("h", "text", 0): "\nx",
    }
    assert chunking.chunked(df.limit(0), "name", "pos", "section", "tag", "strategy").count() == 0


def test_qa_machine(spark):
    lines = ["lead", "Q: one", "more", "A: x", "y", "A: z", "Q: lost", "问： two", "答： w"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "d int, p int, t string")
    assert [(r.question, r.answer) for r in chunking.qa_pairs(df, "d", ["p"], "t").orderBy("pair").collect()] == [("one\nmore", "z"), ("two", "w")]


def plain_pagerank(nodes, edges, rounds=60):
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
    top = max(rank.values())
    return {n: r / top for n, r in rank.items()}


def test_pagerank(spark):
    rnd = random.Random(1)
    nodes = [f"v{k}" for k in range(12)]
    edges = sorted({(rnd.choice(nodes[:9]), rnd.choice(nodes)) for _ in range(25)})
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "key string"), spark.createDataFrame([*edges, edges[0]], "src string, dst string"), iterations=40)
    want = plain_pagerank(nodes, edges)
    assert {r.key: pytest.approx(r.pagerank, abs=1e-4) for r in got.collect()} == want
    assert graph.pagerank(spark.createDataFrame([], "key string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_graph_build(spark):
    e = spark.createDataFrame([("Acme", "ORG", "a", "1", 1), (" acme ", "X", "longer", "2", 2)], "name string, type string, description string, chunk_id string, seq int")
    r = spark.createDataFrame([("ACME", "Bob", "first", "1", 1), ("acme", "bob", "last", "2", 2), ("Bob", "bob", "self", "3", 3)], "source string, target string, description string, chunk_id string, seq int")
    nodes, edges = graph.build(e, r)
    assert {(n.key, n.name, n.type, n.description) for n in nodes.collect()} == {("acme", "Acme", "ORG", "longer"), ("bob", "Bob", "OTHER", "")}
    assert {(x.src, x.dst, x.description) for x in edges.collect()} == {("acme", "bob", "last"), ("bob", "bob", "self")}
    rows = graph.graph_rows(nodes.withColumn("pagerank_flt", F.lit(1.0)), edges, "kb")
    assert rows.count() == 4 and rows.select("id").distinct().count() == 4


def test_suppression(spark):
    rnd = random.Random(2)
    rows = [(p, k, x := rnd.uniform(0, 50), x + 20, y := rnd.uniform(0, 50), y + 20, rnd.random()) for p in [1, 2, None] for k in range(25)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, x1 double, top double, bottom double, score double")
    got = {(r.page, r.id) for r in layout.suppressed(df, ["page"]).collect()}
    want = set()
    for p in [1, 2, None]:
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: -r[6]):
            share = lambda o: max(0, min(r[3], o[3]) - max(r[2], o[2])) * max(0, min(r[5], o[5]) - max(r[4], o[4]))  # noqa: B023, E731
            if all(share(o) / (800 - share(o)) <= 0.2 for o in kept):
                kept.append(r)
        want |= {(p, r[1]) for r in kept}
    assert got == want


def chunk_rows(spark):
    rows = [("p", "parent", None, "Parent text big", [1.0, 0.0]), ("c1", "child", "p", "big data", [1.0, 0.1]), ("c2", "child", "p", "data", [0.9, 0.2]), ("f", "flat", None, "other big thing", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, chunk_type_kwd string, parent_id_kwd string, content_with_weight string, embedding array<float>")
    return schema.as_chunks(df.withColumns({"kb_id": F.lit("k"), "docnm_kwd": F.concat(F.lit("doc-"), "id"), "doc_id": F.col("id")}))


def test_retrieve(spark):
    hits = retrieval.retrieve(chunk_rows(spark), retrieval.Search(["big", "data"], [1.0, 0.0], ("k",), threshold=0.1)).collect()
    assert [(r.id, r.content_with_weight) for r in hits] == [("c1", "Parent text big"), ("f", "other big thing")]
    assert retrieval.retrieve(chunk_rows(spark), retrieval.Search(["big"], [1.0, 0.0], ("none",))).count() == 0
    words = retrieval.retrieve(chunk_rows(spark), retrieval.Search(["thing"])).collect()
    assert [r.id for r in words] == ["f"]
    assert retrieval.query_string("big data") == '(big^0.5000) (data^0.5000) "big data"^1.0000'


def test_context_and_sources(spark):
    hits = chunk_rows(spark).where("id <> 'p'").withColumn("sim", F.when(F.col("id") == "f", 0.9).otherwise(0.5))
    assert retrieval.context_text(hits, 2).first()[0] == "[1] (doc-f) other big thing\n\n[2] (doc-c1) big data"
    assert {r.kind for r in retrieval.sources_of(hits).collect()} == {"local"}
    assert retrieval.documents_of(hits).count() == 3


def test_routing(spark):
    hits = chunk_rows(spark).withColumn("sim", F.lit(0.5))
    web = lambda q, k: [("site", f"{q} {n}") for n in range(k)]
    assert routing.route(hits, "q", lambda q, t: "Correct").action == "local"
    assert routing.route(hits, "q", lambda q, t: "incorrect", web=web).hits.count() == 3
    assert routing.route(hits, "q", lambda q, t: "incorrect").action == "local fallback"
    mixed = routing.route(hits, "q", lambda q, t: "what?", lambda q, t: "fact", web)
    assert mixed.verdict == "ambiguous" and mixed.hits.count() == 3 and mixed.action == "refined and web"

    def fails(*_):
        raise RuntimeError

    failed = routing.route(hits, "q", fails, fails)
    assert failed.verdict == "ambiguous" and failed.hits.first()["sim"] == 0.6
    assert routing.route(hits.limit(0), "q").verdict == "incorrect"
    assert routing.route(hits.withColumn("sim", F.lit(0.9)), "q").verdict == "correct"


def test_filters(spark):
    df = spark.createDataFrame([("a", "/x"), ("b", "/x/y"), ("c", "/"), ("d", "/xy")], "id string, folder string")
    ids = lambda t: {r.id for r in t.collect()}
    assert ids(filters.under_folder(df, "/")) == {"a", "b", "c", "d"} and ids(filters.under_tool_folder(df, "/")) == {"c"}
    assert ids(filters.under_folder(df, "x/")) == {"a", "b"}
    assert ids(filters.deleted(df, {"folder": "/x", "id": None})) == {"b", "c", "d"} and ids(filters.deleted(df, {})) == {"a", "b", "c", "d"}


def test_schema(spark):
    assert schema.type_of("pagerank_flt").simpleString() == "double" and schema.type_of("q_768_vec").simpleString() == "array<float>"
    assert schema.type_of("q_64_vec") is None and schema.type_of("odd") is None
    with pytest.raises(ValueError, match="odd"):
        schema.as_chunks(spark.range(1).withColumn("odd", F.lit(1)))
    with pytest.raises(TypeError):
        schema.checked_types(spark.range(1).select(F.lit("x").alias("n_int")))


def test_children_close_at_every_mark(spark):
    """Against a plain loop over texts and marks."""
    import re

    from pyspark.sql import functions as F

    from cairnflow.operators import chunking

    def plain(parent, limit):
        out, last = [], ""
        for part in re.split("([。；！？])", parent):
            if part:
                last += part
                if re.fullmatch("[。；！？]", part) or len(last) >= limit:
                    out.append(last.strip())
                    last = ""
        return [x for x in [*out, last.strip()] if x]

    texts = ["", "。", "short。", "one。two；three！？four", "no mark", "x" * 30 + "。tail", "a" * 9 + "。" + "b" * 10 + "。。" + "c" * 11, "  。 y。", "\n\u3000a b \n。"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", chunking.child_texts(F.col("t"), 10))
    assert [(r.t, r.c) for r in df.collect()] == [(t, plain(t, 10)) for t in texts]


def test_cell_kinds_by_form(spark):
    from pyspark.sql import functions as F

    from cairnflow.operators import layout

    want = {"2024年": "Dt", "第三季度": "Dt", "2023A": "Dt", "12-25": "Dt", "2024/12": "Nu", "12": "Nu", "A-1": "Ca", "Some words": "En", "12 kg": "NE", "é": "Sg", "One, two": "Ot", "Aa, bb, cc, dd": "Tx", "Ab, " * 12: "Lx"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.k for r in df.select("t", layout.cell_kind(F.col("t")).alias("k")).collect()} == want


def test_many_queries_against_all_pairs(spark):
    import numpy as np

    from cairnflow.operators import ranking

    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(60, 5)).round(3).tolist() + [[0.0] * 5, None]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, vectors[k]) for k in (0, 7, 60)] + [(99, None)], "query_id long, vector array<double>")
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in enumerate(vectors) if v is not None}
    want = set()
    for q in (0, 7, 60):
        best = sorted((-round(float(unit[q] @ u), 9) + 0.0, i) for i, u in unit.items())[:4]
        want |= {(q, i, round(-s, 6) + 0.0) for s, i in best}
    for block in (1, 1000):
        got = ranking.vector_topk_many(rows, asked, 4, query_block=block).collect()
        assert {(r.query_id, r.id, round(r.sim, 6) + 0.0) for r in got} == want
    assert ranking.vector_topk_many(rows.limit(0), asked, 4).count() == 0


def test_damaged_files_never_fail(spark):
    from cairnflow.sources import parsers

    files = [("a.json", b"[" * 100_000), ("b.docx", b"PK\x03\x04 broken"), ("c.html", b"<![foo[ <p>x"), ("d.xlsx", b""), ("e.txt", b"fine\n\nhere")]
    df = spark.createDataFrame(files, "path string, content binary")
    assert {r.path for r in parsers.parsed(df).collect()} >= {"e.txt"}


def test_sections_keep_digits_at_their_ends(spark):
    from cairnflow.operators import chunking

    df = spark.createDataFrame([(1, "0 first 0\n\n 1 second 1\n\n2")], "id long, t string")
    assert [r.section for r in chunking.sections(df, "id", "t").orderBy("pos").collect()] == ["0 first 0", "1 second 1", "2"]


def test_overlap_against_a_loop(spark):
    def plain(parts, budget, percent):
        out, n = [], 0
        for x in parts:
            size = len("\n" + x) // 4
            if out and n <= budget * (100 - percent) / 100:
                out[-1] += "\n" + x
                n += size
            else:
                out.append((out[-1][int(len(out[-1]) * (100 - percent) / 100) :] if out and percent else "") + "\n" + x)
                n = size
        return out

    rnd = random.Random(7)
    rows = [[rnd.choice("abcd") * 4 * rnd.randint(1, 9) + "xyz" for _ in range(rnd.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "i int, p array<string>")
    for percent in (0, 10, 35):
        got = {r.i: r.c for r in df.select("i", chunking.merged_sections(F.col("p"), 12, percent).alias("c")).collect()}
        assert got == {k: plain(r, 12, percent) for k, r in enumerate(rows)}


def test_suppression_takes_many_pages_at_once(spark):
    """Pages come as Arrow batches; lone boxes, null pages and pages over several batches are kept as by the plain rule."""
    rnd = random.Random(13)
    rows = [(rnd.choice([None, *range(40)]) if k % 2 else 1000 + k, k, rnd.uniform(0, 50), rnd.uniform(60, 90), rnd.uniform(0, 50), rnd.uniform(60, 90), rnd.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, x1 double, top double, bottom double, score double")
    out = layout.suppressed(df, ["page"])
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = set()
    for page in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == page]
        want |= {own[k][1] for k in layout.kept_boxes(np.array([r[2:6] for r in own]), np.array([r[6] for r in own]), 0.2)}
    assert {r.id for r in out.collect()} == want and len(want) < 400


def test_vectors_by_slices(spark):
    """A task that takes few rows at a time keeps the same best ones, ties over slices by id, and sends on no more than these."""
    rnd = random.Random(12)
    kinds = [[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(6)]
    data = [(k, rnd.choice(kinds)) for k in rnd.sample(range(1000), 200)]
    rows = spark.createDataFrame(data, "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(k, v) for k, v in enumerate(kinds)], "query_id long, vector array<double>")
    out = ranking.vector_topk_many(rows, asked, 40, slice_rows=7)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((-round(r.sim, 9), r.id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in sorted((-cos(v, e), i) for i, e in data)[:40]] for q, v in enumerate(kinds)}


def plain_terms(tokens):
    """Short runs taken off the front of the list, one at a time."""
    import re

    short = lambda t: len(t) == 1 or re.fullmatch("[0-9a-z]{1,2}", t)
    out, rest = [], list(tokens)
    if len(rest) > 1 and short(rest[0]) and len(rest[1]) > 1 and not re.match("[0-9a-zA-Z]", rest[1]):
        out, rest = [" ".join(rest[:2])], rest[2:]
    while rest:
        run = 0
        while run < len(rest) and short(rest[run]) and rest[run] not in weights.STOP_WORDS:
            run += 1
        take = max(1, run if run < 5 else 2)
        out.append(" ".join(rest[:take]))
        rest = rest[take:]
    return out


def test_merged_terms_against_a_loop(spark):
    rnd = random.Random(9)
    words = ["a", "b1", "7", "word", "中", "书", "的", "中文", "A", "Ab", "x9"]
    rows = [[rnd.choice(words[:3] if k % 3 else words) for _ in range(rnd.randint(0, 13))] for k in range(300)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "i int, t array<string>")
    got = {r.i: r.m for r in df.select("i", weights.merged_terms(F.col("t")).alias("m")).collect()}
    assert got == {k: plain_terms(r) for k, r in enumerate(rows)}


def test_merged_terms_of_long_rows(spark):
    """Four times the tokens take about four times as long, not sixteen times."""
    rnd = random.Random(10)
    row = [rnd.choice(["a", "b1", "word", "other", "中", "的"]) for _ in range(100_000)]
    df = spark.createDataFrame([(0, row)], "i int, t array<string>")

    def took(n):
        began = time.time()
        got = df.select(weights.merged_terms(F.slice("t", 1, n)).alias("m")).first().m
        return time.time() - began, got

    took(25_000)
    few, _ = took(25_000)
    many, got = took(100_000)
    assert many < 8 * few + 2, (few, many)
    assert got == plain_terms_fast(row)


def plain_terms_fast(tokens):
    """``plain_terms`` of tokens of which the first doesn't join the second, by places."""
    out, at = [], 0
    short = lambda t: len(t) == 1 or re.fullmatch("[0-9a-z]{1,2}", t)
    while at < len(tokens):
        run = 0
        while run < 6 and at + run < len(tokens) and short(tokens[at + run]) and tokens[at + run] not in weights.STOP_WORDS:
            run += 1
        take = max(1, run if run < 5 else 2)
        out.append(" ".join(tokens[at : at + take]))
        at += take
    return out


def test_kept_and_joined_tokens(spark):
    df = spark.createDataFrame([(["的", "7", "77", "", "_x", "\\y", "ok", "中", "书"],)], "t array<string>")
    assert df.select(weights.kept_tokens(F.col("t"))).first()[0] == ["77", "ok", "书"]
    assert df.select(weights.kept_tokens(F.col("t"), True, False)).first()[0] == ["的", "7", "77", "ok", "中", "书"]
    joined = lambda t, *w: one(spark, weights.joined_latin(F.col("v"), *w), t)
    assert joined("big data 中文 a1 of  it") == ["big data", "中文", "a1", "of it"] and joined("big of it", ["of"]) == ["big", "of", "it"] and joined(None) == [] and joined(" ") == []
    assert [one(spark, weights.tag_weight(F.col("v")), t) for t in ("r", "ns", "n", "12", "v")] == [0.3, 3.0, 2.0, 2.0, 1.0]
    assert one(spark, text.without_urls(F.col("v")), "see https://a.b/c?d=1 now") == "see  now"
    assert retrieval.query_string("big www.x.org", {"big": ["large", " "]}) == '(big^1.0000 "large"^0.2500)'


def test_overfetch(spark):
    df = spark.createDataFrame([(k, "x" * k, 1 - k / 100) for k in range(20)], "id int, t string, sim double")
    assert [r.id for r in ranking.overfetched(df, lambda t: F.length(t), "t", 2).collect()] == [5, 4]


def test_graph_search(spark):
    from cairnflow.plans import graph_search

    kinds = "id string, knowledge_graph_kwd string, entity_name_kwd string, entity_type_kwd string, target_entity_kwd string, content_with_weight string, pagerank_flt double, embedding array<float>"
    rows = [("1", "entity", "Acme", "ORG", None, "a firm", 1.0, [1.0, 0.0]), ("2", "entity", "Bob", "PERSON", None, "a man", 0.5, [0.0, 1.0]), ("3", "entity", "Zed", "PLACE", None, "", None, None)]
    rows += [("4", "relation", "acme", None, "bob", "hires", 0.2, [1.0, 0.0]), ("5", "relation", "bob", None, "zed", "lives in", 0.1, [-1.0, 0.0]), ("6", None, None, None, None, "text", None, [1.0, 0.0])]
    df = schema.as_chunks(spark.createDataFrame(rows, kinds))
    hits = graph_search.search(df, [1.0, 0.0], ["person"])
    assert [(r.name, round(r.score, 3)) for r in hits.entities.orderBy(F.desc("score")).collect()] == [("Acme", 1.0), ("Bob", 0.25)]
    assert [(r.source, round(r.sim, 3)) for r in hits.relations.orderBy(F.desc("score")).collect()] == [("acme", 1.0), ("bob", 0.0)]
    assert {(r.seed, r.key, r.hop) for r in hits.paths.collect()} >= {("acme", "bob", 1), ("acme", "zed", 2), ("bob", "acme", 1)}
    assert hits.context.first()[0].startswith("Acme|ORG|1.000|a firm")
    assert graph_search.search(df, None, []).entities.count() == 0


def test_question_forms_and_captions(spark):
    df = spark.createDataFrame([(["x", "QUESTION 4 why"],), (["1. so", "第二问 x"],), (["none"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(chunking.question_family(F.col("l"))).collect()] == [10, 0, -1, -1, -1]
    assert [one(spark, text.is_caption(F.col("v")), t) for t in ("图 1: x", "表面", None)] == [True, False, False]
    assert one(spark, text.is_caption(F.col("v"), F.lit("figure caption")), "x")


def test_folders_totals_and_deletes(spark):
    df = spark.createDataFrame([("a", "/x"), ("b", "/x/y"), ("c", "/xy"), ("d", None)], "id string, folder string")
    assert {r.id: r.folder for r in filters.moved_folder(df, "x/", "/z/w").collect()} == {"a": "/z/w", "b": "/z/w/y", "c": "/xy", "d": None}
    assert {r.id for r in filters.deleted_where(df, F.col("folder") == "/x").collect()} == {"b", "c", "d"}
    assert {(r.id, r.total) for r in filters.with_total(df).collect()} == {(k, 4) for k in "abcd"}


def test_graph_save_and_load(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "A", None)], "key string, name string, pagerank double"), spark.createDataFrame([("a", "b", "x")], "src string, dst string, description string")
    graph.save(nodes, edges, f"file://{tmp_path}/g")
    got = graph.load(spark, f"file://{tmp_path}/g", "key string, name string, pagerank double")
    assert got[0].collect() == nodes.collect() and got[1].collect() == edges.collect()


def test_upsert_ties_do_not_follow_the_order_of_rows(spark):
    old = spark.createDataFrame([(1, "o", 1)], "id long, v string, seq int")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 2)], "id long, v string, seq int")
    for rows in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert [r.v for r in filters.upserted(old, rows.coalesce(1)).collect()] == ["a"]


def test_topk_sorts_no_texts(spark, tmp_path):
    """What the k best of all tasks meet by in one task are ids and scores; the rows are the same as by a plain sort."""
    rows = [(f"{k:03d}", [float(k % 7 - 3), 1.0], "text " * k) for k in range(50)] + [("x", None, "no vector")]
    spark.createDataFrame(rows, "id string, embedding array<float>, body string").write.parquet(f"{tmp_path}/t")
    got = ranking.vector_topk(spark.read.parquet(f"{tmp_path}/t"), [1.0, 0.0], 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "TakeOrderedAndProject" in line]
    assert sorts and not any("body" in line or "embedding" in line.split("orderBy")[0] for line in sorts)
    plain = sorted(rows, key=lambda r: (-(r[1][0] / (r[1][0] ** 2 + 1) ** 0.5 if r[1] else 0.0), r[0]))[:9]
    assert sorted((r.id, r.body) for r in got.collect()) == sorted((r[0], r[2]) for r in plain)
