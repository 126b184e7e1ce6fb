"""Given models: batches, failures as rows, odd answers; folder trees and hierarchies."""

from cairnflow.operators import folders, models


def test_embedded(spark):
    def factory():
        def embed(texts):
            assert len(texts) <= 3
            if any("bad" in t for t in texts):
                raise RuntimeError("no answer")
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    rows = [(k, "x" * k) for k in range(1, 8)] + [(8, None), (9, "  "), (10, "bad")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: r for r in models.embedded(df, "text", factory, batch=3).collect()}
    assert [got[k].embedding for k in (1, 7, 8, 9)] == [[1, 1], [7, 1], [1, 1], [1, 1]] and got[1].error is None
    assert got[10].embedding is None and got[10].error == "RuntimeError: no answer" and len(got) == 10
    short = models.embedded(df.where("id < 3"), "text", lambda: lambda texts: [[1.0]]).collect()
    assert {r.error for r in short} == {"ValueError: 1 vectors for 2 texts"}
    cut = models.embedded(spark.createDataFrame([(1, "y" * 100_000)], "id long, text string"), "text", lambda: lambda texts: [[len(t)] for t in texts]).first()
    assert cut.embedding == [4 * models.EMBEDDED_TOKENS]
    assert models.embedded(df.where("id < 0"), "text", factory).collect() == []


def test_hash_embedder():
    embed = models.hash_embedder(16)()
    a, b, none = embed(["One two", "one TWO", ""])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and none == [0.0] * 16


def test_extracted(spark):
    answers = {
        "a": {"entities": [{"name": " Ada ", "type": "person", "description": None}, {"name": ""}, "junk", {"type": "x"}, {"name": "B"}], "relations": [{"source": "Ada", "target": " B "}, {"source": "Ada"}]},
        "b": "no json", "c": {"entities": "no list"}, "d": None,
    }

    def factory():
        def extract(t):
            if t[0] == "e":
                raise KeyError("e")
            return answers[t[0]] | {"entities": answers[t[0]]["entities"]} if t[0] == "a" else answers[t[0]]

        return extract

    rows = [(k, c + " some text that is long enough") for k, c in enumerate("abcde")] + [(8, "a short one"), (9, None), (10, " " * 50)]
    found = models.extracted(spark.createDataFrame(rows, "id long, t string"), factory, "id", "t")
    assert {r.chunk_id: r.error for r in found.collect()} == {0: None, 1: None, 2: None, 3: None, 4: "KeyError: 'e'"}
    assert [(r.name, r.type, r.description, r.chunk_id, r.pos) for r in models.entities_of(found).orderBy("pos").collect()] == [("Ada", "PERSON", "", 0, 0), ("B", "OTHER", "", 0, 3)]
    assert [(r.source, r.target, r.description, r.chunk_id) for r in models.relations_of(found).collect()] == [("Ada", "B", "", 0)]


def test_folder_tree(spark):
    known = spark.createDataFrame([("/a",), ("/a/b/",), ("/x/y",)], "path string")
    bases = spark.createDataFrame([("/a/b", 5), ("/a", 2), ("/", 1), (None, None), ("/x/y", 9)], "folder string, n_rows long")
    rows = {r.path: r for r in folders.folder_tree(known, bases).collect()}
    assert set(rows) == {"/", "/a", "/a/b"}  # /x/y has no known parent
    assert [(r.parent, r.name, r.depth, r.n_bases, r.n_rows, r.all_bases, r.all_rows) for r in (rows["/"], rows["/a"], rows["/a/b"])] == [
        (None, "/", 0, 2, 1, 5, 17), ("/", "a", 1, 1, 2, 2, 7), ("/a", "b", 2, 1, 5, 1, 5)]
    empty = folders.folder_tree(known.limit(0), bases.limit(0)).collect()
    assert [(r.path, r.all_bases) for r in empty] == [("/", 0)]


def test_ancestors(spark):
    nodes = spark.createDataFrame([(1, None, "root"), (2, 1, "mid"), (3, 2, "leaf"), (4, 99, "alone")], "id long, parent long, name string")
    assert {r.id: r.names for r in folders.ancestors_of(nodes).collect()} == {1: ["root"], 2: ["mid", "root"], 3: ["leaf", "mid", "root"], 4: ["alone"]}


def test_walks_beyond_the_row_limit_of_recursive_queries(spark):
    nodes = spark.createDataFrame([(0, None, "root"), *[(k, (k - 1) // 3, f"n{k}") for k in range(1, 40)]], "id long, parent long, name string")
    known = spark.createDataFrame([(f"/a/b{k}",) for k in range(30)] + [("/a",)], "path string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        assert {r.id: len(r.names) for r in folders.ancestors_of(nodes).collect()} == {k: 1 + (k > 0) + (k > 3) + (k > 12) + (k > 39) for k in range(40)}
        assert folders.folder_tree(known, known.limit(0).selectExpr("path as folder", "0L as n_rows")).count() == 32
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
