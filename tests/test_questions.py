"""Questions rewritten by a model: answers that lack fields, failures, each question asked once, a second try, the graph's row."""

import pathlib

from pyspark.sql import functions as F

from cairnflow.plans import questions


def test_rewritten(spark, tmp_path):
    def factory():
        def rewrite(q):
            with open(pathlib.Path(tmp_path) / "asked", "a") as f:
                f.write(q + "\n")
            if "bad" in q.lower():
                raise RuntimeError("no answer")
            return {"full": {"target_types": ["person", None], "entities": ["Ada", 7], "keywords": ["k"], "intent": "i"}, "odd": {"entities": "Ada", "intent": None}, "list": ["x"]}.get(q, {})

        return rewrite

    rows = [(1, "full"), (2, "odd"), (3, " list"), (4, "bad  one"), (5, "Bad  one "), (6, "plain two words"), (7, None), (8, "plain two words"), (9, "FULL")]
    df = spark.createDataFrame(rows, "query_id long, text string")
    got = {r.query_id: (r.target_types, r.entities, r.keywords, r.intent, r.error) for r in questions.rewritten(df, factory).collect()}
    assert got[2] == ([], [], ["odd"], "odd", None) and got[6] == got[8] == ([], [], ["plain", "two", "words"], "plain two words", None)
    assert got[1][:2] == ([], []) and got[7] == ([], [], [], "", None)  # of "full" and "FULL" the first by code points is asked
    assert got[4] == ([], ["bad  one"], ["bad", "one"], "bad  one", "RuntimeError: no answer") and got[5][1] == ["Bad  one"]
    assert got[3][1] == ["list"] and got[3][4] == "TypeError: the answer is no dict"
    one = questions.rewritten(df.where("query_id = 1"), factory).first()
    assert (one.target_types, one.entities, one.keywords, one.intent) == (["PERSON"], ["Ada", "7"], ["k"], "i")
    asked = (tmp_path / "asked").read_text().splitlines()
    assert sorted(asked[:-1]) == sorted(["FULL", "odd", "list", "Bad  one", "plain two words", ""]) and asked[-1] == "full"


def test_enhanced_and_asked_again(spark):
    def factory():
        def rewrite(q):
            if q == "bad":
                raise ValueError("x")
            return {"keywords": [q], "translated": [q[::-1]] if q != "none" else []}

        return rewrite

    df = spark.createDataFrame([(1, "abc"), (2, "x"), (3, " bad "), (4, "none"), (5, ""), (6, "fed")], "query_id long, text string")
    got = {r.query_id: (r.keywords, r.translated, r.enhanced_text, r.error) for r in questions.enhanced(df, factory).collect()}
    assert got[1] == (["abc"], ["cba"], "abc cba", None) and got[2] == ([], [], "x", None) and got[5] == ([], [], "", None)
    assert got[3] == ([], [], "bad", "ValueError: x") and got[4] == (["none"], [], "none", None)
    rows = spark.createDataFrame([(10, "abc"), (11, "def")], "id long, word string")
    ask = lambda q: q.join(rows, q.text.contains(rows.word)).select("query_id", "id")
    hits = questions.asked_again(df, ask, factory).collect()
    assert sorted(map(tuple, hits)) == [(1, 10, 1), (6, 11, 2)]


def test_with_graph(spark):
    hits = spark.createDataFrame([("a", "text", 1.0, "x")], "id string, content_with_weight string, sim double, more string")
    context = spark.createDataFrame([("facts",)], "context string")
    got = questions.with_graph(hits, context).orderBy(F.desc("is_graph_context"), F.desc("sim")).collect()
    assert [(r.id, r.content_with_weight, r.sim, r.more, r.is_graph_context) for r in got] == [("graph_context", "facts", 1.0, None, True), ("a", "text", 1.0, "x", False)]
    assert questions.with_graph(hits, context.withColumn("context", F.lit(" \n"))).count() == 1
