"""The stages on a small table against plain Python."""

import random

import corpus_pipeline
from cairnflow.llm import common, decontaminate, quality, simhash


def say(rnd, n):
    return " ".join(f"u{rnd.randrange(5000)}" for _ in range(n))


def make(spark):
    rnd = random.Random(11)
    shared = "\n".join(say(rnd, 9) for _ in range(4))
    items = [(k, say(rnd, 20)) for k in range(3)]
    rows = [(k, say(rnd, 80) + "\n" + say(rnd, 20), "en", "h1", 0) for k in range(20)]
    rows += [(20, "too short", "en", "h1", 0), (21, None, "en", "h1", 0), (22, "again and again " * 40, "en", "h1", 0)]
    rows += [(30 + k, say(rnd, 60) + "\n" + shared + "\n" + say(rnd, 10), "en", "h2", 0) for k in range(3)]
    long = say(rnd, 3000).split()
    rows += [(40, " ".join(long), "en", "h3", 0), (41, " ".join(long), "en", "h3", 0), (42, " ".join([*long[:2999], "end"]), "en", "h3", 0)]
    rows += [(40, " ".join(long), "en", "h3", 0)]
    rows += [(50, say(rnd, 70) + " " + items[1][1].upper() + ". " + say(rnd, 5), "en", "h4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_pipeline(spark, tmp_path):
    docs, items = make(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs.collect()
    step = common.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        step = common.written(out, "t")
        seen[name] = step.collect()
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in seen.items()}
    good = [r.doc_id for r in before if quality.base_counts(r.text)[0] >= 50 and 2 * quality.base_counts(r.text)[4] <= quality.base_counts(r.text)[0]]
    assert ids["quality_rules"] == sorted(good) == sorted([*range(20), 30, 31, 32, 40, 40, 41, 42, 50])
    assert ids["line_dedup"] == ids["quality_rules"]
    lines = {r.doc_id: r.text.split("\n") for r in seen["line_dedup"]}
    assert [len(lines[k]) for k in (30, 31, 32)] == [6, 2, 2]
    fps = {simhash.fingerprint(r.text) for r in seen["line_dedup"] if r.doc_id in (40, 41, 42)}
    assert max(bin(a ^ b).count("1") for a in fps for b in fps) <= 2
    assert ids["near_dedup"] == [*range(20), 30, 31, 32, 40, 50]
    leaks = {r.doc_id for r in decontaminate.find_items(docs, items).collect()}
    assert leaks == {50} and ids["decontamination"] == [*range(20), 30, 31, 32, 40]
    texts = {r.doc_id: r.text for r in seen["decontamination"]}
    assert {r.doc_id: r.text for r in seen["sentencepiece"]} == texts
    assert all(r.n_ids == len(r.ids) for r in seen["sentencepiece"])
    assert all(r.n_chars == len(r.text) for r in seen["sentencepiece"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(texts)


def test_pipeline_empty(spark, tmp_path):
    docs, items = make(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, extra columns with the names used inside, an empty benchmark."""
    docs, items = make(spark)
    names = "_id _host _digest _lines _gone _drop _kept _both ids n_ids decoded label stays copies i h g key".split()
    rows = docs.selectExpr("case when doc_id % 2 = 0 then null else doc_id end as doc_id", "text", "lang", "source", "n_chars", *(f"{k} as {c}" for k, c in enumerate(names)))
    rows.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*rows.columns, "n_ids_", "ids_"]
    got = out.collect()
    assert all(r[c] == k for r in got for k, c in enumerate(names))
    texts = [r.text for r in got]
    assert len(texts) == len(set(texts)) == 25  # one of each group of copies, leaks stay
    assert {r.doc_id for r in got} == {None, *range(1, 20, 2), 31, 41}


def test_pipeline_leaves_little_behind(spark, tmp_path):
    docs, items = make(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, tables = spark.conf.get(key), len(common._scratch)
    assert corpus_pipeline.run(spark, str(tmp_path)).count()
    assert spark.conf.get(key) == before and len(common._scratch) <= tables + len(corpus_pipeline.STAGES)
