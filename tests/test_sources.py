"""Parsers, the chunk store and streaming ingest."""

import io
import zipfile

import pytest

from cairnflow.sources import parsers
from cairnflow.sources.store import ChunkStore
from cairnflow.streaming import ingest


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_X", ".x"), body)
    return out.getvalue()


def texts(path, data):
    return [(k, t, g) for k, t, g in parsers.parse(path, data)]


def test_text_and_codecs():
    assert texts("a/b.txt", b"one\n \n\ntwo\nlines\n\n\nthree") == [("section", "one", "text"), ("section", "two\nlines", "text"), ("section", "three", "text")]
    assert parsers.decoded("zwölf".encode("cp1252")) and parsers.decoded("中文".encode("gb18030")) == "中文"
    assert texts("x.unknown", b"plain") == [("section", "plain", "text")]
    assert texts("x.docx", b"no zip") == [] and texts("x.json", b"{") == []


def test_html():
    page = b"<body><nav>menu</nav><h1>Title</h1><div><p>One <b>bold</b></p></div><table><tr><td>c</td></tr></table><script>x()</script></body>"
    assert texts("p.html", page) == [("table", "<table><tr><td>c</td></tr></table>", "table"), ("section", "Title", "title"), ("section", "Onebold", "text"), ("section", "Onebold", "text")]
    assert texts("p.html", b"bare text") == [("section", "bare text", "text")]


def test_json():
    assert [t for _, t, _ in texts("a.json", b'{"a": {"b": [1, {"c": null}]}, "d": "x"}')] == ["a.b[0]: 1", "a.b[1].c: None", "d: x"]
    assert [t for _, t, _ in texts("a.jsonl", b'{"a": 1}\nbad\n{"a": 2}')] == ["a: 1", "a: 2"]


def test_markdown():
    got = texts("m.md", b"lead\n# A\nbody\n\n## empty\n### B\n| t |\n")
    assert got == [("section", "lead", "title"), ("section", "A\nbody", "text"), ("section", "B\n| t |", "text")]


def test_office_files():
    w = 'xmlns:w="http://w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert texts("d.docx", zipped(word__document_Xml=doc)) == [("section", "Head", "title"), ("section", "ab", "text"), ("table", "<table><tr><th>h</th></tr></table>", "table")]
    slide = '<p:sld xmlns:p="http://p" xmlns:a="http://a"><a:p><a:r><a:t>line</a:t></a:r></a:p><a:p/></p:sld>'
    assert texts("s.pptx", zipped(ppt__slides__slide1_Xml=slide, ppt__slides__slide10_Xml=slide, ppt__slides__slide2_Xml=slide))[2] == ("section", "line", "slide_3")
    sheet = '<worksheet xmlns="http://x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns="http://x"><sheets><sheet name="Data"/></sheets></workbook>'
    shared = '<sst xmlns="http://x"><si><t>name</t></si></sst>'
    got = texts("t.xlsx", zipped(xl__worksheets__sheet1_Xml=sheet, xl__workbook_Xml=book, xl__sharedStrings_Xml=shared))
    assert got[0][1] == "<table><caption>Data</caption><tr><th>name</th><th></th><th>7</th></tr></table>" and got[1][1] == "[Data]\nname |  | 7"
    assert [t for _, t, _ in texts("b.epub", zipped(b_Xhtml="<p>two</p>", a_Xhtml="<p>one</p>"))] == ["one", "two"]


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"{tmp_path}/store")


def test_store(spark, store):
    assert store.create("a", "Base A", "/x") and not store.create("a") and store.create("b")
    store.merge_meta("a", k=1)
    store.merge_meta("a", m=2)
    assert store.meta("a") == {"k": 1, "m": 2} and store.exists("a") and not store.exists("z")
    row = lambda i, t: spark.createDataFrame([(i, t, "doc")], "id string, content_with_weight string, docnm_kwd string")
    store.upsert("a", row("1", "old").unionByName(row("2", "two")))
    store.upsert("a", row("1", "new").unionByName(row("1", "aaa")))
    assert {(r.id, r.content_with_weight, r.kb_id) for r in store.chunks(["a", "b"]).collect()} == {("1", "new", "a"), ("2", "two", "a")}
    assert {(r.kb_id, r.n) for r in store.counts().collect()} == {("a", 2), ("b", 0)}
    assert store.get("a", spark.createDataFrame([("2",), ("2",), ("9",)], "id string"), ["content_with_weight"]).collect()[0][1] == "two"
    assert store.delete("a", {"id": ["1"]}) == 1 and store.delete("a", {}) == 0
    assert store.drop("a") and not store.drop("a") and store.chunks(["a"]).count() == 0


def test_ingest(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("alpha beta\n\ngamma")
    for _ in range(2):  # the second finds nothing new
        ingest.ingest(spark, str(folder), store, "kb", f"{tmp_path}/cp").awaitTermination()
    (folder / "two.html").write_text("<p>delta</p><table><tr><td>x</td></tr></table>")
    ingest.ingest(spark, str(folder), store, "kb", f"{tmp_path}/cp").awaitTermination()
    got = {(r.docnm_kwd, r.doc_type_kwd, r.content_ltks) for r in store.chunks(["kb"]).collect()}
    assert got == {("one.txt", "text", "alpha beta gamma"), ("two.html", "text", "delta"), ("two.html", "table", "x")}


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "s", 2.0), ("2024-01-01 00:20:00", "s", 4.0), ("2024-01-01 05:00:00", "s", 1.0)], "ts string, stage string, ms double").selectExpr("cast(ts as timestamp) ts", "stage", "ms").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, stage string, ms double").parquet(f"{tmp_path}/e")
    q = ingest.stage_windows(stream, "ts", "stage", "ms").writeStream.format("memory").queryName("stage_w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.avg_ms, r.max_ms) for r in spark.table("stage_w").collect()) == [(1, 1.0, 1.0), (2, 3.0, 4.0)]


def test_few_files_at_a_time():
    """Sections leave before all files of a batch are parsed, and none is lost."""
    import pyarrow as pa

    paths = [f"{k}.txt" for k in range(500)]
    files = pa.RecordBatch.from_arrays([pa.array(paths), pa.array(["\n\n".join(f"line {k} {n}" for n in range(20)).encode() for k in range(500)])], names=["path", "content"])
    out = list(parsers.parsed_batches(iter([files, files.slice(0, 0)])))
    assert len(out) > 2 and max(b.num_rows for b in out) < 3000
    want = [(p, k, *s) for p, c in zip(paths, files.column(1).to_pylist(), strict=True) for k, s in enumerate(parsers.parse(p, c))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
