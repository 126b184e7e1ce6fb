"""Strategies for manuals and papers."""

from cairnflow.operators import chunking


def test_manual_and_paper(spark):
    long = "word " * 400
    rows = [
        ("m", 0, "Section 1", "text", "manual"), ("m", 1, "Article 1", "text", "manual"), ("m", 2, f"first {long}", "text", "manual"), ("m", 3, "Article 2", "text", "manual"), ("m", 4, f"second {long}", "text", "manual"),
        ("m", 5, "<table>", "table", "manual"), ("plain", 0, "no heading", "text", "manual"),
        ("p", 0, " A paper ", "Title@@1", "paper"), ("p", 1, "short", "abstract@@2", "paper"), ("p", 2, "body", None, "paper"), ("p", 3, "[1] x", "reference@@3", "paper"), ("p", 4, "page 1", "footer", "paper"), ("p", 5, "7", "header @@4", "paper"), ("p", 6, "  ", "title", "paper"),
        ("n", 0, "head", "title@@1", "naive"),
    ]
    df = spark.createDataFrame(rows, "name string, pos int, section string, tag string, strategy string")
    got = {(r.name, r.kind, r.pos): r.chunk for r in chunking.chunked(df, "name", "pos", "section", "tag", "strategy").collect()}
    assert got.pop(("m", "table", 0)) == "<table>" and got.pop(("plain", "text", 0)) == "\nno heading"
    assert got.pop(("p", "text", 0)) == "\n[TITLE] A paper\n[ABSTRACT] short\nbody" and got.pop(("n", "text", 0)) == "\nhead"
    lines = ["Section 1", "Article 1", f"first {long.strip()}", "Article 2", f"second {long.strip()}"]
    family = next(k for k, f in enumerate(chunking.BULLETS) if f[0].startswith("PART"))
    assert [got[k] for k in sorted(got)] == chunking.packed_paths(chunking.hierarchy_paths(lines, family, 2)) and len(got) == 2
