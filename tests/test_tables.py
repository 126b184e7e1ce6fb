"""Tables with spans: small ones in full, and lone cells against a plain grid."""

import random
import re

from cairnflow.operators import layout, tables

BAND = "page long, kind string, band_id int, x0 double, x1 double, top double, bottom double"
CELL = "page long, id long, x0 double, x1 double, top double, bottom double, text string"


def grid(rows, columns, head=(), spans=()):
    out = [(1, "header" if r in head else "row", r, 0.0, 50.0 * columns, 20.0 * r, 20.0 * r + 19) for r in range(rows)]
    out += [(1, "column", 100 + c, 50.0 * c, 50.0 * c + 49, 0.0, 20.0 * rows) for c in range(columns)]
    return out + [(1, "span", 200 + k, *map(float, s)) for k, s in enumerate(spans)]


def cell(i, r, c, text, wide=40):
    return (1, i, 50.0 * c + 3, 50.0 * c + 3 + wide, 20.0 * r + 3, 20.0 * r + 13, text)


def html_of(spark, cells, bands, captions=None):
    cap = spark.createDataFrame(captions, "page long, caption string") if captions else None
    rows = tables.table_html(spark.createDataFrame(cells, CELL), spark.createDataFrame(bands, BAND), ["page"], cap).collect()
    return rows[0].html if rows else None


def test_spans_headers_and_captions(spark):
    cells = [cell(1, 0, 0, "Name"), cell(2, 0, 1, "Sales", 90), cell(3, 1, 0, "a"), cell(4, 1, 1, "1"), cell(5, 1, 2, "2"), cell(6, 2, 0, "b"), cell(7, 2, 2, None)]
    bands = grid(3, 3, head=(0,), spans=[(50, 149, 0, 19)])
    assert html_of(spark, cells, bands, [(1, "Cap")]) == (
        "<table><caption>Cap</caption><tr><th>Name</th><th colspan=2>Sales</th></tr><tr><td>a</td><td>1</td><td>2</td></tr><tr><td>b</td><td></td><td></td></tr></table>"
    )
    down = [cell(1, 0, 0, "x"), cell(2, 0, 1, "y"), cell(3, 1, 1, "z")]
    assert html_of(spark, down, grid(2, 2, spans=[(0, 49, 0, 39)])) == "<table><tr><td rowspan=2>x</td><td>y</td></tr><tr><td>z</td></tr></table>"


def test_repeated_header_rows(spark):
    cells = [cell(r * 2 + c, r, c, t) for r, row in enumerate([("h", "g"), ("1", "2"), ("h", "g"), ("h", "new")]) for c, t in enumerate(row)]
    assert html_of(spark, cells, grid(4, 2, head=(0, 2, 3))) == "<table><tr><th>h</th><th>g</th></tr><tr><td>1</td><td>2</td></tr><tr><th>h</th><th>new</th></tr></table>"


def test_number_tables_have_word_headers(spark):
    cells = [cell(r * 2 + c, r, c, t) for r, row in enumerate([("year", "sum"), ("1", "2"), ("3", "4")]) for c, t in enumerate(row)]
    assert html_of(spark, cells, grid(3, 2)).startswith("<table><tr><th>year</th><th>sum</th></tr><tr><td>1</td>")


def test_aligned_bands(spark):
    rows = [(1, "row", k, 10.0 + k, 90.0 - k, 0.0, 1.0) for k in range(3)] + [(1, "column", 9, 0.0, 1.0, 5.0, 50.0), (1, "column", 10, 0.0, 1.0, 7.0, 60.0), (1, "span", 11, 3.0, 4.0, 5.0, 6.0)]
    got = {r.band_id: (r.x0, r.x1, r.top, r.bottom) for r in tables.aligned_bands(spark.createDataFrame(rows, BAND), ["page"]).collect()}
    assert {got[k][:2] for k in range(3)} == {(10, 90)} and got[9][2:] == got[10][2:] == (5, 60) and got[11] == (3, 4, 5, 6)
    many = [(1, "row", k, float(k), 90.0 + k, 0.0, 1.0) for k in range(5)]
    got = {r.band_id: (r.x0, r.x1) for r in tables.aligned_bands(spark.createDataFrame(many, BAND), ["page"]).collect()}
    assert got == {0: (0, 92), 1: (1, 92), 2: (2, 92), 3: (2, 93), 4: (2, 94)}


def plain_moved(cells):
    """The rule on a grid of lists, columns first."""
    n_rows, n_columns = (max(c[k] for c in cells) + 1 for k in ("rn", "cn"))
    table = [[[c for c in cells if (c["rn"], c["cn"]) == (r, k)] for k in range(n_columns)] for r in range(n_rows)]

    def squeeze(table, low, high):
        j = 0
        while j < len(table):
            held = [i for i, x in enumerate(table[j]) if x]
            if len(held) != 1:
                j += 1
                continue
            i = held[0]
            text = lambda k: any(c["text"] for c in table[k][i])
            left, right = j == 0 or text(j - 1), j + 1 == len(table) or text(j + 1)
            if left and right:
                j += 1
                continue
            box = table[j][i][0]
            a = min([box[low] - c[high] for x in table[j - 1] for c in x], default=1e5) if not left else 1e5
            b = min([c[low] - box[high] for x in table[j + 1] for c in x], default=1e5) if not right else 1e5
            table[j - 1 if a < b else j + 1][i].extend(table[j][i])
            table.pop(j)
        return table

    turn = lambda t: [list(x) for x in zip(*t, strict=True)]
    if n_rows >= 4:
        table = turn(squeeze(turn(table), "x0", "x1"))
    if len(table[0]) >= 4:
        table = squeeze(table, "top", "bottom")
    return {c["id"]: (r, k) for r, row in enumerate(table) for k, x in enumerate(row) for c in x}


def test_lone_cells_against_a_grid(spark):
    rnd = random.Random(2)
    moved = 0
    for _ in range(200):
        rows, columns = rnd.randint(3, 6), rnd.randint(2, 6)
        places = sorted({(rnd.randrange(rows), rnd.randrange(columns)) for _ in range(rnd.randint(4, 14))})
        rank = [{v: n for n, v in enumerate(sorted({p[k] for p in places}))} for k in (0, 1)]
        cells = [{"id": i, "rn": rank[0][r], "cn": rank[1][c], "x0": 50.0 * c + rnd.randint(0, 9), "x1": 50.0 * c + 30 + rnd.randint(0, 9), "top": 20.0 * r, "bottom": 20.0 * r + 9 + rnd.random(), "text": rnd.choice(["x", "y", ""])} for i, (r, c) in enumerate(places)]
        want = plain_moved(cells)
        got = {c["id"]: (c["rn"], c["cn"]) for c in tables.lone_moved([dict(c) for c in cells])}
        assert got == want
        moved += got != {c["id"]: (c["rn"], c["cn"]) for c in cells}
    assert moved > 20


def test_lone_cells_in_tables(spark):
    cells = [cell(r * 4 + c, r, c, "x") for r in range(4) for c in (0, 1, 3) if (r, c) != (2, 1)] + [cell(99, 2, 2, "lone")]
    out = html_of(spark, cells, grid(4, 4))
    assert out.count("lone") == 1 and "<tr><td>x</td><td>lone</td><td>x</td></tr>" in out


def exchanges_of(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_cells_are_shuffled_by_their_table_only(spark):
    """Bands, header rows and spans are windows by table: neither cells nor bands are dealt by cell, row or place."""
    cells = spark.createDataFrame([cell(1, 0, 0, "x"), cell(2, 0, 1, "y"), cell(3, 1, 1, "z")], CELL)
    bands = spark.createDataFrame(grid(2, 2, head=(0,), spans=[(0, 49, 0, 39)]), BAND)
    placed = tables.in_bands(cells, bands, ["page"])
    out = tables.spanned(tables.with_heads(placed, ["page"]), ["page"])
    found = exchanges_of(out)
    assert 1 <= len(found) <= 4 and all(re.match(r"page#[0-9]+L?, [0-9]+$", x) for x in found), found
    assert sorted((r.rn, r.cn, r.rowspan, r.colspan, r.text, r.heads) for r in out.collect()) == [(0, 0, 2, 1, "x", [0]), (0, 1, 1, 1, "y", [0]), (1, 1, 1, 1, "z", [0])]


def test_empty(spark):
    assert html_of(spark, [], grid(2, 2)) is None


def test_sorts_of_a_grid_are_dealt_by_its_rows(spark, monkeypatch):
    """More cells are more tasks, not larger ones."""
    cells = spark.createDataFrame([(k // 4, 50.0 * (k % 2), 20.0 * (k // 2 % 2), f"t{k}") for k in range(400)], "page long, x0 double, top double, text string")
    monkeypatch.setattr("cairnflow.shared.TASK_ROWS", 40)
    out = layout.table_grid(cells, ["page"], 5, 5)
    assert [x.split(", ")[1] for x in exchanges_of(out)] == ["10"]
    assert {r.html for r in layout.table_html(out.where("page = 3"), ["page"]).collect()} == {"<table><tr><th>t12</th><th>t13</th></tr><tr><td>t14</td><td>t15</td></tr></table>"}
