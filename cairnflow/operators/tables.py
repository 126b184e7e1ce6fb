"""Tables from their cells and the bands of rows and columns that a recogniser found: aligned bands, cells in bands, lone cells moved, header
rows, spans, and HTML with rowspan and colspan.

Bands (keys, band_id, kind, x0, x1, top, bottom) are of kind ``row``, ``header`` (a row as well), ``column`` or ``span``. All but moving
lone cells is joins and aggregates by table; that is a fold over one table at a time. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..shared import tasks_of
from . import layout
from .pages import per_group, schema_of

#: Least shared part of a cell that puts it into a band, and the least numbers of rows and columns with lone cells moved.
LEAST_SHARED, LEAST_LINES = 0.3, 4


def aligned_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """``bands`` with rows drawn out to a common left and right (the mean of more than four, else the outermost), columns to a
    common top and bottom (the median of more than four)."""
    group = F.when(F.col("kind").isin("row", "header"), "r").when(F.col("kind") == "column", "c").otherwise("s")
    w = Window.partitionBy(*keys, group)
    many = F.count("*").over(w) > 4

    def drawn(name: str, mean, outer, better, kind: str) -> Column:
        common = F.when(many, mean(name).over(w)).otherwise(outer(name).over(w))
        return F.when(group == kind, better(F.col(name), common)).otherwise(F.col(name)).alias(name)

    edges = {
        "x0": drawn("x0", F.avg, F.min, F.least, "r"), "x1": drawn("x1", F.avg, F.max, F.greatest, "r"),
        "top": drawn("top", F.median, F.min, F.least, "c"), "bottom": drawn("bottom", F.median, F.max, F.greatest, "c"),
    }
    return bands.select(*[edges.get(c, F.col(c)) for c in bands.columns])


def _bands_of(bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bands): the bands of a table as one array."""
    return bands.groupBy(*keys).agg(F.collect_list(F.struct("band_id", "kind", "x0", "x1", "top", "bottom")).alias("bands"))


def _best(bands: Column, low: str, high: str, tight: bool) -> Column:
    """(name, low, high) of the band that holds most of a cell's extent between ``low`` and ``high`` (at least ``LEAST_SHARED``), else of the
    one whose middle is nearest; or of the one of which an edge or the middle is nearest (``tight``)."""

    def ranked(b: Column) -> Column:
        far = F.abs(F.col(low) + F.col(high) - b[low] - b[high]) / 2
        own = (b["band_id"].alias("name"), b[low].alias("low"), b[high].alias("high"))
        if tight:
            return F.struct(F.least(F.abs(F.col(low) - b[low]), F.abs(F.col(high) - b[high]), far).alias("e"), *own)
        shared = F.greatest(F.least(high, b[high]) - F.greatest(low, b[low]), F.lit(0.0)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
        return F.struct((-F.when(shared >= LEAST_SHARED, shared).otherwise(0.0)).alias("s"), far.alias("f"), *own)

    return F.array_min(F.transform(bands, ranked))


def _most_covering(bands: Column) -> Column:
    """The band that covers the largest share of a cell, at least ``LEAST_SHARED``; of equal ones that with the smallest id."""
    box = F.struct("x0", "x1", "top", "bottom")
    ranked = F.transform(bands, lambda b: F.struct((-vectors.overlap_share(box, b)).alias("s"), b["band_id"].alias("id"), F.struct(b["x0"], b["x1"], b["top"], b["bottom"]).alias("box")))
    return F.array_min(F.filter(ranked, lambda r: r["s"] <= -LEAST_SHARED))


def in_bands(cells: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` (keys, id, x0, x1, top, bottom, text) with ``rn`` and ``cn``, the places of their row and column among those in
    use, the edges of these, ``H`` (in a header) and ``SP`` (the span they are in, with its edges). A cell is in the row that holds most of
    its height and in the column that fits it best; every table needs a row and a column. Cells are shuffled once, by their table: its bands
    come to each of them as one array."""
    of = lambda *kinds: F.filter("bands", lambda b: b["kind"].isin(*kinds))
    n = tasks_of(cells)
    out = cells.repartition(n, *keys).join(_bands_of(bands, keys).repartition(n, *keys), keys)
    out = out.select(
        *cells.columns, _best(of("row", "header"), "top", "bottom", False).alias("_r"), _best(of("column"), "x0", "x1", True).alias("_c"),
        _most_covering(of("header")).isNotNull().alias("H"), _most_covering(of("span")).alias("_s"),
    ).where("_r is not null and _c is not null")
    edges = [F.col(f"_{k.lower()}.{e}").alias(f"{k}_{e}" if e != "name" else k) for k in "RC" for e in ("name", "low", "high")]
    span = F.when(F.col("_s").isNotNull(), F.struct(*[F.col(f"_s.box.{e}").alias(e) for e in ("x0", "x1", "top", "bottom")])).alias("span")
    others = [c for c in cells.columns if c != "text"]
    out = out.select(*others, F.coalesce("text", F.lit("")).alias("text"), *edges, "H", F.col("_s.id").alias("SP"), span)
    rows, columns = Window.partitionBy(*keys).orderBy("R_low", "R"), Window.partitionBy(*keys).orderBy("C_low", "C")
    return out.withColumns({"rn": F.dense_rank().over(rows) - 1, "cn": F.dense_rank().over(columns) - 1})


def lone_moved(cells: list[dict]) -> list[dict]:
    """Cells of a table with ``rn`` and ``cn``: where there are four rows or more, a column's only cell moves to the nearer
    neighbouring column, unless its row has cells on both sides; likewise a row's only cell where there are four columns or more.
    From the left and the top, each on what the moves before left."""

    def pass_over(line: str, across: str, low: str, high: str) -> None:
        lines: list[list[tuple[int, dict]]] = [[] for _ in range(max(c[line] for c in cells) + 1)]
        for k, c in enumerate(cells):
            lines[c[line]].append((k, c))
        at, moved = 0, False
        while at < len(lines):
            own = lines[at]
            place = own[0][1][across] if own else None
            if any(c[across] != place for _, c in own):
                at += 1
                continue
            text = lambda k: any(c["text"] for _, c in lines[k] if c[across] == place)
            before, behind = at == 0 or text(at - 1), at + 1 >= len(lines) or text(at + 1)
            if before and behind:
                at += 1
                continue
            gap_before = min((own[0][1][low] - c[high] for _, c in lines[at - 1]), default=1e5) if not before else 1e5
            gap_behind = min((c[low] - own[0][1][high] for _, c in lines[at + 1]), default=1e5) if not behind else 1e5
            first = at if behind or (not before and gap_before < gap_behind) else at + 1
            lines[first - 1] = sorted(lines[first - 1] + lines.pop(first), key=lambda x: x[0])
            moved = True
        if moved:
            for k, held in enumerate(lines):
                for _, c in held:
                    c[line] = k

    rows, columns = (max(c[k] for c in cells) + 1 for k in ("rn", "cn"))
    if rows >= LEAST_LINES:
        pass_over("cn", "rn", "x0", "x1")
        columns = max(c["cn"] for c in cells) + 1
    if columns >= LEAST_LINES:
        pass_over("rn", "cn", "top", "bottom")
    return cells


def without_lone_cells(cells: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """``cells`` with new ``rn`` and ``cn`` (see ``lone_moved``)."""

    def fold(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        names = ["rn", "cn", "x0", "x1", "top", "bottom", "text"]
        light = [dict(zip(names, r, strict=True)) for r in zip(*[rows.column(c).to_pylist() for c in names], strict=True)]
        for i, j in zip(starts, [*starts[1:], len(light)], strict=True):
            lone_moved(light[i:j])
        for c in ("rn", "cn"):
            at = rows.schema.get_field_index(c)
            rows = rows.set_column(at, rows.field(at), pa.array([x[c] for x in light], rows.field(at).type))
        return rows

    flat = cells.withColumns({f"span_{e}": F.col(f"span.{e}") for e in ("x0", "x1", "top", "bottom")}).drop("span")
    out = per_group(flat, keys, ["rn", "cn", "id"], fold, schema_of(flat), tasks)
    edges = ("x0", "x1", "top", "bottom")
    return out.withColumn("span", F.when(F.col("SP").isNotNull(), F.struct(*[F.col(f"span_{e}").alias(e) for e in edges]))).drop(*[f"span_{e}" for e in edges])


def with_heads(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with ``heads``, the rows of their table most of whose cells are headers: marked so, or no numbers in a table mostly of numbers."""
    of = lambda *more: Window.partitionBy(*keys, *more)
    out = cells.withColumn("_kind", layout.cell_kind(F.col("text"))).withColumn("_held", F.count("*").over(of("_kind")))
    out = out.withColumn("_usual", F.max(F.struct("_held", "_kind")).over(of())["_kind"])
    out = out.withColumn("_place", F.row_number().over(of("rn", "cn").orderBy("top", "x0", "id"))).withColumn("_marked", F.max("H").over(of("rn", "cn")))
    numbers, number = F.col("_usual") == "Nu", F.col("_kind") == "Nu"
    head = ~(numbers & number) & (F.col("_marked") | (numbers & ~number))
    out = out.withColumn("_share", F.avg(F.when(F.col("_place") == 1, head.cast("int"))).over(of("rn")))
    return out.withColumn("heads", F.collect_set(F.when(F.col("_share") > 0.5, F.col("rn"))).over(of())).drop("_kind", "_held", "_usual", "_place", "_marked", "_share")


def spanned(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rn, cn, text, rowspan, colspan, heads): the grid of cells ``with_heads`` with each span as one entry at its first row and column. A span
    covers the rows and columns whose middles it holds and those of its cells; texts in it are joined from the left and the top. Where spans
    overlap, that with the smallest id takes the entry. All steps are windows by table over the cells, so these are shuffled once at most."""
    of = lambda *more: Window.partitionBy(*keys, *more)
    middle = lambda line, name: (F.avg(f"{name}_low").over(of(line)) + F.avg(f"{name}_high").over(of(line))) / 2
    out = cells.withColumn("_mid_r", middle("rn", "R")).withColumn("_mid_c", middle("cn", "C")).drop("R", "R_low", "R_high", "C", "C_low", "C_high", "H")
    own = [f(c).over(of("SP")).alias(n) for f, c, n in ((F.min, "rn", "r0"), (F.max, "rn", "r1"), (F.min, "cn", "c0"), (F.max, "cn", "c1"))]
    out = out.withColumn("_own", F.when(F.col("SP").isNotNull(), F.struct(F.col("SP").alias("id"), *own, "span"))).drop("SP", "span")
    has = F.max(F.col("_own").isNotNull()).over(of())
    lines = lambda line: F.collect_set(F.when(F.col("_has"), F.struct(F.col(f"_mid_{line[0]}").alias("mid"), F.col(line).alias("at")))).over(of())
    out = out.withColumn("_has", has).withColumns({"_rows": lines("rn"), "_columns": lines("cn"), "_spans": F.collect_set("_own").over(of())}).drop("_own", "_has")

    def whole(s: Column) -> Column:
        held = lambda name, low, high: F.transform(F.filter(name, lambda x: x["mid"].between(s["span"][low], s["span"][high])), lambda x: x["at"])
        rows, columns = held("_rows", "top", "bottom"), held("_columns", "x0", "x1")
        return F.struct(
            s["id"].alias("id"), F.least(s["r0"], F.array_min(rows)).alias("r0"), F.greatest(s["r1"], F.array_max(rows)).alias("r1"),
            F.least(s["c0"], F.array_min(columns)).alias("c0"), F.greatest(s["c1"], F.array_max(columns)).alias("c1"),
        )

    holds = lambda s: ((s["r1"] > s["r0"]) | (s["c1"] > s["c0"])) & F.col("rn").between(s["r0"], s["r1"]) & F.col("cn").between(s["c0"], s["c1"])
    entry = F.struct("rn", "cn", "top", "x0", "id", "text").alias("t")
    held = out.select(*keys, "rn", "cn", "heads", entry, F.array_min(F.filter(F.transform("_spans", whole), holds)).alias("s"))
    at = lambda c, own: F.coalesce(F.col(f"s.{c}"), F.col(own))
    size = lambda a, b: F.coalesce(F.col(f"s.{b}") - F.col(f"s.{a}") + 1, F.lit(1))
    held = held.select(*keys, at("r0", "rn").alias("rn"), at("c0", "cn").alias("cn"), size("r0", "r1").alias("rowspan"), size("c0", "c1").alias("colspan"), "heads", "t")
    grid = held.groupBy(*keys, "rn", "cn").agg(F.max("rowspan").alias("rowspan"), F.max("colspan").alias("colspan"), F.first("heads").alias("heads"), F.sort_array(F.collect_list("t")).alias("t"))
    return grid.withColumn("text", F.array_join(F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != ""), " ")).drop("t")


def _filled(items: Column, at: str, part: str, n: Column, empty: Column) -> Column:
    """The parts of sorted ``items`` joined, ``empty`` for each place from 0 to ``n`` that has none."""
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(items, k - 1)[at])
    filled = F.transform(items, lambda x, k: F.concat(F.repeat(empty, (x[at] - before(k) - 1).cast("int")), x[part]))
    return F.concat(F.array_join(filled, ""), F.repeat(empty, (n - 1 - F.element_at(items, -1)[at]).cast("int")))


def html(grid: DataFrame, keys: list[str], captions: DataFrame | None = None) -> DataFrame:
    """(keys, html) of ``spanned`` cells. Places without a cell are empty cells, places covered by a span are left out; a header
    row whose texts all stood in header rows above is left out; ``captions`` (keys, caption) go in front."""
    whole = Window.partitionBy(*keys)
    grid = grid.withColumns({"n_rows": F.max(F.col("rn") + F.col("rowspan")).over(whole), "n_columns": F.max(F.col("cn") + F.col("colspan")).over(whole)})
    to = lambda c, n: F.explode(F.sequence(F.col(c), F.col(c) + F.col(n) - 1))
    sizes = ["heads", "n_rows", "n_columns"]
    places = grid.select(*keys, *sizes, F.col("rn").alias("r0"), "cn", "rowspan", "colspan", "text", to("rn", "rowspan").alias("rn"))
    places = places.select(*keys, *sizes, "rn", "r0", F.col("cn").alias("c0"), "rowspan", "colspan", "text", to("cn", "colspan").alias("cn"))
    own = (F.col("rn") == F.col("r0")) & (F.col("cn") == F.col("c0"))
    first = [F.first(c).alias(c) for c in sizes]
    places = places.groupBy(*keys, "rn", "cn").agg(*first, F.max(~own).alias("covered"), F.max(F.when(own, F.struct("text", "rowspan", "colspan"))).alias("own"))
    row = places.groupBy(*keys, "rn").agg(*first, F.sort_array(F.collect_list(F.struct("cn", "covered", "own"))).alias("cells"))
    row = row.withColumns({"head": F.array_contains("heads", F.col("rn")), "texts": F.transform(F.filter("cells", lambda x: ~x["covered"]), lambda x: x["own"]["text"])}).drop("heads")
    tag = F.when(F.col("head"), "th").otherwise("td")
    attribute = lambda x, c: F.when(x["own"][c] > 1, F.concat(F.lit(f" {c}="), x["own"][c])).otherwise("")
    cell = lambda x: F.concat(F.lit("<"), tag, attribute(x, "colspan"), attribute(x, "rowspan"), F.lit(">"), F.coalesce(x["own"]["text"], F.lit("")), F.lit("</"), tag, F.lit(">"))
    row = row.withColumn("cells", F.transform("cells", lambda x: F.struct(x["cn"].alias("cn"), F.when(x["covered"], "").otherwise(cell(x)).alias("cell"))))
    above = whole.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    row = row.withColumn("seen", F.flatten(F.collect_list(F.when(F.col("head"), F.col("texts"))).over(above)))
    none = F.size("texts") == 0  # all covered, unless there are empty places
    dropped = (F.col("head") & (F.size(F.array_except("texts", "seen")) == 0)) | (none & (F.size("cells") == F.col("n_columns")))
    tr = F.concat(F.lit("<tr>"), _filled(F.col("cells"), "cn", "cell", F.col("n_columns"), F.concat(F.lit("<"), tag, F.lit("></"), tag, F.lit(">"))), F.lit("</tr>"))
    row = row.select(*keys, "n_rows", "n_columns", "rn", F.when(dropped, "").otherwise(tr).alias("tr"))
    body = row.groupBy(*keys).agg(F.first("n_rows").alias("n_rows"), F.first("n_columns").alias("n_columns"), F.sort_array(F.collect_list(F.struct("rn", "tr"))).alias("rows"))
    front = F.lit("<table>")
    if captions is not None:
        body = body.join(captions, keys, "left")
        front = F.concat(front, F.coalesce(F.concat(F.lit("<caption>"), "caption", F.lit("</caption>")), F.lit("")))
    empty = F.concat(F.lit("<tr>"), F.repeat(F.lit("<td></td>"), F.col("n_columns").cast("int")), F.lit("</tr>"))
    rows = _filled(F.col("rows"), "rn", "tr", F.col("n_rows"), empty)
    return body.select(*keys, F.concat(front, rows, F.lit("</table>")).alias("html"))


def table_html(cells: DataFrame, bands: DataFrame, keys: list[str], captions: DataFrame | None = None) -> DataFrame:
    """(keys, html): all of the above in order."""
    placed = without_lone_cells(in_bands(cells, aligned_bands(bands, keys), keys), keys, tasks_of(cells))
    return html(spanned(with_heads(placed, keys), keys), keys, captions)
