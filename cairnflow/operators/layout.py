"""Page layout geometry: joins of boxes, merging of lines, suppression, table grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..shared import tasks_of
from .pages import per_group, schema_of

BOX = ("x0", "x1", "top", "bottom")


def _box(df: DataFrame, name: str, keys: list[str], id_col: str) -> DataFrame:
    return df.select(*keys, F.col(id_col).alias(f"{name}_id"), F.struct(*BOX).alias(name))


def overlap_join(boxes: DataFrame, regions: DataFrame, keys: list[str], box_id: str, region_id: str, least: float = 0.4) -> DataFrame:
    """(keys, box_id, region_id, share): for each box the region of its page that covers the largest share of it, at
    least ``least``. An equi-join on the page, so a page's boxes meet its own regions only."""
    a, b = _box(boxes, "box", keys, box_id), _box(regions, "region", keys, region_id)
    share = vectors.overlap_share(F.col("box"), F.col("region"))
    hits = a.join(b, keys).withColumn("share", share).where(F.col("share") >= least)
    best = hits.groupBy(*keys, "box_id").agg(F.max_by(F.struct("region_id", "share"), F.struct(F.col("share"), -F.col("region_id"))).alias("b"))
    return best.select(*keys, "box_id", "b.region_id", "b.share")


def nearest_join(boxes: DataFrame, targets: DataFrame, keys: list[str], box_id: str, target_id: str) -> DataFrame:
    """(keys, box_id, target_id, distance): for each box the nearest target of its page."""
    a, b = _box(boxes, "box", keys, box_id), _box(targets, "target", keys, target_id)
    hits = a.join(b, keys).withColumn("distance", vectors.box_distance(F.col("box"), F.col("target")))
    best = hits.groupBy(*keys, "box_id").agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return best.select(*keys, "box_id", "b.target_id", "b.distance")


def tolerance_order(top: Column, x0: Column, threshold: float) -> list[Column]:
    """Reading order: rows of ``threshold`` height from the top, then from the left."""
    return [F.floor(top / threshold), x0]


def kept_boxes(boxes: np.ndarray, scores: np.ndarray, most: float) -> list[int]:
    """Places of the boxes (x0, x1, top, bottom) that overlap no better one by more than ``most``."""
    area = (boxes[:, 1] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 2])
    left, kept = np.lexsort((boxes[:, 2], boxes[:, 0], -scores)), []
    while len(left):
        best, rest = left[0], left[1:]
        kept.append(int(best))
        wide = np.minimum(boxes[rest, 1], boxes[best, 1]) - np.maximum(boxes[rest, 0], boxes[best, 0])
        high = np.minimum(boxes[rest, 3], boxes[best, 3]) - np.maximum(boxes[rest, 2], boxes[best, 2])
        shared = wide.clip(min=0) * high.clip(min=0)
        left = rest[shared <= most * (area[rest] + area[best] - shared)]
    return kept


def suppressed(boxes: DataFrame, keys: list[str], score_col: str = "score", most: float = 0.2) -> DataFrame:
    """Non-maximum suppression within a page and class: boxes that overlap a better one by more than ``most`` go. Small
    groups come in one stream per partition, sorted by their keys; only one group is held at a time."""

    def fold(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        values = np.stack([rows.column(c).cast(pa.float64()).to_numpy() for c in BOX], axis=1)
        scores = rows.column(score_col).cast(pa.float64()).to_numpy()
        ends = np.append(starts[1:], rows.num_rows)
        kept = np.zeros(rows.num_rows, bool)
        alone = ends - starts == 1  # nothing to overlap
        kept[starts[alone]] = True
        for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            kept[[a + k for k in kept_boxes(values[a:b], scores[a:b], most)]] = True
        return rows.filter(pa.array(kept))

    return per_group(boxes, keys, [], fold, schema_of(boxes))


def page_offsets(pages: DataFrame, doc_col: str, page_col: str, height_col: str) -> DataFrame:
    """``pages`` with the height of all pages before."""
    w = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(height_col).over(w), F.lit(0.0)))


def table_grid(cells: DataFrame, keys: list[str], row_gap: float, column_gap: float) -> DataFrame:
    """``cells`` with the row and column that their tops and left edges fall in, from 0."""
    rows, cols = Window.partitionBy(*keys).orderBy("top"), Window.partitionBy(*keys).orderBy("x0")
    cells = cells.repartition(tasks_of(cells), *keys)  # tasks that grow with the cells sort no more of them
    new = lambda c, w, gap: F.coalesce((F.col(c) - F.lag(c).over(w) > gap).cast("int"), F.lit(0))
    t = cells.withColumns({"_r": new("top", rows, row_gap), "_c": new("x0", cols, column_gap)})
    return t.withColumns({"R": F.sum("_r").over(rows), "C": F.sum("_c").over(cols)}).drop("_r", "_c")


#: Forms of table cells, in the order in which they are tried.
CELL_FORMS = [
    ("^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    ("^(20|19)[0-9]{2}年$", "Dt"),
    ("^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    ("^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    ("^第*[一二三四1-4]季度$", "Dt"),
    ("^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    ("^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    ("^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    ("^[A-Z]*[a-z' -]+$", "En"),
    ("^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    ("^.{1}$", "Sg"),
]


def cell_kind(cell: Column, name_tagged: Column | None = None) -> Column:
    """Dt date, Nu number, Ca code, En words, NE mixed, Sg one character; else by the tokens of more than one character: Tx
    text of four to eleven, Lx of more, Nr a single one that a dictionary tags as a name (``name_tagged``), Ot the rest."""
    trimmed = F.trim(cell)
    n = F.size(F.filter(text.tokens(cell), lambda t: F.length(t) > 1))
    name = F.lit(False) if name_tagged is None else name_tagged
    rest = F.when(n >= 12, "Lx").when(n > 3, "Tx").when((n == 1) & name, "Nr").otherwise("Ot")
    out = F.when(trimmed.rlike(CELL_FORMS[0][0]), CELL_FORMS[0][1])
    for pattern, kind in CELL_FORMS[1:]:
        out = out.when(trimmed.rlike(pattern), kind)
    return out.otherwise(rest)


def table_html(cells: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, html) of cells with R and C; the first row is the header."""
    row = cells.groupBy(*keys, "R").agg(F.sort_array(F.collect_list(F.struct("C", F.col(text_col).alias("t")))).alias("cells"))
    td = lambda tag: F.array_join(F.transform("cells", lambda x: F.concat(F.lit(f"<{tag}>"), x["t"], F.lit(f"</{tag}>"))), "")
    row = row.select(*keys, "R", F.concat(F.lit("<tr>"), F.when(F.col("R") == 0, td("th")).otherwise(td("td")), F.lit("</tr>")).alias("tr"))
    items = F.sort_array(F.collect_list(F.struct("R", "tr")))
    return row.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(items, lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))
