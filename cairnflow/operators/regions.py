"""Tables and figures of documents: regions that go on over pages, their captions, and their places among the text.

Which regions go on is told by windows. Nearest regions and texts are found a document at a time (``pages.per_group``), by
distances in numpy; no pairs leave a task. All steps are by document, so boxes are shuffled once, or not at all where they lie by it. ``boxes`` have (page, n, x0, x1, top, bottom, text, layoutno, layout_type, mean_height): ``n`` is
the unique place in the document, ``top`` and ``bottom`` run on over its pages, ``mean_height`` is that of the page. Null texts and
layouts count as empty; documents without regions keep their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import vectors
from .pages import floats, per_group, schema_of

#: How a line that names a source begins, layouts behind which a table does not go on, and how many mean heights a gap may have.
SOURCE = r"^(数据|资料|图表)*来源[:： ]"
STOPS = ["table caption", "title", "figure caption", "reference"]
MOST_GAP = 23


def with_regions(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` with ``region``, null for text: the place of the first box of its table or figure.

    Boxes of one page and layout are a region. A table goes on in the next one from above if that is on the next page, the gap from the last
    box to its first is small and no caption, title or reference came after it. Lines of tables and figures that name a source are dropped.
    """
    kind, words = F.coalesce("layout_type", F.lit("")), F.coalesce("text", F.lit(""))
    inside = kind.isin("table", "figure") & F.col("layoutno").isNotNull()
    t = boxes.withColumn("_own", F.when(inside & ~words.rlike(SOURCE), F.struct(F.col("page").alias("page"), F.col("layoutno").alias("no"), kind.alias("kind"))))
    stopping = F.col("layoutno").isNotNull() & (texts.is_caption(words, kind) | kind.isin(STOPS))
    after = Window.partitionBy(*keys).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    stop, goes = (F.last(F.when(x, F.col("n")), ignorenulls=True).over(after) for x in (stopping, F.col("_own").isNotNull()))
    t = t.withColumn("_stops", F.coalesce(stop <= F.coalesce(goes, stop), F.lit(False))).where(~inside | F.col("_own").isNotNull())
    region, box = Window.partitionBy(*keys, "_own"), F.struct("n", "x0", "top", "bottom", "mean_height")
    t = t.withColumns({"_first": F.min_by(box, "n").over(region), "_last": F.max_by(box, "n").over(region), "_stopped": F.max("_stops").over(region)})
    t = t.withColumn("_head", F.when(F.col("n") == F.col("_first.n"), F.col("_own.kind")))  # regions by their first boxes
    w = Window.partitionBy(*keys, "_head").orderBy("_first.top", "_first.x0", "_first.n")
    t = t.withColumn("_prev", F.lag(F.struct("_own.page", F.col("_last").alias("last"), F.col("_stopped").alias("stopped"))).over(w))
    near = vectors.below(F.col("_prev.last"), F.col("_first")) <= F.col("_first.mean_height") * MOST_GAP
    goes_on = (F.col("_head") == "table") & ~F.col("_prev.stopped") & (F.col("_own.page") - F.col("_prev.page") == 1) & near
    begins = F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("_first.n"))
    t = t.withColumn("_begins", begins).withColumn("_root", F.when(F.col("_head").isNotNull(), F.last("_begins", ignorenulls=True).over(w)))
    t = t.withColumn("region", F.when(F.col("_own").isNotNull(), F.max("_root").over(region)).cast("long"))
    return t.select(*boxes.drop("region").columns, "region")


def _nearest(at: dict[str, np.ndarray], of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each box of ``at`` the region of the nearest one of ``of``, the first of several, and its squared distance: of the middles down
    the page; across it none where both overlap, else of facing edges or middles. Without any the region is -1, infinitely far."""
    region, found = np.full(len(at["mid"]), -1), np.full(len(at["mid"]), np.inf)
    x0, x1, mid = of["x0"], of["x1"], of["mid"]
    if len(mid):
        for i, (a0, a1, am) in enumerate(zip(at["x0"], at["x1"], at["mid"], strict=True)):
            far = np.minimum(np.minimum(np.abs(a1 - x0), np.abs(a0 - x1)), np.abs(a0 + a1 - x0 - x1) / 2)
            d = (mid - am) ** 2 + np.where((a1 < x0) | (a0 > x1), far, 0.0) ** 2
            k = int(d.argmin())
            region[i], found[i] = of["region"][k], d[k]
    return region, found


def captioned(doc: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The region of each box of a document (-1 for none) and whether it is there as a caption. Captions are put to the region of the nearest
    box: to a figure, unless a table is nearer. Without any region they stay text."""
    region, inside = doc["region"].copy(), doc["region"] >= 0
    lone = np.flatnonzero(doc["caption"] & ~inside)
    if len(lone) and inside.any():
        at = {c: doc[c][lone] for c in ("x0", "x1", "mid")}
        (table, dt), (figure, df) = (
            _nearest(at, {c: doc[c][of] for c in ("x0", "x1", "mid", "region")})
            for kind in ("table", "figure")
            for of in [np.flatnonzero(inside & doc[kind])]
            for of in [of[np.lexsort((doc["n"][of], doc["region"][of]))]]
        )
        region[lone] = np.where(dt < df, table, figure)
    return region, ~inside & (region >= 0)


def placed(doc: dict[str, np.ndarray], region: np.ndarray) -> np.ndarray:
    """The item of each box of a document: the order of texts and regions from 0. A region stands before or, where that ends above it,
    behind the text nearest to one of its boxes of pages; regions at one text are in order from above."""
    inside = np.flatnonzero(region >= 0)
    said = np.flatnonzero(region < 0)
    said = said[np.argsort(doc["n"][said], kind="stable")]
    t0, t1, tt, tb, tn = (doc[c][said] for c in ("x0", "x1", "top", "bottom", "n"))
    spans: dict[int, dict[int, list[float]]] = {}
    for r, page, x0, x1, top, bottom in zip(region[inside].tolist(), *(doc[c][inside].tolist() for c in ("page", "x0", "x1", "top", "bottom")), strict=True):
        b = spans.setdefault(r, {}).setdefault(page, [x0, x1, top, bottom])
        b[:] = min(b[0], x0), max(b[1], x1), min(b[2], top), max(b[3], bottom)
    keys = [(n, 1, 0.0, 0.0, 0) for n in tn.tolist()]
    of = {}
    for r, own in spans.items():
        first = own[min(own)]
        side, anchor = 0, -1
        if len(said):
            d = np.full(len(said), np.inf)
            for x0, x1, top, bottom in own.values():
                wide = np.maximum(np.maximum(t0 - x1, x0 - t1), 0.0)
                high = np.maximum(np.maximum(tt - bottom, top - tb), 0.0)
                d = np.minimum(d, wide**2 + high**2)
            k = int(d.argmin())
            anchor, side = int(tn[k]), 2 if tb[k] < first[2] else 0
        of[r] = (anchor, side, first[2], first[0], r)
    order = {key: i for i, key in enumerate(sorted([*keys, *of.values()]))}
    return np.array([order[of[r]] if r >= 0 else order[(n, 1, 0.0, 0.0, 0)] for r, n in zip(region.tolist(), doc["n"].tolist(), strict=True)], np.int32)


def _in_order(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """``rows`` of whole documents, which begin at ``starts``, with the regions of captions, ``role`` and ``item``."""
    x0, x1, top, bottom = floats(rows, "x0", "x1", "top", "bottom")
    kind = pc.fill_null(rows.column("layout_type").combine_chunks(), "")
    one = lambda c, rest: pc.fill_null(rows.column(c).combine_chunks(), rest).to_numpy(zero_copy_only=False)
    all_ = {"x0": x0, "x1": x1, "top": top, "bottom": bottom, "mid": (top + bottom) / 2, "n": one("n", -1), "page": one("page", -1), "region": one("region", -1), "caption": one("caption", False)}
    all_ |= {k: pc.equal(kind, k).to_numpy(zero_copy_only=False) for k in ("table", "figure")}
    region, caption, item = np.empty(rows.num_rows, np.int64), np.empty(rows.num_rows, bool), np.empty(rows.num_rows, np.int32)
    for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):
        doc = {c: v[i:j] for c, v in all_.items()}
        region[i:j], caption[i:j] = captioned(doc)
        item[i:j] = placed(doc, region[i:j])
    role = np.where(caption, "caption", np.where(region >= 0, "member", "text"))
    at = rows.schema.get_field_index("region")
    out = rows.set_column(at, rows.field(at), pa.array(region, rows.field(at).type, mask=region < 0))
    return out.append_column("role", pa.array(role.tolist(), pa.string())).append_column("item", pa.array(item, pa.int32()))


def _with_captions(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("caption", texts.is_caption(F.coalesce("text", F.lit("")), F.coalesce("layout_type", F.lit(""))))


def in_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` of ``with_regions`` with ``region`` set for captions too, ``role`` (text, member, caption) and ``item``, the order of texts
    and regions of their document from 0."""
    cols = [*boxes.columns, "role", "item"]
    return per_group(_with_captions(boxes), keys, ["n"], lambda rows, starts: _in_order(rows, starts).select(cols), schema_of(boxes, "role string", "item int"), 0)


def _items(rows: pa.Table, starts: np.ndarray, keys: list[str]) -> pa.Table:
    """The items of ``rows`` of whole documents, which begin at ``starts``: texts are joined and boxes drawn together for all of them at once."""
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    item, n, page = (pc.fill_null(rows.column(c), -1).to_numpy() for c in ("item", "n", "page"))
    role, layout = rows.column("role"), rows.column("layout_type")
    caption = pc.equal(role, "caption").to_numpy()

    def begins(*by: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in by], axis=0)))

    def listed(at: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)

    order = np.lexsort((np.where(caption, -n, n), ~caption, item, doc))
    first = begins(doc[order], item[order])
    said = pc.binary_join(listed(first, pc.fill_null(rows.column("text").combine_chunks(), "").take(pa.array(order))), "\n")
    kinds = pa.array(sorted(pc.unique(layout).drop_null().to_pylist()), pa.string())
    rank = np.where(pc.equal(role, "member").to_numpy(), pc.fill_null(pc.index_in(layout, value_set=kinds), -1).to_numpy(), -1)
    kind = pa.concat_arrays([pa.array(["text"]), kinds]).take(pa.array(np.maximum.reduceat(rank[order], first) + 1))

    order = np.lexsort((page, item, doc))
    doc, item, page, rows = doc[order], item[order], page[order], rows.take(pa.array(order))
    on = begins(doc, item, page)
    edges = {"x0": "min", "x1": "max", "top": "min", "bottom": "max"}
    of = pa.array(np.repeat(np.arange(len(on)), np.diff(np.append(on, len(order)))))
    drawn = rows.append_column("_on", of).group_by("_on", use_threads=False).aggregate(list(edges.items()))
    columns = [rows.column("page").take(pa.array(on)), *[drawn.column(f"{c}_{f}") for c, f in edges.items()]]
    boxes = pa.StructArray.from_arrays([c.combine_chunks() for c in columns], ["page", *edges])
    first = begins(doc[on], item[on])
    out = rows.select([*keys, "item"]).take(pa.array(on[first]))
    return out.append_column("kind", kind).append_column("text", said).append_column("pages", listed(first, boxes))


def items(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, kind, text, pages) of ``in_order``, or of ``with_regions`` in that order: one row per text and region. A region's text are
    its captions, the last first, and its boxes in order, by line feeds; ``pages`` are its boxes (page, x0, x1, top, bottom) page by page."""
    box = ["page", "x0", "x1", "top", "bottom"]
    ordered = {"role", "item"} <= set(boxes.columns)
    boxes = boxes.select(*keys, *box, "n", "text", "layout_type", *(["role", "item"] if ordered else ["region"]))
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "item int", "kind string", "text string", f"pages array<struct<{', '.join(f'{c}: {kinds[c]}' for c in box)}>>"])
    if ordered:
        return per_group(boxes, keys, ["n"], lambda rows, starts: _items(rows, starts, keys), schema, 0)
    return per_group(_with_captions(boxes), keys, ["n"], lambda rows, starts: _items(_in_order(rows, starts), starts, keys), schema, 0)
