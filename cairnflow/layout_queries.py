"""Registered queries of page reading: columns, merged lines, reading order, contents pages. Line items stand in for the boxes of pages
(four orders a page), document lines for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import levels, vectors
from .operators import aggregates, pages, regions, tables
from .registry import query
from .shared import table, tasks_of

#: The boxes of pages, in expressions that Spark and the SQL share.
_BOX = {
    "page": "cast(floor(l_orderkey / 4) as bigint)",
    "id": "cast(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as bigint)",
    "x0": "cast(40 + 190 * (l_suppkey % (1 + floor(l_orderkey / 4) % 3)) + l_partkey % 2 * 9 as double)",
    "x1": "cast(200 + 190 * (l_suppkey % (1 + floor(l_orderkey / 4) % 3)) + l_partkey % 5 * 20 as double)",
    "top": "cast(10 * (l_orderkey % 4 * 7 + l_linenumber) + l_partkey % 3 as double)",
    "bottom": "cast(10 * (l_orderkey % 4 * 7 + l_linenumber) + l_partkey % 3 + 6 + l_partkey % 7 as double)",
    "text": "case when l_partkey % 11 = 0 then '' else concat(' ', l_returnflag, l_linestatus, case l_partkey % 5 when 0 then '.' when 1 then ',' when 2 then '?' when 3 then ',”' else '' end, ' ') end",
    "layoutno": "case when l_suppkey % 17 = 0 then null else concat('text-', cast(l_orderkey % 2 as int)) end",
    "layout_type": "case when l_suppkey % 13 = 0 then 'table' else 'text' end",
}
_BOX_SQL = "b as (select " + ", ".join(f"{e} as {n}" for n, e in _BOX.items()) + " from lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _BOX.items()])


def _cuts_sql(name: str, source: str, ks: str) -> str:
    """CTE ``name``(page, val, c, k, run, n): the best runs of the values of ``source``(page, val) for the ``ks`` asked, all tried."""
    return f"""
  {name}_v as (select page, val, count(*) as c, row_number() over (partition by page order by val) as i, count(*) over (partition by page) as m, sum(count(*)) over (partition by page) as n from {source} group by page, val),
  {name}_m as (select v.*, mask, bit_count(mask::int)::int + 1 as k, bit_count((mask & ((1 << (i - 1)::int) - 1))::int) as run
    from {name}_v v, (select unnest(range(0, 1024)) as mask) where mask < (1 << (m - 1)::int) and bit_count(mask::int) < 4 and {ks}),
  {name}_s as (select page, k, mask, sum(cost) as sse from (
    select page, k, mask, run, sum(c * val * val) - sum(c * val) ** 2 / sum(c) as cost from {name}_m group by page, k, mask, run) group by page, k, mask),
  {name}_b as (select page, k, arg_min(mask, (round(sse, 6), mask)) as mask from {name}_s group by page, k),
  {name} as (select page, val, c, k, run, n from {name}_m join {name}_b using (page, k, mask))"""


_COLUMNS_SQL = f"""{_BOX_SQL},
  edge as (select page, min(x0) as l, max(x1) - min(x0) as w from b group by page),
  snapped as (select page, case when abs(x0 - l) < w * 0.12::double then l else x0 end as val from b join edge using (page)),
  {_cuts_sql("t", "snapped", "bit_count(mask::int) between 1 and least(4, m, n - 1) - 1")},
  far as (select x.page, x.k, x.val, x.c, x.run, x.n, y.run as other, sum(y.c * abs(x.val - y.val)) as total, sum(y.c) as size from t x join t y on x.page = y.page and x.k = y.k group by all),
  near as (
    select page, k, val, any_value(c) as c, any_value(n) as n, max(case when run = other then size end) as size,
      max(case when run = other then total / greatest(size - 1, 1) end) as own, min(case when run <> other then total / size end) as next from far group by page, k, val),
  score as (select page, k, round(sum(c * case when size > 1 then (next - own) / greatest(next, own, 1e-300::double) else 0 end) / any_value(n), 9) as score from near group by page, k),
  pick as (select page, coalesce(arg_max(k, (score, -k)) filter (where score > 0), 1) as chosen from (select distinct page from b) left join score using (page) group by page),
  raw as (select page, x0 as val, chosen from b join pick using (page)),
  {_cuts_sql("r", "(select page, val from raw)", "true")},
  col as (select r.page, r.val as x0, r.run::int as col_id from r join pick on r.page = pick.page and r.k = pick.chosen),
  n_col as (select page, max(col_id) + 1 as n_columns from col group by page)"""


@query("page_columns", f"""with {_COLUMNS_SQL}
select page, id, col_id, n_columns::int as n_columns, row_number() over (partition by page order by col_id, top, b.x0, id)::int as place from b join col using (page, x0) join n_col using (page)""")
def page_columns(spark, d):
    boxes = pages.with_columns(_boxes(spark, d).select("page", "id", "x0", "x1", "top"), ["page"])
    return pages.in_reading_order(boxes, [], "page", "id").select("page", "id", "col_id", "n_columns", "place")


@query("usual_columns", f"""with {_COLUMNS_SQL}, c as (select page % 5 as doc, n_columns, count(*) as n from n_col group by all)
select doc, arg_max(n_columns, (n, -n_columns))::int as n_columns from c group by doc""")
def usual_columns(spark, d):
    boxes = pages.with_columns(_boxes(spark, d).select("page", "x0", "x1"), ["page"])
    return pages.usual_columns(boxes.withColumn("doc", F.col("page") % 5), ["doc"], "page")


_STATE = "page, id, x0, x1, top, bottom, text, layoutno"
_LAST_SQL = f"select {_STATE} from (select *, row_number() over (partition by page, g order by n desc) as last from rec) where last = 1"


@query("horizontal_merge", f"""with recursive {_BOX_SQL},
s as (select *, floor(x0 / 190)::int as col_id, avg(bottom - top) over (partition by page) as mh, row_number() over (partition by page order by floor(x0 / 190), top, x0, id, text) as n from b),
rec as (
  select {_STATE}, col_id, layout_type, n, 1 as g from s where n = 1
  union all
  select r.page, case when j then r.id else s.id end, case when j then r.x0 else s.x0 end, s.x1, case when j then (r.top + s.top) / 2 else s.top end,
    case when j then (r.bottom + s.bottom) / 2 else s.bottom end, case when j then r.text || s.text else s.text end, s.layoutno, s.col_id, case when j then r.layout_type else s.layout_type end, s.n, case when j then r.g else r.g + 1 end
  from rec r join s on s.page = r.page and s.n = r.n + 1,
  lateral (select coalesce(r.col_id = s.col_id and r.layoutno = s.layoutno and r.layout_type <> 'table' and abs((s.top + s.bottom - r.top - r.bottom) / 2) < s.mh / 3, false) as j))
select {_STATE} from (select *, row_number() over (partition by page, g order by n desc) as last from rec) where last = 1""")
def horizontal_merge(spark, d):
    boxes = _boxes(spark, d).withColumn("col_id", F.floor(F.col("x0") / 190).cast("int"))
    out = pages.horizontal_merge(pages.with_mean_height(boxes, ["page"]), ["page"], ["col_id", "top", "x0", "id", "text"])
    return out.select(*_STATE.split(", "))


@query("vertical_merge", f"""with recursive {_BOX_SQL},
s as (select *, avg(bottom - top) over (partition by page) as mh, row_number() over (partition by page order by top, x0, id, text) as n from b),
rec as (
  select {_STATE}, n, 1 as g from s where n = 1
  union all
  select r.page, case when j then r.id else s.id end, case when j then least(r.x0, s.x0) else s.x0 end, case when j then greatest(r.x1, s.x1) else s.x1 end, case when j then r.top else s.top end,
    s.bottom, case when j then trim(rtrim(r.text) || ' ' || ltrim(s.text)) else s.text end, s.layoutno, s.n, case when j or trim(r.text) = '' then r.g else r.g + 1 end
  from rec r join s on s.page = r.page and s.n = r.n + 1,
  lateral (select trim(r.text) <> '' and r.layoutno is not distinct from s.layoutno and s.top - r.bottom <= 1.5::double * s.mh
    and greatest(0, least(r.x1, s.x1) - greatest(r.x0, s.x0)) / greatest(1, least(r.x1 - r.x0, s.x1 - s.x0)) >= 0.3::double
    and (right(trim(r.text), 1) in (',', ';', ':', '''', '"', '，', '、', '‘', '“', '；', '：', '-')
      or (length(trim(r.text)) > 1 and substr(trim(r.text), length(trim(r.text)) - 1, 1) in (',', ';', ':', '''', '"', '，', '‘', '“', '、', '；', '：'))
      or (trim(s.text) <> '' and left(trim(s.text), 1) in ('。', '；', '？', '！', '?', '”', '）', ')', ',', '，', '、', '：'))
      or not right(trim(r.text), 1) in ('。', '？', '！', '?', '.', '!')) as j))
{_LAST_SQL}""")
def vertical_merge(spark, d):
    out = pages.vertical_merge(pages.with_mean_height(_boxes(spark, d), ["page"]), ["page"], ["top", "x0", "id", "text"])
    return out.select(*_STATE.split(", "))


#: A heading and entries stand in front of some documents' own lines, with dotted lines in others.
_CONTENTS = """case doc_id % 4 when 0 then concat('Table of Contents', chr(10), chr(10), split_part(text, chr(10), 1), chr(10), 'more ... 2', chr(10), text)
  when 1 then concat('目 录', chr(10), split_part(text, chr(10), 1), chr(10), 'x··1', chr(10), 'y··2', chr(10), text)
  when 2 then concat('a··1', chr(10), 'b··2', chr(10), 'c··3', chr(10), 'd··4', chr(10), text) else text end"""


@query("without_contents", f"""with recursive
t as (select doc_id, string_split(t, chr(10)) as l from (select doc_id, {_CONTENTS} as t from documents where text is not null)),
l as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) as pos, floor((generate_subscripts(l, 1) - 1) / 20)::bigint as page from t),
h as (select *, regexp_matches(replace(replace(lower(text), ' ', ''), '　', ''), '^(contents|目录|目次|tableofcontents|致谢|acknowledge)$') as head,
  regexp_matches(trim(text), '^[0-9a-zA-Z :''.-]{{5,}}') as english from l),
n as (select a.doc_id, a.pos, a.english, (select min(b.pos) from l b where b.doc_id = a.doc_id and b.pos > a.pos and trim(b.text) <> '') as entry from h a where head),
p as (select n.*, case when english then array_to_string(list_filter(string_split_regex(l.text, '\\s+'), lambda x: x <> '')[1:2], ' ') else substr(trim(l.text), 1, 3) end as prefix
  from n left join l on l.doc_id = n.doc_id and l.pos = n.entry),
e as (select p.doc_id, p.pos, p.entry, (select min(b.pos) from l b where b.doc_id = p.doc_id and b.pos > p.entry and b.pos <= p.entry + 128 and starts_with(b.text, p.prefix)) as stop from p),
-- headings one after the other: the next is looked for behind what went with the last
w as (
  select doc_id, pos, coalesce(stop - 1, entry, 1000000000) as upto from e where pos = (select min(x.pos) from e x where x.doc_id = e.doc_id)
  union all
  select e.doc_id, e.pos, coalesce(e.stop - 1, e.entry, 1000000000) from w join e on e.doc_id = w.doc_id and e.pos = (select min(x.pos) from e x where x.doc_id = w.doc_id and x.pos > w.upto)),
d as (select doc_id, page from l where not exists (select 1 from w where w.doc_id = l.doc_id) group by doc_id, page having count(*) filter (where contains(text, '··')) > 3)
select doc_id, pos - 1 as pos, text from l
where not exists (select 1 from w where w.doc_id = l.doc_id and l.pos between w.pos and w.upto) and not exists (select 1 from d where d.doc_id = l.doc_id and d.page = l.page)""")
def without_contents(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.expr(_CONTENTS).alias("t"))
    lines = docs.select("doc_id", F.posexplode(F.split("t", "\n")).alias("pos", "text"))
    lines = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.floor(F.col("pos") / 20).alias("page"))
    return pages.without_contents(lines, ["doc_id"], ["pos"], "page").select("doc_id", "pos", "text")


# --- tables -----------------------------------------------------------------------------------------------------------

_CELL = {
    "page": "cast(floor(l_orderkey / 4) as bigint)",
    "id": "cast(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as bigint)",
    "x0": "cast(50 * (l_partkey % 5) + l_suppkey % 7 as double)",
    "x1": "cast(50 * (l_partkey % 5) + l_suppkey % 7 + 30 + l_partkey % 3 * 10 as double)",
    "top": "cast(14 * (l_linenumber % 6) + l_partkey % 4 as double)",
    "bottom": "cast(14 * (l_linenumber % 6) + l_partkey % 4 + 10 as double)",
    "text": "case when l_partkey % 3 = 0 then l_returnflag when l_partkey % 17 = 0 then '' else cast(cast(l_quantity as int) as string) end",
}
#: Six rows (the first a header on even pages), five columns, and a span of two columns and two rows on every third page.
_BAND = {
    "kind": "case when k < 6 then case when k = 0 and page % 2 = 0 then 'header' else 'row' end when k < 11 then 'column' else 'span' end",
    "band_id": "k",
    "x0": "cast(case when k < 6 then k when k < 11 then 50 * (k - 6) else 40 end as double)",
    "x1": "cast(case when k < 6 then 260 - k when k < 11 then 50 * (k - 6) + 48 else 160 end as double)",
    "top": "cast(case when k < 6 then 14 * k when k < 11 then k - 6 else 14 * (page % 4) end as double)",
    "bottom": "cast(case when k < 6 then 14 * k + 13 when k < 11 then 80 + k else 14 * (page % 4) + 28 end as double)",
}
_NAMED = lambda d: ", ".join(f"{e} as {n}" for n, e in d.items())
_TABLES_SQL = f"""
  c as (select {_NAMED(_CELL)} from lineitem),
  b0 as (select page, {_NAMED(_BAND)} from (select distinct page from c), (select unnest(range(0, 12)) as k) where k < 11 or page % 3 = 0),
  b as (
    select page, kind, band_id, case when kind in ('row', 'header') then least(x0, m.rl) else x0 end as x0, case when kind in ('row', 'header') then greatest(x1, m.rr) else x1 end as x1,
      case when kind = 'column' then least("top", m.ct) else "top" end as "top", case when kind = 'column' then greatest(bottom, m.cb) else bottom end as bottom
    from b0 join (select page, case when count(*) filter (where kind in ('row', 'header')) > 4 then avg(x0) filter (where kind in ('row', 'header')) else min(x0) filter (where kind in ('row', 'header')) end as rl,
      case when count(*) filter (where kind in ('row', 'header')) > 4 then avg(x1) filter (where kind in ('row', 'header')) else max(x1) filter (where kind in ('row', 'header')) end as rr,
      median("top") filter (where kind = 'column') as ct, median(bottom) filter (where kind = 'column') as cb from b0 group by page) m using (page)),
  r as (select c.page, c.id, b.band_id as "R", b."top" as r_low, b.bottom as r_high, row_number() over (partition by c.page, c.id order by
      case when greatest(least(c.bottom, b.bottom) - greatest(c."top", b."top"), 0) / (c.bottom - c."top") >= 0.3::double then -greatest(least(c.bottom, b.bottom) - greatest(c."top", b."top"), 0) / (c.bottom - c."top") else 0 end,
      abs(c."top" + c.bottom - b."top" - b.bottom), b.band_id) as n from c join b using (page) where kind in ('row', 'header')),
  k as (select c.page, c.id, b.band_id as "C", b.x0 as c_low, b.x1 as c_high, row_number() over (partition by c.page, c.id order by
      least(abs(c.x0 - b.x0), abs(c.x1 - b.x1), abs(c.x0 + c.x1 - b.x0 - b.x1) / 2), b.band_id) as n from c join b using (page) where kind = 'column'),
  o as (select c.page, c.id, kind, band_id, greatest(least(c.x1, b.x1) - greatest(c.x0, b.x0), 0) * greatest(least(c.bottom, b.bottom) - greatest(c."top", b."top"), 0) / ((c.x1 - c.x0) * (c.bottom - c."top")) as share
    from c join b using (page) where kind in ('header', 'span')),
  g as (select c.*, r_low, r_high, c_low, c_high, dense_rank() over (partition by c.page order by r_low, "R") - 1 as rn, dense_rank() over (partition by c.page order by c_low, "C") - 1 as cn,
      exists (select 1 from o where o.page = c.page and o.id = c.id and kind = 'header' and share >= 0.3::double) as "H",
      (select min(band_id) from o where o.page = c.page and o.id = c.id and kind = 'span' and share >= 0.3::double) as "SP"
    from c join r on r.page = c.page and r.id = c.id and r.n = 1 join k on k.page = c.page and k.id = c.id and k.n = 1)"""


def _table_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = table(spark, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _CELL.items()])
    bands = cells.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).where("k < 11 or page % 3 = 0")
    return cells, bands.selectExpr("page", *[f"{e} as {n}" for n, e in _BAND.items()])


@query("table_bands", f'with {_TABLES_SQL} select page, id, rn::int as rn, cn::int as cn, "H", "SP" from g')
def table_bands(spark, d):
    cells, bands = _table_cells(spark, d)
    return tables.in_bands(cells, tables.aligned_bands(bands, ["page"]), ["page"]).select("page", "id", "rn", "cn", "H", "SP")


@query("table_spans", f"""with {_TABLES_SQL},
s as (select page, "SP", min(rn) as r0, max(rn) as r1, min(cn) as c0, max(cn) as c1 from g where "SP" is not null group by all),
mr as (select page, rn, (avg(r_low) + avg(r_high)) / 2 as mid from g group by all), mc as (select page, cn, (avg(c_low) + avg(c_high)) / 2 as mid from g group by all),
w as (
  select s.page, least(r0, (select min(rn) from mr where mr.page = s.page and mid between b."top" and b.bottom)) as r0, greatest(r1, (select max(rn) from mr where mr.page = s.page and mid between b."top" and b.bottom)) as r1,
    least(c0, (select min(cn) from mc where mc.page = s.page and mid between b.x0 and b.x1)) as c0, greatest(c1, (select max(cn) from mc where mc.page = s.page and mid between b.x0 and b.x1)) as c1
  from s join b on b.page = s.page and b.band_id = s."SP"),
x as (select g.*, w.r0, w.r1, w.c0, w.c1 from g left join w on w.page = g.page and g.rn between w.r0 and w.r1 and g.cn between w.c0 and w.c1 and (w.r1 > w.r0 or w.c1 > w.c0)),
kk as (select page, id, rn, cn, "top", x0, "H", case when regexp_full_match(text, '[0-9.,+%/ -]+') then 'Nu' when regexp_full_match(text, '[0-9A-Z/._~-]+') then 'Ca' else 'Ot' end as kind from g),
u as (select page, arg_max(kind, (n, kind)) as usual from (select page, kind, count(*) as n from kk group by all) group by page),
h as (select page, rn from (
  select page, rn, cn, case when any_value(usual) = 'Nu' and arg_min(kind, ("top", x0, id)) = 'Nu' then 0 when bool_or("H") or (any_value(usual) = 'Nu' and arg_min(kind, ("top", x0, id)) <> 'Nu') then 1 else 0 end as head
  from kk join u using (page) group by page, rn, cn) group by page, rn having avg(head) > 0.5)
select x.page, first::int as rn, coalesce(c0, cn)::int as cn, coalesce(max(r1 - r0 + 1), 1)::int as rowspan, coalesce(max(c1 - c0 + 1), 1)::int as colspan,
  coalesce(string_agg(text, ' ' order by x.rn, cn, "top", x0, id) filter (where text <> ''), '') as text, coalesce(bool_or(h.rn is not null), false) as head
from (select *, coalesce(r0, rn) as first from x) x left join h on h.page = x.page and h.rn = x.first
group by x.page, first, coalesce(c0, cn)""")
def table_spans(spark, d):
    cells, bands = _table_cells(spark, d)
    placed = tables.in_bands(cells, tables.aligned_bands(bands, ["page"]), ["page"])
    grid = tables.spanned(tables.with_heads(placed, ["page"]), ["page"])
    return grid.select("page", "rn", "cn", "rowspan", "colspan", "text", F.array_contains("heads", F.col("rn")).alias("head"))


@query("table_html_spans")
def table_html_spans(spark, d):
    cells, bands = _table_cells(spark, d)
    return tables.table_html(cells, bands, ["page"])


# --- levels and points ------------------------------------------------------------------------------------------------

_PREFIX = "['第三章 ', '第十条', '二、', '（一）', '3. ', '1.2 ', '1.2.3 ', '1.2.3.4 ', '7）', '(8)', '九是', '•', '']"
_LEVELS_SQL = " ".join(f"when regexp_matches(line, '^(?:{p.replace(chr(39), chr(39) * 2)})') then {k}" for p, k in levels.LINE_LEVELS)


@query("line_levels", f"""
with l as (select doc_id, unnest(l) as t, generate_subscripts(l, 1) - 1 as pos from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
m as (select doc_id, pos, ({_PREFIX})[(pos + doc_id) % 13 + 1] || t as line from l)
select doc_id, pos, (case when length(line) <= 2 then null when regexp_matches(line, '^[0-9 ().,%+/-]+$') then 0 {_LEVELS_SQL} end)::int as level from m""")
def line_levels(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    prefix = F.get(F.array(*[F.lit(x) for x in _PREFIX[2:-2].split("', '")]), ((F.col("pos") + F.col("doc_id")) % 13).cast("int"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), levels.line_level(F.concat(prefix, "t")).alias("level"))


@query("usual_title_level", """
with l as (select doc_id, unnest(l) as t, generate_subscripts(l, 1) as pos from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
v as (select doc_id, pos, (length(t) % 7)::int as level from l),
c as (select doc_id, level, count(*) as n, min(pos) as first from v group by all)
select doc_id, coalesce(arg_max(level, (n, -first)) filter (where level <= 4), 5) as level from c group by doc_id""")
def usual_title_level(spark, d):
    """The length of a line stands for its level."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return aggregates.usual_title_level(lines.withColumn("level", F.length("t") % 7), "doc_id", "pos", "level", 4)


@query("numbers_of", """
select o_orderkey, (o_orderkey % 1000)::bigint as digits, (o_orderkey % 20)::bigint as english, (o_orderkey % 3999 + 1)::bigint as roman from orders""")
def numbers_of(spark, d):
    """Numbers written as digits, as an English word and as a Roman numeral, read back."""
    o = table(spark, d, "orders").select("o_orderkey")
    word = F.get(F.array(*[F.lit(w) for w in levels._ONES]), (F.col("o_orderkey") % 20).cast("int"))
    rest, roman = F.col("o_orderkey") % 3999 + 1, F.lit("")
    for unit, five, ten, size in (("M", "", "", 1000), ("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1)):
        digit = (F.floor(rest / size) % 10).cast("int")
        forms = ["", unit, unit * 2, unit * 3, unit + five, five, five + unit, five + unit * 2, five + unit * 3, unit + ten]
        roman = F.concat(roman, F.get(F.array(*map(F.lit, forms)), digit))
    read = {"digits": (F.col("o_orderkey") % 1000).cast("string"), "english": word, "roman": roman}
    return o.select("o_orderkey", *[levels.number_of(c).alias(n) for n, c in read.items()])


@query("font_garbled", """
with c as (select doc_id, unnest(string_split(text, '')) as x, generate_subscripts(string_split(text, ''), 1) as i from documents where text <> ''),
p as (select doc_id, case when doc_id % 3 = 0 and i % 2 = 0 then '#' else x end as x, doc_id % 5 < 3 and i % 3 = 0 as subset from c),
s as (select doc_id, count(*) as n, avg(subset::int) as subset, avg(regexp_matches(x, '[\\x{2E80}-\\x{9FFF}]')::int) as asian, avg(regexp_matches(x, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')::int) as marks
  from p where not regexp_full_match(x, '\\s*') group by doc_id)
select doc_id, n >= 20 and subset >= 0.3 and asian < 0.05 and marks > 0.4 as garbled from s""")
def font_garbled(spark, d):
    """Characters of the documents, every other one a mark in a third of them, in fonts of which some are subsets."""
    chars = table(spark, d, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "")).alias("i", "x"))
    i = F.col("i") + 1
    font = F.when((F.col("doc_id") % 5 < 3) & (i % 3 == 0), "ABC1+Font").otherwise("Font+X")
    chars = chars.select("doc_id", F.when((F.col("doc_id") % 3 == 0) & (i % 2 == 0), "#").otherwise(F.col("x")).alias("text"), font.alias("font"))
    return aggregates.font_garbled(chars, ["doc_id"])


@query("box_distances", f"""with {_BOX_SQL}, p as (select *, lead(x0) over w as nx0, lead(x1) over w as nx1, lead("top") over w as nt, lead(bottom) over w as nb from b window w as (partition by page order by id, x0, x1))
select page, id, least(abs(x1 - nx0), abs(x0 - nx1), abs(x0 + x1 - nx0 - nx1) / 2) as dx, (nt + nb - "top" - bottom) / 2 as dy, floor((x1 - x0) / greatest(length(text), 1))::bigint as wide,
  case id % 4 when 1 then 600 - "top" when 2 then 600 - x0 when 3 then "top" else x0 end as rx, case id % 4 when 1 then x0 when 2 then 800 - "top" when 3 then 800 - x0 else "top" end as ry from p""")
def box_distances(spark, d):
    w = Window.partitionBy("page").orderBy("id", "x0", "x1")
    b = _boxes(spark, d).withColumn("a", F.struct("x0", "x1", "top", "bottom"))
    b = b.withColumn("b", F.lead("a").over(w))
    angle = (F.col("id") % 4 * 90).cast("int")
    at = vectors.rotated_back(F.col("x0"), F.col("top"), angle, F.lit(600.0), F.lit(800.0))
    return b.select("page", "id", vectors.across(F.col("a"), F.col("b")).alias("dx"), vectors.below(F.col("a"), F.col("b")).alias("dy"), vectors.char_width(F.col("a"), F.col("text")).alias("wide"), at["x"].alias("rx"), at["y"].alias("ry"))


#: Boxes of documents of eight pages with tables, figures, captions and source lines.
_REGION_BOX = {
    "doc": "cast(floor(l_orderkey / 32) as bigint)",
    "page": "cast(floor(l_orderkey / 4) % 8 as int)",
    "id": _BOX["id"],
    "x0": _BOX["x0"],
    "x1": _BOX["x1"],
    "top": "cast(300 * (floor(l_orderkey / 4) % 8) + 10 * (l_orderkey % 4 * 7 + l_linenumber) as double)",
    "bottom": "cast(300 * (floor(l_orderkey / 4) % 8) + 10 * (l_orderkey % 4 * 7 + l_linenumber) + 6 + l_partkey % 7 as double)",
    "text": "case when l_partkey % 13 = 0 then '资料来源: x' when l_partkey % 13 = 1 then '表 1: a' when l_partkey % 29 = 2 then '图2 b' else concat(l_returnflag, l_linestatus, cast(l_partkey as string)) end",
    "layoutno": "case when l_suppkey % 17 = 0 then null else concat('r', cast(l_orderkey % 2 as int)) end",
    "layout_type": "case when l_suppkey % 3 = 0 then 'table' when l_suppkey % 11 = 1 then 'figure' when l_suppkey % 13 = 1 then 'title' when l_suppkey % 7 = 2 then 'figure caption' else 'text' end",
}
_REGIONS_SQL = "b0 as (select " + ", ".join(f"{e.replace(' as string', ' as varchar')} as {n}" for n, e in _REGION_BOX.items()) + """ from lineitem),
b as (select *, 9.0::double as mh, (top + bottom) / 2 as mid, row_number() over (partition by doc order by page, top, x0, id, text, layout_type) as n,
  contains(layout_type, 'caption') or regexp_matches(text, '^[图表]+[ 0-9:：]{2,}') as cap, layout_type in ('table', 'figure') and layoutno is not null as inside from b0),
o as (select *, case when inside and not regexp_matches(text, '^(数据|资料|图表)*来源[:： ]') then page || '/' || layoutno || '/' || layout_type end as own from b),
l as (select *, last_value(own ignore nulls) over (partition by doc order by n rows between unbounded preceding and 1 preceding) as before from o),
stopped as (select distinct doc, before as own from l where before is not null and layoutno is not null and (cap or layout_type in ('table caption', 'title', 'figure caption', 'reference'))),
r as (select doc, own, any_value(layout_type) as kind, any_value(page) as page, min(n) as first, arg_min(top, n) as top, arg_min(x0, n) as x0, arg_min(mid, n) as mid0, arg_max(mid, n) as mid1 from o where own is not null group by doc, own),
p as (select r.*, lag({'page': page, 'mid': mid1, 'stopped': s.own is not null}) over (partition by r.doc, kind order by top, x0, first) as prev from r left join stopped s on s.doc = r.doc and s.own = r.own),
c as (select *, last_value(case when kind = 'table' and not prev.stopped and page - prev.page = 1 and mid0 - prev.mid <= 9 * 23 then null else first end ignore nulls) over (partition by doc, kind order by top, x0, first) as region from p),
m as (select o.*, c.region from o left join c on c.doc = o.doc and c.own = o.own where o.own is not null or not o.inside),
d as (select a.doc, a.n, m.region, m.layout_type as kind, m.n as pos, (m.mid - a.mid) ** 2 + case when a.x1 < m.x0 or a.x0 > m.x1 then least(abs(a.x1 - m.x0), abs(a.x0 - m.x1), abs(a.x0 + a.x1 - m.x0 - m.x1) / 2) else 0 end ** 2 as d
  from m a join m on a.doc = m.doc and a.region is null and a.cap and m.region is not null),
near as (select doc, n, arg_min(region, (d, kind <> 'figure', region, pos)) as region from d group by doc, n),
f as (select m.* exclude (region), coalesce(m.region, near.region) as region, case when m.region is not null then 'member' when near.region is not null then 'caption' else 'text' end as role from m left join near on near.doc = m.doc and near.n = m.n),
span as (select doc, region, page, min(x0) as x0, max(x1) as x1, min(top) as top, max(bottom) as bottom from f where region is not null group by doc, region, page),
dist as (select s.doc, s.region, t.n, t.bottom, min(greatest(t.x0 - s.x1, s.x0 - t.x1, 0) ** 2 + greatest(t.top - s.bottom, s.top - t.bottom, 0) ** 2) as d from span s join f t on t.doc = s.doc and t.region is null group by all),
a as (select doc, region, arg_min({'n': n, 'bottom': bottom}, (d, n)) as a from dist group by doc, region),
place as (
  select doc, n as region, 'text' as kind, [n, 1, 0, 0, 0]::double[] as k from f where region is null
  union all
  select x.doc, x.region, x.kind, [coalesce(a.a.n, -1), case when a.a.bottom < y.top then 2 else 0 end, y.top, y.x0, x.region]::double[]
    from (select doc, region, max(layout_type) filter (role = 'member') as kind from f where region is not null group by doc, region) x
    join (select doc, region, arg_min(top, page) as top, arg_min(x0, page) as x0 from span group by doc, region) y on y.doc = x.doc and y.region = x.region left join a on a.doc = x.doc and a.region = x.region),
item as (select *, (row_number() over (partition by doc order by k) - 1)::int as item from place)"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("doc", F.expr(_REGION_BOX["doc"]))
    lines = lines.repartition(tasks_of(lines), "doc")  # all steps are by document; line items are narrower than their boxes
    boxes = lines.selectExpr("doc", *[f"{e} as {n}" for n, e in _REGION_BOX.items() if n != "doc"]).withColumn("mean_height", F.lit(9.0))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("page", "top", "x0", "id", "text", "layout_type")).cast("long")
    return regions.with_regions(boxes.withColumn("n", n), ["doc"])


@query("table_regions", f"with {_REGIONS_SQL} select doc, id, n, region, role from f")
def table_regions(spark, d):
    return regions.in_order(_regions(spark, d), ["doc"]).select("doc", "id", "n", "region", "role")


@query("region_items", f"""with {_REGIONS_SQL},
t as (select doc, coalesce(region, n) as region, string_agg(text, chr(10) order by role <> 'caption', case when role = 'caption' then -n else n end) as text, count(distinct page) as n_pages, min(top) as top, max(bottom) as bottom from f group by doc, coalesce(region, n))
select i.doc, item, i.kind, t.text, n_pages, top, bottom from item i join t on t.doc = i.doc and t.region = i.region""")
def region_items(spark, d):
    out = regions.items(_regions(spark, d), ["doc"])
    edge = lambda f, c: f(F.transform("pages", lambda x: x[c]))
    return out.select("doc", "item", "kind", "text", F.size("pages").cast("long").alias("n_pages"), edge(F.array_min, "top").alias("top"), edge(F.array_max, "bottom").alias("bottom"))
