"""Registered queries of the engine and their SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text, vectors, weights
from .operators import aggregates, chunking, filters, graph, layout, ranking
from .plans import retrieval, routing
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .schema import as_chunks
from .shared import table
from .sources import parsers
from .streaming import ingest

WORDS = r"([\p{L}\p{N}_]+)"
#: The tokens of the example query, and its SQL: (k, w) of words and joined neighbours.
ASKED = ["the", "thing", "of", "and", "ention", "42"]
ASKED_SQL = """
  t(i, t) as (values (1, 'the'), (2, 'thing'), (3, 'of'), (4, 'and'), (5, 'ention'), (6, '42')),
  raw as (
    select i, t, (case when regexp_full_match(t, '[0-9,.]{2,}') then 2.0::double when regexp_full_match(t, '[a-z]{1,2}') then 0.01::double else 1.0::double end)
      * (case when regexp_full_match(t, '[0-9]+') then 2.0::double else 1.0::double end) * log10(10 + (10000000 - f + 0.5::double) / (f + 0.5::double)) as w
    from (select i, t, case when regexp_full_match(t, '[0-9. -]{2,}') then 3 when regexp_full_match(t, '[a-z. -]+') then 300 else 10 end as f from t)),
  q1 as (select i, t, w / sum(w) over () as w, lead(t) over (order by i) as t2, lead(w / s) over (order by i) as w2 from (select *, sum(w) over () as s from raw)),
  q as (select k, sum(w) as w from (select t as k, 0.4 * w as w from q1 union all select t || t2, 0.6 * greatest(w, w2) from q1 where t2 is not null) group by k)"""
TOKENS_SQL = f"regexp_extract_all(lower(coalesce(text, '')), '{WORDS}', 1)"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The example query vector: that of the smallest id. One row."""
    row = table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


# --- text functions ---------------------------------------------------------------------------------------------------


@query("txt_sections", r"""
select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, section
from (select doc_id, i, trim(s[i], ' ') as section from (select doc_id, string_split_regex(text, '\n\s*\n') as s from documents), lateral (select unnest(range(1, len(s) + 1)) as i))
where section <> ''""")
def txt_sections(spark, d):
    return chunking.sections(table(spark, d, "documents"), "doc_id", "text")


_FULL, _HALF = "　" + "".join(map(chr, range(0xFF01, 0xFF5F))), " " + "".join(map(chr, range(0x21, 0x7F)))


@query("fullwidth_fold", f"""
select doc_id, translate(text || '　ＡＢ１２！' || translate(substr(text, 1, 200), '{_HALF.replace("'", "''")}', '{_FULL}'), '{_FULL}', '{_HALF.replace("'", "''")}') as folded from documents""")
def fullwidth_fold(spark, d):
    wide = F.translate(F.substring("text", 1, 200), _HALF, _FULL)
    return table(spark, d, "documents").select("doc_id", text.fold_width(F.concat("text", F.lit("　ＡＢ１２！"), wide)).alias("folded"))


@query("lang_ratio", r"""
select doc_id, round(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / length(text)::double, 6) as han,
  round(length(regexp_replace(text, '[^`a-zA-Z0-9\s.,'':;/"?<>!()\-]', '', 'g')) / length(text)::double, 6) as english,
  length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / length(text)::double > 0.2 as is_chinese
from documents where text <> ''""")
def lang_ratio(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.round(text.han_share(t), 6).alias("han"), F.round(text.english_share(t), 6).alias("english"), text.is_chinese(t).alias("is_chinese"))


@query("token_count", r"""
select doc_id, floor(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) * 1.5 + (length(text) - length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g'))) / 4.0)::int as n_tokens,
  substr(text, 1, 256) as head from documents""")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"), text.truncated(F.col("text"), 64).alias("head"))


@query("chunk_ids", r"""
select doc_id, md5(source || '.txt' || '_' || doc_id || '_' || substr(text, 1, 50)) as chunk_id, regexp_replace(source || '.txt', '\.[a-zA-Z]+$', '') as title,
  substr(md5('/data/' || source || '/' || doc_id), 1, 16) as document_id from documents""")
def chunk_ids(spark, d):
    name = F.concat("source", F.lit(".txt"))
    return table(spark, d, "documents").select(
        "doc_id", text.chunk_id(name, F.col("doc_id"), F.col("text")).alias("chunk_id"), text.title_of(name).alias("title"),
        text.document_id(F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("document_id"),
    )


@query("latin_tokens", f"""
select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, array_to_string(t[1:20], ' ') as head
from (select doc_id, {TOKENS_SQL} as t from documents)""")
def latin_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 20), " ").alias("head"))


@query("term_weights", f"""
with t as (select item_id, unnest({TOKENS_SQL}) as term from benchmark),
w as (select item_id, term, count(*) as n,
  any_value((case when regexp_full_match(term, '[0-9,.]{{2,}}') then 2.0::double when regexp_full_match(term, '[a-z]{{1,2}}') then 0.01::double else 1.0::double end)
  * (case when regexp_full_match(term, '[0-9]+') then 2.0::double else 1.0::double end) * log10(10 + (10000000 - f + 0.5::double) / (f + 0.5::double))) as w
  from (select *, case when regexp_full_match(term, '[0-9. -]{{2,}}') then 3 when regexp_full_match(term, '[a-z. -]+') then 300 else 10 end as f from t) group by item_id, term)
select item_id, term, n, round(w / sum(w * n) over (partition by item_id), 6) as weight from w""")
def term_weights(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    t = t.groupBy("item_id", "term").agg(F.count("*").alias("n")).withColumn("w", weights.raw_weight(F.col("term")))
    total = F.sum(F.col("w") * F.col("n")).over(Window.partitionBy("item_id"))
    return t.select("item_id", "term", "n", F.round(F.col("w") / total, 6).alias("weight"))


@query("clean_query", r"""
select item_id, trim(regexp_replace(text || ' (a|b)* "c": x/y', '([:\{\}/\[\]\-\*"\(\)\|\+~\^])', '\\\1', 'g'), ' ') as escaped,
  regexp_replace(regexp_replace('GPU4中文 and 中A ' || text, '([A-Za-z]+[0-9]*)([\x{4e00}-\x{9fff}])', '\1 \2', 'g'), '([\x{4e00}-\x{9fff}])([A-Za-z])', '\1 \2', 'g') as spaced from benchmark""")
def clean_query(spark, d):
    t = table(spark, d, "benchmark")
    return t.select("item_id", text.escaped_query(F.concat("text", F.lit(' (a|b)* "c": x/y'))).alias("escaped"), text.spaced_scripts(F.concat(F.lit("GPU4中文 and 中A "), F.col("text"))).alias("spaced"))


@query("between_tags", r"""
select page_id, len(h) as n_headings, regexp_replace(h[1], '(?i)</?(table|td|caption|tr|th|b)( [^<>]{0,12})?>', ' ', 'g') as first
from (select page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1) as h from pages)""")
def between_tags(spark, d):
    h = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<h1>(.*?)</h1>"), 1).alias("h"))
    return h.select("page_id", F.size("h").cast("long").alias("n_headings"), F.regexp_replace(F.get("h", F.lit(0)), "(?i)</?(table|td|caption|tr|th|b)( [^<>]{0,12})?>", " ").alias("first"))


@query("position_tags", r"""
select l_orderkey, l_linenumber, (l_suppkey % 9 + 1)::int as page, round(l_quantity, 1) as x0, round(l_quantity + 10, 1) as x1, round(l_linenumber * 10.0::double, 1) as top, round(l_linenumber * 10.0::double + 8, 1) as bottom, 'row' as plain
from lineitem""")
def position_tags(spark, d):
    num = lambda c: F.col(c).cast("double")
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("row"), text.position_tag((F.col("l_suppkey") % 9 + 1).cast("int"), num("l_quantity"), num("l_quantity") + 10, num("l_linenumber") * 10, num("l_linenumber") * 10 + 8)).alias("t"))
    return t.select("l_orderkey", "l_linenumber", text.position_of(F.col("t")).alias("p"), text.without_tags(F.col("t")).alias("plain")).select("l_orderkey", "l_linenumber", "p.*", "plain")


@query("garbled_share", r"""
select doc_id, round(len(regexp_extract_all(t, '[\x{e000}-\x{f8ff}\x{f0000}-\x{10ffff}\x{fffd}\x00-\x08\x0e-\x1b\x{80}-\x{84}\x{86}-\x{9f}]')) / length(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g'))::double, 6) as share,
  regexp_matches(t, '\(cid\s*:\s*[0-9]+\s*\)') as placeholder
from (select doc_id, text || repeat(chr(65533) || chr(1048577) || chr(130), (doc_id % 50)::int) || case when doc_id % 7 = 0 then '(cid: 12)' else '' end as t from documents where trim(text) <> '')""")
def garbled_share(spark, d):
    i = F.col("doc_id")
    t = F.concat("text", F.repeat(F.lit("\ufffd\U00100001\x82"), (i % 50).cast("int")), F.when(i % 7 == 0, "(cid: 12)").otherwise(""))
    out = table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", t.alias("t"))
    return out.select("doc_id", F.round(text.garbled_share(F.col("t")), 6).alias("share"), text.is_garbled(F.col("t"), 2.0).alias("placeholder"))


@query("title_like", r"""
select doc_id, i - 1 as pos, line, regexp_matches(line, '^第[零一二三四五六七八九十百0-9]+条') or (len(string_split_regex(trim(line, ' '), '\s+')) <= 12 and not (position(' ' in line) = 0 and length(line) >= 32) and not regexp_matches(line, '[,;，。；！!]')) as is_title
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)""")
def title_like(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", text.is_title_like(F.col("line")).alias("is_title"))


@query("folder_paths", r"""
with p as (select page_id, '/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#]+', '/', 'g') as raw from pages),
n as (select page_id, case when regexp_replace(raw, '/+$', '') = '' then '/' else regexp_replace(raw, '/+$', '') end as folder from p),
s as (select page_id, folder, list_filter(string_split(folder, '/'), lambda x: x <> '') as parts from n)
select page_id, folder, '/' || array_to_string(parts[1:i], '/') as ancestor, regexp_replace(regexp_replace(lower(folder), '[ -]', '_', 'g'), '[^a-z0-9_]', '', 'g') as kb_id
from s, lateral (select unnest(range(1, len(parts) + 1)) as i)""")
def folder_paths(spark, d):
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/?#]+", "/")
    t = table(spark, d, "pages").select("page_id", text.normal_folder(raw).alias("folder"))
    return t.select("page_id", "folder", F.explode(text.ancestors(F.col("folder"))).alias("ancestor"), text.kb_id(F.col("folder")).alias("kb_id"))


@query("highlights", r"""
select item_id, regexp_replace(text, '(thing|the)', '<em>\1</em>', 'gi') as marked from benchmark""")
def highlights(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.highlighted(F.col("text"), ["the", "thing"]).alias("marked"))


# --- search and ranking -----------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1))"


@query("vector_topk", """
with s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as sim
  from embeddings q, embeddings e where q.vec_id % 20 = 0)
select query_id, vec_id, round(sim, 4) as sim from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as n from s) where n <= 50""")
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.vector_topk_many(rows, asked, 50, id_col="vec_id").withColumn("sim", F.round("sim", 4))


@query("vector_topk_filtered", """
with s as (select q.vec_id as query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as sim
  from embeddings q, embeddings e where q.vec_id % 20 = 0 and e.label in (1, 3, 5))
select query_id, vec_id, label, round(sim, 4) as sim from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as n from s where sim >= 0) where n <= 20""")
def vector_topk_filtered(spark, d):
    all_rows = table(spark, d, "embeddings")
    rows = filters.by_conditions(all_rows, {"label": [1, 3, 5], "vec_id": None})
    asked = all_rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = ranking.vector_topk_many(rows, asked, 20, id_col="vec_id").where("sim >= 0")
    return hits.join(rows.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", F.round("sim", 4).alias("sim"))


@query("parent_dedupe", """
select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rn from lineitem) where rn = 1""")
def parent_dedupe(spark, d):
    t = ranking.best_per_parent(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("parent_lookup", """
with h as (select l_orderkey, l_linenumber, l_extendedprice, l_returnflag as body from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100)
select l_orderkey, l_linenumber, coalesce(o_orderpriority, body) as body from h left join orders on l_orderkey = o_orderkey""")
def parent_lookup(spark, d):
    hits = table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
    hits = hits.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("body"))
    return ranking.with_parent_text(hits, table(spark, d, "orders").withColumnRenamed("o_orderpriority", "body"), "l_orderkey", "body", "o_orderkey")


@query("rerank_fallback", """
with h as (select doc_id, n_chars, doc_id % 7 = 0 as g from documents order by n_chars desc, doc_id limit 30),
r as (select doc_id, case when g then 1.0::double else 1 - 0.01::double * (row_number() over (order by n_chars desc, doc_id) - 1) end as s, g from h)
select doc_id, round(s, 6) as rerank_score from r order by g desc, s desc, doc_id limit 10""")
def rerank_fallback(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "text", F.col("n_chars").alias("sim"), (F.col("doc_id") % 7 == 0).alias("g")).orderBy(F.desc("sim"), "doc_id").limit(30)
    return ranking.reranked(hits, None, "text", 10, "doc_id", graph_flag="g").select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("chunk_page", "select doc_id, substr(text, 1, 200) as preview, length(text) as n from documents order by doc_id limit 20 offset 40")
def chunk_page(spark, d):
    t = ranking.page(table(spark, d, "documents"), 3, 20, "doc_id")
    return t.select("doc_id", text.preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("n"))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("doc_terms_agg", "select source as name, count(*) as n from documents group by source order by n desc, name limit 500")
def doc_terms_agg(spark, d):
    return aggregates.documents_by_count(table(spark, d, "documents"), "source")


@query("doc_aggs", "select source as name, count(*) as n, arg_min(doc_id, (-n_chars, doc_id)) as doc_id from documents where n_chars > 500 group by source")
def doc_aggs(spark, d):
    return aggregates.hits_by_document(table(spark, d, "documents").where("n_chars > 500"), "source", "doc_id", "n_chars", "doc_id")


@query("perf_stats", """
with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events),
t as (select event_type, list(value order by value) as t, arg_min(value, rn) as last from r where rn <= 100 group by event_type),
c as (select event_type, count(*) as count from events group by event_type)
select event_type, len(t) as recent, round(list_sum(t) / len(t), 1) as avg_ms, round(t[1], 1) as min_ms, round(t[len(t)], 1) as max_ms,
  round(t[len(t) // 2 + 1], 1) as p50_ms, round(t[least(floor(len(t) * 0.95)::int, len(t) - 1) + 1], 1) as p95_ms, round(last, 1) as last_ms, count
from t join c using (event_type)""")
def perf_stats(spark, d):
    t = aggregates.stage_stats(table(spark, d, "events"), "event_type", "value", ["ts", "event_id"])
    return t.withColumn("recent", F.col("recent").cast("long"))


@query("perf_last", "select event_type, arg_max(value, (ts, event_id)) as last_ms from events group by event_type")
def perf_last(spark, d):
    return aggregates.last_value(table(spark, d, "events"), "event_type", "value", "ts", "event_id")


@query("level_mode", """
select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as rn from events group by user_id, event_type) where rn = 1""")
def level_mode(spark, d):
    return aggregates.most_frequent(table(spark, d, "events"), "user_id", "event_type")


@query("max_normalise", "select c_custkey, round(c_acctbal / max(c_acctbal) over (), 6) as c_acctbal from customer")
def max_normalise(spark, d):
    return aggregates.max_normalised(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("outcome_counts", """
select count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'X') as "X" from orders""")
def outcome_counts(spark, d):
    return aggregates.outcome_counts(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("repeated_lines_out", """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
s as (select line from l where length(line) < 80 group by line having count(*) > 1)
select doc_id, count(*) as n, sum(length(line))::bigint as chars from l where line not in (select line from s) group by doc_id""")
def repeated_lines_out(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    out = aggregates.without_repeats(lines, "line", F.length("line") < 80)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


_FAMILIES_SQL = ", ".join(
    "len(list_filter(lines, lambda x: not regexp_matches(x, '^(0|[0-9]+ +[0-9~个只-]|[0-9]+\\.{2,})') and regexp_matches(x, '^(?:" + "|".join(f).replace("'", "''") + ")')))" for f in chunking.BULLETS
)


@query("bullet_vote", f"""
with l as (select doc_id, list_transform(string_split(text || chr(10) || '# A' || chr(10) || '1.2 b', chr(10)), lambda x: trim(x, ' ')) as lines from documents where text is not null),
v as (select doc_id, [{_FAMILIES_SQL}] as v from l)
select doc_id, array_to_string(v, ',') as votes, (case when list_max(v) > 0 then list_position(v, list_max(v)) - 1 else -1 end)::int as family from v""")
def bullet_vote(spark, d):
    t = table(spark, d, "documents").where("text is not null").withColumn("text", F.concat("text", F.lit("\n# A\n1.2 b")))
    return chunking.voted_families(t, "doc_id", "text").select("doc_id", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), "family")


# --- filters and table changes ----------------------------------------------------------------------------------------


@query("flag_filters", """
select l_orderkey, l_linenumber from lineitem
where l_returnflag in ('A', 'R') and l_linestatus is distinct from 'parent' and not (coalesce(case when l_linenumber = 3 then 'entity' when l_linenumber > 1 then 'chunk' end, '') in ('entity', 'relation'))""")
def flag_filters(spark, d):
    t = filters.by_conditions(table(spark, d, "lineitem"), {"l_returnflag": ["A", "R"], "l_partkey": 0})
    t = t.withColumns({"chunk_type_kwd": F.col("l_linestatus"), "knowledge_graph_kwd": F.when(F.col("l_linenumber") == 3, "entity").when(F.col("l_linenumber") > 1, "chunk")})
    return filters.without_graph_rows(filters.without_parents(t)).select("l_orderkey", "l_linenumber")


@query("named_documents", "select doc_id from documents where source in ('src1', 'src2', 'nowhere')")
def named_documents(spark, d):
    return filters.named(table(spark, d, "documents"), " src1, src2 ,,nowhere", "source").select("doc_id")


@query("point_lookup", "select doc_id, lang, source from documents where doc_id in (select doc_id from labels where quality = 0)")
def point_lookup(spark, d):
    return filters.by_ids(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 0"), "doc_id").select("doc_id", "lang", "source")


@query("folder_prefix", r"""
with p as (select page_id, '/kb' || page_id % 7 || '/' || regexp_extract(url, '^https?://([^/]+)', 1) as folder from pages)
select page_id, folder, folder = '/' as tool_root from p where folder = '/kb3' or starts_with(folder, '/kb3/')""")
def folder_prefix(spark, d):
    folder = F.concat(F.lit("/kb"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.regexp_extract("url", "^https?://([^/]+)", 1))
    t = table(spark, d, "pages").select("page_id", folder.alias("folder"))
    return filters.under_folder(t, "kb3/").withColumn("tool_root", F.col("folder") == "/")


@query("upsert", """
with n as (select o_orderkey, o_custkey, 'new' as status, 2 as seq from orders where o_orderkey % 3 = 0 union all select o_orderkey + 1000000, o_custkey, 'added', 2 from orders where o_orderkey % 5 = 0),
b as (select o_orderkey, o_custkey, o_orderstatus as status, 1 as seq, 0 as fresh from orders union all select *, 1 from n)
select o_orderkey, o_custkey, status from (select *, row_number() over (partition by o_orderkey order by seq desc, fresh desc) as rn from b) where rn = 1""")
def upsert(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("seq"))
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.lit("new").alias("status"), F.lit(2).alias("seq"))
    more = o.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "o_custkey", F.lit("added").alias("status"), F.lit(2).alias("seq"))
    return filters.upserted(old, new.unionByName(more), "o_orderkey").select("o_orderkey", "o_custkey", "status")


@query("delete_by_condition", "select o_orderkey from orders where not coalesce(o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH'), false)")
def delete_by_condition(spark, d):
    return filters.deleted(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": None}).select("o_orderkey")


# --- chunking ---------------------------------------------------------------------------------------------------------


@query("naive_chunks", r"""
with recursive s as (
  select doc_id, row_number() over (partition by doc_id order by i) as pos, chr(10) || section as line
  from (select doc_id, i, trim(s[i], ' ') as section from (select doc_id, string_split(text, chr(10)) as s from documents), lateral (select unnest(range(1, len(s) + 1)) as i)) where section <> ''),
z as (select *, floor((length(line) - length(regexp_replace(line, '[^\x{4e00}-\x{9fff}]', '', 'g'))) / 4.0 + 1.5 * length(regexp_replace(line, '[^\x{4e00}-\x{9fff}]', '', 'g')))::int as n from s),
r as (
  select doc_id, pos, line, 0 as chunk, n as total from z where pos = 1
  union all
  select z.doc_id, z.pos, z.line, case when r.total > 128 then r.chunk + 1 else r.chunk end, case when r.total > 128 then z.n else r.total + z.n end
  from r join z on z.doc_id = r.doc_id and z.pos = r.pos + 1)
select doc_id, chunk::int as pos, string_agg(line, '' order by r.pos) as chunk from r group by doc_id, r.chunk""")
def naive_chunks(spark, d):
    return chunking.naive_chunks(table(spark, d, "documents"), "doc_id", "text", 128, "\n")


@query("qa_pairs", r"""
with l as (select conv_id, turn, i, case when i = 1 then (case role when 'user' then 'Q: ' else 'A: ' end) else '' end || s[i] as line
  from (select conv_id, turn, role, string_split(text, chr(10)) as s from conversations), lateral (select unnest(range(1, len(s) + 1)) as i)),
m as (select *, regexp_matches(line, '(?i)^(问题|Q|Question|问)[\t:： ]+') as q, regexp_matches(line, '(?i)^(答案|回答|A|Answer|答)[\t:： ]+') as a from l where trim(line, ' ') <> ''),
g as (select *, sum(q::int) over (partition by conv_id order by turn, i) as pair from m),
p as (select *, sum((a and not q)::int) over (partition by conv_id, pair order by turn, i) as part from g where pair > 0),
b as (select *, case when q or a then regexp_replace(line, '(?i)^(问题|Question|Q|问|答案|回答|Answer|A|答)[\t:： ]+', '') else line end as body, max(part) over (partition by conv_id, pair) as last from p),
o as (select conv_id, pair, string_agg(body, chr(10) order by turn, i) filter (part = 0) as question, string_agg(body, chr(10) order by turn, i) filter (part = last and last > 0) as answer from b group by conv_id, pair)
select conv_id, pair::bigint as pair, question, answer from o where question <> '' and answer <> ''""")
def qa_pairs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = F.when(F.col("i") > 0, "").when(F.col("role") == "user", "Q: ").otherwise("A: ")
    return chunking.qa_pairs(c.withColumn("line", F.concat(mark, "line")), "conv_id", ["turn", "i"], "line")


@query("markdown_sections", r"""
with l as (select doc_id, i, case when i % 4 = 0 then '## ' else '' end || s[i + 1] as line from (select doc_id, string_split(text, chr(10)) as s from documents where doc_id is not null), lateral (select unnest(range(0, len(s))) as i)),
h as (select *, regexp_matches(line, '^(#{1,6})\s+(.+)') as h from l),
p as (select *, sum(h::int) over (partition by doc_id order by i) as part from h),
g as (select doc_id, part, max(case when h then trim(regexp_extract(line, '^(#{1,6})\s+(.+)', 2), ' ') end) as title, trim(coalesce(string_agg(line, chr(10) order by i) filter (not h), ''), ' ') as body from p group by doc_id, part),
m as (select *, max(part) over (partition by doc_id) as last from g)
select doc_id, part::bigint as part, case when title is null then body else title || chr(10) || body end as section, case when title is null and part < last then 'title' else 'text' end as tag from m where body <> ''""")
def markdown_sections(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    t = t.withColumn("line", F.concat(F.when(F.col("i") % 4 == 0, "## ").otherwise(""), "line"))
    return chunking.markdown_sections(t, "doc_id", "i", "line")


@query("whole_chunks", "select conv_id, role, string_agg(text, chr(10) order by turn) as chunk from conversations group by conv_id, role")
def whole_chunks(spark, d):
    return chunking.whole_chunks(table(spark, d, "conversations"), "conv_id", "turn", "text", ["role"], "\n")


@query("row_pages", """
with r as (select *, row_number() over (partition by p_brand order by p_partkey) as n from part)
select p_brand, ((n - 1) // 16)::bigint as page, count(*) as n_rows,
  '<table><tr><th>p_name</th><th>p_size</th></tr>' || string_agg('<tr><td>' || coalesce(p_name, '') || '</td><td>' || coalesce(p_size::varchar, '') || '</td></tr>', '' order by n) || '</table>' as html
from r group by p_brand, page""")
def row_pages(spark, d):
    return chunking.row_pages(table(spark, d, "part"), ["p_partkey"], ["p_name", "p_size"], ["p_brand"], 16)


@query("row_sentences", """
select s_suppkey, concat_ws('; ', 'name：' || nullif(s_name, ''), case when s_nationkey <> 0 then 'nation：' || s_nationkey end) || ' ——parts' as line from supplier""")
def row_sentences(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", chunking.row_sentence({"name": F.col("s_name"), "nation": F.col("s_nationkey")}, "parts").alias("line"))


@query("json_flatten", r"""
select event_id, 'props.' || k || ': ' || json_extract_string(props, '$.' || k) as leaf from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def json_flatten(spark, d):
    t = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return t.select("event_id", F.concat(F.lit("props."), "k", F.lit(": "), "v").alias("leaf"))


@query("parent_child_chunks")
def parent_child_chunks(spark, d):
    marked = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"[.] ", "。"))
    return chunking.parent_child_chunks(marked, "source", "text", 256, 200)


def _headed(spark, d):
    """Documents whose lines are headings in turn."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 6 == 0, "# ").when(i % 3 == 0, "## ").otherwise(""), x))
    return table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))


@query("hierarchical_chunks")
def hierarchical_chunks(spark, d):
    t = chunking.voted_families(_headed(spark, d), "doc_id", "text")
    return chunking.hierarchical_chunks(t, "doc_id", "text", "family")


@query("tree_chunks")
def tree_chunks(spark, d):
    t = chunking.voted_families(_headed(spark, d), "doc_id", "text")
    return chunking.tree_chunks(t, "doc_id", "text", "family")


@query("strategy_chunks")
def strategy_chunks(spark, d):
    """Every document's sections by the strategy its source is given."""
    parts = chunking.sections(_headed(spark, d), "doc_id", "text", r"\n").withColumns({"name": F.col("doc_id").cast("string"), "tag": F.lit("")})
    strategies = F.array(*map(F.lit, chunking.STRATEGIES))
    return chunking.chunked(parts.withColumn("strategy", F.get(strategies, (F.col("doc_id") % len(chunking.STRATEGIES)).cast("int"))), "name", "pos", "section", "tag", "strategy")


@query("row_batches", """
with r as (select p_brand, p_name, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as n from part)
select p_brand, (n // 10)::int as batch, string_agg(p_name, '; ' order by p_partkey) as chunk from r group by p_brand, n // 10""")
def row_batches(spark, d):
    return chunking.row_batches(table(spark, d, "part"), ["p_partkey"], "p_name", ["p_brand"])


@query("deleted_by_condition", "select l_orderkey, l_linenumber from lineitem where not (l_quantity < 20 or l_shipdate is null)")
def deleted_by_condition(spark, d):
    rows = filters.deleted_where(table(spark, d, "lineitem"), (F.col("l_quantity") < 20) | F.col("l_shipdate").isNull())
    return rows.select("l_orderkey", "l_linenumber")


# --- graph ------------------------------------------------------------------------------------------------------------


def _relations(spark, d):
    """Customers and suppliers point to their nation, nations to their region and to the nation with the next key."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = lambda t, src, dst, word: table(spark, d, t).select(src.alias("source"), dst.alias("target"), F.lit(word).alias("description"))
    r = rows("customer", key("C", "c_custkey"), key("N", "c_nationkey"), "lives in").unionByName(rows("supplier", key("S", "s_suppkey"), key("N", "s_nationkey"), "sells from"))
    r = r.unionByName(rows("nation", key("N", "n_nationkey"), key("R", "n_regionkey"), "lies in"))
    r = r.unionByName(rows("nation", key("N", "n_nationkey"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")), "next to"))
    return r.withColumns({"chunk_id": F.lit("x"), "seq": F.xxhash64("source", "target", "description")})


_EDGES_SQL = """
  e as (select distinct src, dst from (
    select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
    union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25) from nation))"""
_NODES_SQL = "v as (select src as key from e union select dst from e)"


def _entities(spark, d):
    n = table(spark, d, "nation")
    both = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("NATION").alias("type"), F.col("n_name").alias("description"), F.lit("x").alias("chunk_id"), F.col("n_nationkey").alias("seq"))
    return both.unionByName(both.withColumns({"name": F.concat(F.lit(" "), F.lower("name")), "type": F.lit("LATER"), "description": F.concat("description", F.lit(" again")), "seq": F.col("seq") + 100}))


@query("graph_nodes", f"""
with {_EDGES_SQL}, {_NODES_SQL}
select key, coalesce('N' || n_nationkey, upper(key)) as name, case when n_nationkey is null then 'OTHER' else 'NATION' end as type, coalesce(n_name || ' again', '') as description
from v left join nation on key = 'n' || n_nationkey""")
def graph_nodes(spark, d):
    return graph.build(_entities(spark, d), _relations(spark, d))[0].select("key", "name", "type", "description")


@query("graph_edges", f"with {_EDGES_SQL} select src, dst from e")
def graph_edges(spark, d):
    return graph.build(_entities(spark, d), _relations(spark, d))[1].select("src", "dst")


def _rank_sql(rounds: int) -> str:
    parts = [_EDGES_SQL, _NODES_SQL, "g as (select src, dst, count(*) over (partition by src) as d from e)", "r0 as (select key, 1.0::double / (select count(*) from v) as r from v)"]
    for k in range(rounds):
        parts.append(f"""r{k + 1} as (select v.key, 0.15::double / (select count(*) from v) + 0.85::double * (coalesce(f.f, 0) + (select coalesce(sum(r), 0) from r{k} where key not in (select src from e)) / (select count(*) from v)) as r
  from v left join (select dst, sum(r / d) as f from g join r{k} on src = key group by dst) f on v.key = f.dst)""")
    return "with " + ",\n".join(f"{p}" if not p[0].isalpha() or " as " in p else p for p in parts)


_RANK_SQL = _rank_sql(8).replace(" as (", " as materialized (")


@query("pagerank", f"{_RANK_SQL} select key, round(r / (select max(r) from r8), 6) as pagerank from r8")
def pagerank(spark, d):
    nodes, edges = graph.build(_entities(spark, d), _relations(spark, d))
    return graph.pagerank(nodes, edges, iterations=8, tolerance=None).withColumn("pagerank", F.round("pagerank", 6))


@query("nhop", f"""
with recursive {_EDGES_SQL}, u as (select src, dst from e union select dst, src from e),
w as (select seed, seed as key, 0 as hop from (values ('n3'), ('s1'), ('r2')) t(seed) union select w.seed, u.dst, w.hop + 1 from w join u on w.key = u.src where hop < 2)
select seed, key, min(hop)::int as hop from w group by seed, key having min(hop) > 0""")
def nhop(spark, d):
    _, edges = graph.build(_entities(spark, d), _relations(spark, d))
    return graph.neighbours(edges, spark.createDataFrame([("n3",), ("s1",), ("r2",)], "key string"), 2)


def _graph_hits(spark, d):
    nodes, edges = graph.build(_entities(spark, d), _relations(spark, d))
    ranks = graph.pagerank(nodes, edges, iterations=8, tolerance=None).withColumn("pagerank", F.round("pagerank", 6))
    e = table(spark, d, "embeddings").select(F.concat(F.lit("n"), (F.col("vec_id") % 25).cast("string")).alias("key"), F.round(vectors.cosine_to(F.col("embedding"), first_vector(spark, d)), 6).alias("sim"))
    return nodes, edges, ranks, e.join(ranks, "key").join(nodes.select("key", "name", "type", "description"), "key")


_HITS_SQL = f"hits as (select 'n' || vec_id % 25 as key, round({_COS}, 6) as sim, round(r / (select max(r) from r8), 6) as pagerank from embeddings join r8 on r8.key = 'n' || vec_id % 25)"


@query("graph_rank", f"{_RANK_SQL}, {_HITS_SQL} select key, round(max(sim * greatest(pagerank, 0.01::double)), 5) as score from hits group by key")
def graph_rank(spark, d):
    hits = _graph_hits(spark, d)[3]
    return graph.ranked_entities(hits, "key").select("key", F.round("score", 5).alias("score"))


@query("graph_by_type", f"{_RANK_SQL}, t as (select key, round(r / (select max(r) from r8), 6) as pagerank from r8 where starts_with(key, 'n')) select key, pagerank from t order by pagerank desc, key limit 7")
def graph_by_type(spark, d):
    nodes, _, ranks, _ = _graph_hits(spark, d)
    return graph.by_type(nodes.join(ranks, "key"), ["nation"], 7).select("key", "pagerank")


@query("graph_expand", f"""
{_RANK_SQL.replace("with ", "with recursive ", 1)}, u as (select src, dst from e union select dst, src from e),
w as (select seed, seed as key, 0 as hop from (values ('n3'), ('n4')) t(seed) union select w.seed, u.dst, w.hop + 1 from w join u on w.key = u.src where hop < 2),
h as (select seed, key, min(hop)::int as hop from w group by seed, key having min(hop) > 0),
p as (select h.*, round(r / (select max(r) from r8), 6) as pagerank from h join r8 using (key))
select seed, key, hop, pagerank from (select *, row_number() over (partition by seed order by pagerank desc, key) as rn from p) where rn <= 20""")
def graph_expand(spark, d):
    _, edges, ranks, _ = _graph_hits(spark, d)
    seeds = spark.createDataFrame([("n3", 1.0), ("n4", 0.9), ("n9", 0.1)], "key string, sim double")
    return graph.expanded(edges, ranks, seeds, 2, 2, 20)


@query("entity_topk", """
with e as (select n_name, n_nationkey, embedding from nation join embeddings on vec_id = n_nationkey),
s as (select q.vec_id as query_id, n_name as name, n_nationkey, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as sim from embeddings q, e where q.vec_id % 20 = 0)
select query_id, name, round((1 + sim) / 2, 4) as sim from (select *, row_number() over (partition by query_id order by sim desc, n_nationkey) as n from s) where n <= 5""")
def entity_topk(spark, d):
    vectors_ = table(spark, d, "embeddings")
    rows = table(spark, d, "nation").join(vectors_, F.col("n_nationkey") == F.col("vec_id"))
    asked = vectors_.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = ranking.vector_topk_many(rows, asked, 5, id_col="n_nationkey").join(F.broadcast(table(spark, d, "nation")), "n_nationkey")  # 25 nations
    return hits.select("query_id", F.col("n_name").alias("name"), F.round((1 + F.col("sim")) / 2, 4).alias("sim"))


@query("overlapped_chunks", r"""
with recursive s as (
  select doc_id, row_number() over (partition by doc_id order by i) as pos, chr(10) || section as line
  from (select doc_id, i, trim(s[i], ' ') as section from (select doc_id, string_split(text, chr(10)) as s from documents), lateral (select unnest(range(1, len(s) + 1)) as i)) where section <> ''),
z as (select *, floor((length(line) - length(regexp_replace(line, '[^\x{4e00}-\x{9fff}]', '', 'g'))) / 4.0 + 1.5 * length(regexp_replace(line, '[^\x{4e00}-\x{9fff}]', '', 'g')))::int as n from s),
r as (
  select doc_id, pos, line as last, n, 0 as chunk from z where pos = 1
  union all
  select z.doc_id, z.pos, case when r.n > 51.2::double then substr(r.last, floor(length(r.last) * 80 / 100.0)::int + 1) || z.line else r.last || z.line end, case when r.n > 51.2::double then z.n else r.n + z.n end,
    case when r.n > 51.2::double then r.chunk + 1 else r.chunk end
  from r join z on z.doc_id = r.doc_id and z.pos = r.pos + 1)
select doc_id, chunk::int as pos, arg_max(last, r.pos) as chunk from r group by doc_id, r.chunk""")
def overlapped_chunks(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.merged_sections(parts, 64, 20)).alias("pos", "chunk"))


@query("merged_terms", f"""
with t as (select doc_id, unnest(t) as x, generate_subscripts(t, 1) as i from (
  select doc_id, list_filter({TOKENS_SQL}, lambda x: not regexp_matches(x, '^_') and not regexp_full_match(x, '[0-9]')) as t from documents)),
h as (select a.doc_id, (length(a.x) = 1 or regexp_full_match(a.x, '[0-9a-z]{{1,2}}')) and length(b.x) > 1 and not regexp_matches(b.x, '^[0-9a-zA-Z]') as head from t a join t b on a.doc_id = b.doc_id and a.i = 1 and b.i = 2),
k as (select t.*, length(x) = 1 or regexp_full_match(x, '[0-9a-z]{{1,2}}') as short, coalesce(head, false) and i <= 2 as front from t left join h using (doc_id)),
r as (select *, case when short and not front then i - row_number() over (partition by doc_id, short and not front order by i) end as run from k),
m as (select *, row_number() over (partition by doc_id, run order by i) as place, count(*) over (partition by doc_id, run) as size from r),
g as (select *, case when front then -1 when run is null then i when size < 5 then i - place when place <= 2 * floor((size - 3) / 2) then i - (place - 1) % 2 else i - place + 2 * floor((size - 3) / 2) + 1 end as start,
  front or run is not null as many from m)
select doc_id, string_agg(part, '|' order by first) as terms from (select doc_id, start, many, min(i) as first, string_agg(x, ' ' order by i) as part from g group by doc_id, start, many) group by doc_id
union all select doc_id, '' from documents where doc_id not in (select doc_id from t)""")
def merged_terms(spark, d):
    kept = weights.kept_tokens(text.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(weights.merged_terms(kept), "|").alias("terms"))


@query("joined_latin", r"""
with p as (select item_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as l from benchmark)),
j as (select *, coalesce(regexp_matches(lag(x) over w, '[a-zA-Z]$') and regexp_matches(x, '[a-zA-Z]$'), false) as joins from p window w as (partition by item_id order by i)),
g as (select *, sum((not joins)::int) over (partition by item_id order by i) as g from j),
q as (select item_id, g, string_agg(x, ' ' order by i) as part from g group by all)
select item_id, string_agg(part, '|' order by g) as text from q group by item_id""")
def joined_latin(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(weights.joined_latin(F.col("text")), "|").alias("text"))


@query("graph_context")
def graph_context(spark, d):
    _, edges, ranks, hits = _graph_hits(spark, d)
    entities = graph.ranked_entities(hits, "name")
    relations = graph.ranked_relations(_relations(spark, d).where("description = 'next to'").withColumns({"sim": F.lit(0.5), "pagerank": F.lit(0.2)}))
    paths = graph.neighbours(edges, entities.limit(2).select("key"), 1)
    return graph.context(entities, relations, paths)


# --- layout -----------------------------------------------------------------------------------------------------------


def _boxes(spark, d):
    """Order lines as boxes: an order is a page."""
    x = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), x.alias("x0"), (x + 20 + F.col("l_suppkey") % 5).alias("x1"),
        (F.col("l_partkey") % 50).cast("double").alias("top"), (F.col("l_partkey") % 50 + 10).cast("double").alias("bottom"), F.round("l_discount", 2).alias("score"), F.col("l_returnflag").alias("text"),
    )


_BOXES_SQL = """b as (select l_orderkey as page, l_linenumber as id, l_quantity as x0, l_quantity + 20 + l_suppkey % 5 as x1, (l_partkey % 50)::double as top, (l_partkey % 50 + 10)::double as bottom, l_returnflag as text from lineitem),
  o as (select * from b where id % 2 = 1), r as (select * from b where id % 2 = 0)"""


@query("box_overlap_join", f"""
with {_BOXES_SQL}, s as (select o.page, o.id as box_id, r.id as region_id,
  greatest(least(o.x1, r.x1) - greatest(o.x0, r.x0), 0) * greatest(least(o.bottom, r.bottom) - greatest(o.top, r.top), 0) / ((o.x1 - o.x0) * (o.bottom - o.top)) as share from o join r using (page))
select page, box_id, region_id, round(share, 6) as share from (select *, row_number() over (partition by page, box_id order by share desc, region_id) as rn from s where share >= 0.4) where rn = 1""")
def box_overlap_join(spark, d):
    b = _boxes(spark, d)
    return layout.overlap_join(b.where("id % 2 = 1"), b.where("id % 2 = 0"), ["page"], "id", "id").withColumn("share", F.round("share", 6))


@query("nearest_join", f"""
with {_BOXES_SQL}, s as (select o.page, o.id as box_id, r.id as target_id,
  sqrt(pow(greatest(r.x0 - o.x1, o.x0 - r.x1, 0), 2) + pow(greatest(r.top - o.bottom, o.top - r.bottom, 0), 2)) as distance from o join r using (page))
select page, box_id, target_id, round(distance, 6) as distance from (select *, row_number() over (partition by page, box_id order by distance, target_id) as rn from s) where rn = 1""")
def nearest_join(spark, d):
    b = _boxes(spark, d)
    return layout.nearest_join(b.where("id % 2 = 1"), b.where("id % 2 = 0"), ["page"], "id", "id").withColumn("distance", F.round("distance", 6))


@query("page_offsets", """
select o_custkey, o_orderkey, coalesce(sum(round(o_totalprice)) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as "offset" from orders""")
def page_offsets(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").alias("h"))
    return layout.page_offsets(t, "o_custkey", "o_orderkey", "h").drop("h")


@query("box_suppression")
def box_suppression(spark, d):
    return layout.suppressed(_boxes(spark, d), ["page", "text"])


@query("table_html", f"""
with {_BOXES_SQL}, n as (select *, coalesce((top - lag(top) over (partition by page order by top) > 5)::int, 0) as nr, coalesce((x0 - lag(x0) over (partition by page order by x0) > 5)::int, 0) as nc from b),
g as (select *, sum(nr) over (partition by page order by top) as "R", sum(nc) over (partition by page order by x0) as "C" from n),
t as (select page, "R", '<tr>' || string_agg(case when "R" = 0 then '<th>' || text || '</th>' else '<td>' || text || '</td>' end, '' order by "C", text) || '</tr>' as tr from g group by page, "R")
select page, '<table>' || string_agg(tr, '' order by "R") || '</table>' as html from t group by page""")
def table_html(spark, d):
    return layout.table_html(layout.table_grid(_boxes(spark, d), ["page"], 5, 5), ["page"])


_CELLS = ["2024年", "第三季度", "2023A", "12-25", "2024/12", "2024-1-5", "1999年7月3日", "2021年二季度", "12.5%", "AB-12/X", "Total sum", "12 kg (net)", "x", "one, two", "one, two, three, four", "一二", "", "3月4日", "2024-07"]


@query("cell_kinds", rf"""
select event_id, case
  when regexp_matches(t, '^(20|19)[0-9]{{2}}[年/-][0-9]{{1,2}}[月/-][0-9]{{1,2}}日*$') or regexp_matches(t, '^(20|19)[0-9]{{2}}年$') or regexp_matches(t, '^(20|19)[0-9]{{2}}[年-][0-9]{{1,2}}月*$')
    or regexp_matches(t, '^[0-9]{{1,2}}[月-][0-9]{{1,2}}日*$') or regexp_matches(t, '^第*[一二三四1-4]季度$') or regexp_matches(t, '^(20|19)[0-9]{{2}}年*[一二三四1-4]季度$') or regexp_matches(t, '^(20|19)[0-9]{{2}}[ABCDE]$') then 'Dt'
  when regexp_matches(t, '^[0-9.,+%/ -]+$') then 'Nu' when regexp_matches(t, '^[0-9A-Z/\._~-]+$') then 'Ca'
  when regexp_matches(t, '^[A-Z]*[a-z'' -]+$') then 'En' when regexp_matches(t, '^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()'' -]+$') then 'NE' when length(t) = 1 then 'Sg'
  when n >= 12 then 'Lx' when n > 3 then 'Tx' else 'Ot' end as kind
from (select event_id, trim(c, ' ') as t, len(list_filter(regexp_extract_all(lower(c), '{{WORDS}}', 1), lambda w: length(w) > 1)) as n from (
  select event_id, case when event_id % 23 < 19 then ([{", ".join("'" + c + "'" for c in _CELLS)}])[event_id % 23 + 1] when event_id % 23 = 19 then event_type when event_id % 23 = 20 then repeat(event_type || ', ', (event_id % 17)::int)
    when event_id % 23 = 21 then event_id || ' kg' else upper(event_type) || '_' || event_id end as c from events))""".replace("{WORDS}", WORDS))
def cell_kinds(spark, d):
    i = F.col("event_id")
    t = F.when(i % 23 < 19, F.get(F.array(*map(F.lit, _CELLS)), (i % 23).cast("int"))).when(i % 23 == 19, F.col("event_type"))
    t = t.when(i % 23 == 20, F.repeat(F.concat("event_type", F.lit(", ")), (i % 17).cast("int"))).when(i % 23 == 21, F.concat(i.cast("string"), F.lit(" kg"))).otherwise(F.concat(F.upper("event_type"), F.lit("_"), i.cast("string")))
    return table(spark, d, "events").select("event_id", layout.cell_kind(t).alias("kind"))


# --- sources, plans, streaming additions ------------------------------------------------------------------------------


@query("html_sections")
def html_sections(spark, d):
    files = table(spark, d, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return parsers.parsed(files)


@query("json_leaves", r"""
select event_id || '.json' as path, (row_number() over (partition by event_id order by i) - 1)::int as pos, 'section' as kind, k || ': ' || json_extract_string(props, '$.' || k) as text, 'text' as tag
from (select event_id, props, unnest(json_keys(props)) as k, generate_subscripts(json_keys(props), 1) as i from events)""")
def json_leaves(spark, d):
    return parsers.parsed(table(spark, d, "events").select(F.concat("event_id", F.lit(".json")).alias("path"), F.col("props").cast("binary").alias("content")))


def _chunk_table(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return as_chunks(docs.select(
        F.format_string("%09d", "doc_id").alias("id"), F.lit("kb").alias("kb_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("docnm_kwd"), F.col("text").alias("content_with_weight"),
        F.when(F.col("doc_id") % 10 == 0, "parent").otherwise("child").alias("chunk_type_kwd"), F.when(F.col("doc_id") % 10 != 0, F.format_string("%09d", (F.floor(F.col("doc_id") / 10) * 10).cast("long"))).alias("parent_id_kwd"), "embedding",
    ))


#: The bag's distinct tokens keep the order of their first places, so its neighbours are others than the text's.
_HYBRID_SQL = f"""with {ASKED_SQL},
  cand as (select * from documents),
  s as (select doc_id, unnest(ts) as x, unnest(range(1, len(ts) + 1)) as i from (select doc_id, {TOKENS_SQL} as ts from cand)),
  d as (select doc_id, list(x order by i) as t from (select doc_id, x, min(i) as i from s group by doc_id, x) group by doc_id),
  k as (select doc_id, list_concat(coalesce(t, []), list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1])) as keys from cand left join d using (doc_id)),
  tok as (select doc_id, (1e-9 + coalesce(sum(w) filter (where list_contains(keys, k)), 0)) / (1e-9 + sum(w)) as tok from (select doc_id, keys, q.k, q.w from k as a, q) group by doc_id),
  h0 as (select doc_id, source, coalesce({_COS}, 0) as cos, tok from tok join documents using (doc_id) left join embeddings on doc_id = vec_id),
  h as (select *, case when sum(cos) over () = 0 then tok else 0.3 * cos + 0.7 * tok end as sim from h0)"""


@query("retrieve_page", f"""{_HYBRID_SQL.replace("cand as (select * from documents)", "cand as (select * from documents where doc_id in (select vec_id from embeddings) and doc_id % 10 <> 0)")},
b as (select *, row_number() over (partition by doc_id // 10 order by sim desc, doc_id) as rn from h where sim >= 0.2)
select printf('%09d', doc_id) as id, round(sim, 4) as sim, length(coalesce(p.text, c.text)) as n_chars from (select * from b where rn = 1 order by sim desc, doc_id limit 10) b
join documents c using (doc_id) left join (select doc_id as pid, text from documents where doc_id % 10 = 0 and doc_id in (select vec_id from embeddings)) p on pid = doc_id // 10 * 10""")
def retrieve_page(spark, d):
    hits = retrieval.retrieve(_chunk_table(spark, d), retrieval.Search(ASKED, first_vector(spark, d), ("kb",), size=10, topk=100_000))
    return hits.select("id", F.round("sim", 4).alias("sim"), F.length("content_with_weight").cast("long").alias("n_chars"))


@query("retrieve_context")
def retrieve_context(spark, d):
    hits = retrieval.retrieve(_chunk_table(spark, d), retrieval.Search(ASKED, first_vector(spark, d), size=15))
    return retrieval.context_text(routing.route(hits, "which thing").hits, 5)


@query("stage_windows", """
select time_bucket(interval '1 hour', ts) as window_start, event_type as stage, count(*) as n, round(avg(value), 4) as avg_ms, max(value) as max_ms from events group by all""")
def stage_windows(spark, d):
    return ingest.stage_windows(table(spark, d, "events"), "ts", "event_type", "value")


@query("user_sessions", """
with g as (select *, coalesce((ts >= lag(ts) over w + interval '30 minutes')::int, 1) as n from events window w as (partition by user_id order by ts)),
s as (select *, sum(n) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k""")
def user_sessions(spark, d):
    return ingest.stage_sessions(table(spark, d, "events"), "ts", "user_id")


from . import element_queries, layout_queries, model_queries, search_queries  # noqa: E402, F401  (they register their queries)
