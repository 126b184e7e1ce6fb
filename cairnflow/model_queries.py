"""Registered queries of given models, and of folder trees and hierarchies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import text
from .operators import folders, models
from .plans import questions
from .registry import query
from .search_queries import TOKENS_SQL
from .shared import checked_broadcast, table, written


@query("embedded_texts", f"""
with t as (select item_id, unnest({TOKENS_SQL}) as term from benchmark),
p as (select item_id, ('0x' || substr(md5(term), 1, 7))::bigint % 64 as place, sum(case when ('0x' || substr(md5(term), 8, 1))::int < 8 then 1 else -1 end) as v from t group by all)
select item_id, place, round(v / sqrt(sum(v * v) over (partition by item_id)), 5) as v from p where v <> 0""")
def embedded_texts(spark, d):
    out = models.embedded(table(spark, d, "benchmark").select("item_id", "text"), "text", models.hash_embedder(64))
    out = out.where("error is null").select("item_id", F.posexplode("embedding").alias("place", "v")).where("v <> 0")
    return out.select("item_id", F.col("place").cast("long").alias("place"), F.round(F.col("v").cast("double"), 5).alias("v"))


def _capitalised():
    """An extractor without a model: capitalised words are entities, neighbours among them related."""

    def extract(content: str) -> dict:
        names = re.findall("[A-Z][a-z]+", content)
        return {
            "entities": [{"name": f" {n} ", "type": "word" if len(n) < 8 else None} for n in names],
            "relations": [{"source": a, "target": b, "description": " next "} for a, b in zip(names, names[1:], strict=False)],
        }

    return extract


def _found(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return written(models.extracted(docs, _capitalised, "doc_id", "text"), "extracted")


_NAMES_SQL = r"n as (select doc_id, regexp_extract_all(substr(text, 1, 4000), '[A-Z][a-z]+') as n from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20)"


@query("extracted_entities", f"with {_NAMES_SQL}, e as (select doc_id, unnest(n) as name, generate_subscripts(n, 1) - 1 as pos from n) select doc_id as chunk_id, pos, name, case when length(name) < 8 then 'WORD' else 'OTHER' end as type, '' as description from e")
def extracted_entities(spark, d):
    return models.entities_of(_found(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("extracted_relations", f"with {_NAMES_SQL}, e as (select doc_id, unnest(n) as source, generate_subscripts(n, 1) - 1 as pos from n), p as (select *, lead(source) over (partition by doc_id order by pos) as target from e) select doc_id as chunk_id, pos, source, target, 'next' as description from p where target is not null")
def extracted_relations(spark, d):
    return models.relations_of(_found(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("folder_tree", r"""
with recursive p as (select page_id, '/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#]+', '/', 'g') as raw, length(html) as n from pages where url is not null),
b as (select case when regexp_replace(raw, '/+$', '') = '' then '/' else regexp_replace(raw, '/+$', '') end as path, coalesce(n, 0) as n from p),
a as (select path, n, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from b),
f as (select path from b union select '/' || array_to_string(parts[1:i], '/') from a, lateral (select unnest(range(1, len(parts) + 1)) as i) where length(path) % 2 = 0 or i = 1),
e as (select path, case when regexp_replace(path, '/[^/]*$', '') = '' then '/' else regexp_replace(path, '/[^/]*$', '') end as parent from f where path <> '/'),
t as (select '/' as path, null::varchar as parent, 0 as depth union all select e.path, e.parent, t.depth + 1 from e join t on e.parent = t.path)
select t.path, t.parent, case when t.path = '/' then '/' else regexp_extract(t.path, '([^/]*)$', 1) end as name, t.depth,
  (select count(*) from b where b.path = t.path) as n_bases, (select coalesce(sum(n), 0)::bigint from b where b.path = t.path) as n_rows,
  (select count(*) from b where t.path = '/' or b.path = t.path or starts_with(b.path, t.path || '/')) as all_bases,
  (select coalesce(sum(n), 0)::bigint from b where t.path = '/' or b.path = t.path or starts_with(b.path, t.path || '/')) as all_rows
from t""")
def folder_tree(spark, d):
    """Each page is a base in the folder of its address. Of the folders between, those of addresses of even length are known, and each
    host: others are reached from no parent."""
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/?#]+", "/")
    bases = table(spark, d, "pages").where("url is not null").select(text.normal_folder(raw).alias("folder"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_rows"))
    every = bases.select("folder", F.posexplode(text.ancestors(F.col("folder"))).alias("i", "path"))
    known = every.where("length(folder) % 2 = 0 or i = 0").select("path")
    return folders.folder_tree(known, bases)


@query("ancestor_names", """
select 'c' || c_custkey as id, [c_name, n_name, r_name, 'world'] as names from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select 'n' || n_nationkey, [n_name, r_name, 'world'] from nation join region on n_regionkey = r_regionkey
union all select 'r' || r_regionkey, [r_name, 'world'] from region union all select 'w', ['world']""")
def ancestor_names(spark, d):
    node = lambda t, kind, key, up, parent, name: table(spark, d, t).select(F.concat(F.lit(kind), key).alias("id"), F.concat(F.lit(up), parent).alias("parent"), F.col(name).alias("name"))
    nodes = node("customer", "c", "c_custkey", "n", "c_nationkey", "c_name").unionByName(node("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"))
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent"), F.col("r_name").alias("name"))
    root = spark.createDataFrame([("w", None, "world")], "id string, parent string, name string")
    return folders.ancestors_of(nodes.unionByName(region).unionByName(root))


def _rewriter():
    """A model that isn't one: capitalised words are entities, the last word tells the type; it fails on long questions and leaves out fields."""

    def rewrite(question: str) -> dict:
        if len(question) % 5 == 0:
            raise ValueError("no answer")
        names, words = re.findall("[A-Z][a-z]+", question), question.split(" ")
        return {"target_types": [w[:3] for w in words[-1:]], "entities": names} | ({"keywords": words[:2], "intent": "find"} if len(question) % 2 else {})

    return rewrite


@query("rewritten_questions", r"""
with q as (select conv_id, turn, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as q from conversations where role = 'user'),
k as (select lower(q) as key, min(q) as one from q group by lower(q)),
a as (select conv_id, turn, q, one, length(one) % 5 = 0 as failed, length(one) % 2 = 1 as whole, string_split(one, ' ') as words from q join k on lower(q) = key)
select conv_id, turn, array_to_string(case when failed then [] else [replace(upper(substr(words[-1], 1, 3)), 'ẞ', 'SS')] end, '|') as types, array_to_string(case when failed then [q] else regexp_extract_all(one, '[A-Z][a-z]+') end, '|') as entities,
  array_to_string(case when whole and not failed then words[1:2] else list_filter(string_split_regex(q, '[\s\p{Z}]+'), lambda w: w <> '') end, '|') as keywords, case when whole and not failed then 'find' else q end as intent, failed from a""")
def rewritten_questions(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    said = lambda c: F.array_join(c, "|").alias(c)
    out = questions.rewritten(asked, _rewriter)
    return out.select("conv_id", "turn", F.array_join("target_types", "|").alias("types"), said("entities"), said("keywords"), "intent", F.col("error").isNotNull().alias("failed"))


def _reversed():
    """A translator of words that are written backwards."""
    return lambda question: {"keywords": question.split()[:3], "translated": [w[::-1] for w in question.split()] if len(question) % 7 else []}


@query("asked_again", f"""
with d as (select distinct doc_id, unnest({TOKENS_SQL}) as term from documents),
q as (select item_id, text, trim(case when item_id % 3 = 0 then text else reverse(text) end, ' ') as said from benchmark),
t1 as (select distinct item_id, unnest(regexp_extract_all(lower(said), '{{WORDS}}', 1)) as term from q), n1 as (select item_id, count(*) as n from t1 group by item_id),
h1 as (select item_id, doc_id, count(*) as n from t1 join d using (term) group by all), f1 as (select h1.item_id as query_id, doc_id, h1.n, 1 as asked from h1 join n1 using (item_id) where 10 * h1.n >= 5 * n1.n),
b as (select item_id, said || ' ' || array_to_string(list_transform(string_split_regex(said, '\\s+'), lambda w: reverse(w)), ' ') as said from q where item_id not in (select query_id from f1) and length(said) % 7 <> 0),
t2 as (select distinct item_id, unnest(regexp_extract_all(lower(said), '{{WORDS}}', 1)) as term from b), n2 as (select item_id, count(*) as n from t2 group by item_id),
h2 as (select item_id, doc_id, count(*) as n from t2 join d using (term) group by all)
select * from f1 union all select h2.item_id, doc_id, h2.n, 2 from h2 join n2 using (item_id) where 10 * h2.n >= 2 * n2.n""".replace("{WORDS}", r"([\p{L}\p{N}_]+)"))
def asked_again(spark, d):
    """Questions of which two in three are written backwards; documents with half of a question's words are hits (two tenths when it is
    asked with its translations, as half of it is strange to them)."""
    items = table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.reverse("text")).alias("text"))
    terms = written(table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")), "terms")
    shares = iter((5, 2))

    def ask(q):
        words = q.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
        words = words.select("query_id", F.size("t").alias("all"), F.explode("t").alias("term"))
        hits = terms.join(checked_broadcast(words), "term").groupBy("query_id", "doc_id", "all").agg(F.count("*").alias("n"))
        return hits.where(F.col("n") * 10 >= F.col("all") * next(shares)).select("query_id", "doc_id", "n")

    return questions.asked_again(asked, ask, _reversed)
