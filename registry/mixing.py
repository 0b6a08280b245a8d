"""Registered queries: mixing, set operations and dataset assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import joins as J, mixing as X
from assayer.plans import derive as D
from registry import parts as P

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def docs(spark, sf):
    return D.read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("type"), "source", "n_chars")


@register("mix_sources", """select 'documents' as provenance, doc_id as row_id, lang as type, null as url from documents union all select 'pages', page_id, null, url from pages
  union all select 'benchmark', item_id, null, null from benchmark""")
def mix_sources(spark, sf):
    pages = D.read(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url")
    items = D.read(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"))
    return X.mix({"documents": docs(spark, sf).select("row_id", "type"), "pages": pages, "benchmark": items}).select("provenance", "row_id", "type", "url")


@register("replace_type", """select 'kept' as provenance, doc_id as row_id, lang as type, n_chars from documents where lang <> 'fr'
  union all select 'rebuilt', doc_id + 1000000, lang, n_chars * 2 from documents where lang = 'fr'""")
def replace_type(spark, sf):
    base = docs(spark, sf).drop("source")
    rebuilt = base.select((F.col("row_id") + 1000000).alias("row_id"), "type", (F.col("n_chars") * 2).alias("n_chars"))
    return X.replace_type(base, rebuilt, "fr").select("provenance", "row_id", "type", "n_chars")


@register("replicate_by_weight", """select source, copy, count(*) as n from documents, (select unnest(range(1, 5)) as copy) c
  where copy <= case lang when 'en' then 1 when 'de' then 3 when 'es' then 4 else 0 end group by 1, 2""")
def replicate_by_weight(spark, sf):
    weight = F.when(F.col("type") == "en", 1).when(F.col("type") == "de", 3).when(F.col("type") == "es", 4).otherwise(0)
    return X.replicate(docs(spark, sf), weight).groupBy("source", F.col("copy").cast("bigint").alias("copy")).agg(F.count("*").alias("n"))


@register("rule_overlap", """with e as (select user_id, list_sort(list(distinct event_type)) as kinds from events group by 1) select user_id, list_has_any(kinds, ['purchase', 'error']) as overlaps, len(kinds) as n from e""")
def rule_overlap(spark, sf):
    kinds = D.read(spark, sf, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", J.rule_overlap(F.col("kinds"), F.array(F.lit("purchase"), F.lit("error"))).alias("overlaps"), F.size("kinds").cast("bigint").alias("n"))


@register("distinct_words_in_order", """with w as (select doc_id, w, min(i) as first from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (
    select doc_id, regexp_split_to_array(lower(text), '\\s+') as ws from documents) a) b where w <> '' group by 1, 2)
  select doc_id, count(*) as n, md5(string_agg(w, ' ' order by first)) as digest from w group by 1""")
def distinct_words_in_order(spark, sf):
    words = X.distinct_words_in_order(F.col("text"))
    return D.documents(spark, sf).select("doc_id", words.alias("w")).where(F.size("w") > 0).select(
        "doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_VC = f"""with {P.TRACES}, {P.pairs('unit', 'up')}, {P.targets('unit', 'ut')}, uf as (select row_id, median(cast(rhs as double) / cast(lhs as double)) as c from up where cast(lhs as double) > 0 group by row_id),
  good as (select row_id from ut join uf using (row_id) where abs(round(c * cast(target as double), 2) - cast(expected as double)) < 0.05::double)
  select row_id, 'unit_solver' as source, type as puzzle_type, md5(prompt || chr(10) || 'Put the answer in a box.') as question, {P.BOX} || expected || chr(125) as answer from traces join good using (row_id)"""


@register("verified_chats", _VC)
def verified_chats(spark, sf):
    from assayer.plans.dataset import solved_rows, verified_chats as build
    rows = D.puzzles(spark, sf)
    chats = build(rows, solved_rows(rows, ("unit",)), "unit_solver", "\nPut the answer in a box.")
    return chats.select("row_id", "_meta.source", "_meta.puzzle_type", F.md5(F.get("messages", F.lit(0))["content"]).alias("question"),
                        F.get("messages", F.lit(1))["content"].alias("answer"))
