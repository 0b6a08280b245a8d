"""Registered queries: candidates, votes, sampling and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import joins as J, selection as S
from assayer.operators.quantiles import rank_in_order
from assayer.plans import derive as D
from registry import parts as P
from registry.text import long_eval

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


# Candidate answers: the lines of an order in a total order; the truth comes from the order status.
_LINE_KEY = """md5(concat_ws('-', l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), cast(round(l_discount * 100) as bigint),
  cast(round(l_tax * 100) as bigint), l_returnflag, l_linestatus))"""
_CAND = f"""cand as materialized (select l_orderkey as prompt_id, row_number() over (partition by l_orderkey order by l_linenumber, {_LINE_KEY}) - 1 as k, l_returnflag as answer,
  case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as expected, o_orderpriority as type, repeat(l_returnflag, cast(l_quantity as int)) || l_linestatus as text
  from lineitem join orders on o_orderkey = l_orderkey), judged as materialized (select *, answer = expected as ok from cand),
prompts as (select o_orderkey as prompt_id, 'fallback ' || o_orderkey as fallback, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as expected, o_orderpriority as type from orders)"""


def prompts(spark, sf):
    status = F.col("o_orderstatus")
    return D.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompt_id"), F.concat(F.lit("fallback "), F.col("o_orderkey").cast("string")).alias("fallback"),
        F.when(status == "F", "A").when(status == "O", "N").otherwise("R").alias("expected"), F.col("o_orderpriority").alias("type"))


def candidates(spark, sf, ranked: bool = True, ordered: bool = False):
    """Lines of an order, numbered in a total order where the query needs ``k``, per salted part so that a huge order is no single task.

    With ``ordered``, ``k`` is the place in that order itself, for queries that only ask which line comes first: nothing is ranked.
    """
    read = D.read(spark, sf, "lineitem")
    if ordered:
        # Aggregates over such a place sort the rows of their task. Lines are dealt out evenly before, so that a task sorts a shuffle partition and not
        # the many rows of a compressed file split; the lines of a huge order are spread too.
        read = read.select("l_orderkey", "l_returnflag", "l_quantity", "l_linestatus", F.struct("l_linenumber", F.unhex(F.expr(_LINE_KEY)).alias("line_key")).alias("place")).repartition("l_orderkey", "place.l_linenumber")
    elif ranked:
        read = rank_in_order(read.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_linestatus", F.expr(_LINE_KEY).alias("line_key")), F.col("l_linenumber"), F.col("line_key"), ["l_orderkey"])
    k = [F.col("place").alias("k")] if ordered else [(F.col("rank") - 1).alias("k")] if ranked else []
    lines = read.select(
        F.col("l_orderkey").alias("prompt_id"), *k, F.col("l_returnflag").alias("answer"),
        F.concat(F.repeat("l_returnflag", F.col("l_quantity").cast("int")), "l_linestatus").alias("text"))
    return lines.join(prompts(spark, sf).drop("fallback"), "prompt_id").withColumn("ok", F.col("answer") == F.col("expected"))


@register("best_candidate", f"""with {_CAND}, b as (select prompt_id, count(*) as num_candidates, count(*) filter (where ok) as num_correct from judged group by 1),
  t as (select prompt_id, text from judged where ok qualify row_number() over (partition by prompt_id order by length(text) desc, k) = 1)
  select p.prompt_id, coalesce(t.text, fallback) as text, coalesce(num_correct, 0) as num_correct, coalesce(num_candidates, 0) as num_candidates, coalesce(num_correct, 0) = 0 as is_fallback
  from prompts p left join b using (prompt_id) left join t using (prompt_id)""")
def best_candidate(spark, sf):
    return S.best_candidate(prompts(spark, sf), candidates(spark, sf, ordered=True))


_LOOP = """loop as (select *, max(ok::int) over (partition by prompt_id order by k rows between unbounded preceding and 1 preceding) as before from judged),
  made as (select * from loop where not (coalesce(before, 0) = 1 and k >= 3))"""


@register("first_correct_with_limit", f"""with {_CAND}, {_LOOP}, t as (select prompt_id, text, k from made where ok qualify row_number() over (partition by prompt_id order by length(text) desc, k) = 1)
  select m.prompt_id, count(*) as attempts, any_value(t.text) as best, any_value(t.k) as best_k from made m left join t using (prompt_id) group by m.prompt_id""")
def first_correct_with_limit(spark, sf):
    return S.first_correct_with_limit(candidates(spark, sf))


@register("difficulty_band", f"""with {_CAND} select prompt_id, count(*) filter (where ok) as correct, count(*) as k, case when not bool_or(ok) then 'hard' when bool_and(ok) then 'easy' else 'between' end as band,
  round(avg(ok::int), 9) as correct_rate from judged group by 1""")
def difficulty_band(spark, sf):
    return S.difficulty_band(candidates(spark, sf, ranked=False)).withColumn("correct_rate", F.round("correct_rate", 9))


@register("acceptance_stats", f"""with {_CAND}, g as (select prompt_id, type, count(*) filter (where ok) as c, count(*) as k from judged group by 1, 2)
  select case when grouping(type) = 1 then 'ALL' else type end as type, count(*) as processed, count(*) filter (where c > 0) as accepted, round(avg(c), 9) as mean_correct,
  count(*) filter (where c = 0) as fallbacks, round(sum(c) / sum(k), 9) as candidate_rate from g group by rollup(type)""")
def acceptance_stats(spark, sf):
    return S.acceptance_stats(candidates(spark, sf, ranked=False)).withColumns({c: F.round(c, 9) for c in ("mean_correct", "candidate_rate")})


_VOTE = """votes as (select prompt_id, answer, count(*) as votes, min(k) as first from judged group by 1, 2),
  vote as (select prompt_id, answer, votes from votes qualify row_number() over (partition by prompt_id order by votes desc, first) = 1)"""


@register("majority_vote", f"with {_CAND}, {_VOTE} select prompt_id, answer, votes from vote")
def majority_vote(spark, sf):
    return S.majority_vote(candidates(spark, sf, ordered=True))


@register("vote_oracle_greedy", f"""with {_CAND}, {_VOTE}, o as (select prompt_id, bool_or(ok) as any_ok, bool_or(ok) filter (where k = 0) as first_ok from judged group by 1)
  select count(*) as n, round(avg(coalesce(answer = expected, false)::int), 9) as vote, round(avg(coalesce(any_ok, false)::int), 9) as oracle, round(avg(coalesce(first_ok, false)::int), 9) as greedy
  from prompts left join vote using (prompt_id) left join o using (prompt_id)""")
def vote_oracle_greedy(spark, sf):
    out = S.vote_oracle_greedy(candidates(spark, sf, ordered=True), prompts(spark, sf))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("vote", "oracle", "greedy")])


@register("pass_at_k", f"""with {_CAND}, g as (select prompt_id, count(*) filter (where ok) as c, count(*) as n from judged group by 1)
  select count(*) as prompts, round(avg((c > 0)::int), 9) as pass_any, round(avg(c / n), 9) as win_rate, count(*) filter (where c = 0) as without,
  round(avg(case when n < 2 then (c > 0)::int when n - c < 2 then 1.0::double else 1 - (n - c) * (n - c - 1) / (n * (n - 1))::double end), 9) as pass_at_k from g""")
def pass_at_k(spark, sf):
    return S.pass_at_k(candidates(spark, sf, ranked=False), 2).withColumns({c: F.round(c, 9) for c in ("pass_any", "win_rate", "pass_at_k")})


@register("preference_pairs", f"""with {P.EVAL}, a as (select row_id, prompt, expected, text, {P.last_box('text')} as got from ev where run = 'a'),
  gold as (select prompt, min(b_text) as gold_text from traces where row_id % 3 = 0 group by prompt),
  w as (select a.row_id, a.prompt, coalesce(gold_text, '<think>' || chr(10) || 'Let me solve this step by step.' || chr(10) || 'After careful analysis of the pattern from the examples, I determine the answer.'
    || chr(10) || '</think>' || chr(10) || chr(10) || {P.BOX} || expected || chr(125)) as chosen, text as rejected from a left join gold using (prompt)
    where not coalesce(case when {P.num('expected')} is not null and {P.num('got')} is not null then round({P.num('expected')}, 2) = round({P.num('got')}, 2)
      when {P.num('expected')} is null and {P.num('got')} is null then {P.same('expected', 'got')} else false end, false))
  select row_id, md5(chosen) as chosen, md5(rejected) as rejected, 'wrong' as origin from w""")
def preference_pairs(spark, sf):
    rows = D.traces(spark, sf)
    gold = rows.where(F.col("row_id") % 3 == 0).select("prompt", F.col("b_text").alias("gold_text"))
    outputs = rows.select("row_id", "prompt", F.col("expected").alias("answer"), F.col("a_text").alias("text"))
    return J.preference_pairs(outputs, gold).select("row_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "origin")


_TOP = f"""with {P.TRACES}, gold as (select prompt, min(b_text) as gold_text from traces where row_id % 3 = 0 group by prompt), firsts as (select row_id, prompt, expected from traces order by row_id limit 60)
  select row_id, md5(gold_text) as chosen, md5('<think>' || chr(10) || 'The answer is.' || chr(10) || '</think>' || chr(10) || chr(10) || {P.BOX} || expected || chr(125)) as rejected, 'top_up' as origin from firsts join gold using (prompt)"""


@register("preference_pairs_top_up", _TOP)
def preference_pairs_top_up(spark, sf):
    """All outputs right, so every pair comes from the top-up."""
    rows = D.traces(spark, sf)
    gold = rows.where(F.col("row_id") % 3 == 0).select("prompt", F.col("b_text").alias("gold_text"))
    right = F.concat(F.lit("\\boxed{"), F.col("expected"), F.lit("}"))
    outputs = rows.select("row_id", "prompt", F.col("expected").alias("answer"), right.alias("text"))
    return J.preference_pairs(outputs, gold).select("row_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "origin")


# --- Sampling: documents by language ----------------------------------------------------------------------------------
_DOCS = "docs as (select doc_id as row_id, lang as type, source, n_chars from documents)"


def docs(spark, sf):
    return D.read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("type"), "source", "n_chars")


def _hash(seed: str, key: str = "row_id") -> str:
    return f"md5('{seed}-' || {key})"


def _ranked(seed: str, group: str = "type", source: str = "docs") -> str:
    return f"select *, row_number() over (partition by {group} order by {_hash(seed)}, row_id) as r from {source}"


@register("stratified_n", f"with {_DOCS} select row_id, type from ({_ranked('s1')}) z where r <= 40 and type <> 'de'")
def stratified_n(spark, sf):
    return S.stratified_n(docs(spark, sf), 40, "s1", drop="de").select("row_id", "type")


@register("stratified_n_large", f"with o as (select o_orderkey as row_id, o_orderpriority as type from orders) select row_id, type from ({_ranked('s1', source='o')}) z where r <= 1500")
def stratified_n_large(spark, sf):
    rows = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("type"))
    return S.stratified_n(rows, 1500, "s1").select("row_id", "type")


@register("stratified_total", f"""with {_DOCS} select row_id, type from ({_ranked('s2')}) z where r <= case type when 'de' then 33 when 'en' then 33 when 'es' then 32 else 32 end""")
def stratified_total(spark, sf):
    return S.stratified_total(docs(spark, sf), 130, ["en", "de", "fr", "es"], "s2").select("row_id", "type")


@register("stratified_trim", f"""with {_DOCS} select row_id, type from (select * from ({_ranked('s3')}) z where r <= 50) y order by {_hash('s3-trim')}, row_id limit 90""")
def stratified_trim(spark, sf):
    return S.stratified_trim(docs(spark, sf), 50, 90, "s3").select("row_id", "type")


@register("reservoir", f"with {_DOCS} select row_id from docs order by {_hash('s4')}, row_id limit 100")
def reservoir(spark, sf):
    return S.reservoir(docs(spark, sf), 100, "s4").select("row_id")


@register("reservoir_large", f"with o as (select o_orderkey as row_id from orders) select row_id from o order by {_hash('s4')}, row_id limit 3000")
def reservoir_large(spark, sf):
    return S.reservoir(D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), 3000, "s4").select("row_id")


@register("shuffle_key", f"with {_DOCS} select row_id, {_hash('s5')} as order_key from docs")
def shuffle_key(spark, sf):
    return S.shuffled(docs(spark, sf), "s5").select("row_id", "order_key")


def _answer_id():
    """One number for the answer of a run to a puzzle."""
    return (F.col("row_id") * 2 + (F.col("run") == "b").cast("int")).alias("row_id")


@register("take_quota_solved", f"""with {P.EVAL} select row_id from (select row_id * 2 + (run = 'b')::int as row_id, ok from ev) e where ok order by {_hash('s6')}, row_id limit 25""")
def take_quota_solved(spark, sf):
    rows = long_eval(spark, sf)
    return S.take_quota_solved(rows.select(_answer_id(), "ok"), 25, "s6", verified="ok").select("row_id")


@register("top_k_counts", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20")
def top_k_counts(spark, sf):
    return S.top_counts(D.read(spark, sf, "lineitem").select("l_partkey"), "l_partkey", 20)


@register("sample_cases", f"""with {P.PAIRED}, o as (select row_id, {P.outcome()} as outcome from paired), r as (select *, row_number() over (partition by outcome order by row_id) as rank from o)
  select row_id, outcome, md5(substr(prompt, 1, 400)) as digest from r join traces using (row_id) where rank <= 5""")
def sample_cases(spark, sf):
    from assayer.operators.evaluation import outcome, paired
    rows = paired(long_eval(spark, sf), "a", "b", ("prompt",)).withColumn("outcome", outcome(F.col("a_ok"), F.col("b_ok")))
    return S.sample_cases(rows, "outcome", 5).select("row_id", "outcome", F.md5("prompt").alias("digest"))


_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@register("length_batches", f"""with {P.EVAL}, m as (select row_id * 2 + (run = 'b')::int as row_id, {_W} as words from ev), kept as (select row_id, least(len(words), 450) as length from m
  where contains(array_to_string(words[1:450], ' '), 'boxed')) select row_id, cast(length as int) as length, cast((row_number() over (order by length, md5(cast(row_id as varchar))) - 1) // 16 as bigint) as batch from kept""")
def length_batches(spark, sf):
    rows = long_eval(spark, sf).select(_answer_id(), "text")
    return S.length_batches(rows, 16, 450).select("row_id", "length", "batch")


@register("curriculum_order", f"""with {_CAND}, b as (select prompt_id, avg(ok::int) as correct_rate from judged group by 1)
  select prompt_id, ntile(7) over (order by -correct_rate, md5(cast(prompt_id as varchar))) as stage from b""")
def curriculum_order(spark, sf):
    bands = S.difficulty_band(candidates(spark, sf, ranked=False)).select("prompt_id", "correct_rate")
    return S.curriculum_order(bands, 7).select("prompt_id", F.col("stage").cast("bigint").alias("stage"))
