"""Registered queries: accuracy, comparison of runs, calibration, audits and the release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import markers as M, style
from assayer.operators import evaluation as E, gate as G, joins as J
from assayer.plans import derive as D
from registry import parts as P
from registry.text import long_eval

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def rounded(frame, *columns, places=9):
    return frame.withColumns({c: F.round(c, places) for c in columns})


# --- Two runs from the label table: quality and toxicity flags of documents ------------------------------------------
_LABELLED = """labelled as (select doc_id as row_id, lang as type, source, quality = 1 as a_ok, toxic = 0 as b_ok
  from documents join labels using (doc_id))"""


def labelled(spark, sf):
    docs = D.documents(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("type"), "source")
    flags = D.read(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") == 1).alias("a_ok"), (F.col("toxic") == 0).alias("b_ok"))
    return docs.join(flags, "row_id")


def _bucket_sql(key: str, source: str) -> str:
    return f"""select case when grouping({key}) = 1 then 'ALL' else {key} end as {key}, count(*) as n,
  count(*) filter (where o = 'both_right') as both_right, count(*) filter (where o = 'both_wrong') as both_wrong,
  count(*) filter (where o = 'regression') as regression, count(*) filter (where o = 'improvement') as improvement,
  round(avg(b_ok::int) - avg(a_ok::int), 9) as delta from (select *, {P.outcome()} as o from {source}) z group by rollup({key})"""


@register("outcome_buckets_by_type", f"with {_LABELLED} {_bucket_sql('type', 'labelled')}")
def outcome_buckets_by_type(spark, sf):
    return rounded(E.outcome_buckets(labelled(spark, sf)), "delta")


@register("outcome_buckets_by_source", f"with {_LABELLED} {_bucket_sql('source', 'labelled')}")
def outcome_buckets_by_source(spark, sf):
    return rounded(E.outcome_buckets(labelled(spark, sf), "source"), "delta")


@register("outcome_buckets_of_runs", f"with {P.PAIRED} {_bucket_sql('type', 'paired')}")
def outcome_buckets_of_runs(spark, sf):
    return rounded(E.outcome_buckets(E.paired(long_eval(spark, sf), "a", "b")), "delta")


@register("pair_runs", f"with {P.PAIRED} select row_id, type, a_ok, b_ok from paired")
def pair_runs(spark, sf):
    return E.paired(long_eval(spark, sf), "a", "b")


def _net_sql(key: str) -> str:
    up, down = "count(*) filter (where b_ok and not a_ok)", "count(*) filter (where a_ok and not b_ok)"
    return f"with {P.PAIRED} select {key}, {up} as improvements, {down} as regressions, {up} - {down} as net from paired group by {key}"


@register("net_change_by_type", _net_sql("type"))
def net_change_by_type(spark, sf):
    return E.net_change(E.paired(long_eval(spark, sf), "a", "b"))


@register("net_change_by_source", _net_sql("source"))
def net_change_by_source(spark, sf):
    return E.net_change(E.paired(long_eval(spark, sf), "a", "b", ("type", "source")), "source")


@register("accuracy_by_type_run", f"""with {P.EVAL} select type, run, count(*) as n, count(*) filter (where ok) as correct,
  round(avg(ok::int), 9) as acc from ev group by 1, 2""")
def accuracy_by_type_run(spark, sf):
    return rounded(E.accuracy_by(long_eval(spark, sf), "type", "run"), "acc")


@register("accuracy_with_total", f"""with {P.EVAL} select case when grouping(type) = 1 then 'ALL' else type end as type, count(*) as n,
  count(*) filter (where ok) as correct, round(avg(ok::int), 9) as acc from ev group by rollup(type)""")
def accuracy_with_total(spark, sf):
    return rounded(E.accuracy_with_total(long_eval(spark, sf)), "acc")


@register("solve_report", f"""with {P.EVAL}, s as (select row_id, run || ':' || type as category, case when box = '' then 'unsolved' when {P.strip('box')} = {P.strip('expected')} then 'correct'
  else 'wrong' end as status from ev), w as (select category, string_agg(cast(row_id as varchar), ',' order by row_id) as ids from
  (select * from s where status = 'wrong' qualify row_number() over (partition by category order by row_id) <= 3) z group by 1)
  select category, count(*) filter (where status = 'correct') as correct, count(*) filter (where status = 'wrong') as wrong,
  count(*) filter (where status = 'unsolved') as unsolved, count(*) as total, coalesce(any_value(ids), '') as wrong_samples from s left join w using (category) group by 1""")
def solve_report(spark, sf):
    rows = long_eval(spark, sf)
    return E.solve_report(rows.select("row_id", F.concat("run", F.lit(":"), "type").alias("category"), F.nullif("box", F.lit("")).alias("predicted"), F.col("expected").alias("answer")))


@register("solve_samples", f"""with {P.EVAL} select run || ':' || type as category, row_id, box as predicted, expected as answer, md5(prompt) as prompt from ev
  where box <> '' and {P.strip('box')} <> {P.strip('expected')} qualify row_number() over (partition by run, type order by row_id) <= 3""")
def solve_samples(spark, sf):
    rows = long_eval(spark, sf)
    found = E.solve_samples(rows.select("row_id", F.concat("run", F.lit(":"), "type").alias("category"), F.nullif("box", F.lit("")).alias("predicted"), F.col("expected").alias("answer"), "prompt"))
    return found.withColumn("prompt", F.md5("prompt"))


# --- Confidence and style ---------------------------------------------------------------------------------------------
_LOW = "lower(text)"
_CONF = (f"greatest(0.0::double, least(1.0::double, case when contains(text, {P.BOX}) then 0.7::double else 0.3::double end "
         f"+ 0.1::double * {P.count_parts('low', M.CONFIDENT)} + (-0.1::double) * {P.count_parts('low', M.DOUBTFUL)} "
         f"+ 0.05::double * {P.count_parts('low', M.DECLARATIVE)}))")
SCORED = f"{P.EVAL}, scored as materialized (select row_id, type, run, ok, text, {_CONF} as confidence from (select *, lower(text) as low from ev) l)"


def scored(spark, sf):
    return style.with_confidence(long_eval(spark, sf))


@register("confidence", f"with {SCORED} select row_id, run, round(confidence, 9) as confidence from scored")
def confidence(spark, sf):
    return rounded(scored(spark, sf).select("row_id", "run", "confidence"), "confidence")


@register("calibration", f"""with {SCORED} select run, count(*) as n, round(avg(ok::int), 9) as accuracy, round(avg(confidence), 9) as mean_confidence,
  round(avg((not ok and confidence > 0.7::double)::int), 9) as overclaim, round(avg((ok and confidence < 0.3::double)::int), 9) as underclaim,
  round(coalesce(avg(confidence) filter (where ok), 0), 9) as confidence_when_correct, round(coalesce(avg(confidence) filter (where not ok), 0), 9) as confidence_when_wrong
  from scored group by run""")
def calibration(spark, sf):
    frame = E.calibration(scored(spark, sf), "run")
    return rounded(frame, "accuracy", "mean_confidence", "overclaim", "underclaim", "confidence_when_correct", "confidence_when_wrong")


ECE_SQL = """bins as (select run, greatest(0, least(9, floor(confidence * 10))) as bin, count(*) as n, avg(ok::int) as acc, avg(confidence) as conf from scored group by 1, 2),
errors as (select run, cast(sum(n) as bigint) as n, sum(abs(acc - conf) * n) / sum(n) as ece from bins group by run)"""


@register("calibration_error", f"with {SCORED}, {ECE_SQL} select run, n, round(ece, 9) as ece from errors")
def calibration_error(spark, sf):
    return rounded(E.ece(scored(spark, sf), 10, "run"), "ece")


_OPEN, _CLOSE = "position('<think>' in text)", "position('</think>' in text)"
_BLOCK = (f"case when {_OPEN} > 0 and {_CLOSE} >= {_OPEN} + 7 then substr(text, {_OPEN} + 7, {_CLOSE} - {_OPEN} - 7) "
          f"when {_OPEN} > 0 and position(chr(92) || 'boxed' in substr(text, {_OPEN} + 7)) > 0 then substr(substr(text, {_OPEN} + 7), 1, position(chr(92) || 'boxed' in substr(text, {_OPEN} + 7)) - 1) "
          f"when {_OPEN} > 0 then '' when {_CLOSE} > 0 then substr(text, 1, {_CLOSE} - 1) else '' end")
_CHUNKS = f"list_filter(string_split(block, chr(10)), lambda c: {P.strip('c')} <> '')"
STYLED = f"""{P.EVAL}, blocked as materialized (select *, lower(text) as low, {_BLOCK} as block from ev),
styled as materialized (select row_id, type, run, text, length(block) as think_chars,
  len(list_filter(regexp_split_to_array(block, '\\s+'), lambda w: w <> '')) as think_words, case when block = '' then 0 else len(string_split(block, chr(10))) end as think_lines,
  {P.count_parts('low', M.ATTEMPT)} as attempts, {P.count_parts('low', M.SELF_CORRECTION)} as self_corrections, {P.count_parts('low', M.STYLE_HIGH)} as confident,
  {P.count_parts('low', M.STYLE_LOW)} as doubtful, {P.count_parts('low', M.STYLE_HIGH)} / ({P.count_parts('low', M.STYLE_HIGH)} + {P.count_parts('low', M.STYLE_LOW)} + 1) as confidence_ratio,
  {P.count_parts('low', M.VERIFICATION)} as verifications,
  coalesce(cast(floor(list_sum(list_transform({_CHUNKS}, lambda c: length(c))) / nullif(len({_CHUNKS}), 0)) as int), 0) as chunk_length,
  {P.matches('text', r'\b[0-9]+(?:\.[0-9]+)?\b')} / nullif(length(text) / 100.0::double, 0) as numeric_density,
  {P.matches('text', r'(?:^|\s)([A-Z][A-Z0-9_]{1,15}):')} as labels from blocked)"""
_STYLE_INTS = ["think_chars", "think_words", "think_lines", "attempts", "self_corrections", "confident", "doubtful", "verifications", "chunk_length", "labels"]
_STYLE_DOUBLES = ["confidence_ratio", "numeric_density"]


def styled(spark, sf):
    return style.with_style(long_eval(spark, sf), "row_id", "type", "run")


@register("style_metrics", f"""with {STYLED} select row_id, run, {', '.join(f'cast({c} as bigint) as {c}' for c in _STYLE_INTS)},
  {', '.join(f'round({c}, 6) as {c}' for c in _STYLE_DOUBLES)} from styled""")
def style_metrics(spark, sf):
    frame = styled(spark, sf)
    return frame.select("row_id", "run", *[F.col(c).cast("bigint").alias(c) for c in _STYLE_INTS], *[F.round(c, 6).alias(c) for c in _STYLE_DOUBLES])


@register("fingerprint_means", f"""with {STYLED} select type, run, {', '.join(f'round(avg({c}), 6) as {c}' for c in _STYLE_INTS + _STYLE_DOUBLES)} from styled group by type, run""")
def fingerprint_means(spark, sf):
    return styled(spark, sf).groupBy("type", "run").agg(*[F.round(F.avg(c), 6).alias(c) for c in _STYLE_INTS + _STYLE_DOUBLES])


@register("marker_counts", f"""with {P.EVAL}, low as (select run, type, lower(text) as low from ev) select run, type,
  {', '.join(f'cast(sum({P.count_parts("low", m)}) as bigint) as {n}' for n, m in (('confident', M.CONFIDENT), ('doubtful', M.DOUBTFUL), ('declarative', M.DECLARATIVE), ('attempts', M.ATTEMPT)))}
  from low group by run, type""")
def marker_counts(spark, sf):
    low = F.col("low")
    families = (("confident", M.CONFIDENT), ("doubtful", M.DOUBTFUL), ("declarative", M.DECLARATIVE), ("attempts", M.ATTEMPT))
    rows = long_eval(spark, sf).select("run", "type", F.lower("text").alias("low"))
    return rows.groupBy("run", "type").agg(*[F.sum(style.marker_count(low, m)).alias(n) for n, m in families])


_REST = r"regexp_replace(text, '\\boxed\{([^{}]*)\}', '', 'g')"


@register("copy_ratio", f"""with {P.EVAL}, n as (select row_id, run, {P.strip("coalesce(list_extract(regexp_extract_all(text, '" + r"\\boxed\{([^{}]*)\}" + "', 1), -1), '')")} as needle, {_REST} as rest from ev)
  select row_id, run, round(case when needle = '' or rest = '' then 0.0::double when contains(rest, needle) then 1.0 else coalesce((select max(len) from (
    select unnest(range(1, length(needle) + 1)) as i) s, lateral (select unnest(range(1, length(needle) - i + 2)) as len) t where contains(rest, substr(needle, i, len))), 0) / length(needle)::double end, 9) as ratio from n""")
def copy_ratio(spark, sf):
    return long_eval(spark, sf).select("row_id", "run", F.round(style.copy_ratio(F.col("text")), 9).alias("ratio"))


# --- Corpus reports ---------------------------------------------------------------------------------------------------
@register("quality_report", f"""with {P.EVAL} select run, count(*) as total, round(avg(length(text)), 6) as mean_length, count(*) filter (where contains(text, {P.BOX})) as has_boxed,
  count(*) filter (where contains(text, '<think>')) as has_think, count(*) filter (where length(text) < 1000) as short, count(*) filter (where length(text) >= 1000) as long from ev group by run""")
def quality_report(spark, sf):
    rows = long_eval(spark, sf)
    frames = [E.quality_report(rows.where(F.col("run") == r), short=1000).withColumn("run", F.lit(r)) for r in ("a", "b")]
    return rounded(frames[0].unionByName(frames[1]), "mean_length", places=6)


_INNER = "regexp_extract(text, '(?s)<think>\\n(.*?)\\n</think>', 1)"


@register("detail_report", f"""with {P.EVAL}, d as (select regexp_matches(text, '(?s)<think>\\n.*?\\n</think>') as present, len(string_split({P.strip(_INNER)}, chr(10))) as n from ev)
  select count(*) filter (where present and n >= 20) as detailed, count(*) filter (where present and n < 20) as brief, count(*) as total from d""")
def detail_report(spark, sf):
    return E.detail_report(long_eval(spark, sf), lines=20)


@register("length_stats", f"with {P.EVAL} select type, count(*) as n, round(avg(length(text)), 6) as mean_length from ev group by type")
def length_stats(spark, sf):
    return rounded(E.length_stats(long_eval(spark, sf)), "mean_length", places=6)


@register("composition", f"""with {P.TRACES} select coalesce(source, '*') as source, coalesce(type, '*') as type, count(*) as n from traces
  group by grouping sets ((source), (type), (source, type))""")
def composition(spark, sf):
    return E.composition(D.puzzles(spark, sf).select("source", "type"))


@register("format_hygiene", f"""with {P.EVAL} select type, run, round(avg(contains(text, {P.BOX})::int), 9) as has_boxed, round(avg((not contains(text, {P.BOX}) and length(text) > 3000)::int), 9) as truncated,
  round(avg(len(string_split(text, {P.BOX})) - 1), 9) as boxes_per_text from ev group by type, run""")
def format_hygiene(spark, sf):
    return rounded(E.format_hygiene(long_eval(spark, sf), limit=3000), "has_boxed", "truncated", "boxes_per_text")


@register("coverage_check", f"""with {P.TRACES}, wanted as (select unnest(['binary', 'cipher', 'equation', 'gravity', 'roman', 'unit', 'sudoku']) as type)
  select w.type, count(t.row_id) as n from wanted w left join (select * from traces where not (type = 'unit' and row_id % 8 <> 5)) t using (type) group by w.type having count(t.row_id) < 50""")
def coverage_check(spark, sf):
    rows = D.puzzles(spark, sf).where(~((F.col("type") == "unit") & (F.col("row_id") % 8 != 5)))
    return E.coverage_check(rows, [*D.TYPES, "sudoku"], 50)


_TRUTH = """truth as (select prompt, case when row_id % 5 = 0 then expected || '!' else expected end as answer from traces where row_id % 7 <> 0)"""
_AUDIT = f"""{P.EVAL}, {_TRUTH}, answers as (select {P.strip('prompt')} as key_prompt, min(answer) as answer from truth group by 1),
audited as (select ev.*, {P.strip("regexp_extract(list_extract(string_split(text, '</think>'), -1), '" + r"\\boxed\{([^}]+)\}" + "', 1)")} as got, answer,
  contains(text, '</think>') and contains(list_extract(string_split(text, '</think>'), -1), {P.BOX}) as placed
  from ev left join answers on {P.strip('prompt')} = key_prompt)"""


def truth(spark, sf):
    rows = D.puzzles(spark, sf).where(F.col("row_id") % 7 != 0)
    return rows.select("prompt", F.when(F.col("row_id") % 5 == 0, F.concat("expected", F.lit("!"))).otherwise(F.col("expected")).alias("answer"))


@register("truth_audit", f"""with {_AUDIT} select type, case when answer is null then 'missing' when got = {P.strip('answer')} then 'ok' else 'wrong' end as status, count(*) as n from audited group by 1, 2""")
def truth_audit(spark, sf):
    return J.truth_audit(long_eval(spark, sf), truth(spark, sf)).groupBy("type", "status").agg(F.count("*").alias("n"))


@register("corpus_audit", f"""with {_AUDIT} select source, count(*) as rows, round(avg(placed::int), 9) as boxed_after_think, round(avg(coalesce(got = {P.strip('answer')}, false)::int), 9) as truth_match,
  count(*) - count(distinct md5(text)) as duplicates, avg(placed::int) >= 0.6::double as passes from audited group by source""")
def corpus_audit(spark, sf):
    return rounded(E.corpus_audit(long_eval(spark, sf), truth(spark, sf), target=0.6), "boxed_after_think", "truth_match")


# --- Joins ------------------------------------------------------------------------------------------------------------
@register("enrich_prompt", f"""with {P.TRACES}, dump as (select row_id, type, expected, prompt, row_number() over (partition by type, expected order by row_id) as k from traces),
  known as (select * from dump where row_id % 3 <> 0), first as (select type, expected, prompt from known qualify row_number() over (partition by type, expected order by row_id) = 1)
  select d.row_id, md5(coalesce(f.prompt, 'preview ' || d.row_id)) as digest from dump d left join first f using (type, expected)""")
def enrich_prompt(spark, sf):
    rows = D.puzzles(spark, sf)
    dump = rows.select("row_id", "type", "expected", F.concat(F.lit("preview "), F.col("row_id").cast("string")).alias("prompt_preview"))
    known = rows.where(F.col("row_id") % 3 != 0).withColumnRenamed("expected", "answer")
    return J.enrich_prompt(dump, known).select("row_id", F.md5("prompt").alias("digest"))


@register("score_submission", f"""with {P.EVAL}, sub as (select row_id, box from ev where run = 'a' and row_id % 9 <> 4), s as (
  select {P.metric('t.expected', 'sub.box')} as good from traces t left join sub using (row_id))
  select count(*) as n, count(*) filter (where good) as correct, round(avg(good::int), 9) as score from s""")
def score_submission(spark, sf):
    rows = long_eval(spark, sf).where(F.col("run") == "a")
    submission = rows.where(F.col("row_id") % 9 != 4).select("row_id", "box")
    return rounded(E.score(rows.select("row_id", "expected"), submission), "score")


@register("restrict_to", "select doc_id as row_id, source from documents where doc_id in (select doc_id from labels)")
def restrict_to(spark, sf):
    docs = D.documents(spark, sf).select(F.col("doc_id").alias("row_id"), "source")
    return J.restrict_to(docs, D.read(spark, sf, "labels").select(F.col("doc_id").alias("row_id")))


@register("remaining", "select doc_id as row_id, source from documents where doc_id not in (select doc_id from labels)")
def remaining(spark, sf):
    docs = D.documents(spark, sf).select(F.col("doc_id").alias("row_id"), "source")
    return J.remaining(docs, D.read(spark, sf, "labels").select(F.col("doc_id").alias("row_id")))


@register("id_difference", "select doc_id from documents except select doc_id from labels")
def id_difference(spark, sf):
    return D.documents(spark, sf).select("doc_id").exceptAll(D.read(spark, sf, "labels").select("doc_id"))


@register("teacher_union", """with t as (select doc_id as row_id, md5(text) as digest, 0 as teacher from documents where doc_id % 3 <> 0
  union all select doc_id, md5(text || '+'), 1 from documents where doc_id % 4 <> 1)
  select row_id, arg_min(digest, teacher) as digest, min(teacher) as teacher, count(distinct teacher) > 1 as overlap from t group by row_id""")
def teacher_union(spark, sf):
    docs = D.documents(spark, sf).select(F.col("doc_id").alias("row_id"), "text")
    second = docs.where(F.col("row_id") % 4 != 1).withColumn("text", F.concat("text", F.lit("+")))
    return J.teacher_union(docs.where(F.col("row_id") % 3 != 0), second).select("row_id", F.md5("text").alias("digest"), "teacher", "overlap")


# --- Release gate -----------------------------------------------------------------------------------------------------
_GATE = f"""{SCORED}, {ECE_SQL}, paired as (select row_id, bool_or(ok) filter (where run = 'a') as a_ok, bool_or(ok) filter (where run = 'b') as b_ok from ev group by row_id),
one as (select avg(ok::int) as total_accuracy, coalesce(avg(ok::int) filter (where type = 'cipher'), 1.0) as cipher_accuracy, coalesce(avg(ok::int) filter (where type = 'binary'), 0.0) as binary_accuracy,
  count(*) filter (where type in ('gravity', 'unit', 'roman') and not ok and {P.present('lower(text)', M.DRIFT['unit'])} >= 2) as drift_flags,
  avg(contains(text, {P.BOX})::int) as format_share, avg((not ok and confidence > 0.7::double)::int) as overclaim from scored where run = 'b'),
change as (select count(*) filter (where b_ok and not a_ok) as improvements, count(*) filter (where a_ok and not b_ok) as regressions from paired),
m as (select one.*, change.*, ece from one, change, errors where errors.run = 'b'),
gates as (select unnest(['cipher_accuracy', 'no_template_drift', 'format_share', 'regressions_below_improvements', 'total_accuracy', 'binary_accuracy', 'overclaim', 'ece']) as gate,
  unnest([true, true, true, true, false, false, false, false]) as hard, unnest([cipher_accuracy >= 0.8::double, drift_flags <= 0, format_share >= 1.0::double, regressions < improvements,
  total_accuracy >= 0.7::double, binary_accuracy >= 0.5::double, overclaim <= 0.3::double, ece <= 0.1::double]) as passed from m)"""


def gate_measures(spark, sf):
    rows = scored(spark, sf)
    drift = F.col("type").isin("gravity", "unit", "roman") & ~F.col("ok") & (E.contains_markers(F.lower("text")) >= 2)
    latest = rows.where(F.col("run") == "b").withColumns({"drift": drift, "boxed": F.contains("text", F.lit("\\boxed{"))})
    return G.gate_inputs(latest, E.paired(rows, "a", "b"))


@register("gate_table", f"with {_GATE} select gate, hard, passed from gates")
def gate_table(spark, sf):
    return G.gates(gate_measures(spark, sf))


@register("release_gate", f"""with {_GATE} select bool_and(passed or not hard) as hard_pass, count(*) filter (where passed and not hard) as soft_passed, count(*) filter (where not hard) as soft_total,
  case when not bool_and(passed or not hard) then 'ABORT' when count(*) filter (where passed and not hard) >= 4 then 'STRONG' when count(*) filter (where passed and not hard) >= 2 then 'MARGINAL' else 'WEAK' end as verdict from gates""")
def release_gate(spark, sf):
    return G.release_gate(gate_measures(spark, sf))
