"""Registered queries: text extraction, routing, chats and answer equivalence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions import match, text as T
from assayer.plans import derive as D
from registry import parts as P

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


SUFFIX = "\nPlease put your final answer in a box."


def answer_texts_sql(documents: str, number: str) -> str:
    """Document texts ending in boxed, nested, unclosed, stated or missing answers, by document number."""
    box = "concat(chr(92), 'boxed', chr(123))"
    o, c = "chr(123)", "chr(125)"
    n = number
    cases = [
        f"concat({box}, {n}, {c})",
        f"concat({box}, 'a', {o}, {n}, {c}, 'c', {c}, ' then ', {box}, ' d', {n}, ' ', {c}, ' done')",
        f"concat({box}, 'p', {o}, 'q', {o}, 'r', {c}, {c}, 's', {n}, {c})",
        f"concat({box}, 'first', {n}, {c}, ' and ', {box}, 'open ', {n})",
        "''",
        f"concat('The final answer is: ', {n}, ' units', chr(10), 'end')",
        f"concat({box}, {c}, ' then ', {box}, ' y', {n}, ' ', {c}, ' ', {c})",
        f"concat('final ANSWER : ', {n}, chr(10), 'Final answer is: x', {n})",
        f"concat('so 3.5 or -', {n}, '.25 remains', chr(10), '   ')",
        f"concat({box}, 'only ', {o}, {n})",
        f"concat('<think> short ', {box}, 'inner', {c}, ' </think> out ', {box}, {n}, {c})",
        f"concat({box}, {c}, 'empty ', {box}, '  ', {c})",
    ]
    chosen = " ".join(f"when {i} then {case}" for i, case in enumerate(cases))
    return f"""select doc_id as row_id, lang as type, source,
      concat(text, chr(10), case doc_id % {len(cases)} {chosen} end) as text from {documents}"""


def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(answer_texts_sql("{documents}", "cast(doc_id as string)"), documents=D.documents(spark, sf))


ANSWER_TEXTS = "texts as materialized (" + answer_texts_sql("documents", "cast(doc_id as varchar)") + ")"
DEEP = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
PHRASES = [r"The final answer is:\s*([^\n]+)", r"Final answer is:\s*([^\n]+)", r"Final answer\s*[:：]\s*([^\n]+)", r"final answer\s*[:：]\s*([^\n]+)"]


@register("boxed_last", f"with {ANSWER_TEXTS} select row_id, {P.last_box('text')} as answer from texts")
def boxed_last(spark, sf):
    return answer_texts(spark, sf).select("row_id", T.boxed_last(F.col("text")).alias("answer"))


@register("boxed_balanced", f"""with {ANSWER_TEXTS} select row_id,
  {P.strip(f"list_extract(regexp_extract_all(text, {P.q(DEEP)}, 1), -1)")} as answer from texts""")
def boxed_balanced(spark, sf):
    return answer_texts(spark, sf).select("row_id", T.boxed_balanced(F.col("text")).alias("answer"))


_BOXES = r"regexp_extract_all(text, '\\boxed\{([^}]*)(?:\}|$)', 1)"
_FILLED = f"list_extract(list_filter(list_transform({_BOXES}, lambda b: {P.strip('b')}), lambda b: b <> ''), -1)"
_STATED = ", ".join(f"{P.strip(f'list_extract(regexp_extract_all(text, {P.q(p)}, 1, {chr(39)}i{chr(39)}), -1)')}" for p in PHRASES)


@register("final_answer", f"""with {ANSWER_TEXTS} select row_id, case when len({_BOXES}) > 0 then coalesce({_FILLED}, '')
  else coalesce({_STATED}, list_extract(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?', 0), -1),
  list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda l: {P.strip('l')}), lambda l: l <> ''), -1), 'NOT_FOUND') end as answer from texts""")
def final_answer(spark, sf):
    return answer_texts(spark, sf).select("row_id", T.final_answer(F.col("text")).alias("answer"))


@register("answer_placement", f"""with {ANSWER_TEXTS} select case when contains(text, '</think>') and contains(list_extract(string_split(text, '</think>'), -1), {P.BOX})
  then 'after_think' when contains(text, {P.BOX}) then 'inside_only' else 'absent' end as placement, count(*) as n from texts group by 1""")
def answer_placement(spark, sf):
    return answer_texts(spark, sf).groupBy(T.answer_placement(F.col("text")).alias("placement")).agg(F.count("*").alias("n"))


@register("wrap_think", f"""with {ANSWER_TEXTS}, cut as (select *, list_extract(string_split(text, {P.BOX}), -1) as tail from texts)
  select row_id, md5(case when not contains(text, '<think>') and contains(text, {P.BOX}) and length(text) - length(tail) - 7 > 0
    then '<think>' || chr(10) || {P.strip("substr(text, 1, length(text) - length(tail) - 7)")} || chr(10) || '</think>' || chr(10) || chr(10) || {P.BOX} || tail
    else text end) as digest from cut""")
def wrap_think(spark, sf):
    return answer_texts(spark, sf).select("row_id", F.md5(T.wrap_think(F.col("text"))).alias("digest"))


_TAGGED = """select doc_id as row_id, concat('<|start|>ask<|tool_call|>call', text, '<|tool_response|>reply', text, '<|assistant|>note<|end|>',
  case when doc_id % 3 = 0 then '' else concat('<|assistant|><|message|> ', text, ' <|end|> ') end) as text from {documents}"""


@register("strip_tags", "with tagged as (" + _TAGGED.format(documents="documents") + f""") select row_id, md5({P.strip(
    "regexp_replace(list_extract(string_split('<|start|>ask' || substr(text, position('<|assistant|>' in text)), '<|assistant|>'), -1), '<\\|[^|]*\\|>', '', 'g')")}) as digest from tagged""")
def strip_tags(spark, sf):
    tagged = spark.sql(_TAGGED, documents=D.documents(spark, sf))
    return tagged.select("row_id", F.md5(T.strip_tags(F.col("text"))).alias("digest"))


@register("think_block", f"""with {P.EVAL}, marks as (select row_id, run, text, position('<think>' in text) as o, position('</think>' in text) as c from ev)
  select row_id, run, md5(case when o > 0 and c >= o + 7 then substr(text, o + 7, c - o - 7)
    when o > 0 and position(chr(92) || 'boxed' in substr(text, o + 7)) > 0 then substr(substr(text, o + 7), 1, position(chr(92) || 'boxed' in substr(text, o + 7)) - 1)
    when o > 0 then '' when c > 0 then substr(text, 1, c - 1) else '' end) as digest from marks""")
def think_block(spark, sf):
    return long_eval(spark, sf).select("row_id", "run", F.md5(T.think_block(F.col("text"))).alias("digest"))


def long_eval(spark, sf):
    from assayer.operators.evaluation import unpivot_runs
    return unpivot_runs(D.traces(spark, sf))


@register("unpivot_runs", f"with {P.EVAL} select row_id, type, run, md5(text) as digest, box, ok from ev")
def unpivot_runs_query(spark, sf):
    return long_eval(spark, sf).select("row_id", "type", "run", F.md5("text").alias("digest"), "box", "ok")


def _route_sql(rules: str) -> str:
    scope, default, ordered = T.ROUTES[rules]
    area = {"first_line": "split_part(prompt, chr(10), 1)", None: "prompt"}.get(scope, f"substr(prompt, 1, {scope})")
    whens = []
    for label, alternatives in ordered:
        tests = []
        for a in alternatives:
            needed = a if isinstance(a, tuple) else (a,)
            tests.append("(" + " and ".join(P.has(f"lower({area})", p) for p in needed) + ")")
        whens.append(f"when {' or '.join(tests)} then '{label}'")
    return "case " + " ".join(whens) + f" else '{default}' end"


@register("route_type", f"with {P.TRACES} select type, {_route_sql('tracking')} as routed, count(*) as n from traces group by 1, 2")
def route_type(spark, sf):
    return D.puzzles(spark, sf).groupBy("type", T.route_type(F.col("prompt")).alias("routed")).agg(F.count("*").alias("n"))


_VARIANTS = ["solver", "distill", "builder", "sampling"]


@register("route_type_variants", f"with {P.TRACES} select type, " + ", ".join(f"{_route_sql(r)} as {r}" for r in _VARIANTS)
          + ", count(*) as n from traces group by 1, 2, 3, 4, 5")
def route_type_variants(spark, sf):
    routes = [T.route_type(F.col("prompt"), r).alias(r) for r in _VARIANTS]
    return D.puzzles(spark, sf).groupBy("type", *routes).agg(F.count("*").alias("n"))


@register("ensure_suffix", f"""with {P.TRACES}, mixed as (select row_id, case when row_id % 2 = 0 then prompt || chr(10) || 'Please put your final answer in a box.' else prompt end as prompt from traces)
  select row_id, md5(case when suffix(prompt, 'Please put your final answer in a box.') then prompt else prompt || chr(10) || 'Please put your final answer in a box.' end) as digest from mixed""")
def ensure_suffix(spark, sf):
    mixed = D.puzzles(spark, sf).withColumn("prompt", F.when(F.col("row_id") % 2 == 0, F.concat("prompt", F.lit(SUFFIX))).otherwise(F.col("prompt")))
    return mixed.select("row_id", F.md5(T.ensure_suffix(F.col("prompt"), SUFFIX)).alias("digest"))


@register("make_chat", f"""with {P.TRACES} select row_id, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || expected || '<|im_end|>' || chr(10) as chat,
  source, type as puzzle_type from traces""")
def make_chat(spark, sf):
    rows = D.puzzles(spark, sf)
    chat = rows.select("row_id", *T.make_chat(F.col("prompt"), F.col("expected"), source=F.col("source"), puzzle_type=F.col("type")))
    return chat.select("row_id", T.render_chat(F.col("messages")).alias("chat"), "_meta.source", "_meta.puzzle_type")


@register("render_chat", """select conv_id, count(*) as turns, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn, role, text)) as digest
  from conversations group by conv_id""")
def render_chat(spark, sf):
    # The text of a conversation is one output value, so gathering its turns is bounded by the size of that row.
    turns = D.read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    messages = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.select("conv_id", "turns", F.md5(T.render_chat(messages)).alias("digest"))


# Answer pairs: numeric texts near and far from their truth, and texts.
_ANSWERS = """select row_id, type, expected, case row_id % 11 when 0 then concat(' ', expected, ' ') when 1 then upper(expected) when 2 then concat(expected, '0')
  when 3 then concat('0', expected) when 4 then '' when 5 then concat(expected, '.004') when 6 then '1d' when 7 then '1_000' when 8 then concat(expected, 'e0')
  when 9 then concat('+', expected) else expected end as got from {puzzles}"""
_ANSWER_SQL = f"answers as materialized ({_ANSWERS.format(puzzles='traces')})"


def answers(spark, sf):
    return spark.sql(_ANSWERS, puzzles=D.puzzles(spark, sf))


E_, G_ = P.num("expected"), P.num("got")
_RULES = {
    "match_metric": (match.match_metric, P.metric("expected", "got")),
    "match_strict_binary": (match.match_strict_binary, P.strict("expected", "got")),
    "match_abs": (match.match_abs, f"coalesce({P.same('expected', 'got')} or coalesce(abs({G_} - {E_}) < 0.02::double, false), false)"),
    "match_round2": (match.match_round2, f"coalesce(case when {E_} is not null and {G_} is not null then round({E_}, 2) = round({G_}, 2) "
                     f"when {E_} is null and {G_} is null then {P.same('expected', 'got')} else false end, false)"),
    "match_abs_rel": (match.match_abs_rel, f"{P.strip('expected')} <> '' and {P.strip('got')} <> '' and ({P.same('expected', 'got')} or "
                      f"coalesce(abs({G_} - {E_}) < 0.01::double or abs(({G_} - {E_}) / nullif({E_}, 0)) < 0.001::double, false))"),
    "match_unit_tol": (match.match_unit_tol, f"coalesce(abs({G_} - {E_}) < 0.01::double or abs({G_} - {E_}) / greatest(0.01::double, abs({E_})) < 0.01::double, false)"),
}


def _register_rule(name, rule, sql):
    @register(name, f"with {P.TRACES}, {_ANSWER_SQL} select row_id, {sql} as matched from answers")
    def run(spark, sf, rule=rule):
        return answers(spark, sf).select("row_id", rule(F.col("expected"), F.col("got")).alias("matched"))


for _name, (_rule, _sql) in _RULES.items():
    _register_rule(_name, _rule, _sql)


@register("match_by_type", f"""with {P.TRACES}, {_ANSWER_SQL} select type, case when type in ('cipher', 'equation') then 'accepted_by_rule'
  when type in ('gravity', 'unit') then case when coalesce(abs({G_} - {E_}) < 0.05::double, {P.strip('got')} = {P.strip('expected')}) then 'matched' else 'mismatch' end
  when {P.same('expected', 'got')} then 'matched' else 'mismatch' end as verdict, count(*) as n from answers group by 1, 2""")
def match_by_type(spark, sf):
    verdict = match.match_by_type(F.col("type"), F.col("expected"), F.col("got"))
    return answers(spark, sf).groupBy("type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@register("normalize_answer", f"""with {P.TRACES}, {_ANSWER_SQL} select row_id, round({G_}, 2) as as_number,
  case when {G_} is null then lower({P.strip('got')}) end as as_text from answers""")
def normalize_answer(spark, sf):
    rows = answers(spark, sf)
    return rows.select("row_id", match.rounded(F.col("got")).alias("as_number"),
                       F.when(match.number(F.col("got")).isNull(), match.normalize_answer(F.col("got"))).alias("as_text"))


@register("per_word_accuracy", f"with {P.EVAL} select row_id, run, round({P.word_accuracy('expected', 'box')}, 9) as accuracy from ev")
def per_word_accuracy(spark, sf):
    rows = long_eval(spark, sf)
    return rows.select("row_id", "run", F.round(match.per_word_accuracy(F.col("expected"), F.col("box")), 9).alias("accuracy"))


@register("hamming_bits", f"""with {P.EVAL} select row_id, run, (select cast(count(*) as int) from (select unnest(range(1, least(length(box), length(expected)) + 1)) as i) s
  where substr(box, i, 1) <> substr(expected, i, 1)) as differing from ev where type = 'binary' and length(box) = 8""")
def hamming_bits(spark, sf):
    rows = long_eval(spark, sf).where((F.col("type") == "binary") & (F.char_length("box") == 8))
    return rows.select("row_id", "run", match.hamming(F.col("box"), F.col("expected")).alias("differing"))
