"""Registered queries: verdicts, reasoning chains, rewards and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import markers as M, rewards as R
from assayer.operators import chains as C, evaluation as E, facts as X, joins as J, verdicts as V
from assayer.plans import derive as D
from registry import parts as P
from registry.inference import _SUBTYPE
from registry.text import long_eval

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def judged(spark, sf):
    return V.verdicts(long_eval(spark, sf).drop("target"), X.puzzle_facts(D.puzzles(spark, sf)))


# --- Verdicts ---------------------------------------------------------------------------------------------------------
@register("failure_modes", f"with {P.VERDICTS} select row_id, type, run, failure_mode from verdicts")
def failure_modes(spark, sf):
    return judged(spark, sf).select("row_id", "type", "run", "failure_mode")


@register("failure_histogram", f"with {P.VERDICTS} select type, run, failure_mode, count(*) as n from verdicts group by 1, 2, 3")
def failure_histogram(spark, sf):
    return E.failure_histogram(judged(spark, sf))


@register("outcome_modes", f"""with {P.VERDICTS}, two as (select row_id, any_value(type) as type, bool_or(ok) filter (where run = 'a') as a_ok, bool_or(ok) filter (where run = 'b') as b_ok,
  max(failure_mode) filter (where run = 'a') as am, max(failure_mode) filter (where run = 'b') as bm from verdicts group by row_id),
  o as (select type, {P.outcome()} as outcome, am, bm from two) select outcome, type, case outcome when 'regression' then bm when 'improvement' then am else 'any' end as mode, count(*) as n
  from o where outcome <> 'both_right' group by 1, 2, 3""")
def outcome_modes(spark, sf):
    return E.outcome_modes(E.paired(judged(spark, sf), "a", "b"))


@register("drift_counts", f"with {P.VERDICTS} select type, run, count(*) as n from verdicts where failure_mode = 'cipher_template_drift' group by 1, 2")
def drift_counts(spark, sf):
    return E.drift_counts(judged(spark, sf))


@register("cipher_rollup", f"""with {P.VERDICTS} select run, count(*) as n, count(*) filter (where table_size > 0) as tables, round(avg(table_accuracy), 9) as mean_table_accuracy,
  count(*) filter (where vocab_fill) as vocab_fill_used, {', '.join(f"count(*) filter (where honesty = '{h}') as {h.lower()}" for h in ('NONE', 'PASS_TRUE', 'PASS_LIE', 'FAIL_TRUE', 'FAIL_FALSE'))}
  from verdicts where type = 'cipher' group by run""")
def cipher_rollup(spark, sf):
    frame = E.cipher_rollup(judged(spark, sf))
    return frame.withColumn("mean_table_accuracy", F.round("mean_table_accuracy", 9))


@register("binary_rollup", f"""with {P.VERDICTS} select run, count(*) filter (where difficulty = 'SIMPLE') as simple, count(*) filter (where difficulty = 'HARD') as hard,
  count(*) filter (where {P.strip('box')} = true_answer) as matches_truth, count(*) filter (where true_answer is not null) as solvable from verdicts where type = 'binary' group by run""")
def binary_rollup(spark, sf):
    return E.binary_rollup(judged(spark, sf))


@register("equation_rollup", f"""with {P.EVAL}, {P.pairs('equation')}, {P.targets('equation')}, {_SUBTYPE} select run, subtype, count(*) as n,
  count(*) filter (where {P.present('lower(text)', M.EQUATION_TEMPLATE)} >= 3) as template_misuse, count(*) filter (where {P.present('lower(text)', M.EQUATION_ARITHMETIC)} >= 2) as arithmetic_attempts
  from ev join subtypes using (row_id) group by 1, 2""")
def equation_rollup(spark, sf):
    return E.equation_rollup(judged(spark, sf))


@register("claim_rates", f"""with {P.VERDICTS} select run, round(count(*) filter (where claim = 'PASS') / count(*), 9) as pass_rate,
  round(count(*) filter (where honesty = 'PASS_TRUE') / count(*) filter (where claim = 'PASS'), 9) as justified,
  round(count(*) filter (where honesty = 'PASS_LIE') / count(*) filter (where claim = 'PASS'), 9) as false_claims from verdicts where type = 'cipher' group by run""")
def claim_rates(spark, sf):
    return E.claim_rates(judged(spark, sf)).withColumns({c: F.round(c, 9) for c in ("pass_rate", "justified", "false_claims")})


@register("claim_honesty", f"with {P.EVAL}, {P.CIPHER_FLAGS} select row_id, run, claim, honesty from cipher_flags")
def claim_honesty(spark, sf):
    return judged(spark, sf).where(F.col("type") == "cipher").select("row_id", "run", "claim", "honesty")


@register("stated_table_accuracy", f"""with {P.EVAL}, {P.CIPHER_FLAGS} select row_id, run, cast(table_size as bigint) as table_size, coalesce(table_correct, 0) as table_correct, coalesce(table_wrong, 0) as table_wrong,
  round(table_accuracy, 9) as table_accuracy, round(shared_accuracy, 9) as shared_accuracy from cipher_flags""")
def stated_table_accuracy(spark, sf):
    rows = judged(spark, sf).where(F.col("type") == "cipher")
    return rows.select("row_id", "run", *[F.col(c).cast("bigint").alias(c) for c in ("table_size", "table_correct", "table_wrong")],
                       F.round("table_accuracy", 9).alias("table_accuracy"), F.round("shared_accuracy", 9).alias("shared_accuracy"))


@register("solver_verified_set", f"""with {P.TRACES}, {P.BINARY}, {P.pairs('unit', 'up')}, {P.targets('unit', 'ut')}, {P.pairs('gravity', 'gp')}, {P.targets('gravity', 'gt')},
  uf as (select row_id, median(cast(rhs as double) / cast(lhs as double)) as c from up where cast(lhs as double) > 0 group by row_id),
  gf as (select row_id, median(2 * cast(rhs as double) / (cast(lhs as double) * cast(lhs as double))) as c from gp where cast(lhs as double) > 0 group by row_id),
  solved as (select 'binary' as type, row_id, coalesce(predicted = expected, false) as verified from applied where predicted is not null
    union all select 'unit', row_id, abs(round(c * cast(target as double), 2) - cast(expected as double)) < 0.05::double from ut join uf using (row_id)
    union all select 'gravity', row_id, abs(round(0.5::double * c * cast(target as double) * cast(target as double), 2) - cast(expected as double)) < 0.05::double from gt join gf using (row_id))
  select type, count(*) as solved, count(*) filter (where verified) as verified from solved group by type""")
def solver_verified_set(spark, sf):
    from assayer.plans.dataset import solved_rows
    rows = solved_rows(D.puzzles(spark, sf), ("binary", "unit", "gravity"))
    return rows.groupBy("type").agg(F.count("*").alias("solved"), F.count_if(F.col("verdict") != "mismatch").alias("verified"))


# --- Chains -----------------------------------------------------------------------------------------------------------
_VOCAB = "vocabulary as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark)"


def vocabulary(spark, sf):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return D.read(spark, sf, "benchmark").select(words.alias("word")).distinct()


def graded(spark, sf):
    rows = C.with_marks(E.unpivot_runs(X.with_asked(D.traces(spark, sf)))).drop("pairs", "target", "direction")
    return C.grade_chains(V.verdicts(rows, X.puzzle_facts(D.puzzles(spark, sf))), C.vocabulary_share(long_eval(spark, sf), vocabulary(spark, sf)))


def _chain_sql() -> str:
    W = M.STEP_WORDS
    low, box = "low", P.strip("box")
    boxed = f"{P.found('text', P.BOXED)} and {box} <> ''"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    isnum = f"{P.num('box')} is not null"
    dec = f"(box <> '' and {P.found('text', P.BOXED)} and ({P.found(box, M.TWO_DECIMALS)} or {isnum}))"
    gates = " + ".join(f"{P.matches('text', chr(92) + 'b' + g + chr(92) + 'b')} + {P.matches('text', chr(92) + 'b' + g.lower() + chr(92) + 'b')}" for g in W["binary"]["gates"])
    roman = lambda c: f"regexp_matches(upper({c}), '^[MDCLXVI]+$')"
    arabic = lambda c: f"regexp_matches({c}, '^-*[0-9]+$')"
    exp = P.strip("expected")
    steps = {
        "binary": [("identify_type", P.any_of(low, W["binary"]["type"])), ("parse_examples", "lhs_found >= 3"),
                   ("per_bit_tried", " + ".join(P.matches("text", p, "i") for p in M.PER_BIT) + " >= 4"),
                   ("rule_derived", gates + " + " + " + ".join(P.matches("text", p, "i") for p in M.INPUT_MENTIONS) + " >= 4"),
                   ("consistency_ok", "(" + " or ".join(P.found("text", p, "i") for p in M.CONSISTENCY) + f" or coalesce({box} = true_answer, false))"),
                   ("rule_applied", f"contains(text, target) and {P.any_of(low, W['binary']['apply'])}"), ("valid_binary", f"regexp_matches({box}, '^[01]{{8}}$')"), ("boxed_format", boxed)],
        "cipher": [("identify_type", P.any_of("substr(low, 1, 500)", W["cipher"]["type"])), ("parse_examples", "words_found >= 3"), ("char_align", f"{P.matches('text', M.CHAR_ALIGN)} >= 5"),
                   ("derive_table", "table_size >= 10"), ("table_accuracy", "coalesce(shared_accuracy >= 0.9::double, false)"),
                   ("apply_table", f"{box} <> '' and len({words(box)}) = len({words('ctarget')})"), ("valid_english", "coalesce(known_words / nullif(all_words, 0) >= 0.8::double, false)"), ("boxed_format", boxed)],
        "equation": [("identify_type", P.any_of(low, W["equation"]["type"])), ("parse_operands", "lhs_found >= 1"), ("detect_subtype", P.any_of(low, W["equation"]["subtype"])),
                     ("arithmetic_attempted", P.any_of(low, W["equation"]["arithmetic"])), ("NOT_cipher_template", f"{P.present(low, W['equation']['template'])} < 3"),
                     ("rule_committed", P.any_of(low, W["equation"]["commit"])), ("target_processed", "contains(text, target)"), ("boxed_format", boxed)],
        "gravity": [("identify_type", P.any_of(low, W["gravity"]["type"])), ("parse_observations", "both_found >= 2"), ("g_computed", "(" + " or ".join(P.found("text", p, "i") for p in M.GRAVITY_FORMS) + ")"),
                    ("g_consistency_check", P.any_of(low, W["gravity"]["consistency"])), ("applied_to_target", "contains(text, printf('%g', cast(target as double)))"), ("boxed_format_2dec", dec)],
        "roman": [("identify_type", f"({P.any_of(low, W['roman']['type'])} or {P.matches('text', M.ROMAN_TOKEN)} >= 3 or {P.any_of('text', W['roman']['segments'])})"),
                  ("direction_detected", f"({P.any_of(low, W['roman']['to_roman'] + W['roman']['to_arabic'])} or (contains(low, 'decompose') and {P.any_of(low, ['tens', 'segment', 'ones'])}) or (contains(low, 'parse') and contains(low, 'total')))"),
                  ("conversion_logic", f"({P.any_of(low, W['roman']['conversion'])} or " + " or ".join(P.found("text", p) for p in M.ROMAN_VALUE_FORMS) + ")"),
                  ("applied_to_target", "contains(text, case when v % 2 = 0 then target else roman_target end)"),
                  ("boxed_format", f"box <> '' and {P.found('text', P.BOXED)} and case when {roman(exp)} then {roman(box)} when {arabic(exp)} then {arabic(box)} else {roman(box)} or {arabic(box)} end")],
        "unit": [("identify_type", P.any_of(low, W["unit"]["type"])), ("parse_examples", "both_found >= 2"), ("slope_computed", f"({P.any_of(low, W['unit']['slope'])} or {P.found('text', M.DIVISION)})"),
                 ("applied_to_target", "contains(text, printf('%g', cast(target as double)))"), ("boxed_format_2dec", dec)],
    }
    branches = " union all ".join(
        f"select row_id, type, run, {i + 1} as step_no, '{name}' as step, coalesce({test}, false) as passed from context where type = '{kind}'"
        for kind, tests in steps.items() for i, (name, test) in enumerate(tests))
    kinds = ["binary", "equation", "gravity", "unit"]
    return f"""{P.EVAL}, {P.BINARY_FACTS}, {P.CIPHER_FLAGS}, {_VOCAB}, {', '.join(P.pairs(k, 'q_' + k) for k in kinds[1:])},
  allpairs as (select * from pairs union all select * from q_equation union all select * from q_gravity union all select * from q_unit),
  lhs as (select e.row_id, e.run, count(*) filter (where contains(text, lhs)) as lhs_found, count(*) filter (where type in ('gravity', 'unit') and
     contains(text, printf('%g', try_cast(lhs as double))) and contains(text, printf('%g', try_cast(rhs as double)))) as both_found from ev e join allpairs p on p.row_id = e.row_id group by e.row_id, e.run),
  cw as (select distinct row_id, unnest(regexp_split_to_array(lower(lhs), '\\s+')) as w from cpairs),
  found_words as (select e.row_id, e.run, count(*) filter (where w <> '' and contains(lower(text), w)) as words_found from ev e join cw on cw.row_id = e.row_id group by e.row_id, e.run),
  bw as (select row_id, run, regexp_replace(unnest(regexp_split_to_array(lower(box), '\\s+')), '[^a-z]', '', 'g') as w from ev where type = 'cipher'),
  known as (select row_id, run, count(*) as all_words, count(word) as known_words from bw left join vocabulary on word = w where w <> '' group by row_id, run),
  context as materialized (select ev.*, lower(text) as low, lhs_found, both_found, words_found, known_words, all_words, table_size, shared_accuracy, true_answer, ct.target as ctarget, {D.roman(D.ANSI, '(1 + (v * 97) % 3999)')} as roman_target
    from ev left join lhs using (row_id, run) left join found_words using (row_id, run) left join known using (row_id, run) left join cipher_flags using (row_id, run)
    left join binary_facts using (row_id) left join ctargets ct on ct.row_id = ev.row_id),
  steps as materialized ({branches})"""


_STEPS = _chain_sql()


@register("chain_steps", f"with {_STEPS} select row_id, type, run, step, passed from steps")
def chain_steps(spark, sf):
    return graded(spark, sf).select("row_id", "type", "run", F.inline("steps")).select("row_id", "type", "run", F.col("name").alias("step"), "passed")


@register("chain_scores", f"""with {_STEPS} select row_id, type, run, cast(count(*) filter (where passed) as bigint) as pass_count, cast(count(*) filter (where not passed) as bigint) as fail_count,
  round(avg(passed::int), 9) as chain_score, arg_min(step, step_no) filter (where not passed) as first_failure from steps group by 1, 2, 3""")
def chain_scores(spark, sf):
    return graded(spark, sf).select("row_id", "type", "run", F.col("pass_count").cast("bigint").alias("pass_count"), F.col("fail_count").cast("bigint").alias("fail_count"),
                                    F.round("chain_score", 9).alias("chain_score"), "first_failure")


@register("step_pass_rates", f"""with {_STEPS} select type, step, count(*) filter (where passed) as passed, count(*) as total, round(avg(passed::int), 9) as rate,
  case when avg(passed::int) >= 0.9::double then 'pass' when avg(passed::int) >= 0.5::double then 'partial' else 'fail' end as band from steps group by 1, 2""")
def step_pass_rates(spark, sf):
    return E.step_pass_rates(graded(spark, sf)).withColumn("rate", F.round("rate", 9))


@register("first_failures", f"""with {_STEPS}, f as (select row_id, type, run, arg_min(step, step_no) as first_failure from steps where not passed group by 1, 2, 3)
  select type, first_failure, count(*) as n from f group by 1, 2""")
def first_failures(spark, sf):
    return E.first_failures(graded(spark, sf))


# --- Rewards ----------------------------------------------------------------------------------------------------------
def _case(values: dict[str, str], default: str) -> str:
    return "(" + P.by_type(values, default) + " end)" if not P.by_type(values, default).endswith("end") else "(" + P.by_type(values, default) + ")"


_OK = P.strict("expected", "got")
_LABELS = _case({t: P.present("text", ls) for t, ls in M.STEP_LABELS.items()}, "0")
_CONTAM = _case({t: P.present("low", [m.lower() for m in ms]) for t, ms in M.CONTAMINATION.items()}, "0")
_THRASH = P.present("low", M.THRASH)
_FULL = _case({t: f"{P.present('text', ls)} = {len(ls)}" for t, ls in M.STEP_LABELS.items()}, "true")
_REWARD_CTE = f"rew as materialized (select *, lower(text) as low, {P.last_box('text')} as got from ev)"
_PASS, _FAIL = "regexp_matches(text, 'VER.*?(PASS|YES)', 'i')", "regexp_matches(text, 'VER.*?(FAIL|NO)', 'i')"


def _pt(condition: str, points: str) -> str:
    return f"(case when {condition} then {points}::double else 0.0::double end)"


_BOXED_T, _OPEN_T, _CLOSE_T = f"contains(text, {P.BOX})", "contains(text, '<think>')", "contains(text, '</think>')"


@register("rewards", f"""with {P.EVAL}, {_REWARD_CTE} select row_id, run, {_pt(_OK, '2.0')} as correct, round({_pt(_BOXED_T, '0.5')} + {_pt(f'{_OPEN_T} and {_CLOSE_T}', '0.3')} + {_pt(f'{_BOXED_T} and {_OPEN_T}', '0.2')}, 6) as format,
  round(0.1::double * {_LABELS}, 6) as steps, {_pt(f'{_OPEN_T} or length(text) > 200', '0.25')} as thinking,
  case when not ({_PASS} or {_FAIL}) then 0.0::double when {_OK} and {_PASS} then 0.5::double when not {_OK} and {_FAIL} then 0.2::double when {_OK} and {_FAIL} then -0.1::double else -0.5::double end as honesty,
  {_pt(f'{_OK} and {_FULL} and {_THRASH} = 0 and {_CONTAM} = 0', '5.0')} as clean from rew""")
def rewards(spark, sf):
    kind, text, expected = F.col("type"), F.col("text"), F.col("expected")
    return long_eval(spark, sf).select("row_id", "run", R.reward_correct(text, expected).alias("correct"), F.round(R.reward_format(text), 6).alias("format"),
                                       F.round(R.reward_steps(kind, text), 6).alias("steps"), R.reward_thinking(text).alias("thinking"),
                                       R.reward_honesty(text, expected).alias("honesty"), R.bonus_clean(kind, text, expected).alias("clean"))


@register("penalties", f"""with {P.EVAL}, {_REWARD_CTE} select type, run, round(sum(-0.2::double * {_CONTAM}), 6) as contamination, round(sum(-0.15::double * {_THRASH}), 6) as thrash,
  cast(max({_CONTAM}) as int) as most_markers from rew group by 1, 2""")
def penalties(spark, sf):
    kind, text = F.col("type"), F.col("text")
    return long_eval(spark, sf).groupBy("type", "run").agg(F.round(F.sum(R.penalty_contamination(kind, text)), 6).alias("contamination"),
                                                           F.round(F.sum(R.penalty_thrash(text)), 6).alias("thrash"), F.max(R.contamination_hits(kind, text)).alias("most_markers"))


def _level_sql() -> str:
    has = lambda p: P.has("text", p)
    fmt = f"least(1.0::double, {_pt(has('<think>'), '0.2')} + {_pt(has('</think>'), '0.1')} + {_pt(_BOXED_T, '0.5')} + {_pt(f'len(string_split(text, {P.BOX})) = 2', '0.2')})"
    binary = f"{_pt(P.any_of('text', ['bit[', 'bit ']), '0.5')} + {_pt(P.any_of('text', ['AND', 'OR', 'XOR', 'NOT', 'IDENTITY']), '0.5')} + {_pt(P.has('low', 'verify'), '0.5')} + {_pt(P.found('text', '[01]{8}'), '0.5')}"
    cipher = f"{_pt(has('->') + ' or ' + P.has('low', 'mapping'), '0.5')} + {_pt(P.found('text', '[a-z] -> [a-z]'), '0.5')} + {_pt(P.has('low', 'decrypt'), '0.5')}"
    gravity = f"{_pt(has('g =') + ' or ' + P.has('low', 'gravitational'), '0.5')} + {_pt(P.found('text', '[0-9]+[.][0-9]{2}'), '0.5')} + {_pt(has('0.5') + ' and ' + has('t^2'), '1.0')}"
    equation = f"{_pt(P.any_of('text', ['add', 'multiply', 'subtract', '+', '*', '-']), '0.5')} + {_pt(P.any_of('low', ['symbol', 'digit']), '0.5')} + {_pt(P.has('low', 'verify'), '0.5')}"
    process = f"least(2.0::double, {_case({'binary': binary, 'cipher': cipher, 'gravity': gravity, 'equation': equation}, '0.0::double')})"
    gap = f"abs({P.num('got')} - {P.num('expected')})"
    equal_bits = "(select count(*) from (select unnest(range(1, 9)) as i) s where substr(got, i, 1) = substr(expected, i, 1))"
    correct = (f"case when got = expected then 5.0::double when type = 'binary' and length(got) = 8 and length(expected) = 8 then 0.5::double * {equal_bits} "
               f"when type in ('gravity', 'unit') and {gap} < 0.1::double then 3.0::double when type in ('gravity', 'unit') and {gap} < 1.0::double then 1.0::double else 0.0::double end")
    penalty = (f"greatest(-2.0::double, {_pt(P.has('low', 'i identify') + ' and not ' + has('bit['), '-1.0')} + {_pt(P.present('low', ['hmm', 'let me try', 'actually', 'wait', 'no that']) + ' > 3', '-0.5')} + "
               + _pt("type = 'binary' and " + P.any_of("text", ["LEN:", "TABLE:", "VOCAB"]), "-1.5") + ")")
    return f"round({fmt}, 6) as format_level, {process} as process_level, {correct} as correct_level, {penalty} as penalty_level"


@register("reward_multilevel", f"with {P.EVAL}, {_REWARD_CTE}, levels as (select row_id, run, {_level_sql()} from rew) select *, round(format_level + process_level + correct_level + penalty_level, 6) as total from levels")
def reward_multilevel(spark, sf):
    kind, text, box, expected = F.col("type"), F.col("text"), R.boxed_last(F.col("text")), F.col("expected")
    return long_eval(spark, sf).select(
        "row_id", "run", F.round(R.level_format(text), 6).alias("format_level"), R.level_process(kind, text).alias("process_level"), R.level_correct(kind, box, expected).alias("correct_level"),
        R.level_penalty(kind, text).alias("penalty_level"), F.round(R.reward_multilevel(kind, text, box, expected), 6).alias("total"))


# --- Attribution ------------------------------------------------------------------------------------------------------
_SOURCES = f"""kinded as (select row_id, list_sort(list(distinct kind)) as kinds from chosen group by row_id),
  examples as (select source, type, row_id from traces), known as (select source, type, count(*) as examples from examples group by 1, 2),
  skinds as (select source, list_sort(list(distinct k)) as source_kinds from (select e.source, unnest(kinds) as k from examples e join kinded using (row_id) where e.type = 'binary' and row_id % 3 <> 0) z group by source)"""


def training_examples(spark, sf):
    """All puzzles as tagged training rows; a third of the binary ones carry no rule kinds."""
    rows = D.puzzles(spark, sf)
    kinds = X.binary_facts(X.parsed(rows)).select("row_id", F.filter("rule_kinds", lambda k: k != "COMPLEX").alias("rule_kinds"))
    joined = rows.select("row_id", "source", "type").join(kinds, "row_id", "left")
    return joined.withColumn("rule_kinds", F.when(F.col("row_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("rule_kinds")))


@register("training_sources", f"with {P.TRACES}, {P.BINARY}, {_SOURCES} select source, type, examples, coalesce(array_to_string(source_kinds, ','), '') as kinds from known left join skinds using (source)")
def training_sources(spark, sf):
    return J.training_sources(training_examples(spark, sf)).select("source", "type", "examples", F.array_join("source_kinds", ",").alias("kinds"))


@register("attribute_changes", f"""with {P.PAIRED}, {P.BINARY}, {_SOURCES}, changed as (select p.row_id, p.type, {P.outcome()} as outcome, coalesce(kinds, []) as kinds from paired p left join kinded using (row_id)),
  credits as (select k.source, outcome from changed c join known k on k.type = c.type left join skinds s on s.source = k.source
  where outcome in ('improvement', 'regression') and (c.type <> 'binary' or len(coalesce(source_kinds, [])) = 0 or len(kinds) = 0 or list_has_any(kinds, source_kinds)))
  select source, count(*) filter (where outcome = 'improvement') as improvements, count(*) filter (where outcome = 'regression') as regressions,
  count(*) filter (where outcome = 'improvement') - count(*) filter (where outcome = 'regression') as net from credits group by source""")
def attribute_changes(spark, sf):
    pairs = E.paired(long_eval(spark, sf), "a", "b")
    kinds = X.binary_facts(X.parsed(D.puzzles(spark, sf))).select("row_id", F.array_sort(F.array_distinct(F.filter("rule_kinds", lambda k: k != "COMPLEX"))).alias("row_kinds"))
    changed = pairs.withColumn("outcome", E.outcome(F.col("a_ok"), F.col("b_ok"))).where(F.col("outcome").isin("improvement", "regression"))
    changed = changed.join(kinds, "row_id", "left").withColumn("row_kinds", F.coalesce("row_kinds", F.array().cast("array<string>")))
    return J.attribute(changed, J.training_sources(training_examples(spark, sf)))
