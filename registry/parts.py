"""Shared SQL text for the oracle side of the registered queries (engine-neutral SQL, evaluated by DuckDB)."""

from __future__ import annotations

from assayer.functions import markers as M
from assayer.functions.match import NUMBER
from assayer.operators import bits
from assayer.operators.pairs import PAIR_PATTERNS, TARGET_PATTERNS
from assayer.plans.derive import ANSI, traces_sql

BLANKS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
BOX = "(chr(92) || 'boxed' || chr(123))"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def num(x: str) -> str:
    return f"(case when regexp_matches({strip(x)}, {q(NUMBER)}) then try_cast({strip(x)} as double) end)"


def same(a: str, b: str) -> str:
    return f"(lower({strip(a)}) = lower({strip(b)}))"


def isclose(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= greatest(0.01::double * greatest(abs({a}), abs({b})), 0.00001::double))"


def metric(e: str, g: str) -> str:
    return f"coalesce(case when {num(e)} is not null and {num(g)} is not null then {isclose(num(e), num(g))} else {same(e, g)} end, false)"


def strict(e: str, g: str) -> str:
    return (f"(case when {e} is null or {g} is null or {strip(g)} = '' then false when regexp_matches({strip(e)}, '^[01]+$') "
            f"then lower({strip(e)}) = lower({strip(g)}) else {metric(e, g)} end)")


def has(text: str, part: str) -> str:
    return f"contains({text}, {q(part)})"


def any_of(text: str, parts: list[str]) -> str:
    return "(" + " or ".join(has(text, p) for p in parts) + ")"


def present(text: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"{has(text, p)}::int" for p in parts) + ")"


def count_part(text: str, part: str) -> str:
    return f"(len(string_split({text}, {q(part)})) - 1)"


def count_parts(text: str, parts: list[str]) -> str:
    return "(" + " + ".join(count_part(text, p) for p in parts) + ")"


def matches(text: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}, 0{', ' + q(flags) if flags else ''}))"


def found(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {q(pattern)}{', ' + q(flags) if flags else ''})"


def last_box(text: str) -> str:
    return f"coalesce({strip(f'list_extract(regexp_extract_all({text}, {q(BOXED)}, 1), -1)')}, '')"


BOXED = r"\\boxed\{([^}]*)\}"


def by_type(values: dict[str, str], default: str = "null") -> str:
    return "case type " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end"


TRACES = f"traces as materialized ({traces_sql(ANSI)})"
EVAL = TRACES + f""", ev0 as (
  select row_id, v, type, source, lang, prompt, expected, target, 'a' as run, a_text as text, a_box as box from traces
  union all select row_id, v, type, source, lang, prompt, expected, target, 'b', b_text, b_box from traces),
ev as materialized (select *, {strict('expected', 'box')} as ok from ev0)"""
PAIRED = EVAL + """, paired as (select row_id, any_value(type) as type, any_value(source) as source,
  bool_or(ok) filter (where run = 'a') as a_ok, bool_or(ok) filter (where run = 'b') as b_ok from ev group by row_id)"""


def outcome(a: str = "a_ok", b: str = "b_ok") -> str:
    return f"case when {a} and {b} then 'both_right' when {a} then 'regression' when {b} then 'improvement' else 'both_wrong' end"


def re2(pattern: str) -> str:
    return pattern


def pairs(kind: str, name: str | None = None, source: str = "traces") -> str:
    """CTE of the long pair table of one type."""
    pattern = PAIR_PATTERNS[kind]
    skip = "true"
    if kind == "cipher":
        left = f"lower(regexp_extract(line, {q(pattern)}, 1))"
        skip = f"not contains({left}, 'input') and not contains({left}, 'example')"
    if kind == "equation":
        skip = "not contains(lower(line), 'example') and not contains(lower(line), 'determine')"
    return f"""{name or 'pairs'} as materialized (
  select row_id, row_number() over (partition by row_id order by line_no) - 1 as pos,
         regexp_extract(line, {q(pattern)}, 1) as lhs, {strip(f'regexp_extract(line, {q(pattern)}, 2)')} as rhs
  from (select row_id, generate_subscripts(ls, 1) as line_no, {strip('unnest(ls)')} as line
        from (select row_id, string_split(prompt, chr(10)) as ls from {source} where type = '{kind}') l0) l1
  where regexp_matches(line, {q(pattern)}) and {skip})"""


def targets(kind: str, name: str | None = None, source: str = "traces") -> str:
    pattern = TARGET_PATTERNS[kind]
    extra = " and not contains(line, '->') and contains(lower(line), 'decrypt')" if kind == "cipher" else ""
    return f"""{name or 'targets'} as materialized (
  select p.row_id, any_value(p.expected) as expected, {strip(f'arg_max(regexp_extract(line, {q(pattern)}, 1), line_no)')} as target
  from {source} p join (select row_id, generate_subscripts(ls, 1) as line_no, {strip('unnest(ls)')} as line
        from (select row_id, string_split(prompt, chr(10)) as ls from {source} where type = '{kind}') l0) l1 using (row_id)
  where regexp_matches(line, {q(pattern)}){extra} group by p.row_id)"""


def rules(table: list[tuple[str, str, int, int, int]], name: str = "rules") -> str:
    rows = ", ".join(f"({i}, '{k}', '{o}', {a}, {b}, {c})" for i, (k, o, a, b, c) in enumerate(table))
    return f"{name} as (select * from (values {rows}) r(rule, kind, op, a, b, c))"


def gate(x: str, y: str, z: str) -> str:
    """One rule on single bits."""
    return (f"(case op when 'C0' then 0 when 'C1' then 1 when 'ID' then {x} when 'INV' then 1 - {x} when 'AND' then {x} * {y} "
            f"when 'OR' then greatest({x}, {y}) when 'XOR' then abs({x} - {y}) when 'NAND' then 1 - {x} * {y} "
            f"when 'NOR' then 1 - greatest({x}, {y}) when 'XNOR' then 1 - abs({x} - {y}) when 'AND_N' then {x} * (1 - {y}) "
            f"when 'OR_N' then greatest({x}, 1 - {y}) when 'XOR_N' then abs({x} - (1 - {y})) "
            f"when 'MAJ' then case when {x} + {y} + {z} >= 2 then 1 else 0 end end)")


def bit(text: str, position: str) -> str:
    return f"cast(substr({text}, {position} + 1, 1) as int)"


def valid(table: list[tuple[str, str, int, int, int]] | None = None, name: str = "valid", source: str = "pairs") -> str:
    """All valid rules per (row, bit), by trying every rule on every pair."""
    return rules(table or bits.gate_rules(), f"{name}_rules") + f""", {name} as materialized (
  select row_id, bit, rule, any_value(kind) as kind, any_value(op) as op, any_value(a) as a, any_value(b) as b, any_value(c) as c
  from {source}, {name}_rules, (select unnest(range(8)) as bit) k
  group by row_id, bit, rule having bool_and({gate(bit('lhs', 'a'), bit('lhs', 'b'), bit('lhs', 'c'))} = {bit('rhs', 'bit')}))"""


def first_rules(name: str = "chosen", source: str = "valid") -> str:
    return f"{name} as (select * from {source} qualify row_number() over (partition by row_id, bit order by rule) = 1)"


def applied(name: str = "applied", chosen: str = "chosen", targets_name: str = "targets") -> str:
    return f"""{name} as (select row_id, expected, target, case when n = 8 then answer end as predicted from {targets_name} left join (
  select row_id, count(*) as n, string_agg(cast({gate(bit('target', 'a'), bit('target', 'b'), bit('target', 'c'))} as varchar), '' order by bit) as answer
  from {targets_name} join {chosen} using (row_id) group by row_id) z using (row_id))"""


BINARY = f"{pairs('binary')}, {targets('binary')}, {valid()}, {first_rules()}, {applied()}"
BINARY_FACTS = BINARY + """, kinds as (select row_id, count(*) as n_rules from chosen group by row_id),
binary_facts as (select t.row_id, case when coalesce(n_rules, 0) = 8 then 'SIMPLE' else 'HARD' end as difficulty, predicted as true_answer
  from targets t left join kinds using (row_id) left join applied using (row_id))"""

LEARNED = f"""words as (
  select row_id, pos, w, ls[w] as lw, rs[w] as rw from (select row_id, pos, ls, rs, unnest(range(1, len(ls) + 1)) as w
  from (select row_id, pos, list_filter(string_split(lower(lhs), ' '), lambda x: x <> '') as ls,
               list_filter(string_split(lower(rhs), ' '), lambda x: x <> '') as rs from cpairs) s0 where len(ls) = len(rs)) s1
  where length(ls[w]) = length(rs[w])),
letters as (select row_id, pos, w, i, substr(lw, i, 1) as src, substr(rw, i, 1) as dst
  from (select *, unnest(range(1, length(lw) + 1)) as i from words) s2),
learned as materialized (select row_id, src, dst, votes from (
  select row_id, src, dst, count(*) as votes, min(pos * 1000000 + w * 1000 + i) as first from letters
  where regexp_matches(src, '^\\p{{L}}$') and regexp_matches(dst, '^\\p{{L}}$') group by row_id, src, dst) s3
  qualify row_number() over (partition by row_id, src order by votes desc, first) = 1)"""
CIPHER = f"{pairs('cipher', 'cpairs')}, {targets('cipher', 'ctargets')}, {LEARNED}"

STATED = f"""hits as (select row_id, run, generate_subscripts(hs, 1) as hit_no, unnest(hs) as hit from (
  select row_id, run, regexp_extract_all(text, {q(M.STATED_MAPPING)}, 0) as hs from ev where type = 'cipher') h0),
stated as materialized (select row_id, run, src, arg_min(dst, hit_no) as dst from (
  select row_id, run, hit_no, lower(regexp_extract(hit, {q(M.STATED_MAPPING)}, 1)) as src, lower(regexp_extract(hit, {q(M.STATED_MAPPING)}, 2)) as dst from hits) h1
  group by row_id, run, src),
grades as materialized (select row_id, run, count(*) as table_size, count(*) filter (where s.dst = t.dst) as table_correct,
  count(*) filter (where t.dst is not null and s.dst <> t.dst) as table_wrong,
  count(*) filter (where s.dst = t.dst) / count(*) as table_accuracy,
  count(*) filter (where s.dst = t.dst) / nullif(count(*) filter (where t.dst is not null), 0) as shared_accuracy
  from stated s left join learned t using (row_id, src) group by row_id, run)"""

CLAIMS = f"""claims0 as (select row_id, run, regexp_extract_all(text, {q(M.CLAIM)}, 2, 'i') as cs from ev where type = 'cipher'),
claims as materialized (select row_id, run, list_extract(list_filter(list_transform(cs, lambda c: case when {any_of('lower(c)', M.CLAIM_PASS)} then 'PASS'
  when {any_of('lower(c)', M.CLAIM_FAIL)} then 'FAIL' end), lambda z: z is not null), 1) as claim from claims0),
firsts as (select row_id, lower(lhs) as lhs, lower(rhs) as rhs from cpairs where pos = 0),
fchars as (select row_id, run, i, substr(lhs, i, 1) as c, lhs, rhs from (select f.row_id, run, lhs, rhs, unnest(range(1, length(lhs) + 1)) as i
  from firsts f join (select distinct row_id, run from stated) s using (row_id)) g0),
checked as (select f.row_id, f.run, any_value(length(lhs)) as ll, any_value(length(rhs)) as lr,
  count(*) filter (where (case when regexp_matches(c, '^\\p{{L}}$') then coalesce(s.dst, '?') else c end) = substr(rhs, i, 1)
     or not regexp_matches(case when regexp_matches(c, '^\\p{{L}}$') then coalesce(s.dst, '?') else c end, '^\\p{{L}}$')) as good
  from fchars f left join stated s on s.row_id = f.row_id and s.run = f.run and s.src = f.c group by f.row_id, f.run),
honest as materialized (select row_id, run, claim, case when claim is null or good is null then 'NONE'
  when claim = 'PASS' then case when ll = lr and good >= 0.9::double * lr then 'PASS_TRUE' else 'PASS_LIE' end
  else case when ll = lr and good >= 0.9::double * lr then 'FAIL_FALSE' else 'FAIL_TRUE' end end as honesty
  from claims left join checked using (row_id, run))"""


def word_accuracy(e: str, g: str) -> str:
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
    return (f"(case when len({words(e)}) = 0 or len({words(e)}) <> len({words(g)}) then 0.0::double else "
            f"len(list_filter(list_zip({words(e)}, {words(g)}), lambda z: z[1] = z[2])) / len({words(e)})::double end)")


CIPHER_FLAGS = f"""{CIPHER}, {STATED}, {CLAIMS}, cipher_flags as materialized (
  select ev.row_id, ev.run, coalesce(table_size, 0) as table_size, table_correct, table_wrong, table_accuracy, shared_accuracy, claim, honesty,
         regexp_matches(text, {q(M.VOCABULARY_FILL)}, 'i') as vocab_fill, {word_accuracy('expected', 'box')} as word_accuracy
  from ev left join grades using (row_id, run) left join honest using (row_id, run) where type = 'cipher')"""


def _modes() -> str:
    e, b = strip("expected"), strip("box")
    unit_ok = (f"coalesce(abs({num('box')} - {num('expected')}) < 0.01::double or "
               f"abs({num('box')} - {num('expected')}) / greatest(0.01::double, abs({num('expected')})) < 0.01::double, false)")
    drift = {k: f"{present('lower(text)', ms)} >= 2" for k, ms in M.DRIFT.items()}
    numeric = lambda kind, wrong: (f"case when {unit_ok} then 'correct' when box = '' then 'no_boxed' when {drift[kind]} then 'cipher_template_drift' else '{wrong}' end")
    modes = {
        "gravity": numeric("gravity", "wrong_answer"), "unit": numeric("unit", "wrong_slope"),
        "roman": f"case when upper({b}) = upper({e}) then 'correct' when box = '' then 'no_boxed' when {drift['roman']} then 'cipher_template_drift' else 'wrong_answer' end",
        "binary": f"case when {b} = {e} then 'correct' when box = '' then 'no_boxed' when not regexp_matches({b}, '^[01]{{8}}$') then 'format_bad' "
                  f"when difficulty = 'HARD' then 'complex_gates' when {b} = '00000000' then 'lazy_constant_0' when {b} = '11111111' then 'lazy_constant_1' "
                  f"when {b} = target then 'lazy_copy' when {b} = translate(target, '01', '10') then 'lazy_not' else 'wrong_2gate' end",
        "equation": f"case when {b} = {e} then 'correct' when box = '' then 'no_boxed' when {b} = target then 'copied_input' "
                    f"when {present('lower(text)', M.EQUATION_TEMPLATE)} >= 3 then 'cipher_template_misfire' "
                    f"when {present('lower(text)', M.EQUATION_ARITHMETIC)} < 2 then 'no_arithmetic_attempted' else 'arithmetic_wrong' end",
        "cipher": f"case when lower({b}) = lower({e}) then 'correct' when box = '' then 'no_boxed' when table_size > 0 and honesty = 'PASS_LIE' then 'template_with_lying_ver' "
                  f"when table_size > 0 and table_accuracy < 0.8::double then 'template_with_wrong_table' when vocab_fill and word_accuracy < 1.0 then 'hallucinated_vocab' "
                  f"when table_size = 0 then 'free_form_wrong_mapping' else 'other_wrong' end",
    }
    return by_type(modes, "'unknown_type'")


VERDICTS = f"""{EVAL}, {BINARY_FACTS}, {CIPHER_FLAGS}, verdicts as materialized (
  select ev.*, {_modes()} as failure_mode, difficulty, true_answer, table_size, table_accuracy, shared_accuracy, claim, honesty, vocab_fill, word_accuracy
  from ev left join binary_facts using (row_id) left join cipher_flags using (row_id, run))"""
