"""Registered queries: example pairs and rule inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import match, numerals
from assayer.operators import bits, combos, facts as X, pairs as A, substitution as S
from assayer.plans import derive as D
from registry import parts as P

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def both(spark, sf, kind):
    rows = D.puzzles(spark, sf)
    return A.pairs_from_prompts(rows, kind), A.targets_from_prompts(rows, kind)


_KINDS = ["binary", "cipher", "equation", "gravity", "unit"]


@register("pairs_from_prompt", f"with {P.TRACES}, {', '.join(P.pairs(k, 'p_' + k) for k in _KINDS)} "
          + " union all ".join(f"select '{k}' as type, row_id, pos, lhs, rhs from p_{k}" for k in _KINDS))
def pairs_from_prompt(spark, sf):
    rows, found = D.puzzles(spark, sf), None
    chosen = None
    for kind in _KINDS:
        here = A.prompt_pairs(F.col("prompt"), kind)
        chosen = F.when(F.col("type") == kind, here) if chosen is None else chosen.when(F.col("type") == kind, here)
    found = rows.select("type", "row_id", F.posexplode(chosen).alias("pos", "pair"))
    return found.select("type", "row_id", F.col("pos").cast("bigint").alias("pos"), "pair.lhs", "pair.rhs")


@register("targets_from_prompt", f"with {P.TRACES}, {', '.join(P.targets(k, 't_' + k) for k in _KINDS)} "
          + " union all ".join(f"select '{k}' as type, row_id, target from t_{k}" for k in _KINDS))
def targets_from_prompt(spark, sf):
    chosen = None
    for kind in _KINDS:
        here = A.prompt_target(F.col("prompt"), kind)
        chosen = F.when(F.col("type") == kind, here) if chosen is None else chosen.when(F.col("type") == kind, here)
    return D.puzzles(spark, sf).where(F.col("type") != "roman").select("type", "row_id", chosen.alias("target"))


# --- Ratio fits, on prompts and on order lines ------------------------------------------------------------------------
_NUMERIC = """np as (select row_id, pos, cast(lhs as double) as x, cast(rhs as double) as y from pairs),
nt as (select row_id, expected, cast(target as double) as target_x from targets)"""


def _fit(kind, how, ratio, condition, apply):
    agg = {"mean": "avg", "median": "median"}[how]
    return f"""with {P.TRACES}, {P.pairs(kind)}, {P.targets(kind)}, {_NUMERIC}, fit as (select row_id, {agg}({ratio}) as c from np where {condition} group by row_id)
  select row_id, round(c, 6) as coefficient, round({apply}, 6) as computed, expected from nt join fit using (row_id)"""


def fitted(spark, sf, kind, how):
    pairs, targets = both(spark, sf, kind)
    fit, name = (A.ratio_fit, "slope") if kind == "unit" else (A.quadratic_fit, "g")
    out = fit(A.numeric_pairs(pairs), A.numeric_targets(targets), how)
    return out.select("row_id", F.round(name, 6).alias("coefficient"), F.round("computed", 6).alias("computed"), "expected")


@register("ratio_fit_mean", _fit("unit", "mean", "y / x", "x <> 0", "c * target_x"))
def ratio_fit_mean(spark, sf):
    return fitted(spark, sf, "unit", "mean")


@register("ratio_fit_median", _fit("unit", "median", "y / x", "x > 0", "c * target_x"))
def ratio_fit_median(spark, sf):
    return fitted(spark, sf, "unit", "median")


@register("quadratic_fit_mean", _fit("gravity", "mean", "2 * y / (x * x)", "x <> 0", "0.5::double * c * target_x * target_x"))
def quadratic_fit_mean(spark, sf):
    return fitted(spark, sf, "gravity", "mean")


@register("quadratic_fit_median", _fit("gravity", "median", "2 * y / (x * x)", "x > 0", "0.5::double * c * target_x * target_x"))
def quadratic_fit_median(spark, sf):
    return fitted(spark, sf, "gravity", "median")


_LINES = """select l_orderkey as row_id, l_quantity as x, l_extendedprice as y, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc,
  l_suppkey desc, l_quantity desc, l_extendedprice desc) as back from lineitem"""


def order_lines(spark, sf):
    """Pairs (quantity, price) per order, and the last line in the total order as its target."""
    lines = D.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    last = lines.groupBy("l_orderkey").agg(F.max(key).alias("last"))
    targets = last.select(F.col("l_orderkey").alias("row_id"), F.col("last.l_quantity").alias("target_x"), F.col("last.l_extendedprice").alias("stated"))
    pairs = lines.select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return pairs, targets


@register("ratio_fit_orders", f"""with l as ({_LINES}), fit as (select row_id, median(y / x) as c from l where x > 0 group by row_id)
  select l.row_id, round(c, 6) as slope, round(c * x, 6) as computed from l join fit using (row_id) where back = 1""")
def ratio_fit_orders(spark, sf):
    pairs, targets = order_lines(spark, sf)
    return A.ratio_fit(pairs, targets, "median").select("row_id", F.round("slope", 6).alias("slope"), F.round("computed", 6).alias("computed"))


def _verified_sql(kind, c, ratio):
    return f"""with {P.TRACES}, {P.pairs(kind)}, {P.targets(kind)}, {_NUMERIC}, fit as (select row_id, avg({ratio}) as c from np where x <> 0 group by row_id),
  done as (select row_id, {c} as computed, {P.num('expected')} as stated from nt left join fit using (row_id))
  select row_id, case when computed is null then 'no usable pairs' when stated is null then 'answer not numeric'
  when abs(round(computed, 2) - stated) > 0.02::double + 1e-9::double then 'outside tolerance' end as reason from done"""


@register("verified_within", _verified_sql("gravity", "0.5::double * c * target_x * target_x", "2 * y / (x * x)"))
def verified_within(spark, sf):
    pairs, targets = both(spark, sf, "gravity")
    out = A.quadratic_fit(A.numeric_pairs(pairs), A.numeric_targets(targets), "mean")
    _, reason = match.verified_within(F.col("computed"), F.col("expected"))
    return out.select("row_id", reason.alias("reason"))


# --- Numerals ---------------------------------------------------------------------------------------------------------
_ROMAN = D.roman(D.ANSI, "n")


@register("roman_encode", f"select n, {_ROMAN} as numeral, count(*) as orders from (select o_orderkey % 3999 + 1 as n from orders) o group by 1, 2")
def roman_encode(spark, sf):
    n = (F.col("o_orderkey") % 3999 + 1).alias("n")
    counted = D.read(spark, sf, "orders").groupBy(n).agg(F.count("*").alias("orders"))
    return counted.select("n", numerals.roman_encode(F.col("n")).alias("numeral"), "orders")


@register("roman_decode", f"""with n as (select p_partkey, case when p_partkey % 10 = 3 then 'XQ' when p_partkey % 10 = 4 then 'IIX' else {_ROMAN} end as numeral from (select p_partkey, p_partkey * 7 % 3999 + 1 as n from part) p),
  v as (select p_partkey, numeral, i, case substr(numeral, i, 1) when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 end as val
        from (select *, unnest(range(1, length(numeral) + 1)) as i from n) s),
  w as (select *, lead(val) over (partition by p_partkey order by i) as nxt from v)
  select p_partkey, numeral, case when count(*) = count(val) then cast(sum(case when val < nxt then -val else val end) as int) end as decoded from w group by 1, 2""")
def roman_decode(spark, sf):
    parts = D.read(spark, sf, "part").select("p_partkey")
    numeral = (F.when(F.col("p_partkey") % 10 == 3, "XQ").when(F.col("p_partkey") % 10 == 4, "IIX")
               .otherwise(numerals.roman_encode(F.col("p_partkey") * 7 % 3999 + 1)))
    encoded = parts.withColumn("numeral", numeral)
    return encoded.withColumn("decoded", numerals.roman_decode(F.col("numeral")))


# --- Substitutions ----------------------------------------------------------------------------------------------------
@register("learn_substitution", f"with {P.TRACES}, {P.CIPHER} select row_id, src, dst, cast(votes as bigint) as votes from learned")
def learn_substitution(spark, sf):
    return S.learn_substitution(A.pairs_from_prompts(D.puzzles(spark, sf), "cipher"))


# Whole documents as one long example each: the lower-cased text and its shifted form.
_SHIFTED = f"""select doc_id as row_id, 0 as pos, translate(lower(text), '{D.ALPHABET}', substr('{D.ALPHABET}{D.ALPHABET}', cast(2 + doc_id % 25 as int), 26)) as lhs,
  case when doc_id % 4 = 0 then replace(lower(text), 'th', 'sh') else lower(text) end as rhs from {{documents}}"""


@register("learn_substitution_documents", f"""with pp as ({_SHIFTED.format(documents='documents')}), w0 as (select row_id, list_filter(regexp_split_to_array(lhs, '\\s+'), lambda x: x <> '') as ls,
    list_filter(regexp_split_to_array(rhs, '\\s+'), lambda x: x <> '') as rs from pp), w1 as (select row_id, unnest(ls) as lw, unnest(rs) as rw, generate_subscripts(ls, 1) as w from w0 where len(ls) = len(rs)),
  w2 as (select row_id, lw, rw, w, unnest(range(1, length(lw) + 1)) as i from w1 where length(lw) = length(rw)), c as (select row_id, substr(lw, i, 1) as src, substr(rw, i, 1) as dst, count(*) as votes, min(w * 100000 + i) as first
  from w2 group by 1, 2, 3) select row_id, src, dst, votes from c where regexp_matches(src, '^\\p{{L}}$') and regexp_matches(dst, '^\\p{{L}}$')
  qualify row_number() over (partition by row_id, src order by votes desc, first) = 1""")
def learn_substitution_documents(spark, sf):
    return S.learn_substitution(spark.sql(_SHIFTED, documents=D.documents(spark, sf)))


@register("apply_substitution", f"""with {P.TRACES}, {P.CIPHER}, chars as (select row_id, expected, target, i, substr(target, i, 1) as c from (select *, unnest(range(1, length(target) + 1)) as i from ctargets) s),
  decoded as (select row_id, any_value(expected) as expected, string_agg(case when regexp_matches(c, '^\\p{{L}}$') then coalesce(dst, '?') else c end, '' order by i) as decoded
  from chars left join learned using (row_id) where src = lower(c) or src is null or not exists (select 1 from learned z where z.row_id = chars.row_id and z.src = lower(c)) group by row_id)
  select row_id, decoded, decoded = expected as solved from decoded""".replace(
      "from chars left join learned using (row_id) where src = lower(c) or src is null or not exists (select 1 from learned z where z.row_id = chars.row_id and z.src = lower(c)) group by row_id",
      "from chars left join learned l on l.row_id = chars.row_id and l.src = lower(c) group by row_id").replace("select row_id, any_value(expected)", "select chars.row_id, any_value(expected)").replace("group by row_id)\n  select row_id, decoded, decoded", "group by chars.row_id)\n  select row_id, decoded, decoded"))
def apply_substitution(spark, sf):
    pairs, targets = both(spark, sf, "cipher")
    out = S.apply_substitution(targets, S.learn_substitution(pairs))
    return out.select("row_id", "decoded", (F.col("decoded") == F.col("expected")).alias("solved"))


# --- Bit rules --------------------------------------------------------------------------------------------------------
@register("bit_rules", f"with {P.TRACES}, {P.pairs('binary')}, {P.valid()} select row_id, bit, rule, kind from valid")
def bit_rules(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    return bits.bit_rules(pairs).select("row_id", "bit", "rule", "kind")


@register("bit_rule_first", f"with {P.TRACES}, {P.BINARY} select row_id, bit, rule, kind from chosen")
def bit_rule_first(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    return bits.first_matching(pairs).select("row_id", "bit", "rule", "kind")


# Bytes of events against a rule chosen by user: up to 256 different pairs per user, so several mask chunks each.
_EVENT_PAIRS = """select user_id as row_id, pos, lpad(bin(x), 8, '0') as lhs, lpad(bin(case user_id % 4 when 0 then 255 - x when 1 then (x * 8) % 256 + {div} when 2 then x + 178 - 2 * (x & 178)
  else x & ((x * 2) % 256 + {div7}) end), 8, '0') as rhs from (select user_id, event_id % 256 as x, row_number() over (partition by user_id order by event_id) - 1 as pos from {events}) e"""


def event_pairs(spark, sf):
    """Different pairs of a user, numbered by value: a rule that holds for one of equal pairs holds for all, and a byte has 256 values."""
    events = D.read(spark, sf, "events").select("user_id", (F.col("event_id") % 256).alias("event_id")).distinct()
    return spark.sql(_EVENT_PAIRS.format(div="x div 32", div7="x div 128", events="{events}"), events=events)


_EVENT_SQL = _EVENT_PAIRS.format(div="(x // 32)", div7="(x // 128)", events="events")


@register("bit_rule_first_events", f"with pairs as materialized ({_EVENT_SQL}), {P.valid()}, {P.first_rules()} select row_id, bit, rule, kind from chosen")
def bit_rule_first_events(spark, sf):
    return bits.first_matching(event_pairs(spark, sf)).select("row_id", "bit", "rule", "kind")


@register("bit_apply", f"with {P.TRACES}, {P.BINARY} select row_id, target, predicted, coalesce(predicted = expected, false) as solved from applied")
def bit_apply(spark, sf):
    pairs, targets = both(spark, sf, "binary")
    out = bits.bit_apply(bits.first_matching(pairs), targets)
    return out.select("row_id", "target", "predicted", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).alias("solved"))


@register("bit_difficulty", f"with {P.TRACES}, {P.BINARY_FACTS}, listed as (select row_id, string_agg(kind, ',' order by bit) as kinds from ("
          "select t.row_id, b.bit, coalesce(c.kind, 'COMPLEX') as kind from targets t, (select unnest(range(8)) as bit) b left join chosen c on c.row_id = t.row_id and c.bit = b.bit) z group by row_id) "
          "select row_id, difficulty, kinds from binary_facts join listed using (row_id)")
def bit_difficulty(spark, sf):
    out = X.binary_facts(X.parsed(D.puzzles(spark, sf)))
    return out.select("row_id", "difficulty", F.array_join("rule_kinds", ",").alias("kinds"))


@register("ambiguity_filter", f"""with {P.TRACES}, {P.pairs('binary')}, {P.valid()}, {P.first_rules()}, u as (select row_id, count(*) filter (where n = 1) as unique_bits
  from (select row_id, bit, count(*) as n from valid group by 1, 2) z group by 1) select row_id, unique_bits from u where unique_bits >= 4 and row_id in (select row_id from chosen where kind in ('NOT', 'IDENTITY', '2GATE'))""")
def ambiguity_filter(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    return bits.ambiguity_filter(bits.bit_rules(pairs), 4, ["NOT", "IDENTITY", "2GATE"])


@register("rule_kind_histogram", f"with {P.TRACES}, {P.BINARY} select kind, count(*) as n from chosen group by kind")
def rule_kind_histogram(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    return bits.rule_kind_histogram(bits.first_matching(pairs))


@register("simplest_rule", f"with {P.TRACES}, {P.pairs('binary')}, {P.valid(bits.simple_rules())}, {P.first_rules()} select row_id, bit, rule, kind from chosen")
def simplest_rule(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    return bits.simplest_rules(pairs).select("row_id", "bit", "rule", "kind")


# The search as loops would do it: every operation, first pair of inputs and first output bit, extended while it holds.
_SEARCH = f"""search as (select row_id, o, op, a.i as a, b.i as b, s.i as start from (select distinct row_id from pairs) r, (select unnest(range(9)) as o, unnest({bits.ORDERED_GATES!r}) as op) g,
    (select unnest(range(8)) as i) a, (select unnest(range(8)) as i) b, (select unnest(range(8)) as i) s where a.i <> b.i),
extended as (select s.row_id, s.o, s.op, s.a, s.b, s.start, k.k, exists (select 1 from valid v where v.row_id = s.row_id and v.op = s.op and v.bit = s.start + k.k and v.a = (s.a + k.k) % 8 and v.b = (s.b + k.k) % 8) as ok
  from search s, (select unnest(range(8)) as k) k where s.start + k.k < 8),
lengths as (select row_id, o, op, a, b, start, coalesce(min(k) filter (where not ok), count(*)) as length from extended group by all),
best as (select * from lengths where length >= 2 qualify row_number() over (partition by row_id order by length desc, o, a, b, start) = 1)"""


@register("longest_run", f"""with {P.TRACES}, {P.pairs('binary')}, {P.valid(bits.ordered_rules())}, {_SEARCH} select row_id, op, cast(start as int) as start, cast(length as int) as length, cast(a as int) as first_a, cast(b as int) as first_b from best""")
def longest_run(spark, sf):
    pairs, _ = both(spark, sf, "binary")
    runs = bits.longest_runs(bits.bit_rules(pairs, bits.ordered_rules()))
    return runs.select("row_id", "op", "start", "length", ((F.col("da") + F.col("start")) % 8).cast("int").alias("first_a"),
                       ((F.col("db") + F.col("start")) % 8).cast("int").alias("first_b"))


@register("sequence_rule", f"""with {P.TRACES}, {P.pairs('binary')}, {P.targets('binary')}, {P.valid(bits.ordered_rules())}, {_SEARCH}, {P.first_rules('fallback')},
  chosen as (select f.row_id, f.bit, case when best.op is null then f.op else best.op end as op, case when best.op is null then f.a else (best.a + f.bit - best.start) % 8 end as a,
    case when best.op is null then f.b else (best.b + f.bit - best.start) % 8 end as b, f.c, best.op is not null as from_run from fallback f left join best on best.row_id = f.row_id and f.bit >= best.start and f.bit < best.start + best.length), {P.applied()}
  select row_id, predicted, coalesce(predicted = expected, false) as solved, cast((select count(*) from chosen c where c.row_id = applied.row_id and from_run) as bigint) as run_bits from applied""")
def sequence_rule(spark, sf):
    pairs, targets = both(spark, sf, "binary")
    chosen = bits.sequence_rules(pairs)
    out = bits.bit_apply(chosen, targets)
    covered = chosen.groupBy("row_id").agg(F.count_if("from_run").alias("run_bits"))
    return out.join(covered, "row_id", "left").select(
        "row_id", "predicted", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).alias("solved"), F.coalesce("run_bits", F.lit(0)).alias("run_bits"))


def _byte_sql() -> str:
    """Every whole-byte rule with every constant, tried on every pair."""
    rotl = lambda x, k: f"((({x}) * (1 << {k})) % 256 + (({x}) // (1 << (8 - {k}))))"
    rev = lambda x: "(" + " + ".join(f"((({x}) // {1 << j}) % 2) * {1 << (7 - j)}" for j in range(8)) + ")"
    f = lambda x: (f"(case f when 'same' then {x} when 'not' then 255 - {x} when 'reverse' then {rev(x)} when 'rotate' then {rotl(x, 'k')} "
                   f"when 'left' then ({x} * (1 << k)) % 256 when 'right' then {x} // (1 << k) end)")
    return f"""ints as materialized (select row_id, pos, list_sum([cast(substr(lhs, i, 1) as int) * (1 << (8 - i)) for i in range(1, 9)])::int as x,
    list_sum([cast(substr(rhs, i, 1) as int) * (1 << (8 - i)) for i in range(1, 9)])::int as y from pairs),
  tints as (select row_id, expected, target, list_sum([cast(substr(target, i, 1) as int) * (1 << (8 - i)) for i in range(1, 9)])::int as t from targets),
  base as (select * from (values ('same', 0), ('not', 0), ('reverse', 0)) b(f, k) union all select 'rotate', unnest(range(1, 8)) union all select 'left', unnest(range(1, 8)) union all select 'right', unnest(range(1, 8))),
  constant as (select row_id, f, k, min(xor({f('x')}, y)) as c from ints, base group by row_id, f, k having min(xor({f('x')}, y)) = max(xor({f('x')}, y))),
  moved as (select row_id, k, c, (({rotl('c', '(8 - k)')})) as before from constant where f = 'rotate'),
  candidates as (
    select row_id, 0 as ord, xor({f('t')}, c) as val from constant join tints using (row_id) where f = 'not' and c = 0
    union all select row_id, 1, xor(t, c) from constant join tints using (row_id) where f = 'same'
    union all select row_id, 2, {f('t')} from constant join tints using (row_id) where f = 'reverse' and c = 0
    union all select row_id, 10 + k, {f('t')} from constant join tints using (row_id) where f = 'rotate' and c = 0
    union all select row_id, 20 + 8 - k, {f('t')} from constant join tints using (row_id) where f = 'rotate' and c = 0
    union all select row_id, 30 + k, {f('t')} from constant join tints using (row_id) where f = 'left' and c = 0
    union all select row_id, 40 + k, {f('t')} from constant join tints using (row_id) where f = 'right' and c = 0
    union all select row_id, 50, xor({f('t')}, c) from constant join tints using (row_id) where f = 'not'
    union all select row_id, 51, xor({f('t')}, c) from constant join tints using (row_id) where f = 'reverse'
    union all select row_id, 60 + k, xor({f('t')}, c) from constant join tints using (row_id) where f = 'rotate'
    union all select row_id, 100 + before, xor({rotl('t', 'k')}, c) from (select * from moved qualify row_number() over (partition by row_id, before order by k) = 1) m join tints using (row_id)
    union all select row_id, 400, {f('t')} from constant join tints using (row_id) where f = 'rotate' and k = 4 and c = 0
    union all select row_id, 401, xor({f('t')}, c) from constant join tints using (row_id) where f = 'rotate' and k = 4),
  votes as (select row_id, val, count(*) as votes, min(ord) as first from candidates group by 1, 2),
  winner as (select * from votes qualify row_number() over (partition by row_id order by votes desc, first) = 1)"""


@register("byte_transform_scan", f"""with {P.TRACES}, {P.pairs('binary')}, {P.targets('binary')}, {_byte_sql()}
  select row_id, lpad(bin(val), 8, '0') as predicted, votes, coalesce(lpad(bin(val), 8, '0') = expected, false) as solved from tints left join winner using (row_id)""")
def byte_transform_scan(spark, sf):
    pairs, targets = both(spark, sf, "binary")
    out = bits.byte_transform_scan(pairs, targets)
    return out.select("row_id", "predicted", "votes", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).alias("solved"))


# --- Combinations -----------------------------------------------------------------------------------------------------
def _combo(expr: str) -> str:
    s1 = f"case when operand_order = 'AB_CD' then substr({expr}, 1, 2) else reverse(substr({expr}, 1, 2)) end"
    s2 = f"case when operand_order = 'AB_CD' then substr({expr}, 4, 2) else reverse(substr({expr}, 4, 2)) end"
    a, b = f"cast({s1} as bigint)", f"cast({s2} as bigint)"
    value = (f"(case operation when 'add' then {a} + {b} when 'sub' then {a} - {b} when 'mul' then {a} * {b} when 'mul_add1' then {a} * {b} + 1 "
             f"when 'mul_sub1' then {a} * {b} - 1 when 'addm1' then {a} + {b} - 1 when 'add1' then {a} + {b} + 1 end)")
    text = f"cast({value} as varchar)"
    return (f"(case when regexp_matches({expr}, '^[0-9]{{2}}.[0-9]{{2}}$') then case "
            f"when (operation = 'cat' and format = 'raw') or (operation = 'rcat' and format = 'rev') then concat({s1}, {s2}) "
            f"when (operation = 'cat' and format = 'rev') or (operation = 'rcat' and format = 'raw') then concat({s2}, {s1}) "
            f"when operation in ('cat', 'rcat') then null when format = 'raw' then {text} when format = 'rev' then reverse({text}) "
            f"when format = 'abs' then cast(abs({value}) as varchar) when format = 'rev_abs' then reverse(cast(abs({value}) as varchar)) "
            f"when {value} >= 0 then case when length({text}) < 4 then lpad({text}, 4, '0') else {text} end end end)")


_TABLE = "combos as (select * from (values " + ", ".join(f"({i}, '{o}', '{p}', '{f}')" for i, (o, p, f) in enumerate(combos.COMBINATIONS)) + ") c(combo, operand_order, operation, format))"
_COMBO = f"""{_TABLE}, holds as materialized (select row_id, combo from pairs, combos group by row_id, combo having count(*) >= 3 and bool_and(coalesce({_combo('lhs')} = rhs, false))),
  firstc as (select row_id, min(combo) as combo, count(*) as n_valid from holds group by row_id)"""


@register("combo_scan", f"""with {P.TRACES}, {P.pairs('equation')}, {P.targets('equation')}, {_COMBO}
  select row_id, operand_order, operation, format, n_valid, {_combo('target')} as predicted, coalesce({_combo('target')} = expected, false) as verified
  from targets join firstc using (row_id) join combos using (combo)""")
def combo_scan(spark, sf):
    pairs, targets = both(spark, sf, "equation")
    return combos.combination_scan(pairs, targets).select("row_id", "operand_order", "operation", "format", "n_valid", "predicted", "verified")


@register("top_combinations", f"""with {P.TRACES}, {P.pairs('equation')}, {P.targets('equation')}, {_COMBO}, done as (select operand_order || '|' || operation || '|' || format as name
  from targets join firstc using (row_id) join combos using (combo) where {_combo('target')} = expected) select name, count(*) as n from done group by name order by n desc, name limit 10""")
def top_combinations(spark, sf):
    from assayer.operators.selection import top_counts
    pairs, targets = both(spark, sf, "equation")
    found = combos.combination_scan(pairs, targets).where("verified")
    return top_counts(found.select(F.concat_ws("|", "operand_order", "operation", "format").alias("name")), "name", 10)


_SUBTYPE = """chars as (select row_id, unnest([substr(lhs, 1, 1), substr(lhs, 2, 1), substr(lhs, 4, 1), substr(lhs, 5, 1)]) as c from pairs where length(lhs) >= 5),
  subtypes as (select t.row_id, case when count(c) = 0 then 'UNKNOWN' when count(*) filter (where regexp_matches(c, '^[0-9]$')) / count(c) > 0.7::double then 'SYMBOL-DIGIT' else 'CIPHER-DIGIT' end as subtype
  from targets t left join chars using (row_id) group by t.row_id)"""


@register("equation_subtype", f"with {P.TRACES}, {P.pairs('equation')}, {P.targets('equation')}, {_SUBTYPE} select row_id, subtype from subtypes")
def equation_subtype(spark, sf):
    rows = D.puzzles(spark, sf).where(F.col("type") == "equation")
    return rows.select("row_id", combos.equation_subtype(A.prompt_pairs(F.col("prompt"), "equation")).alias("subtype"))
