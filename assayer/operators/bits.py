"""Rule inference on 8-bit pairs as bulk jobs.

Pairs are folded into integer masks: bit ``p`` of ``ins[j]`` is input bit ``j`` of pair ``p``. A rule is then tested on
all pairs of a chunk by one integer comparison, so nothing is multiplied by the number of pairs. A row with more pairs
than a mask holds gets several chunks, and a rule must hold in each.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut_lineage, stored

CHUNK = 62

# Gate orders. ``GATES`` are symmetric and tried for j1 < j2 after constants, identities and negations;
# ``ORDERED_GATES`` and ``SIMPLE_GATES`` also have one-sided negations.
GATES = ["AND", "OR", "XOR", "NAND", "NOR", "XNOR"]
ORDERED_GATES = ["AND", "OR", "XOR", "AND_N", "OR_N", "XOR_N", "NAND", "NOR", "XNOR"]
SIMPLE_PRIORITY = ["CONSTANT", "IDENTITY", "NOT", "AND", "OR", "XOR", "AND_N", "OR_N", "XOR_N"]


def gate_rules() -> list[tuple[str, str, int, int, int]]:
    """(kind, op, a, b, c) in scan order: constants, identity and negation per input, gates per pair, majorities."""
    rules = [("CONSTANT", "C0", 0, 0, 0), ("CONSTANT", "C1", 0, 0, 0)]
    for j in range(8):
        rules += [("IDENTITY", "ID", j, 0, 0), ("NOT", "INV", j, 0, 0)]
    rules += [("2GATE", g, a, b, 0) for a in range(8) for b in range(a + 1, 8) for g in GATES]
    rules += [("MAJORITY", "MAJ", a, b, c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8)]
    return rules


def ordered_rules() -> list[tuple[str, str, int, int, int]]:
    """Scan order of the sequence solver: constants, identity and negation per input, then each op over i != j."""
    rules = [("C0", "C0", 0, 0, 0), ("C1", "C1", 0, 0, 0)]
    for j in range(8):
        rules += [("I", "ID", j, 0, 0), ("N", "INV", j, 0, 0)]
    rules += [(g, g, a, b, 0) for g in ORDERED_GATES for a in range(8) for b in range(8) if a != b]
    return rules


def simple_rules() -> list[tuple[str, str, int, int, int]]:
    """Constant, identity, negation, three symmetric gates and three with a negated right input, by priority, i, j."""
    rules = [("CONSTANT", "C0", 0, 0, 0), ("CONSTANT", "C1", 0, 0, 0)]
    rules += [("IDENTITY", "ID", j, 0, 0) for j in range(8)] + [("NOT", "INV", j, 0, 0) for j in range(8)]
    for g in SIMPLE_PRIORITY[3:]:
        rules += [(g, g, a, b, 0) for a in range(8) for b in range(8) if (a < b or (g.endswith("_N") and a != b))]
    return rules


def rule_literals(rules: list[tuple[str, str, int, int, int]]) -> Column:
    """The rule table as one constant array, so applying it is a narrow generator and never a join.

    It is passed as one folded text constant. A leading entry that fits everything counts the chunks of a row.
    """
    table = [dict(rule=-1, kind="ANY", op="ANY", a=0, b=0, c=0)]
    table += [dict(rule=i, kind=k, op=o, a=a, b=b, c=c) for i, (k, o, a, b, c) in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<rule:int,kind:string,op:string,a:int,b:int,c:int>>")


def evaluate(ins: Column, full: Column) -> Column:
    """Output mask of the current rule row (columns ``op, a, b, c``) on input masks."""
    pick = lambda name: F.get(ins, F.col(name))
    a, b, c = pick("a"), pick("b"), pick("c")
    flip = lambda mask: full.bitwiseXOR(mask)
    op = F.col("op")
    table = {
        "C0": F.lit(0).cast("bigint"), "C1": full, "ID": a, "INV": flip(a), "AND": a.bitwiseAND(b), "OR": a.bitwiseOR(b),
        "XOR": a.bitwiseXOR(b), "NAND": flip(a.bitwiseAND(b)), "NOR": flip(a.bitwiseOR(b)), "XNOR": flip(a.bitwiseXOR(b)),
        "AND_N": a.bitwiseAND(flip(b)), "OR_N": a.bitwiseOR(flip(b)), "XOR_N": a.bitwiseXOR(flip(b)),
        "MAJ": a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c)),
    }
    result = None
    for name, value in table.items():
        result = F.when(op == name, value) if result is None else result.when(op == name, value)
    return result


def bit_masks(pairs: DataFrame) -> DataFrame:
    """``row_id, chunk, full, ins[8], outs[8], chunks`` from the pair table; a combinable bit-or aggregation."""
    shifted = lambda text, j: F.expr(f"shiftleft(cast(substring({text}, {j + 1}, 1) as bigint), cast(pos % {CHUNK} as int))")
    rows = pairs.select("row_id", "pos", "lhs", "rhs", F.floor(F.col("pos") / CHUNK).alias("chunk"))
    masks = rows.groupBy("row_id", "chunk").agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {CHUNK} as int))")).alias("full"),
        *[F.bit_or(shifted("lhs", j)).alias(f"i{j}") for j in range(8)],
        *[F.bit_or(shifted("rhs", j)).alias(f"o{j}") for j in range(8)])
    packed = masks.select("row_id", "chunk", "full", F.array(*[f"i{j}" for j in range(8)]).alias("ins"),
                          F.array(*[f"o{j}" for j in range(8)]).alias("outs"))
    return packed


def _tried(masks: DataFrame, rules: list[tuple[str, str, int, int, int]]) -> DataFrame:
    """``row_id, rule, hits`` per chunk: bit ``k`` of ``hits`` says that the rule explains output bit ``k`` there."""
    # The masks are a few bytes a row, so that Spark would read them all in one task or two; each row meets hundreds of rules, and
    # a number of partitions that is asked for stays. What follows is grouped by row and needs no further exchange.
    spark = masks.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tried = masks.repartition(slots, "row_id").select("row_id", "full", "ins", "outs", F.inline(rule_literals(rules)))
    value = evaluate(F.col("ins"), F.col("full"))
    # What a generator puts out is computed once; from a plain column, the filter on the hits would compute it again for each of the eight bits.
    tested = tried.select("row_id", "rule", "outs", F.explode(F.array(value)).alias("value"))
    hits = F.lit(0)
    for k in range(8):
        hits = hits + F.when((F.col("rule") < 0) | (F.get("outs", F.lit(k)) == F.col("value")), 1 << k).otherwise(0)
    return tested.select("row_id", "rule", hits.alias("hits")).where(F.col("hits") != 0)


def _described(found: DataFrame, rules: list[tuple[str, str, int, int, int]], *columns: str) -> DataFrame:
    """Number, kind, gate and inputs of the rules in ``columns`` of a result; they follow from the number alone, so that only it is grouped."""
    entry = F.get(rule_literals(rules), F.col("rule") + 1)
    return found.select(*columns, entry.alias("entry")).select(*columns, *[F.col(f"entry.{c}").alias(c) for c in ("rule", "kind", "op", "a", "b", "c")])


def matching_rules(masks: DataFrame, rules: list[tuple[str, str, int, int, int]]) -> DataFrame:
    """``row_id, rule, kind, op, a, b, c, hits``: bit ``k`` of ``hits`` says the rule explains output bit ``k``."""
    merged = _tried(masks, rules).groupBy("row_id", "rule").agg(F.bit_and("hits").alias("hits"), F.count("*").alias("seen"))
    # At most one line per rule and row is left, so the window over a row is bounded by the rule table.
    chunks = F.max(F.when(F.col("rule") < 0, F.col("seen"))).over(Window.partitionBy("row_id"))
    whole = merged.withColumn("chunks", chunks)
    kept = whole.where((F.col("rule") >= 0) & (F.col("seen") == F.col("chunks")) & (F.col("hits") != 0))
    return _described(kept, rules, "row_id", "hits").select("row_id", "rule", "kind", "op", "a", "b", "c", "hits")


def first_matching(pairs: DataFrame, rules: list[tuple[str, str, int, int, int]] | None = None) -> DataFrame:
    """``first_rules`` of ``bit_rules``, without a line for every valid rule: a row that fits in one chunk keeps eight numbers while its rules are tried."""
    rules = rules or gate_rules()
    masks = stored(bit_masks(pairs).withColumn("chunks", F.count("*").over(Window.partitionBy("row_id"))), "bit-masks")
    least = [F.min(F.when(F.col("hits").bitwiseAND(F.lit(1 << k)) != 0, F.col("rule"))).alias(f"r{k}") for k in range(8)]
    short = _tried(masks.where("chunks = 1"), rules).where("rule >= 0").groupBy("row_id").agg(*least)
    long = matching_rules(masks.where("chunks > 1"), rules).groupBy("row_id").agg(*least)
    bits = F.posexplode(F.array(*[f"r{k}" for k in range(8)])).alias("bit", "rule")
    chosen = short.unionByName(long).select("row_id", bits).where("rule is not null")
    return _described(chosen, rules, "row_id", "bit")


def bit_rules(pairs: DataFrame, rules: list[tuple[str, str, int, int, int]] | None = None) -> DataFrame:
    """All valid rules per output bit: ``row_id, bit, rule, kind, op, a, b, c``."""
    found = matching_rules(bit_masks(pairs), rules or gate_rules())
    set_bits = F.expr("filter(sequence(0, 7), k -> (shiftright(hits, k) & 1) = 1)")
    return found.select("row_id", F.explode(set_bits).alias("bit"), "rule", "kind", "op", "a", "b", "c")


def first_rules(valid: DataFrame) -> DataFrame:
    """First valid rule per (row, bit) in scan order, as a combinable arg-min."""
    return valid.groupBy("row_id", "bit").agg(F.min("rule").alias("rule"), *[F.min_by(c, "rule").alias(c) for c in ("kind", "op", "a", "b", "c")])


def bit_apply(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Output for each target by its chosen rules; null unless all eight bits have one. ``targets``: ``row_id, target``."""
    bits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.substring(F.col("target"), j, F.lit(1)).cast("bigint"))
    joined = targets.select("row_id", bits.alias("ins")).join(chosen, "row_id")
    values = joined.select("row_id", "bit", evaluate(F.col("ins"), F.lit(1).cast("bigint")).alias("value"))
    packed = values.groupBy("row_id").agg(F.count("*").alias("n"), F.sum(F.expr("shiftleft(value, 7 - bit)")).alias("byte"))
    answer = F.when(F.col("n") == 8, F.lpad(F.bin("byte"), 8, "0"))
    return targets.join(packed, "row_id", "left").withColumn("predicted", answer).drop("n", "byte")


def solve_and_describe(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """``row_id, true_answer, difficulty, rule_kinds`` from the chosen rules in one aggregation.

    SIMPLE if all eight bits have a rule or there are no pairs at all, else HARD. ``rows``: ``row_id, target, n_pairs``.
    """
    one_bits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.substring(F.col("target"), j, F.lit(1)).try_cast("bigint"))
    value = evaluate(F.col("ins"), F.lit(1).cast("bigint"))
    values = chosen.join(rows.select("row_id", one_bits.alias("ins")), "row_id").select("row_id", "bit", "kind", value.alias("value"))
    described = values.groupBy("row_id").agg(
        F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum(F.expr("shiftleft(value, 7 - bit)")).alias("byte"),
        *[F.max(F.when(F.col("bit") == k, F.col("kind"))).alias(f"k{k}") for k in range(8)])
    has = F.coalesce(F.col("n_pairs"), F.lit(0)) > 0
    kinds = F.when(has, F.array(*[F.coalesce(f"k{k}", F.lit("COMPLEX")) for k in range(8)])).otherwise(F.array().cast("array<string>"))
    return rows.join(described, "row_id", "left").select(
        "row_id", F.when((F.col("n") == 8) & (F.col("n_values") == 8), F.lpad(F.bin("byte"), 8, "0")).alias("true_answer"),
        F.when(~has | (F.col("n") == 8), "SIMPLE").otherwise("HARD").alias("difficulty"), kinds.alias("rule_kinds"))


def unique_bits(valid: DataFrame) -> DataFrame:
    """Per row: output bits with exactly one valid rule."""
    per_bit = valid.groupBy("row_id", "bit").agg(F.count("*").alias("n"))
    return per_bit.groupBy("row_id").agg(F.count_if(F.col("n") == 1).alias("unique_bits"))


def ambiguity_filter(valid: DataFrame, at_least: int, kinds: list[str] | None = None) -> DataFrame:
    """Rows with at least that many unambiguous bits and, if asked, one of the given first-rule kinds."""
    kept = unique_bits(valid).where(F.col("unique_bits") >= at_least)
    if kinds:
        wanted = first_rules(valid).where(F.col("kind").isin(*kinds)).select("row_id")
        kept = kept.join(wanted, "row_id", "left_semi")
    return kept


def rule_kind_histogram(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("kind").agg(F.count("*").alias("n"))


def simplest_rules(pairs: DataFrame) -> DataFrame:
    """Lowest priority rank per (row, bit) among the simple rules."""
    return first_matching(pairs, simple_rules())


def longest_runs(valid: DataFrame) -> DataFrame:
    """Longest run of consecutive output bits explained by one shifted two-input rule (at least two bits).

    A rule shifted along the output keeps its distances ``a - bit`` and ``b - bit`` modulo 8, which identify the run's
    rule; islands are positions minus their row number. Ties follow the scan order (op, first a, first b, first bit).
    """
    order = F.expr("element_at(map(" + ", ".join(f"'{g}', {i}" for i, g in enumerate(ORDERED_GATES)) + "), op)")
    two = valid.where(F.col("op").isin(*ORDERED_GATES)).select(
        "row_id", "op", order.alias("op_order"), "bit", "a", "b", ((F.col("a") - F.col("bit") + 8) % 8).alias("da"),
        ((F.col("b") - F.col("bit") + 8) % 8).alias("db"))
    position = Window.partitionBy("row_id", "op", "da", "db").orderBy("bit")
    islands = two.withColumn("island", F.col("bit") - F.row_number().over(position))
    runs = islands.groupBy("row_id", "op", "op_order", "da", "db", "island").agg(
        F.min("bit").alias("start"), F.count("*").alias("length")).where(F.col("length") >= 2)
    key = F.struct(-F.col("length"), "op_order", ((F.col("da") + F.col("start")) % 8), ((F.col("db") + F.col("start")) % 8), "start")
    best = runs.groupBy("row_id").agg(F.min_by(F.struct("op", "da", "db", "start", F.col("length").cast("int").alias("length")), key).alias("run"))
    return best.select("row_id", "run.*")


def sequence_rules(pairs: DataFrame) -> DataFrame:
    """Chosen rule per (row, bit): the longest shifted run first, remaining bits by scan order."""
    # Both uses below read the stored rules; without it the scan of all rules would be planned for each.
    valid = cut_lineage(bit_rules(pairs, ordered_rules()))
    runs = longest_runs(valid)
    fallback = first_rules(valid).select("row_id", "bit", "kind", "op", "a", "b", "c")
    covered = runs.select("row_id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("bit"), "op", "da", "db").select(
        "row_id", "bit", F.col("op").alias("run_op"), ((F.col("da") + F.col("bit")) % 8).alias("run_a"), ((F.col("db") + F.col("bit")) % 8).alias("run_b"))
    joined = fallback.join(covered, ["row_id", "bit"], "left")
    in_run = F.col("run_op").isNotNull()
    return joined.select("row_id", "bit", in_run.alias("from_run"), F.when(in_run, F.col("run_op")).otherwise(F.col("kind")).alias("kind"),
                         F.when(in_run, F.col("run_op")).otherwise(F.col("op")).alias("op"),
                         F.when(in_run, F.col("run_a")).otherwise(F.col("a")).cast("int").alias("a"),
                         F.when(in_run, F.col("run_b")).otherwise(F.col("b")).cast("int").alias("b"), "c")


def _rotate(x: Column, k: int) -> Column:
    return ((x * (1 << k)) % 256 + F.floor(x / (1 << (8 - k)))).cast("bigint")


def _reverse(x: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for j in range(8):
        total = total + (F.floor(x / (1 << j)) % 2) * (1 << (7 - j))
    return total


def byte_functions(x: Column) -> dict[str, Column]:
    """Whole-byte base functions; every rule is one of them followed by an exclusive-or constant."""
    out = {"same": x, "reverse": _reverse(x)}
    for k in range(1, 8):
        out[f"rotate{k}"] = _rotate(x, k)
        out[f"left{k}"] = (x * (1 << k)) % 256
        out[f"right{k}"] = F.floor(x / (1 << k)).cast("bigint")
    return out


def byte_transform_scan(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole-byte rules by vote: ``row_id, target, predicted, votes``.

    For every base function the exclusive-or of its value with the output must be one constant over all pairs, which a
    combinable min and max decide without exploding pairs by rules. The candidates then vote, first in scan order on ties.
    """
    to_int = lambda c: F.conv(c, 2, 10).cast("bigint")
    x, y = to_int(F.col("lhs")), to_int(F.col("rhs"))
    gaps = {name: value.bitwiseXOR(y) for name, value in byte_functions(x).items()}
    stats = pairs.groupBy("row_id").agg(*[f(g).alias(f"{p}_{n}") for n, g in gaps.items() for f, p in ((F.min, "lo"), (F.max, "hi"))])
    joined = targets.withColumn("t", to_int(F.col("target"))).join(stats, "row_id")
    outs = byte_functions(F.col("t"))
    constant = lambda n: F.when(F.col(f"lo_{n}") == F.col(f"hi_{n}"), F.col(f"lo_{n}"))

    candidates: list[Column] = []

    def offer(order: Column | int, n: str, only: int | None = None) -> None:
        c = constant(n)
        ok = c.isNotNull() if only is None else (c == only)
        candidates.append(F.when(ok, F.struct((order if isinstance(order, Column) else F.lit(order)).cast("bigint").alias("order"),
                                              outs[n].bitwiseXOR(c).alias("value"))))

    offer(0, "same", 255)
    offer(1, "same")
    offer(2, "reverse", 0)
    for k in range(1, 8):
        offer(10 + k, f"rotate{k}", 0)
        offer(20 + k, f"rotate{8 - k}", 0)
        offer(30 + k, f"left{k}", 0)
        offer(40 + k, f"right{k}", 0)
    offer(50, "same")
    offer(51, "reverse")
    for k in range(1, 8):
        offer(60 + k, f"rotate{k}")
    # Exclusive-or before the rotation: the constant moved back through the rotation. Equal constants count once, with
    # the smallest rotation.
    moved = {k: _rotate(constant(f"rotate{k}"), 8 - k) for k in range(1, 8)}
    for k in range(1, 8):
        earlier = F.lit(False)
        for smaller in range(1, k):
            earlier = earlier | F.coalesce(moved[smaller] == moved[k], F.lit(False))
        n = f"rotate{k}"
        candidates.append(F.when(constant(n).isNotNull() & ~earlier,
                                 F.struct((moved[k] + 100).alias("order"), outs[n].bitwiseXOR(constant(n)).alias("value"))))
    offer(400, "rotate4", 0)
    offer(401, "rotate4")
    offered = joined.select("row_id", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("c"))
    votes = offered.groupBy("row_id", "c.value").agg(F.count("*").alias("votes"), F.min("c.order").alias("first"))
    best = votes.groupBy("row_id").agg(F.min_by(F.struct("value", "votes"), F.struct(-F.col("votes"), "first")).alias("best"))
    return targets.join(best, "row_id", "left").select(
        *targets.columns, F.lpad(F.bin("best.value"), 8, "0").alias("predicted"), F.col("best.votes").alias("votes"))
