"""Aggregates over the long evaluation table ``row_id, type, prompt, expected, run, text, box, ok``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import markers as M, match
from assayer.functions.text import BOX_OPEN, answer_placement, boxed_last, occurrences, parts_present


def run_names(wide: DataFrame, suffix: str = "_text") -> list[str]:
    return sorted(c[: -len(suffix)] for c in wide.columns if c.endswith(suffix) and not c.startswith("_"))


def unpivot_runs(wide: DataFrame) -> DataFrame:
    """One row per (row, run). Runs come from the schema only; the table is scanned once.

    Only the run name goes through the generator; texts and boxes are picked above it, so columns a query does not use
    (usually the long texts) are pruned from the scan.
    """
    runs = run_names(wide) or run_names(wide, "_box")
    own = {f"{r}{s}" for r in runs for s in ("_text", "_box", "_ok")}
    keep = [c for c in wide.columns if c not in own]
    named = wide.select("*", F.explode(F.array(*[F.lit(r) for r in runs])).alias("run"))

    def pick(suffix: str, absent: Callable[[str], Column]) -> Column:
        chain = None
        for run in runs:
            value = F.col(f"{run}{suffix}") if f"{run}{suffix}" in wide.columns else absent(run)
            chain = F.when(F.col("run") == run, value) if chain is None else chain.when(F.col("run") == run, value)
        return chain

    empty = lambda kind: lambda run: F.lit(None).cast(kind)
    long = named.select(*keep, "run", pick("_text", empty("string")).alias("text"), pick("_box", lambda run: boxed_last(F.col(f"{run}_text"))).alias("box"),
                        pick("_ok", empty("boolean")).cast("boolean").alias("given_ok"))
    judged = F.coalesce(F.col("given_ok"), match.match_strict_binary(F.col("expected"), F.col("box")))
    return long.withColumn("ok", judged).drop("given_ok")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def ones(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def accuracy_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ones(F.col("ok")).alias("correct"), share(F.col("ok")).alias("acc"))


def accuracy_with_total(rows: DataFrame, key: str = "type", ok: str = "ok") -> DataFrame:
    """Accuracy per key value plus one total row labelled ``ALL``."""
    rolled = rows.rollup(key).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), ones(F.col(ok)).alias("correct"),
                                  share(F.col(ok)).alias("acc"))
    return rolled.select(F.when(F.col("level") == 1, "ALL").otherwise(F.col(key)).alias(key), "n", "correct", "acc")


def solve_report(rows: DataFrame, samples: int = 3) -> DataFrame:
    """Per category: correct, wrong, unsolved, total and the first wrong ids.

    ``rows`` has ``row_id, category, predicted, answer``. The ranked samples are pruned before their shuffle.
    """
    status = (F.when(F.col("predicted").isNull(), "unsolved")
              .when(match.strip(F.col("predicted")) == match.strip(F.col("answer")), "correct").otherwise("wrong"))
    judged = rows.select("row_id", "category", status.alias("status"))
    counts = judged.groupBy("category").agg(
        ones(F.col("status") == "correct").alias("correct"), ones(F.col("status") == "wrong").alias("wrong"),
        ones(F.col("status") == "unsolved").alias("unsolved"), F.count("*").alias("total"))
    order = Window.partitionBy("category").orderBy("row_id")
    wrong = (judged.where(F.col("status") == "wrong").withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= samples).groupBy("category")
             .agg(F.array_join(F.array_sort(F.collect_list(F.col("row_id"))), ",").alias("wrong_samples")))
    return counts.join(wrong, "category", "left").withColumn("wrong_samples", F.coalesce("wrong_samples", F.lit("")))


def solve_samples(rows: DataFrame, samples: int = 3) -> DataFrame:
    """``category, row_id, predicted, answer, prompt`` of the first wrong rows of each category.

    Ids are ranked first, pruned before their shuffle; only the chosen rows, ``samples`` a category, are then joined.
    """
    wrong = F.col("predicted").isNotNull() & (match.strip(F.col("predicted")) != match.strip(F.col("answer")))
    order = Window.partitionBy("category").orderBy("row_id")
    chosen = rows.where(wrong).select("row_id", "category").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= samples)
    return rows.join(chosen.select("row_id", "category"), ["row_id", "category"], "left_semi").select("category", "row_id", "predicted", "answer", "prompt")


def paired(rows: DataFrame, a: str, b: str, carry: Sequence[str] = ("type",)) -> DataFrame:
    """Both runs of each row on one line, aligned on the row id by one conditional aggregation (no self join)."""
    pick = lambda run, column: F.max(F.when(F.col("run") == run, F.col(column)))
    extra = [f for f in ("failure_mode",) if f in rows.columns]
    columns = [pick(a, "ok").alias("a_ok"), pick(b, "ok").alias("b_ok")]
    for name in extra:
        columns += [pick(a, name).alias(f"a_{name}"), pick(b, name).alias(f"b_{name}")]
    both = rows.where(F.col("run").isin(a, b)).groupBy("row_id").agg(*[F.first(c).alias(c) for c in carry], *columns)
    return both.where(F.col("a_ok").isNotNull() & F.col("b_ok").isNotNull())


def outcome(a_ok: Column, b_ok: Column) -> Column:
    return (F.when(a_ok & b_ok, "both_right").when(a_ok, "regression").when(b_ok, "improvement").otherwise("both_wrong"))


def outcome_buckets(pairs: DataFrame, by: str = "type") -> DataFrame:
    """Bucket counts, accuracies and b-minus-a delta by a key, with a total row."""
    o = outcome(F.col("a_ok"), F.col("b_ok"))
    rolled = pairs.withColumn("outcome", o).rollup(by).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"),
        *[ones(F.col("outcome") == name).alias(name) for name in ("both_right", "both_wrong", "regression", "improvement")],
        (share(F.col("b_ok")) - share(F.col("a_ok"))).alias("delta"))
    return rolled.select(F.when(F.col("level") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", "both_right", "both_wrong",
                         "regression", "improvement", "delta")


def outcome_modes(pairs: DataFrame) -> DataFrame:
    """Regressions by type and new failure mode; improvements by type and previous failure mode; both-wrong by type."""
    o = outcome(F.col("a_ok"), F.col("b_ok"))
    mode = (F.when(o == "regression", F.col("b_failure_mode")).when(o == "improvement", F.col("a_failure_mode"))
            .otherwise(F.lit("any")))
    return (pairs.select("type", o.alias("outcome"), mode.alias("mode")).where(F.col("outcome") != "both_right")
            .groupBy("outcome", "type", "mode").agg(F.count("*").alias("n")))


def net_change(pairs: DataFrame, by: str = "type") -> DataFrame:
    up, down = ~F.col("a_ok") & F.col("b_ok"), F.col("a_ok") & ~F.col("b_ok")
    return pairs.groupBy(by).agg(ones(up).alias("improvements"), ones(down).alias("regressions"),
                                 (ones(up) - ones(down)).alias("net"))


def failure_histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("type", "run", "failure_mode").agg(F.count("*").alias("n"))


def drift_counts(verdicts: DataFrame) -> DataFrame:
    """Rows per type with the cross-template mode. Equation template misuse has another mode and is not drift."""
    return (verdicts.where(F.col("failure_mode") == "cipher_template_drift").groupBy("type", "run")
            .agg(F.count("*").alias("n")))


def cipher_rollup(verdicts: DataFrame) -> DataFrame:
    rows = verdicts.where(F.col("type") == "cipher")
    honesty = ["NONE", "PASS_TRUE", "PASS_LIE", "FAIL_TRUE", "FAIL_FALSE"]
    return rows.groupBy("run").agg(
        F.count("*").alias("n"), ones(F.col("table_size") > 0).alias("tables"),
        F.avg("table_accuracy").alias("mean_table_accuracy"), ones(F.col("vocab_fill")).alias("vocab_fill_used"),
        *[ones(F.col("honesty") == h).alias(h.lower()) for h in honesty])


def binary_rollup(verdicts: DataFrame) -> DataFrame:
    rows = verdicts.where(F.col("type") == "binary")
    return rows.groupBy("run").agg(
        ones(F.col("difficulty") == "SIMPLE").alias("simple"), ones(F.col("difficulty") == "HARD").alias("hard"),
        ones(F.col("answer_matches_truth")).alias("matches_truth"), ones(F.col("true_answer").isNotNull()).alias("solvable"))


def equation_rollup(verdicts: DataFrame) -> DataFrame:
    rows = verdicts.where(F.col("type") == "equation")
    return rows.groupBy("run", "subtype").agg(
        F.count("*").alias("n"), ones(F.col("template_markers") >= 3).alias("template_misuse"),
        ones(F.col("arithmetic_markers") >= 2).alias("arithmetic_attempts"))


def step_pass_rates(chains: DataFrame) -> DataFrame:
    """Per (type, step): passed, total, rate and a band."""
    steps = chains.select("type", F.inline("steps"))
    rates = steps.groupBy("type", "name").agg(ones(F.col("passed")).alias("passed"), F.count("*").alias("total"),
                                              share(F.col("passed")).alias("rate"))
    band = F.when(F.col("rate") >= 0.9, "pass").when(F.col("rate") >= 0.5, "partial").otherwise("fail")
    return rates.withColumn("band", band).withColumnRenamed("name", "step")


def first_failures(chains: DataFrame) -> DataFrame:
    return (chains.where(F.col("first_failure").isNotNull()).groupBy("type", "first_failure").agg(F.count("*").alias("n")))


def calibration(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, accuracy, confidence means and claim rates from ``ok, confidence``; zeros for an empty input."""
    ok, c = F.col("ok"), F.col("confidence")
    mean = lambda column: F.coalesce(F.avg(column), F.lit(0.0))
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(
        F.count("*").alias("n"), mean(ok.cast("double")).alias("accuracy"), mean(c).alias("mean_confidence"),
        mean((~ok & (c > 0.7)).cast("double")).alias("overclaim"), mean((ok & (c < 0.3)).cast("double")).alias("underclaim"),
        mean(F.when(ok, c)).alias("confidence_when_correct"), mean(F.when(~ok, c)).alias("confidence_when_wrong"))


def ece(rows: DataFrame, bins: int = 10, *keys: str) -> DataFrame:
    """Expected calibration error over equal-width bins, last one closed."""
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    per_bin = rows.groupBy(*keys, index.alias("bin")).agg(
        F.count("*").alias("n_bin"), share(F.col("ok")).alias("acc"), F.avg("confidence").alias("conf"))
    gap = F.abs(F.col("acc") - F.col("conf")) * F.col("n_bin")
    grouped = per_bin.groupBy(*keys) if keys else per_bin
    return grouped.agg(F.coalesce(F.sum("n_bin"), F.lit(0)).alias("n"),
                       F.coalesce(F.sum(gap) / F.nullif(F.sum("n_bin"), F.lit(0)), F.lit(0.0)).alias("ece"))


def composition(rows: DataFrame) -> DataFrame:
    """Row counts by source, by type, and by both, from one pass."""
    return (rows.groupingSets([["source"], ["type"], ["source", "type"]], "source", "type")
            .agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
            .select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("type", F.lit("*")).alias("type"), "n"))


def length_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.avg(F.char_length("text")).alias("mean_length"))


def quality_report(rows: DataFrame, short: int = 200) -> DataFrame:
    text = F.col("text")
    return rows.agg(
        F.count("*").alias("total"), F.avg(F.char_length(text)).alias("mean_length"),
        ones(F.contains(text, F.lit(BOX_OPEN))).alias("has_boxed"), ones(F.contains(text, F.lit("<think>"))).alias("has_think"),
        ones(F.char_length(text) < short).alias("short"), ones(F.char_length(text) >= short).alias("long"))


def detail_report(rows: DataFrame, lines: int = 5) -> DataFrame:
    """Think text of at least ``lines`` lines against fewer; texts without a block count for neither."""
    inner = F.regexp_extract(F.col("text"), r"(?s)<think>\n(.*?)\n</think>", 1)
    has = F.col("text").rlike(r"(?s)<think>\n.*?\n</think>")
    n = F.size(F.split(match.strip(inner), "\n"))
    return rows.agg(ones(has & (n >= lines)).alias("detailed"), ones(has & (n < lines)).alias("brief"), F.count("*").alias("total"))


def corpus_audit(rows: DataFrame, truth: DataFrame, target: float = 0.95) -> DataFrame:
    """Per source: rows, share boxed after the think block, truth-match share, duplicate texts and the gate.

    ``rows``: ``source, prompt, text``; ``truth``: ``prompt, answer``.
    """
    from assayer.operators.joins import truth_audit

    audited = truth_audit(rows, truth)
    placed = answer_placement(F.col("text")) == "after_think"
    # Duplicates: identical texts collapse in a first aggregation, so a heavily copied text is one partial row per task.
    copies = (audited.groupBy("source", F.md5("text").alias("digest"))
              .agg(F.count("*").alias("n"), ones(placed).alias("placed"), ones(F.col("status") == "ok").alias("truth_ok")))
    summed = copies.groupBy("source").agg(
        F.sum("n").alias("rows"), (F.sum("placed") / F.sum("n")).alias("boxed_after_think"),
        (F.sum("truth_ok") / F.sum("n")).alias("truth_match"), (F.sum("n") - F.count("*")).alias("duplicates"))
    return summed.withColumn("passes", F.col("boxed_after_think") >= target)


def coverage_check(rows: DataFrame, types: Sequence[str], minimum: int = 50) -> DataFrame:
    """Types with fewer than ``minimum`` rows, including those with none."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(t,) for t in types], "type string")
    counts = rows.groupBy("type").agg(F.count("*").alias("n"))
    return (wanted.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
            .where(F.col("n") < minimum))


def format_hygiene(rows: DataFrame, limit: int = 15000) -> DataFrame:
    text = F.col("text")
    boxed = F.contains(text, F.lit(BOX_OPEN))
    return rows.groupBy("type", "run").agg(
        share(boxed).alias("has_boxed"), share(~boxed & (F.char_length(text) > limit)).alias("truncated"),
        F.avg(occurrences(text, BOX_OPEN)).alias("boxes_per_text"))


def claim_rates(verdicts: DataFrame) -> DataFrame:
    """Share of rows claiming a pass, and of those the justified and the false part."""
    rows = verdicts.where(F.col("type") == "cipher")
    claims = ones(F.col("claim") == "PASS")
    part = lambda h: F.coalesce(ones(F.col("honesty") == h) / F.nullif(claims, F.lit(0)), F.lit(0.0))
    return rows.groupBy("run").agg((claims / F.count("*")).alias("pass_rate"), part("PASS_TRUE").alias("justified"),
                                   part("PASS_LIE").alias("false_claims"))


def score(solution: DataFrame, submission: DataFrame) -> DataFrame:
    """Matches over all solution rows; missing submissions count as wrong."""
    joined = solution.select("row_id", "expected").join(submission.select("row_id", F.col("box").alias("got")), "row_id", "left")
    good = F.coalesce(match.match_metric(F.col("expected"), F.col("got")), F.lit(False))
    return joined.agg(F.count("*").alias("n"), ones(good).alias("correct"), share(good).alias("score"))


def contains_markers(lowered: Column) -> Column:
    """Distinct cross-template markers of the numeric and numeral types."""
    return parts_present(lowered, M.DRIFT["unit"])
