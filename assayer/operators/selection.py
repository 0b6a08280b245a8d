"""Sampling, ranking and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators.evaluation import ones
from assayer.operators.quantiles import hash_rank, rank_in_order

# Spark prunes ranked windows before their shuffle up to this limit (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANKS = 1000


def hash_key(seed: str, *columns: str) -> Column:
    """Reproducible uniform sort key."""
    return F.md5(F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def ordered_key(seed: str, key: str) -> Column:
    """Hash order with the key itself behind it, so that every path breaks ties alike."""
    return F.concat_ws("-", hash_key(seed, key), F.col(key).cast("string"))


def sample_ranks(rows: DataFrame, group: list[str], seed: str, key: str, at_most: int) -> DataFrame:
    """Adds ``rank`` in hash order within groups, pruned before the shuffle for small quotas, salted for large ones."""
    if at_most <= PRUNED_RANKS:
        order = Window.partitionBy(*group).orderBy(ordered_key(seed, key))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= at_most)
    return hash_rank(rows, ordered_key(seed, key), group).where(F.col("rank") <= at_most)


def stratified_n(rows: DataFrame, n: int, seed: str, group: str = "type", key: str = "row_id", drop: str = "other") -> DataFrame:
    """Up to ``n`` rows per group in hash order; one label is left out."""
    return sample_ranks(rows.where(F.col(group) != drop), [group], seed, key, n).drop("rank")


def stratified_total(rows: DataFrame, total: int, groups: list[str], seed: str, group: str = "type", key: str = "row_id") -> DataFrame:
    """``total`` split evenly over the groups, the first ones taking one extra, capped by what is there."""
    base, extra = divmod(total, len(groups))
    quotas = rows.sparkSession.createDataFrame([(g, base + (i < extra)) for i, g in enumerate(sorted(groups))], f"{group} string, quota int")
    ranked = sample_ranks(rows.where(F.col(group).isin(*groups)), [group], seed, key, base + 1)
    return ranked.join(F.broadcast(quotas), group).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def first_in_hash_order(rows: DataFrame, n: int, seed: str, key: str = "row_id") -> DataFrame:
    """Uniform ``n`` rows: per-task top-n for small n, salted ranks beyond."""
    if n <= PRUNED_RANKS:
        return rows.orderBy(ordered_key(seed, key)).limit(n)
    return hash_rank(rows, ordered_key(seed, key)).where(F.col("rank") <= n).drop("rank")


reservoir = first_in_hash_order


def stratified_trim(rows: DataFrame, per_group: int, total: int, seed: str, group: str = "type", key: str = "row_id") -> DataFrame:
    """Per-group cap, then a uniform trim of the whole."""
    return first_in_hash_order(sample_ranks(rows, [group], seed, key, per_group).drop("rank"), total, seed + "-trim", key)


def shuffled(rows: DataFrame, seed: str, key: str = "row_id") -> DataFrame:
    """Adds the stored sort key of a reproducible global order and range-partitions by it."""
    return rows.withColumn("order_key", hash_key(seed, key)).orderBy("order_key", key)


def take_quota_solved(rows: DataFrame, n: int, seed: str, verified: str = "verified", key: str = "row_id") -> DataFrame:
    """First ``n`` verified rows in the shuffled order."""
    return first_in_hash_order(rows.where(F.col(verified)), n, seed, key)


def best_candidate(prompts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Longest correct text per prompt (lowest k on ties), else a flagged fallback.

    ``prompts``: ``prompt_id, fallback``; ``candidates``: ``prompt_id, k, text, ok``, with any value that has an order as ``k``. One
    combinable aggregate; prompts without candidates stay.
    """
    score = F.when(F.col("ok"), F.char_length("text"))
    best = candidates.groupBy("prompt_id").agg(
        F.count("*").alias("num_candidates"), ones(F.col("ok")).alias("num_correct"),
        F.min_by("text", F.when(F.col("ok"), F.struct(-score, F.col("k")))).alias("best"))
    joined = prompts.join(best, "prompt_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("prompt_id", F.coalesce("best", "fallback").alias("text"), count("num_correct").alias("num_correct"),
                         count("num_candidates").alias("num_candidates"), (count("num_correct") == 0).alias("is_fallback"))


def attempts_used(candidates: DataFrame, patience: int = 3) -> DataFrame:
    """Candidates an attempt loop would have made: it stops after attempt ``patience`` once one was correct.

    The loop ends at the larger of ``patience`` and the first correct attempt (k counts from 0).
    """
    first = candidates.where(F.col("ok")).groupBy("prompt_id").agg(F.min("k").alias("first_correct"))
    last = F.greatest(F.col("first_correct"), F.lit(patience - 1))
    joined = candidates.join(first, "prompt_id", "left")
    return joined.where(F.col("first_correct").isNull() | (F.col("k") <= last)).drop("first_correct")


def first_correct_with_limit(candidates: DataFrame, patience: int = 3) -> DataFrame:
    """Longest correct text among the attempts made (the earlier one on ties), with their number."""
    made = attempts_used(candidates, patience)
    score = F.when(F.col("ok"), F.struct(-F.char_length("text"), F.col("k")))
    return made.groupBy("prompt_id").agg(F.count("*").alias("attempts"), F.min_by("text", score).alias("best"),
                                         F.min_by("k", score).alias("best_k"))


def difficulty_band(candidates: DataFrame) -> DataFrame:
    """Correct of k per prompt: none is hard, all is easy, anything between is kept with its rate."""
    counts = candidates.groupBy("prompt_id").agg(ones(F.col("ok")).alias("correct"), F.count("*").alias("k"))
    band = F.when(F.col("correct") == 0, "hard").when(F.col("correct") == F.col("k"), "easy").otherwise("between")
    return counts.select("prompt_id", "correct", "k", band.alias("band"), (F.col("correct") / F.col("k")).alias("correct_rate"))


def acceptance_stats(candidates: DataFrame, key: str = "type") -> DataFrame:
    """Per type and in total: processed, accepted, mean correct, fallbacks and the per-candidate rate."""
    prompts = candidates.groupBy("prompt_id", key).agg(ones(F.col("ok")).alias("correct"), F.count("*").alias("k"))
    rolled = prompts.rollup(key).agg(
        F.grouping_id().alias("level"), F.count("*").alias("processed"), ones(F.col("correct") > 0).alias("accepted"),
        F.avg("correct").alias("mean_correct"), ones(F.col("correct") == 0).alias("fallbacks"), (F.sum("correct") / F.sum("k")).alias("candidate_rate"))
    return rolled.withColumn(key, F.when(F.col("level") == 1, "ALL").otherwise(F.col(key))).drop("level")


def majority_vote(candidates: DataFrame) -> DataFrame:
    """Most frequent answer per prompt, first position on ties; answers are counted before the arg-max."""
    counted = candidates.groupBy("prompt_id", "answer").agg(F.count("*").alias("votes"), F.min("k").alias("first"))
    return counted.groupBy("prompt_id").agg(F.min_by("answer", F.struct(-F.col("votes"), "first")).alias("answer"), F.max("votes").alias("votes"))


def vote_oracle_greedy(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy of the vote, of any sample, and of the first sample (lowest k), over all prompts of the truth table.

    One pass: samples are counted per answer, and the few answers of a prompt tell all three. ``k`` is any value that has an order.
    """
    counted = candidates.groupBy("prompt_id", "answer").agg(F.count("*").alias("votes"), F.min(F.struct("k", "ok")).alias("first"), F.bool_or("ok").alias("any_ok"))
    per_prompt = counted.groupBy("prompt_id").agg(F.min_by("answer", F.struct(-F.col("votes"), "first.k")).alias("answer"),
                                                  F.bool_or("any_ok").alias("any_ok"), F.min("first").alias("first"))
    joined = truth.join(per_prompt, "prompt_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return joined.agg(F.count("*").alias("n"), share(F.col("answer") == F.col("expected")).alias("vote"), share(F.col("any_ok")).alias("oracle"),
                      share(F.col("first.ok")).alias("greedy"))


def pass_at_k(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Share of prompts with a correct sample, mean win rate, prompts without any; with ``k`` also the unbiased estimate."""
    per_prompt = candidates.groupBy("prompt_id").agg(ones(F.col("ok")).alias("c"), F.count("*").alias("n"))
    columns = [F.count("*").alias("prompts"), F.avg((F.col("c") > 0).cast("double")).alias("pass_any"), F.avg(F.col("c") / F.col("n")).alias("win_rate"),
               ones(F.col("c") == 0).alias("without")]
    if k:
        # 1 - C(n - c, k) / C(n, k) as a product of k factors; prompts with fewer than k samples count their any-correct.
        factors = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (F.col("n") - F.col("c") - i) / F.nullif(F.col("n") - i, F.lit(0)))
        estimate = F.when(F.col("n") < k, (F.col("c") > 0).cast("double")).when(F.col("n") - F.col("c") < k, 1.0).otherwise(1 - factors)
        columns.append(F.avg(estimate).alias("pass_at_k"))
    return per_prompt.agg(*columns)


def top_counts(rows: DataFrame, value: str, k: int) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def sample_cases(rows: DataFrame, bucket: str, n: int, key: str = "row_id", cut: int = 400) -> DataFrame:
    """First ``n`` rows of each bucket with the prompt cut for display; ranks are pruned before the shuffle."""
    order = Window.partitionBy(bucket).orderBy(key)
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .withColumn("prompt", F.substring("prompt", 1, cut)))


def length_batches(rows: DataFrame, size: int, limit: int, key: str = "row_id") -> DataFrame:
    """Rows whose answer survives a cap of ``limit`` words, in length order, cut into batches of ``size``.

    ``rows``: ``text`` with a boxed answer. Positions come from counts per (length, salt), so no task orders everything.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    measured = rows.withColumn("_words", words)
    kept_text = F.array_join(F.slice("_words", 1, limit), " ")
    kept = measured.where(F.contains(kept_text, F.lit("boxed"))).withColumn("length", F.least(F.size("_words"), F.lit(limit))).drop("_words")
    ranked = rank_in_order(kept, F.col("length"), F.md5(F.col(key).cast("string")))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def curriculum_order(bands: DataFrame, parts: int, key: str = "prompt_id") -> DataFrame:
    """Equal-count stages from easy (high rate) to hard, ties in hash order; the sizes follow ``ntile``."""
    ranked = rank_in_order(bands, -F.col("correct_rate"), F.md5(F.col(key).cast("string")))
    total = bands.agg(F.count("*").alias("total"))
    n = total.scalar()
    small, larger = F.floor(n / parts), n % parts
    edge = larger * (small + 1)
    position = F.col("rank") - 1
    stage = F.when(position < edge, F.floor(position / (small + 1))).otherwise(larger + F.floor((position - edge) / F.nullif(small, F.lit(0))))
    return ranked.withColumn("stage", stage + 1).drop("rank")
