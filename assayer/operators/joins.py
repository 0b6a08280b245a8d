"""Enrichment, audit and attribution joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import boxed_last, strip


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by an order column, as a combinable aggregate (no window over a hot key)."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    picked = rows.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])
    return picked.select(*rows.columns)


def enrich_prompt(dump: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Recover the full prompt by (type, answer); the first puzzle wins, otherwise the preview stays.

    Catalyst broadcasts the puzzle side only while it is below the session's size limit.
    """
    first = first_per_key(puzzles.select("row_id", "type", F.col("answer").alias("expected"), F.col("prompt").alias("full_prompt")),
                          ["type", "expected"], "row_id").drop("row_id")
    joined = dump.join(first, ["type", "expected"], "left")
    return joined.withColumn("prompt", F.coalesce("full_prompt", "prompt_preview")).drop("full_prompt")


def truth_audit(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """``ok``, ``wrong`` or ``missing`` per row, joined on the full trimmed prompt (never on a prefix)."""
    answers = first_per_key(truth.select(strip(F.col("prompt")).alias("key_prompt"), "answer"), ["key_prompt"], "answer")
    answers = answers.withColumn("key_hash", F.xxhash64("key_prompt"))
    keyed = rows.withColumn("key_prompt", strip(F.col("prompt"))).withColumn("key_hash", F.xxhash64("key_prompt"))
    joined = keyed.join(answers, ["key_hash", "key_prompt"], "left")
    tail = F.substring_index(F.col("text"), "</think>", -1)
    got = strip(F.regexp_extract(tail, r"\\boxed\{([^}]+)\}", 1))
    status = F.when(F.col("answer").isNull(), "missing").when(got == strip(F.col("answer")), "ok").otherwise("wrong")
    return joined.withColumn("status", status).drop("key_prompt", "key_hash", "answer")


def restrict_to(rows: DataFrame, solution: DataFrame) -> DataFrame:
    return rows.join(solution.select("row_id"), "row_id", "left_semi")


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done.select("row_id"), "row_id", "left_anti")


def training_sources(examples: DataFrame) -> DataFrame:
    """Per (source, type): row count and, per source, the union of rule kinds over its binary examples."""
    kinds = (examples.where(F.col("type") == "binary").select("source", F.explode("rule_kinds").alias("kind")).distinct()
             .groupBy("source").agg(F.array_sort(F.collect_set("kind")).alias("source_kinds")))
    counts = examples.groupBy("source", "type").agg(F.count("*").alias("examples"))
    return counts.join(kinds, "source", "left").withColumn("source_kinds", F.coalesce("source_kinds", F.array().cast("array<string>")))


def rule_overlap(a: Column, b: Column) -> Column:
    """Non-empty intersection of two rule-kind sets."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def attribute(changed: DataFrame, sources: DataFrame) -> DataFrame:
    """Changes credited to every source with the row's type; binary rows need overlapping kinds unless a side is empty.

    Changed rows are first counted per (type, outcome, kinds), so the many-to-many join works on a few combinations.
    ``changed``: ``type, outcome, row_kinds``.
    """
    combined = changed.groupBy("type", "outcome", "row_kinds").agg(F.count("*").alias("n"))
    joined = combined.join(sources, "type")
    fits = ((F.col("type") != "binary") | (F.size("source_kinds") == 0) | (F.size("row_kinds") == 0)
            | rule_overlap(F.col("row_kinds"), F.col("source_kinds")))
    n = F.col("n")
    return (joined.where(fits).groupBy("source")
            .agg(F.coalesce(F.sum(F.when(F.col("outcome") == "improvement", n)), F.lit(0)).alias("improvements"),
                 F.coalesce(F.sum(F.when(F.col("outcome") == "regression", n)), F.lit(0)).alias("regressions"))
            .withColumn("net", F.col("improvements") - F.col("regressions")))


def preference_pairs(outputs: DataFrame, gold: DataFrame, fewest: int = 20, top_up: int = 60) -> DataFrame:
    """Wrong outputs become rejected, the gold text (or a template) chosen.

    When fewer than ``fewest`` pairs result, gold against a stub is added for the first ``top_up`` prompts that have gold.
    ``outputs``: ``row_id, prompt, answer, text``; ``gold``: ``prompt, gold_text``. The join uses the full prompt.
    """
    from assayer.functions.match import match_round2

    box = lambda answer: F.concat(F.lit("\\boxed{"), answer, F.lit("}"))
    first_gold = first_per_key(gold.select("prompt", "gold_text"), ["prompt"], "gold_text")
    joined = outputs.join(first_gold, "prompt", "left")
    # Template texts.
    template = F.concat(F.lit("<think>\nLet me solve this step by step.\nAfter careful analysis of the pattern from the examples, "
                              "I determine the answer.\n</think>\n\n"), box(F.col("answer")))
    stub = F.concat(F.lit("<think>\nThe answer is.\n</think>\n\n"), box(F.col("answer")))
    wrong = joined.where(~match_round2(F.col("answer"), boxed_last(F.col("text")))).select(
        "row_id", "prompt", F.coalesce("gold_text", template).alias("chosen"), F.col("text").alias("rejected"), F.lit("wrong").alias("origin"))
    needed = wrong.limit(fewest).agg((F.count("*") < fewest).alias("short"))
    extra = (joined.orderBy("row_id").limit(top_up).where(F.col("gold_text").isNotNull())
             .select("row_id", "prompt", F.col("gold_text").alias("chosen"), stub.alias("rejected"), F.lit("top_up").alias("origin")))
    extra = extra.where(needed.scalar())
    return wrong.unionByName(extra)


def teacher_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of verified outputs by id, the first teacher preferred, with the overlap flagged."""
    tagged = first.select("row_id", "text", F.lit(0).alias("teacher")).unionByName(
        second.select("row_id", "text", F.lit(1).alias("teacher")))
    return (tagged.groupBy("row_id").agg(F.min_by("text", "teacher").alias("text"), F.min("teacher").alias("teacher"),
                                         (F.count_distinct("teacher") > 1).alias("overlap")))
