"""Step-by-step grading of a reasoning text: an array of (name, passed, score, detail) per row and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import markers as M, match
from assayer.functions.text import contains_any, count_matches, count_words, guarded, parts_present, strip, with_value, words


def _step(name: str, passed: Column, score: Column | None = None, detail: Column | None = None) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    score = passed.cast("double") if score is None else F.coalesce(score, F.lit(0.0)).cast("double")
    detail = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), score.alias("score"), detail.alias("detail"))


def _counted(name: str, n: Column, need: int, full: float) -> Column:
    return _step(name, n >= need, F.least(n / F.lit(full), F.lit(1.0)), n)


def short_number(text: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form outside the usual range."""
    raw = F.format_string("%.6g", text.try_cast("double"))
    fixed = F.when(F.contains(raw, F.lit(".")), F.regexp_replace(raw, r"\.?0+$", "")).otherwise(raw)
    return F.when(text.try_cast("double").isNotNull(), F.when(F.contains(raw, F.lit("e")), F.regexp_replace(raw, r"\.?0*e", "e")).otherwise(fixed))


def _box() -> Column:
    return strip(F.coalesce("box", F.lit("")))


def _marks(**values: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in values.items()])


def _mark(kind: str):
    return lambda name: F.col(f"{kind}_marks.{name}")


def _n_pairs() -> Column:
    return F.greatest(F.size("pairs"), F.lit(0))


def _pairs_found(keep) -> Column:
    return F.greatest(F.size(F.filter("pairs", keep)), F.lit(0))


def _target_found(text: Column) -> Column:
    return (F.col("target") != "") & F.contains(text, F.col("target"))


BOXED = r"\\boxed\{[^}]*\}"


def _boxed(mark, box: Column) -> Column:
    return _step("boxed_format", mark("boxed") & (box != ""))


def binary_marks(low: Column) -> Column:
    text, word = F.col("text"), M.STEP_WORDS["binary"]
    gates = count_words(text, [part for g in word["gates"] for part in (g, g.lower())], r"\b") + count_words(text, [p[2:] for p in M.INPUT_MENTIONS], flags="i")
    per_bit, language = count_words(text, [p[2:] for p in M.PER_BIT], flags="i"), F.lit(False)
    for p in M.CONSISTENCY:
        language = language | guarded(low, p, text.rlike("(?i)" + p), F.lit(False))
    return _marks(type=contains_any(low, word["type"]), pairs=_n_pairs(), present=_pairs_found(lambda p: F.contains(F.col("text"), p["lhs"])),
                  per_bit=per_bit, gates=gates, language=language, applied=_target_found(text) & contains_any(low, word["apply"]), boxed=text.rlike(r"\\boxed\s*\{"))


def binary_steps() -> Column:
    mark, box = _mark("binary"), _box()
    matches_truth = F.coalesce(box == F.col("true_answer"), F.lit(False))
    valid = box.rlike("^[01]{8}$")
    gap = match.hamming(box, F.col("true_answer"))
    partial = F.when(F.col("true_answer").isNotNull() & (F.char_length(box) == 8), F.greatest(F.lit(0.0), 1.0 - gap / 8.0)).otherwise(0.0)
    return F.array(
        _step("identify_type", mark("type")),
        _step("parse_examples", mark("present") >= 3, mark("present") / F.nullif(mark("pairs"), F.lit(0)), mark("present")),
        _counted("per_bit_tried", mark("per_bit"), 4, 8.0), _counted("rule_derived", mark("gates"), 4, 8.0),
        _step("consistency_ok", mark("language") | matches_truth), _step("rule_applied", mark("applied")),
        _step("valid_binary", valid, F.when(valid, 1.0).otherwise(partial), gap), _boxed(mark, box))


def cipher_marks(low: Column) -> Column:
    text = F.col("text")
    example_words = F.array_distinct(F.flatten(F.transform("pairs", lambda p: words(F.lower(p["lhs"])))))
    found = F.greatest(F.size(F.filter(example_words, lambda w: F.contains(low, w))), F.lit(0))
    return _marks(type=contains_any(F.lower(F.substring(text, 1, 500)), M.STEP_WORDS["cipher"]["type"]), found=found, aligned=count_matches(text, M.CHAR_ALIGN),
                  applied=(F.col("target") != "") & (_box() != "") & (F.size(words(_box())) == F.size(words(F.col("target")))), boxed=text.rlike(BOXED))


def cipher_steps() -> Column:
    """Uses ``stated, table_size, shared_accuracy`` of the cipher flags and ``vocabulary_share``."""
    mark, box = _mark("cipher"), _box()
    return F.array(
        _step("identify_type", mark("type")),
        _counted("parse_examples", mark("found"), 3, 3.0), _counted("char_align", mark("aligned"), 5, 5.0),
        _counted("derive_table", F.col("table_size"), 10, 10.0),
        _step("table_accuracy", F.col("shared_accuracy") >= 0.9, F.col("shared_accuracy")),
        _step("apply_table", mark("applied")),
        _step("valid_english", F.col("vocabulary_share") >= 0.8, F.col("vocabulary_share")),
        _boxed(mark, box))


def equation_marks(low: Column) -> Column:
    text, word = F.col("text"), M.STEP_WORDS["equation"]
    return _marks(type=contains_any(low, word["type"]), pairs=_n_pairs(), found=_pairs_found(lambda p: F.contains(F.col("text"), p["lhs"])),
                  subtype=contains_any(low, word["subtype"]), arithmetic=parts_present(low, word["arithmetic"]), template=parts_present(low, word["template"]),
                  commit=contains_any(low, word["commit"]), applied=_target_found(text), boxed=text.rlike(BOXED))


def equation_steps() -> Column:
    mark, box = _mark("equation"), _box()
    return F.array(
        _step("identify_type", mark("type")),
        _step("parse_operands", mark("found") >= 1, mark("found") / F.nullif(mark("pairs"), F.lit(0)), mark("found")),
        _step("detect_subtype", mark("subtype")),
        _step("arithmetic_attempted", mark("arithmetic") >= 1, F.least(mark("arithmetic") / F.lit(2.0), F.lit(1.0)), mark("arithmetic")),
        _step("NOT_cipher_template", mark("template") < 3),
        _step("rule_committed", mark("commit")),
        _step("target_processed", mark("applied")),
        _boxed(mark, box))


def _number_marks() -> dict[str, Column]:
    text, both = F.col("text"), lambda p: F.contains(F.col("text"), short_number(p["lhs"])) & F.contains(F.col("text"), short_number(p["rhs"]))
    return dict(pairs=_n_pairs(), found=_pairs_found(both), applied=F.contains(text, short_number(F.col("target"))), boxed=text.rlike(BOXED))


def _number_pairs(name: str, mark) -> Column:
    return _step(name, mark("found") >= 2, mark("found") / F.nullif(mark("pairs"), F.lit(0)), mark("found"))


def _boxed_decimals(mark, box: Column) -> Column:
    inside = mark("boxed")
    exact = inside & box.rlike(M.TWO_DECIMALS)
    passed = (box != "") & inside & (box.rlike(M.TWO_DECIMALS) | match.number(box).isNotNull())
    return _step("boxed_format_2dec", passed, F.when(exact, 1.0).when(passed, 0.5).otherwise(0.0))


def gravity_marks(low: Column) -> Column:
    text, formed = F.col("text"), F.lit(False)
    for p in M.GRAVITY_FORMS:
        formed = formed | guarded(low, p, text.rlike("(?i)" + p), F.lit(False))
    word = M.STEP_WORDS["gravity"]
    return _marks(type=contains_any(low, word["type"]), formed=formed, consistency=contains_any(low, word["consistency"]), **_number_marks())


def gravity_steps() -> Column:
    mark, box = _mark("gravity"), _box()
    return F.array(_step("identify_type", mark("type")), _number_pairs("parse_observations", mark),
                   _step("g_computed", mark("formed")), _step("g_consistency_check", mark("consistency")),
                   _step("applied_to_target", mark("applied")), _boxed_decimals(mark, box))


def unit_marks(low: Column) -> Column:
    word = M.STEP_WORDS["unit"]
    return _marks(type=contains_any(low, word["type"]), slope=contains_any(low, word["slope"]) | F.col("text").rlike(M.DIVISION), **_number_marks())


def unit_steps() -> Column:
    mark, box = _mark("unit"), _box()
    return F.array(_step("identify_type", mark("type")), _number_pairs("parse_examples", mark), _step("slope_computed", mark("slope")),
                   _step("applied_to_target", mark("applied")), _boxed_decimals(mark, box))


def roman_marks(low: Column) -> Column:
    text, word = F.col("text"), M.STEP_WORDS["roman"]
    implied_roman = F.contains(low, F.lit("decompose")) & contains_any(low, ["tens", "segment", "ones"])
    implied_arabic = F.contains(low, F.lit("parse")) & F.contains(low, F.lit("total"))
    values = F.lit(False)
    for p in M.ROMAN_VALUE_FORMS:
        values = values | text.rlike(p)
    target = F.when(F.col("direction") == "arabic_to_roman", F.col("target").try_cast("bigint").cast("string")).otherwise(F.col("target"))
    return _marks(
        type=contains_any(low, word["type"]) | (count_matches(text, M.ROMAN_TOKEN) >= 3) | contains_any(text, word["segments"]),
        direction=contains_any(low, word["to_roman"] + word["to_arabic"]) | implied_roman | implied_arabic,
        logic=contains_any(low, word["conversion"]) | values, applied=F.contains(text, target), boxed=text.rlike(BOXED))


def roman_steps() -> Column:
    mark, box = _mark("roman"), _box()
    expected = strip(F.col("expected"))
    is_roman, is_arabic = lambda c: F.upper(c).rlike("^[MDCLXVI]+$"), lambda c: c.rlike("^-*[0-9]+$")
    fits = F.when(is_roman(expected), is_roman(box)).when(is_arabic(expected), is_arabic(box)).otherwise(is_roman(box) | is_arabic(box))
    return F.array(
        _step("identify_type", mark("type")), _step("direction_detected", mark("direction")), _step("conversion_logic", mark("logic")),
        _step("applied_to_target", mark("applied")), _step("boxed_format", (box != "") & mark("boxed") & fits))


MARKS = {"binary": binary_marks, "cipher": cipher_marks, "equation": equation_marks, "gravity": gravity_marks, "roman": roman_marks, "unit": unit_marks}
STEPS = {"binary": binary_steps, "cipher": cipher_steps, "equation": equation_steps, "gravity": gravity_steps,
         "roman": roman_steps, "unit": unit_steps}


def with_marks(rows: DataFrame) -> DataFrame:
    """What each text says, and which parts of its own prompt it holds: a struct per type, all that the steps need of the text.

    ``rows`` has ``type, text, box`` and ``pairs, target, direction`` of the prompt. Texts are searched once, where they are read, so that
    neither the facts nor the vocabulary shares meet them in a join.
    """
    return rows.withColumns({f"{kind}_marks": F.when(F.col("type") == kind, with_value(F.lower("text"), build)) for kind, build in MARKS.items()})


def vocabulary_share(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of the boxed words (letters only) found in a vocabulary, per (row, run); the vocabulary is an equi-join side."""
    letters = F.filter(F.transform(words(F.lower("box")), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w != "")
    exploded = rows.where(F.col("type") == "cipher").select("row_id", "run", F.explode(letters).alias("word"))
    known = vocabulary.select("word").distinct().withColumn("known", F.lit(True))
    return (exploded.join(known, "word", "left").groupBy("row_id", "run")
            .agg((F.count_if(F.col("known")) / F.count("*")).alias("vocabulary_share")))


def grade_chains(flagged: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Steps, first failure, counts and chain score.

    ``flagged`` is the verdict table of rows with marks (facts and cipher flags joined), ``shares`` the vocabulary shares of its answers.
    """
    if shares is not None:
        flagged = flagged.join(shares, ["row_id", "run"], "left")
    elif "vocabulary_share" not in flagged.columns:
        flagged = flagged.withColumn("vocabulary_share", F.lit(None).cast("double"))
    steps = None
    for kind, build in STEPS.items():
        steps = F.when(F.col("type") == kind, build()) if steps is None else steps.when(F.col("type") == kind, build())
    empty = F.array().cast("array<struct<name:string,passed:boolean,score:double,detail:string>>")
    # What a generator puts out is computed once; as a plain column, the steps would be computed again for each of the columns below and each filter on them.
    graded = flagged.select("row_id", "type", "run", "ok", "text", F.explode(F.array(steps.otherwise(empty))).alias("steps"))
    failed = F.filter("steps", lambda s: ~s["passed"])
    n = F.size("steps")
    return graded.withColumns({
        "first_failure": F.when(n == 0, "unknown_type").otherwise(F.get(failed, F.lit(0))["name"]),
        "pass_count": n - F.size(failed), "fail_count": F.size(failed),
        "chain_score": F.coalesce((n - F.size(failed)) / F.nullif(n, F.lit(0)), F.lit(0.0))})
