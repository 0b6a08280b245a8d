"""Language by learned profiles of word edges: smoothed counts of what words begin and end with, from labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.session import stored

SIZE, LEAST = 4000, 5


def _listed(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep, edge``: a row for each edge of each word."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    listed = docs.select(*keep, F.explode(words).alias("w"))
    parts = F.array(F.concat(F.lit("^"), F.left("w", F.lit(2))), F.concat(F.right("w", F.lit(2)), F.lit("$")), F.when(F.length("w") <= 4, F.concat(F.lit("="), "w")))
    return listed.select(*keep, F.explode(parts).alias("edge")).where("edge is not null")


def edges(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep, edge, n``: first and last two letters of every word of a text and its words of up to four letters, with their number."""
    return _listed(docs, *keep, text=text).groupBy(*keep, "edge").agg(F.count("*").alias("n"))


def learn_profiles(labelled: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """``edge, language, weight``: logarithm of the smoothed share of each of the ``size`` most frequent edges among a language's words.

    ``labelled``: ``text, lang``; rows without a language or text teach nothing. All counts combine before the shuffle; edges of less than
    ``least`` occurrences are left out, so a profile is a table of bounded size.
    """
    counted = stored(edges(labelled.where("lang is not null"), "lang"), "edge-counts")
    totals = counted.groupBy("edge").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    kept = totals.orderBy(F.desc("all"), "edge").limit(size).select("edge")
    known = counted.join(kept, "edge")
    sizes = known.groupBy("lang").agg(F.sum("n").alias("total"))
    width = kept.agg(F.count("*").alias("width"))
    # A row for each edge and language, so that an edge which a language does not have gets a smoothed weight too.
    languages = sizes.agg(F.collect_list(F.struct("lang", "total")).alias("languages"))
    grid = kept.select("edge", F.explode(languages.scalar()).alias("s")).select("edge", "s.lang", "s.total").join(known, ["lang", "edge"], "left")
    return grid.select("edge", F.col("lang").alias("language"), F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + width.scalar())).alias("weight"))


def profile_language(docs: DataFrame, profiles: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` (``doc_id`` by default) and ``language``: that of the profile under which the edges of a text are likeliest, the first of equals.

    Texts without a known edge, and null texts, are ``und``. ``keep`` must name one text each. Sums of a text combine in the task that reads it.
    """
    keep = keep or ("doc_id",)
    profiles = stored(profiles, "profiles")
    languages = [r.language for r in profiles.select("language").distinct().orderBy("language").collect()]
    if not languages:
        return docs.select(*keep, F.lit("und").alias("language"))
    # A line for each edge holds the weights of all languages, so that a text's edges meet it once and are neither counted nor moved.
    weights = profiles.groupBy("edge").agg(*[F.sum(F.when(F.col("language") == name, F.col("weight"))).alias(f"_w{i}") for i, name in enumerate(languages)])
    met = _listed(docs.select(*[F.col(k).alias(f"_{k}") for k in keep], F.col(text).alias("_text")), *[f"_{k}" for k in keep], text="_text").join(F.broadcast(weights), "edge")
    scored = met.groupBy(*[f"_{k}" for k in keep]).agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(languages))])
    ranked = F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("language")) for i, name in enumerate(languages)])
    best = F.array_max(F.filter(ranked, lambda x: x["score"].isNotNull()))["language"]
    named = scored.select(*[f"_{k}" for k in keep], best.alias("language"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keep]
    return docs.select(*keep).join(named, on, "left").select(*keep, F.coalesce("language", F.lit("und")).alias("language"))
