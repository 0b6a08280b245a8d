"""Classes of linked members of buckets, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import cut_lineage, stored


def bucket_classes(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], block: int = 512,
                   meets: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``id, component`` of every member that has a verified link to another member of one of its ``bucket``s.

    First each member meets the lowest member of its buckets, which settles a bucket of copies with one comparison a
    member. Buckets whose members are then still in several classes are compared in blocks of ``block`` members, only
    across classes: no link that could join two classes is left out, and no task holds more than two blocks.
    ``verify`` receives ``id, leader`` pairs and returns the good ones. ``meets`` tells from the column ``about`` of two
    entries of a bucket whether they can be linked at all; a link must pass it in one of its buckets at least.
    """
    if meets is None:
        entries, meets = entries.withColumn("about", F.lit(0)), lambda a, b: F.lit(True)
    # Members that are alone in their bucket leave here; both uses read the entries as dealt out once.
    dealt = entries.select("bucket", "id", "about").repartition("bucket")
    leaders = dealt.groupBy("bucket").agg(F.min("id").alias("leader"), F.min_by("about", "id").alias("its"), F.count("*").alias("members")).where(F.col("members") > 1)
    shared = stored(dealt.join(leaders, "bucket").drop("members"), "bucket-members")
    offered = shared.where((F.col("id") != F.col("leader")) & meets(F.col("about"), F.col("its"))).select("id", "leader").distinct()
    links = cut_lineage(verify(offered))
    labels = connected_components(links)
    live = stored(shared.join(labels, "id", "left").select("bucket", "id", "about", F.coalesce("component", "id").alias("label")), "bucket-labels")
    mixed = live.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parted = live.join(mixed.where(F.col("low") != F.col("high")), "bucket").select(
        "bucket", "id", "about", "label", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    parted = stored(parted, "mixed-buckets")
    mine = parted.select("bucket", "id", "about", "label", "own", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("facing"))
    theirs = parted.select("bucket", F.col("id").alias("leader"), F.col("about").alias("its_about"), F.col("label").alias("its"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("own"), F.col("own").alias("facing"))
    across = (mine.join(theirs, ["bucket", "own", "facing"])
              .where((F.col("label") != F.col("its")) & ((F.col("own") < F.col("facing")) | (F.col("id") > F.col("leader"))) & meets(F.col("about"), F.col("its_about")))
              .select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader")).distinct())
    more = cut_lineage(verify(across))
    return labels if more.isEmpty() else connected_components(links.unionByName(more))


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` (lowest id of the component) for every linked id.

    Labels move to the smallest neighbour label and then jump to the label's own label, so long chains halve each round.
    Rounds end at a fixed point; the state is cut to reliable storage each round.
    """
    edges = links.select(F.col("id").alias("a"), F.col("leader").alias("b")).where(F.col("a") != F.col("b"))
    edges = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        offers = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("offer"))
        moved = labels.join(offers, "id").select("id", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        joined = moved.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        joined = cut_lineage(joined)
        labels = joined.select("id", "label")
        if joined.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")
