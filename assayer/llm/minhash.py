"""Near copies of weighted word shingles: probability min-hash, bands, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import LOWER, byte_values, flat, mix, prefix_hashes, ranges, release, slices, span_hashes, word_spans
from assayer.operators.components import connected_components
from assayer.session import cut_lineage, stored

SHINGLE, THRESHOLD, ROWS, BANDS, ROUNDS, BLOCK = 5, 0.8, 7, 44, 1, 512
_MARGIN = 5.0
U = np.uint64


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Row, hash and count of every distinct shingle, the number of words of each row and a 64-bit print of its word sequence.

    A row of fewer than ``size`` words is one shingle; a row without words has none and its print covers its bytes.
    """
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)])
    sums = prefix_hashes(span_hashes(prefix_hashes(byte_values(data)), starts, ends))
    per_row = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    at = ranges(first[:-1], per_row)
    own = np.repeat(np.arange(len(per_row)), per_row)
    hashes = span_hashes(sums, at, np.minimum(at + size, first[own + 1]))
    prints = np.where(n_words > 0, span_hashes(sums, first[:-1], first[1:]), mix(span_hashes(prefix_hashes(byte_values(data)), offsets[:-1], offsets[1:]) + U(1)))
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])])) if len(own) else own
    return own[new], hashes[new], np.diff(np.append(new, len(own))), n_words, prints


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Registers of every row: the element whose Poisson arrivals, at a rate equal to its weight, reach the register first.

    Two rows agree in a register with the probability Jaccard similarity of their weights. Arrivals come in blocks of about one per register
    and row; an element rests as soon as its clock passes the latest first arrival of its row, so long texts end after a few arrivals per
    element.
    """
    best = np.full(n_rows * registers, np.inf)
    kept = np.zeros(n_rows * registers, dtype=U)
    clock, drawn = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
    sizes = np.bincount(rows, minlength=n_rows)
    active = np.arange(len(rows))
    while len(active):
        block = np.clip(registers // np.maximum(sizes[rows[active]], 1), 1, registers)
        element = np.repeat(active, block)
        number = ranges(drawn[active], block).astype(U)
        seed = mix(hashes[element] + (number + U(1)) * U(0x9E3779B97F4A7C15))
        slot = rows[element] * registers + ((seed & U(0xFFFFFFFF)).astype(np.int64) * registers >> 32)
        gaps = -np.log(((mix(seed) >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / weights[element]
        ends = np.cumsum(block)
        times = _block_sums(gaps, block) + np.repeat(clock[active], block)
        np.minimum.at(best, slot, times)
        won = times == best[slot]
        kept[slot[won]] = hashes[element[won]]
        clock[active] = times[ends - 1]
        drawn[active] += block
        latest = best.reshape(n_rows, registers).max(axis=1)
        active = active[clock[active] < latest[rows[active]]]
    return kept.reshape(n_rows, registers)


def _block_sums(gaps: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Running sums inside blocks; a block's sums do not depend, bit for bit, on the rows around it."""
    if (block == 1).all():
        return gaps
    out, starts = gaps.copy(), np.cumsum(block) - block
    for step in range(1, int(block.max())):
        live = starts[block > step] + step
        out[live] += out[live - 1]
    return out


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sorted weighted sets: sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    keys = np.union1d(a, b)
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, a)], q[np.searchsorted(keys, b)] = x, y
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    p_sum, q_sum = np.concatenate([[0.0], np.cumsum(p)])[upto], q.sum() - np.concatenate([[0.0], np.cumsum(q)])[upto]
    both = (p > 0) & (q > 0)
    return float((1.0 / (p_sum[both] / p[both] + q_sum[both] / q[both])).sum())


def _prints(texts: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """``id, known, print, n_words, bands, registers``: everything the later steps need of a text, computed in one scan."""
    registers = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, "text"):
            own, hashes, counts, n_words, prints = weighted_shingles(*flat(part.column(1)), size)
            kept = prob_minhash(own, hashes, counts.astype(np.float64), part.num_rows, registers)
            parts = kept.reshape(part.num_rows, bands, rows)
            band = np.broadcast_to(np.arange(bands, dtype=U), (part.num_rows, bands)).copy()
            for r in range(rows):
                band = mix(band * U(0x9E3779B97F4A7C15) + parts[:, :, r])
            small = (mix(kept) & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "id": part.column(0), "known": part.column(1).is_valid(), "print": pa.array(prints.view(np.int64)), "n_words": pa.array(n_words, pa.int64()),
                "bands": pa.ListArray.from_arrays(pa.array((np.arange(part.num_rows + 1) * bands).astype(np.int32)), pa.array(band.reshape(-1).view(np.int64))),
                "registers": pa.array([r.tobytes() for r in small], pa.binary())})

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, known boolean, print bigint, n_words bigint, bands array<bigint>, registers binary")


def _likely(registers: int, threshold: float):
    """Arrow function: pairs whose registers do not rule the threshold out (five standard errors below it)."""
    least = threshold - _MARGIN * (threshold * (1 - threshold) / registers) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, registers) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))
    return run


def _faced(registers: int, threshold: float):
    """Arrow function over two blocks of a bucket: the members that have to be verified, each with its likely partners of other labels.

    A pair belongs to the first band it shares, so the buckets of a pair do not repeat it. Lines are counted by members, not by pairs.
    """
    least = threshold - _MARGIN * (threshold * (1 - threshold) / registers) ** 0.5

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (np.frombuffer(b"".join(t.column("registers").to_pylist()), dtype=np.uint8).reshape(-1, registers) for t in (left, right))
        bands_a, bands_b = (t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
        mine, theirs = (np.array(t.column("label").to_pylist(), dtype=object) for t in (left, right))
        ids = right.column("id").to_pylist()
        bucket = left.column("bucket")[0].as_py() if left.num_rows else None
        partners, needed = [], np.zeros(right.num_rows, dtype=bool)
        for i in range(len(a) if len(b) else 0):
            near = np.flatnonzero(((a[i] == b).mean(axis=1) >= least) & (mine[i] != theirs))
            if len(near):
                first = (bands_a[i] == bands_b[near]).argmax(axis=1)
                near = near[bands_a[i][first] == bucket]
            needed[near] = True
            partners.append([ids[j] for j in near])
        asked = np.array([i for i, p in enumerate(partners) if p], dtype=np.int64)
        out = pa.concat_tables([left.take(pa.array(asked)), right.filter(pa.array(needed))]).select(["bucket", "own", "facing", "id", "label"])
        lists_ = [partners[i] for i in asked.tolist()] + [[]] * int(needed.sum())
        return out.append_column("partners", pa.array(lists_, pa.list_(right.schema.field("id").type)))
    return run


def _checked(size: int, threshold: float):
    """Arrow function over the listed members of two blocks: links between different labels, exactly verified; one is enough for two labels."""
    def run(part: pa.Table) -> pa.Table:
        # A member may be listed once from each side; its text is the same.
        own, hashes, counts, _, _ = weighted_shingles(*flat(part.column("text")), size)
        edges = np.searchsorted(own, np.arange(part.num_rows + 1))
        ids, labels = part.column("id").to_pylist(), part.column("label").to_pylist()
        place = {x: i for i, x in enumerate(ids)}
        over: dict = {}

        def top(x):
            while over.get(x, x) != x:
                x = over[x]
            return x

        one, two = [], []
        for i, partners in enumerate(part.column("partners").to_pylist()):
            for other in partners:
                j = place[other]
                p, q = top(labels[i]), top(labels[j])
                if p != q and probability_jaccard(*(v[edges[k]:edges[k + 1]] for k in (i, j) for v in (hashes, counts))) >= threshold:
                    over[p] = q
                    one.append(i)
                    two.append(j)
        return pa.table({"a": part.column("id").take(pa.array(one, pa.int64())), "b": part.column("id").take(pa.array(two, pa.int64()))})
    return run


def _verified(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sides = []
                for i in (2, 3):
                    own, hashes, counts, n_words, _ = weighted_shingles(*flat(part.column(i)), size)
                    edges = np.searchsorted(own, np.arange(part.num_rows + 1))
                    sides.append((hashes, counts, edges))
                (ha, ca, ea), (hb, cb, eb) = sides
                good += [probability_jaccard(ha[ea[i]:ea[i + 1]], ca[ea[i]:ea[i + 1]], hb[eb[i]:eb[i + 1]], cb[eb[i]:eb[i + 1]]) >= threshold for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def near_classes(completions: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS,
                 rounds: int = ROUNDS, block: int = BLOCK, text: str = "text") -> DataFrame:
    """Classes of near copies among completion texts.

    ``completions`` holds ``id`` and ``text``; further columns are ignored. Returns ``id, keeper`` for every row: the lowest id of its class.
    Two texts are linked when the probability Jaccard similarity of their ``shingle``-word shingles, weighted by how often each occurs, is at
    least ``threshold``; classes are the connected components of these links.

    Equal word sequences collapse first. The others get ``rows * bands`` registers by Poisson arrivals with early termination; two texts meet
    when all ``rows`` registers of a band agree (a pair at 0.8 is missed with probability 3e-5 by the defaults), and every link is verified on
    the texts. In each bucket members are compared with one leader at a time for ``rounds`` rounds, first with the text that meets the most
    others; buckets whose members are then still in several classes are compared in blocks of ``block`` members inside a task, only across classes. So no link that could join two classes is left out, and
    a group of thousands of copies costs a few comparisons per member.

    Null texts stay alone; texts without words are copies only of equal texts; texts of fewer than ``shingle`` words are one shingle; of equal
    texts the lowest id leads; ids should be unique; an empty table gives an empty result.
    """
    kind = completions.schema["id"].dataType.simpleString()
    texts = completions.select("id", F.col(text).alias("text"))
    prints = stored(_prints(texts, shingle, rows, bands), "prints")
    alike = ["print", "n_words"]
    firsts = prints.where("known").groupBy(*alike).agg(F.min("id").alias("rep"))
    members = prints.where("known").select("id", *alike).join(firsts, alike).select("id", "rep").unionByName(prints.where("not known").select("id", F.col("id").alias("rep")))
    heads = firsts.where("n_words > 0").select(F.col("rep").alias("id"))
    entries = prints.select("id", "bands").join(heads, "id", "left_semi").select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    entries = stored(entries.join(shared, "bucket"), "buckets")
    # The text that meets the most others leads: in a group of copies of one original that is the original, which links them all at once.
    fame = entries.groupBy("id").agg(F.sum("members").alias("fame"))
    entries = cut_lineage(entries.select("bucket", "id").join(fame, "id"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that are near copies, first by registers, then exactly by their texts."""
        side = lambda frame, name, value: frame.select(F.col("id").alias(name), F.col(value).alias(f"{name}_{value}"))
        signed = pairs.join(side(prints, "a", "registers"), "a").join(side(prints, "b", "registers"), "b").select("a", "b", "a_registers", "b_registers")
        likely = cut_lineage(signed.mapInArrow(_likely(rows * bands, threshold), f"a {kind}, b {kind}"))
        full = likely.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "a_text", "b_text")
        return cut_lineage(full.mapInArrow(_verified(shingle, threshold), f"a {kind}, b {kind}"))

    labels = None
    live = entries.select("bucket", "id", "fame", F.col("id").alias("label"))
    for turn in range(rounds + 1):
        chosen = F.struct(F.xxhash64("label", F.lit(turn)) if turn else F.lit(0), "fame", "label", "id")
        leaders = live.groupBy("bucket").agg(F.max(chosen).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where(F.col("low") != F.col("high"))
        if turn < rounds:
            pairs = live.join(leaders.select("bucket", "lead"), "bucket").where(F.col("label") != F.col("lead.label")).select("id", F.col("lead.id").alias("other"))
            pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        else:
            blocks = F.ceil(F.col("n") / block).cast("int")
            parted = live.join(leaders.select("bucket", blocks.alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            parted = cut_lineage(parted.select("bucket", "id", "label", "own", "blocks").join(prints.select("id", "registers", "bands"), "id"))
            mine = parted.select("bucket", "own", F.explode(F.sequence("own", F.col("blocks") - 1)).alias("facing"), "id", "label", "registers", "bands")
            theirs = parted.toDF(*[f"{c}_" for c in parted.columns]).select(F.col("bucket_").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("own_"))).alias("own"), F.col("own_").alias("facing"),
                                                                            *[F.col(f"{c}_").alias(c) for c in ("id", "label", "registers", "bands")])
            keys = ["bucket", "own", "facing"]
            shape = f"bucket bigint, own int, facing int, id {kind}, label {kind}, partners array<{kind}>"
            listed = cut_lineage(mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(_faced(rows * bands, threshold), shape))
            full = listed.join(texts, "id").select(*keys, "id", "label", "partners", "text")
            pairs = full.groupBy(*keys).applyInArrow(_checked(shingle, threshold), f"a {kind}, b {kind}")
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            break
        links = linked(pairs) if turn < rounds else pairs
        known = labels if labels is not None else links.limit(0).select(F.col("a").alias("id"), F.col("a").alias("label"))
        of = lambda name: known.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))  # noqa: E731,B023
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("id"), F.coalesce("b_label", "b").alias("leader"))
        merged = connected_components(joined)
        moved = known.join(merged.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("component", "label").alias("label"))
        fresh = merged.join(known.select("id"), "id", "left_anti").select("id", F.col("component").alias("label"))
        labels = cut_lineage(moved.unionByName(fresh))
        live = cut_lineage(live.select("bucket", "id", "fame").join(labels, "id", "left").select("bucket", "id", "fame", F.coalesce("label", "id").alias("label")))
    if labels is None:
        return members.select("id", F.col("rep").alias("keeper"))
    return members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", F.coalesce("label", "rep").alias("keeper"))
