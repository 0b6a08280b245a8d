import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from assayer.llm import packing
from assayer.llm.queries import tokenizer_file
from tests.llm.common import frame, sentence

PATH = tokenizer_file("word_bpe_49k.json")


def rows():
    rng = random.Random(8)
    made = [(f"t{i:03}", sentence(rng, rng.randint(0, 300))) for i in range(60)] + [("null", None), ("empty", ""), ("long", sentence(rng, 3000)), ("special", "a,<|endoftext|> it's \tÉté— x"), ("same1", "a b"), ("same2", "a b")]
    return made


def test_pieces_hold_every_token_once(spark):
    chats = frame(spark, rows())
    plan = packing.pack(chats, PATH, length=256)
    found, tokenizer = plan.collect(), Tokenizer.from_file(PATH)
    whole = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in rows()}
    for r in found:
        ids = whole[r.id][r.start:r.start + r.length]
        assert len(ids) == r.length and r.start == r.piece * 256 and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert {k: sum(r.length for r in found if r.id == k) for k in whole} == {k: len(v) for k, v in whole.items()}
    for own in {r.sequence_id for r in found}:
        placed = sorted((r.offset, r.length) for r in found if r.sequence_id == own)
        assert [p[0] for p in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))] and sum(n for _, n in placed) <= 256
    least = -(-sum(map(len, whole.values())) // 256)
    assert len({r.sequence_id for r in found}) <= least + 1
    built = {r.sequence_id: r.ids for r in packing.sequences(chats, plan, PATH, length=256).collect()}
    assert sorted(sum(built.values(), [])) == sorted(sum(whole.values(), []))
    r = max(found, key=lambda r: r.offset)
    assert built[r.sequence_id][r.offset:r.offset + r.length] == whole[r.id][r.start:r.start + r.length]


def test_ranks_are_split_without_gaps(spark):
    made = [(f"r{i}", "a b c") for i in range(300)]
    found = packing.pack(frame(spark, made), PATH, length=16, ranked=10).collect()
    assert len({r.id for r in found}) == 300 and len({(r.sequence_id, r.offset) for r in found}) == 300
    assert len({r.sequence_id for r in found}) == 75


def test_fullest_is_the_best_subset():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        capacity = rng.randint(1, 60)
        sums = {0}
        for size, n in counts.items():
            sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= capacity}
        taken = packing.fullest(dict(counts), capacity)
        assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= counts[k] for k, n in taken.items())


def test_bins_use_up_the_histogram():
    rng = random.Random(10)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    left = dict(histogram)
    for taken, times in packing.minimum_bin_slack(histogram, 100):
        assert sum(k * n for k, n in taken.items()) <= 100
        for k, n in taken.items():
            left[k] -= n * times
    assert not any(left.values())


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []
