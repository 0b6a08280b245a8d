"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.arrays import as_text, held_in_worker, ranges, slices

ROWS, CHARS, LANE = 40, 60_000, 400
_COMMON = 254
_built: dict = {}


class Automaton(NamedTuple):
    """Transitions of an automaton: a column for each common symbol and an empty last one for unseen letters; the others as sorted
    ``state * span + symbol`` keys with their targets."""

    dense: np.ndarray
    span: int
    keys: np.ndarray
    targets: np.ndarray


def _transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions symbol -> state of every state of the automaton of all substrings. State 0 is the empty string."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        current = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = current
            at = link[at]
        if at >= 0:
            target = steps[at][symbol]
            if length[target] == length[at] + 1:
                link[current] = target
            else:
                clone = len(steps)
                steps.append(dict(steps[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and steps[at].get(symbol) == target:
                    steps[at][symbol] = clone
                    at = link[at]
                link[target] = link[current] = clone
        last = current
    return steps


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Dense transitions (state, symbol) of the automaton of all substrings; -1 where none continues. State 0 is the empty string."""
    return split_automaton(symbols, size, size).dense


def split_automaton(symbols: list[int], width: int, span: int) -> Automaton:
    """Automaton of all substrings with ``width`` dense columns; symbols from ``width`` to ``span`` are kept as keys."""
    steps = _transitions(symbols)
    table = np.full((len(steps), width), -1, dtype=np.int32)
    keys, targets = [], []
    for state, out in enumerate(steps):
        for symbol, target in out.items():
            if symbol < width:
                table[state, symbol] = target
            else:
                keys.append(state * span + symbol)
                targets.append(target)
    order = np.argsort(np.array(keys, dtype=np.int64))
    return Automaton(table, span, np.array(keys, dtype=np.int64)[order], np.array(targets, dtype=np.int32)[order])


def _followed(table: Automaton, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Next states by keyed symbols, -1 where none continues."""
    if not len(table.keys):
        return np.full(len(symbols), -1, dtype=np.int32)
    keys = states.astype(np.int64) * table.span + symbols
    at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
    return np.where(table.keys[at] == keys, table.targets[at], np.int32(-1))


def _is_letter() -> np.ndarray:
    if "letters" not in _built:
        _built["letters"] = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)
    return _built["letters"]


def _characters(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lowered code points of all texts, with 0 for every run of other characters than letters, and the kept number per text."""
    lowered = pc.utf8_lower(as_text(texts))
    counts = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = (lowered.buffers()[1][8 * (lowered.offset + i):8 * (lowered.offset + i) + 8].to_pybytes() for i in (0, len(lowered)))
    raw = lowered.buffers()[2]
    joined = raw[int.from_bytes(start, "little"):int.from_bytes(end, "little")].to_pybytes() if raw is not None else b""
    points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.int32)
    points = np.where(_is_letter()[points], points, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    kept = np.ones(len(points), dtype=bool)
    if len(points):
        same_row = np.concatenate([[False], rows[1:] == rows[:-1]])
        before = np.concatenate([[0], points[:-1]])
        kept = (points > 0) | (same_row & (before > 0))
    return points[kept], np.bincount(rows[kept], minlength=len(counts))


def _model(samples: dict[str, str]):
    """Symbol table and one automaton per language, built once per worker, which holds the latest model only."""
    def build():
        points = {lang: _characters(pa.array([text]))[0] for lang, text in samples.items()}
        # Every letter of the samples has a symbol; the most used have dense columns, then comes the one of unseen letters, then the others.
        seen, uses = np.unique(np.concatenate([*points.values(), [0]]), return_counts=True)
        seen = seen[np.argsort(-uses, kind="stable")]
        common = min(len(seen), _COMMON)
        symbol = np.full(0x110000, common, dtype=np.int32)
        symbol[seen] = np.arange(len(seen)) + (np.arange(len(seen)) >= common)
        return symbol, common + 1, {lang: (split_automaton(symbol[p].tolist(), common + 1, len(seen) + 1), len(p)) for lang, p in points.items()}

    return held_in_worker(("language", tuple(sorted(samples.items()))), build)


def _stepper(table: Automaton, width: int):
    """Function from states and symbols to the next states and the number of phrases that end before each symbol or with it."""
    flat, root = table.dense.reshape(-1), table.dense[0]

    def step(own: np.ndarray, symbol: np.ndarray, keyed: bool) -> tuple[np.ndarray, np.ndarray]:
        near = np.minimum(symbol, width - 1) if keyed else symbol
        following = flat[own.astype(np.int64) * width + near]
        if keyed:
            rare = np.flatnonzero(symbol >= width)
            following[rare] = _followed(table, own[rare], symbol[rare])
        failed = np.flatnonzero(following < 0)
        again = root[near[failed]]
        if keyed:
            rare = np.flatnonzero(symbol[failed] >= width)
            again[rare] = _followed(table, np.zeros(len(rare), dtype=np.int64), symbol[failed[rare]])
        ended = np.zeros(len(symbol), dtype=np.int32)
        ended[failed] = (own[failed] > 0).astype(np.int32) + (again < 0)
        following[failed] = np.maximum(again, 0)
        return following, ended
    return step


def phrase_counts(symbols: np.ndarray, counts: np.ndarray, tables: list[np.ndarray | Automaton], width: int, lane: int = LANE) -> np.ndarray:
    """Phrases of every text against every automaton: (texts, automata). Symbol ``width - 1`` is an unseen letter, those above have keys.

    A phrase is the longest match from its start. All texts are parsed side by side, a character a step, in lanes of ``lane`` characters. A
    lane first starts anew; then it is entered in the state in which the lane before it was left and parsed again until both parses are in
    the same state, from where on they agree. So the lanes are the unbroken parse of the text.
    """
    per_row = -(-counts // lane)
    rows = np.repeat(np.arange(len(counts)), per_row)
    first = np.repeat(np.cumsum(counts) - counts, per_row) + ranges(np.zeros(len(counts), dtype=np.int64), per_row) * lane
    size = np.minimum(lane, np.repeat(np.cumsum(counts), per_row) - first)
    found = np.zeros((len(counts), len(tables)), dtype=np.int64)
    if not len(rows):
        return found
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    follows = np.concatenate([[False], rows[1:] == rows[:-1]])
    before = np.where(follows, np.concatenate([[0], place[:-1]]), -1)[order]
    last = np.concatenate([~follows[1:], [True]])[order]
    rows, first, size = rows[order], first[order], size[order]
    grid = np.zeros((int(size[0]), len(rows)), dtype=np.int32)
    lanes = np.repeat(np.arange(len(rows)), size)
    offset = ranges(np.zeros(len(rows), dtype=np.int64), size)
    grid[offset, lanes] = symbols[first[lanes] + offset]
    live = np.searchsorted(-size, -np.arange(len(grid)), "left")  # lanes longer than the step
    keyed = (grid >= width).any(axis=1)
    states, ended = np.zeros_like(grid), np.zeros_like(grid)
    at_end = (size - 1, np.arange(len(rows)))
    for k, table in enumerate(tables):
        step = _stepper(Automaton(table, width, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)) if isinstance(table, np.ndarray) else table, width)
        state = np.zeros(len(rows), dtype=np.int32)
        for t in range(len(grid)):
            n = live[t]
            state[:n], ended[t, :n] = step(state[:n], grid[t, :n], keyed[t])
            states[t, :n] = state[:n]
        entered = np.zeros(len(rows), dtype=np.int32)
        while True:
            left = np.where(before >= 0, states[at_end][before], 0)
            again = np.flatnonzero(left != entered)
            if not len(again):
                break
            entered[again] = left[again]
            state = left[again]
            for t in range(len(grid)):
                inside = size[again] > t
                again, state = again[inside], state[inside]
                state, done = step(state, grid[t, again], keyed[t])
                met = state == states[t, again]
                states[t, again], ended[t, again] = state, done
                again, state = again[~met], state[~met]
                if not len(again):
                    break
        made = np.where(np.arange(len(grid))[:, None] < size, ended, 0).sum(axis=0, dtype=np.int64) + (last & (states[at_end] > 0))
        found[:, k] = np.bincount(rows, weights=made, minlength=len(counts)).astype(np.int64)
    return found


def language_samples(labelled: DataFrame, rows: int = ROWS, chars: int = CHARS, text: str = "prompt", lang: str = "lang") -> dict[str, str]:
    """Bounded training text per language: at most ``rows`` whole texts, chosen by hash among those of ordinary length, and ``chars`` characters.

    A text counts once however often it stands, and only if it has a letter.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.regexp_like(F.col(text), F.lit(r"\p{L}")))
    known = known.select(F.col(lang).alias("lang"), F.length(text).alias("size"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    # Copies combine and ranks are given on sizes and hashes alone; the few chosen ones then fetch their texts.
    # Texts over a tenth of the bound come last, the shortest of them first.
    alike = ["lang", "size", "hash"]
    order = [F.greatest("size", F.lit(chars // 10)), "hash", "size"]
    chosen = known.select(*alike).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= rows)
    chosen = known.join(F.broadcast(chosen), alike).groupBy("lang", "nth").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    samples: dict[str, str] = {}
    for row in chosen.orderBy("lang", "nth").collect():
        held = samples.get(row.lang, "")
        if len(held) < chars:
            samples[row.lang] = f"{held} {row.text}"[:chars]
    return {k: v for k, v in sorted(samples.items()) if any(c.isalpha() for c in v)}


def identify_language(puzzles: DataFrame, samples: dict[str, str], text: str = "prompt", lane: int = LANE) -> DataFrame:
    """Language of every prompt by cross-parsing.

    ``puzzles`` holds ``id`` and the ``text`` column; further columns are ignored. ``samples`` is labelled text per language (see
    ``language_samples``). Returns ``id, lang_pred, score, phrases``: a text is cut into the longest phrases that occur in a language's
    sample, and the language with the fewest phrases wins after normalising by the sample's size (phrases times the log of the sample
    length, per character). ``score`` is the winner's share of the inverse normalised phrases, between 0 and 1; ``phrases`` the winner's
    number. Ties go to the first language in alphabetical order.

    Null texts, texts without letters and an empty ``samples`` give ``und`` with score 0; texts of any length are parsed to their end without a
    break (``lane`` only sets how many characters of a text are parsed side by side); repeated rows are answered one by one; an empty table gives an empty result.
    """
    held = puzzles.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(held.value)
        symbol, width, automata = _model(held.value) if names else (None, 0, {})
        weight = np.array([np.log2(max(automata[n][1], 2)) for n in names])
        for part in slices(batches, "text"):
            points, counts = _characters(part.column(1))
            letters = np.bincount(np.repeat(np.arange(len(counts)), counts)[points > 0], minlength=len(counts))
            if names:
                found = phrase_counts(symbol[points], counts, [automata[n][0] for n in names], width, lane)
                norm = np.maximum(found, 1) * weight / np.maximum(counts, 1)[:, None]
                best = norm.argmin(axis=1)
                share = (1 / norm[np.arange(len(best)), best]) / (1 / norm).sum(axis=1)
                phrases = found[np.arange(len(best)), best]
            else:
                best, share, phrases = (np.zeros(len(counts), dtype=np.int64) for _ in range(3))
            sure = (letters > 0) & bool(names)
            yield pa.RecordBatch.from_pydict({
                "id": part.column(0), "lang_pred": pa.array([names[b] if s else "und" for b, s in zip(best, sure)], pa.string()),
                "score": pa.array(np.where(sure, share, 0.0), pa.float64()), "phrases": pa.array(np.where(sure, phrases, 0), pa.int64())})

    shape = f"id {puzzles.schema['id'].dataType.simpleString()}, lang_pred string, score double, phrases bigint"
    return puzzles.select("id", F.col(text).alias("text")).mapInArrow(run, shape)
