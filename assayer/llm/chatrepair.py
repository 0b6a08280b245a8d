"""Repair of chat structure: cheapest edits that turn the messages of a chat into ``(system)? (user assistant)*``.

The edits of a chat form a lattice: a node is a number of messages read and a state of the target structure, an edge keeps, reroles or
deletes the next message or inserts an empty one. A forward heap from the first node and a reverse heap from the accepting nodes meet;
both go on until every crossing of the least cost is known, and the least audit among the cheapest paths is read off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assayer.llm.stored import stored

PART = 4096
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
# States: nothing yet, after system, after user, after assistant. A new or reroled message leads to _NEXT, a kept one to _KEEP.
_NEXT, _BEFORE = (2, 2, 3, 2), ((), (), (0, 1, 3), (2,))
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NEVER = (None,) * 4
_START, _GOALS = {0: 0}, {0: 0, 3: 0}
_LEGAL = ("su", "ua", "au")

_MESSAGES = "array<struct<role string, content string>>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]
_FIELDS = (", ".join(f"{c} bigint" for c in _COUNTS) + ", low bigint, high bigint, head string, tail string, head_turn bigint, tail_turn bigint, n_messages bigint, audit string")


def faults(messages: list[tuple[str, str]], seen: set) -> list[int]:
    """First fault of every message, 0 for none; ``seen`` holds digests of what stands before and grows."""
    found = []
    for role, content in messages:
        key, end = _digest(role, content), content.rstrip(_SPACE)
        found.append(BLANK if not end else DUPLICATE if key in seen else TRUNCATED if end[-1] not in ".!?" else 0)
        seen.add(key)
    return found


def _digest(role: str, content: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{content}".encode(), digest_size=16).digest()


def _edges(rows: list[tuple[str, int]], node: int) -> list[tuple[str, int, int]]:
    """Edits at a node as (letter, next node, cost), letters ascending; ``rows`` are (initial of the role, fault)."""
    at, state = divmod(node, 4)
    insert = ("I", at * 4 + _NEXT[state], INSERT)
    if at == len(rows):
        return [insert]
    initial, fault = rows[at]
    out = [("D", node + 4, DELETE), insert]
    if fault not in (BLANK, DUPLICATE):
        extra, kept = UNFINISHED if fault else 0, _KEEP.get(initial, _NEVER)[state]
        if kept is not None:
            out.append(("K", at * 4 + 4 + kept, extra))
        out.append(("R", at * 4 + 4 + _NEXT[state], REROLE + extra))
    return out


def _reverse_edges(rows: list[tuple[str, int]], node: int) -> list[tuple[int, int]]:
    """(previous node, cost) of every edit that leads to a node."""
    at, state = divmod(node, 4)
    out = [(at * 4 + before, INSERT) for before in _BEFORE[state]]
    if at:
        initial, fault = rows[at - 1]
        out.append((node - 4, DELETE))
        if fault not in (BLANK, DUPLICATE):
            extra, keep = UNFINISHED if fault else 0, _KEEP.get(initial, _NEVER)
            out += [(at * 4 - 4 + q, extra) for q in range(4) if keep[q] == state]
            out += [(at * 4 - 4 + before, REROLE + extra) for before in _BEFORE[state]]
    return out


def exit_costs(rows: list[tuple[str, int]], state: int) -> list[int]:
    """Least cost from a state before the messages to every state after them: the forward heap run to its end."""
    known, heap, last = {}, [(0, state)], len(rows) * 4
    while heap:
        cost, node = heappop(heap)
        if node not in known:
            known[node] = cost
            for _, to, step in _edges(rows, node):
                if to not in known:
                    heappush(heap, (cost + step, to))
    return [known.get(last + q, _FAR) for q in range(4)]


def cheapest(rows: list[tuple[str, int]], sources: dict[int, int], goals: dict[int, int]) -> tuple[int, str, int]:
    """Cost, least audit and last state of the cheapest edits from a state of ``sources`` to one of ``goals``, whose costs are added."""
    last = len(rows) * 4
    ends = {last + q: c for q, c in goals.items() if c < _FAR}
    ahead, behind = {}, {}
    front, back = [(c, q) for q, c in sources.items()], [(c, node) for node, c in ends.items()]
    front.sort(), back.sort()
    best = _FAR
    while front and back and front[0][0] + back[0][0] <= best:
        if front[0] <= back[0]:
            cost, node = heappop(front)
            if node in ahead:
                continue
            ahead[node] = cost
            if node in ends:
                best = min(best, cost + ends[node])
            for _, to, step in _edges(rows, node):
                if to not in ahead:
                    heappush(front, (cost + step, to))
                if to in behind:
                    best = min(best, cost + step + behind[to])
        else:
            cost, node = heappop(back)
            if node in behind:
                continue
            behind[node] = cost
            if node in sources:
                best = min(best, cost + sources[node])
            for to, step in _reverse_edges(rows, node):
                if to not in behind:
                    heappush(back, (cost + step, to))
                if to in ahead:
                    best = min(best, cost + step + ahead[to])
    # Crossings of the least cost, and from them back every settled node on a cheapest path.
    live = [u for u, c in ahead.items() if c + ends.get(u, _FAR) == best or any(c + step + behind.get(to, _FAR) == best for _, to, step in _edges(rows, u))]
    known = set(live)
    while live:
        node = live.pop()
        for before, step in _reverse_edges(rows, node):
            if before in ahead and before not in known and ahead[before] + step == ahead[node]:
                known.add(before)
                live.append(before)
    node = min(q for q in sources if q in known and ahead[q] == sources[q]) if known else min(q for q in sources if sources[q] + behind.get(q, _FAR) == best)
    spent, audit = sources[node], []
    while not (node in ends and spent + ends[node] == best):
        for letter, to, step in _edges(rows, node):
            if spent + step + behind.get(to, _FAR) == best or (to in known and ahead[to] == spent + step):
                audit.append(letter)
                node, spent = to, spent + step
                break
    return spent, "".join(audit), node - last


def apply_audit(messages: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """Messages after the edits of an audit that starts in ``state``."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out.append(("user" if state == 2 else "assistant", ""))
            continue
        role, content = messages[at]
        at += 1
        if letter == "D":
            continue
        state = _KEEP[role[:1]][state] if letter == "K" else _NEXT[state]
        out.append((role if letter == "K" else "user" if state == 2 else "assistant", content))
    return out


def _facts(turns: list, messages: list[tuple[str, str]], found: list[int]) -> dict:
    """Counts of consecutive messages of one chat; the first and last turn and role let the counts of two parts be joined."""
    known, initials = [t for t in turns if t is not None], [role[:1] for role, _ in messages]
    return {"blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(TRUNCATED),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "turns": sum(a != b for a, b in zip([None, *known], known)),
            "low": min(known, default=None), "high": max(known, default=None), "head": messages[0][0][:1] if messages else None,
            "tail": messages[-1][0][:1] if messages else None, "head_turn": known[0] if known else None, "tail_turn": known[-1] if known else None,
            "n_messages": len(messages)}


def _repaired(turns: list, messages: list[tuple[str, str]], seen: set, entry: int = 0, goals: dict[int, int] = _GOALS) -> dict:
    found = faults(messages, seen)
    cost, audit, _ = cheapest(_rows(messages, found), {entry: 0}, goals)
    kept = apply_audit(messages, audit, entry)
    return _facts(turns, messages, found) | {"cost": cost, "audit": audit, "messages": _structs(kept)}


def _rows(messages: list[tuple[str, str]], found: list[int]) -> list[tuple[str, int]]:
    return [(role[:1], fault) for (role, _), fault in zip(messages, found)]


def _structs(messages: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "content": c} for r, c in messages]


def _pairs(messages: list[dict]) -> list[tuple[str, str]]:
    return [(m["role"] or "", m["content"] or "") for m in messages]


def _arrow(kind: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield from batch.slice(start, 512).to_pylist()


def _mapped(df: DataFrame, function, kind: str) -> DataFrame:
    """``function`` over the records of every partition, as they stream by."""
    schema = _arrow(kind, df.sparkSession)
    return df.mapInArrow(lambda batches: _batches(function(_records(batches)), schema), kind)


def repair_messages(messages: DataFrame, part: int = PART) -> DataFrame:
    """Repaired chats in parts: ``id, key, closed``, the counts of the part, ``audit`` and the repaired ``messages`` (role, content).

    ``messages``: ``id, turn, message struct<role, content>``, one message of a chat each, as ``posexplode_outer`` gives them for chat
    records; other columns are ignored. A null message says that the chat exists; it is no message. Null roles and contents count as empty,
    a null id is a chat like any other. Messages go by turn (nulls first), then role and content, so repeated rows stand side by side.

    A blank message holds nothing but white space; a duplicate repeats role and content of an earlier one; a truncated one does not end with
    ``.``, ``!`` or ``?``. Only the first fault of a message counts. Keeping costs 0, reroling to user or assistant 1, deleting 2, inserting
    an empty user or assistant message 5, and a truncated message that stays 5 more; blank and duplicate messages must go. ``audit`` holds
    the initials of the edits (K, R, D, I), the ASCII-least of the cheapest. An empty table gives an empty result.

    Rows are dealt out by ranges of their order, so a chat of any length is spread over tasks. One that fits in ``part`` messages and does
    not cross a range is repaired where it stands (``closed``). The parts of a longer one exchange digests of messages and 4 x 4 costs; the
    costs still to come, folded from its end, are the goals of each part's own search.
    """
    order = ["id", "turn", "message"]
    rows = messages.select("id", F.col("turn").cast("bigint").alias("turn"), F.struct(F.coalesce("message.role", F.lit("")).alias("role"), F.coalesce("message.content", F.lit("")).alias("content"),
                                                                                    F.col("message").isNotNull().alias("there")).alias("message"))
    kind = dict(messages.dtypes)["id"]
    pieces = _mapped(rows.repartitionByRange(*order).sortWithinPartitions(*order), lambda records: _cut(records, part),
                     f"id {kind}, key bigint, closed boolean, {_FIELDS}, messages {_MESSAGES}, turns_open array<bigint>")
    pieces = stored(pieces, "chat-parts")
    result = [c for c in pieces.columns if c != "turns_open"]
    return pieces.where("closed").select(*result).unionByName(_repair_open(pieces.where("not closed"), kind).select(*result))


def _cut(records: Iterator[dict], part: int) -> Iterator[dict]:
    """Consecutive messages of a chat in parts; parts of chats at the edge of the range or of more than one part stay open."""
    base, number, held, first, pieces = TaskContext.get().partitionId() << 32, 0, None, True, 0

    def piece(closed: bool) -> dict:
        nonlocal number
        number += 1
        turns, said = held["turns"], held["messages"]
        row = {"id": held["id"], "key": base + number, "closed": closed}
        if closed:
            return row | _repaired(turns, said, set())
        return row | {"messages": _structs(said), "turns_open": turns}

    for record in records:
        if held is None or record["id"] != held["id"]:
            if held is not None:
                yield piece(closed=not first and not pieces)
                first, pieces = False, 0
            held = {"id": record["id"], "turns": [], "messages": []}
        if not record["message"]["there"]:
            continue
        if len(held["messages"]) == part:
            yield piece(closed=False)
            pieces += 1
            held = {"id": record["id"], "turns": [], "messages": []}
        held["turns"].append(record["turn"])
        held["messages"].append((record["message"]["role"], record["message"]["content"]))
    if held is not None:
        yield piece(closed=False)


def _repair_open(pieces: DataFrame, kind: str) -> DataFrame:
    """Parts of long chats: which messages an earlier part said already, costs to come, entry states, then each part's own repair."""
    said = pieces.select("id", "key", F.explode(F.array_distinct(F.transform("messages", lambda m: F.struct(m["role"], m["content"])))).alias("m"))
    said = said.select("id", "key", F.sha2(F.to_json("m"), 256).alias("digest"), "m")
    first = said.groupBy("id", "digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first")
    again = said.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).where("key > first").groupBy("key").agg(F.collect_list("m").alias("earlier"))
    parts = stored(pieces.select("id", "key", "messages", "turns_open").join(again, "key", "left"), "chat-open")

    def costs(records):
        for r in records:
            said = _pairs(r["messages"])
            rows = _rows(said, faults(said, _seen(r)))
            yield {"id": r["id"], "key": r["key"], "costs": [c for q in range(4) for c in exit_costs(rows, q)]}

    def to_come(records):
        chat, goals = (), None
        for r in records:
            if chat != (r["id"],):
                chat, goals = (r["id"],), [0, _FAR, _FAR, 0]
            yield {"id": r["id"], "key": r["key"], "goals": goals}
            goals = [min(_FAR, min(r["costs"][4 * q + p] + goals[p] for p in range(4))) for q in range(4)]

    def exits(records):
        for r in records:
            said, goals = _pairs(r["messages"]), dict(enumerate(r["goals"]))
            rows = _rows(said, faults(said, _seen(r)))
            yield {"id": r["id"], "key": r["key"], "goals": r["goals"], "exits": [cheapest(rows, {q: 0}, goals)[2] for q in range(4)]}

    def entries(records):
        chat, state = (), 0
        for r in records:
            if chat != (r["id"],):
                chat, state = (r["id"],), 0
            yield {"key": r["key"], "goals": r["goals"], "entry": state}
            state = r["exits"][state]

    def repaired(records):
        for r in records:
            goals = dict(enumerate(r["goals"]))
            yield {"id": r["id"], "key": r["key"], "closed": False} | _repaired(r["turns_open"], _pairs(r["messages"]), _seen(r), r["entry"], goals)

    def in_order(df, *order):
        return df.repartition("id").sortWithinPartitions("id", *order)

    goals = stored(_mapped(in_order(_mapped(parts, costs, f"id {kind}, key bigint, costs array<bigint>"), F.desc("key")), to_come, f"id {kind}, key bigint, goals array<bigint>"), "chat-goals")
    ends = _mapped(parts.join(goals.drop("id"), "key"), exits, f"id {kind}, key bigint, goals array<bigint>, exits array<int>")
    steps = stored(_mapped(in_order(ends, "key"), entries, "key bigint, goals array<bigint>, entry int"), "chat-entries")
    return _mapped(parts.join(steps, "key"), repaired, f"id {kind}, key bigint, closed boolean, {_FIELDS}, messages {_MESSAGES}")


def _seen(record: dict) -> set:
    return {_digest(m["role"] or "", m["content"] or "") for m in record["earlier"] or []}


def repair_report(parts: DataFrame) -> DataFrame:
    """One row per chat from ``repair_messages``: ``id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps`` counts the turns missing between the first and the last; the digest covers the repaired ``role:content`` lines. Chats in
    several parts pass by in order, so that only an audit and one running digest are held; a chat without messages has zeros and an empty audit.
    """
    kind = dict(parts.dtypes)["id"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    whole = parts.where("closed").select("id", gaps.alias("gaps"), *_COUNTS[:5], "audit", F.sha2(lines, 256).alias("repaired_sha256"))

    def joined(records):
        chat = None
        for r in records:
            if chat is None or chat["id"] != r["id"]:
                if chat is not None:
                    yield _closed(chat)
                chat = {"id": r["id"], "audit": [], "hash": hashlib.sha256(), "any": False, "low": None, "high": None, "tail": None, "tail_turn": None} | dict.fromkeys(_COUNTS, 0)
            for name in _COUNTS:
                chat[name] += r[name]
            if r["n_messages"]:
                chat["illegal"] += chat["tail"] is not None and chat["tail"] + r["head"] not in _LEGAL
                chat["tail"] = r["tail"]
            if r["low"] is not None:
                chat["turns"] -= chat["tail_turn"] == r["head_turn"]
                chat["low"] = r["low"] if chat["low"] is None else chat["low"]
                chat["high"], chat["tail_turn"] = r["high"], r["tail_turn"]
            chat["audit"].append(r["audit"])
            for m in r["messages"]:
                chat["hash"].update(f"{chr(10) if chat['any'] else ''}{m['role']}:{m['content']}".encode())
                chat["any"] = True
        if chat is not None:
            yield _closed(chat)

    several = _mapped(parts.where("not closed").repartition("id").sortWithinPartitions("id", "key"), joined,
                      f"id {kind}, gaps bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS[:5]) + ", audit string, repaired_sha256 string")
    return whole.unionByName(several)


def _closed(chat: dict) -> dict:
    gaps = 0 if chat["low"] is None else chat["high"] - chat["low"] + 1 - chat["turns"]
    return {"id": chat["id"], "gaps": gaps, "audit": "".join(chat["audit"]), "repaired_sha256": chat["hash"].hexdigest()} | {c: chat[c] for c in _COUNTS[:5]}


def repair_chats(chats: DataFrame, id: str = "id") -> DataFrame:
    """``id, messages, audit`` of chat records with an identifier and ``messages``, repaired; other columns are left out, null messages are an empty chat."""
    rows = chats.select(F.col(id).alias("id"), F.posexplode_outer("messages").alias("turn", "message"))
    parts = repair_messages(rows)
    several = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "messages", "audit"))).alias("parts"))
    return several.select("id", F.flatten(F.transform("parts", lambda p: p["messages"])).alias("messages"), F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
