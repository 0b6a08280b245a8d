"""Chat repair against a plain table of all edits, on chats of the project's own shape."""

import hashlib
import random

import pytest

from assayer.llm import chatrepair
from registry.text import long_eval
from tests.conftest import SMALL

MESSAGE = "id string, turn bigint, message struct<role string, content string>, key string, closed int, audit string, cost string"


def brute(messages):
    """Cheapest edits from every message and state on, filled from the end; the least audit among the cheapest."""
    seen, fault = set(), []
    for role, content in messages:
        bare = content.strip(" \t\n\x0b\x0c\r")
        fault.append("b" if not bare else "d" if (role, content) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, content))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    keep = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, ""), "s": (10**9, ""), "u": (10**9, "")}
    for at in range(len(messages), -1, -1):
        if at < len(messages):
            new, first, extra = {}, messages[at][0][:1], 5 if fault[at] == "t" else 0
            for q, (c, a) in best.items():
                options = [(c + 2, "D" + a)]
                if fault[at] not in ("b", "d"):
                    if first and first in keep[q]:
                        options.append((best[first][0] + extra, "K" + best[first][1]))
                    options.append((best[after[q]][0] + 1 + extra, "R" + best[after[q]][1]))
                new[q] = min(options)
            best = new
        for _ in range(3):
            best = {q: min(best[q], (best[after[q]][0] + 5, "I" + best[after[q]][1])) for q in best}
    cost, audit = best[""]
    out, at, state = [], 0, ""
    for letter in audit:
        role, content = ("", "") if letter == "I" else messages[at]
        at += letter != "I"
        if letter != "D":
            state = role[:1] if letter == "K" else after[state]
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state], content))
    said = "\n".join(f"{r}:{c}" for r, c in out)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    return (fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), out


def random_chats(rng, chats, longest):
    texts = ["Is it 5?", "It is 5.", "Yes!", "cut off", "  ", "", "a.\n", "La réponse est 7.", "b \x0b"]
    return {f"c{k}": [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(texts)) for _ in range(rng.randint(0, longest))] for k in range(chats)}


def report(spark, rows, part=chatrepair.PART):
    frame = spark.createDataFrame([(i, t, m, "x", 1, "a", "c") for i, t, m in rows], MESSAGE)
    parts = chatrepair.repair_messages(frame, part)
    return parts, {r.id: r for r in chatrepair.repair_report(parts).collect()}


@pytest.mark.parametrize("part", [2, 3, 4096])
def test_against_all_edits(spark, part):
    chats = random_chats(random.Random(part), 120, 14)
    rows = [(k, t, m) for k, said in chats.items() for t, m in enumerate(said)] + [(k, None, None) for k, said in chats.items() if not said]
    _, found = report(spark, rows, part)
    assert set(found) == set(chats)
    for k, said in chats.items():
        r = found[k]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute(said)[0], said
        assert r.gaps == 0


def test_one_long_chat_is_spread(spark):
    rng = random.Random(5)
    said = [(rng.choice(["user", "assistant"]), f"Message {rng.randint(0, 3000)}" + rng.choice([".", "?", ""])) for _ in range(5000)]
    parts, found = report(spark, [("long", t, m) for t, m in enumerate(said)] + [("short", 0, ("user", "Why?"))], 64)
    assert parts.where("id = 'long'").count() > 70
    r = found["long"]
    assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute(said)[0]
    assert found["short"].audit == brute([("user", "Why?")])[0][5]


def test_nulls_ties_and_gaps(spark):
    rows = [(None, 4, ("user", "A.")), (None, 9, ("assistant", "B.")), (None, 9, ("assistant", "B.")), ("n", None, ("assistant", "Z.")), ("n", None, ("user", None)), ("n", None, (None, "Q.")),
            ("t", 3, ("user", "b?")), ("t", 3, ("user", "a?")), ("t", 3, ("assistant", "c.")), ("empty", None, None)]
    _, found = report(spark, rows)
    # Nulls first: "" before "assistant" before "user"; a null content is blank.
    want = {None: [("user", "A."), ("assistant", "B."), ("assistant", "B.")], "n": [("", "Q."), ("assistant", "Z."), ("user", "")], "t": [("assistant", "c."), ("user", "a?"), ("user", "b?")], "empty": []}
    for k, said in want.items():
        r = found[k]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute(said)[0]
    assert {k: r.gaps for k, r in found.items()} == {None: 4, "n": 0, "t": 0, "empty": 0}
    assert found["empty"].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    parts, found = report(spark, [])
    assert found == {} and parts.count() == 0


def test_equal_costs_give_the_least_audit():
    for said in ([("user", "a."), ("user", "b.")], [("assistant", "a.")], [("system", "s.")], [("user", "x"), ("assistant", "y")], [("user", "q?")] * 4):
        found = chatrepair.faults(said, set())
        cost, audit, _ = chatrepair.cheapest([(r[:1], f) for (r, _), f in zip(said, found)], {0: 0}, {0: 0, 3: 0})
        assert (cost, audit) == brute(said)[0][4:6]


def test_chat_records(spark):
    """Chats as ``read_chats`` gives them: whole chats keep their messages, a broken one gets its roles back."""
    from assayer.sources.tables import CHAT_SCHEMA

    rows = [([("system", "You solve puzzles."), ("user", "What is x?"), ("assistant", "It is \\boxed{4}.")], None), ([("user", "Why?"), ("user", "Because.")], None), ([], None), (None, None)]
    chats = spark.createDataFrame(rows, CHAT_SCHEMA).selectExpr("concat('c', coalesce(size(messages), -1), coalesce(get(messages, 0).role, '')) as id", "*")
    found = {r.id: ([tuple(m) for m in r.messages], r.audit) for r in chatrepair.repair_chats(chats).collect()}
    assert found["c3system"] == (rows[0][0], "KKK") and found["c2user"] == ([("user", "Why?"), ("assistant", "Because.")], "KR")
    assert found["c0"] == ([], "") and len(found) == 4


def test_on_derived_chats(spark):
    """The project's own chats of the small tables: every repaired chat has the target structure."""
    traces = long_eval(spark, SMALL).where("text <> ''").limit(40).selectExpr("concat(row_id, ':', run) as id", "array(struct('user' as role, 'Solve it?' as content), struct('user' as role, text as content)) as messages")
    found = chatrepair.repair_chats(traces).collect()
    assert found and all([m.role for m in r.messages] in ([], ["user", "assistant"]) for r in found)
