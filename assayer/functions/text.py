"""Column functions for prompts, chats and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\x0b\x0c"
BOX_OPEN = "\\boxed{"

# Ordered routing rules. A rule fires when any of its alternatives holds; an alternative given as a tuple
# needs all of its parts. The scope is "first_line", a number of leading characters, or None for the whole text.
ROUTES = {
    "tracking": ("first_line", "other", [
        ("binary", ["bit manipulation", "8-bit"]), ("roman", ["roman", "numeral"]), ("unit", ["unit", "measurement"]),
        ("gravity", ["gravitational"]), ("cipher", ["encryption", "cipher"]), ("equation", ["transformation rules"])]),
    "solver": (120, "unknown", [
        ("bit_manipulation", ["bit manipulation"]), ("cipher", ["encryption", "decrypt"]), ("gravity", ["gravitational"]),
        ("unit_conversion", ["unit conversion"]), ("numeral_system", ["numeral"]),
        ("equation_transform", ["transformation rules"])]),
    "distill": (200, "unknown", [
        ("bit", ["bit manipulation", "binary string"]), ("cipher", ["encryption", "decrypt", "cipher"]),
        ("gravity", ["gravitational", "falling"]), ("unit", ["unit conversion", ("becomes", "measurement")]),
        ("numeral", ["numeral", "roman"]), ("equation", ["transformation rules", "wonderland"])]),
    "builder": (400, "unknown", [
        ("bit_manipulation", ["bit manipulation"]), ("cipher", ["encryption", "decrypt"]),
        ("gravity", ["gravitational", "falling distance"]), ("unit_conversion", ["unit conversion"]),
        ("numeral_system", ["numeral"]), ("equation_transform", ["transformation rules"])]),
    "sampling": (None, "unknown", [
        ("bit_manipulation", ["bit manipulation", "bit shifts", "8-bit binary"]),
        ("cipher", ["cipher", "substitution", "encrypt"]),
        ("gravity", ["gravitational", "gravity", "free fall", "dropped"]), ("unit_conversion", [("unit", "conver")]),
        ("numeral_system", ["numeral", "roman"]), ("equation_transform", ["equation", "transform"])]),
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def constants(parts: Sequence[str]) -> Column:
    """Constant text array; one folded literal keeps plans and generated code small."""
    return F.split(F.lit("\x01".join(parts)), "\x01")


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """True when one of the parts occurs."""
    return with_value(text, lambda t: F.exists(constants(parts), lambda part: F.contains(t, part)))


def parts_present(text: Column, parts: Sequence[str]) -> Column:
    """Number of distinct parts that occur in the text."""
    return with_value(text, lambda t: F.size(F.filter(constants(parts), lambda part: F.contains(t, part))))


def occurrences_of(text: Column, parts: Sequence[str]) -> Column:
    """Non-overlapping occurrences summed over parts. Containment is a plain byte scan, so only hits are counted."""
    def count(t: Column, part: Column) -> Column:
        removed = F.octet_length(t) - F.octet_length(F.replace(t, part, F.lit("")))
        return F.when(F.contains(t, part), (removed / F.nullif(F.octet_length(part), F.lit(0))).cast("int")).otherwise(0)

    return with_value(text, lambda t: F.aggregate(constants(parts), F.lit(0), lambda total, part: total + count(t, part)))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a part. The containment test is a plain byte scan, so only hits are counted."""
    return F.when(F.contains(text, F.lit(part)), F.regexp_count(text, F.lit(re.escape(part)))).otherwise(0)


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_words(text: Column, patterns: Sequence[str], end: str = "", flags: str = "") -> Column:
    """Matches of ASCII patterns that begin with a letter, where a word begins; the sum of their single counts, by one search.

    That holds where no two of them match at one place and no match holds the beginning of another one.
    """
    first = "".join(sorted({c for p in patterns for c in ([p[0].lower(), p[0].upper()] if flags else [p[0]])}))
    # The letters ahead only spare the test for the border of a word where no pattern begins.
    return count_matches(text, (f"(?{flags})" if flags else "") + rf"(?=[{first}])\b(?:" + "|".join(patterns) + ")" + end)


def plain_runs(pattern: str) -> list[str]:
    """Letters and digits, in lower case, that every match of a pattern holds; groups, classes and whatever may be absent tell nothing."""
    rest = re.sub(r"\\[a-zA-Z][?*+]?|\\.[?*]", " ", pattern)
    rest = re.sub(r"\[[^\]]*\][?*+]?", " ", re.sub(r"\\.", " ", rest))
    while "(" in rest:
        rest = re.sub(r"\([^()]*\)[?*+]?", " ", rest)
    if "|" in rest or "{" in rest:
        return []
    return re.findall(r"[a-z0-9]+", re.sub(r".[?*]", " ", rest).lower())


def guarded(lowered: Column, pattern: str, search: Column, absent: Column) -> Column:
    """A search for an ASCII pattern in a text, made only if the text in lower case holds what every match holds. Finding letters is much cheaper."""
    holds = F.lit(True)
    for run in plain_runs(pattern):
        holds = holds & F.contains(lowered, F.lit(run))
    return F.when(lowered.isNull() | holds, search).otherwise(absent)


def route_type(prompt: Column, rules: str = "tracking") -> Column:
    scope, default, ordered = ROUTES[rules]
    if scope == "first_line":
        area = F.split_part(prompt, F.lit("\n"), F.lit(1))
    elif scope is None:
        area = prompt
    else:
        area = F.substring(prompt, 1, scope)
    area = F.lower(area)
    routed = None
    for label, alternatives in ordered:
        hit = F.lit(False)
        for alternative in alternatives:
            needed = alternative if isinstance(alternative, tuple) else (alternative,)
            every = F.lit(True)
            for part in needed:
                every = every & F.contains(area, F.lit(part))
            hit = hit | every
        routed = F.when(hit, label) if routed is None else routed.when(hit, label)
    return routed.otherwise(default)


def ensure_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix.strip())), text).otherwise(F.concat(text, F.lit(suffix)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def make_chat(user: Column, assistant: Column, **meta: Column) -> list[Column]:
    """``messages`` and, when tags are given, ``_meta``."""
    columns = [F.array(message("user", user), message("assistant", assistant)).alias("messages")]
    if meta:
        columns.append(F.struct(*[value.alias(name) for name, value in meta.items()]).alias("_meta"))
    return columns


def render_chat(messages: Column) -> Column:
    """Turn-delimited text of an array of role and content."""
    # Fixed value: turn delimiters.
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, turn), "")


def before_last(text: Column, mark: str) -> tuple[Column, Column]:
    """Zero-based position of the last mark (-1 when absent) and the text before it."""
    tail = F.substring_index(text, mark, -1)
    position = F.when(F.contains(text, F.lit(mark)), F.char_length(text) - F.char_length(tail) - len(mark)).otherwise(-1)
    return position, F.substring(text, F.lit(1), F.greatest(position, F.lit(0)))


def wrap_think(text: Column, mark: str = BOX_OPEN) -> Column:
    """Put everything before the last boxed answer inside think tags unless tags exist or the box opens the text."""
    position, head = before_last(text, mark)
    wrapped = F.concat(F.lit("<think>\n"), strip(head), F.lit("\n</think>\n\n"), F.substring(text, position + 1, F.char_length(text)))
    return F.when(~F.contains(text, F.lit("<think>")) & (position > 0), wrapped).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Drop tool spans, keep the last assistant part, remove the remaining tags."""
    # Tag patterns.
    tools = r"(?s)<\|tool_call\|>.*?<\|tool_response\|>.*?(?=<\|assistant\|>|<\|start\|>|$)"
    without = F.regexp_replace(text, tools, "")
    last = F.substring_index(without, "<|assistant|>", -1)
    return strip(F.regexp_replace(last, r"<\|[^|]*\|>", ""))


def think_block(text: Column) -> Column:
    opened, closed = F.instr(text, "<think>"), F.instr(text, "</think>")
    start = opened + 7
    rest = F.substring(text, start, F.char_length(text))
    boxed = F.instr(rest, "\\boxed")
    return (F.when(text.isNull(), "")
            .when((opened > 0) & (closed >= start), F.substring(text, start, closed - start))
            .when((opened > 0) & (boxed > 0), F.substring(rest, F.lit(1), boxed - 1))
            .when(opened > 0, "")
            .when(closed > 0, F.substring(text, F.lit(1), closed - 1))
            .otherwise(""))


def boxed_last(text: Column) -> Column:
    return F.coalesce(strip(last_match(text, r"\\boxed\{([^}]*)\}")), F.lit(""))


def boxed_balanced(text: Column) -> Column:
    """Last complete boxed span with nested braces; null when there is none.

    The text is cut into box openers, braces and stretches between them; a fold carries positions only, so the cost is
    linear in the number of braces.
    """
    state = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"),
                     F.lit(0).alias("first"), F.lit(-1).alias("length"))

    def step(s: Column, token: Column) -> Column:
        size = F.char_length(token)
        inside = s["start"] > 0
        opener, left, right = token == BOX_OPEN, token == "{", token == "}"
        closes = inside & right & (s["depth"] == 0)
        return F.struct(
            (s["at"] + size).alias("at"),
            F.when(inside & (opener | left), s["depth"] + 1).when(inside & right & (s["depth"] > 0), s["depth"] - 1)
            .when(closes | (~inside & opener), F.lit(0)).otherwise(s["depth"]).alias("depth"),
            F.when(closes, F.lit(0)).when(~inside & opener, s["at"] + size).otherwise(s["start"]).alias("start"),
            F.when(closes, s["start"]).otherwise(s["first"]).alias("first"),
            F.when(closes, s["at"] - s["start"]).otherwise(s["length"]).alias("length"))

    tokens = F.regexp_extract_all(text, F.lit(r"\\boxed\{|[{}]|\\|[^\\{}]+"), F.lit(0))
    last = F.aggregate(tokens, state, step)
    found = F.when(F.contains(text, F.lit(BOX_OPEN)), last)
    return F.when(found["length"] >= 0, strip(F.substring(text, found["first"], found["length"])))


def final_answer(text: Column) -> Column:
    """Boxed answer, else a stated final answer, else the last number, else the last line."""
    boxes = F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]*)(?:\}|$)"), F.lit(1))
    filled = F.filter(F.transform(boxes, strip), lambda b: b != "")
    # Answer phrases in their order of preference.
    phrases = [r"(?i)The final answer is:\s*([^\n]+)", r"(?i)Final answer is:\s*([^\n]+)",
               r"(?i)Final answer\s*[:：]\s*([^\n]+)", r"(?i)final answer\s*[:：]\s*([^\n]+)"]
    stated = [strip(last_match(text, phrase)) for phrase in phrases]
    number = last_match(text, r"-?[0-9]+(?:\.[0-9]+)?", 0)
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda line: line != "")
    return (F.when(text.isNull(), "NOT_FOUND")
            .when(F.size(boxes) > 0, F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit("")))
            .otherwise(F.coalesce(*stated, number, F.try_element_at(lines, F.lit(-1)), F.lit("NOT_FOUND"))))


def answer_placement(text: Column) -> Column:
    """Whether the boxed answer follows the closed think block, sits only inside, or is absent."""
    after = F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)).otherwise("")
    return (F.when(F.contains(after, F.lit(BOX_OPEN)), "after_think")
            .when(F.contains(text, F.lit(BOX_OPEN)), "inside_only").otherwise("absent"))


def words(text: Column) -> Column:
    """Whitespace-separated words without empty parts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
