"""Evaluation inputs derived from the document table.

There is no puzzle table among the given tables, so prompts, answers and two runs of reasoning texts are computed from
``documents`` with integer arithmetic only. The derivation is plain SQL; the few spellings that differ between Spark
SQL and ANSI engines come from a ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assayer.session import scratch_path, spread

TYPES = ["binary", "cipher", "equation", "gravity", "roman", "unit"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Dialect:
    name: str

    def div(self, a: str, b: str | int) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def item(self, array: str, position: str) -> str:
        return f"try_element_at({array}, cast({position} as int))" if self.name == "spark" else f"list_extract({array}, {position})"

    def split(self, text: str, separator: str) -> str:
        return f"split({text}, '{separator}')" if self.name == "spark" else f"string_split({text}, '{separator}')"

    def words(self, text: str) -> str:
        if self.name == "spark":
            return f"regexp_extract_all(lower({text}), '[a-z]+', 0)"
        return f"regexp_extract_all(lower({text}), '[a-z]+')"

    def joined(self, count: int, variable: str, expression: str, separator: str) -> str:
        """Texts of an expression over 0 .. count - 1, joined; one lambda instead of ``count`` copies of the expression."""
        if self.name == "spark":
            return f"array_join(transform(sequence(0, {count - 1}), {variable} -> {expression}), {separator})"
        return f"array_to_string(list_transform(range({count}), lambda {variable}: {expression}), {separator})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.name == "spark" else f"len({array})"


SPARK = Dialect("spark")
ANSI = Dialect("ansi")

NL = "chr(10)"
BOX = "concat(chr(92), 'boxed', chr(123))"  # code points, since braces are parameter marks in spark.sql


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _lines(*parts: str) -> str:
    joined: list[str] = []
    for part in parts:
        joined += [part, NL]
    return _cat(*joined[:-1])


def _cents(dialect: Dialect, n: str) -> str:
    """Integer hundredths as text such as 12.05."""
    return _cat(f"cast({dialect.div(n, 100)} as string)" if dialect.name == "spark" else f"cast({dialect.div(n, 100)} as varchar)",
                "'.'", f"lpad(cast(({n}) % 100 as {'string' if dialect.name == 'spark' else 'varchar'}), 2, '0')")


def _text(dialect: Dialect, n: str) -> str:
    return f"cast({n} as {'string' if dialect.name == 'spark' else 'varchar'})"


def _bits(n: str) -> str:
    return f"lpad(bin({n}), 8, '0')"


def roman(dialect: Dialect, n: str) -> str:
    """Numeral of an integer below 4000 from four digit tables."""
    places = [
        (",M,MM,MMM", 1000), (",C,CC,CCC,CD,D,DC,DCC,DCCC,CM", 100),
        (",X,XX,XXX,XL,L,LX,LXX,LXXX,XC", 10), (",I,II,III,IV,V,VI,VII,VIII,IX", 1),
    ]
    return _cat(*(dialect.item(dialect.split(f"'{table}'", ","), f"{dialect.div(n, unit)} % 10 + 1")
                  for table, unit in places))


def _byte_output(dialect: Dialect, x: str) -> str:
    rotated1 = f"((({x}) * 2) % 256 + {dialect.div(x, 128)})"
    rotated3 = f"((({x}) * 8) % 256 + {dialect.div(x, 32)})"
    return (f"(case v % 5 when 0 then 255 - ({x}) when 1 then {rotated3} "
            f"when 2 then ({x}) + 178 - 2 * (({x}) & 178) when 3 then ({x}) & {rotated1} "
            f"else (({x}) * ({x}) + v) % 256 end)")


def _equation_output(dialect: Dialect, a: str, b: str) -> str:
    return (f"(case v % 4 when 0 then {_text(dialect, f'({a}) + ({b})')} when 1 then {_text(dialect, f'({a}) - ({b})')} "
            f"when 2 then {_text(dialect, f'({a}) * ({b})')} else {_cat(_text(dialect, a), _text(dialect, b))} end)")


def puzzles_sql(dialect: Dialect, documents: str = "documents") -> str:
    """``row_id, v, type, source, lang, body, prompt, expected, target, shift`` from the document table."""
    d = dialect
    x = "((v * 37 + i * 53 + i * i * 11) % 256)"
    binary_pairs = d.joined(8, "i", _cat(_bits(x), "' -> '", _bits(_byte_output(d, x))), NL)
    binary_target = "((v * 91 + 29) % 256)"
    sign = d.item(d.split("'+,-,*,/'", ","), "v % 4 + 1")

    def hidden(expr: str) -> str:
        return f"(case when v % 5 = 4 then translate({expr}, '0123456789', '@#$%&!?~;<') else {expr} end)"

    def equation_side(i: str | int) -> tuple[str, str]:
        return f"((v * 7 + {i} * 13) % 90 + 10)", f"((v * 11 + {i} * 17) % 90 + 10)"

    left, right = equation_side("i")
    equation_pairs = d.joined(4, "i", _cat(hidden(_cat(_text(d, left), sign, _text(d, right))), "' = '",
                                           hidden(_equation_output(d, left, right))), NL)
    target_a, target_b = equation_side(9)
    g = "(500 + (v * 13) % 1000)"

    def fallen(t: str) -> str:
        return d.div(f"{g} * {t} * {t}", 20000)

    time = "(100 + (v * 17 + i * 37) % 400)"
    target_time = "(120 + (v * 23) % 500)"
    gravity_pairs = d.joined(5, "i", _cat("'t = '", _cents(d, time), "'s, distance = '", _cents(d, fallen(time)), "' m'"), NL)
    slope = "(50 + (v * 7) % 300)"
    length = "(100 + (v * 29 + i * 83) % 5000)"
    target_length = "(150 + (v * 41) % 4000)"
    unit_pairs = d.joined(5, "i", _cat(_cents(d, length), "' m becomes '", _cents(d, d.div(f"{length} * {slope}", 100))), NL)
    number = "(1 + (v * 97) % 3999)"
    shifted = f"substr('{ALPHABET}{ALPHABET}', cast(shift + 1 as int), 26)"

    def plain(first: int, count: int) -> str:
        word = d.item("words", f"(v * 31 + (k + {first}) * 977) % greatest(n_words, 1) + 1")
        return d.joined(count, "k", f"coalesce({word}, 'alice')", "' '")

    examples = [_cat(f"translate({plain(4 * i, 4)}, '{ALPHABET}', {shifted})", "' -> '", plain(4 * i, 4),
                     "case when v % 7 = 3 then ' x' else '' end" if i == 2 else "''") for i in range(3)]
    secret = f"translate({plain(12, 3)}, '{ALPHABET}', {shifted})"

    prompts = {
        "binary": _lines("'A hidden bit manipulation rule maps 8-bit numbers.'", "'Pairs of input -> output:'", binary_pairs,
                         _cat("'Now, determine the output for: '", _bits(binary_target))),
        "cipher": _lines("'A secret encryption is used on text.'", "'Some example lines:'", *examples,
                         _cat("'Now, decrypt the following text: '", "secret")),
        "equation": _lines("'Hidden transformation rules are applied to equations.'", equation_pairs,
                           _cat("'Now, determine the result for: '", hidden(_cat(_text(d, target_a), sign, _text(d, target_b))))),
        "gravity": _lines("'The gravitational constant has been changed.'", gravity_pairs,
                          _cat("'Now, find the falling distance for t = '", _cents(d, target_time), "'s given d = 0.5*g*t^2.'")),
        "roman": _lines("'Numbers are written in a hidden numeral system.'", "'11 -> XI'", "'15 -> XV'",
                        f"case when v % 2 = 0 then {_cat(chr(39) + 'Now, write the number ' + chr(39), _text(d, number), chr(39) + ' in it.' + chr(39))} "
                        f"else {_cat(chr(39) + 'Now, what arabic number is ' + chr(39), roman(d, number), chr(39) + '?' + chr(39))} end"),
        "unit": _lines("'A secret unit conversion is applied to measurements.'", unit_pairs,
                       _cat("'Now, convert the following measurement: '", _cents(d, target_length), "' m'")),
    }
    answers = {
        "binary": _bits(_byte_output(d, binary_target)), "cipher": "plain_target",
        "equation": hidden(_equation_output(d, target_a, target_b)), "gravity": _cents(d, fallen(target_time)),
        "roman": f"case when v % 2 = 0 then {roman(d, number)} else {_text(d, number)} end",
        "unit": _cents(d, d.div(f"{target_length} * {slope}", 100)),
    }
    targets = {
        "binary": _bits(binary_target), "cipher": "secret", "equation": hidden(_cat(_text(d, target_a), sign, _text(d, target_b))),
        "gravity": _cents(d, target_time), "roman": _text(d, number), "unit": _cents(d, target_length),
    }

    def by_type(values: dict[str, str]) -> str:
        return "case type " + " ".join(f"when '{t}' then {values[t]}" for t in TYPES) + " end"

    type_name = "case doc_id % 6 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES)) + " end"
    return f"""
      select row_id, v, type, source, lang, body, shift,
             {by_type(prompts)} as prompt, {by_type(answers)} as expected, {by_type(targets)} as target
      from (select *, case when type = 'cipher' then {secret} end as secret,
                   case when type = 'cipher' then {plain(12, 3)} end as plain_target
            from (select *, {d.size('words')} as n_words
                  from (select doc_id as row_id, {d.div('doc_id', 6)} as v, {type_name} as type, source, lang, text as body,
                               1 + {d.div('doc_id', 6)} % 25 as shift,
                               case when doc_id % 6 = 1 then {d.words('text')} end as words
                        from {documents}) q0) q1) q2"""


# Phrases appended by behaviour number so that every marker family of the style and confidence operators occurs.
_REMARKS = [
    "Therefore it holds. VER: PASS on all. This clearly matches all examples.",
    "I think maybe it could be this. Wait, actually let me verify by checking. VER: FAIL here.",
    "Certainly verified, it must be right. CHECK: correct, holds for every example.",
    "LEN: TABLE: DECRYPT: then VOCAB fill, CHECK: pass. VER: PASS.",
    "Hmm, let me try another approach. Perhaps unclear and ambiguous, no rule found.",
    "The answer is plain: the rule is fixed. ANS: done. VERIFY it: no match, mismatch.",
    "Inconsistent across lines, possibly wrong. Let me reconsider, i was wrong.",
    "HARDSTOP. What if the digits are reversed? i'm not sure.",
]

_WORKINGS = {
    "binary": "PIPELINE scan of the binary rule. bit[0]: NOT of input[0], bit[1]: XOR, bit[2]: AND, bit[3]: OR, bit 4 IDENTITY. "
              "SCAN, CONCAT, ANS. Apply to target and compute the result.",
    "cipher": "This is a substitution cipher with a letter mapping, so decrypt it. TABLE next, DECRYPT then CHECK and ANS.",
    "equation": "The transformation rule uses an operator on each number: add or multiply digits, reverse or swap. PARSE, SCAN, LOCK, APPLY, ANS.",
    "gravity": "SOLVE the gravity step: g = 9.81 from 2*d/t, rate = 4.9, average and verify. APPLY 0.5 and t^2, RATE, ANS 12.34.",
    "roman": "Decompose arabic to roman: tens and ones, 10 = X, DECOMPOSE, CAT: XI, XV, IX, ANS.",
    "unit": "SOLVE the conversion factor: slope = 3.5 / 2.5, RATE, APPLY, ANS.",
}


def traces_sql(dialect: Dialect, documents: str = "documents") -> str:
    """Wide evaluation table: the puzzle columns plus ``a_text, a_box, b_text, b_box``."""
    d = dialect
    columns = []
    for run, behaviour in (("a", "v % 8"), ("b", f"(v + {d.div('v', 8)}) % 8")):
        x = f"({behaviour})"
        answer = (f"case {x} when 3 then '00000000' when 4 then target when 5 then concat(expected, '7') "
                  f"when 7 then '' else expected end")
        remark = f"case {x} " + " ".join(
            f"when {i} then '{text.replace(chr(39), chr(39) * 2)}'" if d.name == "ansi" else f"when {i} then \"{text}\""
            for i, text in enumerate(_REMARKS)) + " end"
        working = "case type " + " ".join(f"when '{t}' then '{w}'" for t, w in _WORKINGS.items()) + " end"
        letter = "((v + 2 * j) % 26)"
        mapping = _cat(f"substr('{ALPHABET}', cast(({letter} + shift) % 26 + 1 as int), 1)", "' -> '",
                       f"substr('{ALPHABET}', cast(({letter} + case when {x} in (3, 5) then 1 else 0 end) % 26 + 1 as int), 1)")
        table = f"case when type = 'cipher' and {x} not in (2, 7) then {_cat(d.joined(12, 'j', mapping, NL), NL)} else '' end"
        echo = f"case when {x} in (0, 1, 2, 4, 6) then {_cat('prompt', NL)} else '' end"
        opening = f"case when {x} in (4, 5) then '' else {_cat(chr(39) + '<think>' + chr(39), NL)} end"
        closing = f"case when {x} in (5, 6) then '' else {_cat(chr(39) + '</think>' + chr(39), NL)} end"
        boxed = f"case when {x} = 7 then '' else {_cat(BOX, run + '_box', 'chr(125)')} end"
        columns.append((f"{answer} as {run}_box",
                        f"{_cat(opening, working, NL, echo, table, remark, NL, 'body', NL, closing, boxed)} as {run}_text"))
    boxes = ", ".join(c[0] for c in columns)
    texts = ", ".join(c[1] for c in columns)
    return f"""
      select row_id, v, type, source, lang, prompt, expected, target, a_text, a_box, b_text, b_box
      from (select *, {texts} from (select *, {boxes} from ({puzzles_sql(d, documents)}) p0) p1) p2"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table, spread over the slots when it is a single small file."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


_STORED: dict[tuple[str, str], str] = {}


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived evaluation table, written once per application and folder so that queries scan stored columns."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "traces")
        spark.sql(traces_sql(SPARK, "{documents}"), documents=documents(spark, sf_dir)).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("row_id", "v", "type", "source", "lang", "prompt", "expected", "target")
