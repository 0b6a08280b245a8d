"""Splittable readers against readers of whole files, with cuts at every few bytes."""

import csv
import io
import json
import random

import pytest

from assayer.sources import splits, tables as T

SIZES = ["37", "150", "134217728"]


@pytest.fixture(params=SIZES)
def cuts(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield int(request.param)
    for n, v in before.items():
        spark.conf.set(n, v)


def puzzle_rows(rng, n):
    texts = ["one line", "two\nlines", "a \"quoted\" word", "\n\nblank lines\n", "x,y,z", "CR\r\nLF inside", "é 日本 \"\"", "tail \"", "\"", "}{][", "plain", " \n "]
    return [(f"{i:08d}", rng.choice(texts) + rng.choice(texts), rng.choice(["1", "0101", "XIV", "a,b", "\"q\""])) for i in range(n)]


def csv_text(rows, line_end, quoting):
    out = io.StringIO()
    writer = csv.writer(out, quoting=quoting, lineterminator=line_end)
    writer.writerow(["id", "prompt", "answer"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_puzzles_equal_at_any_cut(spark, cuts, line_end, tmp_path):
    rng = random.Random(cuts)
    files = {"a.csv": puzzle_rows(rng, 24), "b.csv": puzzle_rows(rng, 3), "c.csv": [], "d.csv": [("00000001", "long " * 60 + "\n" + "\"more\" " * 20, "7")]}
    for name, rows in files.items():
        (tmp_path / name).write_bytes(csv_text(rows, line_end, csv.QUOTE_ALL if name == "a.csv" else csv.QUOTE_MINIMAL).encode())
    got = sorted((r.id, r.prompt, r.answer) for r in T.read_puzzles(spark, str(tmp_path)).collect())
    assert got == sorted(r for rows in files.values() for r in rows)
    whole = spark.read.schema("id string, prompt string, answer string").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    # The reader of whole files writes the line ends of a file that ends its lines with CRLF anew, also inside quotes.
    plain = [tuple(v.replace("\r\n", "\n") for v in r) for r in got]
    assert sorted(plain) == sorted(tuple(v.replace("\r\n", "\n") for v in (r.id, r.prompt, r.answer)) for r in whole.collect())
    if cuts < 100:
        assert splits._pieces(spark, str(tmp_path), "\n").select("start").distinct().count() > 10


def test_empty_cells_and_missing_last_line_end(spark, cuts, tmp_path):
    (tmp_path / "p.csv").write_text('id,prompt,answer\n1,,x\n2,"",y\n\n3,"a\nb",\n4,"c ""d"" e","z"')
    got = sorted((r.id, r.prompt, r.answer) for r in T.read_puzzles(spark, str(tmp_path)).collect())
    whole = spark.read.schema("id string, prompt string, answer string").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    assert got == sorted(tuple(r) for r in whole.collect()) and got[2:] == [("3", "a\nb", None), ("4", 'c "d" e', "z")]


def dump_rows(rng, n):
    texts = ["plain", "brace } in text", "{ open", "quote \" and \\ slash", "]} end", "line\nend", "é 日本", "\"rows\": [", "\\\\", ""]
    return [{"type": rng.choice(["cipher", "gravity"]), "expected": str(i), "prompt": rng.choice(texts) + rng.choice(texts), "a_text": rng.choice(texts), "nested": {"deep": [{"x": rng.choice(texts)}]}} for i in range(n)]


META = {"timestamp": "2024", "adapters": [{"name": "a", "path": "{x}"}, {"name": "b } ]", "path": "p"}], "sampling": {"t": 1, "stop": ["}", "]"]}, "grid": [[{"k": 1}], []]}


@pytest.mark.parametrize("indent", [None, 2])
def test_dumps_equal_at_any_cut(spark, cuts, indent, tmp_path):
    rng = random.Random(cuts + 1)
    wrapped, bare = dump_rows(rng, 8), dump_rows(rng, 8)
    other = [{"expected": "never", "prompt": "not a row"}]
    (tmp_path / "w.json").write_text(json.dumps({"meta": META, "before": other, "rows": wrapped, "after": other}, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(bare, indent=indent, ensure_ascii=False))
    (tmp_path / "e.json").write_text(json.dumps({"meta": META, "rows": []}, indent=indent))
    (tmp_path / "f.json").write_text("[]")
    got = sorted((r.expected, r.type, r.prompt, r.a_text, r.nested.deep[0].x) for r in T.read_dump(spark, str(tmp_path)).collect())
    assert got == sorted((r["expected"], r["type"], r["prompt"], r["a_text"], r["nested"]["deep"][0]["x"]) for r in wrapped + bare)


def test_records_keep_their_order(spark, cuts, tmp_path):
    rows = [(str(i), "x\n" * (i % 4), "y") for i in range(30)]
    (tmp_path / "o.csv").write_text(csv_text(rows, "\n", csv.QUOTE_ALL))
    found = splits.csv_records(spark, str(tmp_path)).orderBy("file", "start", "at").collect()
    assert [r.text.split(",")[0].strip('"') for r in found] == ["id", *[r[0] for r in rows]]
