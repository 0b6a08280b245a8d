"""Registered queries: readers, writers and incremental processing, each over files written from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from assayer.functions.text import make_chat, message
from assayer.operators.evaluation import accuracy_by
from assayer.plans import derive as D
from assayer.session import scratch_path
from assayer.sources import history as H, tables as T
from assayer.streaming import incremental as I
from registry import parts as P
from registry.runs import _LABELLED, labelled
from registry.text import long_eval

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


@register("read_puzzles", f"with {P.TRACES}, k as (select lpad(cast(row_id as varchar), 8, '0') as id, prompt, expected as answer, type from traces) select id, type, answer, md5(prompt) as digest from k")
def read_puzzles(spark, sf):
    path = scratch_path(spark, "puzzles")
    T.write_puzzles(D.puzzles(spark, sf).select(F.lpad(F.col("row_id").cast("string"), 8, "0").alias("id"), "prompt", F.col("expected").alias("answer")), path)
    return T.read_puzzles(spark, path).select("id", "type", "answer", F.md5("prompt").alias("digest"))


@register("read_puzzles_first", f"with {P.TRACES} select lpad(cast(min(row_id) as varchar), 8, '0') as id, type, expected as answer from traces group by type, expected")
def read_puzzles_first(spark, sf):
    path = scratch_path(spark, "puzzles")
    T.write_puzzles(D.puzzles(spark, sf).select(F.lpad(F.col("row_id").cast("string"), 8, "0").alias("id"), "prompt", F.col("expected").alias("answer")), path)
    return T.read_puzzles(spark, path, first_per_answer=True).select("id", "type", "answer")


@register("read_chats", """select case when doc_id % 5 = 0 then 'unknown' else source end as source, case when doc_id % 5 = 0 then 'unknown' else lang end as type, count(*) as n, cast(sum(length(text)) as bigint) as chars
  from documents where doc_id % 11 <> 7 group by 1, 2""")
def read_chats(spark, sf):
    """JSON lines with untagged, blank and broken lines in between."""
    docs = D.documents(spark, sf)
    meta = F.struct(F.col("source"), F.col("lang").alias("puzzle_type"))
    line = F.to_json(F.struct(F.array(message("user", F.lit("?")), message("assistant", F.col("text"))).alias("messages"), F.when(F.col("doc_id") % 5 != 0, meta).alias("_meta")))
    broken = F.when(F.col("doc_id") % 11 == 7, F.when(F.col("doc_id") % 2 == 0, "").otherwise('{"messages": [')).otherwise(line)
    path = scratch_path(spark, "chats")
    docs.select(broken.alias("value")).write.text(path)
    answer = F.get("messages", F.lit(1))["content"]
    return T.read_chats(spark, path).groupBy("source", "type").agg(F.count("*").alias("n"), F.sum(F.char_length(answer)).alias("chars"))


_DUMP = f"with {P.TRACES} select type, count(*) as n, count(*) filter (where a_box = expected) as a_right, count(*) filter (where b_box = expected) as b_right from traces group by type"


def _documents(head, tail, size=256):
    """Arrow function: rows of a task, as JSON texts, joined to JSON documents of at most ``size`` rows."""
    def run(batches):
        held = []
        for batch in batches:
            for row in batch.column(0).to_pylist():
                held.append(row)
                if len(held) == size:
                    yield pa.RecordBatch.from_pydict({"value": [head + ",".join(held) + tail]})
                    held = []
        if held:
            yield pa.RecordBatch.from_pydict({"value": [head + ",".join(held) + tail]})
    return run


def _dump(spark, sf, wrapped):
    """Dumps of at most 256 rows, one JSON document per file: a bare list of rows, or rows with a header. Each task joins its own rows, so no text moves."""
    rows = D.traces(spark, sf).select(F.to_json(F.struct("row_id", "type", "expected", "prompt", "a_text", "a_box", "b_text", "b_box")).alias("value"))
    head, tail = ('{"meta":{"timestamp":"2024-01-01 00:00:00"},"rows":[', "]}") if wrapped else ("[", "]")
    path = scratch_path(spark, "dump")
    rows.mapInArrow(_documents(head, tail), "value string").write.option("maxRecordsPerFile", 1).text(path)
    frame = T.read_dump(spark, path)
    right = lambda run: F.count_if(F.col(f"{run}_box") == F.col("expected"))
    return frame.groupBy("type").agg(F.count("*").alias("n"), right("a").alias("a_right"), right("b").alias("b_right"))


@register("write_chats", f"with {P.TRACES} select type, count(*) as n, cast(sum(length(prompt) + length(expected)) as bigint) as chars from traces group by type")
def write_chats(spark, sf):
    rows = D.puzzles(spark, sf).select(*make_chat(F.col("prompt"), F.col("expected"), source=F.col("source"), puzzle_type=F.col("type")))
    clean, full = scratch_path(spark, "clean"), scratch_path(spark, "full")
    T.write_chats(rows, clean, full)
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda acc, m: acc + F.char_length(m["content"]))
    written = spark.read.parquet(full).groupBy(F.col("_meta.puzzle_type").alias("type")).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
    lines = spark.read.schema("messages array<struct<role:string,content:string>>").json(clean).agg(F.count("*").alias("lines"))
    total = spark.read.parquet(full).agg(F.count("*").alias("total"))
    return written.where(lines.scalar() == total.scalar())


@register("append_history", f"""with {P.EVAL} select run, case run when 'a' then '2024-01-01' else '2024-01-02' end as run_date, type, count(*) as n, count(*) filter (where ok) as correct,
  (select count(*) from ev e where e.run = ev.run) as n_samples from ev group by run, type""")
def append_history(spark, sf):
    rows, path = long_eval(spark, sf).select("run", "type", "ok"), scratch_path(spark, "history")
    # Run b is appended twice, as after a lost answer.
    for run, day in (("a", "2024-01-01"), ("b", "2024-01-02"), ("b", "2024-01-02")):
        H.append_history(T.summarise_run(rows.where(F.col("run") == run), run, day), path)
    stored = H.read_history(spark, path).select("run", F.col("run_date").cast("string").alias("run_date"), "n_samples", F.explode("per_type").alias("type", "cell"))
    return stored.select("run", "run_date", "type", "cell.n", "cell.correct", "n_samples")


@register("read_vocabulary", "select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark union all select unnest(['the', 'a', 'an', 'and', 'of', 'to', 'in', 'on', 'at', 'for', 'is', 'was', 'it', 'that', 'this', 'with', 'from', 'by', 'as', 'be'])) w")
def read_vocabulary(spark, sf):
    path = scratch_path(spark, "vocabulary")
    words = D.read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    words.select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value")).write.text(path)
    return T.read_vocabulary(spark, path)


@register("read_first_match", "select source, count(*) as n from documents group by source")
def read_first_match(spark, sf):
    path = scratch_path(spark, "first")
    docs = D.documents(spark, sf).select(*make_chat(F.lit("?"), F.col("text"), source=F.col("source")))
    docs.write.json(path + "/b")
    docs.limit(0).write.json(path + "/c")
    return T.read_first_match(spark, [path + "/a*", path + "/b*", path + "/*"]).groupBy("source").agg(F.count("*").alias("n"))


@register("round_trip_formats", "select kind, event_type, count(*) as n, round(sum(value), 4) as total from events, (select unnest(['parquet', 'json', 'csv']) as kind) k group by 1, 2")
def round_trip_formats(spark, sf):
    events, schema = D.read(spark, sf, "events").select("event_id", "event_type", "value"), "event_id bigint, event_type string, value double"
    union = None
    for kind in ("parquet", "json", "csv"):
        path = scratch_path(spark, kind)
        T.write_table(events, path, kind)
        part = T.read_table(spark, path, kind, schema).withColumn("kind", F.lit(kind))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("kind", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("incremental_history", f"""with {_LABELLED}, long as (select 'a' as run, row_id, type, a_ok as ok from labelled union all select 'b', row_id, type, b_ok from labelled),
  fixed as (select run, row_id, type, case when row_id % 10 = 0 then true else ok end as ok from long) select run, type, count(*) as n, count(*) filter (where ok) as correct, round(avg(ok::int), 9) as acc from fixed group by 1, 2""")
def incremental_history(spark, sf):
    """Two deliveries, the second one correcting a tenth of the rows, each ingested by its own stream run."""
    both = labelled(spark, sf)
    long = both.select("row_id", "type", F.inline(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"{r}_ok").alias("ok")) for r in ("a", "b")])))
    base = scratch_path(spark, "incremental")
    source, target, checkpoint = f"{base}/source", f"{base}/target", f"{base}/checkpoint"
    schema = "row_id bigint, type string, run string, ok boolean, seen_at bigint"
    deliveries = [long.withColumn("seen_at", F.lit(1).cast("bigint")),
                  long.where(F.col("row_id") % 10 == 0).withColumn("ok", F.lit(True)).withColumn("seen_at", F.lit(2).cast("bigint"))]
    for delivery in deliveries:
        delivery.select("row_id", "type", "run", "ok", "seen_at").write.mode("append").parquet(source)
        I.ingest_available(spark, source, schema, target, checkpoint)
    return accuracy_by(I.current_state(spark, target), "run", "type").select("run", "type", "n", "correct", F.round("acc", 9).alias("acc"))


@register("read_dump_bare", _DUMP)
def read_dump_bare(spark, sf):
    return _dump(spark, sf, wrapped=False)


@register("read_dump_wrapped", _DUMP)
def read_dump_wrapped(spark, sf):
    return _dump(spark, sf, wrapped=True)
