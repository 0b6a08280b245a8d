"""Registered queries of the subpackage: thin Spark steps that map the given tables to the operators and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.llm import (archives, chatrepair, collocations, crossparse, editcounts, licenses, linefield, minhash, noisyor, packing, prunedgraph,
                         suffixes, winnowing)

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP1 = f"""with item_words as (select item_id, {_WORDS} as w from benchmark where text is not null),
item_windows as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item_words where len(w) > 0)),
sizes as (select distinct size from item_windows),
doc_words as materialized (select doc_id, coalesce({_WORDS}, []) as w from documents),
doc_windows as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc_words, sizes)),
met as materialized (select doc_id, item_id, i, size from doc_windows join item_windows using (size, gram)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from met) group by 1),
owners as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, cast(item_id as varchar) as item from met) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated from doc_words d left join places p using (doc_id) left join owners o using (doc_id)"""


@register("op1_winnowing_decontamination", _OP1)
def op1(spark, sf_dir):
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = winnowing.contamination(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")), bench.select(F.col("item_id").alias("id"), F.col("text").alias("prompt")))
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_BASE32 = "array_to_string(flatten(list_transform(range(8), lambda g: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::bigint >> s) & 31) + 1, 1)))), '')"
_OP4 = f"""with digested as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
grouped as (select *, max(page_id) over (partition by h) as response from digested)
select page_id, cast(payload_bytes as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id <> response then response end as refers_to from grouped"""


@register("op4_gzip_member_normaliser", _OP4)
def op4(spark, sf_dir):
    return archives.archive_round_trip(read(spark, sf_dir, "pages"))


@register("op5_probminhash_near_dedup")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = minhash.near_classes(docs.select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("keeper").alias("cluster_id"), (F.col("id") == F.col("keeper")).alias("kept"))


_OP6 = """with texts as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from texts)),
again as materialized (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from starts) where k > 1),
marked as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from again),
numbered as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from marked),
spans as materialized (select doc_id, min(i) as low, max(i) + 100 as high from numbered group by doc_id, run),
gaps as (select doc_id, g.high as a, lead(g.low) over (partition by doc_id order by g.low, g.high) as b from (select * from spans union all select doc_id, 0, 0 from texts) g),
kept as (select t.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' order by a, b) as h from texts t join gaps using (doc_id) group by 1),
sums as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans from spans group by 1)
select t.doc_id, cast(len(t.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(k.h)) as kept_sha256
from texts t join kept k using (doc_id) left join sums using (doc_id)"""


@register("op6_suffix_array_dedup", _OP6)
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = suffixes.drop_repeats(docs.select(F.col("doc_id").alias("id"), "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_pruned_graph_neighbours")
def op2(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return prunedgraph.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_minimum_bin_slack_packing")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    packed = packing.pack(docs.select(F.col("doc_id").alias("id"), "text"), tokenizer_file("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def fold(modulus: int):
    """Remainder of the checksum of the document number, which deals documents out to learning and testing."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@register("op7_cross_parsing_language")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    samples = crossparse.language_samples(docs.where(fold(3) != 1), text="text")
    found = crossparse.identify_language(docs.select(F.col("doc_id").alias("id"), "text"), samples, text="text").withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def _labels(spark, sf_dir: str, label: str, learn) -> DataFrame:
    """``id, label`` of the documents that may be learned from."""
    return read(spark, sf_dir, "labels").where(learn).select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


@register("op8_line_field_quality")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    model = linefield.fit_quality(docs, _labels(spark, sf_dir, "quality", fold(5) != 0))
    found = linefield.score_quality(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "bad_lines")


@register("op9_noisy_or_toxicity")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    model = noisyor.fit_toxicity(docs, _labels(spark, sf_dir, "toxic", fold(4) != 2))
    found = noisyor.score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("sentences").cast("bigint").alias("n_offending"))


@register("op10_edit_aware_token_counts")
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = editcounts.redacted_counts(docs, tokenizer_file("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_before", "n_tokens", "n_edits", "n_encoded")


_CRC = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
_KEY = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
# Position, cost and audit of the cheapest edits from a message on, per state (start, system, user, assistant), folded from the last message.
_NEXT_STATE = [2, 2, 3, 2]


def _op11_sql() -> str:
    kept = {0: "case r when 's' then n1 when 'u' then n2 end", 1: "case r when 'u' then n2 end", 2: "case r when 'a' then n3 end", 3: "case r when 'u' then n2 end"}
    after = lambda state, letter, cost: f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a}}"
    once = ", ".join(f"list_min([{after(f'n{q}', 'D', 2)}, case when fault < 2 then {after(f'n{_NEXT_STATE[q]}', 'R', '1 + 5 * fault')} end, case when fault < 2 then "
                     f"{after('(' + kept[q] + ')', 'K', '5 * fault')} end]) as m{q}" for q in range(4))
    insert = lambda old, new: ", ".join(f"list_min([{old}{q}, {after(f'{old}{_NEXT_STATE[q]}', 'I', 5)}]) as {new}{q}" for q in range(4))
    return f"""with recursive hashed as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({_KEY}) + 1), lambda i: cast(ascii(substr({_KEY}, i, 1)) as bigint))),
  lambda c, b: {_CRC}), 4294967295) % 20 as hit from conversations),
damaged as (select conv_id, turn, case when hit = 4 then 'user' else coalesce(role, ' ') end as role,
  case hit when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case when hit = 3 then 2 else 1 end)) from hashed where hit > 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as r from damaged),
faulty as materialized (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 3 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 1 else 0 end as fault,
  lag(r) over (partition by conv_id order by i) || r not in ('su', 'ua', 'au') as bad from placed),
sizes as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 1) as truncated, count(*) filter (bad) as illegal from faulty group by 1),
ends as (select conv_id, n, {{'c': 0, 'a': ''}} as n0, {{'c': 1000000000, 'a': ''}} as n1, {{'c': 5, 'a': 'I'}} as n2, {{'c': 0, 'a': ''}} as n3 from sizes),
fold as (select conv_id, n as i, n0, {{'c': 10, 'a': 'II'}} as n1, n2, n3 from ends union all
  select conv_id, i, p0, p1, p2, p3 from (select conv_id, i, {insert('o', 'p')} from (select conv_id, i, {insert('m', 'o')} from (
    select f.conv_id, f.i - 1 as i, {once} from fold f join faulty on faulty.conv_id is not distinct from f.conv_id and faulty.i = f.i)))),
best as (select conv_id, cast(n0.c as bigint) as cost, n0.a as audit from fold where i = 0),
letters as (select conv_id, k, audit[k] as letter, length(replace(audit[:k], 'I', '')) as i, k - length(replace(audit[:k], 'D', '')) as gone from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from best)),
lines as (select l.conv_id, k, letter, f.role, case letter when 'I' then '' else f.text end as text, k - gone - (max(case when letter = 'K' and f.r = 's' then 1 else 0 end) over (partition by l.conv_id)) as place
  from letters l join faulty f on l.conv_id is not distinct from f.conv_id and f.i = greatest(l.i, 1) where letter <> 'D' union all
  select l.conv_id, k, letter, null, '', k - gone from letters l where letter = 'I' and not exists (select 1 from faulty f where f.conv_id is not distinct from l.conv_id)),
repaired as (select conv_id, string_agg(case when letter = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as said from lines group by 1)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256 from (select distinct conv_id from conversations) c
left join sizes s on s.conv_id is not distinct from c.conv_id left join best b on b.conv_id is not distinct from c.conv_id left join repaired p on p.conv_id is not distinct from c.conv_id"""


@register("op11_conversation_repair", _op11_sql())
def op11(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    message = F.when(hit != 0, F.struct(F.when(hit == 4, "user").otherwise(blank("role")).alias("role"), text.alias("content")))
    copies = F.array_repeat(F.struct(message.alias("message")), F.when(hit == 3, 2).otherwise(1))
    damaged = rows.select(F.col("conv_id").alias("id"), F.when(hit != 0, F.col("turn")).alias("turn"), F.explode(copies).alias("copy")).select("id", "turn", "copy.message")
    return chatrepair.repair_report(chatrepair.repair_messages(damaged)).withColumnRenamed("id", "conv_id")


_OP12 = """with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null),
words as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from words group by 1),
grams as materialized (select lang, size, gram, count(*) as f from (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as gram
  from words, range(1, 4) t(size) where len(w) >= size) group by all),
candidates as materialized (select *, string_split(gram, ' ') as w from grams where size > 1 and f >= 10),
sides as materialized (select lang, gram, f as a, k, array_to_string(w[:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from candidates, range(1, 3) t(k) where k < size),
cuts as (select s.lang, s.gram, a, k, l.f as l, r.f as r, 1000000::hugeint * a * a // (l.f::hugeint * r.f) as score from sides s
  join grams l on l.lang = s.lang and l.gram = s.first join grams r on r.lang = s.lang and r.gram = s.rest),
lowest as (select lang, gram, min(struct_pack(score := score, k := k, a := a, l := l, r := r)) as cut from cuts group by 1, 2),
parts as (select lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) as gram from candidates where size = 3),
covered as (select distinct p.lang, p.gram from parts p join candidates c on c.lang = p.lang and c.gram = p.gram where 100 * p.f >= 50 * c.f),
ranked as (select lang, gram as phrase, cut, row_number() over (partition by lang order by cut.score desc, cut.a desc, gram) as rank from lowest anti join covered using (lang, gram))
select lang, rank, phrase, cut.a as a, cut.l as l, cut.r as r, cast(n as bigint) as n, cast(cut.score as bigint) as score from ranked join totals using (lang) where rank <= 2000"""


@register("op12_phrase_collocations", _OP12)
def op12(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return collocations.mine_phrases(docs.select(F.col("lang").alias("run"), "text")).withColumnRenamed("run", "lang")


def _op13_sql() -> str:
    listed = ", ".join(f"({rank}, '{label}', '{key}', '{regex}', {weight})" for rank, label, key, regex, weight in licenses.rules())
    base = ", ".join(f"('{label}', '{licenses.pattern(phrase)}')" for phrase, label in licenses.BASE.items())
    span = "cast(regexp_extract(m, '[0-9]+') as bigint) as s, cast(regexp_extract(m, '[0-9]+') as bigint) + (length(m) - length(replace(m, ' ', ''))) // 2 as e"
    return f"""with doc_words as materialized (select doc_id, coalesce({_WORDS}, []) as w from documents),
lines as materialized (select doc_id, w, array_to_string(list_transform(range(1, len(w) + 1), lambda i: ' ' || (i - 1) || ':' || w[i] || ' '), '') as line from doc_words),
rules(rank, label, word, pattern, weight) as (values {listed}), base(label, pattern) as (values {base}),
places as (select doc_id, label, {span} from (select doc_id, label, unnest(regexp_extract_all(line, pattern)) as m from lines, base)),
spans as materialized (select doc_id, rank, label, weight, {span} from (select doc_id, rank, label, weight, unnest(regexp_extract_all(line, pattern)) as m from lines join rules on list_contains(w, word))),
kept as (select * from spans x where not exists (select 1 from spans y where y.doc_id = x.doc_id and y.rank < x.rank and ((y.s <= x.s and x.e <= y.e) or (x.s <= y.s and y.e <= x.e)))),
known as (select doc_id, label, weight, 0 as base, null as s from kept union all select doc_id, label, 0.8, 1, s from places),
found as (select doc_id, sum(base) as n_base, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) filter (base = 1) as base_labels, string_agg(distinct label, ',' order by label) as labels,
  max(weight) as score from known group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  cast(coalesce(score, 0) as double) as score from doc_words left join found using (doc_id)"""


@register("op13_license_scan", _op13_sql())
def op13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = licenses.license_scan(docs.select(F.col("doc_id").alias("row_id"), "text"), keys=("row_id",))
    starts = F.transform("base_places", lambda p: p["start"])
    return found.select(F.col("row_id").alias("doc_id"), "n_words", F.size("base_places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
