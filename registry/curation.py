"""Registered queries: document filters, deduplication, redaction, contamination and classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from assayer.operators import classifiers as C, contamination as N, dedup as U, filters as X, logistic as L, phrases as H, profiles as G, redaction as R, sensitive as S
from assayer.plans import curation as Q, derive as D
from assayer.session import scratch_path
from registry import parts as P

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def docs(spark, sf):
    return D.documents(spark, sf)


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_FILLED = "list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')"
_UNIQ = lambda x: f"len(list_distinct({x}))"


def _removed(pattern: str) -> str:
    return f"(length(text) - length(regexp_replace(text, {P.q(pattern)}, '', 'g')))"


def _ratio(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0)::double, 0.0::double)"


_MEASURES = {
    "n_words": f"len({_WORDS})",
    "repeated_lines": _ratio(f"(len(fl) - {_UNIQ('fl')})", "len(fl)"),
    "symbol_ratio": _ratio(_removed("[#*~^{}<>|%$@]+"), f"len({_WORDS})"),
    "url_ratio": _ratio(_removed(X.URL), "length(text)"),
    "non_alnum": _ratio(_removed(r"[^\p{L}\p{N}\s]+"), "length(text)"),
    "bullets": _ratio("len(list_filter(fl, lambda l: regexp_matches(l, '^\\s*[-*•]')))", "len(fl)"),
    "whitespace": _ratio(_removed(r"\s+"), "length(text)"),
    "parentheses": _ratio(_removed(r"[()\[\]]+"), "length(text)"),
    "longest_word": f"coalesce(list_max(list_transform({_WORDS}, lambda w: length(w))), 0)",
}
_MEASURED = f"measured as materialized (select doc_id, text, source, {', '.join(f'{e} as {n}' for n, e in _MEASURES.items())} from (select *, {_FILLED} as fl from documents) d)"


@register("document_measures", f"with {_MEASURED} select doc_id, cast(n_words as bigint) as n_words, cast(longest_word as bigint) as longest_word, "
          + ", ".join(f"round({n}, 9) as {n}" for n in _MEASURES if n not in ("n_words", "longest_word")) + " from measured")
def document_measures(spark, sf):
    frame = X.with_measures(docs(spark, sf), "doc_id")
    return frame.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("longest_word").cast("bigint").alias("longest_word"),
                        *[F.round(n, 9).alias(n) for n in _MEASURES if n not in ("n_words", "longest_word")])


def _keeps(name: str, condition_sql: str, condition):
    @register(name, f"with {_MEASURED} select doc_id from measured where {condition_sql}")
    def run(spark, sf):
        return X.with_measures(docs(spark, sf), "doc_id").where(condition()).select("doc_id")


_L = X.LIMITS
_keeps("word_count_filter", f"n_words between {_L['min_words']} and {_L['max_words']}", lambda: F.col("n_words").between(_L["min_words"], _L["max_words"]))
for _name, _column in (("repeated_lines_filter", "repeated_lines"), ("symbol_word_ratio_filter", "symbol_ratio"), ("url_ratio_filter", "url_ratio"), ("non_alnum_filter", "non_alnum"),
                       ("bullets_filter", "bullets"), ("whitespace_filter", "whitespace"), ("parentheses_filter", "parentheses"), ("long_word_filter", "longest_word")):
    _keeps(_name, f"{_column} <= {_L[_column]}::double", lambda c=_column: F.col(c) <= _L[c])


def _language_sql() -> str:
    count = lambda stop: "len(list_filter(tokens, lambda w: w in (" + ", ".join(P.q(s) for s in stop) + ")))"
    scores = ", ".join(f"{count(stop)} as s_{lang}" for lang, stop in X.STOP_WORDS.items())
    best = "greatest(" + ", ".join(f"s_{lang}" for lang in X.STOP_WORDS) + ")"
    chain = " ".join(f"when s_{lang} = {best} then '{lang}'" for lang in sorted(X.STOP_WORDS))
    return (f"tokenised as (select doc_id, lang, text, regexp_extract_all(lower(text), '\\p{{L}}+') as tokens from documents), lscored as (select *, {scores} from tokenised), "
            f"languages as materialized (select doc_id, lang, case when {best} = 0 then 'und' {chain} end as language from lscored)")


@register("language_filter", f"with {_language_sql()} select doc_id, language from languages where language in ('en', 'fr')")
def language_filter(spark, sf):
    return X.language_filter(docs(spark, sf), ["en", "fr"]).select("doc_id", "language")


@register("language_agreement", f"with {_language_sql()} select lang, language, count(*) as n from languages group by 1, 2")
def language_agreement(spark, sf):
    return docs(spark, sf).select("lang", X.detect_language(F.col("text")).alias("language")).groupBy("lang", "language").agg(F.count("*").alias("n"))


_EDGES = """unnest(list_filter(flatten(list_transform(regexp_extract_all(lower(text), '\\p{L}+'), lambda w: ['^' || w[:2], w[-2:] || '$', case when length(w) <= 4 then '=' || w end])), lambda e: e is not null))"""
_PROFILED = f"""pieces as materialized (select doc_id, lang, {_EDGES} as edge from documents), counted as (select lang, edge, count(*) as n from pieces where doc_id % 5 <> 0 and lang is not null group by 1, 2),
  kept as (select edge from counted group by 1 having sum(n) >= 5 order by sum(n) desc, edge limit 4000), own as (select * from counted join kept using (edge)), sizes as (select lang, sum(n) as total from own group by 1),
  profiles as (select kept.edge as edge, s.lang as language, ln((coalesce(n, 0) + 1) / (total + (select count(*) from kept))::double) as weight from sizes s cross join kept left join own on own.lang = s.lang and own.edge = kept.edge),
  likeliest as (select doc_id, language from (select doc_id, language, sum(weight) as score from pieces join profiles using (edge) group by 1, 2) t qualify row_number() over (partition by doc_id order by score desc, language) = 1),
  profiled as (select doc_id, lang, coalesce(language, 'und') as language from documents left join likeliest using (doc_id))"""


def _profiled(spark, sf):
    rows = docs(spark, sf)
    return G.profile_language(rows, G.learn_profiles(rows.where(F.col("doc_id") % 5 != 0)), "doc_id", "lang")


@register("profile_language", f"with {_PROFILED} select doc_id, language from profiled")
def profile_language(spark, sf):
    return _profiled(spark, sf).select("doc_id", "language")


@register("profile_agreement", f"with {_PROFILED} select doc_id % 5 = 0 as held_out, lang, language, count(*) as n from profiled group by 1, 2, 3")
def profile_agreement(spark, sf):
    return _profiled(spark, sf).groupBy((F.col("doc_id") % 5 == 0).alias("held_out"), "lang", "language").agg(F.count("*").alias("n"))


@register("exact_dedup", "select doc_id, min(doc_id) over (partition by md5(text)) as keeper, count(*) over (partition by md5(text)) as copies from documents")
def exact_dedup(spark, sf):
    return U.exact_dedup(docs(spark, sf))


def _classes_sql(nodes: str, key: str, links: str) -> str:
    """Least member of the component of every node; ``links`` yields pairs (x, y)."""
    return f"""sides as materialized (select x, y from ({links}) l union select y, x from ({links}) m),
  reach as (select {key} as x, {key} as y from {nodes} union select r.x, s.y from reach r join sides s on s.x = r.y),
  classes as (select x, min(y) as cluster from reach group by 1)"""


def _near_sql(nodes: str) -> str:
    """Components by Jaccard 0.8 of three-word shingles, from all pairs that share a shingle, and equal texts."""
    return f"""listed as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from {nodes}),
  sets as materialized (select doc_id, hash(gram) as gram from (select distinct doc_id, unnest(case when len(tokens) >= 3 then list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i + 2], ' '))
    when len(tokens) > 0 then [array_to_string(tokens, ' ')] else [] end) as gram from listed) g),
  sized as (select doc_id, count(*) as n from sets group by 1),
  met as materialized (select a.doc_id as x, b.doc_id as y, count(*) as shared from sets a join sets b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
  near as materialized (select x, y from met join sized p on p.doc_id = x join sized q on q.doc_id = y where shared / (p.n + q.n - shared)::double >= 0.8::double
    union select a.doc_id, b.doc_id from listed a join listed b on md5(a.text) = md5(b.text) and a.doc_id < b.doc_id), {_classes_sql(nodes, 'doc_id', 'select x, y from near')}"""


@register("fuzzy_dedup", f"with recursive {_near_sql('documents')} select x as doc_id, cluster from classes")
def fuzzy_dedup(spark, sf):
    return U.fuzzy_dedup(docs(spark, sf))


# Every seventh vector gets a scaled and slightly turned copy, every fourteenth a second one, so that there are links to find.
_PLANTED = """planted as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  union all select vec_id + 1000000000, list_transform(embedding, lambda x, i: (x * 1.5::double + case when i = 1 then 0.1::double else 0.0::double end)::float::double) from embeddings where vec_id % 7 = 0
  union all select vec_id + 2000000000, list_transform(embedding, lambda x, i: (x * 0.5::double - case when i = 2 then 0.05::double else 0.0::double end)::float::double) from embeddings where vec_id % 14 = 0)"""


@register("semantic_dedup", f"with recursive {_PLANTED}, close as materialized (select a.vec_id as x, b.vec_id as y from planted a join planted b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.85::double), "
          f"{_classes_sql('planted', 'vec_id', 'select x, y from close')} select x as vec_id, cluster from classes")
def semantic_dedup(spark, sf):
    vectors = D.read(spark, sf, "embeddings").select("vec_id", "embedding")
    turned = lambda offset, factor, place, shift, every: vectors.where(F.col("vec_id") % every == 0).select(
        (F.col("vec_id") + offset).alias("vec_id"), F.transform("embedding", lambda x, i: (x * F.lit(factor) + F.when(i == place, F.lit(shift)).otherwise(0.0)).cast("float")).alias("embedding"))
    return U.semantic_dedup(vectors.unionByName(turned(1000000000, 1.5, 0, 0.1, 7)).unionByName(turned(2000000000, 0.5, 1, -0.05, 14)))


def _redacted_sql() -> str:
    current, counts = "text", []
    for name, pattern in R.ENTITIES.items():
        counts.append(f"len(regexp_extract_all({current}, {P.q(pattern)}, 0)) as {name.lower()}")
        current = f"regexp_replace({current}, {P.q(pattern)}, '<{name}>', 'g')"
    return f"select doc_id, {', '.join(counts)}, md5({current}) as digest from documents"


@register("pii_redact", _redacted_sql())
def pii_redact(spark, sf):
    frame = R.pii_redact(docs(spark, sf))
    return frame.select("doc_id", *[F.col(n.lower()).cast("bigint").alias(n.lower()) for n in R.ENTITIES], F.md5("text").alias("digest"))


_LUHN = """(regexp_matches(d, '^[2-6]') and length(d) between 13 and 19
  and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then cast(d[length(d) - i + 1] as int) else cast(d[length(d) - i + 1] as int) * 2 - case when d[length(d) - i + 1] > '4' then 9 else 0 end end)) % 10 = 0)"""
_IBAN = """(length(d) between 15 and 34 and list_reduce(list_prepend(0::bigint, list_transform(range(1, length(d) + 1), lambda i: ascii((d[5:] || d[:4])[i])::bigint)),
  lambda a, c: case when c < 65 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1)"""
_SECRET = f"""(regexp_matches(d, '[0-9]') and regexp_matches(d, '[A-Za-z]') and round(list_sum(list_transform(list_distinct(string_split(d, '')), lambda c:
  -(length(d) - length(replace(d, c, ''))) / length(d)::double * log2((length(d) - length(replace(d, c, ''))) / length(d)::double))), 9) >= {S.ENTROPY}::double)"""


def _checked_sql(spans: bool) -> str:
    """Runs with their numbers and the text before each; those that pass the check are tagged, in the order of the entities."""
    checks = {"SECRET": (_SECRET, "m"), "IBAN_CODE": (_IBAN, "replace(m, ' ', '')"), "CREDIT_CARD": (_LUHN, "regexp_replace(m, '[^0-9]', '', 'g')")}
    steps, last, tables = [], "documents", []
    for name, pattern in S.PATTERNS.items():
        key, (check, digits) = name.lower(), checks[name]
        source = "documents" if spans else last
        steps.append(f"""{key}_runs as materialized (select doc_id, i, before, m, coalesce({check}, false) as hit from (select *, {digits} as d from (select doc_id, unnest(range(1, len(b) + 1)) as i, unnest(b) as before, unnest(list_append(ms, null)) as m
  from (select doc_id, string_split_regex(text, {P.q(pattern)}) as b, regexp_extract_all(text, {P.q(pattern)}) as ms from {source} where text is not null) t) u) v)""")
        if spans:
            steps.append(f"""{key}_spans as (select doc_id, '{name}' as entity, cast(upto - length(m) as int) as start, cast(upto as int) as "end" from (
  select *, sum(length(before) + coalesce(length(m), 0)) over (partition by doc_id order by i) as upto from {key}_runs) r where hit)""")
            tables.append(f"select * from {key}_spans")
        else:
            steps.append(f"""{key}_done as materialized (select doc_id, count(*) filter (where hit) as {key}, string_agg(before || case when hit then '<{name}>' else coalesce(m, '') end, '' order by i) as text from {key}_runs group by 1)""")
            last = f"{key}_done"
    if spans:
        return f"with {', '.join(steps)} {' union all '.join(tables)}"
    names = [n.lower() for n in S.PATTERNS]
    joins = " ".join(f"left join {n}_done on {n}_done.doc_id = d.doc_id" for n in names)
    return f"with {', '.join(steps)} select d.doc_id, {', '.join(f'coalesce({n}, 0) as {n}' for n in names)}, md5({last}.text) as digest from documents d {joins}"


@register("checked_redaction", _checked_sql(False))
def checked_redaction(spark, sf):
    found = S.checked_redact(docs(spark, sf))
    return found.select("doc_id", *[n.lower() for n in S.PATTERNS], F.md5("text").alias("digest"))


@register("sensitive_spans", _checked_sql(True))
def sensitive_spans(spark, sf):
    return S.sensitive_spans(docs(spark, sf))


def _scored_sql(label: str) -> str:
    return f"""with listed as materialized (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), {P.q(C.TOKENS)})) as words from documents),
  known as (select doc_id, {label} as y from labels where {label} is not null), totals as (select count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0 from documents join known using (doc_id)),
  counted as (select word, count(*) filter (where y = 1) as c1, count(*) filter (where y = 0) as c0 from (select unnest(words) as word, y from listed join known using (doc_id)) w group by 1 having count(*) >= 5),
  weighed as (select word, ln((c1 + 1) / (n1 + 2)::double) - ln((c0 + 1) / (n0 + 2)::double) as weight from counted, totals
    where abs(c1 / n1::double - c0 / n0::double) >= 3.0::double * sqrt((c1 + c0) / (n1 + n0)::double * (1 - (c1 + c0) / (n1 + n0)::double) * (1 / n1::double + 1 / n0::double))),
  sums as (select doc_id, sum(weight) as weight from (select doc_id, unnest(words) as word from listed) w join weighed using (word) group by 1),
  scored as (select d.doc_id, 1 / (1 + exp(-(coalesce(weight, 0) + ln((n1 + 1) / (n0 + 1)::double)))) as score from documents d left join sums s using (doc_id), totals)"""


@register("quality_classifier", f"{_scored_sql('quality')} select doc_id, round(score, 4) as score from scored where score > 0.5::double")
def quality_classifier(spark, sf):
    return C.quality_classifier(docs(spark, sf), D.read(spark, sf, "labels")).select("doc_id", F.round("score", 4).alias("score"))


@register("toxicity_filter", f"{_scored_sql('toxic')} select doc_id, round(score, 4) as score from scored where score < 0.9::double")
def toxicity_filter(spark, sf):
    return C.toxicity_filter(docs(spark, sf), D.read(spark, sf, "labels")).select("doc_id", F.round("score", 4).alias("score"))


def _fitted(spark, sf, label):
    """Scores by a model fitted on four fifths of the labels, stored as a version in the shared folder and loaded again."""
    known, rows = D.read(spark, sf, "labels"), docs(spark, sf)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    path = scratch_path(spark, f"model-{label}")
    L.save_model(spark, L.fit_text_model(rows, known.where(~held_out), label), path)
    return L.score_text(rows, L.load_model(spark, path)).select("doc_id", held_out.alias("held_out"), "score")


@register("quality_model")
def quality_model(spark, sf):
    return _fitted(spark, sf, "quality")


@register("toxicity_model")
def toxicity_model(spark, sf):
    return _fitted(spark, sf, "toxic")


_LIM = Q.LIMITS
def _staged_sql(languages: list[str], start: str = "with") -> str:
    return f"""{start} {_MEASURED}, {_language_sql()}, ruled as (select doc_id, md5(text) as digest, case when n_words < {_LIM['min_words']} or n_words > {_LIM['max_words']} then 'word_count'
  when repeated_lines > {_LIM['repeated_lines']}::double then 'repeated_lines' when symbol_ratio > {_LIM['symbol_ratio']}::double then 'symbol_ratio' when url_ratio > {_LIM['url_ratio']}::double then 'url_ratio'
  when language not in ({', '.join(P.q(x) for x in languages)}) then 'language' end as stage from measured join languages using (doc_id)),
  staged as (select doc_id, case when stage is not null then stage when doc_id = min(doc_id) over (partition by digest, stage is null) then 'kept' else 'exact_copy' end as stage from ruled)"""


_STAGED = _staged_sql(["en"])


@register("curation_stages", f"{_STAGED} select doc_id, stage from staged")
def curation_stages(spark, sf):
    return Q.staged(docs(spark, sf), ["en"])


@register("curation_funnel", f"{_STAGED} select stage, count(*) as documents from staged group by stage")
def curation_funnel(spark, sf):
    return Q.stage_counts(Q.staged(docs(spark, sf), ["en"]))


def _curated_sql() -> str:
    text = "text"
    for name, pattern in R.ENTITIES.items():
        text = f"regexp_replace({text}, {P.q(pattern)}, '<{name}>', 'g')"
    kept = "kept_documents as materialized (select d.* from documents d join staged s using (doc_id) where s.stage = 'kept')"
    return f"{_staged_sql(['en', 'de', 'fr', 'es'], 'with recursive')}, {kept}, {_near_sql('kept_documents')} select k.doc_id, md5({text}) as digest from kept_documents k join classes c on c.x = k.doc_id where c.cluster = k.doc_id"


@register("curated_documents", _curated_sql())
def curated_documents(spark, sf):
    return Q.curated(docs(spark, sf), ["en", "de", "fr", "es"]).select("doc_id", F.md5("text").alias("digest"))


def _funnel_sql() -> str:
    """All steps of the chain; the scores come from every document, as the classifier learns from the whole table."""
    scored = _scored_sql("toxic").removeprefix("with ").replace("listed", "worded").replace("known", "labelled_docs").replace("sums", "word_sums")
    hits = " + ".join(f"len(regexp_extract_all(text, {P.q(p)}, 0))" for p in R.ENTITIES.values())
    kept = "kept_documents as materialized (select d.* from documents d join staged s using (doc_id) where s.stage = 'kept')"
    return f"""{_staged_sql(['en', 'de', 'fr', 'es'], 'with recursive')}, {kept}, {_near_sql('kept_documents')}, {scored},
  judged as (select k.doc_id, {hits} as hits, score < 0.8::double as is_safe from kept_documents k join classes c on c.x = k.doc_id join scored s on s.doc_id = k.doc_id where c.cluster = k.doc_id),
  names as (select unnest([{', '.join(P.q(s) for s in Q.FUNNEL)}]) as stage),
  counts as (select stage, count(*) as documents from staged where stage <> 'kept' group by 1 union all select 'near_copy', count(*) from classes where x <> cluster
    union all select 'toxic', count(*) filter (where not is_safe) from judged union all select 'kept', count(*) filter (where is_safe) from judged
    union all select 'redacted', count(*) filter (where is_safe and hits > 0) from judged)
  select stage, coalesce(documents, 0) as documents from names left join counts using (stage)"""


@register("full_funnel", _funnel_sql())
def full_funnel(spark, sf):
    return Q.curate(docs(spark, sf), D.read(spark, sf, "labels"), ["en", "de", "fr", "es"], scratch_path(spark, "curated"))


_GRAMS = lambda table, key: f"""(select distinct {key}, md5(array_to_string(tokens[i:i + 7], ' ')) as gram from (
  select {key}, tokens, unnest(range(1, len(tokens) - 6)) as i from (select {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from {table}) a) b)"""
_OVERLAP = f"""owned as materialized (select gram, item_id from {_GRAMS('benchmark', 'item_id')} g), sizes as (select item_id, count(*) as owned from owned group by 1),
  found_overlaps as materialized (select doc_id, o.item_id, count(*)::bigint as hits, count(*) / any_value(owned) as share from {_GRAMS('documents', 'doc_id')} d join owned o using (gram) join sizes s on s.item_id = o.item_id group by 1, 2)"""


@register("benchmark_overlap", f"with {_OVERLAP} select doc_id, item_id, hits, round(share, 9) as share from found_overlaps")
def benchmark_overlap(spark, sf):
    return N.overlap(docs(spark, sf), D.read(spark, sf, "benchmark")).withColumn("share", F.round("share", 9))


@register("decontaminate", f"with {_OVERLAP} select doc_id from documents where doc_id not in (select doc_id from found_overlaps where share >= 0.5::double)")
def decontaminate(spark, sf):
    return N.decontaminate(docs(spark, sf), D.read(spark, sf, "benchmark")).select("doc_id")


@register("template_leakage", """with l as (select distinct doc_id, trim(unnest(string_split(text, chr(10))), ' ') as line from documents)
  select md5(line) as line, count(*) as documents from l where length(line) >= 5 group by 1 having count(*) >= 0.01::double * (select count(*) from documents)""")
def template_leakage(spark, sf):
    return X.template_leakage(docs(spark, sf)).select(F.md5("line").alias("line"), "documents")


# Frequent phrases grow word by word: the places of the phrases of n words, kept where enough documents share them.
_PHRASES = """with recursive lists as materialized (select doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') as ws from documents),
  w as materialized (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from lists),
  least as (select greatest(2, ceil(0.01::double * count(*) - 1e-9::double)) as least from documents),
  base as (select a.doc_id, a.p, md5_number_lower(a.word || ' ' || b.word || ' ' || c.word) as id from w a join w b on b.doc_id = a.doc_id and b.p = a.p + 1 join w c on c.doc_id = a.doc_id and c.p = a.p + 2),
  base_n as (select id, count(distinct doc_id) as documents from base group by 1 having documents >= (select least from least)),
  grown(n, doc_id, p, id, documents) as (
    select 3, doc_id, p, id, documents from base join base_n using (id)
    union all
    select n, doc_id, p, id, documents from (select *, sum(fresh) over (partition by id) as documents from (
      select *, case when row_number() over (partition by id, doc_id order by p) = 1 then 1 else 0 end as fresh from (
        select a.n + 1 as n, a.doc_id, a.p, md5_number_lower(a.id::varchar || w.word) as id
        from grown a join grown b on a.doc_id = b.doc_id and b.p = a.p + 1 join w on w.doc_id = a.doc_id and w.p = a.p + a.n) d) e) f where documents >= (select least from least)),
  stays as (select n, doc_id, p, id, documents from grown),
  inner_ones as (select distinct s.id from stays s join stays t on t.doc_id = s.doc_id and t.n = s.n + 1 and t.p in (s.p, s.p - 1)),
  firsts as (select id, any_value(n) as n, min(struct_pack(doc_id := doc_id, p := p)) as spot, any_value(documents) as documents from stays anti join inner_ones using (id) group by 1)
  select md5(array_to_string(list_slice(ws, spot.p, spot.p + n - 1), ' ')) as phrase, n as words, cast(documents as bigint) as documents from firsts join lists on lists.doc_id = spot.doc_id"""


@register("phrase_leakage", _PHRASES)
def phrase_leakage(spark, sf):
    return H.phrase_leakage(docs(spark, sf)).select(F.md5("phrase").alias("phrase"), "words", "documents")


@register("regeneration_diff", """with o as (select doc_id, md5(text) as before from documents where doc_id % 19 <> 3), n as (select case when doc_id % 50 = 9 then doc_id + 1000000000 else doc_id end as doc_id,
  md5(case when doc_id % 3 = 0 then text || '.' else text end) as after from documents where doc_id % 23 <> 4),
  b as (select * from o full join n using (doc_id)), c as (select count(*) as total, count(*) filter (where before is null) as added, count(*) filter (where after is null) as removed, count(*) filter (where before <> after) as changed from b)
  select *, round(changed / (total - added - removed), 9) as changed_share, changed / (total - added - removed) > 0.3::double as alert from c""")
def regeneration_diff(spark, sf):
    base = docs(spark, sf).select("doc_id", "text")
    new = base.where(F.col("doc_id") % 23 != 4).select(F.when(F.col("doc_id") % 50 == 9, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id")).alias("doc_id"),
                                                        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return X.regeneration_diff(base.where(F.col("doc_id") % 19 != 3), new).withColumn("changed_share", F.round("changed_share", 9))


@register("ngram_repetition", """with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as ws from documents),
  g as (select doc_id, list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) as gs from t)
  select doc_id, round(coalesce(1 - len(list_distinct(gs)) / nullif(len(gs), 0)::double, 0), 9) as repetition from g""")
def ngram_repetition(spark, sf):
    return X.with_ngram_repetition(docs(spark, sf), 3, "doc_id").withColumn("repetition", F.round("repetition", 9))


@register("map_batches", "select event_id, value * 2 + 1 as doubled, upper(event_type) as label from events where value > 20")
def map_batches(spark, sf):
    rows = D.read(spark, sf, "events").select("event_id", "value", "event_type")

    def double(batch: pd.DataFrame) -> pd.DataFrame:
        kept = batch[batch["value"] > 20]
        return pd.DataFrame({"event_id": kept["event_id"], "doubled": kept["value"] * 2 + 1, "label": kept["event_type"].str.upper()})

    return C.map_batches(rows, double, "event_id bigint, doubled double, label string")


@register("map_filter_flat_map", "select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as word from conversations where role = 'user'")
def map_filter_flat_map(spark, sf):
    rows = D.read(spark, sf, "conversations").where(F.col("role") == "user")
    return rows.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word"))


@register("batch_inference", """select vec_id, label, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::double * ((i * 37) % 11 - 5) / 10.0::double)), 6) as score from embeddings""")
def batch_inference(spark, sf):
    def build():
        import numpy as np

        def scores(batch: pd.Series) -> pd.Series:
            flat, sizes = np.concatenate([np.zeros(0), *batch]).astype(np.float64), batch.map(len).to_numpy(dtype=np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return pd.Series(np.bincount(own, weights=flat * (((place * 37) % 11 - 5) / 10.0), minlength=len(sizes)))

        return scores

    predict = C.batch_inference(build)
    return D.read(spark, sf, "embeddings").select("vec_id", "label", F.round(predict(F.col("embedding")), 6).alias("score"))


@register("repartition", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def repartition(spark, sf):
    rows = D.read(spark, sf, "events").repartition(16, "event_id")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
