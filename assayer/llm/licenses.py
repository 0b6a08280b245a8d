"""License scan by ordered signature rules, in DataFrame functions only.

A signature is a row of words; ``word?`` may be absent, ``a|b`` is either. It becomes a regular expression over numbered words, so that every
match carries its place. A gate of stems and then the keyword of each rule decide which rules are tried on a text. Of two detections of
which one contains the other, that of the earlier rule stays. Everything happens inside the row: no shuffle, whole texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANY_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # the same before A-Z is lowered
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Phrases that every scan reports, whatever the other rules say.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
VERSIONED, NAMED, HINT = 1.0, 0.8, 0.5

_GNU = {"gpl": "gnu? general public license|licence", "lgpl": "gnu? lesser|library general public license|licence", "agpl": "gnu? affero general public license|licence"}
_GNU_VERSIONS = {"gpl": ["1", "2", "3"], "lgpl": ["2", "2 1", "3"], "agpl": ["1", "3"]}
_CREATIVE = {"by": "attribution", "by sa": "attribution share? sharealike? alike?", "by nd": "attribution no? noderivatives|noderivs|derivatives|derivs", "by nc": "attribution non? noncommercial|commercial",
             "by nc sa": "attribution non? noncommercial|commercial share? sharealike|alike", "by nc nd": "attribution non? noncommercial|commercial no? noderivatives|noderivs|derivatives|derivs"}
_CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_PUBLIC = {
    "mpl": ("mozilla public license", ["1 0", "1 1", "2 0"]), "epl": ("eclipse public license", ["1 0", "2 0"]), "cpl": ("common public license", ["1 0"]),
    "cddl": ("common development and distribution license", ["1 0", "1 1"]), "eupl": ("european union public licence|license", ["1 0", "1 1", "1 2"]),
    "osl": ("open software license", ["1 0", "2 0", "2 1", "3 0"]), "afl": ("academic free license", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    "artistic": ("artistic license", ["1 0", "2 0"]), "apl": ("adaptive public license", ["1 0"]), "apsl": ("apple public source license", ["1 0", "1 1", "1 2", "2 0"]),
    "lppl": ("latex project public license", ["1 0", "1 1", "1 2", "1 3"]), "ofl": ("sil? open font license", ["1 0", "1 1"]), "zpl": ("zope public license", ["1 1", "2 0", "2 1"]),
    "rpl": ("reciprocal public license", ["1 1", "1 5"]), "qpl": ("q public license", ["1 0"]), "npl": ("netscape public license", ["1 0", "1 1"]), "ecl": ("educational community license", ["1 0", "2 0"]),
    "upl": ("universal permissive license", ["1 0"]), "bsl": ("boost software license", ["1 0"]), "odbl": ("open database license", ["1 0"]), "mulan": ("mulan permissive software license", ["1", "2"]),
    "cecill": ("cecill free? software? license", ["1 0", "1 1", "2 0", "2 1"]), "gfdl": ("gnu? free documentation license", ["1 1", "1 2", "1 3"]), "busl": ("business source license", ["1 0", "1 1"]),
    "sspl": ("server side public license", ["1"]), "polyform": ("polyform noncommercial|strict|shield license", ["1 0"]), "openrail": ("responsible ai license", ["1 0"]),
}
_PLAIN = [
    ("apache-2.0", "apache license version? v? 2 0?"), ("apache-2.0", "apache software license version? v? 2 0?"), ("apache-2.0", "apache 2 0 license|licence"), ("apache-2.0", "asl 2 0"),
    ("apache-1.1", "apache software? license version? 1 1"), ("apache-1.0", "apache software? license version? 1 0"), ("bsd-2-clause", "bsd 2 clause license?"), ("bsd-2-clause", "2|two clause bsd license?"),
    ("bsd-3-clause", "bsd 3 clause license?"), ("bsd-3-clause", "3|three clause bsd license?"), ("bsd-4-clause", "bsd 4 clause license?"), ("bsd-4-clause", "4|four clause bsd license?"),
    ("bsd-2-clause", "simplified bsd license"), ("bsd-2-clause", "freebsd license"), ("bsd-3-clause", "new|modified|revised bsd license"), ("bsd-4-clause", "original bsd license"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software"), ("bsd-3-clause", "neither the name of"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"), ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty"), ("unlicense", "free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"), ("cc0-1.0", "cc0 1 0 universal?"), ("cc0-1.0", "creative commons zero v? 1? 0?"), ("postgresql", "postgresql license"), ("openssl", "openssl license"),
    ("python", "python software foundation license"), ("php", "php license version? 3?"), ("ruby", "ruby license"), ("vim", "vim license"), ("json", "the software shall be used for good not evil"),
    ("ms-pl", "microsoft public license"), ("ms-rl", "microsoft reciprocal license"), ("ncsa", "university of illinois ncsa open source license"), ("x11", "x11 license"), ("beerware", "beer ware license"),
    ("0bsd", "zero clause bsd license?"), ("sleepycat", "sleepycat license"), ("ipl", "ibm public license"), ("pddl", "public domain dedication and license"), ("elastic-2.0", "elastic license 2 0?"),
]
_NAMES = [
    ("mit", "mit license|licence"), ("mit", "licensed under mit"), ("mit", "expat license"), ("isc", "isc license|licence"), ("zlib", "zlib libpng? license"), ("bsd", "bsd style? license|licence|licensed"), ("apache", "apache software? license|licence"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"), ("cc0", "cc0"), ("unlicense", "the unlicense"), ("wtfpl", "wtfpl"), ("cc", "creative commons license|licence"), ("cc", "creative commons"),
    ("gpl", "gnu gpl"), ("lgpl", "gnu lgpl"), ("agpl", "gnu agpl"),
]
_HINTS = [
    ("public-domain", "in|into the public domain"), ("proprietary", "proprietary and confidential"), ("proprietary", "unauthorized copying of this file"), ("no-redistribution", "redistribution is prohibited"),
    ("no-warranty", "provided as is without warranty of any kind"), ("licensed", "licensed under the? terms? of? the?"), ("licensed", "released|distributed|available under the? terms? of? the? license|licence"), ("licensed", "license agreement"),
    ("spdx", "spdx license identifier"), ("licensed", "see the? license|licence file"),
]
_STEMS = ["licen", "public", "gpl", "clause", "bsd", "commons", "permission", "warranty", "reserved", "advertising", "neither", "unencumbered", "redistribution", "proprietary", "unauthorized"]
_SEPARATOR = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
# Stems anywhere, short words only whole. Every signature has a word of the gate that must be there (a test holds them against each other).
_SHORT = ["cc", "cc0", "asl", "evil", "unlicense", "wtfpl", *_PUBLIC]
_WHOLE = f"(?:^|[{_SEPARATOR}])(?:{'|'.join(_SHORT)})(?:$|[{_SEPARATOR}])"
GATE = f"(?i)(?:{'|'.join(_STEMS)}|{_WHOLE})"


def may_hold(text: Column) -> Column:
    """Whether ``GATE`` finds something, by plain searches first: only texts with the letters of a short word need the expression for whole ones."""
    lowered = F.lower(text)
    some = lambda parts: functools.reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in parts])
    return some(_STEMS) | (some(_SHORT) & text.rlike(f"(?i){_WHOLE}"))


def pattern(signature: str) -> str:
    """Regular expression of a signature over words written as `` number:word ``; the same in Java and in RE2."""
    out = []
    for word in signature.split():
        either = "|".join(word.rstrip("?").split("|"))
        out.append(f"(?: [0-9]+:(?:{either}) )" + ("?" if word.endswith("?") else ""))
    return "".join(out)


def keyword(signature: str) -> str:
    """The longest word that every match of the signature holds."""
    return max((w for w in signature.split() if not w.endswith("?") and "|" not in w), key=len)


def signatures() -> list[tuple[str, str, float]]:
    """(label, signature, weight) of every rule, earlier ones first: versions, then names, then hints."""
    dotted = lambda version: ".".join(version.split())
    found = [(label, signature, VERSIONED) for label, signature in _PLAIN]
    for label, name in _GNU.items():
        for v in reversed(_GNU_VERSIONS[label]):
            tail, zero = f"{v} or any? later version?", "" if " " in v else " 0?"
            found += [(f"{label}-{dotted(v)}+", f"{name} version? v? {tail}", VERSIONED), (f"{label}-{dotted(v)}+", f"{label} version? v? {v}{zero} or later", VERSIONED), (f"{label}-{dotted(v)}", f"{name} version? v? {v}{zero}", VERSIONED),
                      (f"{label}-{dotted(v)}", f"{label} version? v? {v}{zero} only?", VERSIONED), (f"{label}-{dotted(v)}", f"{label}v{v}", VERSIONED), (f"{label}-{dotted(v)}", f"version {v} of the {name}", VERSIONED)]
    for parts, name in reversed(_CREATIVE.items()):
        for v in _CREATIVE_VERSIONS:
            label = f"cc-{'-'.join(parts.split())}-{dotted(v)}"
            found += [(label, f"cc {parts} {v}", VERSIONED), (label, f"creative commons {name} {v}", VERSIONED)]
    for label, (name, versions) in _PUBLIC.items():
        for v in versions:
            found += [(f"{label}-{dotted(v)}", f"{name} version? v? {v}", VERSIONED), (f"{label}-{dotted(v)}", f"{label} {v}", VERSIONED)]
    found += [(label, signature, NAMED) for label, signature in _NAMES]
    found += [(f"cc-{'-'.join(parts.split())}", f"cc {parts}", NAMED) for parts in reversed(_CREATIVE)]
    found += [(f"cc-{'-'.join(parts.split())}", f"creative commons {name}", NAMED) for parts, name in reversed(_CREATIVE.items())]
    found += [(label, name, NAMED) for label, name in reversed(_GNU.items())]
    found += [(label, name, NAMED) for label, (name, _) in _PUBLIC.items()]
    found += [(BASE["all rights reserved"], "all rights reserved", HINT), *[(label, signature, HINT) for label, signature in _HINTS]]
    return found


def rules() -> list[tuple[int, str, str, str, float]]:
    """(rank, label, keyword, pattern, weight) of every rule."""
    return [(rank, label, keyword(signature), pattern(signature), weight) for rank, (label, signature, weight) in enumerate(signatures())]


def _numbered(words: Column) -> Column:
    """Words as one text of `` number:word ``, every word between blanks of its own."""
    marked = F.transform(words, lambda w, i: F.concat(F.lit(" "), i.cast("string"), F.lit(":"), w, F.lit(" ")))
    return F.array_join(marked, "")


def _span(match: Column) -> list[Column]:
    start = F.substring_index(F.ltrim(match), ":", 1).cast("bigint")
    words = (F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))) / 2
    return [start.alias("start"), (start + words.cast("bigint")).alias("end")]


def _places(phrase: str, label: str) -> Column:
    return F.transform(F.regexp_extract_all("_line", F.lit(pattern(phrase)), F.lit(0)), lambda m: F.struct(*_span(m), F.lit(label).alias("label")))


_OPEN = "array<struct<start: bigint, end: bigint, rank: int, label: string, weight: double, gone: boolean>>"


def _settled(spans: Column) -> Column:
    """Detections that no earlier rule's detection contains or is contained in; a sweep by start holds only those still open."""
    def sweep(state: Column, x: Column) -> Column:
        still = F.filter(state["open"], lambda o: o["end"] > x["start"])
        closed = F.filter(state["open"], lambda o: (o["end"] <= x["start"]) & ~o["gone"])
        inside = lambda o: x["end"] <= o["end"]
        lost = F.exists(still, lambda o: inside(o) & (o["rank"] < x["rank"]))
        fields = ("start", "end", "rank", "label", "weight")
        kept = F.transform(still, lambda o: F.struct(*[o[f].alias(f) for f in fields], (o["gone"] | (inside(o) & (x["rank"] < o["rank"]))).alias("gone")))
        new = F.array(F.struct(*[x[f].alias(f) for f in fields], lost.alias("gone")))
        return F.struct(F.concat(kept, new).alias("open"), F.concat(state["done"], closed).alias("done"))

    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["rank"], s["end"].alias("end"), s["label"], s["weight"]))),
                          lambda s: F.struct(s["start"], s["end"], s["rank"], s["label"], s["weight"]))
    empty = F.array().cast(_OPEN)
    return F.aggregate(ordered, F.struct(empty.alias("open"), empty.alias("done")), sweep, lambda state: F.concat(state["done"], F.filter(state["open"], lambda o: ~o["gone"])))


def license_scan(traces: DataFrame, text: str = "text", keys: tuple[str, ...] = ("row_id", "run")) -> DataFrame:
    """License statements of every text: ``keys``, then ``n_words, base_places, found, labels, base_labels, score``.

    ``traces``: texts of model runs, ``row_id, run, text``; columns that are not named are left out, so their names cannot clash. A-Z is
    lowered, every byte of a non-ASCII letter belongs to a word. ``base_places`` are all places of the phrases of ``BASE`` as (start, end,
    label), words counted from 0; ``found`` the detections that stay, in order of their start. ``labels`` are the distinct labels of both, sorted; ``score`` is the
    largest weight among them: 1 for a name with its version or a license's own wording, 0.8 for a name or a base phrase, 0.5 for a mere
    hint, 0 without any. A null or empty text has no words and no labels; repeated rows and null keys each keep a row of their own, a very
    long text is scanned whole, an empty table gives an empty result.
    """
    table = rules()
    listed = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(key).alias("keyword"), F.lit(regex).alias("pattern"), F.lit(weight).alias("weight"))
                       for rank, label, key, regex, weight in table])
    source = F.coalesce(F.col(text), F.lit(""))
    gated = traces.select(*keys, F.regexp_count(source, F.lit(ANY_WORD)).cast("bigint").alias("n_words"),
                          F.when(may_hold(source), F.regexp_extract_all(F.translate(source, UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("_words"))
    present = F.array_intersect("_words", F.array(*[F.lit(k) for k in sorted({r[2] for r in table})]))
    lined = gated.select(*keys, "n_words", F.when(F.size(present) > 0, _numbered(F.col("_words"))).alias("_line"), present.alias("_present"))
    tried = F.filter(listed, lambda r: F.array_contains(F.col("_present"), r["keyword"]))
    met = F.flatten(F.transform(tried, lambda r: F.transform(F.regexp_extract_all("_line", r["pattern"], F.lit(0)), lambda m: F.struct(*_span(m), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight")))))
    # An empty match cannot occur: every signature has a word that must be there.
    base = F.concat(*[_places(phrase, label) for phrase, label in BASE.items()])
    places = lined.select(*keys, "n_words", F.when(F.col("_line").isNotNull(), met).alias("_met"), F.when(F.col("_line").isNotNull(), F.array_sort(base)).alias("base_places"))
    kept = F.when(F.size("_met") > 0, _settled(F.col("_met")))
    settled = places.select(*keys, "n_words", F.coalesce("base_places", F.array().cast("array<struct<start: bigint, end: bigint, label: string>>")).alias("base_places"), F.coalesce(kept, F.array().cast(_OPEN)).alias("_kept"))
    found = F.transform("_kept", lambda s: F.struct(s["start"], s["end"], s["label"], s["weight"]))
    base_labels = F.array_sort(F.array_distinct(F.transform("base_places", lambda s: s["label"])))
    labels = F.array_sort(F.array_union(F.transform("_kept", lambda s: s["label"]), base_labels))
    weights = F.concat(F.transform("_kept", lambda s: s["weight"]), F.when(F.size("base_places") > 0, F.array(F.lit(NAMED))).otherwise(F.array(F.lit(0.0))))
    return settled.select(*keys, "n_words", "base_places", found.alias("found"), labels.alias("labels"), base_labels.alias("base_labels"), F.array_max(weights).alias("score"))
