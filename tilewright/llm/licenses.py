"""License scan by ordered signatures (operator 12). DataFrame functions only; nothing is shuffled.

A text becomes lower-case words with single blanks. Every signature names one keyword of its regex in angle brackets:
texts without any keyword are passed over, and where a keyword stands only its own signatures are tried, on the
keyword with the words around it. What they detect are intervals of words; an interval inside one of better or equal
priority is suppressed. All of this stays within a row, with work that grows by the text and n log n by its detections.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words on either side of a keyword that a signature can see.
AROUND = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class Signature(NamedTuple):
    """``regex`` over blank-separated words, its keyword once as <word>; ``priority`` 0 is best and never suppressed."""

    label: str
    regex: str
    priority: int
    confidence: float

    @property
    def keyword(self) -> str:
        return re.search("<([^>]+)>", self.regex).group(1)


#: Phrases of the contract.
BASE = [
    Signature("mit", "under the <mit> license", 0, 0.9),
    Signature("apache-2", "<apache> license version 2", 0, 0.9),
    Signature("cc-by-nc", "<cc> by nc", 0, 0.9),
]

_V = "(?: version| v)?"
#: Licenses: label, short identifier, and name as texts have it, each with its keyword.
LICENSES = [
    ("mit", "<mit>", "<mit>"),
    ("mit", "<expat>", "<expat>(?: mit)?"),
    ("mit-0", "<mit> 0", "<mit> (?:0|zero|no attribution)"),
    ("x11", "<x11>", "<x11>(?: mit)?"),
    ("apache-2", "<apache> 2 0", f"<apache>(?: software)?(?: license)?{_V} (?:2|v2)(?: 0)?"),
    ("apache-1.1", "<apache> 1 1", f"<apache>(?: software)?(?: license)?{_V} 1 1"),
    ("bsd-2", "<bsd> 2 clause", "(?:(?:2|two) clause|simplified|freebsd) <bsd>"),
    ("bsd-3", "<bsd> 3 clause", "(?:(?:3|three) clause|new|revised|modified) <bsd>"),
    ("bsd-4", "<bsd> 4 clause", "(?:(?:4|four) clause|original|old) <bsd>"),
    ("0bsd", "<0bsd>", "(?:zero clause bsd )?<0bsd>"),
    ("isc", "<isc>", "<isc>"),
    ("gpl-2", "<gpl> 2 0(?: only| or later)?", "(?:gnu )?<gpl>(?: version| v)? 2(?: 0)?"),
    ("gpl-2", "<gplv2>", "(?:gnu )?<gplv2>"),
    ("gpl-2", "<gnu> gpl 2(?: 0)?", f"<gnu> general public license{_V} (?:2|v2)(?: 0)?(?: or(?: any)? later)?"),
    ("gpl-3", "<gpl> 3 0(?: only| or later)?", "(?:gnu )?<gpl>(?: version| v)? 3(?: 0)?"),
    ("gpl-3", "<gplv3>", "(?:gnu )?<gplv3>"),
    ("gpl-3", "<gnu> gpl 3(?: 0)?", f"<gnu> general public license{_V} (?:3|v3)(?: 0)?(?: or(?: any)? later)?"),
    ("gpl", "<gpl>", "(?:gnu )?<gpl>"),
    ("gpl", "<gnu> gpl", "<gnu> general public"),
    ("lgpl-2.1", "<lgpl> 2 1(?: only| or later)?", "(?:gnu )?<lgpl>(?: version| v)? 2(?: 1)?"),
    ("lgpl-2.1", "<gnu> lgpl 2 1", f"<gnu> (?:lesser|library) general public license{_V} 2(?: 1)?"),
    ("lgpl-3", "<lgpl> 3 0(?: only| or later)?", "(?:gnu )?<lgpl>(?: version| v)? 3(?: 0)?"),
    ("lgpl-3", "<gnu> lgpl 3(?: 0)?", f"<gnu> lesser general public license{_V} 3(?: 0)?"),
    ("lgpl", "<lgpl>", "(?:gnu )?<lgpl>"),
    ("lgpl", "<gnu> lgpl", "<gnu> (?:lesser|library) general public"),
    ("agpl-3", "<agpl> 3 0(?: only| or later)?", "(?:gnu )?<agpl>(?:(?: version| v)? 3(?: 0)?)?"),
    ("agpl-3", "<gnu> agpl", f"<gnu> affero general public(?: license{_V} 3(?: 0)?)?"),
    ("mpl-2", "<mpl> 2 0", "<mpl>(?: version| v)? 2(?: 0)?"),
    ("mpl-2", "<mozilla> 2 0", f"<mozilla> public(?: license{_V} 2(?: 0)?)?"),
    ("mpl-1.1", "<mpl> 1 1", f"<mozilla> public license{_V} 1 1"),
    ("epl-2", "<epl> 2 0", "<epl>(?: version| v)? 2(?: 0)?"),
    ("epl-1", "<epl> 1 0", "<epl>(?: version| v)? 1(?: 0)?"),
    ("epl", "<eclipse> public", "<eclipse> public"),
    ("cddl", "<cddl> 1 [01]", "<cddl>(?: version)?(?: 1 [01])?"),
    ("cddl", "<cddl>", "common development and distribution license <cddl>"),
    ("eupl", "<eupl> 1 [12]", "(?:european union public licen[cs]e )?<eupl>(?: v?1 [12])?"),
    ("artistic-2", "<artistic> 2 0", "<artistic>(?: license)? 2(?: 0)?"),
    ("artistic", "<artistic>", "(?:perl )?<artistic>"),
    ("zlib", "<zlib>", "<zlib>(?: libpng)?"),
    ("boost", "<bsl> 1 0", "<boost> software"),
    ("busl", "<busl> 1 1", "business source license <busl>(?: 1 1)?"),
    ("unlicense", "<unlicense>", "(?:the )?<unlicense>"),
    ("wtfpl", "<wtfpl>", "<wtfpl>"),
    ("python", "<psf> 2 0", "(?:python software foundation )?<psf>"),
    ("ofl", "<ofl> 1 1", "(?:sil )?(?:open font license )?<ofl>(?: 1 1)?"),
    ("openssl", "<openssl>", "<openssl>"),
    ("postgresql", "<postgresql>", "<postgresql>"),
    ("unicode", "<unicode> dfs 2016", "<unicode>(?: data files)?"),
    ("odbl", "<odbl> 1 0", "(?:open database license )?<odbl>(?: 1 0)?"),
    ("cc0", "<cc0> 1 0", "<cc0>(?: 1 0)?(?: universal)?"),
    ("cc-by", "<cc> by [1-4] 0", "<cc> by(?: [1-4] [05])?"),
    ("cc-by-sa", "<cc> by sa [1-4] 0", "<cc> by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "<cc> by nd [1-4] 0", "<cc> by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "<cc> by nc [1-4] 0", "<cc> by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "<cc> by nc sa [1-4] 0", "<cc> by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "<cc> by nc nd [1-4] 0", "<cc> by nc nd(?: [1-4] [05])?"),
]

#: How texts speak of a license; the longer the phrase, the better its priority. Named by what they hold: an identifier or a name.
PHRASES = [
    ("spdx license identifier {short}", 1, 1.0),
    ("(?:opensource|spdx|choosealicense|creativecommons|gnu) (?:org|com) licenses? {short}", 1, 0.95),
    ("(?:licensed|relicensed|released|distributed|available|published|provided|offered|covered|redistributed) (?:only )?(?:under|by|as) (?:the terms (?:and conditions )?of )?(?:the |an? )?{name}(?: (?:public )?licen[cs]e)?", 2, 0.95),
    ("(?:subject to|governed by|in accordance with|compliance with) (?:the terms (?:and conditions )?of )?(?:the |an? )?{name}(?: (?:public )?licen[cs]e)?", 2, 0.9),
    ("licen[cs]e (?:is |type |name |as )?(?:the )?{name}(?: licen[cs]e)?", 3, 0.75),
    ("(?:the )?{name} (?:public )?licen[cs]ed?", 3, 0.8),
]

#: Signatures that follow no common phrase.
SINGLE = [
    Signature("mit", "permission is hereby <granted> free of charge to any person obtaining a copy", 1, 0.97),
    Signature("isc", "permission to use copy modify and or <distribute> this software for any purpose", 1, 0.95),
    Signature("bsd", "<redistribution> and use in source and binary forms with or without modification", 1, 0.95),
    Signature("gpl", "this program is free software you can <redistribute> it and or modify it", 1, 0.93),
    Signature("apache-2", "you may not use this file except in <compliance> with the license", 1, 0.93),
    Signature("wtfpl", "do what the fuck you want to public <license>", 1, 0.98),
    Signature("unlicense", "free and <unencumbered> software released into the public domain", 1, 0.98),
    Signature("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public <domain>", 2, 0.8),
    Signature("cc0", "<creative> commons (?:zero|cc0|public domain)", 2, 0.9),
    Signature("cc-by-nc-sa", "<creative> commons attribution non ?commercial share ?alike", 2, 0.93),
    Signature("cc-by-nc-nd", "<creative> commons attribution non ?commercial no ?deriv(?:s|atives|ative works)", 2, 0.93),
    Signature("cc-by-nc", "<creative> commons attribution non ?commercial", 2, 0.93),
    Signature("cc-by-sa", "<creative> commons attribution share ?alike", 2, 0.93),
    Signature("cc-by-nd", "<creative> commons attribution no ?deriv(?:s|atives|ative works)", 2, 0.93),
    Signature("cc-by", "<creative> commons attribution", 2, 0.9),
    Signature("cc-by", "<cc> by [1-4] [05]", 3, 0.85),
    Signature("cc-by-sa", "<cc> by sa(?: [1-4] [05])?", 3, 0.85),
    Signature("cc-by-nd", "<cc> by nd(?: [1-4] [05])?", 3, 0.85),
    Signature("cc-by-nc-sa", "<cc> by nc sa(?: [1-4] [05])?", 3, 0.85),
    Signature("cc-by-nc-nd", "<cc> by nc nd(?: [1-4] [05])?", 3, 0.85),
    Signature("proprietary", "all rights <reserved>", 3, 0.4),
    Signature("proprietary", "<proprietary> and confidential", 3, 0.7),
]


def signatures() -> list[Signature]:
    """The rules in order: the contract's phrases, single signatures, then every phrase with every license."""
    out = [*BASE, *SINGLE]
    for phrase, priority, confidence in PHRASES:
        for label, short, name in LICENSES:
            out.append(Signature(label, phrase.format(short=short, name=name), priority, confidence))
    # A name that says license and version by itself needs no phrase around it.
    out += [Signature(label, f"(?:the )?{name}", 3, 0.85) for label, _, name in LICENSES if f" license{_V} " in name]
    return out


def words_text(text: Column) -> Column:
    """Lower-case words (A-Z only) with single blanks; empty for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), _BETWEEN, " "))


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def detect(words: Column, rules: list[Signature]) -> Column:
    """Array of (start, -end, priority, rule), words from 0 and end exclusive, of every signature at every keyword, sorted for ``suppress``.

    ``words`` must be a column, not an expression: it is looked into once a keyword.
    """
    keywords = list(dict.fromkeys(r.keyword for r in rules))
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    anchors = F.filter(numbered, lambda a: a["w"].isin(keywords))

    def context(a: Column) -> Column:
        left = F.slice(words, F.greatest(a["i"] - AROUND, F.lit(0)) + 1, F.least(a["i"], F.lit(AROUND)))
        right = F.slice(words, a["i"] + 2, F.lit(AROUND))
        return F.struct(a["w"].alias("w"), a["i"].alias("i"), F.concat(F.lit(" "), F.array_join(F.concat(left, F.array(F.concat(F.lit("<"), a["w"], F.lit(">"))), right), " "), F.lit(" ")).alias("c"))

    def hits(a: Column) -> Column:
        found = None
        for k in keywords:
            tried = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_extract(a["c"], f" {r.regex} ", 0).alias("hit")) for n, r in enumerate(rules) if r.keyword == k])
            found = F.when(a["w"] == k, tried) if found is None else found.when(a["w"] == k, tried)
        blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        start = lambda h: a["i"] - blanks(F.substring_index(h["hit"], "<", 1)) + 1
        end = lambda h: a["i"] + blanks(F.substring_index(h["hit"], ">", -1))
        priority = _literal([r.priority for r in rules], "int")
        return F.transform(F.filter(found, lambda h: h["hit"] != ""), lambda h: F.struct(start(h).alias("start"), (-end(h)).alias("to"), F.element_at(priority, h["rule"] + 1).alias("priority"), h["rule"].alias("rule")))

    return F.array_sort(F.flatten(F.transform(F.transform(anchors, context), hits)))


def suppress(found: Column, levels: int) -> Column:
    """Those of the sorted detections that lie in no other interval of better or equal priority.

    Sorted by start, longest first, then priority and rule, whatever contains a detection stands before it, so the
    furthest end before it decides, for each priority. These prefix maxima come from doubling: log n passes.
    """
    n = F.size(found)
    names = [f"m{p}" for p in range(levels)]
    ends = F.transform(found, lambda d: F.struct(*[F.when(d["priority"] <= p, -d["to"]).otherwise(F.lit(-1)).alias(f"m{p}") for p in range(levels)]))
    none = F.struct(*[F.lit(-1).alias(m) for m in names])
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))

    def doubled(acc: Column, k: Column) -> Column:
        by = F.least(F.call_function("shiftleft", F.lit(1), k), n)
        moved = F.concat(F.array_repeat(none, by), F.slice(acc, F.lit(1), n - by))
        return F.zip_with(acc, moved, lambda x, y: F.struct(*[F.greatest(x[m], y[m]).alias(m) for m in names]))

    def shifted(best: Column) -> Column:
        return F.concat(F.array(none), F.slice(best, F.lit(1), F.greatest(n - 1, F.lit(0))))

    before = shifted(F.aggregate(steps, ends, doubled))
    judged = F.zip_with(found, before, lambda d, b: F.struct(d.alias("d"), F.element_at(F.array(*[b[m] for m in names]), d["priority"] + 1).alias("m")))
    return F.transform(F.filter(judged, lambda j: (j["d"]["priority"] == 0) | (j["m"] < -j["d"]["to"])), lambda j: j["d"])


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None, text_col: str = "text", names: tuple[str, str] = ("n_words", "detections")) -> DataFrame:
    """Adds the number of words and the detections: array of (start, end, label, priority, confidence, rule), in order of start.

    Null and empty texts have no words and an empty array. Every row is judged by itself: repeated rows get equal
    results, null ids and columns of any other name are kept, given columns of the two names are replaced. A signature
    reaches ``AROUND`` words to either side of its keyword.
    """
    rules = signatures() if rules is None else rules
    n_words, detections = names
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    taken = {c.lower() for c in docs.columns} | {n.lower() for n in names}
    text, words, found = (next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("words_text", "words", "found"))
    keywords = sorted({r.keyword for r in rules})
    gate = F.concat(F.lit(" "), F.col(text), F.lit(" ")).rlike(f" (?:{'|'.join(keywords)}) ")
    kind = "array<struct<start:int,to:int,priority:int,rule:int>>"
    label, confidence = _literal([r.label for r in rules], "string"), _literal([r.confidence for r in rules], "double")
    out = docs.select(*kept, words_text(F.col(f"`{text_col}`")).alias(text))
    out = out.withColumn(words, F.when(gate, F.split(text, " ")))
    out = out.withColumn(found, F.when(F.col(words).isNotNull(), detect(F.col(words), rules)).otherwise(F.expr(f"cast(array() AS {kind})")))
    out = out.withColumn(found, F.when(F.size(found) > 0, suppress(F.col(found), 1 + max(r.priority for r in rules))).otherwise(F.col(found)))
    value = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["to"]).alias("end"), F.element_at(label, d["rule"] + 1).alias("label"), d["priority"].alias("priority"), F.element_at(confidence, d["rule"] + 1).alias("confidence"), d["rule"].alias("rule")))
    count = F.when(F.col(text) == "", 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1).cast("long")
    return out.select(*kept, count.alias(n_words), value.alias(detections))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (best confidence, else 0) of scanned rows."""
    base = F.filter("detections", lambda d: d["priority"] == 0)
    starts, labels = F.transform(base, lambda d: d["start"]), lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return scanned.select(F.col(id_col).alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), score.alias("score"))


def oracle_sql(rules: list[Signature] | None = None) -> str:
    """The same in DuckDB SQL over table documents: keywords join a table of signatures, windows suppress."""
    rules = signatures() if rules is None else rules
    values = ", ".join(f"({n}, '{r.keyword}', ' {r.regex} ', '{r.label}', {r.priority}, {r.confidence})" for n, r in enumerate(rules))
    blanks = lambda s: f"(length({s}) - length(replace({s}, ' ', '')))"
    return f"""
WITH rules AS (SELECT * FROM (VALUES {values}) r(rule, keyword, regex, label, priority, confidence)),
d AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_BETWEEN}', ' ', 'g'), ' ') AS t FROM documents),
s AS (SELECT r, doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM d),
a AS (SELECT r, i, w, w[i] AS keyword FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM s) x WHERE w[i] IN (SELECT keyword FROM rules)),
c AS (SELECT r, i, keyword, ' ' || array_to_string(list_concat(list_concat(w[greatest(1, i - {AROUND}):i - 1], ['<' || keyword || '>']), w[i + 1:i + {AROUND}]), ' ') || ' ' AS c FROM a),
h AS (SELECT r, i, rule, label, priority, confidence, regexp_extract(c, regex, 0) AS hit FROM c JOIN rules USING (keyword)),
f AS (SELECT *, i - {blanks("split_part(hit, '<', 1)")} AS start_, i - 1 + {blanks("split_part(hit, '>', 2)")} AS end_ FROM h WHERE hit <> ''),
k AS (SELECT * FROM (SELECT *, {', '.join(f"max(CASE WHEN priority <= {p} THEN end_ END) OVER w AS m{p}" for p in range(1, 1 + max(r.priority for r in rules)))} FROM f
  WINDOW w AS (PARTITION BY r ORDER BY start_, end_ DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
  WHERE priority = 0 OR coalesce(CASE priority {' '.join(f"WHEN {p} THEN m{p}" for p in range(1, 1 + max(r.priority for r in rules)))} END, -1) < end_),
g AS (SELECT r, count(*) FILTER (priority = 0) AS n_base, min(start_) FILTER (priority = 0) AS first_word, max(start_) FILTER (priority = 0) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (priority = 0))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(confidence) AS score FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM s LEFT JOIN g USING (r)
"""
