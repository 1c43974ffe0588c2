"""Lexical search, license scan and collocations against brute force on small tables, and against SQL on the smallest given ones."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tilewright.llm import collocations, lexical, licenses, registry

DATA = "/root/testdata/sf0.001"
BIG = 2**60 + 1


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_license_scan", "op13_collocations"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    cur = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(r) for r in cur.fetchall())
    assert want and sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want


# --- Operator 11 --------------------------------------------------------------------------------------------------

TEXTS = [(5, "The cat, the CAT and a_dog"), (3, None), (4, ""), (BIG, "cat cat cat"), (BIG + 1, "cat cat cat"), (None, "cat dog"), (2, "größe Éa x 7 seven7"), (2, "größe Éa x 7 seven7"), (9, "concat cats " * 3000 + "dog"), (8, "!!! ???")]
ITEMS = [(1, "cat"), (1, "dog cat"), (2, "GRÖßE größe x 7"), (3, "nothing here"), (4, None), (None, "a dog"), (6, "Éa x")]


def searched(texts, items, k):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    docs = [(i, Counter(words(t))) for i, t in texts if words(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = set()
    for item, terms in wanted.items():
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in docs) + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block_pairs", [2, 1000])
def test_lexical(spark, block_pairs):
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in TEXTS], "doc_id long, text string, score string, item_id string, rank int").repartition(3)
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, term string")
    for k in (1, 3, 10):
        got = lexical.ranked_search(docs, items, k, block_pairs=block_pairs).collect()
        want = searched(TEXTS, ITEMS, k)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert lexical.ranked_search(docs.limit(0), items).count() == lexical.ranked_search(docs, items.limit(0)).count() == 0


# --- Operator 12 --------------------------------------------------------------------------------------------------


def scanned(text, rules):
    """Every signature on the whole text, then every pair of detections compared."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    found = []
    for n, r in enumerate(rules):
        for i, w in enumerate(words):
            if w == r.keyword:
                marked = f" {' '.join([*words[max(0, i - licenses.AROUND) : i], f'<{w}>', *words[i + 1 : i + 1 + licenses.AROUND]])} "
                if m := re.search(f" {r.regex} ", marked):
                    a, b = m.group().split(f"<{w}>")
                    found.append((i - len(a.split()), i + 1 + len(b.split()), r.priority, n))
    kept = [d for d in found if d[2] == 0 or not any(e[0] <= d[0] and d[1] <= e[1] and e != d and (e[2] < d[2] or (e[2] == d[2] and ((e[1] - e[0]) > (d[1] - d[0]) or e[3] < d[3]))) for e in found)]
    return len(words), sorted((s, e, rules[n].label, p, n) for s, e, p, n in kept)


LICENSED = [
    (1, "Released under the MIT License.", {"mit"}),
    (2, "der Hund mit der Katze, mit allen", set()),
    (3, "SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3"}),
    (4, "Licensed under CC BY-NC-SA 4.0", {"cc-by-nc", "cc-by-nc-sa"}),
    (5, "the GNU Lesser General Public License, version 2.1 or Apache License, Version 2.0", {"lgpl-2.1", "apache-2"}),
    (6, None, set()),
    (7, "", set()),
    (BIG, "under the mit license " * 3, {"mit"}),
    (None, "under the mit license", {"mit"}),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy; All rights reserved", {"mit", "proprietary"}),
]


def test_licenses(spark):
    rules = licenses.signatures()
    assert len(rules) > 300 and all(r.regex.count("<") == 1 for r in rules)
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t, _ in LICENSED] * 2, "doc_id long, text string, found string, words_text string, N_WORDS string")
    out = licenses.scan_licenses(docs)
    assert set(out.columns) == {"doc_id", "text", "found", "words_text", "n_words", "detections"}
    by_text = {}
    for r in out.collect():
        assert r.found == r.words_text == "clash"
        n, kept = scanned(r.text, rules)
        assert r.n_words == n and [(d.start, d.end, d.label, d.priority, d.rule) for d in r.detections] == sorted(kept, key=lambda d: (d[0], -d[1], d[3], d[4])), r.text
        by_text[r.text] = {d.label for d in r.detections}
    assert by_text == {t: labels for _, t, labels in LICENSED}
    digest = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.digest(out).collect()}
    assert {(BIG, 12, 3, 0, 8, "mit"), (None, 4, 1, 0, 0, "mit"), (6, 0, 0, None, None, ""), (2, 7, 0, None, None, "")} <= digest
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_in_one_long_text(spark):
    text = "Licensed under the Apache License, Version 2.0. gnu gpl words between " * 30_000
    row = licenses.digest(licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_base, row.first_word, row.last_word, row.n_words) == (30_000, 3, 12 * 29_999 + 3, 12 * 30_000)


# --- Operator 13 --------------------------------------------------------------------------------------------------


def mined(rows, least, keep, inside):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in cand.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in cand.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(left)[:keep])}
    return out


def test_collocations(spark):
    import random

    rng = random.Random(3)
    words = ["a", "B", "the", "of", "größe", "日本", "x1", " y", "-", "\U0001f600"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), ("en", "big " * 500 + "x"), ("xx", "rare words only")] + [("de", "same text here")] * 12
    docs = spark.createDataFrame([(x, t, "clash", "clash", 1) for x, t in rows], "lang string, text string, phrase string, w1 string, n int").repartition(4)
    for keep, bounds in ((2000, {}), (7, {"words": 3, "pairs": 2, "dense": 50, "buffer": 40, "size": 16}), (2000, {"words": 40, "pairs": 8, "buffer": 200}), (2000, {"words": 0, "pairs": 0, "size": 8})):
        got = collocations.mine_collocations(docs, keep=keep, **bounds).collect()
        want = mined(rows, 10, keep, 50)
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    assert collocations.mine_collocations(docs.limit(0)).count() == 0


def test_cells_count_alike():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (rng.zipf(1.3, 20_000) % 5000 for _ in range(2))
    cell = collocations.cells(3, a, b)
    code, x, y = collocations.ids_of(cell)
    assert (code == 3).all() and (x == a).all() and (y == b).all()
    keys, n = np.unique(cell, return_counts=True)
    for dense in (1, 100, 10**9):
        got, m = collocations.counted(cell, dense)
        order = np.argsort(got)
        assert (got[order] == keys).all() and (m[order] == n).all()
