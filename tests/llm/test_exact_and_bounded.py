"""Ids above 2^53 beside nulls, texts that once took quadratic or exponential time, and tables of very few rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import collocations, flac, jaccard, langid, lexical, licenses, packing, pieces, registry, toxicity

BIG = 2**60 + 1
ROWS = [(BIG, "the cat sat on the mat and ran", BIG + 2), (None, "another text of words altogether", None), (BIG + 1, "the cat sat on the mat and ran", BIG + 4), (BIG, "the cat sat on the mat and ran", None)]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, other long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


def test_ids_beside_nulls(spark, big):
    import public_tokenizers

    want = [BIG, BIG, BIG + 1, None]
    assert ids(packing.pack_documents(big, registry.vocabulary())) == want
    assert ids(pieces.encode_column(big, public_tokenizers.path("piece_bpe_32k.model"))) == want
    media = flac.encode_column(big)
    assert ids(flac.media_digest(media)) == want and ids(flac.decode_column(media)) == want
    joined = jaccard.jaccard_components(big)
    assert ids(joined) == want and {r.component_id for r in joined.where("doc_id IS NOT NULL").collect()} == {BIG}
    assert [r.doc_id for r in lexical.ranked_search(big, spark.createDataFrame([(BIG, "cat")], "item_id long, text string")).collect()] == [BIG, BIG, BIG + 1]
    assert ids(licenses.scan_licenses(big)) == want
    assert {(r.phrase, r.a) for r in collocations.mine_collocations(big.withColumn("lang", F.lit("en")), least=3).where("phrase LIKE 'the cat%'").collect()} == {("the cat sat", 3)}


def test_carried_columns_beside_nulls(spark, big):
    told = langid.identify_languages(big, langid.fit_language_model(big.withColumn("lang", F.lit("en"))))
    scored = toxicity.score_toxicity(big, toxicity.Lexicon({"cat": 1.0}))
    for df in (told, scored):
        assert ids(df) == [BIG, BIG, BIG + 1, None] and ids(df, "other") == [BIG + 2, BIG + 4, None, None]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_labelled_rows(spark, n):
    texts = [("en", "the cat and the dog"), ("de", "der Hund und die Katze")]
    known = spark.createDataFrame([(i, texts[i % 2][1] + f" {i}", texts[i % 2][0]) for i in range(n)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(known)
    out = {r.doc_id: r.lang_pred for r in langid.identify_languages(known, model).collect()}
    assert out == {i: texts[i % 2][0] for i in range(n)}
    assert toxicity.fit_lexicon(known.withColumn("toxic", F.lit(1))).words == {}


def test_folding_and_weights_take_linear_time():
    start = time.perf_counter()
    assert toxicity.fold("a" + "1" * 10**6) == "a" + "1" * 10**6
    assert toxicity.fold(("a" + "1" * 50) * 20_000 + "b 1d10t h3LL0 12 4@$ 9x9x9 _1a").endswith(" idiot hell0 12 4@$ 9x9x9 _ia")
    lexicon = toxicity.Lexicon({"ass": 2.0, "bad": 1.0}, {}, {"bad luck": 0.0})
    automaton = lexicon.automaton()
    assert toxicity.weight("bad luck " * 10**6, automaton) == 0 and toxicity.weight("bad luck " * 10 + "bad day", automaton) == 1
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("n, size, most", [(2000, 4_000, 60), (1, 8_000_000, 160)])
def test_shingles_take_bounded_memory(n, size, most):
    import tracemalloc

    import pandas as pd

    texts = pd.Series([("".join(f"w{i * j % 977} " for j in range(size // 5)))[:size] for i in range(1, n + 1)])
    tracemalloc.start()
    try:
        sets = jaccard.sets_of(texts, 5)
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    assert len(sets) == n and peak < most


def test_words_across_windows_hash_alike(monkeypatch):
    texts = ["one two three " + "x" * 500 + " four five six", None, "", "ä b  c d e f\tg " * 20, "one"]
    whole = jaccard.shingle_sets(texts, 3)
    monkeypatch.setattr(jaccard, "WINDOW", 4)
    monkeypatch.setattr(jaccard._Powers, "up", jaccard._Powers.up[:1])
    monkeypatch.setattr(jaccard._Powers, "down", jaccard._Powers.down[:1])
    assert [s.tolist() for s in jaccard.shingle_sets(texts, 3)] == [s.tolist() for s in whole]


def test_shared_first_tokens():
    """Linked sets share at least so many first tokens, and only linked ones need to."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 200, 480]:
        for percent in (80, 90):
            for _ in range(20):
                a = np.unique(rng.integers(0, 10**9, n))
                b = np.unique(np.concatenate((a[rng.random(a.size) < rng.choice([0.9, 0.95, 1])], rng.integers(0, 10**9, rng.integers(0, n // 8 + 2)))))
                if not b.size or 100 * np.intersect1d(a, b).size < percent * np.union1d(a, b).size:
                    continue
                first = [s[: s.size - jaccard._least(s.size, percent) + min(8, jaccard._least(s.size, percent))] for s in (a, b)]
                both = np.intersect1d(*first)
                assert both.size >= jaccard._shared_least(a.size, b.size, percent, 8) >= min(8, jaccard._least(a.size, percent))
                assert jaccard._in_reach(a.size, np.searchsorted(a, both), b.size, np.searchsorted(b, both), percent).all()


def test_texts_do_not_travel_once_a_list(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1]))], "doc_id long, text string")
    sets = {r.doc_id: [int(x) % 1000 for x in jaccard.shingle_sets([r.text], 3)[0]] for r in texts.collect()}
    firsts = spark.createDataFrame([(i, len(s), s[:28]) for i, s in sets.items()], "doc_id long, n int, first array<int>")
    shared = spark.createDataFrame([(k, i, i, sets[i].index(x)) for k, x in enumerate(t for t in sets[1][:20] if t in sets[2]) for i in sets if x in sets[i][:28]], "list long, doc_id long, label long, pos int")
    stored, keep = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    found = jaccard.compared_blocks(shared.where("doc_id = 1"), shared, firsts, texts, 3, 90, 8, 512)
    assert {tuple(sorted(r)) for r in found.collect()} == {(1, 2)} and shared.where("doc_id = 2").count() > 10
    sent = stored[-1]  # rows that send their texts
    assert "is_some" in sent.columns and sent.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("grouped", [3, 1 << 19])
def test_packed_lists(spark, grouped):
    rng = random.Random(5)
    rows = [(i, 10, [rng.randrange(-(2**63), 2**63) if rng.random() < 0.5 else rng.randrange(4) for _ in range(6)], 5) for i in (-(2**62), 3, BIG, BIG + 1, 2**63 - 1)]
    rows = [(i, n, list(dict.fromkeys(first)), min(k, len(set(first)))) for i, n, first, k in rows] + [(9, 1, [], 0)]
    want = {}
    for i, n, first, k in rows:
        for at, token in enumerate(first[:k]):
            want.setdefault(token, set()).add((n, i, at))
    got = {}
    for r in jaccard.rare_lists(spark.createDataFrame(rows, "doc_id long, n int, first array<long>, rare int"), 2, grouped).collect():
        assert r.size == len(want[r.token]) and 0 < len(r.l) <= 2
        got.setdefault(r.token, []).extend(tuple(x) for x in r.l)
    assert {t: sorted(l) for t, l in got.items()} == {t: sorted(l) for t, l in want.items() if len(l) > 1}
