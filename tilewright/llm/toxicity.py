"""Toxicity by a weighted lexicon (operator 8).

Texts are folded (case, width, homoglyphs, digits that stand for letters), an Aho-Corasick automaton finds the
lexicon's words, stems and exception phrases in one pass, and the summed weights are normalised by length.
Weights and the final curve are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sliced

#: Documented bound: labelled rows (in expectation) that the lexicon and the curve are learned from.
SAMPLE = 20000
THRESHOLD = 0.3
STEMS = (3, 4, 5, 6, 7, 8)
#: Clean rows that a phrase around a lexicon word needs to become an exception, and how many times the toxic ones they must be (half a row is added to both).
LEAST_CLEAN, CLEAN_ODDS = 3, 8
LEAST_ODDS = math.log(20)

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ⅼ": "l",
}
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_ODD = re.compile(r"[^\x00-\x7fÀ-ɏ]")
#: A run of letters, digits and signs with a digit or sign in it. Possessive throughout, so no character is read again.
_MIXED = re.compile(r"(?<![^\W_])(?<![@$])[^\W\d_]*+[\d@$](?:[^\W_]|[@$])*+")
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE, _AFTER = re.compile(r"[^\W\d_]{1,40} \Z"), re.compile(r" [^\W\d_]{1,40}")


def fold(text: str) -> str:
    """Lower case; compatibility forms, look-alike letters and letter-like digits inside words become plain letters."""
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_GLYPHS)
    else:
        text = text.lower()
    return _MIXED.sub(_letters, text)


def _letters(run: re.Match) -> str:
    """Digits and signs up to the run's last letter as the letters that they stand for."""
    s = run.group()
    end = len(s)
    while end and (s[end - 1] in "@$" or s[end - 1].isdecimal()):
        end -= 1
    return s[:end].translate(_LEET) + s[end:]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)  # phrases; what they cover does not count
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, terms in (("exception", self.exceptions), ("stem", self.stems), ("word", self.words)):
            for t, w in terms.items():
                if t:
                    a.add_word(t, [*a.get(t, []), (kind, t, w)])
        if len(a):
            a.make_automaton()
        return a


def weight(folded: str, automaton) -> float:
    """Summed weight of the distinct matches that stand at word bounds and under no exception phrase."""
    if not len(automaton):
        return 0.0
    hits, covered = [], []
    last = len(folded) - 1
    for end, found in automaton.iter(folded):
        for kind, term, w in found:
            start = end - len(term) + 1
            if start and folded[start - 1].isalpha():
                continue
            if kind != "stem" and end < last and folded[end + 1].isalpha():
                continue
            if kind == "exception":
                covered.append((start, end))
            else:
                hits.append((start, end, term, w))
    covered.sort()
    hits.sort()
    kept, at, furthest = {}, 0, -1
    for start, end, term, w in hits:
        while at < len(covered) and covered[at][0] <= start:
            furthest = max(furthest, covered[at][1])
            at += 1
        if end > furthest:
            kept[term] = w
    return sum(kept.values())


def phrases(folded: str, automaton) -> set[str]:
    """Two and three words in a row, single spaces between, around every match that counts on its own."""
    out: set[str] = set()
    last = len(folded) - 1
    for end, found in automaton.iter(folded) if len(automaton) else ():
        for kind, term, _ in found:
            start = end - len(term) + 1
            if kind == "exception" or (start and folded[start - 1].isalpha()) or (kind == "word" and end < last and folded[end + 1].isalpha()):
                continue
            stop = end + 1
            while stop <= last and folded[stop].isalpha():
                stop += 1
            before, after = _BEFORE.search(folded, 0, start) if folded[max(0, start - 1) : start] == " " else None, _AFTER.match(folded, stop)
            a = before.start() if before else start
            b = after.end() if after else stop
            out |= {folded[x:y] for x, y in ((a, stop), (start, b), (a, b)) if y - x > stop - start}
    return out


def features(folded: str, automaton) -> tuple[float, float]:
    w = weight(folded, automaton)
    return (1.0 if w > 0 else 0.0), (w / math.log2(2 + len(folded.split())) if w > 0 else 0.0)


def score_of(f: tuple[float, float], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * f[0] + curve[2] * f[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(folded: str) -> set[str]:
    words = set(_WORD.findall(folded))
    return {f"w{w}" for w in words if len(w) > 2} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n}


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose smoothed log-odds reach the least; a stem gives way to the single word that makes it up."""
    def odds(t: str) -> float:
        return math.log((toxic.get(t, 0) + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))

    good = {t: w for t, n in toxic.items() if n >= least and (w := odds(t)) >= LEAST_ODDS}
    words = {t[1:]: w for t, w in good.items() if t[0] == "w"}
    stems: dict[str, float] = {}
    main: Counter[str] = Counter()
    for t in words:
        for n in STEMS:
            main[t[:n]] = max(main[t[:n]], toxic[f"w{t}"])
    for t in sorted((t[1:] for t in good if t[0] == "s"), key=len):
        if main[t] < 0.8 * toxic[f"s{t}"] and not any(t[:n] in stems for n in STEMS if n < len(t)):
            stems[t] = good[f"s{t}"]
    words = {t: w for t, w in words.items() if not any(t[:n] in stems for n in STEMS)}
    return words, stems


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 25) -> tuple[float, float, float]:
    """Logistic regression with a small ridge on points that stand for n rows each, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (n * (y - p)) - 0.1 * beta
        beta = beta + np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(3), grad)
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def fit_lexicon(labelled: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = (), text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns from about ``sample`` of the labelled rows given, picked by a hash of the text.

    Words and stems come first, then exception phrases: contexts of their matches that clean rows have more often, in
    addition to those given. Rows without text or label teach nothing. With labels of one kind only, every text scores low.
    """
    rows = labelled.select(F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("y"), F.xxhash64(F.col(text_col)).alias("h")).where("text is not null and y is not null")
    n = rows.count()

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": [fold(t) for t in pdf["text"]], "y": pdf["y"].to_numpy()})

    picked = rows.where((F.col("h") / 2.0**64 + 0.5) < min(1.0, sample / max(1, n))).select("text", "y").mapInPandas(folded, "text string, y int")
    # Folded once, read three times.
    picked = materialize(picked)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, int]] = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame({"term": np.array([t for t, _ in seen], dtype=object), "y": [y for _, y in seen], "n": list(seen.values())}, columns=["term", "y", "n"])
            seen.clear()
            return out

        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                seen.update((x, int(y)) for x in (*_terms(t), ""))
                if len(seen) > 200_000:
                    yield flushed()
        if seen:
            yield flushed()

    counted = picked.mapInPandas(count, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    sizes = counted.where("term = ''").collect()
    if not sizes or not sizes[0]["toxic"] or not sizes[0]["clean"]:
        release(picked)
        return Lexicon()
    n_toxic, n_clean = sizes[0]["toxic"], sizes[0]["clean"]
    least = max(5, round(0.015 * n_toxic))
    kept = counted.where((F.col("toxic") >= least) & (F.col("toxic") * (n_clean + 1) > 4 * F.col("clean") * (n_toxic + 1)) & (F.col("term") != "")).collect()
    toxic, clean = {r["term"]: r["toxic"] for r in kept}, {r["term"]: r["clean"] for r in kept}
    words, stems = choose(toxic, clean, n_toxic, n_clean, least)
    plain = Lexicon(words, stems)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, seen = plain.automaton(), Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"]):
                seen.update((p, int(y)) for p in phrases(t, automaton))
        if seen:
            yield pd.DataFrame({"term": np.array([t for t, _ in seen], dtype=object), "y": [y for _, y in seen], "n": list(seen.values())}, columns=["term", "y", "n"])

    told = picked.mapInPandas(contexts, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    learned = told.where((F.col("clean") >= LEAST_CLEAN) & (F.col("clean") + 0.5 >= CLEAN_ODDS * (F.col("toxic") + 0.5))).collect()
    lexicon = Lexicon(words, stems, dict.fromkeys([*(fold(e) for e in exceptions), *sorted(r["term"] for r in learned)], 0.0))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            f = [features(t, automaton) for t in pdf["text"]]
            yield pd.DataFrame({"a": [round(v[0], 1) for v in f], "b": [round(v[1], 2) for v in f], "y": pdf["y"].to_numpy()})

    # Rounded values repeat: their counts are what the driver gets, however often one text was picked.
    points = picked.mapInPandas(measured, "a double, b double, y int").groupBy("a", "b", "y").count().orderBy("a", "b", "y").toPandas()
    lexicon.curve = fit_curve(points[["a", "b"]].to_numpy(), points["y"].to_numpy(), points["count"].to_numpy(dtype=float))
    release(picked)
    return lexicon


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts of about ``sample`` labelled documents, stored; the ids are picked first, so that no other text moves.

    The picked labels are bounded by the parameter and therefore broadcast.
    """
    rows = labels.select(id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = rows.where((F.xxhash64(id_col) / 2.0**64 + 0.5) < min(1.0, sample / max(1, rows.count())))
    return materialize(docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(text_col, label_col))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row; null texts count as empty.

    Given columns of these names, or of those in ``names``, are replaced; all others are kept.
    """
    value, verdict = names
    schema = docs.drop(*names).withColumn(value, F.lit(0.0)).withColumn(verdict, F.lit(0)).schema
    text_at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in sliced(batches):
            scores = np.array([score_of(features(fold(t), automaton) if isinstance(t, str) else (0.0, 0.0), lexicon.curve) for t in b.column(text_at).to_pylist()], dtype=float)
            # The given columns pass as they are.
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return docs.drop(*names).mapInArrow(run, schema)
