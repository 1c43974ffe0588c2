"""Language identification by string kernels (operator 3).

Blended-spectrum presence kernel: for n = 1, 2, 3 the share of common character n-grams, |x and l| / sqrt(|x| |l|),
averaged. Landmarks (Nystroem) stand for the training texts, and one-versus-rest kernel ridge regression is
solved on their features. Tasks turn the training texts into rows of kernel values and sum their products, so the
driver gets landmarks and matrices of fixed size, no texts. A batch of texts is scored as products of its presence matrices with the landmarks'
weights, so a text costs the same whatever the number of landmarks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Documented bounds of the training sample: texts per language (in expectation), landmarks per language and in all,
#: and the length up to which texts are preferred as landmarks (training and prediction read whole texts of any length).
PER_LANG, LANDMARKS, ALL_LANDMARKS, MARK_CHARS = 400, 64, 512, 20_000
RIDGE = 1e-2
LETTERS = 126  # letters with codes of their own; 127 stands for all others, 0 for what is no letter
WIDTH = 128
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for others."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


def letters_in(text: str) -> np.ndarray:
    """Distinct letters of a whole text, as lower-case code points."""
    cp = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    out = np.unique(_lower_letters()[np.minimum(cp, 0xFFFF)])
    return out[out > 0]


def code_table(alphabet: np.ndarray) -> np.ndarray:
    low = _lower_letters()
    code = np.full(0x10000, LETTERS + 1, dtype=np.uint8)
    code[0] = 0
    code[alphabet] = np.arange(1, alphabet.size + 1)
    return code[low]


def grams(texts: list[str], table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Row and code of every 1-, 2- and 3-gram of whole texts; runs of other characters count as one gap."""
    joined = np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    code = table[np.minimum(joined, 0xFFFF)]
    keep = np.ones(code.size, dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
    code, row = code[keep].astype(np.int32), row[keep]
    out_r, out_c, c = [], [], code
    for n in (1, 2, 3):
        if n > 1:
            c = c[: code.size - n + 1] * WIDTH + code[n - 1 :]
        c = c[: max(0, code.size - n + 1)]
        same = row[: c.size] == row[n - 1 :]
        good = same & (c > 0)
        out_r.append(row[: c.size][good])
        out_c.append(c[good])
        c = c if n == 1 else c
    return out_r, out_c


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    alphabet: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    vocabulary: list[np.ndarray] = field(default_factory=list)  # by n: sorted codes that landmarks hold
    weights: list[np.ndarray] = field(default_factory=list)  # by n: code x language

    @functools.cached_property
    def table(self) -> np.ndarray:
        return code_table(self.alphabet)

    @functools.cached_property
    def places(self) -> list[np.ndarray]:
        out = []
        for n, v in enumerate(self.vocabulary, 1):
            at = np.full(WIDTH**n, -1, dtype=np.int32)
            at[v] = np.arange(v.size)
            out.append(at)
        return out

    def decide(self, texts: list[str]) -> np.ndarray:
        """Ridge outputs, text x language; all zero for a text without letters."""
        total = np.zeros((len(texts), len(self.langs)))
        rows, codes = grams(texts, self.table)
        for r, c, at, w, n in zip(rows, codes, self.places, self.weights, (1, 2, 3)):
            size = _distinct(r, c, len(texts), n)
            p = at[c]
            hit = p >= 0
            present = np.zeros((len(texts), w.shape[0]), dtype=np.float32)
            present[r[hit], p[hit]] = 1
            total += (present @ w) / np.sqrt(np.maximum(size, 1))[:, None]
        return total


def _distinct(r: np.ndarray, c: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """Distinct codes of each row."""
    if n < 3:
        seen = np.zeros((n_rows, WIDTH**n), dtype=bool)
        seen[r, c] = True
        return seen.sum(axis=1)
    out = np.zeros(n_rows)
    cuts = np.searchsorted(r, np.arange(n_rows + 1))
    seen = np.zeros(WIDTH**3, dtype=bool)
    for i in range(n_rows):
        own = c[cuts[i] : cuts[i + 1]]
        seen[own] = True
        first = np.empty(own.size, dtype=np.int32)
        place = _scratch()
        place[own] = np.arange(own.size, dtype=np.int32)
        first = place[own] == np.arange(own.size)
        out[i] = first.sum()
        seen[own] = False
    return out


@functools.lru_cache(maxsize=1)
def _scratch() -> np.ndarray:
    return np.zeros(WIDTH**3, dtype=np.int32)


def presence(texts: list[str], table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By n: row and code of each text's distinct n-grams, and their number a text (1 at least)."""
    out = []
    for n, r, c in zip((1, 2, 3), *grams(texts, table)):
        pairs = np.unique(r.astype(np.int64) * WIDTH**n + c)
        r, c = pairs // WIDTH**n, pairs % WIDTH**n
        out.append((r, c, np.maximum(np.bincount(r, minlength=len(texts)), 1)))
    return out


class Landmarks:
    """Presence of n-grams in the landmark texts, and the kernel of any texts with them."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.table, self.size = table, len(texts)
        self.vocabulary: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        for r, c, size in presence(texts, table):
            vocabulary = np.unique(c)
            mark = np.zeros((vocabulary.size, len(texts)), dtype=np.float32)
            mark[np.searchsorted(vocabulary, c), r] = 1
            self.vocabulary.append(vocabulary)
            self.marks.append(mark / (3 * np.sqrt(size)))

    def kernel(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for (r, c, size), vocabulary, mark in zip(presence(texts, self.table), self.vocabulary, self.marks):
            at = np.minimum(np.searchsorted(vocabulary, c), max(0, vocabulary.size - 1))
            hit = vocabulary[at] == c if vocabulary.size else np.zeros(c.size, dtype=bool)
            present = np.zeros((len(texts), vocabulary.size), dtype=np.float32)
            present[r[hit], at[hit]] = 1
            out += (present @ mark) / np.sqrt(size)[:, None]
        return out


def fit_language_model(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", ridge: float = RIDGE) -> Model:
    """Fits on a bounded sample of the labelled rows given: about ``per_lang`` a language, by a hash of id and text.

    Rows without text or language teach nothing. Without any such row every prediction is ``und``. The driver gets
    the landmarks (at most ``ALL_LANDMARKS`` texts, the shorter ones of the sample where there are enough) and sums
    of kernel products (landmarks x landmarks, landmarks x languages) a task.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    picked = materialize(rows.where((F.col("h") / 2.0**64 + 0.5) < share[F.col("lang")]))
    each = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    short = F.greatest(F.length("text"), F.lit(MARK_CHARS))
    chosen = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(short, "h", "text"))).where(F.col("k") <= each).orderBy("lang", "k").select("text").collect()

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(0x10000, dtype=np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                n[letters_in(t)] += 1
        yield pd.DataFrame({"code": np.flatnonzero(n), "n": n[n > 0]})

    common = picked.select("text").mapInPandas(letters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(LETTERS).collect()
    model = Model(names, np.array([r["code"] for r in common], dtype=np.int64))
    marks = Landmarks([r["text"] for r in chosen], model.table)
    values, vectors = np.linalg.eigh(marks.kernel([r["text"] for r in chosen]))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    known = docs.sparkSession.sparkContext.broadcast(marks)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        by = {x: (np.zeros((m.size, m.size)), np.zeros(m.size), 0) for x in names}
        for whole in batches:
            for at in range(0, len(whole), 16):
                part = whole.iloc[at : at + 16]
                k = m.kernel(part["text"].tolist())
                for x in part["lang"].unique():
                    own = k[(part["lang"] == x).to_numpy()]
                    by[x] = by[x][0] + own.T @ own, by[x][1] + own.sum(axis=0), by[x][2] + len(own)
        seen = {x: v for x, v in by.items() if v[2]}
        if seen:
            yield pd.DataFrame({"lang": list(seen), "square": [v[0].tobytes() for v in seen.values()], "total": [v[1].tobytes() for v in seen.values()], "n": [v[2] for v in seen.values()]}, columns=["lang", "square", "total", "n"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.add.reduce([np.frombuffer(x) for x in pdf[c]]).tobytes()
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "square": [add("square")], "total": [add("total")], "n": [int(pdf["n"].sum())]})

    schema = "lang string, square binary, total binary, n long"
    sums = picked.select("text", "lang").repartition(8).mapInPandas(products, schema).groupBy("lang").applyInPandas(added, schema).collect()
    release(picked)
    # Every language weighs the same.
    gram, target = ridge * np.eye(marks.size) / marks.size, np.zeros((marks.size, len(names)))
    for r in sums:
        gram += root.T @ (np.frombuffer(r["square"]).reshape(marks.size, marks.size) / r["n"]) @ root
        target[:, names.index(r["lang"])] = root.T @ np.frombuffer(r["total"]) / r["n"]
    beta = root @ np.linalg.solve(gram, target)
    model.vocabulary = marks.vocabulary
    model.weights = [(m @ beta).astype(np.float32) for m in marks.marks]
    return model


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 128, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1), or what ``names`` calls them, to every row; all given columns but those two are kept.

    Null texts and texts without a letter are ``und`` with score 0. Whole texts are read.
    """
    langs = np.array([*model.langs, UNDETERMINED], dtype=object)
    pred, certainty = names
    schema = docs.drop(*names).withColumn(pred, F.lit("")).withColumn(certainty, F.lit(0.0)).schema
    text_at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                texts = [t if isinstance(t, str) else "" for t in part.column(text_at).to_pylist()]
                letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
                if model.langs:
                    out = model.decide(texts)
                    out = np.exp(8 * (out - out.max(axis=1, keepdims=True)))
                    out /= out.sum(axis=1, keepdims=True)
                    best, score = out.argmax(axis=1), out.max(axis=1)
                else:
                    best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
                told = langs[np.where(letters & bool(model.langs), best, len(model.langs))]
                # The given columns pass as they are.
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told, pa.string()), pa.array(np.where(letters, score, 0.0))], names=schema.names)

    return docs.drop(*names).mapInArrow(run, schema)
