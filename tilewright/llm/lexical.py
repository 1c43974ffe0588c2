"""Ranked lexical search by one scan over the texts (operator 11).

The distinct terms of all items form an Aho-Corasick automaton whose patterns carry a blank on both sides, so that it
only matches whole terms. Texts are read twice and never indexed: the first scan gives the corpus sizes and document
frequencies, the second counts the terms of each text with the automaton, maps them to items and keeps the best
documents of every item a task. What is shuffled are counts a term and at most ``k`` rows an item and task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items are searched in blocks of about so many pairs of item and term; a block's automaton and lists are broadcast.
BLOCK_PAIRS = 131_072
#: The best rows of tasks meet in so many parts an item first, so that the last step reads few rows however many tasks ran.
PARTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of UTF-8: A-Z become a-z, ASCII that is no letter or digit becomes a blank, all else (other scripts too) stays.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: bytes) -> str:
    """Terms in lower case (A-Z only) with single or repeated blanks between and a blank at either end."""
    return f" {text.translate(_TABLE).decode('utf-8', 'replace')} "


def terms_of(normalised: str) -> list[str]:
    return [t for t in normalised.split(" ") if t]


def automaton_of(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(f" {t} ", i)
    if len(a):
        a.make_automaton()
    return a


def counts_of(normalised: str, automaton) -> Counter[int]:
    """Occurrences of each of the automaton's terms."""
    return Counter(map(itemgetter(1), automaton.iter(normalised))) if len(automaton) else Counter()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term); rows that share an id are one item, also those without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(normal(t)))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([t for x in found for t in x], pa.string())], names=["item_id", "term"])

    given = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    kind = given.schema["item_id"].dataType.simpleString()
    return given.mapInArrow(run, f"item_id {kind}, term string").distinct()


def _corpus(texts: DataFrame, shared) -> dict[int, int]:
    """Document frequency by term number; -1 has the documents with a term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = automaton_of(shared.value), Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                s = normal(text)
                n = len(terms_of(s))
                if n:
                    seen[-1] += 1
                    seen[-2] += n
                    seen.update(counts_of(s, automaton).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return {r["term"]: r["n"] for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _best(texts: DataFrame, shared, lists, n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        weights, starts, owners = lists.value
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(n_items)]
        least = np.ones(n_items)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = normal(text)
                counts = counts_of(s, automaton)
                if not counts:
                    continue
                m = 10 + 90 * len(terms_of(s)) * n_docs // n_terms
                found = np.fromiter(counts.keys(), np.int64, len(counts))
                part = np.array([1_000_000_000 * tf // (1000 * tf + 8 * m) for tf in counts.values()], dtype=np.float64) * weights[found]
                sizes = starts[found + 1] - starts[found]
                at = np.repeat(starts[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                # Sums of whole numbers far below 2^53: exact in doubles.
                scores = np.bincount(owners[at], weights=np.repeat(part, sizes), minlength=n_items)
                for i in np.flatnonzero(scores >= least).tolist():
                    key = (int(scores[i]), doc_id is not None, -doc_id if doc_id is not None else 0)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], key)
                    elif key > heaps[i][0]:
                        heapq.heapreplace(heaps[i], key)
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        rows = [(i, -d if known else None, score) for i, heap in enumerate(heaps) for score, known, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return texts.mapInArrow(run, "item long, doc_id long, score long").withColumn("part", F.spark_partition_id() % PARTS)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest score above 0.

    Terms are maximal runs of letters and digits of ASCII and of anything beyond it, A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums weight * (1e9 tf div (1000 tf + 8 m)) over an item's
    distinct terms, with m = 10 + 90 n N div L. Ties go to the smaller id, null ids last; repeated rows are documents of
    their own and equal ones may both be listed. Null and empty texts have no terms; items without terms, an empty table of
    documents or of items give no rows. Only the named columns are read. Texts of any length are scanned whole, in one task.
    """
    spark = docs.sparkSession
    pairs = item_terms(items, item_col, item_text).cache()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    n_blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for number in range(n_blocks):
        rows = pairs.where(block == number).collect()  # about block_pairs rows, and no more than one item's terms above that
        ids = {item: i for i, item in enumerate(dict.fromkeys(r["item_id"] for r in rows))}
        terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        shared = spark.sparkContext.broadcast(list(terms))
        seen = _corpus(texts, shared)
        n_docs, n_terms = seen.get(-1, 0), seen.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.float64)
        owner = sorted((terms[r["term"]], ids[r["item_id"]]) for r in rows)
        starts = np.searchsorted(np.array([t for t, _ in owner], dtype=np.int64), np.arange(len(terms) + 1))
        lists = spark.sparkContext.broadcast((weights, starts, np.array([i for _, i in owner], dtype=np.int64)))
        found = _best(texts, shared, lists, len(ids), n_docs, n_terms, k)
        names = spark.createDataFrame([(i, item) for item, i in ids.items()], f"item long, item_id {pairs.schema['item_id'].dataType.simpleString()}")
        best = found
        for keys in (("item", "part"), ("item",)):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # One row an item of the block: bounded like the block itself.
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    pairs.unpersist()
    return out


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def oracle_sql(k: int = 10) -> str:
    """The same in DuckDB SQL, over an index of all terms instead of a scan."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) u GROUP BY ALL),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) u),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM items JOIN df USING (term), corpus),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN size USING (r), corpus GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {k}
"""
