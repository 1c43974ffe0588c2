"""Exact top-k inner products by a bit-sliced index (operator 4).

Vectors are quantised and dealt into blocks. A block keeps one bitmap per attribute and bit; a query's score
is summed slice by slice with full adders over whole bitmaps (64 rows a machine word). The best rows are read
from the most significant slice downward, and the rows that tie on the boundary are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a chunk: what one task holds at a time, at most.
BLOCK, CHUNK = 16384, 4096
SCALE = 256


def slices_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (attribute, bit, word) of values less their column minimum, and the number of bits."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    words = -(-values.shape[0] // 64)
    padded = np.zeros((words * 64, values.shape[1]), dtype=np.uint64)
    padded[: values.shape[0]] = values
    out = np.empty((values.shape[1], bits, words), dtype=np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T.copy(), axis=1, bitorder="little").view(np.uint64)
    return out, bits


def add_slices(levels: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Carry-save addition: bitmaps by weight to one bitmap per weight, least significant first."""
    out, w = [], 0
    while levels:
        column = levels.pop(w, [])
        carries = levels.get(w + 1, [])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            t = a ^ b
            column.insert(0, t ^ c)
            carries.append((a & b) | (t & c))
        if len(column) == 2:
            a, b = column
            column = [a ^ b]
            carries.append(a & b)
        if carries:
            levels[w + 1] = carries
        out.append(column[0] if column else None)
        w += 1
    return out


def top_rows(total: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows surely among the k best, and the rows tied on the boundary, both as bitmaps."""
    sure, tied = np.zeros_like(alive), alive.copy()
    have = 0
    for slice_ in reversed(total):
        if slice_ is None:
            continue
        ones = tied & slice_
        n = int(np.bitwise_count(ones).sum())
        if have + n > k:
            tied = ones
        else:
            sure, have, tied = sure | ones, have + n, tied & ~slice_
            if have == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def rows_in(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows of one block; ids ascending, so ties end with the smaller id."""
    low = values.min(axis=0)
    slices, bits = slices_of(values - low)
    words = slices.shape[2]
    everyone = np.zeros(words * 64, dtype=np.uint8)
    everyone[: ids.size] = 1
    everyone = np.packbits(everyone, bitorder="little").view(np.uint64)
    flipped = ~slices
    out = []
    for qid, q in zip(query_ids, queries):
        levels: dict[int, list[np.ndarray]] = {}
        # A negative weight adds the complement of the attribute: the same order, and no signed slices.
        for j in np.flatnonzero(q):
            source, weight = (slices if q[j] > 0 else flipped)[j], abs(int(q[j]))
            for a in range(weight.bit_length()):
                if weight >> a & 1:
                    for b in range(bits):
                        levels.setdefault(a + b, []).append(source[b])
        alive = everyone
        if (own := ids == qid).any():
            mask = np.zeros(words * 64, dtype=np.uint8)
            mask[: ids.size] = own
            alive = everyone & ~np.packbits(mask, bitorder="little").view(np.uint64)
        sure, tied = top_rows(add_slices(levels), alive, k)
        best = rows_in(sure)
        rows = np.concatenate([best, rows_in(tied)[: max(0, k - best.size)]])
        for r, s in zip(rows, values[rows] @ q):
            out.append((int(qid), int(ids[r]), int(s)))
    return out


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The k best other rows of each query: query_id, rank, vec_id, score.

    Components become floor(256 * x). Rows with a null id, a null or empty vector, or a null or non-finite component
    take no part on either side. A row whose id is the query's own is no candidate; repeated ids are candidates
    each. Missing trailing components count as 0. Scores must fit 64 bits. Empty sides give an empty result.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(
            F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))

    rows, asked = clean(vectors), clean(queries)
    n_queries = asked.count()
    blocks = max(1, -(-rows.count() // block))
    # A row travels once a chunk, so chunks are as large as memory allows, unless that leaves tasks without work.
    wanted = -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    chunks = max(1, -(-n_queries // chunk), min(wanted, -(-n_queries // 128)))

    def dealt(df: DataFrame, mine: str, parts: int, other: str, others: int, is_query: bool) -> DataFrame:
        return df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.lit(is_query).alias("is_query")).select("block", "chunk", "is_query", "id", "v")

    both = dealt(rows, "block", blocks, "chunk", chunks, False).unionByName(dealt(asked, "chunk", chunks, "block", blocks, True))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        width = pdf["v"].map(len).max()
        part = {}
        for flag, side in pdf.groupby("is_query"):
            side = side.sort_values("id", kind="stable")
            m = np.zeros((len(side), width), dtype=np.int64)
            for i, v in enumerate(side["v"]):
                m[i, : len(v)] = v
            part[bool(flag)] = (side["id"].to_numpy(np.int64), m)
        found = search_block(*part[False], *part[True], k) if len(part) == 2 else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = both.groupBy("block", "chunk").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
