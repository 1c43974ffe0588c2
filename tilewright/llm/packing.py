"""Best-fit packing of token sequences (operator 1).

Bulk-synchronous best fit. Equal lengths are interchangeable, so documents and gaps are handled as sorted
runs (length, count): at most ``capacity`` of them, whatever the corpus holds. Each round sweeps both sorted
lists from long to short; a document takes the smallest gap that still holds it (its successor), documents of
one length that want one run of gaps take it in the order of their ranks, all gaps are updated together, and
the round repeats. The rows themselves never leave Spark: they get distributed ranks within their length and
join the rounds' outcome, a table of rank intervals.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_exact, materialize

CAPACITY = 1024
EOS = 2
# Fixed value: a text that holds this string gets its one id, as the library's tokenizer file has it by default.
SPECIAL = "<|endoftext|>"
#: Each length is ranked in independent parts of about so many rows, so that one very common length is no hot group.
PART_ROWS = 100_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE from a rank file; one per Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids followed by ``eos``.

    Null text counts as empty (one piece that holds only ``eos``). Documents above ``capacity`` are cut into
    pieces of ``capacity``; the first takes the remainder. Repeated rows and null ids are kept row by row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(np.asarray(enc.encode(text or "", allowed_special="all"), dtype="<u4"), np.uint32(eos)).astype("<u4")
                first = ids.size % capacity or capacity
                cuts = [0, *range(min(first, ids.size), ids.size + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return map_exact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, PIECE_SCHEMA)


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit rounds over runs: (length, first rank, end rank, sequence of the first rank, offset)."""
    left = {s: n for s, n in counts.items() if n > 0}
    ranked = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    places, sequences = [], 0

    def put(length: int, gap: int, seq: int, n: int, into: dict[int, list[tuple[int, int]]]) -> None:
        places.append((length, ranked[length], ranked[length] + n, seq, capacity - gap))
        ranked[length] += n
        left[length] -= n
        if gap > length:
            into.setdefault(gap - length, []).append((seq, n))

    while any(left.values()):
        updated: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, int, int]] = []
        longest = max(s for s, n in left.items() if n)
        for size in sorted({*gaps, *(s for s, n in left.items() if n)}, reverse=True):
            stack += [(size, seq, n) for seq, n in gaps.get(size, ())]
            while stack and left.get(size) and 2 * size > longest:  # shorter ones wait: they fit nearly anywhere
                gap, seq, n = stack.pop()
                take = min(n, left[size])
                put(size, gap, seq, take, updated)
                if take < n:
                    stack.append((gap, seq + take, n - take))
        for gap, seq, n in stack:
            updated.setdefault(gap, []).append((seq, n))
        gaps = updated
        # What no gap can hold any more opens sequences, as many as its volume needs.
        largest = max(gaps, default=0)
        unfit = sorted((s for s, n in left.items() if n and s > largest and 2 * s > longest), reverse=True)
        allowed = -(-sum(s * left[s] for s in unfit if 2 * s <= capacity) // capacity)
        for size in unfit:
            n = left[size] if 2 * size > capacity else min(left[size], allowed)
            if n:
                allowed -= n if 2 * size <= capacity else 0
                put(size, capacity, sequences, n, gaps)
                sequences += n
    return places


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Needs columns doc_id, piece and length; others are kept, but for a given ``sequence_id`` and ``offset``. Ties of length are ranked by doc_id and piece;
    equal rows get places of their own. An empty table stays empty. A length outside the range fails the job.
    ``pieces`` is read twice: pass a stored table.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect()}
    parts = max(128, -(-max(counts.values(), default=1) // part_rows))
    # The given columns travel in one struct, so that none of their names clashes with these.
    row = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"))
    salted = row.withColumn("length", F.col("row.length")).withColumn("part", F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.lit(parts)))
    runs = salted.groupBy("length", "part").count()
    runs = runs.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = spark.createDataFrame(rounds(counts, capacity), "of long, lo long, hi long, seq long, offset long")
    order = Window.partitionBy("length", "part").orderBy("row.doc_id", "row.piece")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(runs.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # At most one row per run and round: bounded by the capacity, so it may be broadcast.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*kept, (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """Tokenizes and packs whole documents; see ``token_pieces`` and ``best_fit_packing``."""
    return best_fit_packing(materialize(token_pieces(docs, vocabulary, capacity, **names)), capacity)
