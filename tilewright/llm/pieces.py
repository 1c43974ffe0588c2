"""Piece encoding and decoding by a max-plus scan (operator 7).

The best segmentation of a text is a path of greatest summed piece score. Every text is cut into chunks, rows of
their own; each gives a transfer matrix over boundary states (how far the last piece of one chunk reaches into the
next). Matrices are combined by max-plus products in a tree (``FAN`` neighbours a step, each step a shuffle by
document and place), the states at all cuts are read on the way down, and every chunk is traced back by itself.

Cuts are laid before a mark where there is one, since no piece holds a mark but in front: such a cut has the
single state 0. A chunk between two such cuts has a 1 x 1 matrix, its score, and is traced at once. Within it, words are
encoded together, a position of all words at a time, and kept in a bounded cache. This is the segmentation of greatest
score; among equal ones the choice is fixed for a given chunk size. The supplied model is a merge model, whose own
encoding is a different one.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_exact, materialize

MARK = "▁"
APART = "\uffff"  # stands for a mark of the text itself
#: Characters of a chunk, neighbours combined in a step, words kept by a worker, characters of words that are encoded together.
CHUNK, FAN, CACHE, TOGETHER = 8192, 32, 400_000, 48
#: The score of a character written as bytes.
BYTES_SCORE = -1e6
NONE = -1e18


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.pieces[i]: (i, model.get_score(i)) for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids))
        # Every prefix of a piece: the piece that it is itself, or None. A walk ends at the first string that is no prefix.
        self.prefixes: dict[str, tuple[list[int], float] | None] = {}
        for piece, (i, score) in self.ids.items():
            for e in range(1, len(piece)):
                self.prefixes.setdefault(piece[:e])
            self.prefixes[piece] = [i], score
        # Characters whose own piece beats their bytes; others need the byte step.
        self.single = {c for c, (_, score) in self.ids.items() if len(c) == 1 and score > BYTES_SCORE}
        self.spelled = [bytes([self.bytes[i]]) if i in self.bytes else piece.replace(MARK, " ").encode() for i, piece in enumerate(self.pieces)]
        self.words: dict[str, tuple[list[int], float]] = {}
        # The prefixes as a tree: node and character to the next node, by a hash; id and score by node.
        node = {x: k for k, x in enumerate(["", *self.prefixes])}
        edges = sorted((node[x[:-1]] << 21 | ord(x[-1]), k) for x, k in node.items() if x)
        self.edge, self.target = np.array([e for e, _ in edges], dtype=np.int64), np.array([k for _, k in edges], dtype=np.int32)
        self.node_id, self.node_score = np.full(len(node), -1, dtype=np.int32), np.full(len(node), NONE)
        for x, hit in self.prefixes.items():
            if hit is not None:
                self.node_id[node[x]], self.node_score[node[x]] = hit[0][0], hit[1]
        # A slot holds the place of its only edge, or -1 for several, which are then searched for.
        slot, first, times = np.unique(self._slot(self.edge), return_index=True, return_counts=True)
        self.slots = np.full(1 << 20, self.edge.size, dtype=np.int32)
        self.slots[slot] = np.where(times == 1, first, -1)
        self.edge = np.append(self.edge, -1)
        self.target = np.append(self.target, 0)
        self.plain = np.array(sorted(map(ord, self.single)), dtype=np.uint32)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _next(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have the child, and these children."""
        key = node << 21 | char
        at = self.slots[self._slot(key)]
        if (crowded := np.flatnonzero(at < 0)).size:
            at[crowded] = np.searchsorted(self.edge[:-1], key[crowded])
        on = np.flatnonzero(self.edge[at] == key)
        return on, self.target[at[on]]

    def best(self, s: str, a: int = 0, stop: int | None = None) -> tuple[list[float], list]:
        """Scores and back pointers of all positions from a; pieces start before ``stop``."""
        n, stop = len(s), len(s) if stop is None else stop
        score, back = [NONE] * (n + 1), [None] * (n + 1)
        score[a] = 0.0
        get, single, longest = self.prefixes.get, self.single, self.longest
        for p in range(a, stop):
            base = score[p]
            if base <= NONE:
                continue
            if s[p] not in single:
                c = {APART: MARK, MARK: " "}.get(s[p], s[p])
                if base + BYTES_SCORE > score[p + 1]:
                    score[p + 1], back[p + 1] = base + BYTES_SCORE, (p, [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")])
                if s[p] == APART:
                    continue
            for e in range(p + 1, min(n, p + longest) + 1):
                hit = get(s[p:e], NONE)
                if hit is NONE:
                    break
                if hit is not None and base + hit[1] > score[e]:
                    score[e], back[e] = base + hit[1], (p, hit[0])
        return score, back

    def trace(self, back: list, a: int, e: int) -> list[int]:
        out = []
        while e > a:
            e, ids = back[e]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def word(self, w: str) -> tuple[bytes, float, bytes]:
        """Ids (32-bit), score and decoded bytes of a mark followed by w, which holds none."""
        score, back = self.best(MARK + w)
        ids = self.trace(back, 0, len(w) + 1)
        return np.asarray(ids, dtype="<u4").tobytes(), score[-1], self.decode(ids)

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache: those of usual length together, the others one by one."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = list(words)
        usual = sorted((w for w in new if len(w) < TOGETHER), key=len)
        for at in range(0, len(usual), 1 << 15):
            self._together(usual[at : at + (1 << 15)])
        for w in new:
            if len(w) >= TOGETHER:
                self.words[w] = self.word(w)

    def _together(self, names: list[str]) -> None:
        """``word`` for words sorted by length."""
        n, size = len(names), np.array([len(w) + 1 for w in names])
        width = int(size[-1])
        flat = np.frombuffer("".join([MARK + w for w in names]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text = np.zeros((n, width), dtype=np.int64)
        text[np.arange(width)[None, :] < size[:, None]] = flat
        plain = self.plain[np.minimum(np.searchsorted(self.plain, text), self.plain.size - 1)] == text
        score = np.full((width + 1, n), NONE)
        score[0] = 0.0
        last, piece = np.zeros((width + 1, n), dtype=np.int32), np.full((width + 1, n), -1, dtype=np.int32)
        for p in range(width):
            low = int(np.searchsorted(size, p, side="right"))
            # Characters without a piece are written as bytes: a negative piece names the character.
            odd = low + np.flatnonzero(~plain[low:, p])
            odd = odd[score[p, odd] + BYTES_SCORE > score[p + 1, odd]]
            score[p + 1, odd], last[p + 1, odd], piece[p + 1, odd] = score[p, odd] + BYTES_SCORE, p, -2 - text[odd, p]
            rows, node = np.arange(low, n), np.zeros(n - low, dtype=np.int64)
            for e in range(p + 1, min(width, p + self.longest) + 1):
                on, child = self._next(node, text[rows, e - 1])
                rows, node = rows[on], child.astype(np.int64)
                if not rows.size:
                    break
                total = score[p, rows] + self.node_score[node]
                better = np.flatnonzero(total > score[e, rows])
                r = rows[better]
                score[e, r], last[e, r], piece[e, r] = total[better], p, self.node_id[node[better]]
        place, steps, every = size.copy(), [], np.arange(n)
        while (place > 0).any():
            steps.append(np.where(place > 0, piece[place, every], -1))
            place = np.where(place > 0, last[place, every], 0)
        ids = np.stack(steps[::-1], axis=1).astype("<i4")
        count = (ids != -1).sum(axis=1)
        totals = score[size, every].tolist()
        spelled, wide, rest = self.spelled, ids.shape[1], (ids < -1).any(axis=1).tolist()
        raw = ids.tobytes()
        for k, (w, c, row) in enumerate(zip(names, count.tolist(), ids.tolist())):
            own = row[wide - c :]
            if rest[k]:
                own = [i for x in own for i in ([x] if x >= 0 else [self.byte_ids[b] for b in {APART: MARK, MARK: " "}.get(chr(-2 - x), chr(-2 - x)).encode("utf-8", "surrogatepass")])]
                self.words[w] = np.asarray(own, dtype="<u4").tobytes(), totals[k], b"".join([spelled[i] for i in own])
            else:
                self.words[w] = raw[4 * (k * wide + wide - c) : 4 * (k + 1) * wide], totals[k], b"".join([spelled[i] for i in own])

    def transfer(self, s: str, size: int, enter: int, leave: int) -> np.ndarray:
        """Matrix over entry states below ``enter`` and exit states below ``leave``: s holds the chunk's ``size`` characters and some next ones."""
        at = np.full((len(s) + 1, enter), NONE)
        at[np.arange(min(enter, size + 1)), np.arange(min(enter, size + 1))] = 0.0
        get, single, longest = self.prefixes.get, self.single, self.longest
        for p in range(size):
            base = at[p]
            if s[p] not in single:
                np.maximum(at[p + 1], base + BYTES_SCORE, out=at[p + 1])
                if s[p] == APART:
                    continue
            for e in range(p + 1, min(len(s), p + longest) + 1):
                hit = get(s[p:e], NONE)
                if hit is NONE:
                    break
                if hit is not None:
                    np.maximum(at[e], base + hit[1], out=at[e])
        m = np.full((enter, leave), NONE)
        n = min(leave, len(s) - size + 1)
        m[:, :n] = at[size : size + n].T
        return np.maximum(m, NONE)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a run of ids; every mark is a space."""
        return b"".join([self.spelled[i] for i in ids])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, so chunks may be combined in any grouping."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def states_within(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states at all cuts of a run of chunks on the best path from ``enter`` to ``leave``."""
    before = [np.where(np.arange(matrices[0].shape[0]) == enter, 0.0, NONE)[None, :]]
    for m in matrices[:-1]:
        before.append(combine(before[-1], m))
    out = [leave]
    for m, pre in zip(reversed(matrices), reversed(before)):
        out.append(int((pre[0] + m[:, out[-1]]).argmax()))
    return out[::-1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def marked(text: str) -> str:
    """Spaces become marks, a mark goes in front; a mark of the text itself stands apart (written as bytes)."""
    return MARK + text.replace(MARK, APART).replace(" ", MARK)


def cuts(s: str, chunk: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a marked text, at most ``chunk`` characters each; cut before the last mark where there is one."""
    out, a = [], 0
    while len(s) - a > chunk:
        soft = s.rfind(MARK, a + 1, a + chunk + 1)
        e = soft if soft > 0 else a + chunk
        out.append((a, e))
        a = e
    return [*out, (a, len(s))]


# Fixed value: the reversed polynomial of CRC-32.
_CRC = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC's, bits reversed."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_CRC if b & 1 else 0)
    return out


def joined_crc(a: int, b: int, size_b: int) -> int:
    """CRC-32 of a concatenation from the parts' and the second part's size in bytes."""
    power, square, n = 0x80000000, 0x00800000, size_b  # 1 and x^8
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return _times(power, a) ^ b


_KEYS = "row long, doc_id long, chunk long, chunks long"
_SUMS = "n_ids long, ids_crc32 long, score double, bytes long, bytes_crc32 long, round_trip boolean"
_SUM_NAMES = [x.split()[0] for x in _SUMS.split(", ")]
_OPEN = "enter int, leave int, size int, part string"


def _sums(ids: bytes, score: float, back: bytes, said: str) -> tuple:
    """Digests of a chunk from its ids, its decoded bytes and the text that it says."""
    return len(ids) // 4, zlib.crc32(ids), score, len(back), zlib.crc32(back), back == said.replace(MARK, " ").replace(APART, MARK).encode("utf-8", "surrogatepass")


def chunk_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """A row a chunk of every whole text: row, doc_id, chunk, chunks, digests (or null), ids if asked for, and for chunks with an
    open cut their text. Null text counts as empty; ``row`` tells rows of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for whole in batches:
            upto = np.cumsum([len(t) + 1 if isinstance(t, str) else 1 for t in whole["text"]]) >> 20
            for k in np.unique(upto):
                pdf = whole[upto == k]
                texts = [marked(t) if isinstance(t, str) else MARK for t in pdf["text"]]
                v.learn({w for s in texts for w in s.split(MARK) if len(w) < chunk})
                yield pd.DataFrame([x for r, d, s in zip(pdf["row"], pdf["doc_id"], texts) for x in rows_of(v, r, d, s)], columns=names).astype({"doc_id": "Int64", **dict.fromkeys(("n_ids", "ids_crc32", "bytes", "bytes_crc32"), "Int64")})

    def rows_of(v: Vocabulary, row: int, doc: int | None, s: str) -> Iterator[tuple]:
        spans, get = cuts(s, max(chunk, v.longest)), v.words.get
        for c, (a, e) in enumerate(spans):
            enter = 1 if s[a] == MARK else v.longest
            leave = 1 if e == len(s) or s[e] == MARK else v.longest
            head = (row, doc, c, len(spans))
            if enter == leave == 1:
                hits = [get(w) or v.word(w) for w in s[a + 1 : e].split(MARK)]
                ids = b"".join([h[0] for h in hits])
                yield (*head, *_sums(ids, sum([h[1] for h in hits]), b"".join([h[2] for h in hits]), s[a:e]), *([np.frombuffer(ids, dtype="<i4")] if with_ids else []), enter, leave, e - a, None)
            else:
                part = s[a : e + v.longest - 1]
                yield (*head, *[None] * (6 + with_ids), enter, leave, e - a, part)

    schema = f"{_KEYS}, {_SUMS}, {'ids array<int>, ' if with_ids else ''}{_OPEN}"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_exact(rows, run, schema)


def _up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    m = functools.reduce(combine, [np.frombuffer(x).reshape(a, b) for x, a, b in zip(pdf["matrix"], pdf["enter"], pdf["leave"])])
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "at": [int(pdf["at"].iloc[0]) // FAN], "enter": m.shape[0], "leave": m.shape[1], "matrix": [m.tobytes()]})


def _down(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    s = states_within([np.frombuffer(x).reshape(a, b) for x, a, b in zip(pdf["matrix"], pdf["enter"], pdf["leave"])], int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]))
    return pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "first": s[:-1], "last": s[1:]})


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """The encoding of every whole text, a row a chunk: row, doc_id, chunk, chunks, digests of the chunk and (``with_ids``) its ids.

    Null text counts as empty, repeated rows get equal results, null ids are kept, an empty table stays empty. A chunk
    is the most that a task holds at a time of a giant text after it was cut. ``chunk`` is at least the longest piece.
    """
    rows = materialize(chunk_rows(docs, path, id_col, text_col, chunk, with_ids))
    kept = [c for c in rows.columns if c not in ("enter", "leave", "size", "part")]
    open_ = rows.where("part IS NOT NULL")
    most = open_.agg(F.max("chunks")).first()[0]
    if not most:
        return rows.select(*kept)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            m = [v.transfer(p, n, a, b).tobytes() for p, n, a, b in zip(pdf["part"], pdf["size"], pdf["enter"], pdf["leave"])]
            yield pdf[["row", "at", "enter", "leave"]].assign(matrix=m)

    # Up: matrices of the open chunks, each chunk a row of its own; chunks between closed cuts take part with their scores.
    schema = "row long, at long, enter int, leave int, matrix binary"
    dealt = open_.select("row", F.col("chunk").alias("at"), "enter", "leave", "size", "part").repartition("row", "at")
    closed = rows.where("part IS NULL AND chunks > 1").join(open_.select("row").distinct(), "row", "left_semi")
    as_matrix = F.udf(lambda x: np.array([x]).tobytes(), "binary")
    levels = [materialize(dealt.mapInPandas(matrices, schema).unionByName(closed.select("row", F.col("chunk").alias("at"), "enter", "leave", as_matrix("score").alias("matrix"))))]
    while most > 1:
        levels.append(materialize(levels[-1].groupBy("row", F.floor(F.col("at") / FAN).alias("g")).applyInPandas(_up, schema)))
        most = -(-most // FAN)
    # Down: the states at the cuts.
    states = levels[-1].select("row", "at", F.lit(0).alias("first"), F.lit(0).alias("last"))
    for level in reversed(levels[:-1]):
        known = states.select("row", F.col("at").alias("g"), "first", "last")
        states = level.withColumn("g", F.floor(F.col("at") / FAN)).join(known, ["row", "g"]).groupBy("row", "g").applyInPandas(_down, "row long, at long, first int, last int")
    states = materialize(states)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                score, back = v.best(r.part, r.first, r.size)
                ids = v.trace(back, r.first, r.size + r.last)
                out.append((r.row, r.doc_id, r.chunk, r.chunks, *_sums(np.asarray(ids, dtype="<u4").tobytes(), score[r.size + r.last], v.decode(ids), r.part[r.first : r.size + r.last]), *([ids] if with_ids else [])))
            yield pd.DataFrame(out, columns=kept).astype({"doc_id": "Int64"})

    parts = open_.join(states.select("row", F.col("at").alias("chunk"), "first", "last"), ["row", "chunk"])
    schema = f"{_KEYS}, {_SUMS}{', ids array<int>' if with_ids else ''}"
    parts = parts.repartition("row", "chunk")
    return rows.where("part IS NULL").select(*kept).unionByName(map_exact(parts.select("row", "doc_id", "chunk", "chunks", "size", "part", "first", "last"), traced, schema))


def decode_pieces(chunks: DataFrame, path: str) -> DataFrame:
    """row, doc_id, chunk, chunks and text of encoded chunks; joined in order they are the document.

    A chunk may end within a character that is written as bytes only if another model encoded it; such bytes are replaced.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for pdf in batches:
            text = [v.decode(list(ids)).decode("utf-8", "replace")[int(c == 0) :] for ids, c in zip(pdf["ids"], pdf["chunk"])]
            yield pdf[["row", "doc_id", "chunk", "chunks"]].assign(text=text)

    return map_exact(chunks.select("row", "doc_id", "chunk", "chunks", "ids"), run, f"{_KEYS}, text string")


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of runs of chunks (column ``parts``: at most ``FAN`` structs in order) joined to one each."""
    for pdf in batches:
        out = []
        for row, doc, at, parts in zip(pdf["row"], pdf["doc_id"], pdf["at"], pdf["parts"]):
            n, crc, score, size, told, fine = 0, 0, 0.0, 0, 0, True
            for p in parts:
                crc, told = joined_crc(crc, p["ids_crc32"], 4 * p["n_ids"]), joined_crc(told, p["bytes_crc32"], p["bytes"])
                n, score, size, fine = n + p["n_ids"], score + p["score"], size + p["bytes"], fine and p["round_trip"]
            out.append((row, doc, at, n, crc, score, size, told, fine))
        yield pd.DataFrame(out, columns=["row", "doc_id", "at", *_SUM_NAMES]).astype({"doc_id": "Int64"})


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_ids, ids_crc32, score, decoded_bytes, decoded_crc32 and round_trip of every whole text, one row per row.

    The chunks' digests are joined in order, ``FAN`` neighbours a step.
    """
    rows = encode_pieces(docs, path, id_col, text_col, chunk, with_ids=False)
    single, several = rows.where("chunks = 1"), rows.where("chunks > 1").withColumn("at", F.col("chunk"))
    most = several.agg(F.max("chunks")).first()[0] or 1
    several = several.select("row", "doc_id", "at", *_SUM_NAMES)
    while most > 1:
        near = several.groupBy("row", F.floor(F.col("at") / FAN).alias("g")).agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", *_SUM_NAMES))).alias("parts"))
        several = map_exact(near.select("row", "doc_id", F.col("g").alias("at"), "parts"), _added, f"row long, doc_id long, at long, {_SUMS}")
        most = -(-most // FAN)
    # The mark in front decodes to a space, which is no part of the text; a score is rounded, since its order of addition is free.
    out = single.select("doc_id", *_SUM_NAMES).unionByName(several.select("doc_id", *_SUM_NAMES))
    return out.select("doc_id", "n_ids", "ids_crc32", F.round("score", 6).alias("score"), (F.col("bytes") - 1).alias("decoded_bytes"), F.col("bytes_crc32").alias("decoded_crc32"), "round_trip")
