"""Phrase collocations by direct-address tiles (operator 13).

Frequent words get ids by frequency within their language, so the cells of pairs (id, id) that matter lie in few
tiles of 1024 x 1024. Tasks split the pairs of a buffer into tiles: full tiles are counted by a dense bincount, thin
ones as sorted coordinates. Pairs that are frequent over the corpus get ids by frequency in turn, and triples are
counted as pairs (id of a pair, id of a word) the same way. Only partial counts are shuffled.

Ids are held for a bounded number of words and pairs, the most frequent ones. What is frequent beyond them is known by
a bitmap of fixed size and counted by its text; bits that agree by chance only cost work, since counts decide.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words and pairs that get ids at most, over all languages: what is broadcast is bounded by these.
WORDS, PAIRS = 1 << 18, 1 << 20
#: Bits for what is frequent and has no id.
BITS = 1 << 26
SIDE = 10  # a tile has 2^10 x 2^10 cells
TILE_BITS = 20  # of a cell within its tile, and of the tile within its language
#: A tile with at least so many pairs in a buffer is counted densely.
DENSE = 1 << 17
BUFFER = 1 << 21  # words that are counted at a time
SLICE = 1 << 22  # bytes of a text that become words at a time
PARTS = 64
NONE, UNNUMBERED = -1, -2  # no part of a candidate; perhaps part of one, but without an id
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of UTF-8: A-Z become a-z, tabs blanks, the marks that end a piece line feeds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def slices(text: bytes, size: int) -> Iterator[list[str]]:
    """The words of a text in order, a line feed between pieces and after the last, in lists from about ``size`` bytes."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = len(text)
        if at + size < end:
            cut = text.rfind(b" ", at, at + size)
            end = cut if cut > at else text.find(b" ", at + size)
            end = len(text) if end < 0 else end
        yield [w for w in text[at:end].replace(b"\n", b" \n ").decode("utf-8", "replace").split(" ") if w]
        at = end
    yield ["\n"]


def by_language(batches: Iterator[pa.RecordBatch], order: int, size: int, buffer: int) -> Iterator[tuple[str, list[str]]]:
    """Words of texts by language, about ``buffer`` at a time.

    Where a buffer ends within a text, its last order - 1 words come again, so that every run of ``order`` words is
    whole in exactly one buffer.
    """
    held: dict[str, list[str]] = {}
    n = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = held.setdefault(lang, [])
            for part in slices(text, size):
                words += part
                n += len(part)
                if n >= buffer:
                    yield from held.items()
                    held = {lang: words[len(words) - order + 1 :]}
                    words, n = held[lang], 0
    yield from held.items()


def cells(lang: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number: language, tile, place in the tile."""
    low = (1 << SIDE) - 1
    tile = ((a >> SIDE) << (TILE_BITS // 2)) | (b >> SIDE)
    return (np.int64(lang) << (2 * TILE_BITS)) | (tile << TILE_BITS) | ((a & low) << SIDE) | (b & low)


def ids_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, half = (1 << SIDE) - 1, TILE_BITS // 2
    tile = (cell >> TILE_BITS) & ((1 << TILE_BITS) - 1)
    return cell >> (2 * TILE_BITS), ((tile >> half) << SIDE) | ((cell >> SIDE) & low), ((tile & ((1 << half) - 1)) << SIDE) | (cell & low)


def counted(cell: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of one language and their counts: full tiles by bincount, the others by sorting."""
    tiles, place = cell >> TILE_BITS, cell & ((1 << TILE_BITS) - 1)
    first = int(tiles.min()) if len(tiles) else 0
    full = np.flatnonzero(np.bincount(tiles - first) >= dense) + first if len(tiles) else np.empty(0, np.int64)
    keys, sums, left = [], [], np.ones(len(cell), dtype=bool)
    for t in full.tolist():
        mine = tiles == t
        left &= ~mine
        n = np.bincount(place[mine], minlength=1 << TILE_BITS)
        at = np.flatnonzero(n)
        keys.append(at + (np.int64(t) << TILE_BITS))
        sums.append(n[at])
    rest = np.sort(cell[left])
    new = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.empty(0, np.int64)
    keys.append(rest[new])
    sums.append(np.diff(np.append(new, len(rest))))
    return np.concatenate(keys), np.concatenate(sums)


class Numbered:
    """Ids of words and pairs and the bitmaps for the others; bounded, one per Python worker."""

    def __init__(self, words: dict[str, tuple[list[str], np.ndarray]], word_bits: np.ndarray | None, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, pair_bits: np.ndarray | None = None):
        self.words, self.word_bits, self.pair_bits = words, word_bits, pair_bits
        self.langs = {lang: i for i, lang in enumerate(words)}
        self.pairs = pairs  # sorted cells, their ids and counts
        self.known: dict[str, dict[str, int]] = {}

    def ids(self, lang: str) -> dict[str, int]:
        if lang not in self.known:
            self.known[lang] = {w: i for i, w in enumerate(self.words[lang][0])} if lang in self.words else {}
            self.known[lang]["\n"] = NONE
        return self.known[lang]

    def word_codes(self, lang: str, words: list[str]) -> np.ndarray:
        ids = self.ids(lang)
        codes = np.array([ids.get(w, UNNUMBERED) for w in words], dtype=np.int64)
        at = np.flatnonzero(codes == UNNUMBERED)
        if len(at):
            codes[at] = UNNUMBERED if self.word_bits is not None else NONE
            if self.word_bits is not None:
                codes[at[~held(self.word_bits, np.array([place_of(lang, words[i]) for i in at.tolist()], dtype=np.int64))]] = NONE
        return codes

    def pair_codes(self, lang: str, words: list[str], codes: np.ndarray) -> np.ndarray:
        """For every word but the last: what the pair that it begins is."""
        a, b = codes[:-1], codes[1:]
        out = np.full(len(a), NONE, dtype=np.int64)
        direct = np.flatnonzero((a >= 0) & (b >= 0))
        if len(direct):
            cell = cells(self.langs[lang], a[direct], b[direct])
            at = np.minimum(np.searchsorted(self.pairs[0], cell), max(0, len(self.pairs[0]) - 1))
            hit = self.pairs[0][at] == cell if len(self.pairs[0]) else np.zeros(len(cell), dtype=bool)
            out[direct[hit]] = self.pairs[1][at[hit]]
            if self.pair_bits is not None:
                miss = ~hit
                out[direct[miss][held(self.pair_bits, spread(cell[miss]))]] = UNNUMBERED
        if self.pair_bits is not None:
            odd = np.flatnonzero(((a == UNNUMBERED) & (b != NONE)) | ((b == UNNUMBERED) & (a != NONE)))
            if len(odd):
                places = np.array([place_of(lang, f"{words[i]} {words[i + 1]}") for i in odd.tolist()], dtype=np.int64)
                out[odd[held(self.pair_bits, places)]] = UNNUMBERED
        return out


def place_of(lang: str, phrase: str) -> int:
    return zlib.crc32(f"{lang} {phrase}".encode()) & (BITS - 1)


def spread(cell: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(38)).astype(np.int64)


def held(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


COUNTS = "cell long, lang string, phrase string, n long"


def _rows(cell: np.ndarray, n: np.ndarray, lang: str, texts: Counter[str]) -> pa.RecordBatch:
    k = len(texts)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(cell, pa.int64()), pa.nulls(k, pa.int64())]), pa.concat_arrays([pa.nulls(len(cell), pa.string()), pa.array([lang] * k, pa.string())]),
        pa.concat_arrays([pa.nulls(len(cell), pa.string()), pa.array(list(texts), pa.string())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.array(list(texts.values()), pa.int64())]),
    ], names=["cell", "lang", "phrase", "n"])


def _grams(texts: DataFrame, shared, order: int, least: int, dense: int, buffer: int, size: int) -> DataFrame:
    """Counts from ``least`` on of pairs (order 2) or triples (order 3): by cell where ids exist, else by language and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(*shared.value)
        for lang, words in by_language(batches, order, size, buffer):
            codes = numbered.word_codes(lang, words)
            if order == 2:
                left, right = codes[:-1], codes[1:]
                fits = (left != NONE) & (right != NONE)
            else:
                pairs = numbered.pair_codes(lang, words, codes)
                left, right = pairs[:-1], codes[2:]
                fits = (left != NONE) & (pairs[1:] != NONE)
            direct = fits & (left >= 0) & (right >= 0)
            odd = np.flatnonzero(fits & ~direct).tolist()
            cell, n = counted(cells(numbered.langs.get(lang, 0), left[direct], right[direct]), dense)
            yield _rows(cell, n, lang, Counter(" ".join(words[i : i + order]) for i in odd))

    return texts.mapInArrow(run, COUNTS).groupBy("cell", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _words(texts: DataFrame, least: int, buffer: int, size: int) -> DataFrame:
    """(lang, word, n) from ``least`` on, and with a null word the number of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches, 1, size, buffer):
            n = Counter(words)
            n.pop("\n", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(n) + 1), pa.string()), pa.array([None, *n], pa.string()), pa.array([sum(n.values()), *n.values()], pa.int64())], names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull())


def most_frequent(counts: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent rows, at most ``bound``, and the rest; cut between classes of counts (an eighth of an octave wide)."""
    grade = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in counts.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():  # at most 512 classes
        total += r["count"]
        if total > bound:
            break
        least = r["g"]
    top = F.lit(False) if least is None else grade >= least
    return counts.where(top), counts.where(~top)


def bitmap(places: DataFrame) -> np.ndarray | None:
    """A bitmap of BITS bits of the column place, or None where there is no row."""
    place = F.col("place") + 1  # Spark's buckets start at 1
    rows = places.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most BITS / 32768
    if not rows:
        return None
    width = 32768 // 8
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * width
        out[at : at + width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _places(rows: DataFrame) -> DataFrame:
    """Places in the bitmap of rows with cell or with lang and phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, lang, phrase = (b.column(i).to_pylist() for i in range(3))
            direct = np.array([c for c in cell if c is not None], dtype=np.int64)
            odd = [place_of(x, p) for c, x, p in zip(cell, lang, phrase) if c is None]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([spread(direct), np.array(odd, dtype=np.int64)]), pa.int64())], names=["place"])

    return rows.select("cell", "lang", "phrase").mapInArrow(run, "place long")


def _named(counts: DataFrame, shared, order: int) -> DataFrame:
    """Cells back to words: lang, w1, w2 (w3), a, with the counts of parts that have ids (null for the others)."""
    parts = ["f1", "f2"] if order == 2 else ["f1", "f3", "f12", "f23"]
    names = ["lang", *(f"w{i + 1}" for i in range(order)), "a", *parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(*shared.value)
        langs = list(numbered.langs)
        if order == 3:  # pairs by language and id
            code_of = numbered.pairs[0] >> (2 * TILE_BITS)
            by_id = numbered.pairs[0][np.lexsort((numbered.pairs[1], code_of))]
            starts = np.searchsorted(code_of, np.arange(len(langs)))
        f = lambda lang, w: int(numbered.words[lang][1][i]) if (i := numbered.ids(lang).get(w)) is not None and lang in numbered.words else None

        def f_pair(lang: str, a: str, b: str) -> int | None:
            ids = numbered.ids(lang)
            if a not in ids or b not in ids or lang not in numbered.langs or not len(numbered.pairs[0]):
                return None
            c = cells(numbered.langs[lang], np.array([ids[a]]), np.array([ids[b]]))[0]
            i = int(np.searchsorted(numbered.pairs[0], c))
            return int(numbered.pairs[2][i]) if i < len(numbered.pairs[0]) and numbered.pairs[0][i] == c else None

        for b in batches:
            rows = []
            for cell, lang, phrase, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if cell is None:
                    words = phrase.split(" ")
                else:
                    code, left, right = (int(x) for x in ids_of(np.int64(cell)))
                    lang = langs[code]
                    of = numbered.words[lang][0]
                    if order == 2:
                        words = [of[left], of[right]]
                    else:
                        _, x, y = (int(v) for v in ids_of(by_id[starts[code] + left]))
                        words = [of[x], of[y], of[right]]
                got = [f(lang, words[0]), f(lang, words[-1])]
                if order == 3:
                    got += [f_pair(lang, *words[:2]), f_pair(lang, *words[1:])]
                rows.append((lang, *words, n, *got))
            kinds = [pa.string()] * (order + 1) + [pa.int64()] * (1 + len(parts))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return counts.mapInArrow(run, ", ".join(f"{c} {'string' if i <= order else 'long'}" for i, c in enumerate(names)))


def _filled(rows: DataFrame, part: str, known: DataFrame, on: dict[str, str]) -> DataFrame:
    """Fills the nulls of ``part`` from the column n of ``known``; the others stay where they are."""
    names = rows.columns
    right = known.select(*[F.col(c).alias(w) for c, w in on.items()], F.col("n").alias(part))
    return rows.where(F.col(part).isNotNull()).unionByName(rows.where(F.col(part).isNull()).drop(part).join(right, list(on.values())).select(*names))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right)).cast("long")


def mine_collocations(docs: DataFrame, least: int = 10, keep: int = 2000, inside: int = 50, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, pairs: int = PAIRS, dense: int = DENSE, buffer: int = BUFFER, size: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``keep`` best phrases of two or three words of each language.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at blanks and tabs. A phrase counts from
    ``least`` occurrences on; its score is that of its worse cut, the first among equals. It is dropped if a longer one
    around it, itself counted, has ``inside`` percent of its occurrences. Null languages are ``und``; null and empty
    texts have no words; every repeated row counts. An empty table gives no rows. Only the two columns are read.
    ``words`` and ``pairs`` bound what gets ids and change no result. Counts must stay below 10^16.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")

    counts = materialize(_words(texts, least, buffer, size))
    frequent = counts.where("word IS NOT NULL")
    top, rest = most_frequent(frequent, words)
    got = top.toArrow()
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for lang, word, n in zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n"))):
        by_lang.setdefault(lang, []).append((-n, word))
    ranked = {lang: sorted(by_lang[lang]) for lang in sorted(by_lang)}
    vocabulary = {lang: ([w for _, w in ws], np.array([-n for n, _ in ws], dtype=np.int64)) for lang, ws in ranked.items()}
    word_bits = bitmap(rest.select(F.pmod(F.crc32(F.concat_ws(" ", "lang", "word").cast("binary")), F.lit(BITS)).alias("place")))
    shared = spark.sparkContext.broadcast((vocabulary, word_bits))

    two = materialize(_grams(texts, shared, 2, least, dense, buffer, size))
    top, others = most_frequent(two.where("cell IS NOT NULL"), pairs)
    got = top.select("cell", "n").toArrow()
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((cell, -n, cell >> (2 * TILE_BITS)))
    lang_of = (cell >> (2 * TILE_BITS))[order]
    number = np.arange(len(cell)) - np.searchsorted(lang_of, lang_of)
    by_cell = np.argsort(cell[order])
    pair_bits = bitmap(_places(others.unionByName(two.where("cell IS NULL"))))
    shared3 = spark.sparkContext.broadcast((vocabulary, word_bits, (cell[order][by_cell], number[by_cell], n[order][by_cell]), pair_bits))
    three = materialize(_grams(texts, shared3, 3, least, dense, buffer, size))

    pair = materialize(_named(two, shared, 2))
    pair_n = pair.select("lang", "w1", "w2", F.col("a").alias("n"))
    scored2 = _filled(_filled(pair, "f1", frequent, {"lang": "lang", "word": "w1"}), "f2", frequent, {"lang": "lang", "word": "w2"})
    scored2 = scored2.select("lang", "w1", "w2", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    triple = materialize(_named(three, shared3, 3))
    full = _filled(_filled(triple, "f1", frequent, {"lang": "lang", "word": "w1"}), "f3", frequent, {"lang": "lang", "word": "w3"})
    full = _filled(_filled(full, "f12", pair_n, {"lang": "lang", "w1": "w1", "w2": "w2"}), "f23", pair_n, {"lang": "lang", "w1": "w2", "w2": "w3"})
    cut1, cut2 = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    full = full.withColumn("s1", cut1).withColumn("s2", cut2)
    better = lambda x, y: F.when(F.col("s2") < F.col("s1"), F.col(y)).otherwise(F.col(x))
    scored3 = full.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", better("f1", "f12").alias("l"), better("f23", "f3").alias("r"), better("s1", "s2").alias("score"))

    around = triple.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("most"))
    kept2 = scored2.join(around, ["lang", "w1", "w2"], "left").where(100 * F.coalesce("most", F.lit(0)) < inside * F.col("a"))
    both = kept2.select("lang", "phrase", "a", "l", "r", "score").unionByName(scored3).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        both = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    totals = counts.where("word IS NULL").select("lang", F.col("n"))
    return both.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, keep: int = 2000, inside: int = 50) -> str:
    """The same in DuckDB SQL: all runs of one to three words of every piece are counted."""
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) u GROUP BY ALL),
two AS (SELECT lang, p[1] AS w1, p[2] AS w2, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM w) u GROUP BY ALL HAVING count(*) >= {least}),
three AS (SELECT lang, p[1] AS w1, p[2] AS w2, p[3] AS w3, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM w) u GROUP BY ALL HAVING count(*) >= {least}),
cut AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.w1, t.w2, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN one y ON y.lang = t.lang AND y.phrase = t.w2
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, NULL, NULL, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, NULL, NULL, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.phrase = t.w3),
scored AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nr FROM scored) s WHERE nr = 1),
around AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) u GROUP BY ALL),
left_ AS (SELECT worst.* FROM worst LEFT JOIN around USING (lang, w1, w2) WHERE 100 * coalesce(most, 0) < {inside} * a),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN n USING (lang) WHERE rank <= {keep}
"""
