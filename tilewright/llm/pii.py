"""Personal data: patterns, and terms that disclose them (operator 5). DataFrame functions only.

Base patterns find emails, IP addresses, cards and phone numbers. Then corpus statistics tell which words in a text
with such an entity reveal it: with p(t) and p(c, t) over whole distinct texts, a term's disclosure of entity c is
PMI(c; t) / IC(c), where 1 means that the term occurs with the entity alone. Terms from ``generalise`` on are
replaced by a placeholder, terms from ``remove`` on are taken out, at every place in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .places import gap, matches, replaced

KINDS = ("email", "ip", "card", "phone", "term")
#: Least number of texts with entity and term, and thresholds.
SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.95
#: A list of candidate terms or of texts with terms (8 bytes each) up to this length is broadcast; a longer one is joined.
BROADCAST_ROWS = 1_000_000

_SPAN = "array<struct<s:int,e:int,v:string>>"
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = r"[0-9][0-9\\x20-]*+"
_PHONE = r"\\+[0-9][\\x20().0-9-]+[0-9]"
_TERM = r"\\p{L}[\\p{L}\\p{N}_]*+"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_LUHN = """aggregate(sequence(0, length(d) - 1), 0L, (a, i) -> a + CASE WHEN i % 2 = 0 THEN cast(substring(d, length(d) - i, 1) AS bigint)
    ELSE (cast(substring(d, length(d) - i, 1) AS bigint) * 2) DIV 10 + (cast(substring(d, length(d) - i, 1) AS bigint) * 2) % 10 END) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '\\.'), p -> length(regexp_replace(p, '^0+(?=.)', '')) <= 3 AND try_cast(regexp_replace(p, '^0+(?=.)', '') AS int) <= 255)",
    "card": f"CASE WHEN length({_digits('x.v')}) BETWEEN 12 AND 19 THEN element_at(transform(array({_digits('x.v')}), d -> {_LUHN}), 1) ELSE false END",
    "phone": f"length({_digits('x.v')}) BETWEEN 9 AND 15",
}
#: Cheap tests that any text with such a match passes.
_MAYBE = {"email": "instr(t, '@') > 0", "ip": r"t rlike '[0-9]\\.[0-9]++\\.[0-9]'", "card": r"t rlike '[0-9][0-9\\x20-]{10}'", "phone": r"t rlike '\\+[0-9]'"}
_SOURCE = {"email": ("t", _EMAIL), "ip": ("t", _IP), "card": (r"regexp_replace(t, '[\\x20-](?![0-9])', '\n')", _CARD), "phone": ("t", _PHONE)}


def base_spans() -> Column:
    """array<struct<k, s, e, v>> of the base kinds in column t (k: place in KINDS), by start and kind."""
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        source, pattern = _SOURCE[kind]
        found = f"CASE WHEN {_MAYBE[kind]} THEN filter({matches(source, pattern)}, x -> {_VALID[kind]}) ELSE cast(array() AS {_SPAN}) END"
        parts.append(f"transform({found}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'v', x.v))")
    return F.expr(f"transform(array_sort(concat({', '.join(parts)})), x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v))")


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    return rows.withColumn("base", base_spans())


#: SQL: the text with blanks for what base spans cover, places unchanged; the entity of a base span b; distinct words of free text as hashes.
_FREE = replaced("t", "base", f"concat({gap()}, repeat(' ', x.e - greatest(p, x.s)))")
_ENTITY = f"xxhash64(b.k, CASE WHEN b.k = 0 THEN lower(b.v) WHEN b.k = 1 THEN b.v ELSE {_digits('b.v')} END)"
_FOUND = f"regexp_extract_all(CASE WHEN size(base) > 0 THEN {_FREE} ELSE t END, '{_TERM}', 0)"
_WORDS = f"array_distinct(transform({_FOUND}, w -> xxhash64(lower(w))))"


def _places(terms: str) -> str:
    """SQL for array<struct<s, e, th>>: the words of column free whose hashes are keys of the map ``terms``."""
    words = f"transform({matches('free', _TERM)}, x -> named_struct('s', x.s, 'e', x.e, 'th', xxhash64(lower(x.v))))"
    return f"filter({words}, x -> map_contains_key({terms}, x.th))"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, h (hash of the text) and spans: array<struct<k, s, e, action>> by start and kind; one row per input row.

    Places are code points, the end is exclusive. Base spans have action ``mask``; terms have ``generalise`` or
    ``remove`` wherever they stand. Null text counts as empty, repeated rows get equal results, null ids are kept.
    Statistics are taken over the distinct texts of the whole table, so copies do not vouch for each other.
    """
    bare = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e"))).alias("base")
    entities = F.expr(f"array_distinct(transform(base, b -> {_ENTITY}))").alias("cs")
    # Stored with the texts, so that the base patterns run once.
    found = materialize(_with_base(docs, id_col, text_col).select("doc_id", "h", "t", bare, entities))
    near = materialize(found.where(F.size("cs") > 0).dropDuplicates(["h"]).select("h", "cs", F.expr(_WORDS).alias("words")))
    # Entities in fewer texts than the support can't reach it with any term.
    n_c = near.select(F.explode("cs").alias("c")).groupBy("c").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    pairs = near.select(F.explode("cs").alias("c"), "words").join(n_c, "c").select("c", "n_c", F.explode("words").alias("th"))
    pairs = pairs.groupBy("c", "th").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c")).where(F.col("n_ct") >= support)
    total = found.agg(F.count_distinct("h").alias("n"))
    # One row; attached as a literal so that no join is needed.
    n = float(total.collect()[0]["n"]) or 1.0
    ic = F.log(F.lit(n) / F.col("n_c"))

    def disclosure(texts_with_term: str) -> Column:
        return F.when(ic > 0, F.log(F.lit(n) * F.col("n_ct") / (F.col("n_c") * F.col(texts_with_term))) / ic).otherwise(0.0)

    # A term is in at least as many texts as in texts with an entity: pairs that fail even so need no count over all texts.
    least = near.select(F.explode("words").alias("th")).groupBy("th").agg(F.count("*").alias("n_near"))
    pairs = materialize(pairs.join(least, "th").where(disclosure("n_near") >= generalise).drop("n_near"))
    terms = pairs.select("th").distinct()
    # One row a word: cheaper than a lambda a word, and few words are left after the join.
    each = found.select("h", F.explode(F.expr(_FOUND)).alias("w")).select("h", F.xxhash64(F.lower("w")).alias("th"))
    each = each.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms, "th", "left_semi")
    each = materialize(each.distinct())
    counts = each.groupBy("th").agg(F.count("*").alias("n_t"))
    told = pairs.join(counts, "th").withColumn("d", disclosure("n_t")).where(F.col("d") >= generalise).groupBy("th").agg(F.max("d").alias("d"))
    hit = materialize(each.join(told, "th").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("th", "d"))).alias("told")))
    # Only texts with such terms move; their places depend on the text alone.
    texts = found.join(F.broadcast(hit.select("h")), "h", "left_semi") if hit.count() <= BROADCAST_ROWS else found
    placed = texts.select("h", F.expr(_FREE).alias("free")).join(hit, "h").select("h", "told", F.expr(_places("told")).alias("at"))
    action = F.transform("at", lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e"), F.when(F.col("told")[x["th"]] >= remove, "remove").otherwise("generalise").alias("action")))
    added = placed.select(F.col("h").alias("_h"), action.alias("added")).dropDuplicates(["_h"])
    out = found.join(added, F.col("h") == F.col("_h"), "left")
    every = F.concat(F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lit("mask").alias("action"))), F.coalesce("added", F.expr("cast(array() AS array<struct<s:int,k:int,e:int,action:string>>)")))
    return out.select("doc_id", "h", F.transform(F.array_sort(every), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["action"].alias("action"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["k"] < 4)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["k"] == 4)).cast("long").alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The same rows and columns with personal data in the text masked, generalised or removed.

    Overlapping spans are replaced once, by the first. A null text stays null.
    """
    found = find_personal_data(docs, id_col, text_col, **parameters).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"])
    # The given columns travel in one struct, so that none of their names clashes with these.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = row.withColumn("key", F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    out = named.join(found, (F.col("key") == F.col("h")) & F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")), "left")
    masks = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    given = f"row.`{text_col}`"
    fill = f"CASE WHEN x.s < p THEN '' ELSE concat({gap()}, CASE WHEN x.action = 'remove' THEN '' ELSE element_at(array({masks}), x.k + 1) END) END"
    text = f"CASE WHEN spans IS NULL THEN {given} ELSE {replaced(given, 'spans', fill)} END"
    return out.select(*[(F.expr(text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
