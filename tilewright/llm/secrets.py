"""Secret scan with a random forest against false positives (operator 9). DataFrame functions and Spark ML only.

Candidates are long tokens and values assigned to telling names, with what stands around them. Labelled findings (known
key formats and assignments are secrets, plain words of the corpus are not) train a forest on length, character
transitions, dictionary coverage, path and the words on both sides; it then judges every candidate. Dictionary and
transitions are counted over all texts.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .places import blocks, cut, let, matches

#: Documented bound of the training sample (findings in expectation), and the forest's size.
SAMPLE, TREES, DEPTH = 20000, 20, 6
TOKEN = "[A-Za-z0-9+/_-]{16,}+"
#: A name that tells of a secret with what assigns to it; group 1 is the value, up to the closing quote or else the next space.
NAME = r"""(?i)(?:pass|secret|token|key|auth)[a-z0-9_-]{0,40}+["'\]]{0,2}+\s*+[=:]++>?+\s*+["']?+(?=((?<=")[^"\r\n]+(?=")|(?<=')[^'\r\n]+(?=')|[^\s"']\S*+))"""
#: The word and separators before a candidate, those after it, and the code points they can take up.
BEFORE, AFTER, CONTEXT = r"[^\s=:]{1,24}[\s=:\"']{1,4}\z", r"\A[\s\"',;.)]{0,4}[^\s=:]{0,24}", 28
#: A whole word of the corpus; it is in the dictionary if it stands in so many rows and in two different texts at least.
WORD, LEAST_ROWS = "(?<![A-Za-z0-9+/_-])[A-Za-z][a-z]{2,23}(?![A-Za-z0-9+/_-])", 5
#: Hot tokens meet their coverage in so many parts.
SALTS = 16
FEATURES = ("length", "digits", "uppers", "turns", "natural", "coverage", "named", "quoted", "plain_before", "plain_after", "path", "in_path")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, token and the words and separators before and after it for every candidate; null text has none.

    Candidates are long tokens and whatever is assigned to a name that tells of a secret, of any length and any
    printable characters; a token within such a value is a row of its own. Both are matched without what stands
    around them, so no candidate hides its neighbour.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(f"{TOKEN}|{NAME}"))
    name = NAME.replace("\\", "\\\\").replace("'", "\\'")
    # The name is consumed, the value only looked at: it begins where the name's match ends.
    assigned = f"zip_with({matches('t', name)}, regexp_extract_all(t, '{name}', 1), (m, v) -> named_struct('s', m.e, 'n', length(v), 'k', 0, 'v', v, 'b', m.v))"
    tokens = f"transform({matches('t', TOKEN)}, x -> named_struct('s', x.s, 'n', length(x.v), 'k', 1, 'v', x.v, 'b', cast(NULL AS string)))"
    # A token that is an assigned value comes right after it in order of place and length.
    both = let("found", f"array_sort(concat({assigned}, {tokens}))", "filter(found, (x, i) -> x.k = 0 OR coalesce(get(found, i - 1).s <> x.s OR get(found, i - 1).n <> x.n, true))")
    found = f"CASE WHEN t rlike '{name}' THEN {both} ELSE {tokens} END"
    from_, e = f"greatest(0, x.s - {CONTEXT})", "(x.s + x.n)"
    around = f"named_struct('x', x, 'near', {cut('bs', from_, f'least({CONTEXT}, x.s)')}, 'next', {cut('bs', e, str(CONTEXT))})"
    rows = rows.select("doc_id", F.explode(F.expr(let("bs", blocks("t"), f"transform({found}, x -> {around})"))).alias("c"))
    before = F.coalesce("c.x.b", F.regexp_extract("c.near", BEFORE, 0))
    return rows.select("doc_id", F.col("c.x.s").alias("start"), F.expr("c.x.s + c.x.n").alias("end"), F.col("c.x.v").alias("token"), before.alias("before"), F.regexp_extract("c.next", AFTER, 0).alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", least: int = LEAST_ROWS) -> DataFrame:
    """word, n: lower-cased whole words of all texts that stand in at least ``least`` rows and in two different texts."""
    t = docs.select(F.col(text_col).cast("string").alias("t")).select(F.xxhash64("t").alias("h"), F.explode(F.array_distinct(F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0)))).alias("word"))
    counts = t.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    return counts.where((F.col("n") >= least) & (F.col("low") < F.col("high"))).select("word", "n")


def transitions(words: DataFrame) -> list[float]:
    """log2 of how much likelier than chance each pair of neighbouring letters is in dictionary words, add-one smoothed.

    27 x 27 numbers (a to z and all else), so that is what the driver gets whatever the corpus.
    """
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    seen = {r["pair"]: r["n"] for r in pairs.where(F.col("pair").rlike("^[a-z]{2}$")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    total = {a: sum(seen.get(a + b, 0) for b in letters) for a in letters}
    out = []
    for a in letters + " ":
        out += [math.log2(27 * (seen.get(a + b, 0) + 1) / (total[a] + 27)) if a in total else 0.0 for b in letters + " "]
    return out


def coverage(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, coverage: the share of each distinct token's characters in runs of letters that are dictionary words.

    Runs end where letters do and before a capital that follows a small letter.
    """
    runs = tokens.select("token", F.explode(F.regexp_extract_all(F.col("token"), F.lit("[A-Z]?[a-z]{2,23}|[A-Z]{3,24}"), F.lit(0))).alias("run"))
    known_ = runs.withColumn("word", F.lower("run")).join(words.select("word"), "word")
    return known_.groupBy("token").agg((F.sum(F.length("word")) / F.first(F.length("token"))).alias("coverage"))


def _share(pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace("token", pattern, "")) / F.length("token")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """All of ``FEATURES`` for candidates, given the dictionary."""
    spread = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    share = coverage(found.select("token").distinct(), words).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = spread.join(share, ["token", "salt"], "left").drop("salt").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    table = f"array({', '.join(f'{x:.6f}D' for x in transitions(words))})"
    code = lambda i: f"CASE WHEN substring(lower(token), {i}, 1) BETWEEN 'a' AND 'z' THEN ascii(substring(lower(token), {i}, 1)) - 97 ELSE 26 END"
    natural = F.expr(f"CASE WHEN length(token) < 2 THEN 0D ELSE aggregate(sequence(1, length(token) - 1), 0D, (s, i) -> s + element_at({table}, least(27, {code('i')}) * 27 + least(27, {code('i + 1')}) + 1)) / (length(token) - 1) END")
    yes = lambda c: c.cast("double")
    around = lambda pattern, c: yes(F.col(c).rlike(pattern))
    return found.withColumns({
        "length": F.length("token").cast("double"), "digits": _share("[0-9]"), "uppers": _share("[A-Z]"), "turns": F.length(shape) / F.length("token"), "natural": natural,
        "named": around("(?i)(pass|secret|token|key|auth)", "before"), "quoted": around("[\"']$", "before") * around("^[\"']", "after"),
        "plain_before": around(r"^[A-Za-z][a-z]*[,;.]?\s+$", "before"), "plain_after": around(r"^[,;.)]?\s+[A-Za-z][a-z]*[,;.)]?$", "after"),
        # Parts of a path within the token, and a path that goes on around it.
        "path": F.size(F.split("token", "/")) - 1.0, "in_path": F.greatest(around(r"[/\\~@.][\s=:\"']*$", "before"), around(r"^[/\\.][A-Za-z0-9]", "after")),
    })


def known(token: Column, before: Column) -> Column:
    """1 for known key formats, assigned hexadecimal and letters with digits quoted after a name, 0 for plain words not quoted after a name, null where no rule decides."""
    secret = token.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,})$") | (token.rlike("^[0-9a-f]{20,}$") & before.rlike(r"(?i)(password|token|secret|key)[\s=:\"']+$"))
    quoted = before.rlike(r"(?i)(pass|secret|token|key|auth)\S*\s*[=:]+>?\s*[\"']$")
    secret = secret | (quoted & token.rlike(r"^(?=.*[A-Za-z])(?=.*[0-9])\S{6,}$"))
    return F.when(secret, 1.0).when(token.rlike("^[A-Za-z][a-z]+$") & ~quoted, 0.0)


def judged_apart() -> Column:
    """True for a quarter of all distinct tokens, by a hash."""
    return F.pmod(F.xxhash64("token"), F.lit(4)) == 2


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = LEAST_ROWS, train: Column | None = None) -> DataFrame:
    """doc_id, start, end, token, before, after, score and is_secret for every candidate of every whole text.

    Places are code points, the end is exclusive. Null ids are kept, repeated rows get equal results.

    Trained on about ``sample`` findings that ``known`` labels, picked by a hash among those that ``train``
    admits (all, unless given; ``~judged_apart()`` leaves a part for measuring). Where they are of one kind only, the label decides alone and undecided candidates are no secrets.
    """
    found = materialize(candidates(docs, id_col, text_col))
    words = materialize(dictionary(docs, text_col, least))
    rows = materialize(with_features(found, words).withColumn("label", known(F.col("token"), F.col("before"))))
    release(found, words)
    out = ("doc_id", "start", "end", "token", "before", "after")
    fit = F.col("label").isNotNull() & (F.lit(True) if train is None else train)
    sizes = {r["label"]: r["n"] for r in rows.where(fit).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        score = F.coalesce("label", F.lit(0.0))
        return rows.select(*out, score.alias("score"), (score >= 0.5).alias("is_secret"))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / 2 / n))])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    picked = rows.where(fit & (F.xxhash64("token", "before", "doc_id") / 2.0**64 + 0.5 < share[F.col("label")]))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label").fit(picked.select("features", "label"))
    scored = forest.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("is_secret"))
