"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import jaccard, langid, packing, pii, registry, toxicity
from tilewright.llm.common import held_out, materialize, table

def _fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, each with underscores after it until no column of docs has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language stands out.

    A language stands out if its score is at least twice the mean of the others': for n languages, 2 / (n + 1).
    """
    known = docs.select("doc_id", "text", "lang").where(~held_out("doc_id"))
    model = langid.fit_language_model(known)
    pred, score = _fresh(docs, "lang_pred", "score")
    judged = langid.identify_languages(docs, model, names=(pred, score))
    return judged.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= 2 / (len(model.langs) + 1))).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon predicts as toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id"))
    lexicon = toxicity.fit_lexicon(toxicity.labelled_sample(docs, labels))
    score, predicted = _fresh(docs, "score", "predicted")
    return toxicity.score_toxicity(docs, lexicon, names=(score, predicted)).where(F.col(predicted) == 0).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without words or without an id stay."""
    groups = jaccard.jaccard_components(docs)
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct())
    # A bounded list of ids is broadcast, so that the texts stay where they are.
    few = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms that disclose it; every document stays."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, registry.vocabulary())


STAGES = [
    ("language id", identify_language),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", deduplicate),
    ("pii", sanitise),
    ("best-fit packing", pack),
]

#: SQL can't express tokenization, trained models or components of unbounded depth; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
