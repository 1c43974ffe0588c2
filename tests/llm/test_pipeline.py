"""Stages of the pipeline on small tables, against brute force where there is any."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import _components, _spans  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest table with rows of every odd kind, and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(-1, None, "en", "x", 0), (-2, "", "en", "x", 0), (-3, "12 !! 34", None, "x", 8), (-4, "Mail a.b@c.de or call +49 170 1234567 from 10.0.0.1", "en", "x", 50), (None, "The house is old and the garden is green", "en", None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(-5).cast("long")))
    return docs.withColumns({c: F.lit("clash") for c in ("score", "label", "spans", "h", "key", "row", "offset", "part")})


def test_every_stage_keeps_columns_and_whole_rows(spark, documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents, DATA)
        assert out.columns == documents.columns, name
        assert out.where("score = 'clash' AND spans = 'clash'").count() == out.count(), name
        assert stage(spark, documents.limit(0), DATA).count() == 0, name


def test_language_stage(spark, documents):
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents, DATA).select("doc_id").collect()}
    assert not kept & {-1, -2, -3} and {-5, None} <= kept
    assert kept >= {r.doc_id for r in documents.where("lang IS NOT NULL AND length(text) > 200").select("doc_id").collect()}


def test_toxicity_stage(spark, documents):
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, documents, DATA).select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()} & {r.doc_id for r in documents.select("doc_id").collect()}
    assert len(clean - kept) <= 0.02 * len(clean) and {-1, -2, None} <= kept


def test_duplicate_stage(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    groups = _components([(i, t) for i, t in rows if i is not None], 80, 5)
    kept = [r.doc_id for r in corpus_pipeline.deduplicate(spark, documents, DATA).select("doc_id").collect()]
    assert set(kept) == {i for i, (n, c) in groups.items() if not n or i == c} | {None}


def test_personal_data_stage(spark, documents):
    out = corpus_pipeline.sanitise(spark, documents, DATA).select("doc_id", "text").collect()
    assert len(out) == documents.count() and all(not _spans(r.text or "") for r in out)
    assert {r.doc_id: r.text for r in out}[-4] == "Mail <EMAIL> or call <PHONE> from <IP>"


def test_packing_stage(spark, documents):
    out = corpus_pipeline.pack(spark, documents, DATA).collect()
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and sum(r.piece == 0 for r in out) == documents.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert re.match("doc_id,piece", ",".join(out.columns)) and out.count() > 100
