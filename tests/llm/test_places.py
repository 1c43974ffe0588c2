"""Places of matches in whole texts: against plain Python, and in texts with very many matches."""

import random
import re
import time
from itertools import accumulate

from pyspark.sql import functions as F

from tilewright.llm import pii, places, secrets


def test_running_values(spark):
    rng = random.Random(5)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 512, 70000)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    got = df.select("v", F.expr(places.running("v")).alias("sum"), F.expr(places.running("v", places.larger)).alias("max")).collect()
    assert all(r["sum"] == list(accumulate(r.v)) and r["max"] == list(accumulate(r.v, max)) for r in got)


def test_cuts_and_matches(spark):
    t = "aé🙂\n" * 1000 + "x"
    df = spark.createDataFrame([(t, a, n) for a in (0, 1, 1023, 1024, 3999, 4001) for n in (0, 1, 2, 1024, 2500)], "t string, a int, n int")
    got = df.select("a", "n", F.expr(places.cut(places.blocks("t"), "a", "n")).alias("c"), F.expr(places.matches("t", "[é🙂]")).alias("m")).collect()
    want = [(m.start(), m.end(), m.group()) for m in re.finditer("[é🙂]", t)]
    assert all(r.c == t[r.a : r.a + r.n] and [tuple(x) for x in r.m] == want for r in got)


def test_overlapping_spans_are_replaced_once(spark):
    df = spark.createDataFrame([("0123456789", [(1, 4), (2, 3), (3, 6), (8, 9)]), ("ab", []), ("", [])], "t string, spans array<struct<s:int,e:int>>")
    fill = f"CASE WHEN x.s < p THEN '' ELSE concat({places.gap()}, '_') END"
    assert [r[0] for r in df.select(F.expr(places.replaced("t", "spans", fill))).collect()] == ["0_67_9", "ab", ""]


def test_many_matches_in_one_text(spark):
    """200,000 emails, and 100,000 tokens beside as many assigned values, each in one text and in well under a minute."""
    n = 200_000
    mails = " ".join(f"é{i}@x.org" for i in range(n))
    df = spark.createDataFrame([(1, mails)], "doc_id long, text string")
    start = time.time()
    (found,) = pii.find_personal_data(df).collect()
    assert [(x.s, x.e) for x in found.spans] == [(m.start(), m.end()) for m in re.finditer("[0-9]+@x.org", mails)]
    (clean,) = pii.sanitise(df).collect()
    took = time.time() - start
    assert clean.text == " ".join(["é<EMAIL>"] * n)
    keys = " ".join(f"token={i:018d} {i:020d}" for i in range(n // 2))
    start = time.time()
    got = secrets.candidates(df.withColumn("text", F.lit(keys))).orderBy("start").collect()
    print("seconds", took, time.time() - start)
    assert [(r.start, r.end, r.token) for r in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]{18,}", keys)]
    assert got[0].before == "token=" and got[2].before == "token=" and got[1].before == "000000000000000000 "
    assert took < 60 and time.time() - start < 60
