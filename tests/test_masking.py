"""Masking on odd and very long texts: the patterns for Java find what the plain ones find, in time and without deep recursion."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chatlake.functions import masking


PIECES = ["a", "b1", "é", "_", ".", "..", "-", "--", "+", "@", "@x", ".com", ".co", "com", ".net", "command", "/", "/p?q", "www.", "http://", " ", "\n", "<", ">", "<a@b.c>", "a@b.c", ".tr", ")"]


def found(spark, texts, java):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", F.regexp_extract_all("t", F.lit(java), F.lit(0)).alias("m")).orderBy("i").collect()
    return [list(r.m) for r in rows]


def test_java_patterns_find_the_same(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(30_000)]
    for name in ("URL", "CONTACT"):
        want = found(spark, texts, getattr(masking, name))
        got = found(spark, texts, getattr(masking, "JAVA_" + name))
        assert [x for x in zip(texts, got, want) if x[1] != x[2]][:5] == []
    got = [[m.lstrip(".+-") for m in ms if "@" in m] for ms in found(spark, texts, masking.JAVA_EMAIL)]
    want = found(spark, texts, masking.EMAIL)
    assert [x for x in zip(texts, got, want) if x[1] != x[2]][:5] == []


LONG = {
    "labels": "a." * 100_000, "labels with an ending": "a." * 100_000 + "com", "letters": "x" * 1_000_000 + " me@host.example x.com", "digits": "7" * 1_000_000, "hyphens": "a-" * 100_000 + ".com",
    "address": "x." * 100_000 + "@" + "y." * 100_000 + "org", "at signs": "a@" * 100_000 + "b.c", "contact": "w" * 1_000_000 + " <me@host.org>", "blanks": "1 (" + " " * 500_000 + "2", "roster": " " * 200_000 + "\tme@host.org",
}


@pytest.mark.parametrize("name", LONG)
def test_very_long_texts_take_no_time(spark, name):
    df = spark.createDataFrame([(LONG[name],)], "text string")
    masking.with_masked(spark.createDataFrame([("a",)], "text string")).collect()
    began = time.time()
    row = masking.with_masked(df).first()
    assert time.time() - began < 15, name
    assert row.masked is not None
    if name == "letters":
        assert row.masked_counts.email == 1 and row.masked_counts.private_url == 1
