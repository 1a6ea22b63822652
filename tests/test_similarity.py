"""Similarity of texts: long ones in time, short ones and odd characters against sets in Python."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from paperlake.functions import text as fn
from paperlake.plans.registry import QUERIES


def jaccard(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_trigrams_of_long_and_odd_texts(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefghij é中\U0001f600\n") for _ in range(n))
    pairs = [(make(a), make(b)) for a, b in ((400_000, 400_000), (0, 5), (2, 3), (3, 3), (40, 30), (0, 0))]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    began = time.time()
    got = [r.t for r in table.select("k", fn.trigram_jaccard(F.col("a"), F.col("b")).alias("t")).orderBy("k").collect()]
    assert got == [jaccard(*p) for p in pairs]
    assert time.time() - began < 30  # it took time in proportion to the square of the length


def test_conversations_stay_in_several_parts(spark):
    df = QUERIES["text_similarity"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert df.rdd.getNumPartitions() >= 16
