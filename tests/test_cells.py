"""Literal goldens of the encoding, and round trips over all orders."""

import random

import pytest
from pyspark.sql import functions as F

from sphereframe.functions import cells as C

LABELS = ["433142211", "-5112333", "1", "-6", "3" + "1234" * 7, "3" + "1234" * 7 + "2", "-644" + "12" * 13 + "4"]


def test_words_of_known_labels():
    assert C.cell_word(*C.cell("433142211")) == 5347180132572332040
    assert C.cell_word(*C.cell("-5112333")) == 12711972898206646278
    assert C.cell("433142211")[1] - 4**8 == 238416


def test_columns_agree_with_the_driver(spark):
    rng = random.Random(3)
    labels = LABELS + [("-" if rng.random() < 0.5 else "") + str(rng.randint(1, 6)) + "".join(rng.choice("1234") for _ in range(rng.randint(0, 29))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in labels], "t string").select("t", C.label_order("t").alias("ord"), C.label_k("t").alias("k"))
    df = df.withColumn("w", C.word("k", "ord"))
    for r in df.select("*", C.word_k("w").alias("k2"), C.word_order("w").alias("o2"), C.label("k", "ord").alias("t2"), C.nested("k", "ord").alias("n")).collect():
        assert (r.ord, r.k) == C.cell(r.t) == (r.o2, r.k2)
        assert r.t2 == r.t == C.cell_label(r.ord, r.k)
        assert r.w % (1 << 64) == C.cell_word(r.ord, r.k)
        assert r.n == r.k - 4**r.ord


def test_points(spark):
    df = spark.createDataFrame([(C.cell("3" + "1234" * 7 + "2")[1],)], "k bigint").select(C.word("k", F.lit(29), True).alias("w"))
    r = df.select(C.word_is_point("w").alias("p"), C.word_is_point(C.point_to_area("w")).alias("a"), (C.area_to_point(C.point_to_area("w")) == F.col("w")).alias("same")).first()
    assert (r.p, r.a, r.same) == (True, False, True)


def test_bad_labels_fail(spark):
    with pytest.raises(ValueError):
        C.cell("7123")
    with pytest.raises(Exception, match="not a cell label"):
        spark.createDataFrame([("512a",)], "t string").select(C.label_k("t")).collect()


def test_squares(spark):
    rows = spark.range(16).select("id", C.rank_row("id").alias("r"), C.rank_col("id").alias("c")).orderBy("id").collect()
    assert [(x.r, x.c) for x in rows[:5]] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2)]


def test_parents_refuse_finer_levels(spark):
    with pytest.raises(Exception, match="finer"):
        C.with_parents(spark.createDataFrame([(3, 70)], "ord int, k bigint"), [5]).collect()


def test_subtree_span():
    assert C.subtree_span("4331", "43", 6) == (2 * 4**4 + 0 * 4**3, 2 * 4**4 + 4**3)
    with pytest.warns(UserWarning):
        assert C.subtree_span("5", "43", 6) == (0, 0)
