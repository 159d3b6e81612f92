"""Interval algebra against brute force, coverage tiers, nested fields, stores and gates."""

import random
import warnings

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.functions import geo, lanes, temporal
from sphereframe.operators import coverage as V
from sphereframe.operators import domain as D
from sphereframe.operators import joins as J
from sphereframe.operators import moc as M
from sphereframe.operators import nested as N
from sphereframe.operators import verify as Y
from sphereframe.sources import store as S


def frame(spark, cells):
    return spark.createDataFrame(list(cells), "ord int, k bigint")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_seam_is_one_interval(spark):
    """The last cell of +6 and the first of -1 are neighbours."""
    df = frame(spark, [C.cell("6444444"), C.cell("-1111111")])
    assert rows(M.coalesce(M.intervals(df, 8), 8)) == [(458736, 458767)]


def test_compress_is_canonical(spark):
    rng = random.Random(1)
    members = [(o, k) for o in range(4) for k in range(4**o, 13 * 4**o) if rng.random() < 0.3]
    cells = {(3, k) for o, p in members for k in range(p << 2 * (3 - o), (p + 1) << 2 * (3 - o))}
    for o in (3, 2, 1):
        for p in {k >> 2 for x, k in cells if x == o}:
            four = {(o, 4 * p + i) for i in range(4)}
            if four <= cells:
                cells = cells - four | {(o - 1, p)}
    assert rows(M.compress_cover(frame(spark, members))) == sorted(cells)


def test_reversed_interval_fails(spark):
    with pytest.raises(Exception, match="reversed"):
        M.coalesce(spark.createDataFrame([(9, 3)], "lo bigint, hi bigint")).collect()


def test_region_filter_both_ways(spark):
    data = frame(spark, [(3, 100), (3, 101), (3, 400)])
    aoi = frame(spark, [(2, 25), (6, 400 * 64 + 5)])
    assert rows(V.in_region(data, aoi)) == [(3, 100), (3, 101), (3, 400)]
    assert rows(V.in_region(data, frame(spark, [(3, 101)]))) == [(3, 101)]
    mixed = frame(spark, [(3, 100), (5, 1616), (1, 6), (4, 1700)])
    many = frame(spark, [(2, 25), (3, 100), (4, 404), (5, 1616), (6, 6464)])
    assert rows(V.in_region(mixed, many)) == [(1, 6), (3, 100), (5, 1616)]


def test_bitmaps(spark):
    z = zstandard.ZstdCompressor()
    shard = C.cell("-5112333")[1]
    df = spark.createDataFrame([(shard, bytearray(z.compress(b"\x80\x00"))), (shard + 1, bytearray(z.compress(b"\x00\x01"))), (shard + 2, None)], "shard_k bigint, payload binary")
    got = V.decode_bitmaps(df, 6, 8).select(C.label("k", "ord")).collect()
    assert sorted(r[0] for r in got) == ["-511233311", "-511233444"]
    with pytest.raises(Exception, match="bytes"):
        V.decode_bitmaps(spark.createDataFrame([(shard, bytearray(z.compress(b"\x80")))], "shard_k bigint, payload binary"), 6, 8).collect()


def test_domain_round_trip(spark):
    dom = D.from_cells(frame(spark, [(2, k) for k in (17, 18, 19, 40, 41, 90)]), 2)
    assert rows(dom) == [(17, 19, 0), (40, 41, 3), (90, 90, 5)]
    got = D.take(spark.createDataFrame([(0,), (4,), (-1,)], "position bigint"), dom)
    assert rows(got.select("position", "k")) == [(-1, 90), (0, 17), (4, 41)]
    assert rows(D.rank(frame(spark, [(2, 41), (2, 50)]), dom, 2, missing=-1).select("k", "position")) == [(41, 4), (50, -1)]
    with pytest.raises(Exception, match="not in the domain"):
        D.rank(frame(spark, [(2, 50)]), dom, 2).collect()
    with pytest.raises(NotImplementedError):
        D.concat([dom, dom], 2)
    later = D.from_cells(frame(spark, [(2, k) for k in (91, 95)]), 2)
    assert rows(D.concat([dom, dom.limit(0), later], 2)) == [(17, 19, 0), (40, 41, 3), (90, 91, 5), (95, 95, 7)]
    assert rows(D.subset(dom, 1, 6, 2, step=2)) == [(18, 18, 0), (40, 40, 1), (90, 90, 2)]
    assert rows(D.subset_at(dom, spark.createDataFrame([(0,), (1,), (-1,), (0,)], "position bigint"), 2)) == [(17, 18, 0), (90, 90, 2)]
    assert rows(D.from_cover(frame(spark, [(1, 4), (2, 20)]), 2)) == [(16, 20, 0)]
    assert [r.ordinal for r in D.select(frame(spark, [(2, 5), (2, 6)]), spark.createDataFrame([(3, 5), (1, 6), (2, 5)], "ordinal int, k bigint")).collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="several orders"):
        C.fabricate(frame(spark, [(2, 17), (3, 70)]))


def test_join_coarse_gates(spark):
    fine, coarse = frame(spark, [(3, 100)]), frame(spark, [(2, 25)]).withColumn("v", F.lit(7))
    assert rows(J.join_coarse(fine, coarse)) == [(3, 100, 7.0)]
    with pytest.raises(ValueError, match="suffix"):
        J.join_coarse(fine.withColumn("v", F.lit(1)), coarse)
    with pytest.raises(ValueError, match="finer"):
        J.join_coarse(frame(spark, [(1, 6)]), coarse)


def test_degrade_policies(spark):
    leaves = spark.createDataFrame([(70, True, "bitmap", False, None, 5)], "shard_k bigint, stamped boolean, encoding string, has_bitmap boolean, box array<struct<ord:int,k:bigint>>, env_order int")
    none = spark.createDataFrame([], "shard_k bigint, k bigint")
    with pytest.raises(ValueError):
        J.leaf_parts(leaves, none, 3, 3, 5, "raise")
    with pytest.warns(J.ConservativeCoverageWarning):
        assert rows(J.leaf_parts(leaves, none, 3, 3, 5, "conservative")) == [(3, 70, False)]
    assert rows(J.leaf_parts(leaves, none, 3, 3, 5, "skip")) == []


def test_lane_round_trip(spark):
    df = spark.createDataFrame([(n, c) for n in range(1, 255, 7) for c in range(0, n + 1, 3)], "n bigint, c bigint")
    got = df.select("c", lanes.counts(lanes.pack([F.col("c")] * 8, F.col("n")), F.col("n")).alias("x"))
    assert got.where(F.exists("x", lambda v: v != F.col("c"))).isEmpty()


def test_temporal_words(spark):
    t = 5_354_000_000_123_456_789
    r = spark.range(1).select(temporal.instant_word(F.lit(t)).alias("w"), temporal.range_word(F.lit(t), F.lit(t + 10**10)).alias("r")).select(temporal.start_ns(F.col("w")).alias("a"), temporal.end_ns(F.col("w")).alias("b"), temporal.start_ns(F.col("r")).alias("c"), temporal.end_ns(F.col("r")).alias("d")).first()
    assert (r.a, r.b) == (t, t + 1)
    assert r.c <= t and r.d > t + 10**10 and t - r.c < 1 << 31 and r.d - t - 10**10 <= 1 << 32
    with pytest.raises(ValueError):
        temporal.query_span((5, 5))


def test_geography():
    for order in (0, 3, 9, 20):
        p = np.unique(np.random.default_rng(order).integers(0, 12 * 4**order, 2000))
        for authalic in (True, False):
            assert (geo.pixels(*geo.centers(p, order, authalic), order, authalic) == p).all()


def test_ragged_decode(spark):
    raw = np.arange(6, dtype="<i2").tobytes()
    element = N.parse_element({"dtype": "<i2", "shape": [-1, 3]})
    df = N.decode(spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(b""),)], "raw binary"), "raw", element, "v")
    assert [r.v for r in df.collect()] == [[[0, 1, 2], [3, 4, 5]], [], []]
    with pytest.raises(ValueError):
        N.parse_element({"dtype": "<i2", "shape": [3]})


def test_rasterize_keeps_weight(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (3.0, 4.0)],)], "d array<struct<mean:double,weight:double>>")
    got = df.select(N.rasterize(F.col("d"), F.lit(0.0), F.lit(1.0), 4)).first()[0]
    assert got == pytest.approx([1.0, 1.5, 3.5, 0.0])


def test_hashes_and_tampering(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(50)], "shard_k bigint, k bigint, v double")
    import hashlib

    own = Y.hash_arrays(df, ["v"], ["shard_k"])
    assert own.first().sha256 == hashlib.sha256(np.arange(50, dtype="<f8").tobytes()).hexdigest()
    bad = Y.hash_arrays(df.withColumn("v", F.when(F.col("k") == 7, -1.0).otherwise(F.col("v"))), ["v"], ["shard_k"])
    assert Y.verify(bad, own, ["shard_k"]).first().match is False
    assert Y.verify(own, own.limit(0), ["shard_k"]).first().match is None


def test_store_round_trip(spark, tmp_path):
    shard = C.cell("4331")[1]
    cells = frame(spark, [(5, (shard << 4) + i) for i in range(16)] + [(5, C.cell("-51123")[1] * 4)]).withColumn("count", F.col("k") % 5)
    store = S.write_store(cells, str(tmp_path / "s"), 5, 3)
    assert store.open().count() == 17
    part = store.open(aoi=["433"], ordered=True)
    assert [r.k for r in part.collect()] == [(shard << 4) + i for i in range(16)]
    assert "shard_k" in part._jdf.queryExecution().executedPlan().toString()
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert store.open(aoi=["2"]).count() == 0
    assert any("no data" in str(w.message) for w in seen)
    with pytest.raises(FileNotFoundError):
        S.read_manifest(spark, str(tmp_path))
    assert S.list_products(spark, str(tmp_path)) == [("s", store.manifest)]


def test_paths():
    assert S.leaf_path("-4334122", 3) == "-4/334/122/-4334122.zarr"
    assert S.check_node("4/3/3/1/4331_2019.zarr") == "4331"
    assert S.split_leaf_name("4331_2019.zarr") == ("4331", "2019")
    with pytest.raises(ValueError):
        S.check_node("4/3/3/2/4331.zarr")
    assert not S.is_product_name("-3") and S.is_product_name("atl_06")
