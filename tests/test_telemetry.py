import pytest
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import verify as Y
from sphereframe.sources import store as S
from sphereframe.sources import telemetry as T


def test_pyramid_and_records(spark, tmp_path):
    root, shard = str(tmp_path / "s"), C.cell("4331")[1]
    cells = spark.createDataFrame([(5, (shard << 4) + i, i) for i in range(16)], "ord int, k bigint, v bigint")
    store = S.write_store(cells, root, 5, 3, pyramid={"overview": {"orders": [2, 1]}})
    assert Y.overview_orders(store.manifest.pyramid, 5, 3) == {2: 4, 1: 3}
    assert T.overview_objects(store) == [] and T.source_orders(store) == [5] and store.overview(2) is None
    level = Y.pyramid_level(cells, {"v": "sum"}, 4).withColumn("anc_order", F.lit(2)).withColumn("role", F.lit("overview"))
    level.write.parquet(f"{root}/overview")
    assert T.overview_objects(store) == [(2, "all")] and T.source_orders(store) == [4, 5]
    assert T.finest_source_at(store, 4) == 4 and T.finest_source_at(store, 3) is None
    assert store.overview(2).agg(F.sum("v")).first()[0] == 120
    assert T.read_stats(store, "4331") is None and T.read_stats_rollup(store) is None
    record = spark.createDataFrame([(shard, 1, 2, 3, 16, 0.5, 1.0, "t", True, "h")], "shard_k bigint, n_shards bigint, n_granules bigint, n_obs bigint, cells_with_data bigint, duration_s double, max_memory_mb double, timestamp string, success boolean, semantic_hash string")
    record.write.parquet(f"{root}/leaf_stats")
    assert T.read_stats(store, "4331").first().n_obs == 3
    assert T.read_stats_rollup(store).first().semantic_hash == "h"
    with pytest.raises(ValueError):
        T.read_stats(store, "43")


def test_off_order_overviews_fail(spark, tmp_path):
    root = str(tmp_path / "s")
    cells = spark.createDataFrame([(5, C.cell("433111")[1], 1)], "ord int, k bigint, v bigint")
    store = S.write_store(cells, root, 5, 3, pyramid={"overview": {"orders": [2]}})
    cells.withColumn("anc_order", F.lit(2)).write.parquet(f"{root}/overview")
    with pytest.raises(ValueError, match="declared"):
        T.overview_objects(store)


def test_windows_and_catalog(spark, tmp_path):
    root = str(tmp_path)
    cells = spark.createDataFrame([(5, C.cell("433111")[1], 1)], "ord int, k bigint, v bigint")
    S.write_store(cells, f"{root}/plain", 5, 3)
    windowed = S.write_store(cells, f"{root}/yearly", 5, 3, window="2019", temporal={"windows": ["2019", "2020"]})
    assert windowed.open(window="2019").count() == 1
    with pytest.raises(ValueError):
        windowed.open(window="2021")
    assert set(S.open_store(spark, root, window="2019")) == {("plain", 5), ("yearly", 5)}
    with pytest.raises(KeyError):
        S.open_store(spark, root, products=["none"])
