"""Telemetry of a store: leaf and node records, roll-ups, and which orders a pyramid really has."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import verify as Y
from sphereframe.sources.store import ALL_TIME, Store


def use_object_store(spark: SparkSession, anonymous: bool = False, endpoint: str | None = None) -> None:
    """Settings of the s3a file system; without anonymous access the ambient credentials are used."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if anonymous:
        conf.set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)


def read_stats(store: Store, label, window: str | None = None) -> DataFrame | None:
    """A leaf's record (no row or one), None where the store keeps none."""
    order, k = C.cell(label)
    if order != store.manifest.shard_order:
        raise ValueError(f"{label} is not of the shards' order")
    df = store.table("leaf_stats")
    if df is None:
        return None
    df = df.where(F.col("shard_k") == k)
    return df.where(F.col("window") == window) if window and "window" in df.columns else df


def read_overview_stats(store: Store, order: int, window: str | None = None) -> DataFrame:
    """The node records of an overview order, every node listed, with nulls where it has no record.

    A store whose paths are grouped has no such records and fails; one without a roster warns and is empty.
    """
    if store.manifest.path_grouping != 1:
        raise ValueError("grouped paths have no overview records")
    stats, ranges = store.table("overview_stats"), store.table("root_ranges")
    if ranges is None or stats is None:
        warnings.warn("there is no roster or no record to read", stacklevel=2)
        return store.spark.createDataFrame([], "k bigint")
    shards = ranges.select(F.explode(F.sequence("lo", "hi")).alias("k"))
    nodes = Y.overview_nodes(shards, store.manifest.shard_order, order)
    own = stats.where(F.col("anc_order") == order)
    own = own.where(F.col("window") == (window or ALL_TIME)) if "window" in own.columns else own
    return nodes.join(own.drop("anc_order", "window").withColumnRenamed("node_k", "k"), "k", "left")


def read_stats_rollup(store: Store, by: list[str] | None = None) -> DataFrame | None:
    """The stored roll-up, or the fold of the leaf records where there is none."""
    df = store.table("stats_rollup")
    if df is not None:
        return df
    leaves = store.table("leaf_stats")
    return None if leaves is None else Y.fold_stats(leaves, by or [])


def overview_objects(store: Store) -> list[tuple[int, str]]:
    """(ancestor order, window) of what the overview table holds.

    Rows whose role is not overview are warned about and left out; cells off the declared order fail.
    """
    df = store.table("overview")
    if df is None:
        return []
    declared = Y.overview_orders(store.manifest.pyramid, store.manifest.cell_order, store.manifest.shard_order)
    role = F.col("role") if "role" in df.columns else F.lit("overview")
    window = F.col("window") if "window" in df.columns else F.lit(ALL_TIME)
    out = []
    for r in df.groupBy("anc_order", window.alias("w"), role.alias("r")).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).collect():  # a few orders and windows
        if r.r != "overview":
            warnings.warn(f"the rows of role {r.r!r} at order {r.anc_order} are left out", stacklevel=2)
        elif declared.get(r.anc_order) != r.lo or r.lo != r.hi:
            raise ValueError(f"cells of orders {r.lo} to {r.hi} where {declared.get(r.anc_order)} is declared")
        else:
            out.append((r.anc_order, r.w))
    return sorted(out)


def source_orders(store: Store) -> list[int]:
    """All cell orders that can be read: the leaves' and the overviews'."""
    declared = Y.overview_orders(store.manifest.pyramid, store.manifest.cell_order, store.manifest.shard_order)
    return sorted({store.manifest.cell_order, *(declared[o] for o, _ in overview_objects(store))})


def finest_source_at(store: Store, order: int) -> int | None:
    return Y.finest_at(source_orders(store), order)
