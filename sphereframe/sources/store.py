"""Stores as Parquet tables: path grammar, manifest, catalog of products, scans, and the one writer.

A store is a folder with a manifest (manifest.json), the table cells partitioned by product, window and
shard_k with rows sorted by k, and small tables of metadata: root_ranges, leaf_meta, toc_map, sidecars.
Everything is read by Spark's own readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.operators import coverage as V
from sphereframe.operators import verify as Y

SPECS = ("cell-store/1", "cell-store/2")
MANIFEST = "manifest.json"
_PRODUCT = re.compile(r"[a-z0-9_-]{1,192}")
_WINDOW = re.compile(r"[0-9A-Za-z-]{1,32}")
_BASE = re.compile(r"-?[1-6]")
ALL_TIME = "all"


def is_product_name(name: str) -> bool:
    return bool(_PRODUCT.fullmatch(name)) and not _BASE.fullmatch(name)


def validate_product_name(name: str) -> str:
    if not is_product_name(name):
        raise ValueError(f"not a product name: {name!r}")
    return name


def validate_label(window: str) -> str:
    if not isinstance(window, str) or not _WINDOW.fullmatch(window):
        raise ValueError(f"not a window label: {window!r}")
    return window


def validate_window(window: str | None, manifest: Manifest) -> str | None:
    """A window of a windowed store; all is reserved for the all-time fold."""
    if window is None:
        return None
    if validate_label(window) == ALL_TIME:
        raise ValueError("the label all is reserved")
    if not manifest.temporal:
        raise ValueError("the store has no windows")
    listed = manifest.temporal.get("windows")
    if listed and window not in listed:
        raise ValueError(f"no such window: {window!r}")
    return window


@dataclass(frozen=True)
class Manifest:
    spec: str
    cell_order: int
    shard_order: int
    path_grouping: int = 1
    temporal: dict | None = None
    pyramid: dict | None = None
    semantic_hash: str | None = None
    dataset: dict = field(default_factory=dict)


def parse_manifest(text: str) -> Manifest:
    raw = json.loads(text)
    if raw.get("spec") not in SPECS:
        raise ValueError(f"unsupported spec: {raw.get('spec')!r}")
    cell, shard, group = raw.get("cell_order"), raw.get("shard_order"), raw.get("path_grouping", 1)
    if not isinstance(cell, int) or not isinstance(shard, int) or not 0 <= shard <= cell <= C.MAX_ORDER:
        raise ValueError("the manifest's orders are malformed")
    if not isinstance(group, int) or group < 1:
        raise ValueError("the path grouping must be a positive integer")
    if raw.get("temporal") and raw["spec"] == SPECS[0]:
        raise ValueError("this spec has no windows")
    return Manifest(raw["spec"], cell, shard, group, raw.get("temporal"), raw.get("pyramid"), raw.get("semantic_hash"), raw.get("dataset") or {})


# -- path grammar


def group_digits(digits: str, grouping: int) -> list[str]:
    return [digits[i : i + grouping] for i in range(0, len(digits), grouping)]


def leaf_name(label: str, window: str | None = None) -> str:
    return f"{label}_{window}.zarr" if window else f"{label}.zarr"


def leaf_path(label: str, grouping: int = 1, window: str | None = None) -> str:
    m = re.fullmatch(r"(-?[1-6])([1-4]*)", label)
    if not m:
        raise ValueError(f"not a shard label: {label!r}")
    return "/".join([m[1], *group_digits(m[2], grouping), leaf_name(label, window)])


def split_leaf_name(name: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"(-?[1-6][1-4]*)(?:_([0-9A-Za-z-]{1,32}))?\.zarr", name)
    if not m:
        raise ValueError(f"not a leaf: {name!r}")
    return m[1], m[2]


def leaf_paths(label: Column, grouping: int = 1, window: Column | None = None) -> Column:
    """The same as a Column expression."""
    base, digits = F.regexp_extract(label, r"^(-?[1-6])", 1), F.regexp_extract(label, r"^-?[1-6]([1-4]*)$", 1)
    groups = F.regexp_replace(digits, f"(.{{1,{grouping}}})", "$1/")
    name = label if window is None else F.concat(label, F.when(window.isNotNull(), F.concat(F.lit("_"), window)).otherwise(""))
    return F.concat(base, F.lit("/"), groups, name, F.lit(".zarr"))


def check_node(path: str, grouping: int = 1) -> str:
    """The label of a leaf path whose folders agree with its name, or an error."""
    label, window = split_leaf_name(path.rsplit("/", 1)[-1])
    if leaf_path(label, grouping, window) != path:
        raise ValueError(f"the folders of {path!r} do not agree with its name")
    return label


def stats_key(label: str, window: str | None = None, spec: str = SPECS[0]) -> str:
    if spec not in SPECS:
        raise ValueError(f"unsupported spec: {spec!r}")
    return f"{label}_{window}.stats.json" if window else f"{label}.stats.json"


def overview_stats_key(window: str | None = None) -> str:
    return f"{window or ALL_TIME}.stats.json"


# -- reading


def _text(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).head(1)
    except AnalysisException:
        return None
    return rows[0][0] if rows else None


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    text = _text(spark, f"{root}/{MANIFEST}")
    if text is None:
        raise FileNotFoundError(f"{root} is not a store: it has no {MANIFEST}")
    return parse_manifest(text)


def list_products(spark: SparkSession, root: str) -> list[tuple[str, Manifest | None]]:
    """(name, manifest) by name of the folders in root, one level; those without a manifest are skipped, an unsupported
    one gives None."""
    from pyspark.errors import AnalysisException

    if _text(spark, f"{root}/{MANIFEST}") is not None:
        return []
    try:
        rows = spark.read.text(f"{root}/*/{MANIFEST}", wholetext=True).select("value", F.input_file_name().alias("path")).collect()
    except AnalysisException:  # no folder has one
        return []
    out = []
    for r in rows:
        name = r.path.rstrip("/").split("/")[-2]
        if not is_product_name(name):
            continue
        try:
            out.append((name, parse_manifest(r.value)))
        except ValueError:
            out.append((name, None))
    return sorted(out, key=lambda x: x[0])


def _table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return None


class Store:
    """One store: its manifest and lazy tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = read_manifest(spark, self.root)

    def table(self, name: str) -> DataFrame | None:
        return _table(self.spark, self.root, name)

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")

    def committed(self, window: str | None = None) -> DataFrame | None:
        leaves = self.table("leaf_meta")
        if leaves is None:
            return None
        leaves = leaves.where("stamped")
        return leaves.where(F.col("window") == window) if window else leaves

    def candidates(self, aoi: list | None = None, window: str | None = None, when=None) -> list[int]:
        """The shards that a query reads, from metadata only: a list for partition pruning."""
        validate_window(window, self.manifest)
        ranges, leaves = self.table("root_ranges"), self.committed(window)
        cover = V.region(self.spark, aoi) if aoi else None
        if ranges is None:  # the roster is only a cache; without it the leaves themselves are listed
            shards = leaves.select(F.lit(self.manifest.shard_order).alias("ord"), F.col("shard_k").alias("k")).distinct() if leaves is not None else self.cells.select(F.lit(self.manifest.shard_order).alias("ord"), F.col("shard_k").alias("k")).distinct()
            ranges = shards.select("ord", F.col("k").alias("lo"), F.col("k").alias("hi"))
        found = V.candidates(ranges, self.manifest.shard_order, cover, self.table("toc_map"), when)
        if leaves is not None:
            found = found.join(leaves.select(F.col("shard_k").alias("k")).distinct(), "k", "left_semi")
        return [r.k for r in found.orderBy("k").collect()]

    def open(self, aoi: list | None = None, window: str | None = None, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
        """The cells of the selected leaves, filtered exactly.

        Shards become a literal predicate on the partition column, so pruning happens before any file is
        read.  A region without data gives an empty frame and a warning; a store without a committed leaf
        fails.
        """
        leaves = self.committed()
        if leaves is not None and leaves.isEmpty():
            raise V.NoCoverageError(f"{self.root} has no committed leaf")
        shards = self.candidates(aoi, window)
        df = self.cells
        if window:
            df = df.where(F.col("window") == window)
        if not shards:
            warnings.warn("the region holds no data", stacklevel=2)
            df = df.where(F.lit(False))
        elif aoi or leaves is not None:
            df = df.where(F.col("shard_k").isin(shards)) if len(shards) <= 10_000 else df.join(self.spark.createDataFrame([(s,) for s in shards], "shard_k bigint"), "shard_k", "left_semi")
        if aoi:
            df = V.in_region(df, V.region(self.spark, aoi), [self.manifest.cell_order])
        names = columns or sorted(c for c in df.columns if c not in ("ord", "k", "shard_k", "window", "product"))
        df = df.select("ord", "k", *names)
        return df.orderBy("ord", "k") if ordered else df

    def leaf(self, label, window: str | None = None) -> DataFrame:
        """One shard's cells."""
        order, k = C.cell(label)
        if order != self.manifest.shard_order:
            raise ValueError(f"{label} is not of the shards' order")
        validate_window(window, self.manifest)
        df = self.cells.where(F.col("shard_k") == k)
        return df.where(F.col("window") == window) if window else df

    def overview(self, order: int, window: str | None = None) -> DataFrame | None:
        """The rollup at an ancestor order, None where there is none."""
        if order not in Y.overview_orders(self.manifest.pyramid, self.manifest.cell_order, self.manifest.shard_order):
            return None
        df = self.table("overview")
        if df is None:
            return None
        df = df.where(F.col("anc_order") == order)
        df = df.where(F.col("window") == (window or ALL_TIME)) if "window" in df.columns else df
        return None if df.isEmpty() else df

    def warn_if_stale(self) -> int:
        """How many committed leaves the roster does not list; warns once if any."""
        leaves, ranges = self.committed(), self.table("root_ranges")
        n = V.stale(leaves, ranges, self.manifest.shard_order).count() if leaves is not None and ranges is not None else 0
        if n:
            warnings.warn(f"{n} committed leaves are missing from the root coverage", stacklevel=2)
        return n


def open_store(spark: SparkSession, root: str, products: list[str] | None = None, aoi: list | None = None, window: str | None = None) -> dict[tuple[str, int], DataFrame]:
    """(product, cell order) to frame, pyramids included; the window reaches windowed products only."""
    for name in products or []:
        validate_product_name(name)
    if window is not None:
        validate_label(window)
    found = dict(list_products(spark, root))
    if missing := set(products or ()) - set(found):
        raise KeyError(f"no such products: {sorted(missing)}")
    out = {}
    for name, manifest in found.items():
        if manifest is None or products and name not in products:
            continue
        store = Store(spark, f"{root}/{name}")
        own = window if manifest.temporal else None
        out[name, manifest.cell_order] = store.open(aoi, own)
        for order, level in Y.overview_orders(manifest.pyramid, manifest.cell_order, manifest.shard_order).items():
            if (df := store.overview(order, own)) is not None:
                out[name, level] = df
    return out


# -- the writer


def write_store(cells: DataFrame, root: str, cell_order: int, shard_order: int, window: str | None = None, temporal: dict | None = None, pyramid: dict | None = None) -> Store:
    """cells: ord, k and variables.  Writes cells by shard, leaf_meta, root_ranges and the manifest.

    One shuffle by shard; rows are sorted by k inside files, so Parquet's row-group ranges prune like boxes.
    """
    spark = cells.sparkSession
    from sphereframe.operators import moc

    rows = cells.withColumn("shard_k", C.parent("k", "ord", F.lit(shard_order)))
    by = ["shard_k"]
    if window is not None:
        rows, by = rows.withColumn("window", F.lit(validate_label(window))), ["window", "shard_k"]
    # a second run replaces the shards that it writes, of its window only
    rows.repartition("shard_k").sortWithinPartitions("shard_k", "k").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/cells")
    written = spark.read.parquet(f"{root}/cells")
    meta = written.groupBy("shard_k", *(["window"] if window is not None else [])).agg(F.count(F.lit(1)).alias("cells_with_data"))
    meta.select("*", F.lit(True).alias("stamped"), F.when(F.col("cells_with_data") == 4 ** (cell_order - shard_order), "full").otherwise("bitmap").alias("encoding"), F.lit(cell_order).alias("env_order")).write.mode("overwrite").parquet(f"{root}/leaf_meta")
    shards = written.select(F.col("shard_k").cast("long").alias("lo"), F.col("shard_k").cast("long").alias("hi")).distinct()
    moc.coalesce(shards, shard_order).select(F.lit(shard_order).alias("ord"), "lo", "hi").write.mode("overwrite").parquet(f"{root}/root_ranges")
    manifest = {"spec": SPECS[1] if temporal else SPECS[0], "cell_order": cell_order, "shard_order": shard_order, "path_grouping": 1, "temporal": temporal, "pyramid": pyramid}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return Store(spark, root)
