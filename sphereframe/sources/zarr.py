"""Trees of small Zarr (version 3) groups, one leaf a shard, read as tables of cells.

Metadata names the leaves of a region and time; their objects are read by Spark's binaryFile source, so any
file system that Spark knows will do.  A leaf's objects, still encoded, meet in one task by one shuffle and are
decoded there: a leaf has at most 4 ** (cell order - shard order) cells, whatever the store's size.  For
queries that come again, ingest() writes the Parquet tables of sources.store once.

Names are taken from the objects themselves: the manifest is the JSON object at the root that has the orders,
a leaf's stamp is the attribute of its root group that says complete, and the coordinate array is the one that
the group declares.  Arrays have one dimension.  Fill values of NaN and arrays that a leaf lacks are null; an
object that is missing holds the fill value; a codec, type or checksum that does not fit is an error.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import warnings
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.functions import temporal as T
from sphereframe.operators import coverage as V
from sphereframe.sources import store as S

#: Zarr's name of a number type -> (NumPy's, Spark's).  Unsigned 64-bit numbers keep their bits.
NUMBERS = {
    "bool": ("?", "boolean"), "int8": ("i1", "tinyint"), "int16": ("i2", "smallint"), "int32": ("i4", "int"), "int64": ("i8", "bigint"),
    "uint8": ("u1", "smallint"), "uint16": ("u2", "int"), "uint32": ("u4", "bigint"), "uint64": ("u8", "bigint"), "float32": ("f4", "float"), "float64": ("f8", "double"),
}
#: Types of any length -> (Spark's type, the codec that lays them out).
LENGTHS = {"variable_length_bytes": ("binary", "vlen-bytes"), "bytes": ("binary", "vlen-bytes"), "string": ("string", "vlen-utf8")}
ROSTER, NODE, ABSENT = "coverage.moc", "zarr.json", (1 << 64) - 1
_LEAF = re.compile(r"(?:^|/)(-?[1-6][1-4]*)(?:_([0-9A-Za-z-]{1,32}))?\.zarr(?:/|$)")


# -- codecs


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)  # Castagnoli's polynomial, reflected
        out.append(x)
    return out


_CRC = _crc_table()


def crc32c(raw: bytes) -> int:
    x = 0xFFFFFFFF
    for b in raw:
        x = x >> 8 ^ _CRC[(x ^ b) & 0xFF]
    return x ^ 0xFFFFFFFF


def spark_type(kind: str) -> str:
    if kind in NUMBERS:
        return NUMBERS[kind][1]
    if kind in LENGTHS:
        return LENGTHS[kind][0]
    raise ValueError(f"unsupported data type: {kind!r}")


def fill_of(meta: dict):
    """The fill value as a Python value."""
    kind, fill = meta["data_type"], meta.get("fill_value")
    if kind not in NUMBERS:
        return fill.encode() if isinstance(fill, str) and LENGTHS[kind][0] == "binary" else fill or (b"" if LENGTHS[kind][0] == "binary" else "")
    if isinstance(fill, str) and fill.startswith("0x"):
        return np.frombuffer(bytes.fromhex(fill[2:]), f">{NUMBERS[kind][0]}")[0].item()
    return float(fill.replace("Infinity", "inf")) if isinstance(fill, str) else fill


def _unpacked(raw: bytes, codec: dict) -> bytes:
    """Undo one codec from bytes to bytes."""
    name = codec["name"]
    if name == "crc32c":
        body, (want,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if crc32c(body) != want:
            raise ValueError("a checksum does not agree")
        return body
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name == "gzip":
        return gzip.decompress(raw)
    raise ValueError(f"unsupported codec: {name!r}")


def _lengths(raw: bytes, n: int, text: bool) -> list:
    (count,), at, out = struct.unpack_from("<I", raw), 4, []
    if count != n:
        raise ValueError(f"a chunk of {count} items where {n} are due")
    for _ in range(n):
        (size,) = struct.unpack_from("<I", raw, at)
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(raw):
        raise ValueError("a chunk of items has bytes left over")
    return [x.decode() for x in out] if text else out


def decode(raw: bytes | None, codecs: list[dict], n: int, kind: str, fill) -> list | np.ndarray:
    """The n values of a chunk; no bytes mean the fill value throughout."""
    if raw is None:
        return np.full(n, fill, NUMBERS[kind][0]) if kind in NUMBERS else [fill] * n
    *packers, last = reversed([c for c in codecs if c["name"] != "transpose"])  # of one dimension: nothing to do
    for codec in packers:
        raw = _unpacked(raw, codec)
    own = last.get("configuration") or {}
    if last["name"] == "sharding_indexed":
        return _shard(raw, own, n, kind, fill)
    if kind in NUMBERS and last["name"] == "bytes":
        out = np.frombuffer(raw, (">" if own.get("endian") == "big" else "<") + NUMBERS[kind][0])
        if len(out) != n:
            raise ValueError(f"a chunk of {len(out)} values where {n} are due")
        return out.astype(NUMBERS[kind][0])
    if kind in LENGTHS and last["name"] == LENGTHS[kind][1]:
        return _lengths(raw, n, kind == "string")
    raise ValueError(f"the codec {last['name']!r} does not fit {kind!r}")


def _shard(raw: bytes, own: dict, n: int, kind: str, fill) -> list | np.ndarray:
    """The inner chunks of a shard, by the index of offsets and sizes at its end or start."""
    (inner,) = own["chunk_shape"]
    if n % inner:
        raise ValueError("inner chunks do not fill their shard")
    count = n // inner
    size = 16 * count + 4 * sum(c["name"] == "crc32c" for c in own["index_codecs"])
    index = raw[:size] if own.get("index_location", "end") == "start" else raw[len(raw) - size :]
    places = decode(index, own["index_codecs"], 2 * count, "uint64", 0).reshape(count, 2)
    parts = [decode(None if at == size_ == ABSENT else raw[at : at + size_], own["codecs"], inner, kind, fill) for at, size_ in places.tolist()]
    return np.concatenate(parts) if kind in NUMBERS else [x for p in parts for x in p]


def array_values(name: str, objects: dict[str, bytes]) -> list | np.ndarray:
    """All values of the array with this name from a group's objects (key -> bytes)."""
    meta = json.loads(objects[f"{name}/{NODE}"])
    if len(meta["shape"]) != 1:
        raise ValueError(f"{name} has {len(meta['shape'])} dimensions, not one")
    (n,), (step,) = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    keys = meta.get("chunk_key_encoding") or {"name": "default"}
    mark = (keys.get("configuration") or {}).get("separator", "/" if keys["name"] == "default" else ".")
    head = f"{name}/c{mark}" if keys["name"] == "default" else f"{name}/"
    kind, fill = meta["data_type"], fill_of(meta)
    parts = [decode(objects.get(f"{head}{i}"), meta["codecs"], step, kind, fill) for i in range(-(-n // step))]
    if kind in NUMBERS:
        return np.concatenate(parts)[:n] if parts else np.zeros(0, NUMBERS[kind][0])
    return [x for p in parts for x in p][:n]


def column(values: list | np.ndarray, kind: str) -> pa.Array:
    """As Spark holds it: NaN is null, unsigned 64-bit numbers keep their bits."""
    if kind in LENGTHS:
        return pa.array(values, pa.binary() if LENGTHS[kind][0] == "binary" else pa.string())
    if kind in ("float32", "float64"):
        return pa.array(values, mask=np.isnan(values))
    wider = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}
    return pa.array(values.view(np.int64) if kind == "uint64" else values.astype(wider.get(kind, values.dtype)))


# -- stores


_META = "shard string, window string, stamped boolean, encoding string, env_order int, sidecar string, has_bitmap boolean, box array<string>, cells_with_data bigint, granule_count bigint, written_at string"


def _stamps(batches):  # noqa: ANN001, ANN202
    names = [x.split()[0] for x in _META.split(", ")]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        rows = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            m = _LEAF.search(path)
            found = [v for v in (json.loads(text).get("attributes") or {}).values() if isinstance(v, dict) and v.get("complete") is True]
            stamp = found[0] if found else {}
            cover = stamp.get("coverage") if isinstance(stamp.get("coverage"), dict) else {}
            bitmap = cover.get("encoding") == "bitmap" and bool(cover.get("sidecar"))
            rows.append((m[1], m[2], bool(found), cover.get("encoding", "absent"), cover.get("cell_order"), cover.get("sidecar"), bitmap, [x for x in cover.get("box") or [] if x], stamp.get("cells_with_data"), stamp.get("granule_count"), stamp.get("written_at")))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


class Tree:
    """A store as its writer left it: manifest, roster, leaves, cells and occupancy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = self._manifest()

    def _manifest(self) -> S.Manifest:
        for r in self.spark.read.option("pathGlobFilter", "*.json").text(self.root, wholetext=True).collect():  # the root's own few objects
            raw = json.loads(r[0])
            if isinstance(raw, dict) and {"spec", "cell_order", "shard_order"} <= set(raw):
                version = str(raw["spec"]).rsplit("/", 1)[-1]
                if version not in ("1", "2"):
                    raise ValueError(f"unsupported spec: {raw['spec']!r}")
                return S.parse_manifest(json.dumps(raw | {"spec": S.SPECS[int(version) - 1], "temporal": raw.get("temporal") if version == "2" else None}))
        raise FileNotFoundError(f"{self.root} is not a store: no object at its root has the orders")

    def _roster(self) -> dict | None:
        text = S._text(self.spark, f"{self.root}/{ROSTER}")
        try:
            raw = json.loads(text) if text else None
        except ValueError:
            return None
        return raw if isinstance(raw, dict) and raw.get("encoding") == "ranges" else None

    def ranges(self) -> DataFrame | None:
        """(ord, lo, hi) of the roster, None where there is none that can be read."""
        if (raw := self._roster()) is None:
            return None
        rows = []
        for first, last in raw.get("ranges", []):
            (o, lo), (p, hi) = C.cell(first), C.cell(last)
            if o != p or hi < lo:
                raise ValueError(f"a malformed range: {first} to {last}")
            rows.append((o, lo, hi))
        return self.spark.createDataFrame(rows, "ord int, lo bigint, hi bigint")

    def times(self) -> DataFrame | None:
        """(shard_k, start_ns, end_ns) of the shards that the roster gives a time."""
        temporal = (self._roster() or {}).get("temporal")
        if not isinstance(temporal, dict) or not str(temporal.get("spec", "")).endswith("/1") or not isinstance(temporal.get("shards"), dict):
            return None
        rows = [(C.cell(s)[1], int(np.uint64(int(w)).view(np.int64))) for s, w in temporal["shards"].items()]
        df = self.spark.createDataFrame(rows, "shard_k bigint, w bigint")
        return df.select("shard_k", T.start_ns(F.col("w")).alias("start_ns"), T.end_ns(F.col("w")).alias("end_ns"))

    def _exist(self, paths: list[str]) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()

        def there(path: str) -> bool:
            p = jvm.org.apache.hadoop.fs.Path(path)
            return p.getFileSystem(conf).exists(p)

        with ThreadPoolExecutor(32) as pool:
            return [p for p, ok in zip(paths, pool.map(there, paths), strict=True) if ok]

    def walk(self) -> list[str]:
        """Every leaf under the root, from a listing: only where there is no roster."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NODE).load(self.root).select("path").where(F.col("path").rlike(r"/-?[1-6][1-4]*(_[0-9A-Za-z-]{1,32})?\.zarr/zarr\.json$"))
        return sorted(r.path.removesuffix(f"/{NODE}") for r in found.collect())

    def leaves(self, aoi: list | None = None, window: str | None = None, when=None) -> list[str]:  # noqa: ANN001
        """Paths of the leaves that a query can touch, in the order of their cells; by the roster, without a listing."""
        S.validate_window(window, self.manifest)
        ranges, order = self.ranges(), self.manifest.shard_order
        windows = [window] if window or not self.manifest.temporal else self.manifest.temporal.get("windows")
        listed = None
        if ranges is None or not windows:
            listed = self.walk()
            shards = sorted({C.cell(_LEAF.search(p)[1])[1] for p in listed})
            ranges = self.spark.createDataFrame([(order, k, k) for k in shards], "ord int, lo bigint, hi bigint")
        cover = V.region(self.spark, aoi) if aoi else None
        wanted = [r.k for r in V.candidates(ranges, order, cover, self.times(), when).orderBy("k").collect()]
        if listed is not None:
            keep = set(wanted)
            own = [(C.cell(m[1])[1], m[2] or "", p) for p in listed if (m := _LEAF.search(p)) and (window is None or m[2] == window)]
            return [p for k, _, p in sorted(own) if k in keep]
        return self._exist([f"{self.root}/{S.leaf_path(C.cell_label(order, k), self.manifest.path_grouping, w)}" for k in wanted for w in windows])

    def leaf_meta(self, paths: list[str]) -> DataFrame:
        """shard_k, window, stamped, encoding, env_order, sidecar, has_bitmap, box and counts, one row a leaf."""
        nodes = self._exist([f"{p}/{NODE}" for p in paths])
        empty = self.spark.createDataFrame([], "path string, value string")
        text = self.spark.read.text(nodes, wholetext=True).select(F.input_file_name().alias("path"), "value") if nodes else empty
        rows = text.mapInArrow(_stamps, _META)
        box = F.transform("box", lambda x: F.struct(C.label_order(x).alias("ord"), C.label_k(x).alias("k")))
        return rows.withColumn("shard_k", C.label_k(F.col("shard"))).withColumn("box", box).drop("shard")

    def schema(self, leaf: str) -> tuple[str, dict[str, str]]:
        """The coordinate's name, and type by name of a leaf's other arrays."""
        group = f"{leaf}/{self.manifest.cell_order}"
        rows = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", NODE).text(group, wholetext=True).select("value", F.input_file_name().alias("path")).collect()  # one object an array
        own = {r.path.split("/")[-2]: json.loads(r.value) for r in rows}
        arrays = {k: v["data_type"] for k, v in own.items() if v.get("node_type") == "array"}
        declared = [v.get("attributes", {}).get("dggs", {}).get("coordinate") for v in own.values() if v.get("node_type") == "group"]
        name = next((x for x in declared if x), "morton")
        if arrays.get(name) != "uint64":
            raise ValueError(f"{leaf} has no coordinate array of packed words")
        return name, {k: v for k, v in sorted(arrays.items()) if k != name}

    def cells(self, aoi: list | None = None, window: str | None = None, when=None, columns: list[str] | None = None) -> DataFrame:  # noqa: ANN001
        """ord, k, shard_k, window and the variables, by name, of every cell of the committed leaves selected; exact on the region."""
        paths = self.leaves(aoi, window, when)
        stamped = {(r.shard_k, r.window) for r in self.leaf_meta(paths).where("stamped").select("shard_k", "window").collect()}  # one entry a leaf
        paths = [p for p in paths if (C.cell((m := _LEAF.search(p))[1])[1], m[2]) in stamped]
        empty = not paths
        if empty:
            any_ = self.leaves()
            first = self.leaf_meta(any_).where("stamped").select("shard_k", "window").head()
            if first is None:
                raise V.NoCoverageError(f"{self.root} has no committed leaf")
            warnings.warn("the region holds no data", stacklevel=2)
            paths = [next(p for p in any_ if (C.cell((m := _LEAF.search(p))[1])[1], m[2]) == tuple(first))]
        coordinate, kinds = self.schema(paths[0])
        if columns is not None and (unknown := set(columns) - set(kinds)):
            raise KeyError(f"no such arrays: {sorted(unknown)}")
        kinds = {k: kinds[k] for k in (columns if columns is not None else kinds)}
        names, group = [coordinate, *kinds], self.manifest.cell_order
        inside = r"\.zarr/%d/(.+)$" % group
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{p}/{group}" for p in paths]).select("path", "content")
        files = files.select(F.regexp_extract("path", r"([^/]+)\.zarr/", 1).alias("leaf"), F.regexp_extract("path", inside, 1).alias("key"), "content").where(F.split("key", "/")[0].isin(names))

        def leaf(table: pa.Table) -> pa.Table:
            objects = dict(zip(table.column("key").to_pylist(), table.column("content").to_pylist(), strict=True))
            label = table.column("leaf")[0].as_py()
            shard, own = S.split_leaf_name(f"{label}.zarr")
            words = array_values(coordinate, objects)
            cols = [pa.array([shard] * len(words), pa.string()), pa.array([own] * len(words), pa.string()), column(words, "uint64")]
            for name, kind in kinds.items():
                if f"{name}/{NODE}" not in objects:
                    cols.append(pa.nulls(len(words), column(decode(None, [], 0, kind, 0), kind).type))
                    continue
                values = array_values(name, objects)
                if json.loads(objects[f"{name}/{NODE}"])["data_type"] != kind or len(values) != len(words):
                    raise ValueError(f"{name} of {label} does not fit the other leaves or its cells")
                cols.append(column(values, kind))
            return pa.table(cols, names=["_shard", "_window", "_word", *kinds])

        schema = ", ".join(["_shard string", "_window string", "_word bigint", *[f"`{k}` {spark_type(v)}" for k, v in kinds.items()]])
        rows = files.groupBy("leaf").applyInArrow(leaf, schema)
        out = rows.select(C.word_order(F.col("_word")).alias("ord"), C.word_k(F.col("_word")).alias("k"), C.label_k(F.col("_shard")).alias("shard_k"), F.col("_window").alias("window"), *[f"`{k}`" for k in kinds])
        if empty:
            return out.where(F.lit(False))
        return V.in_region(out, V.region(self.spark, aoi), [self.manifest.cell_order]) if aoi else out

    def occupancy(self, leaves: DataFrame) -> DataFrame:
        """(shard_k, ord, k) of the cells that the bitmap sidecars of these leaves (of leaf_meta) mark."""
        order = self.manifest.shard_order
        rows = leaves.where("stamped and has_bitmap").select("shard_k", "window", "sidecar").collect()  # one entry a leaf
        paths = self._exist([f"{self.root}/{S.leaf_path(C.cell_label(order, r.shard_k), self.manifest.path_grouping, r.window)}/{r.sidecar}" for r in rows])
        if not paths:
            return self.spark.createDataFrame([], "shard_k bigint, ord int, k bigint")
        files = self.spark.read.format("binaryFile").load(paths)
        label = F.regexp_extract("path", r"/(-?[1-6][1-4]*)(_[0-9A-Za-z-]{1,32})?\.zarr/", 1)
        return V.decode_bitmaps(files.select(C.label_k(label).alias("shard_k"), F.col("content").alias("payload")), order, self.manifest.cell_order)

    def ingest(self, root: str, window: str | None = None) -> S.Store:
        """Write the cells as the Parquet tables of a store, once; later queries prune partitions and columns there."""
        df = self.cells(window=window).drop("shard_k", "window")
        return S.write_store(df, root, self.manifest.cell_order, self.manifest.shard_order, window, self.manifest.temporal, self.manifest.pyramid)
