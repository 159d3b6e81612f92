"""Leaves written here by hand, object by object, read back."""

import json
import math
import struct

import numpy as np
import pytest
import zstandard

from sphereframe.functions import cells as C
from sphereframe.operators.coverage import NoCoverageError
from sphereframe.sources import store as S
from sphereframe.sources import zarr as Z

BYTES, ZSTD, CRC = {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {}}, {"name": "crc32c"}


def sharded(inner, codecs):
    return [{"name": "sharding_indexed", "configuration": {"chunk_shape": [inner], "codecs": codecs, "index_codecs": [BYTES, CRC], "index_location": "end"}}]


def meta(n, step, kind, fill, codecs):
    grid = {"name": "regular", "configuration": {"chunk_shape": [step]}}
    return json.dumps({"zarr_format": 3, "node_type": "array", "shape": [n], "data_type": kind, "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs, "attributes": {}}).encode()


def shard(parts):
    """Inner chunks (None: absent) with their index and its checksum."""
    body, index = b"", b""
    for p in parts:
        index += struct.pack("<QQ", Z.ABSENT, Z.ABSENT) if p is None else struct.pack("<QQ", len(body), len(p))
        body += p or b""
    return body + index + struct.pack("<I", Z.crc32c(index))


def items(values):
    return struct.pack("<I", len(values)) + b"".join(struct.pack("<I", len(v)) + v for v in values)


def put(path, raw):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


def build(root, listed=("4111", "4112"), leaves=("4111", "4112", "-5113"), bare=("-5113",)):
    """Orders 5 and 3: 16 cells a leaf."""
    put(root / "any_name.json", json.dumps({"spec": "some-tree/1", "cell_order": 5, "shard_order": 3, "path_grouping": 1}).encode())
    if listed:
        put(root / "coverage.moc", json.dumps({"encoding": "ranges", "order": 3, "ranges": [[x, x] for x in listed]}).encode())
    squeeze = zstandard.ZstdCompressor().compress
    for label in leaves:
        leaf = root / S.leaf_path(label)
        k = C.cell(label)[1] * 16 + np.arange(16)
        words = np.array([C.cell_word(5, int(x)) for x in k], "<u8")
        bits = np.packbits(np.arange(16) % 3 == 0).tobytes()
        stamp = {"complete": True, "cells_with_data": 6, "granule_count": 2, "written_at": "x", "coverage": {"encoding": "bitmap", "sidecar": "coverage.moc", "cell_order": 5, "box": [label, None, None, None]}}
        put(leaf / "zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {} if label in bare else {"stamp": stamp}}).encode())
        put(leaf / "coverage.moc", squeeze(bits))
        put(leaf / "5/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"dggs": {"coordinate": "morton"}}}).encode())
        put(leaf / "5/morton/zarr.json", meta(16, 16, "uint64", 0, sharded(4, [BYTES])))
        put(leaf / "5/morton/c/0", shard([words[i : i + 4].tobytes() for i in range(0, 16, 4)]))
        put(leaf / "5/count/zarr.json", meta(16, 8, "int32", 7, [BYTES, ZSTD]))
        put(leaf / "5/count/c/1", squeeze(np.arange(8, 16, dtype="<i4").tobytes()))  # the first chunk is absent
        put(leaf / "5/height/zarr.json", meta(16, 16, "float32", "NaN", [BYTES]))
        put(leaf / "5/height/c/0", np.where(np.arange(16) % 2, np.nan, np.arange(16)).astype("<f4").tobytes())
        put(leaf / "5/digest/zarr.json", meta(16, 16, "variable_length_bytes", "", sharded(4, [{"name": "vlen-bytes"}, ZSTD])))
        put(leaf / "5/digest/c/0", shard([squeeze(items([b"a" * i for i in range(4)])), None, squeeze(items([b"z"] * 4)), None]))


@pytest.fixture
def tree(spark, tmp_path):
    build(tmp_path)
    return Z.Tree(spark, str(tmp_path))


def test_checksum():
    assert Z.crc32c(b"123456789") == 0xE3069283


def test_cells(tree):
    rows = {r.k: r for r in tree.cells().collect()}
    for label in ("4111", "4112"):
        first = C.cell(label)[1] * 16
        for i in range(16):
            r = rows[first + i]
            assert (r.ord, r.shard_k, r.window) == (5, first // 16, None)
            assert r["count"] == (i if i >= 8 else 7) and r.height == (None if i % 2 else float(i))
            assert bytes(r.digest) == (b"a" * i if i < 4 else b"z" if 8 <= i < 12 else b"")
    assert len(rows) == 32  # the leaf without a stamp and entry stays out


def test_region_columns_and_window(tree, spark):
    df = tree.cells(aoi=["411112"], columns=["count"])
    assert df.columns == ["ord", "k", "shard_k", "window", "count"] and [r.k for r in df.collect()] == [C.cell("411112")[1]]
    assert len(tree.leaves(aoi=["4112"])) == 1
    with pytest.warns(UserWarning, match="no data"):
        none = tree.cells(aoi=["-6111"])
    assert none.count() == 0 and "digest" in none.columns
    with pytest.raises(KeyError):
        tree.cells(columns=["absent"])
    with pytest.raises(ValueError):
        tree.cells(window="2019")


def test_leaf_meta_and_occupancy(tree):
    leaves = tree.leaf_meta(tree.leaves())
    rows = leaves.orderBy("shard_k").collect()
    assert [(r.stamped, r.encoding, r.env_order, r.cells_with_data, [(b.ord, b.k) for b in r.box]) for r in rows] == [(True, "bitmap", 5, 6, [C.cell(x)]) for x in ("4111", "4112")]
    got = {(r.shard_k, r.k) for r in tree.occupancy(leaves).collect()}
    assert got == {(s, s * 16 + i) for s in (C.cell("4111")[1], C.cell("4112")[1]) for i in range(0, 16, 3)}


def test_without_a_roster_leaves_are_listed(spark, tmp_path):
    build(tmp_path, listed=())
    tree = Z.Tree(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in tree.leaves()] == ["4111.zarr", "4112.zarr", "-5113.zarr"]
    assert tree.cells().count() == 32


def test_a_store_of_debris_only(spark, tmp_path):
    build(tmp_path, listed=("-5113",), leaves=("-5113",))
    with pytest.raises(NoCoverageError):
        Z.Tree(spark, str(tmp_path)).cells()


def test_a_broken_checksum_is_an_error(spark, tmp_path):
    build(tmp_path)
    path = tmp_path / S.leaf_path("4111") / "5/morton/c/0"
    path.write_bytes(path.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="checksum"):
        Z.Tree(spark, str(tmp_path)).cells(columns=["count"]).collect()


def test_not_a_store(spark, tmp_path):
    put(tmp_path / "x.json", b"{}")
    with pytest.raises(FileNotFoundError):
        Z.Tree(spark, str(tmp_path))


def test_ingest(tree, tmp_path):
    store = tree.ingest(str(tmp_path / "out"))
    want = {(r.k, r["count"], r.height) for r in tree.cells().collect()}
    assert {(r.k, r["count"], r.height) for r in store.open().collect()} == want


@pytest.mark.parametrize(("kind", "fill", "want"), [("float32", "NaN", math.nan), ("float64", "-Infinity", -math.inf), ("float32", "0x7fc00000", math.nan), ("int16", 3, 3), ("variable_length_bytes", "", b"")])
def test_fill_values(kind, fill, want):
    got = Z.fill_of({"data_type": kind, "fill_value": fill})
    assert got == want or math.isnan(got) and math.isnan(want)


def test_types_and_codecs_that_do_not_fit():
    with pytest.raises(ValueError):
        Z.spark_type("complex64")
    with pytest.raises(ValueError):
        Z.decode(b"", [BYTES, {"name": "blosc"}], 0, "int8", 0)
    with pytest.raises(ValueError):
        Z.decode(b"\0" * 8, [BYTES], 3, "int32", 0)
    assert Z.column(np.array([1, 2**64 - 1], "u8"), "uint64").to_pylist() == [1, -1]
    assert Z.column(np.array([200], "u1"), "uint8").to_pylist() == [200]
    assert Z.decode(struct.pack(">h", 5), [{"name": "bytes", "configuration": {"endian": "big"}}], 1, "int16", 0).tolist() == [5]
