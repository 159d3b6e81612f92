"""Longitude and latitude of cells: HEALPix in the nested scheme, vectorised, as Arrow functions.

Latitudes may be authalic (the sphere's, after the ellipsoid's equal-area mapping; the default) or spherical.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_COL = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])
_E2 = 0.00669437999014132  # of the WGS84 ellipsoid


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for mask, shift in ((0x0000FFFF0000FFFF, 16), (0x00FF00FF00FF00FF, 8), (0x0F0F0F0F0F0F0F0F, 4), (0x3333333333333333, 2), (0x5555555555555555, 1)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) & np.uint64(0x5555555555555555)
    for mask, shift in ((0x3333333333333333, 1), (0x0F0F0F0F0F0F0F0F, 2), (0x00FF00FF00FF00FF, 4), (0x0000FFFF0000FFFF, 8), (0x00000000FFFFFFFF, 16)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def _q(s: np.ndarray) -> np.ndarray:
    e = np.sqrt(_E2)
    return (1 - _E2) * (s / (1 - _E2 * s * s) + np.arctanh(e * s) / e)


def to_authalic(lat: np.ndarray) -> np.ndarray:
    return np.degrees(np.arcsin(np.clip(_q(np.sin(np.radians(lat))) / _q(np.array(1.0)), -1, 1)))


def from_authalic(lat: np.ndarray) -> np.ndarray:
    want, s = np.sin(np.radians(lat)) * _q(np.array(1.0)), np.sin(np.radians(lat))
    for _ in range(8):  # Newton's method on q
        s = np.clip(s - (_q(s) - want) * (1 - _E2 * s * s) ** 2 / (2 * (1 - _E2)), -1, 1)
    return np.degrees(np.arcsin(s))


def _place(face: np.ndarray, x: np.ndarray, y: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and sphere latitude of the point (x, y) of a face, in pixels from its southern corner."""
    jr = _ROW[face] * n - x - y
    north, south = jr < n, jr > 3 * n
    nr = np.where(north, jr, np.where(south, 4 * n - jr, n))
    z = np.where(north, 1 - nr * nr / (3 * n * n), np.where(south, nr * nr / (3 * n * n) - 1, (2 * n - jr) * 2 / (3 * n)))
    jp = _COL[face] * nr + x - y
    lon = np.where(nr > 0, jp / np.where(nr > 0, nr, 1), 0) * 45.0
    return (lon + 180) % 360 - 180, np.degrees(np.arcsin(np.clip(z, -1, 1)))


def centers(pixel: np.ndarray, order: int, authalic: bool = True) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << order
    face, inside = pixel >> 2 * order, pixel & (n * n - 1)
    lon, lat = _place(face, _gather(inside) + 0.5, _gather(inside >> 1) + 0.5, float(n))
    return lon, from_authalic(lat) if authalic else lat


def corners(pixel: np.ndarray, order: int, authalic: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """South, east, north and west corners; longitudes are brought to within half a turn of the first."""
    n = 1 << order
    face, inside = pixel >> 2 * order, pixel & (n * n - 1)
    x, y = _gather(inside), _gather(inside >> 1)
    out = []
    middle, _ = _place(face, x + 0.5, y + 0.5, float(n))
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)):
        lon, lat = _place(face, x + dx, y + dy, float(n))
        lon = np.where(np.abs(lat) > 90 - 1e-9, middle, lon)
        lon = middle + (lon - middle + 180) % 360 - 180
        out.append((lon, from_authalic(lat) if authalic else lat))
    return out


def pixels(lon: np.ndarray, lat: np.ndarray, order: int, authalic: bool = True) -> np.ndarray:
    """Nested pixel numbers of points in degrees."""
    n = 1 << order
    lat = to_authalic(np.asarray(lat, float)) if authalic else np.asarray(lat, float)
    z, tt = np.sin(np.radians(lat)), (np.asarray(lon, float) % 360) / 90.0
    za = np.abs(z)
    a, b = n * (0.5 + tt), n * z * 0.75
    jp, jm = np.floor(a - b).astype(np.int64), np.floor(a + b).astype(np.int64)
    fp, fm = jp >> order, jm >> order
    face = np.where(fp == fm, (fp & 3) | 4, np.where(fp < fm, fp & 3, (fm & 3) + 8))
    ix, iy = jm & (n - 1), n - (jp & (n - 1)) - 1
    nt = np.minimum(tt.astype(np.int64), 3)
    tp, tmp = tt - nt, n * np.sqrt(3 * np.maximum(1 - za, 0))
    kp, km = np.minimum((tp * tmp).astype(np.int64), n - 1), np.minimum(((1 - tp) * tmp).astype(np.int64), n - 1)
    polar = za > 2 / 3
    face = np.where(polar, np.where(z >= 0, nt, nt + 8), face)
    ix = np.where(polar, np.where(z >= 0, n - km - 1, kp), ix)
    iy = np.where(polar, np.where(z >= 0, n - kp - 1, km), iy)
    return (face.astype(np.int64) << 2 * order) + (_spread(ix) | _spread(iy) << np.uint64(1)).astype(np.int64)


def with_centers(df: DataFrame, order: int, k: str = "k", authalic: bool = True) -> DataFrame:
    """df with lon and lat of its cells' centres; all of one order."""
    first = 1 << 2 * order

    @F.pandas_udf("lon double, lat double")
    def at(cells):  # noqa: ANN001
        import pandas as pd

        lon, lat = centers(cells.to_numpy() - first, order, authalic)
        return pd.DataFrame({"lon": lon, "lat": lat})

    return df.withColumn("_at", at(k)).select(*df.columns, "_at.lon", "_at.lat")


def with_cells(df: DataFrame, order: int, lon: str = "lon", lat: str = "lat", authalic: bool = True) -> DataFrame:
    """df with ord and k of the cell in which each point lies."""

    @F.pandas_udf("bigint")
    def cell(x, y):  # noqa: ANN001
        import pandas as pd

        return pd.Series(pixels(x.to_numpy(), y.to_numpy(), order, authalic) + (1 << 2 * order))

    return df.withColumn("ord", F.lit(order)).withColumn("k", cell(lon, lat))


def with_boundaries(df: DataFrame, order: int, k: str = "k", authalic: bool = True) -> DataFrame:
    """df with boundary, the four corners, and wkt, the closed polygon."""
    first = 1 << 2 * order

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def around(cells):  # noqa: ANN001
        four = corners(cells.to_numpy() - first, order, authalic)
        import pandas as pd

        return pd.Series([[{"lon": float(a[i]), "lat": float(b[i])} for a, b in four] for i in range(len(cells))])

    df = df.withColumn("boundary", around(k))
    point = lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))
    ring = F.concat(F.transform("boundary", point), F.array(point(F.get("boundary", 0))))
    return df.withColumn("wkt", F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))")))


def select_points(rows: DataFrame, points: DataFrame, order: int, authalic: bool = True) -> DataFrame:
    """Each point with the row of its cell."""
    return with_cells(points, order, authalic=authalic).join(rows, ["ord", "k"])
