"""The grid queries over the driver's tables, each with SQL that gives the same rows.

Cells are derived from keys by integer arithmetic: events and orders at order 8, lineitem at order 9.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.functions import cells as C
from sphereframe.functions import geo as G
from sphereframe.functions import lanes as L
from sphereframe.functions import temporal as T
from sphereframe.operators import coverage as V
from sphereframe.operators import domain as D
from sphereframe.operators import joins as J
from sphereframe.operators import moc as M
from sphereframe.operators import nested as N
from sphereframe.operators import verify as Y
from sphereframe.sources import store as S
from sphereframe.sources import telemetry as E


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _k(order: int, a: str, rest: str) -> str:
    n = 4**order
    return f"(1 + {a} % 12) * {n} + ({rest}) % {n}"


EVENT_K = _k(8, "event_id", "event_id * 7919 + user_id * 104729")
ORDER_K = _k(8, "o_orderkey", "o_orderkey * 7919 + o_custkey * 104729")
LINE_K = _k(9, "l_orderkey", "l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31")
EV = f"SELECT *, 8 AS ord, CAST({EVENT_K} AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events"
OR = f"SELECT *, 8 AS ord, CAST({ORDER_K} AS BIGINT) AS k FROM orders"
LI = f"SELECT *, 9 AS ord, CAST({LINE_K} AS BIGINT) AS k FROM lineitem"
#: A region of mixed orders 2 to 4 and 10: one member a nation.
_AO = "CASE WHEN n_nationkey % 5 = 4 THEN 10 ELSE 2 + n_nationkey % 3 END"
_AK = "(1 + n_nationkey % 12) * pow4 + (n_nationkey * 37) % pow4"
AOI = f"SELECT ord, CAST({_AK} AS BIGINT) AS k FROM (SELECT n_nationkey, {_AO} AS ord, CAST(pow(4, {_AO}) AS BIGINT) AS pow4 FROM nation)"
ORDERS = [2, 3, 4, 10]


def events(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "events").select("*", F.lit(8).alias("ord"), F.expr(EVENT_K).cast("long").alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def orders(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "orders").select("*", F.lit(8).alias("ord"), F.expr(ORDER_K).cast("long").alias("k"))


def lines(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "lineitem").select("*", F.lit(9).alias("ord"), F.expr(LINE_K).cast("long").alias("k"))


def region(s: SparkSession, d: str) -> DataFrame:
    o = F.expr(_AO)
    return _read(s, d, "nation").select("n_nationkey", o.alias("ord"), F.pow(F.lit(4), o).cast("long").alias("pow4")).select("ord", F.expr(_AK).cast("long").alias("k"))


def _in_region(s: SparkSession, d: str) -> DataFrame:
    return M.cells_in(events(s, d), F.broadcast(region(s, d)), ORDERS, [8])  # 25 nations


_MASK = f"WITH e AS ({EV}), m AS (SELECT CAST(k * pow(4, 10 - ord) AS BIGINT) AS lo, CAST((k + 1) * pow(4, 10 - ord) AS BIGINT) - 1 AS hi FROM ({AOI}))"
_HIT = "EXISTS (SELECT 1 FROM m WHERE e.k * 16 <= m.hi AND m.lo <= e.k * 16 + 15)"


def flagship(s: SparkSession, d: str) -> DataFrame:
    fine = J.rollup(_in_region(s, d), 6, [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")])
    coarse = J.rollup(events(s, d), 2, [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")])
    both = J.join_coarse(fine, coarse, ["n", "cents"], how="inner", suffix="_coarse")
    return both.select("ord", "k", C.label("k", "ord").alias("label"), "n", "cents", "n_coarse", "cents_coarse", (F.col("cents") * F.col("n_coarse") - F.col("cents_coarse") * F.col("n")).alias("anomaly"))


def _label_sql(k: str, order: int) -> str:
    return f"(CASE WHEN ({k} >> {2 * order}) > 6 THEN '-' ELSE '' END) || CAST((({k} >> {2 * order}) - 1) % 6 + 1 AS VARCHAR) || array_to_string(list_transform(range({order - 1}, -1, -1), lambda i: CAST((({k} >> (2 * i)) & 3) + 1 AS VARCHAR)), '')"


def _dense(s: SparkSession, d: str) -> DataFrame:
    """The cells of order 4 with a purchase or a click."""
    return events(s, d).where(F.col("event_type").isin("purchase", "click")).select(F.lit(4).alias("ord"), C.parent("k", "ord", F.lit(4)).alias("k")).distinct()


_DENSE = f"SELECT DISTINCT k >> 8 AS k FROM ({EV}) WHERE event_type IN ('purchase', 'click')"
_DENSE_B = f"SELECT DISTINCT k >> 8 AS k FROM ({OR}) WHERE o_orderstatus = 'F'"


def _dense_b(s: SparkSession, d: str) -> DataFrame:
    """The cells of order 4 with a filled order."""
    return orders(s, d).where("o_orderstatus = 'F'").select(F.lit(4).alias("ord"), C.parent("k", "ord", F.lit(4)).alias("k")).distinct()


def _canonical_sql(cells: str, order: int = 4) -> str:
    """Each cell rises as far as its ancestors are whole; an ancestor of a gap is not, so the levels can be counted."""
    whole = " + ".join(f"CAST(count(*) OVER (PARTITION BY k >> {2 * j}) = {4**j} AS INT)" for j in range(1, order + 1))
    return f"SELECT DISTINCT {order} - j AS ord, k >> (2 * j) AS k FROM (SELECT k, {whole} AS j FROM ({cells}) AS c) AS l"


def _runs_sql(cells: str) -> str:
    return f"SELECT min(k) AS lo, max(k) AS hi FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM ({cells})) GROUP BY g"


def _domain(s: SparkSession, d: str) -> DataFrame:
    return D.from_cells(_dense(s, d), 4)


_POS = f"SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM ({_DENSE})"


def _probe(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "customer").select("c_custkey", F.expr(_k(4, "c_custkey", "c_custkey * 7919")).cast("long").alias("k"))


_PROBE = f"SELECT c_custkey, CAST({_k(4, 'c_custkey', 'c_custkey * 7919')} AS BIGINT) AS k FROM customer"


def _part_word(s: SparkSession, d: str) -> DataFrame:
    n = F.lit(100).cast("long")
    parts = [(F.col("p_partkey") * (i + 3) % 101).cast("long") for i in range(8)]
    return _read(s, d, "part").select("p_partkey", "p_size", L.pack(parts, n).alias("w"))


_LANE = [f"(CASE WHEN p_partkey * {i + 3} % 101 > 0 THEN greatest(CAST(round_even(255 * (p_partkey * {i + 3} % 101) / 100.0, 0) AS BIGINT), 1) ELSE 0 END)" for i in range(8)]


def lanes(s: SparkSession, d: str) -> DataFrame:
    w = _part_word(s, d)
    return w.select("p_partkey", *[L.lane(F.col("w"), i).cast("long").alias(x) for i, x in enumerate(L.LANES)], F.aggregate(L.counts(F.col("w"), F.col("p_size").cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter(L.present(F.col("w")), lambda x: x)).alias("n_present"))


_LANES_SQL = f"SELECT p_partkey, {', '.join(f'{e} AS {x}' for e, x in zip(_LANE, L.LANES, strict=True))}, {' + '.join(f'CAST(round_even(({e}) * p_size / 255.0, 0) AS BIGINT)' for e in _LANE)} AS total, CAST({' + '.join(f'CAST(({e}) > 0 AS INT)' for e in _LANE)} AS INT) AS n_present FROM part"

#: Shards of order 3 with times: those without a signup are not listed.
_TIMES = f"SELECT k >> 10 AS shard_k, min(epoch_us(ts)) * 1000 AS start_ns, max(epoch_us(ts)) * 1000 + 1 AS end_ns FROM ({EV}) WHERE event_type = 'signup' GROUP BY k >> 10"
#: Half a minute from each event on.
_SPANS = "SELECT epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + 30000000000 AS end_ns FROM events"
_WHEN = (1_704_067_200_000_000_000, 1_704_070_800_000_000_000)


def _times(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).where("event_type = 'signup'").withColumn("s", C.parent("k", "ord", F.lit(3)))
    us = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.groupBy(F.col("s").alias("shard_k")).agg(F.min(us).alias("start_ns"), (F.max(us) + 1).alias("end_ns"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return _read(s, d, "events").select(us.alias("start_ns"), (us + 30 * 10**9).alias("end_ns"))


def _shards(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(C.parent("k", "ord", F.lit(3)).alias("k")).distinct()


_SHARDS = f"SELECT DISTINCT k >> 10 AS k FROM ({EV})"


def _errors(s: SparkSession, d: str) -> DataFrame:
    """The shards of order 3 with an error of a low value."""
    return events(s, d).where("event_type = 'error' AND value < 50").select(C.parent("k", "ord", F.lit(3)).alias("k")).distinct()


_ERRORS = f"SELECT DISTINCT k >> 10 AS k FROM ({EV}) WHERE event_type = 'error' AND value < 50"


def _ranges(s: SparkSession, d: str) -> DataFrame:
    """Inclusive shard ranges of order 3, one a supplier."""
    return _read(s, d, "supplier").select(F.lit(3).alias("ord"), F.expr("64 + s_suppkey * 53 % 700").cast("long").alias("lo"), F.expr("64 + s_suppkey * 53 % 700 + s_suppkey % 4").cast("long").alias("hi"))


_RANGES = "SELECT 3 AS ord, CAST(64 + s_suppkey * 53 % 700 AS BIGINT) AS lo, CAST(64 + s_suppkey * 53 % 700 + s_suppkey % 4 AS BIGINT) AS hi FROM supplier"


def _leaves(s: SparkSession, d: str, source: DataFrame, order: int) -> DataFrame:
    kind = F.col("shard_k") % 3
    box = F.array(F.struct(F.lit(order + 1).alias("ord"), (F.col("shard_k") * 4).alias("k")))
    return source.select(C.parent("k", "ord", F.lit(order)).alias("shard_k")).distinct().select("shard_k", (F.col("shard_k") % 11 != 5).alias("stamped"), F.when(kind == 0, "full").when(kind == 1, "bitmap").otherwise("absent").alias("encoding"), (kind == 1).alias("has_bitmap"), box.alias("box"), F.lit(8).alias("env_order"))


def _parts(s: SparkSession, d: str, source: DataFrame, degrade: str = "skip") -> DataFrame:
    cells = source.select("ord", "k").withColumn("shard_k", C.parent("k", "ord", F.lit(3))).select("shard_k", C.parent("k", "ord", F.lit(8)).alias("k")).distinct()
    return J.leaf_parts(_leaves(s, d, source, 3), cells, 3, 3, 7, degrade)


def _parts_sql(name: str, cells: str, shift: int) -> str:
    """Cells of order 7: exact ones of bitmap leaves, all of full ones."""
    return f"""{name}_l AS (SELECT DISTINCT k >> {shift + 10} AS s FROM ({cells}) WHERE (k >> {shift + 10}) % 11 != 5),
{name} AS (SELECT DISTINCT k >> {shift + 2} AS k FROM ({cells}) WHERE (k >> {shift + 10}) IN (SELECT s FROM {name}_l WHERE s % 3 = 1)
UNION SELECT s * 256 + i AS k FROM (SELECT s, unnest(range(256)) AS i FROM {name}_l WHERE s % 3 = 0))"""


_AND = f"WITH {_parts_sql('a', EV, 0)}, {_parts_sql('b', LI, 2)} SELECT k FROM a INTERSECT SELECT k FROM b"


def _stats(s: SparkSession, d: str, order: int = 4) -> DataFrame:
    """The records of shards: no string is aggregated over all rows, which would sort them, and none is repeated for a distinct count.

    The greatest event_id as text is the greatest or the least number of some length.
    """
    e = events(s, d).withColumn("shard_k", C.parent("k", "ord", F.lit(order)))
    rows = e.groupBy("shard_k", "event_type", F.length(F.col("event_id").cast("string")).alias("digits")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.max("user_id").alias("max_user"), F.max("event_id").alias("hi"), F.min("event_id").alias("lo"), F.bool_and(F.col("event_id") > 3).alias("success")
    )
    counts = [e.select("shard_k", c).distinct().groupBy("shard_k").agg(F.count(c).alias(name)) for c, name in (("user_id", "n_granules"), ("k", "cells_with_data"))]
    for part in counts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    text = F.greatest(F.col("hi").cast("string"), F.col("lo").cast("string"))
    return rows.groupBy("shard_k").agg(
        F.lit(1).cast("long").alias("n_shards"), F.sum("n_granules").alias("n_granules"), F.sum("n_obs").alias("n_obs"), F.sum("cells_with_data").alias("cells_with_data"), (F.sum("n_obs") / 4).alias("duration_s"),
        F.max("max_user").cast("double").alias("max_memory_mb"), F.max(text).alias("timestamp"), F.bool_and("success").alias("success"), F.min("event_type").alias("semantic_hash"),
    )


_STATS = f"SELECT k >> 8 AS shard_k, count(DISTINCT user_id) AS n_granules, count(*) AS n_obs, count(DISTINCT k) AS cells_with_data, count(*) / 4.0 AS duration_s, max(user_id) AS max_memory_mb, max(CAST(event_id AS VARCHAR)) AS timestamp, bool_and(event_id > 3) AS success, min(event_type) AS semantic_hash FROM ({EV}) GROUP BY k >> 8"


def _digests(s: SparkSession, d: str) -> DataFrame:
    """At order 4: centroids of a cell are its users' order-free means in whole numbers."""
    e = events(s, d).where("event_type = 'error'").withColumn("c", C.parent("k", "ord", F.lit(4)))
    per = e.groupBy("c", (F.col("event_id") % 37).cast("double").alias("mean")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return per.groupBy(F.lit(4).alias("ord"), F.col("c").alias("k")).agg(F.sort_array(F.collect_list(F.struct("mean", "weight"))).alias("digest"))


_CENTROIDS = f"SELECT k >> 8 AS k, event_id % 37 AS mean, count(*) AS weight FROM ({EV}) WHERE event_type = 'error' GROUP BY 1, 2"
#: Of each cell the quantiles 0.05 and 0.95: linear between the middles of its centroids, bounded by its first and last mean.
_TAILS = f"""WITH c AS (SELECT k, CAST(mean AS DOUBLE) AS mean, sum(weight) OVER (PARTITION BY k ORDER BY mean) - weight / 2.0 AS mid, sum(weight) OVER (PARTITION BY k) AS t FROM ({_CENTROIDS})),
n AS (SELECT *, lead(mean) OVER w AS mean2, lead(mid) OVER w AS mid2, lag(mid) OVER w AS mid0 FROM c WINDOW w AS (PARTITION BY k ORDER BY mean)),
q AS (SELECT k, p, CASE WHEN mid0 IS NULL AND p * t < mid THEN mean WHEN mid2 IS NULL THEN mean ELSE mean + (p * t - mid) / (mid2 - mid) * (mean2 - mean) END AS v FROM n, (VALUES (0.05), (0.95)) AS p(p) WHERE (mid <= p * t OR mid0 IS NULL) AND (mid2 IS NULL OR p * t < mid2)),
tails AS (SELECT k, min(v) FILTER (p < 0.5) AS lo, max(v) FILTER (p > 0.5) AS hi FROM q GROUP BY k)"""


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """(shard_k, payload) of the events' cells of order 6 in shards of order 3: compressed bitmaps, first bit first."""

    @F.pandas_udf("binary")
    def pack(ranks):  # noqa: ANN001
        import numpy as np
        import zstandard

        def one(r):  # noqa: ANN001
            bits = np.zeros(64, np.uint8)
            bits[np.asarray(r, int)] = 1
            return zstandard.ZstdCompressor().compress(np.packbits(bits).tobytes())

        return ranks.map(one)

    cells = events(s, d).select(C.parent("k", "ord", F.lit(6)).alias("k")).distinct()
    return cells.groupBy(F.shiftright("k", 6).alias("shard_k")).agg(F.collect_list(F.col("k").bitwiseAND(F.lit(63))).alias("r")).select("shard_k", pack("r").alias("payload"))


_STORES: dict[tuple[str, str], str] = {}


def _catalog(s: SparkSession, d: str) -> str:
    """A root of two products with pyramids, records and a roster, written once for each application and input."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STORES:
        base = s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sphereframe-store-")
        root = f"{base.rstrip('/')}/sphereframe-store/{uuid.uuid4().hex}"
        pyramid = {"overview": {"orders": [2]}}
        for name, source in (("events", events(s, d)), ("orders", orders(s, d))):
            cells = source.groupBy("ord", "k").agg(F.count(F.lit(1)).alias("count"))
            written = S.write_store(cells, f"{root}/{name}", 8, 3, pyramid=pyramid).cells
            Y.pyramid_level(written, {"count": "sum"}, 7).select("*", F.lit(2).alias("anc_order"), F.lit("all").alias("window"), F.lit("overview").alias("role")).write.parquet(f"{root}/{name}/overview")
        _stats(s, d, 3).write.parquet(f"{root}/events/leaf_stats")
        node = F.shiftright("shard_k", 2).alias("node_k")
        nodes = s.read.parquet(f"{root}/events/leaf_stats").groupBy(F.lit(2).alias("anc_order"), F.lit("all").alias("window"), node).agg(F.sum("n_obs").alias("n_obs"))
        nodes.where("n_obs > 40").write.parquet(f"{root}/events/overview_stats")
        _STORES[key] = root
    return _STORES[key]


def _products(s: SparkSession, d: str) -> DataFrame:
    rows = [(n, m.cell_order, m.shard_order, m.spec) for n, m in S.list_products(s, _catalog(s, d))]
    return s.createDataFrame(rows, "product string, cell_order int, shard_order int, spec string")


def _opened(s: SparkSession, d: str) -> DataFrame:
    out = None
    for (name, order), df in S.open_store(s, _catalog(s, d), aoi=[(2, 17), (4, 700)]).items():
        part = df.select(F.lit(name).alias("product"), F.lit(order).alias("source"), "ord", "k", "count")
        out = part if out is None else out.unionByName(part)
    return out


def _store_scan(s: SparkSession, d: str) -> DataFrame:
    """Writes a store of the events' cells and opens it through a region: pruned partitions, exact rows."""
    base = s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sphereframe-store-")
    root = f"{base.rstrip('/')}/sphereframe-store/{uuid.uuid4().hex}"
    cells = events(s, d).groupBy("ord", "k").agg(F.count(F.lit(1)).alias("count"), F.sum("cents").alias("cents"))
    store = S.write_store(cells, root, 8, 1)
    return store.open([(2, 17), (4, 700), (10, 2_000_000)])


_SCAN = f"WITH e AS (SELECT ord, k, count(*) AS count, CAST(sum(cents) AS BIGINT) AS cents FROM ({EV}) GROUP BY ord, k) SELECT * FROM e WHERE k >> 12 = 17 OR k >> 8 = 700 OR k = 2000000 >> 4"

_words = lambda s, d: events(s, d).select("event_id", C.word("k", "ord").alias("w"))
_instants = lambda s, d: events(s, d).select("event_id", T.instant_ns(F.col("ts")).alias("t"))
_T0 = f"(epoch_us(ts) * 1000 + {T.OFFSET_NS})"

QUERIES = {
    "grid_quickstart": flagship,
    "grid_labels": lambda s, d: events(s, d).select("event_id", C.label("k", "ord").alias("label")).select("event_id", "label", C.label_order("label").alias("ord"), C.label_k("label").alias("k"), C.label_base("label").alias("base"), C.label_rank("label").alias("rank"), C.is_base("label").alias("is_base")),
    "grid_words": lambda s, d: _words(s, d).select("event_id", "w", C.word_order("w").alias("ord"), C.word_k("w").alias("k"), C.word_is_point("w").alias("is_point")),
    "grid_points": lambda s, d: events(s, d).select("event_id", C.word(C.first_child("k", "ord", F.lit(29)), F.lit(29), True).alias("w")).select("event_id", C.word_is_point("w").alias("is_point"), C.word_k(C.point_to_area("w")).alias("k29"), (C.area_to_point(C.point_to_area("w")) == F.col("w")).alias("same")),
    "grid_nested": lambda s, d: C.fabricate(events(s, d).select("event_id", "ord", "k"), 8).select("event_id", "cell_ids"),
    "grid_parents": lambda s, d: C.with_parents(events(s, d).select("event_id", "ord", "k"), [6, 3, 0]).select("event_id", "parent_o6", "parent_o3", "parent_o0"),
    "grid_zoom": lambda s, d: _dense(s, d).select("k", F.explode(C.zoom("k", "ord", 6)).alias("child")),
    "grid_rowcol": lambda s, d: events(s, d).select("event_id", C.rank_in("k", "ord", F.lit(0)).alias("rank")).select("event_id", C.rank_row("rank").alias("row"), C.rank_col("rank").alias("col"), C.rowcol_rank(C.rank_row("rank"), C.rank_col("rank")).alias("rank")),
    "grid_lanes": lanes,
    "grid_region_filter": lambda s, d: _in_region(s, d).select("event_id", "k"),
    "grid_range_shards": lambda s, d: V.range_shards(_ranges(s, d)).select("k"),
    "grid_range_cover": lambda s, d: V.range_cover(_ranges(s, d)).select("ord", "k"),
    "grid_range_contains": lambda s, d: V.ranges_contain(_shards(s, d), _ranges(s, d), 3),
    "grid_candidates": lambda s, d: V.candidates(_ranges(s, d), 3, region(s, d), _times(s, d), _WHEN),
    "grid_temporal_keep": lambda s, d: V.temporal_keep(_shards(s, d), _times(s, d), _WHEN),
    "grid_temporal_cover": lambda s, d: V.temporal_cover(_spans(s, d)),
    "grid_toc_words": lambda s, d: _instants(s, d).select("event_id", T.instant_word(F.col("t")).alias("w"), T.range_word(F.col("t"), F.col("t") + 5 * 10**9).alias("r")).select("event_id", T.start_ns(F.col("w")).alias("start_ns"), T.end_ns(F.col("w")).alias("end_ns"), T.is_instant(F.col("r")).alias("is_instant"), T.start_ns(F.col("r")).alias("range_start"), T.end_ns(F.col("r")).alias("range_end")),
    "grid_box_filter": lambda s, d: V.box_overlaps(_leaves(s, d, events(s, d), 3), region(s, d)).select("shard_k"),
    "grid_coalesce": lambda s, d: M.coalesce(_dense(s, d).select(F.col("k").alias("lo"), F.col("k").alias("hi")), 4),
    "grid_compress": lambda s, d: M.compress(M.coalesce(_dense(s, d).select(F.col("k").alias("lo"), F.col("k").alias("hi")), 4), 4),
    "grid_cover_and": lambda s, d: M.intersect(_dense(s, d), _dense_b(s, d)),
    "grid_cover_or": lambda s, d: M.union(_dense(s, d), _dense_b(s, d)),
    "grid_expand": lambda s, d: M.expand(region(s, d), 5).select("k"),
    "grid_clip": lambda s, d: M.clip_cover(region(s, d), 3),
    "grid_domain_runs": lambda s, d: _domain(s, d),
    "grid_domain_shards": lambda s, d: D.from_shards(_errors(s, d), 3, 8),
    "grid_domain_rank": lambda s, d: D.rank(_probe(s, d), _domain(s, d), 4, missing=-1),
    "grid_domain_member": lambda s, d: D.member(_probe(s, d), _domain(s, d), 4),
    "grid_domain_take": lambda s, d: D.take(D.fabricate(_domain(s, d)).select("position"), _domain(s, d)),
    "grid_domain_subset": lambda s, d: D.fabricate(D.subset(_domain(s, d), 100, 900, 4)),
    "grid_domain_and": lambda s, d: D.fabricate(D.intersection(_domain(s, d), D.from_cells(_dense_b(s, d), 4), 4)).select("k"),
    "grid_domain_size": lambda s, d: D.size(_domain(s, d)),
    "grid_domain_within": lambda s, d: D.fabricate(D.within(_domain(s, d), region(s, d), 4)).select("k"),
    "grid_select": lambda s, d: D.select(_dense(s, d).select("k", (F.col("k") * 2).alias("v")), _dense(s, d).join(_dense_b(s, d).select("k"), "k", "left_semi").select("k", (F.col("k") % 100).alias("ordinal"))),
    "grid_align_outer": lambda s, d: D.align(_dense(s, d).withColumn("a", F.lit(1)), _dense_b(s, d).withColumn("b", F.lit(1)), "outer"),
    "grid_reindex": lambda s, d: D.reindex(_domain(s, d), _dense_b(s, d).select("k"), 4),
    "grid_rollup": lambda s, d: J.rollup(lines(s, d), 5, [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_linenumber").alias("least"), F.max("l_partkey").alias("most")]),
    "grid_rollup_many": lambda s, d: J.rollup_many(lines(s, d), [6, 3, 1], [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")]),
    "grid_join_coarse": lambda s, d: J.join_coarse(lines(s, d).select("l_orderkey", "l_linenumber", "ord", "k"), J.rollup(orders(s, d), 5, [F.count(F.lit(1)).alias("n_orders")]), how="left"),
    "grid_coarsen": lambda s, d: J.coarsen(lines(s, d).select("ord", "k").distinct(), 6),
    "grid_shared_regions": lambda s, d: J.shared_regions(_errors(s, d), orders(s, d).where("o_totalprice > 490000").select(C.parent("k", "ord", F.lit(2)).alias("k")).distinct(), 3, 2),
    "grid_occupancy_cells": lambda s, d: J.occupancy_cells(_parts(s, d, events(s, d)), _parts(s, d, lines(s, d)), 3, 7),
    "grid_occupancy_and": lambda s, d: J.occupancy_and(_parts(s, d, events(s, d)), _parts(s, d, lines(s, d))),
    "grid_leaf_kinds": lambda s, d: J.classify(_leaves(s, d, events(s, d), 3)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "grid_pyramid": lambda s, d: _levels(Y.pyramid(events(s, d).select("ord", "k", "cents", "event_id", "user_id"), {"cents": "sum", "event_id": "min", "user_id": "max"}, [6, 4, 2])),
    "grid_overview_nodes": lambda s, d: Y.overview_nodes(_shards(s, d), 3, 1),
    "grid_stats_fold": lambda s, d: Y.fold_stats(_stats(s, d).withColumn("node", F.col("shard_k").bitwiseAND(F.lit(-256))), ["node"]),
    "grid_combined_hash": lambda s, d: events(s, d).groupBy(C.parent("k", "ord", F.lit(2)).alias("node")).agg(Y.combined_hash(F.sha2(F.col("event_id").cast("string"), 256)).alias("combined")),
    "grid_verify": lambda s, d: _verify(s, d),
    "grid_array_hash": lambda s, d: Y.hash_arrays(events(s, d).withColumn("shard_k", C.parent("k", "ord", F.lit(1))).select("shard_k", "event_id", "cents", F.col("event_id").alias("i")), ["cents", "event_id"], ["shard_k"], "i"),
    "grid_ragged_rows": lambda s, d: N.rows_of(_read(s, d, "embeddings").select(F.lit(8).alias("ord"), (F.col("vec_id") + 65536).alias("k"), "embedding"), "embedding").select("k", "pos", F.col("value").cast("double").alias("value")),
    "grid_ragged_subtree": lambda s, d: N.rows_of(N.read(_digests(s, d), "digest", subtree=(1, 7)), "digest").select("k", F.col("value.mean").alias("mean"), F.col("value.weight").alias("weight")),
    "grid_z_windows": lambda s, d: N.z_windows(_digests(s, d), "digest", 2, 1.0, 8, "degrade_resolution"),
    "grid_tensors": lambda s, d: N.tensors(_digests(s, d), "digest", J.coarsen(lines(s, d), 4), 4, 2, 1.0, 64).select("block_k", "row", "col", "mask"),
    "grid_tensor_counts": lambda s, d: N.tensors(_digests(s, d), "digest", _dense(s, d), 4, 2, 1.0, 64).where("counts is not null").select("block_k", "row", "col", F.posexplode("counts").alias("bin", "w")).where("w > 0.0000005").select("block_k", "row", "col", F.col("bin").cast("long").alias("bin"), F.round("w", 6).alias("weight")),
    "grid_centers": lambda s, d: G.with_centers(_dense(s, d), 4).select("k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")),
    "grid_bin_points": lambda s, d: G.with_cells(G.with_centers(_dense(s, d), 4).withColumnRenamed("k", "own").drop("ord"), 4).select("own", "k"),
    "grid_boundaries": lambda s, d: G.with_boundaries(_dense(s, d), 4).select("k", F.size("boundary").alias("n"), F.col("wkt").startswith("POLYGON ((").alias("polygon")),
    "grid_point_lookup": lambda s, d: G.select_points(_dense(s, d).withColumn("v", F.col("k") * 2), G.with_centers(_dense(s, d), 4).select("lon", "lat"), 4).select("k", "v"),
    "grid_store_scan": _store_scan,
    "grid_domain_concat": lambda s, d: D.concat([D.from_cells(_dense(s, d).where(c), 4) for c in ("k < 700", "k >= 700 AND k < 701", "k >= 701")], 4),
    "grid_domain_or": lambda s, d: D.fabricate(D.union(_domain(s, d), D.from_cells(_dense_b(s, d), 4), 4)),
    "grid_domain_cover": lambda s, d: D.fabricate(D.from_cover(region(s, d).where("ord <= 4"), 4)),
    "grid_domain_ranges": lambda s, d: D.from_ranges(_ranges(s, d), 3, 8),
    "grid_domain_step": lambda s, d: D.fabricate(D.subset(_domain(s, d), 10, 900, 4, step=3)),
    "grid_domain_at": lambda s, d: D.fabricate(D.subset_at(_domain(s, d), _read(s, d, "customer").select((F.col("c_custkey") * 7 % 150 - 50).alias("position")), 4)),
    "grid_ranges_and": lambda s, d: V.ranges_and(_ranges(s, d), region(s, d)),
    "grid_bitmaps": lambda s, d: V.decode_bitmaps(_payloads(s, d), 3, 6),
    "grid_occupied_in": lambda s, d: V.occupied_in(_leaves(s, d, events(s, d), 3), events(s, d).select("ord", "k", C.parent("k", "ord", F.lit(3)).alias("shard_k")).distinct(), region(s, d), 3).select("ord", "k"),
    "grid_stale": lambda s, d: V.stale(_leaves(s, d, events(s, d), 3), _ranges(s, d), 3),
    "grid_degraded_parts": lambda s, d: _parts(s, d, events(s, d), "conservative"),
    "grid_companions": lambda s, d: V.companion_spans(events(s, d).groupBy("k").agg(F.collect_list(T.instant_word(T.instant_ns(F.col("ts")))).alias("words")), "words", ["k"]),
    "grid_digest_merge": lambda s, d: N.rows_of(N.merge_digests(_digests(s, d), "digest", 2, 8), "digest").select("k", "pos", F.round("value.mean", 6).alias("mean"), F.col("value.weight").alias("weight")),
    "grid_decode": lambda s, d: N.decode(_read(s, d, "customer").select("c_custkey", F.encode("c_name", "utf-8").alias("raw")), "raw", N.parse_element({"dtype": "<u1", "shape": [-1]}), "v").select("c_custkey", F.posexplode("v").alias("pos", "x")).select("c_custkey", "pos", F.get("x", F.lit(0)).alias("value")),
    "grid_read_cell": lambda s, d: N.read_cell(_digests(s, d), "digest", 4, 300).select("k", F.explode("digest").alias("c")).select("k", "c.mean", "c.weight"),
    "grid_exact_flag": lambda s, d: N.has_exact_occupancy(_leaves(s, d, events(s, d), 3)).select("shard_k", "exact"),
    "grid_overview_orders": lambda s, d: s.createDataFrame(sorted(Y.overview_orders({"overview": {"orders": [2, 5, 4]}}, 8, 6).items()), "anc_order int, cell_order int"),
    "grid_products": _products,
    "grid_catalog_scan": _opened,
    "grid_leaf_scan": lambda s, d: S.Store(s, f"{_catalog(s, d)}/events").leaf((3, 70)).select("ord", "k", "count"),
    "grid_overview_scan": lambda s, d: S.Store(s, f"{_catalog(s, d)}/orders").overview(2).select("ord", "k", "count"),
    "grid_leaf_stats": lambda s, d: E.read_stats(S.Store(s, f"{_catalog(s, d)}/events"), (3, 70)).select("shard_k", "n_granules", "n_obs", "cells_with_data"),
    "grid_overview_stats": lambda s, d: E.read_overview_stats(S.Store(s, f"{_catalog(s, d)}/events"), 2).select("k", "n_obs"),
    "grid_stats_rollup": lambda s, d: E.read_stats_rollup(S.Store(s, f"{_catalog(s, d)}/events")).select("n_shards", "n_obs", "cells_with_data", "duration_s"),
    "grid_source_orders": lambda s, d: s.createDataFrame([(o, E.finest_source_at(S.Store(s, f"{_catalog(s, d)}/events"), o)) for o in range(6, 10)], "ord int, source int"),
    "grid_leaf_paths": lambda s, d: _shards(s, d).select("k", S.leaf_paths(C.label("k", F.lit(3)), 2).alias("path")),
}


def _levels(frames: dict[int, DataFrame]) -> DataFrame:
    out = None
    for df in frames.values():
        out = df if out is None else out.unionByName(df)
    return out


def _verify(s: SparkSession, d: str) -> DataFrame:
    own = events(s, d).groupBy(C.parent("k", "ord", F.lit(2)).alias("shard_k")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("sha256")).withColumn("array", F.lit("count"))
    recorded = own.where("shard_k % 5 != 0").withColumn("sha256", F.when(F.col("shard_k") % 7 == 0, "other").otherwise(F.col("sha256")))
    return Y.verify(own, recorded, ["shard_k"]).select("shard_k", "match", F.size("mismatched").alias("n_wrong"))


#: The bytes of a 64-bit number in hexadecimal, lowest first.
_LE = " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2))
_AOI10 = f"SELECT DISTINCT CAST(k * pow(4, 10 - ord) AS BIGINT) + unnest(range(CAST(pow(4, 10 - ord) AS BIGINT))) AS k FROM ({AOI})"
_BITS = lambda at: " | ".join(f"((r >> {2 * i + at} & 1) << {i})" for i in range(8))

ORACLES = {
    "grid_quickstart": f"{_MASK}, f AS (SELECT k >> 4 AS k, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e WHERE {_HIT} GROUP BY k >> 4), c AS (SELECT k >> 12 AS k, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY k >> 12) SELECT 6 AS ord, f.k, {_label_sql('f.k', 6)} AS label, f.n, f.cents, c.n AS n_coarse, c.cents AS cents_coarse, f.cents * c.n - c.cents * f.n AS anomaly FROM f JOIN c ON c.k = f.k >> 8",
    "grid_labels": f"SELECT event_id, {_label_sql('k', 8)} AS label, 8 AS ord, k, (CASE WHEN (k >> 16) > 6 THEN '-' ELSE '' END) || CAST(((k >> 16) - 1) % 6 + 1 AS VARCHAR) AS base, k % 65536 AS rank, false AS is_base FROM ({EV})",
    "grid_words": f"SELECT event_id, CAST(CASE WHEN (k >> 16) >= 8 THEN CAST(k AS HUGEINT) * 17592186044416 + 8 - 18446744073709551616 ELSE CAST(k AS HUGEINT) * 17592186044416 + 8 END AS BIGINT) AS w, 8 AS ord, k, false AS is_point FROM ({EV})",
    "grid_points": f"SELECT event_id, true AS is_point, k * 4398046511104 AS k29, true AS same FROM ({EV})",
    "grid_nested": f"SELECT event_id, k - 65536 AS cell_ids FROM ({EV})",
    "grid_parents": f"SELECT event_id, k >> 4 AS parent_o6, k >> 10 AS parent_o3, k >> 16 AS parent_o0 FROM ({EV})",
    "grid_zoom": f"SELECT k, k * 16 + unnest(range(16)) AS child FROM ({_DENSE})",
    "grid_rowcol": f"SELECT event_id, CAST({_BITS(1)} AS BIGINT) AS row, CAST({_BITS(0)} AS BIGINT) AS col, r AS rank FROM (SELECT event_id, k % 65536 AS r FROM ({EV}))",
    "grid_lanes": _LANES_SQL,
    "grid_region_filter": f"{_MASK} SELECT event_id, k FROM e WHERE {_HIT}",
    "grid_range_shards": f"SELECT DISTINCT unnest(range(lo, hi + 1)) AS k FROM ({_RANGES})",
    "grid_range_cover": _canonical_sql(f"SELECT DISTINCT unnest(range(lo, hi + 1)) AS k FROM ({_RANGES})", 3),
    "grid_range_contains": f"SELECT k, EXISTS (SELECT 1 FROM ({_RANGES}) r WHERE s.k BETWEEN r.lo AND r.hi) AS in_cover FROM ({_SHARDS}) s",
    "grid_candidates": f"WITH r AS (SELECT DISTINCT unnest(range(lo, hi + 1)) AS k FROM ({_RANGES})), m AS (SELECT CAST(k * pow(4, 10 - ord) AS BIGINT) AS lo, CAST((k + 1) * pow(4, 10 - ord) AS BIGINT) - 1 AS hi FROM ({AOI})), t AS ({_TIMES}) SELECT k FROM r WHERE EXISTS (SELECT 1 FROM m WHERE r.k * 16384 <= m.hi AND m.lo <= r.k * 16384 + 16383) AND NOT EXISTS (SELECT 1 FROM t WHERE t.shard_k = r.k AND NOT (t.start_ns < {_WHEN[1]} AND t.end_ns > {_WHEN[0]}))",
    "grid_temporal_keep": f"WITH t AS ({_TIMES}) SELECT k FROM ({_SHARDS}) s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.shard_k = s.k AND NOT (t.start_ns < {_WHEN[1]} AND t.end_ns > {_WHEN[0]}))",
    "grid_temporal_cover": f"WITH t AS ({_SPANS}), o AS (SELECT *, max(end_ns) OVER (ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t), g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ns > p THEN 1 ELSE 0 END) OVER (ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM g GROUP BY g",
    "grid_toc_words": f"SELECT event_id, {_T0} AS start_ns, {_T0} + 1 AS end_ns, false AS is_instant, ({_T0} >> 31) * 2147483648 AS range_start, ((({_T0} + 5000000000) >> 32) + 1) * 4294967296 AS range_end FROM events",
    "grid_box_filter": f"WITH s AS ({_SHARDS}), m AS (SELECT CAST(k * pow(4, 10 - ord) AS BIGINT) AS lo, CAST((k + 1) * pow(4, 10 - ord) AS BIGINT) - 1 AS hi FROM ({AOI})) SELECT k AS shard_k FROM s WHERE EXISTS (SELECT 1 FROM m WHERE s.k * 16384 <= m.hi AND m.lo <= s.k * 16384 + 4095)",
    "grid_coalesce": _runs_sql(_DENSE),
    "grid_compress": _canonical_sql(_DENSE),
    "grid_cover_and": _canonical_sql(f"{_DENSE} INTERSECT {_DENSE_B}"),
    "grid_cover_or": _canonical_sql(f"{_DENSE} UNION {_DENSE_B}"),
    "grid_expand": f"SELECT DISTINCT k FROM (SELECT CAST(k * pow(4, 5 - ord) AS BIGINT) + unnest(range(CAST(pow(4, 5 - ord) AS BIGINT))) AS k FROM ({AOI}) WHERE ord <= 5 UNION ALL SELECT k >> 10 AS k FROM ({AOI}) WHERE ord = 10)",
    "grid_clip": f"SELECT DISTINCT least(ord, 3) AS ord, CASE ord WHEN 4 THEN k >> 2 WHEN 10 THEN k >> 14 ELSE k END AS k FROM ({AOI})",
    "grid_domain_runs": f"SELECT min(k) AS lo, max(k) AS hi, min(position) AS offset FROM ({_POS}) GROUP BY k - position",
    "grid_domain_shards": f"WITH r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM ({_ERRORS})) SELECT min(k) * 1024 AS lo, max(k) * 1024 + 1023 AS hi, min(i) * 1024 AS offset FROM r GROUP BY k - i",
    "grid_domain_rank": f"SELECT c_custkey, p.k, coalesce(position, -1) AS position FROM ({_PROBE}) p LEFT JOIN ({_POS}) d ON d.k = p.k",
    "grid_domain_member": f"SELECT c_custkey, k, k IN (SELECT k FROM ({_DENSE})) AS member FROM ({_PROBE})",
    "grid_domain_take": f"SELECT position, k FROM ({_POS})",
    "grid_domain_subset": f"SELECT k, position - 100 AS position FROM ({_POS}) WHERE position >= 100 AND position < 900",
    "grid_domain_and": f"{_DENSE} INTERSECT {_DENSE_B}",
    "grid_domain_size": f"SELECT count(*) AS size FROM ({_DENSE})",
    "grid_domain_within": f"WITH s AS ({_DENSE}), m AS (SELECT CAST(k * pow(4, 10 - ord) AS BIGINT) AS lo, CAST((k + 1) * pow(4, 10 - ord) AS BIGINT) - 1 AS hi FROM ({AOI})) SELECT k FROM s WHERE EXISTS (SELECT 1 FROM m WHERE s.k * 4096 <= m.hi AND m.lo <= s.k * 4096 + 4095)",
    "grid_select": f"SELECT k % 100 AS ordinal, k, k * 2 AS v FROM ({_DENSE}) WHERE k IN ({_DENSE_B})",
    "grid_align_outer": f"SELECT 4 AS ord, coalesce(x.k, y.k) AS k, CASE WHEN x.k IS NOT NULL THEN 1 END AS a, CASE WHEN y.k IS NOT NULL THEN 1 END AS b FROM ({_DENSE}) x FULL JOIN ({_DENSE_B}) y ON x.k = y.k",
    "grid_reindex": f"SELECT b.k, coalesce(position, -1) AS position FROM ({_DENSE_B}) b LEFT JOIN ({_POS}) d ON d.k = b.k",
    "grid_rollup": f"SELECT 5 AS ord, k >> 8 AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_linenumber) AS least, max(l_partkey) AS most FROM ({LI}) GROUP BY k >> 8",
    "grid_rollup_many": " UNION ALL ".join(f"SELECT {o} AS ord, k >> {2 * (9 - o)} AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM ({LI}) GROUP BY k >> {2 * (9 - o)}" for o in (6, 3, 1)),
    "grid_join_coarse": f"SELECT l_orderkey, l_linenumber, l.ord, l.k, CAST(c.n AS DOUBLE) AS n_orders FROM ({LI}) l LEFT JOIN (SELECT k >> 6 AS k, count(*) AS n FROM ({OR}) GROUP BY k >> 6) c ON c.k = l.k >> 8",
    "grid_coarsen": f"SELECT DISTINCT 6 AS ord, k >> 6 AS k FROM ({LI})",
    "grid_shared_regions": f"SELECT k FROM ({_ERRORS}) WHERE k >> 2 IN (SELECT k >> 12 FROM ({OR}) WHERE o_totalprice > 490000)",
    "grid_occupancy_cells": f"SELECT k >> 8 AS region, k FROM ({_AND})",
    "grid_occupancy_and": _canonical_sql(_AND, 7),
    "grid_leaf_kinds": f"SELECT CASE WHEN k % 11 = 5 THEN 'empty' WHEN k % 3 = 0 THEN 'full' WHEN k % 3 = 1 THEN 'cells' ELSE 'box' END AS kind, count(*) AS n FROM ({_SHARDS}) GROUP BY 1",
    "grid_pyramid": " UNION ALL ".join(f"SELECT {o} AS ord, k >> {2 * (8 - o)} AS k, CAST(sum(cents) AS BIGINT) AS cents, min(event_id) AS event_id, max(user_id) AS user_id FROM ({EV}) GROUP BY k >> {2 * (8 - o)}" for o in (6, 4, 2)),
    "grid_overview_nodes": f"SELECT DISTINCT k >> 4 AS k FROM ({_SHARDS})",
    "grid_stats_fold": f"SELECT shard_k & -256 AS node, count(*) AS n_shards, CAST(sum(n_granules) AS BIGINT) AS n_granules, CAST(sum(n_obs) AS BIGINT) AS n_obs, CAST(sum(cells_with_data) AS BIGINT) AS cells_with_data, CAST(sum(duration_s) AS DOUBLE) AS duration_s, CAST(max(max_memory_mb) AS DOUBLE) AS max_memory_mb, max(timestamp) AS timestamp, bool_and(success) AS success, CASE WHEN count(DISTINCT semantic_hash) = 1 THEN max(semantic_hash) END AS semantic_hash FROM ({_STATS}) GROUP BY 1",
    "grid_combined_hash": f"SELECT k >> 12 AS node, sha256(string_agg(h, chr(10) ORDER BY h)) AS combined FROM (SELECT k, sha256(CAST(event_id AS VARCHAR)) AS h FROM ({EV})) GROUP BY 1",
    "grid_verify": f"SELECT shard_k, CASE WHEN shard_k % 5 != 0 THEN shard_k % 7 != 0 END AS match, CAST(CASE WHEN shard_k % 5 != 0 AND shard_k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS n_wrong FROM (SELECT DISTINCT k >> 12 AS shard_k FROM ({EV}))",
    "grid_ragged_rows": "SELECT vec_id + 65536 AS k, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "grid_ragged_subtree": f"SELECT k, CAST(mean AS DOUBLE) AS mean, CAST(weight AS DOUBLE) AS weight FROM ({_CENTROIDS}) WHERE k >> 6 = 7",
    "grid_z_windows": f"{_TAILS} SELECT block_k, z_lo, 8 AS n_bins, CAST(CASE WHEN need <= 8 THEN 1 WHEN need <= 16 THEN 2 WHEN need <= 32 THEN 4 ELSE 8 END AS DOUBLE) AS resolution FROM (SELECT k >> 4 AS block_k, floor(min(lo)) AS z_lo, ceil(max(hi)) - floor(min(lo)) AS need FROM tails GROUP BY 1)",
    "grid_tensors": f"WITH g AS (SELECT DISTINCT k FROM ({_CENTROIDS})), b AS (SELECT DISTINCT k >> 4 AS block_k FROM g), c AS (SELECT block_k, unnest(range(16)) AS r FROM b) SELECT block_k, (r // 2 % 2) + 2 * (r // 8 % 2) AS row, (r % 2) + 2 * (r // 4 % 2) AS col, CAST(CASE WHEN block_k * 16 + r IN (SELECT k FROM g) THEN 2 WHEN block_k * 16 + r IN (SELECT k >> 10 FROM ({LI})) THEN 1 ELSE 0 END AS SMALLINT) AS mask FROM c",
    "grid_tensor_counts": f"""{_TAILS}, z AS (SELECT k >> 4 AS block_k, floor(min(lo)) AS z FROM tails GROUP BY 1),
g AS (SELECT block_k, k, t, z, unnest(range(65)) AS i FROM z JOIN (SELECT DISTINCT k, t FROM c) ON block_k = k >> 4),
e AS (SELECT g.block_k, g.k, i, coalesce(max(CASE WHEN mean IS NULL THEN 0 WHEN mean2 IS NULL THEN g.t ELSE mid + (z + i - mean) / (mean2 - mean) * (mid2 - mid) END), 0) AS f FROM g LEFT JOIN n ON n.k = g.k AND mean <= z + i AND (mean2 IS NULL OR z + i < mean2) GROUP BY ALL),
h AS (SELECT block_k, k, i, greatest(lead(f) OVER (PARTITION BY k ORDER BY i) - f, 0) AS w FROM e)
SELECT block_k, ((k % 16) // 2 % 2) + 2 * ((k % 16) // 8 % 2) AS row, (k % 2) + 2 * ((k % 16) // 4 % 2) AS col, i AS bin, round(w, 6) AS weight FROM h WHERE i < 64 AND w > 0.0000005""",
    "grid_bin_points": f"SELECT k AS own, k FROM ({_DENSE})",
    "grid_boundaries": f"SELECT k, 4 AS n, true AS polygon FROM ({_DENSE})",
    "grid_point_lookup": f"SELECT k, k * 2 AS v FROM ({_DENSE})",
    "grid_store_scan": _SCAN,
    "grid_array_hash": f"SELECT shard_k, \"array\", sha256(unhex(string_agg({_LE}, '' ORDER BY i))) AS sha256 FROM (SELECT k >> 14 AS shard_k, event_id AS i, 'cents' AS \"array\", format('{{:016x}}', cents) AS h FROM ({EV}) UNION ALL SELECT k >> 14, event_id, 'event_id', format('{{:016x}}', event_id) FROM ({EV})) GROUP BY shard_k, \"array\"",
    "grid_domain_concat": f"SELECT min(k) AS lo, max(k) AS hi, min(position) AS offset FROM ({_POS}) GROUP BY k - position",
    "grid_domain_or": f"SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM ({_DENSE} UNION {_DENSE_B})",
    "grid_domain_cover": f"SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM (SELECT DISTINCT CAST(k * pow(4, 4 - ord) AS BIGINT) + unnest(range(CAST(pow(4, 4 - ord) AS BIGINT))) AS k FROM ({AOI}) WHERE ord <= 4)",
    "grid_domain_ranges": f"WITH r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT unnest(range(lo, hi + 1)) AS k FROM ({_RANGES}))) SELECT min(k) * 1024 AS lo, max(k) * 1024 + 1023 AS hi, min(i) * 1024 AS offset FROM r GROUP BY k - i",
    "grid_domain_step": f"SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM ({_POS}) WHERE position >= 10 AND position < 900 AND (position - 10) % 3 = 0",
    "grid_domain_at": f"WITH p AS ({_POS}), n AS (SELECT count(*) AS n FROM p) SELECT k, row_number() OVER (ORDER BY k) - 1 AS position FROM p, n WHERE position IN (SELECT (q + n) % n FROM (SELECT c_custkey * 7 % 150 - 50 AS q FROM customer))",
    "grid_ranges_and": _canonical_sql(f"SELECT k FROM ({_AOI10}) WHERE k >> 14 IN (SELECT unnest(range(lo, hi + 1)) FROM ({_RANGES}))", 10),
    "grid_bitmaps": f"SELECT DISTINCT k >> 10 AS shard_k, 6 AS ord, k >> 4 AS k FROM ({EV})",
    "grid_occupied_in": f"SELECT ord, k FROM ({_canonical_sql(f'SELECT k FROM ({_AOI10}) WHERE k >> 14 IN (SELECT k FROM ({_SHARDS}) WHERE k % 11 != 5 AND k % 3 = 0)', 10)}) UNION ALL SELECT DISTINCT 8 AS ord, k FROM ({EV}) WHERE (k >> 10) % 11 != 5 AND (k >> 10) % 3 = 1 AND k IN (SELECT k >> 4 FROM ({_AOI10}))",
    "grid_stale": f"SELECT k FROM ({_SHARDS}) WHERE k % 11 != 5 AND k NOT IN (SELECT unnest(range(lo, hi + 1)) FROM ({_RANGES}))",
    "grid_degraded_parts": f"SELECT DISTINCT 7 AS ord, k >> 2 AS k, true AS exact FROM ({EV}) WHERE (k >> 10) % 11 != 5 AND (k >> 10) % 3 = 1 UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END, CASE WHEN k % 3 = 0 THEN k ELSE k * 4 END, false FROM ({_SHARDS}) WHERE k % 11 != 5 AND k % 3 != 1",
    "grid_companions": f"SELECT k, a AS start_ns, b + 1 AS end_ns, ((a >> 31) - CASE WHEN (a >> 31) >= 2147483648 THEN 4294967296 ELSE 0 END) * 4294967296 + CASE WHEN a = b THEN 2147483648 + (a & 2147483647) ELSE ((b >> 32) + 1) & 2147483647 END AS word FROM (SELECT k, min({_T0}) AS a, max({_T0}) AS b FROM ({EV}) GROUP BY k)",
    "grid_digest_merge": f"WITH m AS (SELECT k >> 4 AS k, mean, sum(weight) AS w FROM ({_CENTROIDS}) GROUP BY 1, 2), c AS (SELECT *, least(floor((sum(w) OVER (PARTITION BY k ORDER BY mean) - w / 2.0) * 8 / sum(w) OVER (PARTITION BY k)), 7) AS c FROM m), g AS (SELECT k, c, sum(mean * w) / CAST(sum(w) AS DOUBLE) AS mean, sum(w) AS weight FROM c GROUP BY k, c) SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY mean, weight) - 1 AS INT) AS pos, round(mean, 6) AS mean, CAST(weight AS DOUBLE) AS weight FROM g",
    "grid_decode": "SELECT c_custkey, CAST(generate_subscripts(string_split(c_name, ''), 1) - 1 AS INT) AS pos, CAST(ascii(unnest(string_split(c_name, ''))) AS SMALLINT) AS value FROM customer",
    "grid_read_cell": f"SELECT k, CAST(mean AS DOUBLE) AS mean, CAST(weight AS DOUBLE) AS weight FROM ({_CENTROIDS}) WHERE k = 300",
    "grid_exact_flag": f"SELECT k AS shard_k, k % 11 != 5 AND k % 3 != 2 AS exact FROM ({_SHARDS})",
    "grid_overview_orders": "SELECT * FROM (VALUES (2, 4), (4, 6), (5, 7)) AS v(anc_order, cell_order)",
    "grid_products": "SELECT * FROM (VALUES ('events', 8, 3, 'cell-store/1'), ('orders', 8, 3, 'cell-store/1')) AS v(product, cell_order, shard_order, spec)",
    "grid_catalog_scan": " UNION ALL ".join(f"SELECT '{n}' AS product, 8 AS source, 8 AS ord, k, count(*) AS count FROM ({t}) WHERE k >> 12 = 17 OR k >> 8 = 700 GROUP BY k UNION ALL SELECT '{n}', 7, 7, k >> 2, count(*) FROM ({t}) GROUP BY k >> 2" for n, t in (("events", EV), ("orders", OR))),
    "grid_leaf_scan": f"SELECT 8 AS ord, k, count(*) AS count FROM ({EV}) WHERE k >> 10 = 70 GROUP BY k",
    "grid_overview_scan": f"SELECT 7 AS ord, k >> 2 AS k, count(*) AS count FROM ({OR}) GROUP BY 2",
    "grid_leaf_stats": f"SELECT 70 AS shard_k, count(DISTINCT user_id) AS n_granules, count(*) AS n_obs, count(DISTINCT k) AS cells_with_data FROM ({EV}) WHERE k >> 10 = 70 HAVING count(*) > 0",
    "grid_overview_stats": f"SELECT k >> 12 AS k, CASE WHEN count(*) > 40 THEN count(*) END AS n_obs FROM ({EV}) GROUP BY 1",
    "grid_stats_rollup": f"SELECT count(DISTINCT k >> 10) AS n_shards, count(*) AS n_obs, count(DISTINCT k) AS cells_with_data, count(*) / 4.0 AS duration_s FROM ({EV})",
    "grid_source_orders": "SELECT * FROM (VALUES (6, NULL), (7, 7), (8, 8), (9, 8)) AS v(ord, source)",
    "grid_leaf_paths": f"SELECT k, (CASE WHEN (k >> 6) > 6 THEN '-' ELSE '' END) || b || '/' || x || y || '/' || z || '/' || (CASE WHEN (k >> 6) > 6 THEN '-' ELSE '' END) || b || x || y || z || '.zarr' AS path FROM (SELECT k, CAST(((k >> 6) - 1) % 6 + 1 AS VARCHAR) AS b, CAST((k >> 4 & 3) + 1 AS VARCHAR) AS x, CAST((k >> 2 & 3) + 1 AS VARCHAR) AS y, CAST((k & 3) + 1 AS VARCHAR) AS z FROM ({_SHARDS}))",
}
