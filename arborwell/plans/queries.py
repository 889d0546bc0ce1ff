"""Queries of the tree engine over the test tables, and the same results in SQL.

At the root, gradients of whole-number labels are exact in binary floating point, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objective
from ..functions.gain import gain, weight
from ..operators import bins, histogram, split
from ..params import GBDTParams
from ..sources import sparse
from . import predict as predicting
from . import train as training
from .lineage import cut

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
Q = 20
P = GBDTParams(num_split=Q, min_node_instance=16)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    y = ((F.col("l_quantity") >= 25) & (F.col("l_discount") >= 0.05)).cast("double")
    return _t(spark, d, "lineitem").select(*FEATURES, y.alias("y"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return sparse.wide_to_cells(_lineitem(spark, d), FEATURES)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return bins.value_counts(_cells(spark, d))


def _info(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_counts(spark, d))
    return cut(bins.feature_info(c, bins.exact_cuts(c, Q)))


def _binned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    info = _info(spark, d)
    by = {r["fid"]: r.asDict() for r in info.collect()}  # a row per feature
    g, h = objective.logistic(F.lit(0.0), F.col("y"))
    return bins.bin_columns(_lineitem(spark, d), FEATURES, by, ["y"]).withColumns({"g0": g, "h0": h, "node": F.lit(0).cast("long")}), info


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows at nodes 1 and 2, parted at l_quantity 25, and the metadata."""
    info = _info(spark, d)
    by = {r["fid"]: r.asDict() for r in info.collect()}
    g, h = objective.logistic(F.lit(0.0), F.col("y"))
    rows = bins.bin_columns(_lineitem(spark, d), FEATURES, by, ["y", "l_quantity"])
    return rows.withColumns({"g0": g, "h0": h, "node": F.when(F.col("l_quantity") < 25, 1).otherwise(2).cast("long")}), info


def _wide(cuts_sql: str = "") -> str:
    ys = "(l_quantity >= 25 AND l_discount >= 0.05)::INT::DOUBLE"
    cells = " UNION ALL ".join(f"SELECT rid, y, {k} AS fid, {c}::DOUBLE AS value FROM w WHERE {c} <> 0" for k, c in enumerate(FEATURES))
    return f"w AS (SELECT row_number() OVER () AS rid, *, {ys} AS y FROM lineitem), cells AS ({cells})"


_RANKS = f"""r AS (SELECT fid, value, row_number() OVER (PARTITION BY fid ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY fid) AS n FROM cells),
k AS (SELECT DISTINCT r.fid, r.value AS c FROM r JOIN range({Q}) AS q(i) ON r.rk = (r.n * q.i) // {Q}),
cuts AS (SELECT fid, list(c ORDER BY c) AS s FROM k GROUP BY fid),
probe AS (SELECT fid, count(DISTINCT value) AS nd, count(*) AS nnz, list(DISTINCT value ORDER BY value) AS vals FROM cells GROUP BY fid),
info AS (SELECT p.fid, nd <= 32 AS is_categorical, CASE WHEN nd <= 32 THEN vals ELSE s END AS splits, p.nnz,
  CASE WHEN nd <= 32 THEN nd + 1 ELSE len(s) END AS num_bin,
  CASE WHEN nd <= 32 THEN nd ELSE greatest(len(list_filter(s, lambda c: c <= 0)) - 1, 0) END AS default_bin FROM probe p JOIN cuts USING (fid))"""
_BINS = f"""{_wide()}, {_RANKS},
every AS (SELECT w.rid, w.y, w.l_quantity, i.fid, i.is_categorical, i.num_bin, i.splits,
  CASE WHEN c.value IS NULL THEN i.default_bin ELSE greatest(len(list_filter(i.splits, lambda s: s <= c.value)) - 1, 0) END AS bin
  FROM w CROSS JOIN info i LEFT JOIN cells c ON c.rid = w.rid AND c.fid = i.fid),
gh AS (SELECT *, 0.5 - y AS g, 0.25 AS h, 0 AS root, CASE WHEN l_quantity < 25 THEN 1 ELSE 2 END AS side FROM every)"""
_HIST = "SELECT {node}::BIGINT AS node, fid, bin::INT AS bin, count(*) AS n, sum(g)::DOUBLE AS g0, sum(h)::DOUBLE AS h0 FROM gh GROUP BY ALL"


def _gain_sql(g: str, h: str, p: GBDTParams) -> str:
    s = f"(sign({g}) * greatest(abs({g}) - {p.reg_alpha}, 0.0))" if p.reg_alpha else g
    if p.max_leaf_weight:
        w = f"greatest(least(-{s} / ({h} + {p.lam}), {p.max_leaf_weight}), -{p.max_leaf_weight})"
        v = f"(-2.0 * ({g} * {w} + 0.5 * ({h} + {p.lam}) * {w} * {w} + {p.reg_alpha} * abs({w})))"
    else:
        v = f"({s} * {s} / ({h} + {p.lam}))"
    return f"(CASE WHEN {g} <> 0 THEN {v} ELSE 0 END)"


def _scan_sql(p: GBDTParams, node: str = "root") -> str:
    change = f"{_gain_sql('gl', 'hl', p)} + {_gain_sql('(g - gl)', '(h - hl)', p)} - {_gain_sql('g', 'h', p)} - {p.lam}"
    return f"""WITH {_BINS}, hist AS ({_HIST.format(node=node)}),
    c AS (SELECT node, fid, bin, sum(g0) OVER u AS gl, sum(h0) OVER u AS hl, sum(n) OVER u AS nl, sum(g0) OVER a AS g, sum(h0) OVER a AS h FROM hist
          WINDOW u AS (PARTITION BY node, fid ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, fid)),
    s AS (SELECT c.node, c.fid, c.bin, nl::BIGINT AS nl, splits[bin + 2] AS fvalue, gl, hl, round({change}, 6) AS gain
          FROM c JOIN info USING (fid) WHERE NOT is_categorical AND bin < num_bin - 1)"""


def _scan(hist: DataFrame, info: DataFrame, p: GBDTParams) -> DataFrame:
    d = split.numeric_candidates(hist, info, p)
    return d.select("node", "fid", "bin", "nl", "fvalue", F.col("l_g0").alias("gl"), F.col("l_h0").alias("hl"), F.round("gain", 6).alias("gain"))


def _best_numeric(p: GBDTParams):
    def run(spark, d):
        rows, info = _binned(spark, d)
        hist = histogram.build_arrow(rows, list(range(len(FEATURES))), 1)
        b = split.best_splits(hist, info.where("NOT is_categorical"), p)
        return b.select("node", "fid", "bin", "nl", "fvalue", F.col("l_g0").alias("gl"), F.col("l_h0").alias("hl"), F.round("gain", 6).alias("gain"))

    return run, _scan_sql(p) + " SELECT * FROM s WHERE gain > 0 ORDER BY gain DESC, fid, bin LIMIT 1"


def _hist(build):
    def run(spark, d):
        rows, _ = _binned(spark, d)
        return build(rows, list(range(len(FEATURES))), 1)

    return run


def hist_two_nodes(spark, d):
    rows, _ = _two(spark, d)
    return histogram.build_arrow(rows, list(range(len(FEATURES))), 1)


def hist_subtract(spark, d):
    """Node 2 from node 0 minus node 1."""
    rows, _ = _two(spark, d)
    fids = list(range(len(FEATURES)))
    parent = histogram.build_arrow(rows.withColumn("node", F.lit(0).cast("long")), fids, 1)
    return histogram.subtract(parent, histogram.build_arrow(rows.where("node = 1"), fids, 1), lambda c: c + 1)


def hist_default_fill(spark, d):
    """From present cells only; absent ones go to the default bin by subtraction from the node's total."""
    info = _info(spark, d)
    li = _lineitem(spark, d)
    g, h = objective.logistic(F.lit(0.0), F.col("y"))
    cells = sparse.wide_to_cells(li, FEATURES, keep=["y"]).join(F.broadcast(info.select("fid", "splits")), "fid")  # a row per feature
    seen = cells.select(F.lit(0).cast("long").alias("node"), "fid", bins.bin_of(F.col("splits"), F.col("value")).cast("int").alias("bin"), g.alias("g0"), h.alias("h0"))
    seen = seen.groupBy("node", "fid", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g0").alias("g0"), F.sum("h0").alias("h0"))
    totals = li.agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("g0"), F.sum(h).alias("h0")).withColumn("node", F.lit(0).cast("long"))
    return histogram.fill_default(seen, totals, info).where("n > 0")


def libsvm_parse(spark, d):
    li = _lineitem(spark, d)
    lines = li.select(sparse.libsvm_line(F.col("y"), FEATURES).alias("value"))
    return sparse.explode_cells(sparse.parse_lines(lines)).groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def label_remap_binary(spark, d):
    y = sparse.remap_labels(_lineitem(spark, d).select((2 * F.col("y") - 1).alias("y")), "y", 2)
    return y.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def label_remap_multi(spark, d):
    k = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return sparse.remap_labels(_t(spark, d, "orders").select(k.alias("y")), "y", 3).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def bin_counts(spark, d):
    info = _info(spark, d)
    c = _counts(spark, d).join(F.broadcast(info.select("fid", "splits")), "fid")  # a row per feature
    return c.groupBy("fid", bins.bin_of(F.col("splits"), F.col("value")).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def feature_info(spark, d):
    return _info(spark, d).select("fid", "is_categorical", F.col("num_bin").cast("long").alias("num_bin"), F.col("default_bin").cast("long").alias("default_bin"), "nnz")


def _root(loss: str):
    def run(spark, d):
        g, h = objective.gradients(loss, F.lit(0.0), F.col("y"), 2)
        return _lineitem(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("g"), F.sum(h).alias("h"))

    return run


_LANGS = ["de", "en", "es", "fr"]


def _multi(loss: str):
    def run(spark, d):
        y = F.array_position(F.array(*[F.lit(x) for x in _LANGS]), F.col("lang")) - 1
        docs = _t(spark, d, "documents").select(y.alias("y"))
        g, h = objective.gradients(loss, F.array(*[F.lit(0.0)] * 4), F.col("y"), 4)
        return docs.select(F.posexplode(F.arrays_zip(g.alias("g"), h.alias("h"))).alias("k", "p")).groupBy("k").agg(F.sum("p.g").alias("g"), F.sum("p.h").alias("h"))

    return run


def root_totals(spark, d):
    rows, _ = _binned(spark, d)
    t = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("g0").alias("g"), F.sum("h0").alias("h"))
    return t.withColumn("can_split", (F.col("n") > 1024) & (F.col("g") != 0) & (F.col("h") >= 0.0))


def lighter_child(spark, d):
    rows, _ = _two(spark, d)
    t = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sibling = F.when(F.col("node") % 2 == 0, F.col("node") - 1).otherwise(F.col("node") + 1)
    other = t.select(F.col("node").alias("sibling"), F.col("n").alias("m"))
    build = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("sibling")))
    return t.withColumn("sibling", sibling).join(other, "sibling").select("node", "sibling", F.floor((F.col("node") - 1) / 2).alias("parent"), "n", build.alias("build"))


def route_level1(spark, d):
    rows, _ = _two(spark, d)
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("g0").alias("g"), F.sum("h0").alias("h"))


def _leaf(p: GBDTParams):
    def run(spark, d):
        return route_level1(spark, d).select("node", F.round(weight(F.col("g"), F.col("h"), p), 9).alias("weight"))

    w = f"-sign(g) * greatest(abs(g) - {p.reg_alpha}, 0) / (h + {p.lam})"
    if p.max_leaf_weight:
        w = f"greatest(least({w}, {p.max_leaf_weight}), -{p.max_leaf_weight})"
    return run, f"WITH {_BINS}, t AS (SELECT side AS node, sum(g) AS g, sum(h) AS h FROM gh WHERE fid = 0 GROUP BY 1) SELECT node::BIGINT AS node, round(CASE WHEN g <> 0 THEN {w} ELSE 0 END, 9) AS weight FROM t"


def split_categorical_best(spark, d):
    """Best split of each categorical feature at the root, as sizes and gain."""
    rows, info = _binned(spark, d)
    c = split.categorical_candidates(histogram.build_arrow(rows, list(range(len(FEATURES))), 1), info, P)
    return c.select("fid", "nl", F.array_join(F.transform("left_bins", lambda b: b.cast("string")), ",").alias("left_bins"), F.round("gain", 6).alias("gain")).where("gain IS NOT NULL")


_CAT = f"""WITH RECURSIVE {_BINS}, hist AS ({_HIST.format(node='root')}),
b AS (SELECT hist.*, i.default_bin, row_number() OVER (PARTITION BY hist.fid ORDER BY bin) AS o, sum(g0) OVER (PARTITION BY hist.fid) AS g, sum(h0) OVER (PARTITION BY hist.fid) AS h
      FROM hist JOIN info i ON i.fid = hist.fid AND i.is_categorical WHERE hist.bin <> i.default_bin),
tot AS (SELECT hist.fid, sum(g0) AS g, sum(h0) AS h, count(*) FILTER (bin <> default_bin) AS m, coalesce(sum(g0) FILTER (bin = default_bin), 0) AS dg, coalesce(sum(h0) FILTER (bin = default_bin), 0) AS dh,
        coalesce(sum(n) FILTER (bin = default_bin), 0) AS dn, any_value(default_bin) AS db FROM hist JOIN info i ON i.fid = hist.fid AND i.is_categorical GROUP BY hist.fid),
f AS (SELECT fid, 0::BIGINT AS o, dg::DOUBLE AS gl, dh::DOUBLE AS hl, dn::BIGINT AS nl, [db::INT] AS l FROM tot UNION ALL
      SELECT f.fid, f.o + 1, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN gl + b.g0 ELSE gl END, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN hl + b.h0 ELSE hl END,
             CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN nl + b.n ELSE nl END, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN list_append(l, b.bin) ELSE l END
      FROM f JOIN b ON b.fid = f.fid AND b.o = f.o + 1 JOIN tot t ON t.fid = f.fid)
SELECT f.fid, nl, array_to_string(list_sort(l), ',') AS left_bins,
  round({_gain_sql('gl', 'hl', P)} + {_gain_sql('(t.g - gl)', '(t.h - hl)', P)} - {_gain_sql('t.g', 't.h', P)} - {P.lam}, 6) AS gain FROM f JOIN tot t ON t.fid = f.fid AND f.o = t.m WHERE len(l) <= t.m"""


def _best_sql(name: str, rows: str, node: str, p: GBDTParams) -> str:
    """CTEs <name>_*: the best split of each node (column node of rows), points and sets; last is {name}."""
    numeric = f"{_gain_sql('gl', 'hl', p)} + {_gain_sql('(g - gl)', '(h - hl)', p)} - {_gain_sql('g', 'h', p)} - {p.lam}"
    sets = f"{_gain_sql('gl', 'hl', p)} + {_gain_sql('(t.g - gl)', '(t.h - hl)', p)} - {_gain_sql('t.g', 't.h', p)} - {p.lam}"
    n = name
    return f"""{n}_hist AS (SELECT {node}::BIGINT AS node, fid, bin::INT AS bin, count(*) AS n, sum(g)::DOUBLE AS g0, sum(h)::DOUBLE AS h0 FROM {rows} GROUP BY ALL),
    {n}_c AS (SELECT node, fid, bin, sum(g0) OVER u AS gl, sum(h0) OVER u AS hl, sum(n) OVER u AS nl, sum(g0) OVER a AS g, sum(h0) OVER a AS h, sum(n) OVER a AS nt FROM {n}_hist
          WINDOW u AS (PARTITION BY node, fid ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, fid)),
    {n}_s AS (SELECT node, {n}_c.fid, bin, NULL::INT[] AS l, nl::BIGINT AS nl, splits[bin + 2] AS fvalue, gl, hl, g, h, nt, {numeric} AS gain FROM {n}_c JOIN info USING (fid) WHERE NOT is_categorical AND bin < num_bin - 1),
    {n}_b AS (SELECT x.*, row_number() OVER (PARTITION BY node, x.fid ORDER BY bin) AS o FROM {n}_hist x JOIN info i ON i.fid = x.fid AND i.is_categorical WHERE x.bin <> i.default_bin),
    {n}_t AS (SELECT node, x.fid, sum(g0) AS g, sum(h0) AS h, sum(n) AS nt, count(*) FILTER (bin <> default_bin) AS m, coalesce(sum(g0) FILTER (bin = default_bin), 0) AS dg, coalesce(sum(h0) FILTER (bin = default_bin), 0) AS dh,
              coalesce(sum(n) FILTER (bin = default_bin), 0) AS dn, any_value(default_bin) AS db FROM {n}_hist x JOIN info i ON i.fid = x.fid AND i.is_categorical GROUP BY node, x.fid),
    {n}_f AS (SELECT node, fid, 0::BIGINT AS o, dg::DOUBLE AS gl, dh::DOUBLE AS hl, dn::BIGINT AS nl, [db::INT] AS l FROM {n}_t UNION ALL
      SELECT f.node, f.fid, f.o + 1, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN gl + b.g0 ELSE gl END, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN hl + b.h0 ELSE hl END,
             CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN nl + b.n ELSE nl END, CASE WHEN b.g0 * (2 * gl + b.g0 - t.g) >= 0 THEN list_append(l, b.bin) ELSE l END
      FROM {n}_f f JOIN {n}_b b ON b.node = f.node AND b.fid = f.fid AND b.o = f.o + 1 JOIN {n}_t t ON t.node = f.node AND t.fid = f.fid),
    {n}_all AS (SELECT node, fid, 0 AS split_type, bin, l, nl, fvalue, gl, hl, g, h, nt, gain FROM {n}_s UNION ALL
      SELECT f.node, f.fid, 1, NULL, l, nl, NULL, gl, hl, t.g, t.h, t.nt, {sets} FROM {n}_f f JOIN {n}_t t ON t.node = f.node AND t.fid = f.fid AND f.o = t.m WHERE len(l) <= t.m),
    {n} AS (SELECT * FROM {n}_all WHERE gain > {max(0.0, p.min_split_gain)} AND nt > {p.min_node_instance} AND g <> 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, split_type, fid, bin) = 1)"""


def _tree_sql(p: GBDTParams, only_best: bool) -> str:
    """Label, class, rows and mean margin under one tree of depth 2; only_best: of the two children, only the one with the larger gain is split."""
    some = "SELECT * FROM lvl1 QUALIFY row_number() OVER (ORDER BY gain DESC, node) = 1" if only_best else "SELECT * FROM lvl1"
    side = "(CASE WHEN x.split_type = 0 THEN bin > x.bin0 ELSE NOT list_contains(x.l, bin) END)::INT"
    return f"""WITH RECURSIVE {_BINS}, {_best_sql('lvl0', 'gh', 'root', p)},
    s0 AS (SELECT rid, 1 + {side} AS node FROM (SELECT gh.rid, gh.bin, b.split_type, b.bin AS bin0, b.l FROM gh JOIN lvl0 b ON gh.fid = b.fid) x),
    rows1 AS (SELECT gh.*, s0.node FROM gh JOIN s0 USING (rid)), {_best_sql('lvl1', 'rows1', 'node', p)}, chosen AS ({some}),
    s1 AS (SELECT rid, 2 * node + 1 + {side} AS leaf FROM (SELECT r.rid, r.node, r.bin, b.split_type, b.bin AS bin0, b.l FROM rows1 r JOIN chosen b ON r.fid = b.fid AND r.node = b.node) x),
    leaves AS (SELECT r.y, r.g, r.h, coalesce(s1.leaf, r.node) AS leaf FROM rows1 r LEFT JOIN s1 USING (rid) WHERE r.fid = 0),
    weights AS (SELECT leaf, {p.learning_rate}::DOUBLE * CASE WHEN sum(g) <> 0 THEN -sum(g) / (sum(h) + {p.lam}) ELSE 0 END AS m FROM leaves GROUP BY leaf)
    SELECT y, (m > 0)::INT AS predicted, count(*) AS n, round(avg(m), 6) AS avg_margin FROM leaves JOIN weights USING (leaf) GROUP BY 1, 2"""


def pred_after_tree1(spark, d):
    p = GBDTParams(num_tree=1, max_depth=1, min_node_instance=16, num_split=Q, learning_rate=0.5)
    m = training.train(_lineitem(spark, d), "y", ["l_quantity"], p)
    return predicting.score_case(_lineitem(spark, d), m).groupBy(F.round("margin", 9).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


_TREE1 = f"""{_scan_sql(P).replace("s AS (SELECT c.node", "s AS (SELECT g, h, c.node")}, best AS (SELECT * FROM s WHERE fid = 0 ORDER BY gain DESC, bin LIMIT 1)
SELECT round(0.5 * CASE WHEN l_quantity < fvalue THEN -gl / (hl + 1) ELSE -(g - gl) / (h - hl + 1) END, 9) AS pred, count(*) AS n FROM w CROSS JOIN best GROUP BY 1"""

def _metric(name: str):
    def run(spark, d):
        m = _lineitem(spark, d).withColumn("m", F.col("l_linenumber").cast("double") - 3)
        return objective.auc(m, "m", "y").select(F.round("auc", 9).alias("value")) if name == "auc" else m.agg(F.round(objective.metric(name, F.col("m"), F.col("y")), 9).alias("value"))

    return run


_M = f"WITH {_wide()}, m AS (SELECT y, l_linenumber::DOUBLE - 3 AS m, 1 / (1 + exp(-(l_linenumber::DOUBLE - 3))) AS p FROM w)"
_METRIC_SQL = {
    "rmse": "sqrt(avg((m - y) * (m - y)))", "error": "avg(CASE WHEN m >= 0 THEN 1 - y ELSE y END)", "precision": "avg(CASE WHEN m < 0 THEN 1 - y ELSE y END)",
    "log-loss": "avg(-(y * ln(p) + (1 - y) * ln(1 - p)))",
}
_AUC = ", r AS (SELECT y, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM m) SELECT round((sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / (count(*) FILTER (y > 0) * count(*) FILTER (y = 0))::DOUBLE, 9) AS value FROM r"


def _multi_metric(name: str):
    def run(spark, d):
        o = _t(spark, d, "orders")
        y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
        m = F.array(*[(F.pmod(F.col("o_orderkey") + i, F.lit(5))).cast("double") for i in range(3)])
        return o.select(y.alias("y"), m.alias("m")).agg(F.round(objective.metric(name, F.col("m"), F.col("y"), 3), 9).alias("value"))

    return run


_MM = "WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, [((o_orderkey + i) % 5)::DOUBLE FOR i IN range(3)] AS m FROM orders)"
_MULTI_SQL = {
    "rmse": "sqrt(avg(list_sum([power(m[k + 1] - (k = y)::INT, 2) FOR k IN range(3)])))", "error": "avg((list_position(m, list_max(m)) - 1 <> y)::INT)",
    "precision": "avg((list_position(m, list_max(m)) - 1 = y)::INT)", "cross-entropy": "avg(-ln(exp(m[y + 1]) / list_sum([exp(v) FOR v IN m])))",
}


def _fixed_model() -> training.Model:
    N = training.Node
    t1 = {0: N(fid=0, split_type=0, fvalue=100000.0), 1: N(weight=[-1.0]), 2: N(fid=1, split_type=1, right_values=[2.0, 3.0]), 5: N(weight=[0.5]), 6: N(weight=[2.0])}
    t2 = {0: N(fid=1, split_type=0, fvalue=4.0), 1: N(weight=[0.25]), 2: N(weight=[-0.75])}
    return training.Model(GBDTParams(learning_rate=0.5), ["price", "prio"], [t1, t2], [])


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"))


def predict_fixed_forest(spark, d):
    s = predicting.predict(_orders(spark, d), _fixed_model())
    return s.groupBy("margin", "predicted").agg(F.count(F.lit(1)).alias("n"))


def feature_groups(spark, d):
    return bins.feature_groups(_info(spark, d), 2)


_TRAIN = GBDTParams(num_tree=3, max_depth=3, num_split=Q, min_node_instance=16, learning_rate=0.5)


def _train(p: GBDTParams):
    def run(spark, d):
        li = _lineitem(spark, d)
        m = training.train(li, "y", FEATURES, p)
        return predicting.predict(li, m).groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("avg_margin"))

    return run


K, MULTI = 10, GBDTParams(loss="multi:logistic", num_class=10, num_tree=1, max_depth=2, num_split=8, min_node_instance=16)
DIMS = [f"e{i}" for i in range(64)]


def _embeddings(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(DIMS)])


def train_multi(spark, d):
    """One tree of depth 2 for ten classes on all components."""
    e = _embeddings(spark, d)
    m = training.train(e, "label", DIMS, MULTI)
    return predicting.predict(e, m).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def best_split_multi(spark, d):
    """The best split at the root for ten classes: uniform probabilities, diagonal Hessian."""
    e = _embeddings(spark, d)
    infos = training.prepare(e, DIMS, MULTI)
    info = spark.createDataFrame([(i["fid"], i["is_categorical"], i["splits"], i["num_bin"], i["default_bin"]) for i in infos.values()], "fid int, is_categorical boolean, splits array<double>, num_bin int, default_bin int")
    g, h = objective.gradients(MULTI.loss, F.array(*[F.lit(0.0)] * K), F.col("_y"), K)
    rows = bins.bin_columns(e.withColumn("_y", F.col("label").cast("double")), DIMS, infos, ["_y"]).withColumns({"g": g, "h": h, "node": F.lit(0).cast("long")})
    b = split.best_splits(histogram.build_arrow(rows, list(range(len(DIMS))), K), info, MULTI)
    return b.select("node", "fid", "bin", "nl", F.round("fvalue", 6).alias("fvalue"), F.round("gain", 6).alias("gain"), F.round("l_g0", 6).alias("gl0"))


_MULTI_SPLIT = f"""WITH e AS (SELECT row_number() OVER () AS rid, label, embedding FROM embeddings),
cells AS (SELECT rid, label, i AS fid, embedding[i + 1]::DOUBLE AS value FROM e, range({len(DIMS)}) AS q(i) WHERE embedding[i + 1] <> 0),
r AS (SELECT fid, value, row_number() OVER (PARTITION BY fid ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY fid) AS n FROM cells),
k AS (SELECT DISTINCT r.fid, r.value AS c FROM r JOIN range(8) AS q(i) ON r.rk = (r.n * q.i) // 8),
cuts AS (SELECT fid, list(c ORDER BY c) AS s FROM k GROUP BY fid),
b AS (SELECT e.rid, e.label, q.i AS fid, s, greatest(len(list_filter(s, lambda c: c <= embedding[q.i + 1])) - 1, 0) AS bin FROM e, range({len(DIMS)}) AS q(i) JOIN cuts ON cuts.fid = q.i),
c AS (SELECT fid, bin, any_value(s) AS s, o, count(*) AS n, sum(0.1 - (label = o)::INT)::DOUBLE AS g, sum(0.09)::DOUBLE AS h FROM b, range({K}) AS z(o) GROUP BY fid, bin, o),
u AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM c
      WINDOW w AS (PARTITION BY fid, o ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY fid, o)),
v AS (SELECT fid, bin, any_value(s) AS s, any_value(nl) AS nl, any_value(gl) FILTER (o = 0) AS gl0,
             (sum(gl * gl / (hl + 1)) + sum((gt - gl) * (gt - gl) / (ht - hl + 1)) - sum(gt * gt / (ht + 1))) / {K} - 1 AS gain FROM u WHERE bin < len(s) - 1 GROUP BY fid, bin)
SELECT 0::BIGINT AS node, fid::INT AS fid, bin::INT AS bin, nl::BIGINT AS nl, round(s[bin + 2], 6) AS fvalue, round(gain, 6) AS gain, round(gl0, 6) AS gl0 FROM v WHERE gain > 0 ORDER BY v.gain DESC, fid, bin LIMIT 1"""


def leaf_weights_multi(spark, d):
    """Weights of the classes on either side of 0 of the first component: uniform probabilities, L1 and a bound on weights."""
    p = GBDTParams(reg_alpha=2.0, max_leaf_weight=1.5)
    g, h = objective.multinomial(F.array(*[F.lit(0.0)] * K), F.col("label"), K)
    e = _embeddings(spark, d).select(F.when(F.col("e0") < 0, 1).otherwise(2).cast("long").alias("node"), F.posexplode(F.arrays_zip(g.alias("g"), h.alias("h"))).alias("k", "p"))
    t = e.groupBy("node", "k").agg(F.sum("p.g").alias("g"), F.sum("p.h").alias("h"))
    return t.select("node", "k", F.round(weight(F.round("g", 9), F.col("h"), p), 6).alias("weight"))


_LEAF_MULTI = f"""WITH t AS (SELECT CASE WHEN embedding[1] < 0 THEN 1 ELSE 2 END AS node, o, round(sum(0.1 - (label = o)::INT), 9)::DOUBLE AS g, sum(0.09)::DOUBLE AS h FROM embeddings, range({K}) AS z(o) GROUP BY 1, 2)
SELECT node::BIGINT AS node, o::INT AS k, round(CASE WHEN g <> 0 THEN greatest(least(-sign(g) * greatest(abs(g) - 2, 0) / (h + 1), 1.5), -1.5) ELSE 0 END, 6) + 0.0 AS weight FROM t"""


def _fixed_multi_model() -> training.Model:
    N = training.Node
    t1 = {0: N(fid=0, split_type=0, fvalue=100000.0), 1: N(weight=[1.0, 0.0, -1.0]), 2: N(fid=1, split_type=1, right_values=[2.0, 3.0]), 5: N(weight=[0.0, 2.0, 0.5]), 6: N(weight=[0.25, 0.25, 3.0])}
    t2 = {0: N(fid=1, split_type=0, fvalue=4.0), 1: N(weight=[0.5, 0.0, 0.0]), 2: N(weight=[0.0, 1.5, 0.0])}
    return training.Model(GBDTParams(loss="multi:logistic", num_class=3, learning_rate=0.5), ["price", "prio"], [t1, t2], [])


def predict_class(spark, d):
    """Class by the first largest margin of three, with prices and priorities that are null, 0 or in no set."""
    odd = F.when(F.col("prio") == 5, F.lit(None)).when(F.col("prio") == 1, 0.0).otherwise(F.col("prio"))
    o = _orders(spark, d).select(F.when(F.col("price") < 5000, F.lit(None)).otherwise(F.col("price")).alias("price"), odd.alias("prio"))
    s = predicting.predict(o, _fixed_multi_model())
    return s.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("margin", 1)).alias("m0"), F.sum(F.element_at("margin", 3)).alias("m2"))


_PREDICT_CLASS = """WITH o AS (SELECT CASE WHEN o_totalprice < 5000 THEN NULL ELSE o_totalprice END AS p, CASE substr(o_orderpriority, 1, 1)::INT WHEN 5 THEN NULL WHEN 1 THEN 0 ELSE substr(o_orderpriority, 1, 1)::INT END AS q FROM orders),
m AS (SELECT CASE WHEN coalesce(p, 0) < 100000 THEN [1.0, 0, -1] WHEN coalesce(q, 0) IN (2, 3) THEN [0.25, 0.25, 3] ELSE [0, 2, 0.5] END AS a, CASE WHEN coalesce(q, 0) < 4 THEN [0.5, 0, 0] ELSE [0, 1.5, 0] END AS b FROM o),
z AS (SELECT [(0.5 * (a[i] + b[i]))::DOUBLE FOR i IN [1, 2, 3]] AS m FROM m)
SELECT (list_position(m, list_max(m)) - 1)::INT AS predicted, count(*) AS n, sum(m[1]) AS m0, sum(m[3]) AS m2 FROM z GROUP BY 1"""


def kll_cuts(spark, d):
    """Cuts from the sketch, and how far each stands from its exact rank: within 2 % of the cells."""
    cells = _cells(spark, d)
    ranked = bins._ranked(bins.value_counts(cells)).select(F.col("fid").alias("rf"), "value", "lo", "hi", "total")
    c = bins.kll_cuts(cells, Q).join(ranked, (F.col("fid") == F.col("rf")) & (F.col("cut") == F.col("value")))
    # cuts are distinct, so a cut may stand for several equal ranks: its nearest wanted rank counts
    off = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(Q - 1)), lambda i: F.greatest(F.col("lo") - F.floor(F.col("total") * i / Q), F.floor(F.col("total") * i / Q) - F.col("hi") + 1, F.lit(0))))
    return c.groupBy("fid").agg(F.max(off <= 0.02 * F.col("total")).alias("close"), (F.min(off) == 0).alias("some_exact"), F.min("cut").alias("first_cut"))


def quantiles_at(spark, d):
    return bins.quantiles_at(_counts(spark, d), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])


def table_functions(spark, d):
    """Sigmoid and logarithm by tables, over margins within and beyond the sigmoid's bound."""
    m = (F.col("l_linenumber") - 4) * 3 + F.col("l_discount")
    li = _lineitem(spark, d).select(F.round(objective.table_sigmoid(m), 6).alias("s"), F.round(objective.table_log(F.col("l_discount") * 12), 5).alias("l"))
    return li.groupBy("s", "l").agg(F.count(F.lit(1)).alias("n"))


_TABLES = f"""WITH m AS (SELECT ((l_linenumber - 4) * 3 + l_discount)::FLOAT AS m, (l_discount * 12)::FLOAT AS x FROM lineitem),
i AS (SELECT m, x, floor((m + 8) * 512 / 8 / 2) AS a, floor(x * 512) AS b FROM m)
SELECT round(CASE WHEN m < -8 THEN 0 WHEN m > 8 THEN 1 ELSE 1 / (1 + exp(-(a / 32 - 8))) END, 6)::DOUBLE AS s, round(CASE WHEN x > 1 THEN 0 ELSE ln((b + 1e-5) / 512) END, 5)::DOUBLE AS l, count(*) AS n FROM i GROUP BY 1, 2"""


def feature_group_layout(spark, d):
    """Histogram of the root from the layout by feature groups, present cells only."""
    info = _info(spark, d)
    groups = cut(bins.dense_groups(info, 2))
    li = _lineitem(spark, d).withColumn("ins_id", F.monotonically_increasing_id())
    g, h = objective.logistic(F.lit(0.0), F.col("y"))
    rows = bins.grouped_rows(sparse.wide_to_cells(li, FEATURES, keep=["ins_id", "y"]), info, groups, keep=["y"])
    hist = histogram.build_grouped(rows.withColumns({"node": F.lit(0).cast("long"), "g0": g, "h0": h}))
    names = groups.select(F.col("grp").alias("grp_of"), "place", F.col("fid").alias("true_fid"))
    return hist.join(F.broadcast(names), (F.col("grp") == F.col("grp_of")) & (F.col("fid") == F.col("place"))).select(F.col("true_fid").alias("fid"), F.col("grp").cast("int").alias("grp"), F.col("bin").cast("int").alias("bin"), "n", "g0")


def best_root_split(spark, d):
    """The flagship's first step: cuts, bins, gradients, histogram, scan, one row."""
    rows, info = _binned(spark, d)
    b = split.best_splits(histogram.build_arrow(rows, list(range(len(FEATURES))), 1), info, P)
    return b.select("fid", "split_type", "fvalue", F.round("gain", 6).alias("gain"), "nl", F.col("l_g0").alias("gl"), F.col("l_h0").alias("hl"))


_BEST = _best_numeric(P)
_BEST_L1 = _best_numeric(GBDTParams(num_split=Q, reg_alpha=50.0, reg_lambda=2.0))
_BEST_MAX = _best_numeric(GBDTParams(num_split=Q, max_leaf_weight=0.5, reg_alpha=1.0))
_DEPTH2 = GBDTParams(num_tree=1, max_depth=2, num_split=Q, min_node_instance=16, learning_rate=0.5)
_LEAFWISE = GBDTParams(num_tree=1, max_depth=3, num_split=Q, min_node_instance=16, growth="leaf", max_node_num=5)
_LEAF, _LEAF_L1 = _leaf(GBDTParams()), _leaf(GBDTParams(reg_alpha=100.0, max_leaf_weight=0.7))

QUERIES = {
    "best_root_split": best_root_split, "libsvm_parse": libsvm_parse, "label_remap_binary": label_remap_binary, "label_remap_multi": label_remap_multi,
    "cells_nnz": lambda s, d: bins.nnz(_cells(s, d)), "distinct_probe": lambda s, d: bins.distinct_probe(_counts(s, d)), "quantile_cuts": lambda s, d: bins.exact_cuts(_counts(s, d), Q),
    "feature_info": feature_info, "feature_groups": feature_groups, "bin_counts": bin_counts, "grad_logistic": _root("binary:logistic"), "grad_squared": _root("rmse"),
    "grad_softmax": _multi("multi:logistic"), "grad_squared_onehot": _multi("rmse"), "root_totals": root_totals, "hist_root": _hist(histogram.build_arrow), "hist_root_sql": _hist(histogram.build_sql),
    "hist_default_fill": hist_default_fill, "hist_two_nodes": hist_two_nodes, "hist_subtract": hist_subtract, "lighter_child": lighter_child,
    "split_scan": lambda s, d: (lambda r: _scan(histogram.build_arrow(r[0], list(range(len(FEATURES))), 1), r[1], P))(_binned(s, d)),
    "split_numeric_best": _BEST[0], "best_split_l1": _BEST_L1[0], "best_split_maxleaf": _BEST_MAX[0], "split_categorical_best": split_categorical_best, "route_level1": route_level1,
    "leaf_weights": _LEAF[0], "leaf_weights_l1_clamped": _LEAF_L1[0], "pred_after_tree1": pred_after_tree1, "predict_fixed_forest": predict_fixed_forest,
    "train_binary": _train(_TRAIN), "train_leafwise": _train(_LEAFWISE), "train_depth2": _train(_DEPTH2), "train_multi": train_multi, "kll_cuts": kll_cuts,
    "best_split_multi": best_split_multi, "leaf_weights_multi": leaf_weights_multi, "predict_class": predict_class, "quantiles_at": quantiles_at, "table_functions": table_functions, "feature_group_layout": feature_group_layout,
    **{f"metric_{n.replace('-', '_')}": _metric(n) for n in [*_METRIC_SQL, "auc"]}, **{f"metric_{n.replace('-', '_')}_multi": _multi_metric(n) for n in _MULTI_SQL},
}

_GRAD = lambda g, h: f"WITH {_wide()} SELECT y, count(*) AS n, sum({g})::DOUBLE AS g, sum({h})::DOUBLE AS h FROM w GROUP BY y"
_GRADM = lambda g, h: f"SELECT k::INT AS k, sum({g})::DOUBLE AS g, sum({h})::DOUBLE AS h FROM (SELECT list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS y, unnest(range(4)) AS k FROM documents) GROUP BY k"
_HEAD = f"WITH {_wide()}, {_RANKS}"
ORACLES = {
    "best_root_split": f"WITH RECURSIVE {_BINS}, {_best_sql('lvl0', 'gh', 'root', P)} SELECT fid, split_type, fvalue, round(gain, 6) AS gain, nl, gl, hl FROM lvl0",
    "train_depth2": _tree_sql(_DEPTH2, False), "train_leafwise": _tree_sql(_LEAFWISE, True),
    "best_split_multi": _MULTI_SPLIT, "leaf_weights_multi": _LEAF_MULTI, "predict_class": _PREDICT_CLASS, "table_functions": _TABLES,
    "quantiles_at": f"{_HEAD}, f AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS fraction) SELECT r.fid, fraction, value FROM r JOIN f ON r.rk = least(floor(r.n * fraction), r.n - 1)",
    "kll_cuts": f"WITH {_wide()} SELECT fid, TRUE AS close, TRUE AS some_exact, min(value) AS first_cut FROM cells GROUP BY fid",
    "feature_group_layout": f"{_HEAD}, o AS (SELECT fid, row_number() OVER (ORDER BY nnz, fid) - 1 AS r, count(*) OVER () AS n FROM info), q AS (SELECT fid, CASE WHEN r < n // 2 THEN fid % 2 ELSE 1 - fid % 2 END AS grp FROM o) SELECT fid, grp::INT AS grp, (greatest(len(list_filter(splits, lambda s: s <= value)) - 1, 0))::INT AS bin, count(*) AS n, sum(0.5 - y)::DOUBLE AS g0 FROM cells JOIN info USING (fid) JOIN q USING (fid) GROUP BY ALL",
    "libsvm_parse": f"WITH {_wide()} SELECT fid, count(*) AS n, round(sum(value), 2) AS total FROM cells GROUP BY fid",
    "label_remap_binary": f"WITH {_wide()} SELECT y, count(*) AS n FROM w GROUP BY y",
    "label_remap_multi": "SELECT CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS y, count(*) AS n FROM orders GROUP BY 1",
    "cells_nnz": f"WITH {_wide()} SELECT fid, count(*) AS nnz, min(value) AS min_value, max(value) AS max_value FROM cells GROUP BY fid",
    "distinct_probe": f"WITH {_wide()} SELECT fid, count(DISTINCT value) AS n_distinct, count(DISTINCT value) <= 32 AS is_categorical FROM cells GROUP BY fid",
    "quantile_cuts": f"{_HEAD} SELECT fid, (row_number() OVER (PARTITION BY fid ORDER BY c) - 1)::INT AS idx, c AS cut FROM k",
    "feature_info": f"{_HEAD} SELECT fid, is_categorical, num_bin, default_bin, nnz FROM info",
    "feature_groups": f"{_HEAD}, o AS (SELECT fid, row_number() OVER (ORDER BY nnz, fid) - 1 AS r, count(*) OVER () AS n FROM info) SELECT fid, fid % 2 AS rr_group, CASE WHEN r < n // 2 THEN fid % 2 ELSE 1 - fid % 2 END AS balanced_group, least(fid // (CASE WHEN n % 2 > n / 2.0 THEN (n + 1) // 2 ELSE greatest(n // 2, 1) END), 1)::INT AS even_group FROM o",
    "bin_counts": f"{_HEAD} SELECT fid, (greatest(len(list_filter(splits, lambda s: s <= value)) - 1, 0))::INT AS bin, count(*) AS n FROM cells JOIN info USING (fid) GROUP BY ALL",
    "grad_logistic": _GRAD("0.5 - y", "0.25"), "grad_squared": _GRAD("0 - y", "1"),
    "grad_softmax": _GRADM("0.25 - (k = y)::INT", "0.1875"), "grad_squared_onehot": _GRADM("0 - (k = y)::INT", "1"),
    "root_totals": f"WITH {_wide()} SELECT 0::BIGINT AS node, count(*) AS n, sum(0.5 - y) AS g, sum(0.25)::DOUBLE AS h, count(*) > 1024 AND sum(0.5 - y) <> 0 AS can_split FROM w",
    "hist_root": f"WITH {_BINS} {_HIST.format(node='root')}", "hist_root_sql": f"WITH {_BINS} {_HIST.format(node='root')}", "hist_default_fill": f"WITH {_BINS} {_HIST.format(node='root')}",
    "hist_two_nodes": f"WITH {_BINS} {_HIST.format(node='side')}", "hist_subtract": f"WITH {_BINS} SELECT * FROM ({_HIST.format(node='side')}) WHERE node = 2",
    "lighter_child": f"WITH {_wide()}, t AS (SELECT CASE WHEN l_quantity < 25 THEN 1 ELSE 2 END AS node, count(*) AS n FROM w GROUP BY 1) SELECT a.node::BIGINT AS node, b.node::BIGINT AS sibling, 0::BIGINT AS parent, a.n, a.n < b.n OR (a.n = b.n AND a.node < b.node) AS build FROM t a JOIN t b ON a.node <> b.node",
    "split_scan": _scan_sql(P) + " SELECT * FROM s", "split_numeric_best": _BEST[1], "best_split_l1": _BEST_L1[1], "best_split_maxleaf": _BEST_MAX[1], "split_categorical_best": _CAT,
    "route_level1": f"WITH {_BINS} SELECT side::BIGINT AS node, count(*) AS n, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h FROM gh WHERE fid = 0 GROUP BY 1",
    "leaf_weights": _LEAF[1], "leaf_weights_l1_clamped": _LEAF_L1[1], "pred_after_tree1": _TREE1,
    "predict_fixed_forest": "WITH o AS (SELECT o_totalprice AS p, substr(o_orderpriority, 1, 1)::DOUBLE AS q FROM orders), m AS (SELECT 0.5::DOUBLE * CASE WHEN p < 100000 THEN -1 WHEN q IN (2, 3) THEN 2 ELSE 0.5 END + 0.5::DOUBLE * CASE WHEN q < 4 THEN 0.25 ELSE -0.75 END AS margin FROM o) SELECT margin, (margin > 0)::INT AS predicted, count(*) AS n FROM m GROUP BY 1, 2",
    **{f"metric_{n.replace('-', '_')}": f"{_M} SELECT round({s}, 9) AS value FROM m" for n, s in _METRIC_SQL.items()}, "metric_auc": _M + _AUC,
    **{f"metric_{n.replace('-', '_')}_multi": f"{_MM} SELECT round({s}, 9) AS value FROM o" for n, s in _MULTI_SQL.items()},
}
