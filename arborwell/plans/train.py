"""Boosting: trees grow level by level (or leaf by leaf); a level is one job that returns one row per node.

Rows are binned once and checkpointed with their margins; a row's node is an expression over its bins, so growing a tree
writes nothing, and one checkpoint per tree carries the margins on. Histograms of the larger of two siblings come from
their parent's. Only best splits, node totals and metrics reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import objective
from ..operators import bins, histogram, split
from ..params import GBDTParams
from ..sources import sparse
from .lineage import cut


@dataclass
class Node:
    n: int = 0
    g: list[float] = field(default_factory=list)
    h: list[float] = field(default_factory=list)
    fid: int = -1  # -1: a leaf
    split_type: int = 0
    gain: float = 0.0
    fvalue: float | None = None
    bin: int | None = None
    left_bins: list[int] | None = None
    right_values: list[float] | None = None
    weight: list[float] | None = None


@dataclass
class Model:
    params: GBDTParams
    features: list[str]
    trees: list[dict[int, Node]]
    history: list[dict]


def leaf_weight(g: list[float], h: list[float], p: GBDTParams) -> list[float]:
    """One weight per output."""
    if all(abs(x) == 0 for x in g) or np.prod(h) < p.min_child_weight:
        return [0.0] * len(g)
    w = -np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0) / (np.array(h) + p.lam)
    if p.max_leaf_weight:
        w = np.clip(w, -p.max_leaf_weight, p.max_leaf_weight)
    return w.tolist()


def full_hessian_weight(g: list[float], lower: list[float], p: GBDTParams) -> list[float]:
    """Solves (H + lambda I) w = -g for a packed lower triangle."""
    k = len(g)
    h = np.zeros((k, k))
    h[np.tril_indices(k)] = lower
    h += np.tril(h, -1).T
    w = np.linalg.solve(h + p.lam * np.eye(k), -np.asarray(g))
    return (np.clip(w, -p.max_leaf_weight, p.max_leaf_weight) if p.max_leaf_weight else w).tolist()


def node_column(tree: dict[int, Node], at: int = 0) -> Column:
    """The leaf id of a binned row."""
    n = tree[at]
    if n.fid < 0:
        return F.lit(at).cast("long")
    b = F.col(f"b{n.fid}")
    left = b <= n.bin if n.split_type == 0 else b.isin(n.left_bins)
    return F.when(left, node_column(tree, 2 * at + 1)).otherwise(node_column(tree, 2 * at + 2))


def can_split(n: Node, p: GBDTParams) -> bool:
    return n.n > p.min_node_instance and any(x != 0 for x in n.g) and (p.min_child_weight == 0 or np.prod(n.h) >= p.min_child_weight)


def sampled_features(count: int, p: GBDTParams, tree: int) -> list[int]:
    """Without replacement, by a seeded hash."""
    if p.feature_sample_ratio >= 1:
        return list(range(count))
    order = sorted(range(count), key=lambda f: xxhash.xxh64_intdigest(f"{p.seed}|{tree}|{f}"))
    return sorted(order[: max(1, round(count * p.feature_sample_ratio))])


def prepare(df: DataFrame, features: list[str], p: GBDTParams) -> dict[int, dict]:
    """fid -> row of feature_info. One row per feature reaches the driver."""
    cells = sparse.wide_to_cells(df, features)
    if cells.where(F.isnan("value")).limit(1).count():
        raise ValueError("a feature holds NaN")
    counts = cut(bins.value_counts(cells))
    cuts = bins.exact_cuts(counts, p.num_split) if p.cuts == "exact" else bins.kll_cuts(cells, p.num_split)
    return {r["fid"]: r.asDict() for r in bins.feature_info(counts, cuts, p.enum_threshold).collect()}


def _best(rows: DataFrame, hist_of: dict, active: list[int], tree: dict[int, Node], fids: list[int], info: DataFrame, p: GBDTParams) -> tuple[DataFrame, list]:
    """Histograms of the active nodes and their best splits."""
    k = p.outputs
    pairs_of = [(a, a + 1) for a in active if a % 2 and a + 1 in active] if p.hist_subtraction and hist_of else []
    small = [min(ab, key=lambda a: tree[a].n) if p.lighter_child_first else ab[0] for ab in pairs_of]
    large = {2 * ((a - 1) // 2) + 1 + (a % 2) for a in small}
    build = [a for a in active if a not in large]
    hist = histogram.build_arrow(rows.where(F.col("node").isin(build)), fids, k)
    hist = cut(hist) if p.hist_subtraction else hist
    if small:
        sibling = lambda c: F.when(c % 2 == 0, c - 1).otherwise(c + 1)
        hist = cut(hist.unionByName(histogram.subtract(hist_of["all"], hist.where(F.col("node").isin(small)), sibling, k)))
    return hist, split.best_splits(hist, info, p).collect()


def train(df: DataFrame, label: str, features: list[str], params: GBDTParams | None = None, valid: DataFrame | None = None) -> Model:
    """Fit a model on wide rows. valid rows ride along for metrics only."""
    p = params or GBDTParams()
    objective.loss_name(p.loss, p.num_class)
    if p.full_hessian:
        raise ValueError("growing with full Hessians is not supported; see full_hessian_weight")
    spark, k = df.sparkSession, p.outputs
    df = sparse.remap_labels(df, label, p.num_class)
    if p.float32:
        df = df.withColumns({f: F.col(f).cast("float").cast("double") for f in features})
        valid = valid.withColumns({f: F.col(f).cast("float").cast("double") for f in features}) if valid is not None else None
    infos = prepare(df, features, p)
    info = spark.createDataFrame([(i["fid"], i["is_categorical"], i["splits"], i["num_bin"], i["default_bin"]) for i in infos.values()], "fid int, is_categorical boolean, splits array<double>, num_bin int, default_bin int")
    zero = F.lit(0.0) if k == 1 else F.array(*[F.lit(0.0)] * k)
    both = df.withColumn("_part", F.lit(0))
    if valid is not None:
        both = both.select(label, *features, "_part").unionByName(valid.select(label, *features, F.lit(1).alias("_part")))
    rows = bins.bin_columns(both.withColumn("_y", F.col(label).cast("double")), features, infos, ["_y", "_part"]).withColumn("_m", zero)
    rows = cut(rows)
    model = Model(p, features, [], [])
    for t in range(p.num_tree):
        fids = [f for f in sampled_features(len(features), p, t) if f in infos]
        g, h = objective.gradients(p.loss, F.col("_m"), F.col("_y"), p.num_class, p.fast_math)
        cols = [g.alias("g0"), h.alias("h0")] if k == 1 else [g.alias("g"), h.alias("h")]
        graded = rows.where("_part = 0").select(*cols, *[f"b{f}" for f in range(len(features))])
        tree = {0: _root(graded, k)}
        pending: dict[int, object] = {}
        active, hist_of = [0] if can_split(tree[0], p) else [], {}
        limit = p.max_node_num or (1 << (p.max_depth + 1)) - 1
        while active or pending:
            if active:
                at = node_column(tree)
                hist, found = _best(graded.withColumn("node", at), hist_of, active, tree, fids, info, p)
                if p.growth == "level":
                    hist_of = {"all": hist}
                pending |= {r["node"]: r for r in found}
            chosen = list(pending) if p.growth == "level" else ([max(pending, key=lambda a: (pending[a]["gain"], -a))] if pending else [])
            active = []
            for a in sorted(chosen):
                r = pending.pop(a)
                if len(tree) + 2 > limit:
                    continue
                n = tree[a]
                n.fid, n.split_type, n.gain, n.fvalue, n.bin, n.left_bins = r["fid"], r["split_type"], r["gain"], r["fvalue"], r["bin"], r["left_bins"]
                if n.split_type:
                    n.right_values = [v for b, v in enumerate(infos[n.fid]["splits"]) if b not in n.left_bins]
                    # bins without rows in this node stand on the left, as unseen values do
                    n.left_bins, n.right_values = _sides(n, infos[n.fid], r["bins"])
                gl, hl = [r[f"l_g{i}"] for i in range(k)], [r[f"l_h{i}"] for i in range(k)]
                tree[2 * a + 1] = Node(r["nl"], gl, hl)
                tree[2 * a + 2] = Node(n.n - r["nl"], [x - y for x, y in zip(n.g, gl, strict=True)], [x - y for x, y in zip(n.h, hl, strict=True)])
                active += [c for c in (2 * a + 1, 2 * a + 2) if 2 * c + 1 < (1 << (p.max_depth + 1)) - 1 and can_split(tree[c], p)]
        for n in tree.values():
            if n.fid < 0:
                n.weight = leaf_weight(n.g, n.h, p)
        model.trees.append(tree)
        leaves = F.create_map(*[x for a, n in tree.items() if n.fid < 0 for x in (F.lit(a).cast("long"), F.array(*[F.lit(p.learning_rate * w) for w in n.weight]))])
        step = F.element_at(leaves, node_column(tree))
        margin = F.col("_m") + F.get(step, F.lit(0)) if k == 1 else F.zip_with("_m", step, lambda a, b: a + b)
        rows = cut(rows.withColumn("_m", margin))
        model.history.append({"tree": t} | evaluate(rows, p))
    return model


def _root(graded: DataFrame, k: int) -> Node:
    if k == 1:
        t = graded.agg(F.count(F.lit(1)).alias("n"), F.sum("g0").alias("g"), F.sum("h0").alias("h")).first()
        return Node(t["n"], [t["g"] or 0.0], [t["h"] or 0.0])
    each = graded.select(F.posexplode(F.arrays_zip("g", "h")).alias("k", "p")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("p.g").alias("g"), F.sum("p.h").alias("h"))
    rows = {r["k"]: r for r in each.collect()}  # one row per output
    return Node(rows[0]["n"], [rows[i]["g"] for i in range(k)], [rows[i]["h"] for i in range(k)]) if rows else Node(0, [0.0] * k, [0.0] * k)


def _sides(n: Node, info: dict, seen: list[int]) -> tuple[list[int], list[float]]:
    right = sorted(set(seen) - set(n.left_bins))
    return [b for b in range(info["num_bin"]) if b not in right], [info["splits"][b] for b in right]


def evaluate(rows: DataFrame, p: GBDTParams) -> dict:
    """Metrics of train and validation rows (valid_...)."""
    names = p.metrics or (objective.LOSSES[p.loss.lower()],)
    out = {}
    plain = [m for m in names if m.lower() != "auc"]
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[objective.metric(m, F.col("_m"), F.col("_y"), p.num_class).alias(m) for m in plain]).collect():
        out |= {("valid_" if r["_part"] else "") + m: r[m] for m in plain}
        if "auc" in [m.lower() for m in names]:
            out[("valid_" if r["_part"] else "") + "auc"] = objective.auc(rows.where(F.col("_part") == r["_part"]), "_m", "_y").first()["auc"]
    return out
