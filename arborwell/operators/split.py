"""Split search over histograms: one best split per node, all nodes of a level at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gain import gain_of, satisfies
from ..params import GBDTParams
from .histogram import pairs


def _loss_change(gl: list[Column], hl: list[Column], g: list[Column], h: list[Column], p: GBDTParams) -> Column:
    gr, hr = [a - b for a, b in zip(g, gl, strict=True)], [a - b for a, b in zip(h, hl, strict=True)]
    both = satisfies(hl, p) & satisfies(hr, p)
    return F.when(both, gain_of(gl, hl, p) + gain_of(gr, hr, p) - gain_of(g, h, p) - p.lam)


def numeric_candidates(hist: DataFrame, info: DataFrame, p: GBDTParams) -> DataFrame:
    """node, fid, bin, gain, nl, left and total pairs for every bin but the last. A window partition is one node's feature."""
    k = p.outputs
    d = hist.join(F.broadcast(info.where(~F.col("is_categorical")).select("fid", "num_bin", "splits")), "fid")
    upto = Window.partitionBy("node", "fid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "fid")
    d = d.select("node", "fid", "bin", "num_bin", "splits", F.sum("n").over(upto).alias("nl"), *[F.sum(c).over(upto).alias(f"l_{c}") for c in pairs(k)], *[F.sum(c).over(whole).alias(f"t_{c}") for c in pairs(k)])
    pick = lambda s: ([F.col(f"{s}_g{i}") for i in range(k)], [F.col(f"{s}_h{i}") for i in range(k)])
    (gl, hl), (g, h) = pick("l"), pick("t")
    d = d.where(F.col("bin") < F.col("num_bin") - 1).withColumn("gain", _loss_change(gl, hl, g, h, p))
    return d.withColumn("fvalue", F.get("splits", F.col("bin") + 1)).drop("splits", "num_bin")


def categorical_candidates(hist: DataFrame, info: DataFrame, p: GBDTParams) -> DataFrame:
    """node, fid, gain, nl, left_bins, left and total pairs: a fold over the bins in order of value.

    The default bin starts on the left; a bin joins it if g_b . (2 G_L + g_b - G) >= 0.
    """
    k = p.outputs
    d = hist.join(F.broadcast(info.where("is_categorical").select("fid", "default_bin")), "fid")
    pair = F.struct("bin", "n", F.array(*[f"g{i}" for i in range(k)]).alias("g"), F.array(*[f"h{i}" for i in range(k)]).alias("h"))
    d = d.groupBy("node", "fid", "default_bin").agg(F.array_sort(F.collect_list(pair)).alias("b"), *[F.sum(c).alias(f"t_{c}") for c in pairs(k)])  # a feature's bins
    total = F.array(*[f"t_g{i}" for i in range(k)])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    first = F.filter("b", lambda x: x["bin"] == F.col("default_bin"))
    zero = F.array(*[F.lit(0.0)] * k)
    start = F.struct(
        F.coalesce(F.get(first, F.lit(0))["g"], zero).alias("g"), F.coalesce(F.get(first, F.lit(0))["h"], zero).alias("h"),
        F.coalesce(F.get(first, F.lit(0))["n"], F.lit(0)).cast("long").alias("n"), F.array(F.col("default_bin")).alias("left"),
    )

    def fold(acc: Column, x: Column) -> Column:
        dot = F.aggregate(F.zip_with(x["g"], F.zip_with(F.zip_with(acc["g"], x["g"], lambda a, b: 2 * a + b), total, lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        new = F.struct(add(acc["g"], x["g"]).alias("g"), add(acc["h"], x["h"]).alias("h"), (acc["n"] + x["n"]).cast("long").alias("n"), F.concat(acc["left"], F.array(x["bin"])).alias("left"))
        return F.when(dot >= 0, new).otherwise(acc)

    d = d.withColumn("l", F.aggregate(F.filter("b", lambda x: x["bin"] != F.col("default_bin")), start, fold))
    gl, hl = [F.get("l.g", F.lit(i)) for i in range(k)], [F.get("l.h", F.lit(i)) for i in range(k)]
    g, h = [F.col(f"t_g{i}") for i in range(k)], [F.col(f"t_h{i}") for i in range(k)]
    some_right = F.exists("b", lambda x: ~F.array_contains("l.left", x["bin"]))
    d = d.withColumn("gain", F.when(some_right, _loss_change(gl, hl, g, h, p)))
    return d.select("node", "fid", "gain", F.col("l.n").alias("nl"), F.array_sort("l.left").alias("left_bins"), F.transform("b", lambda x: x["bin"]).alias("bins"), *[c.alias(f"l_{n}") for n, c in zip(pairs(k), gl + hl, strict=True)], *[F.col(f"t_{c}") for c in pairs(k)])


def _gains(g: np.ndarray, h: np.ndarray, p: GBDTParams) -> np.ndarray:
    """Gain of nodes with several outputs (rows of g and h): the mean over outputs."""
    s = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0) if p.reg_alpha else g
    v = (s * s / (h + p.lam)).sum(axis=1) / g.shape[1]
    ok = (np.abs(g) > 1e-8).any(axis=1)
    return np.where(ok & (np.prod(h, axis=1) >= p.min_child_weight) if p.min_child_weight else ok, v, 0.0)


def _changes(gl: np.ndarray, hl: np.ndarray, g: np.ndarray, h: np.ndarray, p: GBDTParams) -> np.ndarray:
    out = _gains(gl, hl, p) + _gains(g - gl, h - hl, p) - _gains(g[None], h[None], p)[0] - p.lam
    if p.min_child_weight:
        out[(np.prod(hl, axis=1) < p.min_child_weight) | (np.prod(h - hl, axis=1) < p.min_child_weight)] = -np.inf
    return out


def _best_of_feature(bins: np.ndarray, n: np.ndarray, g: np.ndarray, h: np.ndarray, categorical: bool, num_bin: int, default: int, p: GBDTParams) -> tuple | None:
    """bin, gain, nl, left_bins, bins, left g and h of one node's feature, or None."""
    total_g, total_h = g.sum(axis=0), h.sum(axis=0)
    if not categorical:
        gl, hl, nl = g.cumsum(axis=0), h.cumsum(axis=0), n.cumsum()
        change = np.where(bins < num_bin - 1, _changes(gl, hl, total_g, total_h, p), -np.inf)
        b = int(change.argmax())
        return (int(bins[b]), float(change[b]), int(nl[b]), None, None, gl[b], hl[b]) if np.isfinite(change[b]) else None
    first = bins == default
    gl, hl, left = g[first].sum(axis=0), h[first].sum(axis=0), [default]
    nl = int(n[first].sum())
    for b in np.flatnonzero(~first):
        if g[b] @ (2 * gl + g[b] - total_g) >= 0:
            gl, hl, nl = gl + g[b], hl + h[b], nl + int(n[b])
            left.append(int(bins[b]))
    if set(bins.tolist()) <= set(left):
        return None
    change = float(_changes(gl[None], hl[None], total_g, total_h, p)[0])
    return (None, change, nl, sorted(left), bins.tolist(), gl, hl) if np.isfinite(change) else None


_BEST_SCHEMA = "node long, fid int, split_type int, bin int, gain double, nl long, left_bins array<int>, bins array<int>, lg array<double>, lh array<double>"


def multi_candidates(hist: DataFrame, info: DataFrame, p: GBDTParams) -> DataFrame:
    """The best split of each node's feature with several outputs, gains in numpy over the sorted bins of a partition (_BEST_SCHEMA)."""
    k = p.outputs
    d = hist.join(F.broadcast(info.select("fid", "is_categorical", "num_bin", "default_bin")), "fid")  # one row per feature
    d = d.select("node", "fid", "bin", "n", "is_categorical", "num_bin", "default_bin", F.array(*[f"g{i}" for i in range(k)]).alias("g"), F.array(*[f"h{i}" for i in range(k)]).alias("h"))
    d = d.repartition("node", "fid").sortWithinPartitions("node", "fid", "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def best(rows: pa.Table) -> Iterator[list]:
            cols = {c: rows.column(c).to_numpy() for c in ("node", "fid", "bin", "n", "is_categorical", "num_bin", "default_bin")}
            g, h = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, k) for c in ("g", "h"))
            cuts = np.flatnonzero(np.r_[True, (cols["node"][1:] != cols["node"][:-1]) | (cols["fid"][1:] != cols["fid"][:-1]), True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                categorical = bool(cols["is_categorical"][lo])
                found = _best_of_feature(cols["bin"][lo:hi], cols["n"][lo:hi], g[lo:hi], h[lo:hi], categorical, int(cols["num_bin"][lo]), int(cols["default_bin"][lo]), p)
                if found:
                    yield [int(cols["node"][lo]), int(cols["fid"][lo]), int(categorical), *found[:5], found[5].tolist(), found[6].tolist()]

        def out(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _BEST_SCHEMA.split(", ")])

        for b in batches:  # a feature's bins may lie in two batches: the last feature waits for the next one
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([*held, b]).combine_chunks()
            node, fid = whole.column("node").to_numpy(), whole.column("fid").to_numpy()
            last = int(np.flatnonzero((node != node[-1]) | (fid != fid[-1])).max(initial=-1)) + 1
            if last:
                yield out(list(best(whole.slice(0, last))))
            held = whole.slice(last).to_batches()
        if held:
            yield out(list(best(pa.Table.from_batches(held))))

    return d.mapInArrow(run, _BEST_SCHEMA)


def best_splits(hist: DataFrame, info: DataFrame, p: GBDTParams) -> DataFrame:
    """The best valid split of each node: gain down, points before sets, fid up, bin up. bins: the bins of a set's feature that the node's rows are in."""
    k = p.outputs
    if k > 1:
        d = multi_candidates(hist, info, p).join(F.broadcast(info.select(F.col("fid").alias("f"), "splits")), F.col("fid") == F.col("f"))
        d = d.withColumn("fvalue", F.get("splits", F.col("bin") + 1)).drop("f", "splits")
    else:
        num = numeric_candidates(hist, info, p).withColumns({"split_type": F.lit(0), "left_bins": F.lit(None).cast("array<int>"), "bins": F.lit(None).cast("array<int>")})
        cat = categorical_candidates(hist, info, p).withColumns({"split_type": F.lit(1), "bin": F.lit(None).cast("int"), "fvalue": F.lit(None).cast("double")})
        d = num.unionByName(cat)
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "split_type", "fid", "bin"))
    d = d.where(F.col("gain") > max(0.0, p.min_split_gain)).withColumn("rn", first).where("rn = 1").drop("rn")
    if k > 1:
        d = d.select("*", *[F.get("lg", F.lit(i)).alias(f"l_g{i}") for i in range(k)], *[F.get("lh", F.lit(i)).alias(f"l_h{i}") for i in range(k)]).drop("lg", "lh")
    return d
