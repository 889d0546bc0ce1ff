"""Gradient histograms: node, fid, bin, n, g0.., h0.. (one pair per output)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(k: int) -> list[str]:
    return [f"g{i}" for i in range(k)] + [f"h{i}" for i in range(k)]


def build_sql(rows: DataFrame, fids: list[int], k: int) -> DataFrame:
    """From rows (node, pairs, b<fid>): explode and group; all nodes of a level in one job, combined before the shuffle."""
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("fid"), F.col(f"b{f}").alias("bin")) for f in fids]))
    d = rows.select("node", *pairs(k), cell.alias("c")).groupBy("node", "c.fid", "c.bin")
    return d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in pairs(k)])


def build_arrow(rows: DataFrame, fids: list[int], k: int) -> DataFrame:
    """The same by numpy bin counts per partition: what is shuffled is one histogram per partition. Rows may hold the pairs as arrays g and h."""
    names = ["n", *pairs(k)]
    arrays = k > 1 and "g" in rows.columns
    given = ["g", "h"] if arrays else pairs(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            node = b.column(0).to_numpy().astype(np.int64)
            if arrays:
                weights = [None, *np.concatenate([b.column(1 + i).flatten().to_numpy().reshape(-1, k) for i in range(2)], axis=1).T]
            else:
                weights = [None, *[b.column(1 + i).to_numpy() for i in range(2 * k)]]
            nodes, at = np.unique(node, return_inverse=True)
            for j, f in enumerate(fids):
                bins = b.column(1 + len(given) + j).to_numpy().astype(np.int64)
                width = int(bins.max()) + 1 if len(bins) else 1
                key = at * width + bins
                sums = np.stack([np.bincount(key, weights=w, minlength=len(nodes) * width).astype(np.float64) for w in weights], axis=1)
                some = np.flatnonzero(sums[:, 0])
                keys = np.stack([nodes[some // width], some % width], axis=1)
                if f in total:
                    keys = np.concatenate([total[f][0], keys])
                    both, inv = np.unique(keys, axis=0, return_inverse=True)
                    merged = np.zeros((len(both), len(names)))
                    np.add.at(merged, inv.ravel(), np.concatenate([total[f][1], sums[some]]))
                    total[f] = (both, merged)
                else:
                    total[f] = (keys, sums[some])
        for f, (keys, sums) in total.items():
            cols = [pa.array(keys[:, 0]), pa.array(np.full(len(keys), f, dtype=np.int32)), pa.array(keys[:, 1].astype(np.int32)), *[pa.array(sums[:, i]) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "fid", "bin", *names])

    schema = "node long, fid int, bin int, " + ", ".join(f"{c} double" for c in names)
    part = rows.select("node", *given, *[f"b{f}" for f in fids]).mapInArrow(run, schema)
    return part.groupBy("node", "fid", "bin").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in pairs(k)])


def build_grouped(rows: DataFrame, k: int = 1) -> DataFrame:
    """node, grp, fid (its number inside the group), bin, n and pairs from bins.grouped_rows() that keep node and pairs: present cells only."""
    d = rows.select("node", "grp", *pairs(k), F.explode(F.arrays_zip("fids", "bins")).alias("c"))
    return d.groupBy("node", "grp", F.col("c.fids").alias("fid"), F.col("c.bins").alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in pairs(k)])


def fill_default(observed: DataFrame, totals: DataFrame, info: DataFrame, k: int = 1) -> DataFrame:
    """Histogram of present cells plus, in each feature's default bin, what the node has beyond them."""
    names = ["n", *pairs(k)]
    seen = observed.groupBy("node", "fid").agg(*[F.sum(c).alias(f"s_{c}") for c in names])
    rest = totals.select("node", *[F.col(c).alias(f"t_{c}") for c in names]).crossJoin(F.broadcast(info.select("fid", "default_bin"))).join(seen, ["node", "fid"], "left")
    rest = rest.select("node", "fid", F.col("default_bin").alias("bin"), *[(F.col(f"t_{c}") - F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in names])
    return observed.select("node", "fid", "bin", *names).unionByName(rest).groupBy("node", "fid", "bin").agg(*[F.sum(c).alias(c) for c in names])


def subtract(parent: DataFrame, child: DataFrame, sibling, k: int = 1) -> DataFrame:
    """Histograms of the siblings of child's nodes: parent minus child. sibling: node column -> its sibling's id."""
    names = ["n", *pairs(k)]
    c = child.select((F.floor((F.col("node") - 1) / 2)).cast("long").alias("p"), F.col("node").alias("c"), F.col("fid").alias("cf"), F.col("bin").alias("cb"), *[F.col(x).alias(f"c_{x}") for x in names])
    built = child.select(F.col("node").alias("built")).distinct().select("built", F.floor((F.col("built") - 1) / 2).cast("long").alias("bp"))
    d = parent.join(F.broadcast(built), F.col("node") == F.col("bp"))  # one row per node of a level
    d = d.join(c, (F.col("built") == F.col("c")) & (F.col("fid") == F.col("cf")) & (F.col("bin") == F.col("cb")), "left")
    d = d.select(sibling(F.col("built")).cast("long").alias("node"), "fid", "bin", *[(F.col(x) - F.coalesce(f"c_{x}", F.lit(0))).alias(x) for x in names])
    return d.where("n > 0")
