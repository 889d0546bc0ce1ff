"""Approximate nearest neighbours by learned partitions (largest inner product).

Fitted on a sample of at most SAMPLE_MAX distinct vectors (the smallest hashes of id and vector, 4096 or 64 per
partition): a k-nearest-neighbour graph of the sample is cut by recursive balanced bisection (a spectral start, halves
split at the median, then swaps that lower the cut); a small network learns where a vector's neighbours lie. Every row
is indexed in its most probable partition; a query is routed to its most probable partitions and reranked there by
exact inner products in double precision. How many partitions a query probes is the least number that reaches
RECALL_AIM on sample queries the network has not seen, measured against brute force.

A partition's rows are cut into blocks and its queries into chunks, so a group holds at most BLOCK rows and CHUNK queries
on average, whatever one partition attracts; a block finds the best k of each query, so nothing is capped. A task combines
what its blocks found for a query, so what is shuffled grows with tasks, not with blocks. The number of partitions
grows with the rows up to PARTITIONS_MAX; beyond that, work per query grows with the rows.

Vectors that are null, zero, of a length other than the most frequent one, or hold null or non-finite components take
no part, nor do rows without an id. Rows that share an id are one row with the smallest of their vectors. Extra columns
are ignored; an empty table gives no rows. Components stay as precise as they are given. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .embed_dedup import usable

ROWS_PER_PARTITION, PARTITIONS_MAX, SAMPLE_MIN, SAMPLE_MAX = 1024, 256, 4096, 16384
GRAPH_K, HIDDEN, EPOCHS, RECALL_AIM, SEED = 16, 64, 200, 0.94, 7
BLOCK, CHUNK = 2048, 1024
#: Rows found that a task holds at most, about, before it combines them by query.
COMBINE = 1_000_000


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row, itself apart."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Balanced partition (parts: a power of two) of the symmetric graph with edges i - near[i]."""
    n, k = near.shape
    src = np.repeat(np.arange(n), k)
    a, b = np.r_[src, near.ravel()], np.r_[near.ravel(), src]
    label = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(parts.bit_length() - 1):
        same = label[a] == label[b]
        i, j = a[same], b[same]
        degree = np.maximum(np.bincount(i, minlength=n), 1)
        new = np.zeros(n, dtype=np.int64)
        v = rng.standard_normal(n)
        for _ in range(60):  # power iteration for the second eigenvector, all current parts at once
            v = 0.5 * v + 0.5 * np.bincount(i, weights=v[j], minlength=n) / degree
            mass = np.bincount(label, weights=degree, minlength=label.max() + 1)
            v -= (np.bincount(label, weights=v * degree, minlength=len(mass)) / np.maximum(mass, 1))[label]
            v /= np.sqrt(np.bincount(label, weights=v * v, minlength=len(mass)))[label] + 1e-12
        order = np.lexsort((v, label))
        size = np.bincount(label, minlength=label.max() + 1)
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        new[order] = place >= np.repeat(size // 2, size)
        for _ in range(12):  # swaps between the halves of a part, best first, an eighth of a half at most
            gain = np.bincount(i, weights=np.where(new[i] != new[j], 1.0, -1.0), minlength=n)
            before = new.copy()
            cut = (new[i] != new[j]).sum()
            for part in range(len(size)):
                own = np.flatnonzero(label == part)
                left, right = own[new[own] == 0], own[new[own] == 1]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = max(1, min(len(left), len(right)) // 8)
                m = min(m, len(left), len(right))
                good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
                new[left[:good]], new[right[:good]] = 1, 0
            if (new[i] != new[j]).sum() >= cut:
                new = before
                break
        label = 2 * label + new
    return label


class Router:
    """Two-layer network: log-probability of each partition for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        self.scale = 1.0 / max(1e-12, float(np.sqrt((x * x).mean())))
        w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p), rng.standard_normal((d, p)) * 0.01]
        m, s, step = [np.zeros_like(q) for q in w], [np.zeros_like(q) for q in w], 0
        x = x * self.scale
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(x))
            for at in range(0, len(x), 1024):
                xb, tb = x[order[at : at + 1024]], target[order[at : at + 1024]]
                h = np.tanh(xb @ w[0] + w[1])
                z = h @ w[2] + w[3] + xb @ w[4]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (q / q.sum(axis=1, keepdims=True) - tb) / len(xb)
                dh = (dz @ w[2].T) * (1 - h * h)
                step += 1
                for t, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0), xb.T @ dz)):
                    g = g + 1e-4 * w[t]
                    m[t] = 0.9 * m[t] + 0.1 * g
                    s[t] = 0.99 * s[t] + 0.01 * g * g
                    w[t] -= rate * (m[t] / (1 - 0.9**step)) / (np.sqrt(s[t] / (1 - 0.99**step)) + 1e-8)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) * self.scale
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3] + x @ self.w[4]


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Router | None, int]:
    """A router for parts partitions and the number of partitions to probe."""
    x = np.unique(sample.astype(np.float64), axis=0)
    if parts < 2 or len(x) < 8 * parts or len(x) < 4 * k:
        return None, 1
    x = x[np.random.default_rng(SEED).permutation(len(x))]
    held, seen = x[: len(x) // 4], x[len(x) // 4 :]
    near = _graph(seen, min(GRAPH_K, len(seen) - 1))
    label = balanced_parts(near, parts)
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.repeat(np.arange(len(seen)), near.shape[1]), label[near.ravel()]), 1.0 / near.shape[1])
    own = np.zeros_like(target)
    own[np.arange(len(seen)), label] = 1.0
    router = Router(seen, 0.8 * target + 0.2 * own)
    x = np.concatenate([held, seen])  # held-out queries against the whole sample
    z = router.scores(x)
    place = np.argsort(np.argsort(-z[: len(held)], axis=1), axis=1)  # of each partition for each query
    ranks = np.take_along_axis(place, z.argmax(axis=1)[_graph(x, k)[: len(held)]], axis=1)
    recall = [(ranks < m).mean() for m in range(1, parts + 1)]
    return router, next(m for m, r in enumerate(recall, 1) if r >= RECALL_AIM or m == parts)


def _score_block(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a block for each query of a chunk, ties to smaller ids."""
    q, r = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
    if not len(q) or not len(r):
        return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
    xq, xr = np.stack(q["vec"].to_numpy()).astype(np.float64), np.stack(r["vec"].to_numpy()).astype(np.float64)
    qid, rid = q["id"].to_numpy(), r["id"].to_numpy()
    out = []
    for at in range(0, len(xq), 256):
        s = xq[at : at + 256] @ xr.T
        s[qid[at : at + 256, None] == rid[None, :]] = -np.inf
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        for i in range(len(s)):
            # rounding differs with a row's place in a block: near candidates are scored again, each alone
            c = np.flatnonzero(s[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i]))) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(s[i]))
            e = (xr[c] * xq[at + i]).sum(axis=1)
            best = np.lexsort((rid[c], -e))[:k]
            out.append((np.full(len(best), qid[at + i]), rid[c[best]], e[best]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def _best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The best k of each query, ties to smaller ids."""
    pdf = pd.concat(found, ignore_index=True)
    q = pdf["query_id"].to_numpy()
    order = np.lexsort((pdf["id"].to_numpy(), -pdf["score"].to_numpy(), q))
    first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return pdf.iloc[order[rank < k]]


def _score_task(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Score all blocks of a task, which come one after another, and combine what they find for a query before it is shuffled."""
    held: list[pd.DataFrame] = []
    found: list[pd.DataFrame] = []
    key, size = None, 0

    def close() -> None:
        nonlocal size
        block = _score_block(pd.concat(held, ignore_index=True), k)
        if len(block):
            found.append(block)
            size += len(block)
        held.clear()

    for pdf in batches:
        keys = pdf[["part", "block", "chunk"]].to_numpy()
        cuts = np.flatnonzero(np.r_[len(keys) > 0, (keys[1:] != keys[:-1]).any(axis=1)])
        for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if held and tuple(keys[lo]) != key:
                close()
                if size > COMBINE:
                    found = [_best(found, k)]
                    size = len(found[0])
                    if size > COMBINE // 2:  # too many queries to hold: the window after the shuffle combines the rest
                        yield found[0]
                        found, size = [], 0
            key = tuple(keys[lo])
            held.append(pdf.iloc[lo:hi][["id", "vec", "query"]])
    if held:
        close()
    if found:
        yield _best(found, k)


def search(df: DataFrame, id_col: str, vec: str, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, id, score: the k nearest found for every row whose id satisfies is_query (a function of the id column)."""
    kind = "array<double>" if "double" in df.schema[vec].dataType.simpleString() else "array<float>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").cast(kind).alias("vec"))
    rows = rows.where(usable("vec") & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = stage(rows, "vectors")
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, n = (lengths[0]["d"], lengths[0]["n"]) if lengths else (1, 0)
    rows = rows.where(F.size("vec") == dim)
    parts = 1 << max(0, min(PARTITIONS_MAX, -(-n // ROWS_PER_PARTITION)).bit_length() - 1)
    size = min(SAMPLE_MAX, max(SAMPLE_MIN, 64 * parts))
    drawn = rows.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(size).collect() if parts > 1 else []
    router, probes = fit(np.array([r["vec"] for r in drawn]), parts, k) if drawn else (None, 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if router is None:
                yield pdf.assign(routed=[[0]] * len(pdf))
            elif len(pdf):
                z = router.scores(np.stack(pdf["vec"].to_numpy()))
                yield pdf.assign(routed=list(np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    routed = stage(rows.mapInPandas(route, f"id long, vec {kind}, routed array<int>"), "routed")
    indexed = routed.select("id", "vec", F.lit(False).alias("query"), F.get("routed", F.lit(0)).alias("part"))
    queries = routed.where(is_query(F.col("id"))).select("id", "vec", F.lit(True).alias("query"), F.explode("routed").alias("part"))
    # at most PARTITIONS_MAX rows each
    n_rows = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_queries = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [max(1, -(-n_rows.get(p, 0) // BLOCK)) for p in range(PARTITIONS_MAX)]
    chunks = [max(1, -(-n_queries.get(p, 0) // CHUNK)) for p in range(PARTITIONS_MAX)]

    def dealt(d: DataFrame, own: list[int], other: list[int], names: tuple[str, str]) -> DataFrame:
        at = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("part"))
        d = d.withColumn(names[0], F.pmod(F.xxhash64("id"), at(own)).cast("int"))
        return d.withColumn(names[1], F.explode(F.sequence(F.lit(0), at(other) - 1)))

    both = dealt(indexed, blocks, chunks, ("block", "chunk")).unionByName(dealt(queries, chunks, blocks, ("chunk", "block")))
    tasks = both.repartition("part", "block", "chunk").sortWithinPartitions("part", "block", "chunk")
    found = tasks.mapInPandas(lambda batches: _score_task(batches, k), "query_id long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_ann_partition(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    from .common import table

    found = search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op2_ann_partition": op2_ann_partition}
ORACLES: dict[str, str] = {}
