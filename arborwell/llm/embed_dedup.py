"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions and quantised with width WIDTH; WIDTHS_PER_KEY such
numbers are one bucket key, TABLES keys are drawn per vector. Vectors that share a bucket (and a label) are compared by
exact cosine in double precision. At cosine 0.93 the chance that a pair shares no bucket is below 5e-4, at 0.95 below
1e-4, and it falls fast above.

Equal vectors are one class with a count, so copies are never expanded. Buckets are met twice. First only keys, numbers of
classes and SKETCH-bit signs of projections move: what has no other in its bucket within SKETCH_RADIUS bits drops out of it (a pair
at cosine 0.93 exceeds that radius with a chance below 1e-7, other pairs hardly ever keep it). Then the vectors of what is left move and are compared
exactly. A bucket larger than TILE is cut into tiles and its tile pairs are compared apart, all of them. A pair that met in an earlier
table is not counted again. A task returns one row per vector: links counted and the local root, never pairs.

Vectors that are null, zero, or hold a null or non-finite component, and rows without a label, link with nothing:
n_links 0, component_id their own id, kept. Vectors of different length never link. Labels may be of any type that has
equality. A null id is compared, but names no component unless there is no other id. Repeated rows are copies. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage
from .graph import connected_components, contract

THRESHOLD, WIDTH, WIDTHS_PER_KEY, TABLES, SEED = 0.93, 1.2, 4, 20, 5
SKETCH, SKETCH_RADIUS = 128, 36
#: Rows of a bucket that are compared in one piece; rows of a task's group, about.
TILE, GROUP = 2048, 8192
_TABLE_BITS = 31  # the table of a key is in its lowest bits


def usable(vec: str):
    """Condition: a vector with finite components, not all zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _mix(x: np.ndarray) -> np.ndarray:
    """An even hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(units: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """TABLES bucket keys per vector: quantised projections, hashed with the label's hash, the length and the table."""
    rng = np.random.default_rng([SEED, units.shape[1]])
    a = rng.standard_normal((units.shape[1], TABLES * WIDTHS_PER_KEY))
    shift = rng.uniform(0, WIDTH, TABLES * WIDTHS_PER_KEY)
    q = np.floor((units @ a + shift) / WIDTH).astype("<i2")
    bucket = np.ascontiguousarray(q).view("<u8").reshape(len(units), TABLES)
    place = _mix(labels.astype(np.int64).view(np.uint64) + np.uint64(units.shape[1]))
    key = _mix(bucket ^ place[:, None]) & ~np.uint64(_TABLE_BITS)
    return (key | np.arange(TABLES, dtype=np.uint64)).view(np.int64)


def _sketches(units: np.ndarray) -> np.ndarray:
    """SKETCH signs of projections per vector, as two longs."""
    a = np.random.default_rng([SEED, units.shape[1], 1]).standard_normal((units.shape[1], SKETCH))
    return np.packbits(units @ a >= 0, axis=1).view("<i8")


def _by_length(vec: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their unit vectors."""
    size = vec.value_lengths().to_numpy()
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, _unit(vec.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d))


def _large_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Keys that least rows or more of a partition have, with their number."""
    found = [_keys(u, b.column(1).to_numpy()[rows]).ravel() for b in batches for rows, u in _by_length(b.column(0))]
    key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    some = n >= least
    yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some])], names=["k", "size"])


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, f, g: a row for every table."""
    for b in batches:
        for rows, u in _by_length(b.column(0)):
            keys, sketch = _keys(u, b.column(1).to_numpy()[rows]), _sketches(u)
            at = np.repeat(np.arange(len(rows)), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(b.column(2).to_numpy()[rows][at]), pa.array(sketch[at, 0]), pa.array(sketch[at, 1])], names=["key", "node", "f", "g"])


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The two sides of each bucket's tile pair, and whether they are the same tile."""
    key, a, b, tile = (pdf[c].to_numpy() for c in ("key", "a", "b", "tile"))
    order = np.lexsort((b, a, key))
    runs = np.stack([key[order], a[order], b[order]], axis=1)
    cuts = np.flatnonzero(np.r_[True, (runs[1:] != runs[:-1]).any(axis=1), True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo > 1:
            rows = order[lo:hi]
            one = a[rows[0]] == b[rows[0]]
            yield (rows, rows, True) if one else (rows[tile[rows] == a[rows[0]]], rows[tile[rows] == b[rows[0]]], False)


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """node, mask: the tables (bits) in which a class has another within the sketches' radius."""
    f, g = pdf["f"].to_numpy().view(np.uint64), pdf["g"].to_numpy().view(np.uint64)
    good = np.zeros(len(pdf), dtype=bool)
    for left, right, one in _runs(pdf):
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            d = np.bitwise_count(f[i][:, None] ^ f[right][None, :]) + np.bitwise_count(g[i][:, None] ^ g[right][None, :])
            hit = d <= SKETCH_RADIUS
            if one:
                hit[np.arange(len(i)), np.arange(at, at + len(i))] = False
            good[i[hit.any(axis=1)]] = True
            good[right[hit.any(axis=0)]] = True
    found = pdf[good]
    return pd.DataFrame({"node": found["node"], "mask": np.left_shift(np.int64(1), found["key"].to_numpy() & _TABLE_BITS)})


def _second_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, n, label, vec: a row for every table of mask."""
    for b in batches:
        vec, label, node, n, mask = b.columns
        for rows, u in _by_length(vec):
            keys = _keys(u, label.to_numpy()[rows])
            i, t = np.nonzero(mask.to_numpy()[rows][:, None] >> np.arange(TABLES) & 1)
            for lo in range(0, len(i), 10_000):
                at = pa.array(rows[i[lo : lo + 10_000]])
                yield pa.RecordBatch.from_arrays([pa.array(keys[i, t][lo : lo + 10_000]), node.take(at), n.take(at), label.take(at), vec.take(at)], names=["key", "node", "n", "label", "vec"])


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links found in the buckets of one group, counted for each node once per pair."""
    nodes, first, where = np.unique(pdf["node"].to_numpy(), return_index=True, return_inverse=True)
    count, vec, label = pdf["n"].to_numpy(), pdf["vec"].to_numpy(), pdf["label"].to_numpy()
    size = np.array([len(vec[k]) for k in first])
    units: list = [None] * len(nodes)
    keys = np.zeros((len(nodes), TABLES), dtype=np.int64)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        u = _unit(np.stack(vec[first[own]]))
        keys[own] = _keys(u, label[first[own]])
        for k, x in zip(own, u, strict=True):
            units[k] = x
    table = pdf["key"].to_numpy() & _TABLE_BITS
    links, parent = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    for left, right, one in _runs(pdf):
        if not len(left) or not len(right):
            continue
        u, t = np.stack([units[k] for k in where[right]]), table[left[0]]
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            i, j = np.nonzero(np.stack([units[k] for k in where[part]]) @ u.T >= THRESHOLD)
            i, j = part[i], right[j]
            ok = i < j if one else np.ones(len(i), dtype=bool)  # each pair once; both directions are counted below
            i, j = i[ok], j[ok]
            parent = contract(parent, where[i], where[j])
            new = ~(keys[where[i], :t] == keys[where[j], :t]).any(axis=1)
            np.add.at(links, where[i[new]], count[j[new]])
            np.add.at(links, where[j[new]], count[i[new]])
    some = np.flatnonzero((links > 0) | (parent != np.arange(len(nodes))))
    return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[parent[some]]})


def _dealt(rows: DataFrame, large: DataFrame, total: int) -> DataFrame:
    """rows (key, node) with the tiles they take part in and a group: large buckets are cut into tiles of about TILE rows."""
    rows = rows.join(large, F.col("key") == F.col("k"), "left").drop("k")
    tiles = F.coalesce(F.floor(F.col("size") / TILE) + 1, F.lit(1)).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("size")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"a": F.least("tile", "o"), "b": F.greatest("tile", "o")}).drop("o", "tiles")
    return rows.withColumn("grp", F.pmod(F.xxhash64("key", "a", "b"), F.lit(max(1, total // GROUP))))


def link_vectors(classes: DataFrame) -> DataFrame:
    """node, links, root from staged classes (node, label: a long, vec, n): partial counts and a forest of the links."""
    base = classes.select("vec", "label", "node")
    total = classes.count() * TABLES
    # a bucket of more than TILE rows has TILE / partitions in some partition, so no large one is overlooked; sizes are short by TILE at most
    least = max(2, TILE // max(1, base.rdd.getNumPartitions()))
    large = base.mapInArrow(lambda it: _large_keys(it, least), "k long, size long").groupBy("k").agg(F.sum("size").alias("size"))
    large = small(stage(large.where(F.col("size") > TILE // 2), "large"))
    first = _dealt(base.mapInArrow(_first_rows, "key long, node long, f long, g long"), large, total)
    masks = first.groupBy("grp").applyInPandas(_candidates, "node long, mask long").groupBy(F.col("node").alias("mn")).agg(F.bit_or("mask").alias("mask"))
    masks = stage(masks, "masks")
    left = masks.agg(F.sum(F.bit_count("mask"))).first()[0] or 0
    both = classes.join(small(masks), F.col("node") == F.col("mn")).select("vec", "label", "node", "n", "mask")
    vec = classes.schema["vec"].dataType.simpleString()
    second = _dealt(both.mapInArrow(_second_rows, f"key long, node long, n long, label long, vec {vec}"), large, left)
    return second.groupBy("grp").applyInPandas(_compare, "node long, links long, root long")


def dedup_vectors(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """id, n_links, component per row of df."""
    kind = df.schema[vec].dataType.simpleString()
    v = F.col(f"`{vec}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vec}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").alias("lab"), v.alias("vec"))
    good = usable("vec") & F.col("lab").isNotNull()
    # a class is named by two hashes of label and vector
    names = [F.when(good, F.xxhash64(F.lit(salt), "lab", "vec")).alias(c) for salt, c in ((1, "c"), (2, "d"))]
    rows = rows.withColumns({"c": names[0], "d": names[1]})
    groups = rows.where("c IS NOT NULL").groupBy("c", "d").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.any_value("vec").alias("vec"), F.xxhash64(F.any_value("lab")).alias("label"))
    classes = stage(groups.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once: its numbers stay
    links = stage(link_vectors(classes), "links")
    parts = connected_components(links.where("node <> root"), "node", "root")
    total = links.groupBy(F.col("node").alias("ln")).agg(F.sum("links").alias("links"))
    found = classes.select("c", "d", "n", "first", "node").join(parts.withColumnRenamed("node", "pn"), F.col("node") == F.col("pn"), "left").join(total, F.col("node") == F.col("ln"), "left")
    found = found.select("c", "d", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    found = stage(found, "found")
    firsts = found.groupBy(F.col("part").alias("fp")).agg(F.min("first").alias("component"))
    found = found.join(firsts, F.col("part") == F.col("fp")).select(F.col("c").alias("fc"), F.col("d").alias("fd"), "n_links", "component")
    linked = rows.where("c IS NOT NULL").select("id", "c", "d").join(found, (F.col("c") == F.col("fc")) & (F.col("d") == F.col("fd"))).select("id", "n_links", "component")
    alone = rows.where("c IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def op5_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from .common import table

    d = dedup_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return d.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {THRESHOLD}),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.c, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN c ON v.vec_id = c.a"""

QUERIES = {"op5_embed_dedup": op5_embed_dedup}
ORACLES = {"op5_embed_dedup": _SQL}
