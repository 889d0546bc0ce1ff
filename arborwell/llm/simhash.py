"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Two kinds of fingerprints, both majority bits of hashes of word shingles, computed in Arrow batches from whole texts:

- near_duplicates(): 64 bits of XXH64, linked at RADIUS or fewer differing bits. A fingerprint lies in the cell (bits in its
  upper half, bits in its lower half); two within the radius lie in cells whose counts differ by no more than the radius
  in total, so each cell meets its near cells only. A cell of more than TILE fingerprints is cut further, by the counts
  of its quarters, so tile pairs that cannot hold a link are left out before anything is shuffled.
- similar_documents(): 128 bits of XXH3 over SIMILAR_WORDS-word shingles, linked where the differing bits say a cosine of at least
  SIMILARITY and the numbers of shingles differ by no more than that factor, which a similarity of that much implies. Cells
  are ranges of that number, and a cell meets itself and the next one.

Distinct fingerprints only are compared; documents that share one are one class. The rows of a cell are cut into home tiles of
about TILE or WIDE_TILE and its visitors into chunks of four times as many, whatever the size of the table, so a task's rows don't
grow with it; a row's copies do, once its cell holds several tiles. A tile pair returns a spanning forest of its links, never its pairs.

The number of comparisons grows with the square of the number of distinct fingerprints: about a fortieth of all pairs remains
for near_duplicates(), about a tenth for similar_documents(). A compared pair costs 32 / TILE bytes of shuffle or less.

Null text counts as empty: fingerprint zero, linked like any other. A null id is compared too, but is no
component's smallest id unless there is no other: then component is null. Repeated rows are one class. An id on several
texts does not link them. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_worker_cache, stage, unstage
from .graph import connected_components, contract

SHINGLE, SEED, RADIUS = 3, 42, 3
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Home rows of a tile, about; visitors of a tile are four times as many. Wide tiles are larger, as their cells are few: fewer copies of a row.
TILE, WIDE_TILE = 4096, 32_768


def _shingles(text: str | None, size: int) -> list[bytes]:
    """All shingles of a whole text, in order; fewer words: the whole sequence; none: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change; only 0x20, 0x09-0x0D split
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False)))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows of hashes (rows of bytes), as bytes."""
    ones = np.zeros(8 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in _shingles(text, shingle)], dtype="<u8")
    return int(_majority(hashes.view(np.uint8).reshape(-1, 8)).view("<u8")[0]) if len(hashes) else 0


def wide_fingerprint(text: str | None, shingle: int = SIMILAR_WORDS) -> tuple[bytes, int]:
    """128-bit fingerprint of a whole text, and its number of shingles."""
    found = _shingles(text, shingle)
    raw = b"".join(map(xxhash.xxh3_128_digest, found))
    return (_majority(np.frombuffer(raw, np.uint8).reshape(-1, 16)).tobytes() if found else bytes(16)), len(found)


def fingerprints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, fp long")


def wide_fingerprints(df: DataFrame, id_col: str, text: str, shingle: int = SIMILAR_WORDS) -> DataFrame:
    """id, fp (struct of the 128 bits as two longs, and the number of shingles) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for b in batches:
            got = [wide_fingerprint(t.as_py(), shingle) for t in b.column(1)]
            bits = np.frombuffer(b"".join(g[0] for g in got), dtype="<i8").reshape(-1, 2)
            fp = pa.StructArray.from_arrays([pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([g[1] for g in got], pa.int64())], names=["f", "g", "size"])
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, fp struct<f:long,g:long,size:long>")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Bits in each quarter, the uppermost first."""
    u = fp.view(np.uint64)
    return np.stack([np.bitwise_count((u >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.int64) for k in (48, 32, 16, 0)], axis=1)


def _spread(fp: np.ndarray) -> np.ndarray:
    """An even hash of fingerprints, apart from their bit counts."""
    with np.errstate(over="ignore"):
        x = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def _forest(nodes: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[parent[linked]]})


def _links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning forest (a, b) of the links between the home rows and the visitors of one tile pair."""
    nodes, where = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    fp, home = pdf["node"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
    parent = np.arange(len(nodes))
    quarters = _quarters(fp).astype(np.int16)
    hs, vs = np.flatnonzero(home), np.flatnonzero(~home)
    keys, group = np.unique(quarters[hs], axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    cuts = np.searchsorted(group.ravel()[order], np.arange(len(keys) + 1))
    for k, key in enumerate(keys):
        rows = hs[order[cuts[k] : cuts[k + 1]]]
        near = vs[np.abs(quarters[vs] - key).sum(axis=1) <= radius]
        step = max(1, 1_000_000 // max(1, len(rows)))
        for at in range(0, len(near), step):
            part = near[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[part][None, :]) <= radius)
            parent = contract(parent, where[rows[i]], where[part[j]])
    return _forest(nodes, parent)


def _copies(cell: np.ndarray, fp: np.ndarray, at_home: bool, homes: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fp, home tile and chunk of each copy: a home row is copied to all chunks of its cell, a visitor to all home tiles."""
    spread, nh, nc = _spread(fp), homes[cell], chunks[cell]
    n = nc if at_home else nh
    r = np.repeat(np.arange(len(fp)), n)
    k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    return (r, spread[r] % nh[r], k) if at_home else (r, k, (spread[r] // 8191) % nc[r])


_SIDE = np.array([17**3, 17**2, 17, 1])
_SMALL = 33 * 33  # cells by halves come first, cells by quarters after them


def _near(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of quarter counts within the radius, one of each pair of opposite ones."""
    some = product(range(-radius, radius + 1), repeat=4)
    return [d for d in some if sum(map(abs, d)) <= radius and (d[0] + d[1], d[2] + d[3], d[0], d[2]) >= (0, 0, 0, 0)]


def link_fingerprints(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the fingerprints (column fp, distinct) that connect whatever is linked."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int").alias(f"q{k}") for k in (48, 32, 16, 0)]
    fine = np.zeros((17, 17, 17, 17), dtype=np.int64)
    for r in reps.groupBy(*quarter).agg(F.count(F.lit(1)).alias("n")).collect():  # 17 to the fourth rows at most
        fine[r["q48"], r["q32"], r["q16"], r["q0"]] = r["n"]
    upper = np.add.outer(np.arange(17), np.arange(17))
    coarse = np.zeros((33, 33), dtype=np.int64)
    np.add.at(coarse, (upper[:, :, None, None], upper[None, None, :, :]), fine)
    whole = coarse <= TILE  # other cells are cut by quarters
    near = _near(radius)
    halves = sorted({(d[0] + d[1], d[2] + d[3]) for d in near})

    def visitors(counts: np.ndarray, offsets: list[tuple]) -> np.ndarray:
        pad = np.pad(counts, radius)
        return sum(pad[tuple(slice(radius + o, radius + o + n) for o, n in zip(d, counts.shape, strict=True))] for d in offsets)

    sizes = np.concatenate([coarse.ravel(), fine.ravel()])
    homes = np.maximum(1, -(-sizes // TILE))
    chunks = np.maximum(1, -(-np.concatenate([visitors(coarse, halves).ravel(), visitors(fine, near).ravel()]) // (4 * TILE)))
    filled = sizes > 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies of each row for the tile pairs it takes part in."""
        for b in batches:
            fp = b.column(0).to_numpy()
            q = _quarters(fp)
            h = np.stack([q[:, 0] + q[:, 1], q[:, 2] + q[:, 3]], axis=1)
            own = whole[h[:, 0], h[:, 1]]
            cell = np.where(own, h[:, 0] * 33 + h[:, 1], _SMALL + q @ _SIDE)
            moves = [(True, np.arange(len(fp)), cell)]
            for d in halves:
                to = h - d
                ok = ((to >= 0) & (to <= 32)).all(axis=1)
                ok[ok] &= whole[to[ok, 0], to[ok, 1]]
                moves.append((False, np.flatnonzero(ok), to[ok, 0] * 33 + to[ok, 1]))
            for d in [] if whole.all() else near:
                to = q - d
                ok = ((to >= 0) & (to <= 16)).all(axis=1)
                ok[ok] &= ~whole[to[ok, 0] + to[ok, 1], to[ok, 2] + to[ok, 3]]
                moves.append((False, np.flatnonzero(ok), _SMALL + to[ok] @ _SIDE))
            for at_home, rows, cell in moves:
                some = filled[cell]
                rows, cell = rows[some], cell[some]
                r, i, j = _copies(cell, fp[rows], at_home, homes, chunks)
                for lo in range(0, len(r), 100_000):
                    s = r[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s]), pa.array(i[lo : lo + 100_000]), pa.array(j[lo : lo + 100_000]), pa.array(fp[rows][s]), pa.array(np.full(len(s), at_home))], names=["cell", "i", "j", "node", "home"])

    dealt = reps.select("fp").mapInArrow(deal, "cell long, i long, j long, node long, home boolean")
    return dealt.groupBy("cell", "i", "j").applyInPandas(lambda pdf: _links(pdf, radius), "a long, b long")


def _wide_links(pdf: pd.DataFrame, radius: int, ratio: float) -> pd.DataFrame:
    nodes, where = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    f, g, size, home = pdf["f"].to_numpy().view(np.uint64), pdf["g"].to_numpy().view(np.uint64), pdf["size"].to_numpy(), pdf["home"].to_numpy()
    parent = np.arange(len(nodes))
    hs, vs = np.flatnonzero(home), np.flatnonzero(~home)
    hs, vs = hs[np.argsort(size[hs], kind="stable")], vs[np.argsort(size[vs], kind="stable")]
    for lo in range(0, len(hs), 128):  # by size: a slice of home rows meets a narrow range of visitors
        part = hs[lo : lo + 128]
        a, z = np.searchsorted(size[vs], [math.floor(size[part].min() * ratio), math.ceil(size[part].max() / ratio) + 1])
        for at in range(a, z, 4096):
            v = vs[at : min(at + 4096, z)]
            d = np.bitwise_count(f[part][:, None] ^ f[v][None, :])
            d += np.bitwise_count(g[part][:, None] ^ g[v][None, :])
            i, j = np.nonzero(d <= radius)
            i, j = part[i], v[j]
            ok = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
            parent = contract(parent, where[i[ok]], where[j[ok]])
    return _forest(nodes, parent)


def link_wide(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between nodes of reps (node, fp as wide_fingerprints(); distinct) that connect whatever is linked."""
    radius = math.floor(128 * math.acos(similarity) / math.pi)
    cell = F.when(F.col("fp.size") > 0, F.floor(F.log("fp.size") / -math.log(similarity))).otherwise(-1).cast("long")
    reps = reps.select("node", "fp.f", "fp.g", "fp.size", (cell + 1).alias("cell"))
    rows = reps.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred rows at most
    sizes = np.zeros(2 + max((r["cell"] for r in rows), default=0), dtype=np.int64)
    for r in rows:
        sizes[r["cell"]] = r["n"]
    homes = np.maximum(1, -(-sizes // WIDE_TILE))
    chunks = np.maximum(1, -(-(sizes + np.append(sizes[1:], 0)) // (4 * WIDE_TILE)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, f, g, size, cell = (c.to_numpy() for c in b.columns)
            for at_home, step in ((True, 0), (False, 0), (False, 1)):
                ok = np.flatnonzero((cell >= step) & (sizes[np.maximum(cell - step, 0)] > 0))
                to = cell[ok] - step
                r, i, j = _copies(to, f[ok], at_home, homes, chunks)
                for lo in range(0, len(r), 100_000):
                    s = slice(lo, lo + 100_000)
                    k = ok[r[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (to[r[s]], i[s], j[s], node[k], f[k], g[k], size[k], np.full(len(k), at_home))], names=["cell", "i", "j", "node", "f", "g", "size", "home"])

    dealt = reps.mapInArrow(deal, "cell long, i long, j long, node long, f long, g long, size long, home boolean")
    return dealt.groupBy("cell", "i", "j").applyInPandas(lambda pdf: _wide_links(pdf, radius, similarity), "a long, b long")


def _components(prints: DataFrame, wide: bool) -> DataFrame:
    """Of prints (id, fp): rfp (each fingerprint), part (a component's number), component: its smallest id."""
    # a wide fingerprint is named by a hash of it; two with one name would count as linked, at a chance of pairs / 2^64
    node = F.xxhash64("fp") if wide else F.col("fp")
    reps = stage(prints.groupBy("fp").agg(F.min("id").alias("first")).select("fp", "first", node.alias("node")), "reps")
    edges = stage(link_wide(reps) if wide else link_fingerprints(reps), "links")
    parts = connected_components(edges, "a", "b")
    unstage(edges)
    where = reps.join(parts.withColumnRenamed("node", "pn"), F.col("node") == F.col("pn"), "left")
    where = where.select(F.col("fp").alias("rfp"), "first", F.coalesce("component", "node").alias("part"))
    firsts = where.groupBy(F.col("part").alias("fpart")).agg(F.min("first").alias("component"))
    return stage(where.join(firsts, F.col("part") == F.col("fpart")).select("rfp", "part", "component"), "components")


def _same(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def near_duplicates(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, fp, component (smallest id reachable by links) per row of df; fingerprints of 64 bits."""
    prints = stage(fingerprints(df, id_col, text), "fingerprints")
    return prints.join(_components(prints, False), _same("fp", "rfp")).select("id", "fp", "component")


def similar_documents(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, component (smallest id reachable by links) per row of df; shingles of SIMILAR_WORDS words, a similarity of SIMILARITY."""
    prints = stage(wide_fingerprints(df, id_col, text), "fingerprints")
    return prints.join(_components(prints, True), _same("fp", "rfp")).select("id", "component")


def keep_one(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """df with one row of each component of similar_documents(): its smallest id (null last), then the smallest MD5 of the text. Columns stay.

    Null texts count as empty and are one component; of rows that repeat whole, one stays; an empty table stays empty.
    """
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    ids = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"), F.struct(F.col(f"`{id_col}`").alias("i"), digest.alias("d")).alias("key"))
    prints = stage(wide_fingerprints(ids, "key", "t"), "fingerprints")
    where = _components(prints.select(F.col("id.i").alias("id"), "fp"), True)
    best = F.min(F.struct(F.col("id.i").isNull().alias("last"), "id.i", "id.d"))
    firsts = prints.join(where, _same("fp", "rfp")).groupBy("part").agg(best.alias("k"))
    firsts = stage(firsts.select(F.col("k.i").alias("_aw_i"), F.col("k.d").alias("_aw_d")), "kept")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_aw_row"), F.col(f"`{id_col}`").alias("_aw_id"), digest.alias("_aw_digest"))
    kept = rows.join(firsts, F.col("_aw_id").eqNullSafe(F.col("_aw_i")) & (F.col("_aw_digest") == F.col("_aw_d")), "left_semi")
    again = prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:  # whole rows that repeat: one of each
        kept = kept.withColumn("_aw_n", F.row_number().over(Window.partitionBy("_aw_id", "_aw_digest").orderBy(F.xxhash64("_aw_row")))).where("_aw_n = 1")
    return kept.select("_aw_row.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .common import table

    d = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
