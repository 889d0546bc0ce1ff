"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines of random projections (a Gaussian kernel) beside the
statistics themselves. Each partition sums its part of the normal equations, for three folds apart; the sums meet
in a tree of fixed fan-in and the driver solves one bounded system. Scores of each fold under the solution of the other two are
averaged in bins, and pooling adjacent violators makes the calibration, joined by straight lines. All labelled
rows outside the held-out quarter are used; nothing is sampled.

Null text counts as empty and is scored like any other. Rows with a null id are scored and not held out. A label counts
once per row of the labels table that has one; null labels don't. Without any label of both kinds every score is the
mean label, or 0.5. Repeated rows are scored alike. Extra columns are ignored by score() and kept by keep_good(); an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_cache, stage, tree_fold

FEATURES, RIDGE, FOLDS, BINS, SEED, THRESHOLD, HELD_OUT = 256, 1e-3, 3, 400, 11, 0.7, 2
STATS = 26
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[list(range(97, 123))] = 1  # lower case
_CLASS[list(range(65, 91))] = 2  # upper case
_CLASS[list(range(48, 58))] = 3  # digits
_CLASS[[32, 9, 10, 11, 12, 13]] = 4  # white space
_CLASS[[46, 44, 59, 58, 39, 34, 40, 41, 45]] = 5  # . , ; : ' " ( ) -
_CLASS[[33, 63]] = 6  # ! ?
_CLASS[list(range(128, 256))] = 7


def statistics(text: str | None) -> np.ndarray:
    """STATS numbers about a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(raw)), max(1, len(words))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=count, minlength=8) / n
    p = count[count > 0] / n
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    freq = Counter(words)
    number = {w: k for k, w in enumerate(freq)}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    three = ids[:-2] * 1_000_003 + ids[1:-1] * 1009 + ids[2:] if len(ids) > 2 else np.zeros(0, dtype=np.int64)
    repeated = 1 - len(np.unique(three)) / len(three) if len(three) else 0.0
    odd = sum(c for w, c in freq.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:")
    caps = sum(c for w, c in freq.items() if w.isupper() and len(w) > 1)
    tops = freq.most_common(5)
    line_len = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) if lines else np.zeros(1, dtype=np.int64)
    same_lines = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return np.array(
        [
            np.log1p(len(words)), np.log1p(len(raw)), length.mean(), length.std(), np.log1p(length.max()), *kinds,
            -(p * np.log(p)).sum() if len(p) else 0.0, len(freq) / m, len(freq) / m**0.8, repeated, odd / m, caps / m,
            tops[0][1] / m if tops else 0.0, sum(c for _, c in tops) / m, (length <= 3).mean(), same_lines, np.log1p(line_len.mean()), len(lines) / m, raw.count(b"|") / m,
        ]
    )


def _phi(x: np.ndarray, model: dict) -> np.ndarray:
    """Fourier features, standardised statistics and a constant."""
    z = np.clip((x - model["mean"]) / model["std"], -4, 4)
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((STATS, FEATURES)) / np.sqrt(STATS), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(z @ w + b) * np.sqrt(2.0 / FEATURES), z, np.ones((len(z), 1))])


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to y under weights w."""
    means, weights, sizes = [], [], []
    for a, b in zip(y, w, strict=True):
        means.append(float(a)), weights.append(float(b)), sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / total]
            weights[-2:], sizes[-2:] = [total], [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    if model["beta"] is None:
        return np.full(len(x), model["prior"])
    return np.clip(np.interp(_phi(x, model) @ model["beta"], model["at"], model["level"]), 0.0, 1.0)


def with_statistics(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, x (STATS doubles) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64()))], names=["id", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, x array<double>")


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, STATS))


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """A model from stats (id, x) and labels (id, y); ids whose crc32 leaves HELD_OUT are not used."""
    moments = stats.agg(*[F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(STATS)], *[F.stddev_pop(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(STATS)]).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(STATS)])
    std = np.array([moments[f"s{k}"] or 0.0 for k in range(STATS)])
    model = {"mean": mean, "std": np.where(std > 1e-9, std, 1.0), "beta": None, "prior": 0.5}
    used = labels.where("y IS NOT NULL AND id IS NOT NULL").where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != HELD_OUT)
    train = stats.join(used.select(F.col("id").alias("lid"), "y"), F.col("id") == F.col("lid"))
    train = stage(train.select("x", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")), "train")
    size = FEATURES + STATS + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((FOLDS, size, size))
        for pdf in batches:
            phi = np.hstack([_phi(_matrix(pdf["x"]), model), pdf["y"].to_numpy()[:, None]])
            for f in range(FOLDS):
                part = phi[pdf["fold"].to_numpy() == f]
                a[f] += part.T @ part
        yield pd.DataFrame({"a": [np.stack([m[np.triu_indices(size)] for m in a]).tobytes()]})

    def add(rows: list[tuple[bytes]]) -> tuple[bytes]:
        return (sum(np.frombuffer(r[0]) for r in rows).tobytes(),)

    folds = np.zeros((FOLDS, size, size))
    for r in tree_fold(train.mapInPandas(sums, "a binary"), "a binary", add).collect():  # one row
        for f, part in enumerate(np.frombuffer(r["a"]).reshape(FOLDS, -1)):
            a = np.zeros((size, size))
            a[np.triu_indices(size)] = part
            folds[f] = a + np.triu(a, 1).T
    whole = folds.sum(axis=0)
    n, ones = whole[-2, -2], whole[-2, -1]
    if n == 0 or ones in (0, n):
        return model | {"prior": float(ones / n) if n else 0.5}

    def solve(a: np.ndarray) -> np.ndarray:
        penalty = np.full(size - 1, RIDGE * max(1.0, a[-2, -2]) + 1e-6)
        penalty[-1] = 1e-9
        return np.linalg.solve(a[:-1, :-1] + np.diag(penalty), a[:-1, -1])

    apart = [solve(whole - folds[f] if (whole - folds[f])[-2, -2] > 0 else whole) for f in range(FOLDS)]

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = (_phi(_matrix(pdf["x"]), model) * np.array(apart)[pdf["fold"].to_numpy()]).sum(axis=1)
            at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
            yield pd.DataFrame({"at": at, "y": pdf["y"].to_numpy(), "s": raw}).groupby("at").agg(n=("y", "size"), y=("y", "sum"), s=("s", "sum")).reset_index()

    hist = train.mapInPandas(bins, "at int, n long, y double, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("s").alias("s")).orderBy("at").collect()
    count, y, s = (np.array([float(r[c]) for r in hist]) for c in ("n", "y", "s"))  # BINS rows at most
    level, where = pool_adjacent(y / count, count), s / count
    blocks = np.unique(level)
    at = np.array([(s[level == v].sum() / count[level == v].sum()) for v in blocks])
    spread = max(1e-6, float(np.ptp(where)))
    at, blocks = np.r_[at[0] - spread, at, at[-1] + spread], np.r_[max(0.0, blocks[0] - 0.01), blocks, min(1.0, blocks[-1] + 0.01)]
    return model | {"beta": solve(whole), "at": at, "level": blocks}


def score(stats: DataFrame, model: dict) -> DataFrame:
    """id, score per row of stats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": predict(_matrix(pdf["x"]), model)})

    return stats.mapInPandas(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def keep_good(df: DataFrame, id_col: str, text: str, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores threshold or more under a model of labels (id, y), all columns as they are.

    Statistics are computed once and staged beside their rows; only they, not the texts, go to the scoring step.
    """

    @F.arrow_udf("array<double>")
    def stats_of(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, STATS)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATS, dtype=np.int32)), pa.array(x.ravel()))

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    both = stage(df.select(row.alias("_aw_row"), stats_of(F.col(f"`{text}`")).alias("_aw_x")), "statistics")
    model = fit(both.select(F.col(f"_aw_row.`{id_col}`").alias("id"), F.col("_aw_x").alias("x")), labels)

    @F.arrow_udf("double")
    def score_of(x: pa.Array) -> pa.Array:
        return pa.array(predict(x.flatten().to_numpy().reshape(-1, STATS), model))

    return both.where(score_of("_aw_x") >= threshold).select("_aw_row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from .common import table

    stats = stage(with_statistics(table(spark, sf_dir, "documents"), "doc_id", "text"), "statistics")
    model = fit(stats, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return score(stats, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
