"""Language-model scores: masked pseudo-likelihood from a bidirectional window network in numpy.

Words of whole texts (lower-cased A-Z) become ids: the most frequent words of the corpus, counted over all documents, then
BUCKETS ids for the rest by hash. The network sees the WINDOW words on either side of a position, never the word
itself, and predicts it through a class of ids and a member of the class. A word of a bucket is then given by its share of
the bucket in the counts over all documents; these counts are a staged table, one row per distinct word, which grows with the
corpus and is never collected. A bucket keeps the share of one occurrence for words that were not counted. So
every word has a probability of its own. A document's score is the sum of its words' conditional log-probabilities, and
the mean.

Texts are read once: segments() numbers the words of some documents by a list of distinct words of their own, so counting,
training and scoring go on from small numbers, and the corpus' counts meet a segment's distinct words, not its text.

Training: every document is trained on once (TRAIN_EVERY = 1): in the first round an EARLY-th of each segment's documents, in the second
the others, from the first round's weights. In a round every partition trains a copy from the shared weights, in steps that grow with
the words it has seen, and copies are averaged by the words they saw, in a tree of fixed fan-in. Only the averaged
weights, the ids of the network's words and the sums of the buckets (all of fixed sizes) reach the driver.

Null text counts as empty: 0 words, log-probability 0, mean null. Null ids pass through, repeated rows score alike, extra columns
are ignored; an empty table gives no rows. A text is never cut; one longer than a segment is a segment of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_cache, stage, table, tree_fold

CLASSES, MEMBERS, BUCKETS, WINDOW, DIM, HIDDEN = 32, 32, 64, 2, 16, 32
TRAIN_EVERY, EPOCHS, EARLY, RATE, SEED = 1, 1, 8, 0.05, 17
#: Positions of a training step: the words seen so far divided by GROW, within these bounds.
STEP_MIN, STEP_MAX, GROW = 128, 16384, 32
#: A segment ends at so many words or distinct words; scores are computed for so many positions at once.
SEGMENT_WORDS, SEGMENT_DISTINCT, SLICE = 1_500_000, 200_000, 16_384
IDS = CLASSES * MEMBERS
EDGE = IDS  # stands beyond either end of a text
#: Positions whose arrays fit a core's cache.
BLOCK = 1024
_ONES, _TRUE = np.ones(max(BLOCK, CLASSES, MEMBERS), np.float32), np.ones(1, dtype=bool)
_BESIDE = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def segments(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """words, counts: the distinct words of some rows; ids, sizes: these rows; code: their words as places in words (zstd, int32). Not staged."""
    kind = df.schema[id_col].dataType.simpleString()
    id_type = df.select(F.col(f"`{id_col}`")).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        drop_worker_cache()
        arrow_id = to_arrow_type(id_type)
        place, ids, sizes, codes, total = defaultdict(count().__next__), [], [], [], 0

        def close() -> pa.RecordBatch:
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            number = np.bincount(code, minlength=len(place))
            one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, t))
            cols = [one(list(place), pa.binary()), one(number, pa.int64()), one(ids, arrow_id), one(sizes, pa.int64()), pa.array([total], pa.int64()), pa.array([_packed(code)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["words", "counts", "ids", "sizes", "total", "code"])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(t.as_py())
                if ids and (total + len(words) > SEGMENT_WORDS or len(place) > SEGMENT_DISTINCT):
                    yield close()
                    place, ids, sizes, codes, total = defaultdict(count().__next__), [], [], [], 0
                codes.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(key), sizes.append(len(words))
                total += len(words)
        if ids:
            yield close()

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, f"words array<binary>, counts array<long>, ids array<{kind}>, sizes array<long>, total long, code binary")


def _numbered(seg: DataFrame) -> DataFrame:
    return stage(seg.withColumn("seg", F.monotonically_increasing_id()), "segments")  # written once: its numbers stay


def _unpacked(cell: pa.Scalar, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(cell.as_py(), decompressed_size=n * size, codec="zstd", asbytes=True) if n else b"", kind)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _decode(batch: pa.RecordBatch, vocab: dict[bytes, int]) -> Iterator[dict]:
    """Each segment of a batch in numpy: code, sizes, net (the network's id of each distinct word) and, where it has been looked up, n (its count)."""
    for k in range(batch.num_rows):
        cell = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
        out = {"code": _unpacked(cell["code"], np.int32, cell["total"].as_py()), "sizes": np.asarray(cell["sizes"].values, dtype=np.int64), "ids": cell["ids"].values}
        if "words" in cell:
            yield out | {"net": _ids(cell["words"].values.to_pylist(), vocab)}
        else:
            m = cell["distinct"].as_py() or 0
            yield out | {"net": _unpacked(cell["net"], np.int64, m), "n": _unpacked(cell["n"], np.int64, m)}


def counts_of(seg: DataFrame) -> DataFrame:
    """w, n of every distinct word of segments."""
    return seg.select(F.explode(F.arrays_zip("words", "counts")).alias("c")).groupBy(F.col("c.words").alias("w")).agg(F.sum("c.counts").alias("n"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """w, n of every distinct word, counted over all rows; not staged."""
    return counts_of(segments(df.select(F.col(f"`{text}`").alias("t"), F.lit(0).alias("id")), "id", "t"))


def vocabulary(df: DataFrame, text: str) -> dict[bytes, int]:
    """Ids of the network's own words, counted over all rows."""
    return head(word_counts(df, text))


def head(counts: DataFrame) -> dict[bytes, int]:
    """Ids of the IDS - BUCKETS most frequent words of counts, most frequent first (ties by bytes)."""
    return {bytes(r["w"]): k for k, r in enumerate(counts.orderBy(F.desc("n"), "w").limit(IDS - BUCKETS).collect())}


def _own_words(counts: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """w of the network's words: IDS rows at most."""
    return F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in vocab], "w binary"))


def bucket_sums(counts: DataFrame, vocab: dict[bytes, int]) -> np.ndarray:
    """Occurrences of all words of each bucket."""
    rest = counts.join(_own_words(counts, vocab), "w", "left_anti").groupBy((F.crc32("w") % BUCKETS).alias("b")).agg(F.sum("n").alias("n"))
    sums = np.zeros(BUCKETS, dtype=np.int64)
    for r in rest.collect():  # BUCKETS rows at most
        sums[r["b"]] = r["n"]
    return sums


def _ids(words: list[bytes], vocab: dict[bytes, int]) -> np.ndarray:
    get = vocab.get
    return np.fromiter((i if (i := get(w)) is not None else IDS - BUCKETS + zlib.crc32(w) % BUCKETS for w in words), dtype=np.int64, count=len(words))


def initial() -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    return [normal(IDS + 1, DIM), normal(2 * WINDOW * DIM, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32), normal(CLASSES, HIDDEN, MEMBERS), np.zeros((CLASSES, MEMBERS), np.float32)]


def _steep(w: list[np.ndarray]) -> bool:
    """Whether some output may be so large that its exponential needs care; hidden values lie in [-1, 1]."""
    return max(float((np.abs(w[3]).sum(axis=0) + np.abs(w[4])).max()), float((np.abs(w[5]).sum(axis=1) + np.abs(w[6])).max())) > 60


def _hidden(w: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = w[0].take(ctx.ravel(), axis=0).reshape(len(ctx), -1)
    h = x @ w[1]
    h += w[2]
    return x, np.tanh(h, out=h)


def _outputs(w: list[np.ndarray], h: np.ndarray, cls: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Outputs for classes and for the members of cls (ascending), and the runs (class, from, to) of cls."""
    z, y = h @ w[3], w[6].take(cls, axis=0)
    z += w[4]
    first, last = int(cls[0]), int(cls[-1])
    cuts = np.searchsorted(cls, np.arange(first, last + 2)).tolist()
    runs = [(first + k, lo, hi) for k, (lo, hi) in enumerate(pairwise(cuts)) if lo < hi]
    for c, lo, hi in runs:
        y[lo:hi] += h[lo:hi] @ w[5][c]
    if steep:
        z -= z.max(axis=1, keepdims=True)
        y -= y.max(axis=1, keepdims=True)
    return z, y, runs


def _sorted_by_class(targets: np.ndarray) -> np.ndarray:
    return np.argsort((targets // MEMBERS).astype(np.uint8), kind="stable")


def log_probabilities(w: list[np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | both sides) for each position."""
    order, steep, out = _sorted_by_class(target), _steep(w), np.empty(len(target))
    for lo in range(0, len(order), BLOCK):
        at = order[lo : lo + BLOCK]
        cls, mem = np.divmod(target.take(at), MEMBERS)
        rows = np.arange(len(at))
        z, y, _ = _outputs(w, _hidden(w, ctx.take(at, axis=0))[1], cls, steep)
        got = z[rows, cls] + y[rows, mem]
        for part in (z, y):
            np.exp(part, out=part)
            got -= np.log(part @ _ONES[: part.shape[1]])
        out[at] = got
    return out


def train(w: list[np.ndarray], stream: np.ndarray, at: np.ndarray, memory: list[np.ndarray]) -> None:
    """One step of Adagrad in place, on the positions at of stream. Gradients are summed over blocks of few classes that fit a core's cache."""
    at = at.take(_sorted_by_class(stream.take(at)))
    g, steep = [np.zeros_like(p) for p in w], _steep(w)
    for lo in range(0, len(at), BLOCK):
        _add_gradient(w, stream, at[lo : lo + BLOCK], g, steep)
    scale = np.float32(1 / len(at))
    for p, d, m in zip(w, g, memory, strict=True):
        d *= scale
        m += d * d
        p -= RATE * d / (np.sqrt(m) + 1e-6)


def _add_gradient(w: list[np.ndarray], stream: np.ndarray, at: np.ndarray, g: list[np.ndarray], steep: bool) -> None:
    cls, mem = np.divmod(stream.take(at), MEMBERS)
    near = stream.take((at[:, None] + _BESIDE).ravel())
    rows, ones = np.arange(len(at)), _ONES[: len(at)]
    x, h = _hidden(w, near.reshape(len(at), -1))
    dz, dm, runs = _outputs(w, h, cls, steep)
    for p, k in ((dz, cls), (dm, mem)):
        np.exp(p, out=p)
        p /= (p @ _ONES[: p.shape[1]])[:, None]
        p[rows, k] -= 1
    dh = dz @ w[3].T
    g[3] += h.T @ dz
    g[4] += ones @ dz
    for c, lo, hi in runs:
        d = dm[lo:hi]
        g[5][c] += h[lo:hi].T @ d
        g[6][c] += ones[lo:hi] @ d
        dh[lo:hi] += d @ w[5][c].T
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    g[1] += x.T @ dh
    g[2] += ones @ dh
    order = np.argsort(near, kind="stable")
    near = near.take(order)
    first = np.flatnonzero(np.concatenate([_TRUE, near[1:] != near[:-1]]))
    g[0][near.take(first)] += np.add.reduceat((dh @ w[1].T).reshape(-1, DIM).take(order, axis=0), first, axis=0)


def _stream(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts with edges between, the places of words, and each word's text."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) + WINDOW * (own + 1)
    stream = np.full(len(ids) + WINDOW * (len(sizes) + 1), EDGE, dtype=np.uint16)
    stream[at] = ids
    return stream, at, own


def _average(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    n = sum(k for k, _ in rows)
    mean = sum(np.frombuffer(b, dtype="<f4").astype(np.float64) * (k / n) for k, b in rows)
    return n, mean.astype("<f4").tobytes()


def fit_segments(seg: DataFrame, vocab: dict[bytes, int], epochs: int = EPOCHS) -> list[np.ndarray]:
    weights = initial()
    work = seg.select("words", "ids", "sizes", "total", "code")
    for early in [True, False] * epochs:
        shared = weights

        def local(batches: Iterator[pa.RecordBatch], shared=shared, early=early) -> Iterator[pa.RecordBatch]:
            w, seen = [p.copy() for p in shared], 0
            memory = [np.full_like(p, 1e-3) for p in w]
            for b in batches:
                for s in _decode(b, vocab):
                    stream, at, own = _stream(s["net"].take(s["code"]), s["sizes"])
                    at = at[(own % EARLY == 0) == early]
                    np.random.default_rng(SEED).shuffle(at)
                    lo = 0
                    while lo < len(at):
                        hi = lo + min(max(seen // GROW, STEP_MIN), STEP_MAX)
                        train(w, stream, at[lo:hi], memory)
                        seen += len(at[lo:hi])
                        lo = hi
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([np.concatenate([p.ravel() for p in w]).astype("<f4").tobytes()], pa.binary())], names=["n", "w"])

        got = tree_fold(work.mapInArrow(local, "n long, w binary"), "n long, w binary", _average).collect()  # one row
        if got:
            flat, weights, lo = np.frombuffer(got[0]["w"], dtype="<f4"), [], 0
            for p in shared:
                weights.append(flat[lo : lo + p.size].reshape(p.shape).copy())
                lo += p.size
    return weights


def fit(df: DataFrame, text: str, vocab: dict[bytes, int], every: int = TRAIN_EVERY, rounds: int = EPOCHS) -> list[np.ndarray]:
    """Weights after so many passes over the texts of df whose hash divides by every (1: all)."""
    docs = df.select(F.col(f"`{text}`").alias("t"), F.lit(0).alias("id")).where("t IS NOT NULL")
    if every > 1:
        docs = docs.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    return fit_segments(_numbered(segments(docs, "id", "t")), vocab, rounds)


def _score(seg: DataFrame, id_kind: str, vocab: dict[bytes, int], weights: list[np.ndarray], base: np.ndarray | None) -> DataFrame:
    """id, n_words, log_prob, score per row of the segments. base: sums of buckets, for words given by their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _decode(b, vocab):
                ids, sizes = s["net"], s["sizes"]
                share = np.zeros(len(ids))
                if base is not None:
                    far = ids >= IDS - BUCKETS
                    share[far] = np.log(s["n"][far]) - np.log(base)[ids[far] - (IDS - BUCKETS)]
                stream, at, own = _stream(ids.take(s["code"]), sizes)
                total = np.bincount(own, weights=share.take(s["code"]), minlength=len(sizes))
                for lo in range(0, len(at), SLICE):
                    p = at[lo : lo + SLICE]
                    logp = log_probabilities(weights, stream.take((p[:, None] + _BESIDE).ravel()).reshape(len(p), -1), stream.take(p))
                    k = own[lo : lo + SLICE]
                    total[k[0] : k[-1] + 1] += np.bincount(k - k[0], weights=logp, minlength=k[-1] - k[0] + 1)
                for lo in range(0, len(sizes), 10_000):
                    n, t = sizes[lo : lo + 10_000], total[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([s["ids"].slice(lo, len(n)), pa.array(n), pa.array(t), pa.array(t / np.maximum(n, 1), mask=n == 0)], names=["id", "n_words", "log_prob", "score"])

    return seg.mapInArrow(run, f"id {id_kind}, n_words long, log_prob double, score double")


def score(df: DataFrame, id_col: str, text: str, vocab: dict[bytes, int], weights: list[np.ndarray]) -> DataFrame:
    """id, n_words, log_prob, score per row, where a word of a bucket counts as its bucket."""
    return _score(segments(df, id_col, text), df.schema[id_col].dataType.simpleString(), vocab, weights, None)


def score_segments(seg: DataFrame, id_kind: str, counts: DataFrame, vocab: dict[bytes, int], weights: list[np.ndarray]) -> DataFrame:
    """id, n_words, log_prob, score per row of staged segments, where a word of a bucket has its share of it by counts (w, n)."""
    base = bucket_sums(counts, vocab) + 1  # one for all words not counted
    own = F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w), k) for w, k in vocab.items()], "w binary, id int"))  # IDS rows at most
    words = seg.select("seg", F.posexplode("words").alias("pos", "w")).join(own, "w", "left")
    bucket = (F.crc32("w") % BUCKETS + (IDS - BUCKETS)).cast("int")
    known = words.where("id IS NULL").join(counts, "w", "left").select("seg", "pos", F.coalesce("n", F.lit(1)).alias("n"), bucket.alias("id"))
    known = known.unionByName(words.where("id IS NOT NULL").select("seg", "pos", F.lit(1).cast("long").alias("n"), "id"))
    known = known.select("seg", (F.shiftleft(F.col("id").cast("long"), 32) + F.col("pos")).alias("at"), "n")  # two numbers in one: half the bytes to move

    def pack(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        order = np.argsort(at & 0xFFFFFFFF)  # every place once
        net, n = (at >> 32)[order], rows.column("n").to_numpy()[order]
        return pa.table({"of": rows.column("seg").slice(0, 1), "distinct": [len(at)], "net": pa.array([_packed(net)], pa.binary()), "n": pa.array([_packed(n)], pa.binary())})

    found = known.groupBy("seg").applyInArrow(pack, "of long, distinct long, net binary, n binary")  # a segment's distinct words: bounded
    both = seg.join(found, F.col("seg") == F.col("of"), "left").select("ids", "sizes", "total", "code", "distinct", "net", "n")
    return _score(both, id_kind, vocab, weights, base)


def score_words(df: DataFrame, id_col: str, text: str, counts: DataFrame, vocab: dict[bytes, int], weights: list[np.ndarray]) -> DataFrame:
    """id, n_words, log_prob, score per row, where a word of a bucket has its share of it by counts (w, n; staged)."""
    return score_segments(_numbered(segments(df, id_col, text)), df.schema[id_col].dataType.simpleString(), counts, vocab, weights)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents")
    seg = _numbered(segments(docs, "doc_id", "text"))
    counts = stage(counts_of(seg), "words")
    vocab = head(counts)
    return score_segments(seg, docs.schema["doc_id"].dataType.simpleString(), counts, vocab, fit_segments(seg, vocab)).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
