"""Packing by cutting-stock column generation.

A document's token ids (with the end id) are cut into pieces of SEQUENCE tokens and a rest. The histogram of piece
lengths, in UNIT tokens rounded up, is the demand of a cutting-stock problem: a linear program over patterns (how many
pieces of each length share a sequence), whose columns are priced by an unbounded-knapsack dynamic program on
the duals, until the larger of Farley's bound and the plain filling bound is within GAP. Pattern counts are rounded down; what is left over is packed by best
fit decreasing on the histogram. Pieces of at most SHORT tokens, which rounding would pad, first fill bundles of BUNDLE tokens by the same program on
exact lengths; a bundle is then a piece like others. Pieces are ranked within their length by hash, and ranks are mapped to the slots of the
patterns. The histograms and the patterns are bounded by SHORT and SEQUENCE / UNIT, so the driver's part does not grow with
the input; pieces are never collected.

Tokenising is by whole text. Texts of ordinary Latin letters are cut at white space and into the parts that the
tokenizer never joins. A Python worker keeps the ids of words and parts (not of over LONG characters) in two dicts of CACHE_WORDS / 2 at most: a
full one becomes the old one, from which words that return come back, so what is kept does not grow with the input; the stage that places pieces
frees it. Any other text, and every text under a tokenizer that does not cut PROBE so, is encoded as it stands.

Null text counts as empty: one piece with the end id. Null ids pass through; repeated rows are documents of their own.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offset, stage, worker_cache

SEQUENCE, UNIT, END_ID, TOKENIZER = 4096, 16, 2, "word_bpe_49k.json"
GAP, ROUNDS, CACHE_WORDS, LONG = 5e-4, 4_000, 800_000, 64
#: Texts are encoded so many rows, or about so many bytes, at a time.
ROWS, BYTES = 64, 1 << 20
#: Pieces a partition of the result holds at least, about: Hadoop starts processes for each file that is written.
FILE_ROWS = 8192
#: Pieces of at most SHORT tokens are first packed by their exact lengths into bundles of BUNDLE tokens.
SHORT, BUNDLE = 128, 1024
PROBE = ["It's 42 \xe9t\xe9s, 'TWAS (we'll) don't: x_y--z!!", " A\tb\r\nCD3.14 \xbd \xaa\xba \xb5g... a@b.c #1 ", "The QUICK brown-fox_jumps"]
#: Characters whose texts may be encoded by parts: no normalisation or case rule looks past one character here.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
#: The tokenizer's own parts of a lower-cased text, for those characters.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def encoder(path: str):
    """Function: list of texts -> list of little-endian uint32 ids as bytes, without the end id. path: a file, or the name of a public one."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache()
    if path not in cache:
        tok = Tokenizer.from_file(path if os.path.exists(path) else public_tokenizers.path(path))
        last = np.zeros(max(tok.get_vocab().values()) + 1, dtype=bool)  # ids that end a part
        last[[i for w, i in tok.get_vocab().items() if w.endswith("</w>")]] = True
        ids_of = lambda t: tok.encode(t, add_special_tokens=False).ids
        by_parts = all(ids_of(t) == [i for w in t.split() for part in _PRETOKEN.findall(w.lower()) for i in ids_of(part)] for t in PROBE)
        # parts need no normalising nor cutting but at the spaces between them, which takes a third of the time
        plain = Tokenizer(tok.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        listed = sorted({part for t in PROBE for part in _PRETOKEN.findall(t.lower())})
        if not by_parts or plain.encode(" ".join(listed), add_special_tokens=False).ids != [i for part in listed for i in ids_of(part)]:
            plain = tok
        cache[path] = ((tok, plain), last, {}, {}, by_parts)
    (tok, plain), last, old, words, by_parts = cache[path]

    def ids(encodings) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in encodings]

    def learn(new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of parts, many in one call: white space keeps them apart, and the last id of each ends a part."""
        flat = np.array(plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(last[flat]) + 1
        if len(ends) == len(new) and ends[-1] == len(flat):
            raw, at = flat.tobytes(), (4 * ends).tolist()
            return zip(new, (raw[lo:hi] for lo, hi in zip([0, *at], at, strict=False)), strict=True)
        return zip(new, ids(tok.encode_batch_fast(new, add_special_tokens=False)), strict=True)

    def encode(texts: list[str]) -> list[bytes]:
        split = [t.split() if by_parts and _PLAIN.fullmatch(t) and "<|" not in t else [] for t in texts]
        found = [list(map(words.get, s)) for s in split]
        gaps = [[k for k, v in enumerate(f) if v is None] for f in found]
        new = {s[k] for s, gap in zip(split, gaps, strict=True) for k in gap}
        fresh = {w: old[w] for w in new if w in old}
        # a part is a word whose only part is itself, so one dict holds both
        cut = {w: (w.lower(),) if w.isalpha() else _PRETOKEN.findall(w.lower()) for w in new if w not in fresh}
        part = {p: words.get(p) or old.get(p) for p in {p for ps in cut.values() for p in ps}}
        unknown = [p for p, raw in part.items() if raw is None]
        for at in range(0, len(unknown), 20_000):
            part.update(learn(unknown[at : at + 20_000]))
        fresh.update([(w, b"".join([part[p] for p in ps])) for w, ps in cut.items() if w not in part])
        fresh.update(part)
        if len(words) + len(fresh) > CACHE_WORDS // 2:
            old.clear()
            old.update(words)
            words.clear()
        words.update(fresh)
        for w in [w for w in fresh if len(w) > LONG]:
            del words[w]
        for s, f, gap in zip(split, found, gaps, strict=True):
            for k in gap:
                f[k] = fresh[s[k]]
        return [b"".join(f) if f else ids([tok.encode(t, add_special_tokens=False)])[0] for t, f in zip(texts, found, strict=True)]

    return encode


def forget_words() -> None:
    """Free the words that encoders kept in this Python worker (tokenizers stay): what follows needs the memory for its shuffles."""
    kept = [d for c in worker_cache().values() if isinstance(c, tuple) for d in c if isinstance(d, dict) and d]
    for d in kept:
        d.clear()
    if kept:
        pa.default_memory_pool().release_unused()


def pieces(df: DataFrame, id_col: str, text: str, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, h (an even hash) per piece."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()) if b.num_rows else np.zeros(0)
            row = np.arange(b.num_rows)
            starts = np.flatnonzero((row % ROWS == 0) | (np.diff(size // BYTES, prepend=0) > 0)).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                at, rows = [], []
                for k, (t, raw) in enumerate(zip(texts, encode(texts), strict=True)):
                    raw += end
                    n = len(raw) // 4
                    seed = xxhash.xxh64_intdigest(f"{keys[k]}|{zlib.crc32(raw)}|{len(t)}")
                    for s in range(0, n, sequence):
                        e = min(n, s + sequence)
                        at.append(k)
                        rows.append((s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n, xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), s)))
                cols = list(zip(*rows, strict=True))
                h = pa.array(np.array(cols[4], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *[pa.array(c, pa.int64()) for c in cols[:4]], h], names=["id", "start", "length", "ids_crc32", "doc_tokens", "h"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, h long")


def _price(size: np.ndarray, value: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best total value within cap and how often each item is taken."""
    order = np.argsort(size)
    s, v = size[order], value[order]
    best, item = np.zeros(cap + 1), np.full(cap + 1, -1)
    fits = np.searchsorted(s, np.arange(cap + 1), side="right")
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - s[: fits[c]]] + v[: fits[c]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], item[c] = gain[k], k
    taken, c = np.zeros(len(size), dtype=np.int64), cap
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            taken[order[item[c]]] += 1
            c -= s[item[c]]
    return float(best[cap]), taken


def solve_patterns(demand: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces} and how often each is used; together exactly the demand {length: pieces}."""
    size = np.array(sorted(k for k, n in demand.items() if n > 0), dtype=np.int64)
    if not len(size):
        return []
    m = len(size)
    # slightly uneven demands, for the linear program only: degenerate steps stall without
    need = np.array([demand[k] for k in size.tolist()], dtype=np.float64) + np.random.default_rng(m).uniform(0, 1e-2, m)
    columns = np.diag(cap // size).astype(np.float64)
    inverse, x = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    filled = float(need @ size) / cap  # no packing takes fewer sequences
    for step in range(ROUNDS):
        dual = inverse.sum(axis=0)
        value, a = _price(size, np.maximum(dual, 0), cap)
        if value <= 1 + 1e-9 or x.sum() <= max(filled, (need @ np.maximum(dual, 0)) / value) * (1 + GAP):
            break
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        t = ratio[r]
        x = x - t * d
        x[r] = t
        x = np.maximum(x, 0)
        columns[:, r] = a
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        if step % 200 == 199:
            # a product first: after a fork, BLAS starts its threads again in products, but LAPACK waits for them forever
            off = np.eye(m) - columns @ inverse
            inverse = inverse + inverse @ off if np.abs(off).sum(axis=1).max() < 0.5 else np.linalg.inv(columns)
            x = np.maximum(inverse @ need, 0)
    used, left = [], np.array([demand[k] for k in size.tolist()], dtype=np.int64)
    whole = np.floor(x + 1e-9).astype(np.int64)
    for r in np.argsort(-whole, kind="stable"):
        a = columns[:, r].astype(np.int64)
        some = a > 0
        n = int(min(whole[r], (left[some] // a[some]).min()))
        if n > 0:
            left -= n * a
            used.append(({int(size[i]): int(a[i]) for i in np.flatnonzero(some)}, n))
    # best fit decreasing on the rest: open sequences by what is free in them
    free: dict[int, list[dict[int, int]]] = {}
    for i in range(m - 1, -1, -1):
        s = int(size[i])
        for _ in range(int(left[i])):
            room = next((c for c in range(s, cap + 1) if free.get(c)), None)
            seq = free[room].pop() if room is not None else {}
            seq[s] = seq.get(s, 0) + 1
            free.setdefault((cap if room is None else room) - s, []).append(seq)
    return used + [(seq, 1) for c in sorted(free) for seq in free[c]]


class Plan:
    """Where the rank-th piece of a bin goes. A bin is a number of UNITs (rounded up), or minus the exact length of a piece of at most SHORT tokens.

    Short pieces fill bundles by patterns of exact lengths; a bundle then counts as a piece of its own number of units, ranked after the pieces
    of that bin, and pieces and bundles fill sequences by patterns of units. All tables have a size that depends on sequence alone.
    """

    def __init__(self, demand: dict[int, int], sequence: int):
        units = {b: n for b, n in demand.items() if b > 0}
        self.bundles = self._slots(bundled := solve_patterns({-b: n for b, n in demand.items() if b < 0}, min(BUNDLE, sequence)))
        made = []  # of each bundle pattern: its first bundle, their bin, their first rank there
        first = 0
        for pattern, n in bundled:
            bin_ = -(-sum(length * per for length, per in pattern.items()) // UNIT)
            made.append((first, bin_, units.get(bin_, 0)))
            units[bin_] = units.get(bin_, 0) + n
            first += n
        self.made = np.array(made, dtype=np.int64).reshape(-1, 3)
        self.sequences = self._slots(solve_patterns(units, sequence // UNIT))

    @staticmethod
    def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
        """Rows (size, first rank, first holder, pieces of this size per holder), by size and rank."""
        slots, first, seen = [], 0, {}
        for pattern, n in patterns:
            for size, per in pattern.items():
                slots.append((size, seen.get(size, 0), first, per))
                seen[size] = seen.get(size, 0) + n * per
            first += n
        return np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)

    @staticmethod
    def _holder(slots: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(slots[:, 0] * (1 << 48) + slots[:, 1], size * (1 << 48) + rank, side="right") - 1
        return slots[k, 2] + (rank - slots[k, 1]) // slots[k, 3]

    def sequence_of(self, bin_: np.ndarray, rank: np.ndarray) -> np.ndarray:
        bin_, rank = bin_.astype(np.int64), rank.astype(np.int64)
        short = np.flatnonzero(bin_ < 0)
        if len(short):
            bundle = self._holder(self.bundles, -bin_[short], rank[short])
            k = np.searchsorted(self.made[:, 0], bundle, side="right") - 1
            bin_[short], rank[short] = self.made[k, 1], self.made[k, 2] + bundle - self.made[k, 0]
        return self._holder(self.sequences, bin_, rank)


def _assign(plan: Plan):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for b in batches:
            column = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in ("rank", "bin")}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plan.sequence_of(column["bin"], column["rank"]))], names=[*b.schema.names, "sequence_id"])

    return assign


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, sequence: int = SEQUENCE) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece. sequence: a multiple of UNIT."""
    if sequence < UNIT or sequence % UNIT:
        raise ValueError(f"sequence must be a multiple of {UNIT}")
    bin_ = F.when(F.col("length") <= min(SHORT, sequence), -F.col("length")).otherwise(F.ceil(F.col("length") / UNIT)).cast("int")
    rows = stage(pieces(df, id_col, text, tokenizer, sequence).withColumn("bin", bin_), "pieces")
    # SHORT + sequence / UNIT rows at most
    demand = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(demand, sequence)
    low = min(demand, default=0)
    in_bin = F.get(F.lit([demand.get(b, 0) for b in range(low, max(demand, default=0) + 1)]).cast("array<long>"), F.col("bin") - low)

    ranked = running_offset(rows, ["bin"], ["h", "id", "start"], F.lit(1), "rank", group_rows=in_bin)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long"
    placed = ranked.mapInArrow(_assign(plan), schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    out = placed.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
    return out.coalesce(max(1, sum(demand.values()) // FILE_ROWS))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from .common import table

    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
