"""Packing: ids against the tokenizer, exact demand, gapless sequences."""

import zlib

import numpy as np

from arborwell.llm import packing

TEXTS = [(1, "Hello, world! it's 42"), (2, None), (3, ""), (4, "éé <|endoftext|> 汉字 ok"), (4, "same id"), (None, "no id"), (5, "a b, c. " * 4000), (5, "a b, c. " * 4000), (6, "İstanbuĺ x")]


def test_pieces_and_sequences(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    df = spark.createDataFrame([(*r, "clash") for r in TEXTS], "doc_id long, text string, rank string")
    rows = packing.op4_packing(spark, sf(documents=df)).collect()
    want = []
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        want.append((str(i), len(ids), ids))
    for i, n, ids in want:
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if str(r.doc_id) == i and r.doc_tokens == n)
        copies = sum(1 for x in want if x[0] == i and x[1] == n)
        assert mine[0][0] == 0 and sum(m[1] for m in mine) == n * copies
        assert all(zlib.crc32(ids[s : s + k].tobytes()) == c for s, k, c in mine)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.op4_packing(spark, sf(documents=df.limit(0))).count() == 0


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    texts = [f"word{k % 37} Other{k % 11}, {k}" for k in range(400)]
    whole = packing.encoder(packing.TOKENIZER)(texts)
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    packing.worker_cache().clear()
    encode = packing.encoder(packing.TOKENIZER)
    assert [x for at in range(0, 400, 8) for x in encode(texts[at : at + 8])] == whole


def test_patterns_meet_the_demand_with_little_padding():
    demand = {k: 2_000 // k for k in range(1, 33)}
    used = packing.solve_patterns(demand, 64)
    got = {}
    for pattern, n in used:
        assert sum(k * c for k, c in pattern.items()) <= 64
        for k, c in pattern.items():
            got[k] = got.get(k, 0) + c * n
    assert got == demand
    assert sum(n for _, n in used) <= 1.02 * sum(k * n for k, n in demand.items()) / 64 + 1
    assert packing.solve_patterns({}, 256) == []


def test_other_tokenizers_and_long_words_give_the_tokenizers_own_ids():
    import public_tokenizers
    from pathlib import Path
    from tokenizers import Tokenizer

    texts = ["Hello, World! it's 42", "a" * 300 + " b" * 3 + " " + "Xy9" * 200, "plain words here", ""]
    folder = Path(public_tokenizers.path(packing.TOKENIZER)).parent
    tried = 0
    for file in sorted(folder.glob("*.json")):
        try:
            tok = Tokenizer.from_file(str(file))
        except Exception:  # noqa: BLE001 - not a tokenizer of this kind
            continue
        tried += 1
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert packing.encoder(str(file))(texts) == want, file.name
    assert tried
    packing.encoder(packing.TOKENIZER)(texts)
    _, _, parts, words, by_parts = packing.worker_cache()[packing.TOKENIZER]
    assert by_parts and max(map(len, [*parts, *words])) <= packing.LONG
    packing.worker_cache().clear()


def filled(demand, sequence=packing.SEQUENCE):
    """Tokens of each sequence of a plan for {length: pieces}."""
    bins, left = {}, {}
    for length, n in demand.items():
        bins.setdefault(-length if length <= packing.SHORT else -(-length // packing.UNIT), []).extend([length] * n)
    plan = packing.Plan({b: len(x) for b, x in bins.items()}, sequence)
    for b, lengths in bins.items():
        for seq, length in zip(plan.sequence_of(np.full(len(lengths), b), np.arange(len(lengths))).tolist(), lengths, strict=True):
            left[seq] = left.get(seq, 0) + length
    assert max(left.values(), default=0) <= sequence
    return left


def test_short_pieces_leave_little_padding():
    for demand in ({1: 50_000}, {17: 20_000}, {k: 900 for k in range(2, 61)}, {100: 9_000}, {k: 300 for k in range(1, 257)}, {5: 30_000, 1000: 900, 4096: 7}):
        got = filled(demand)
        tokens = sum(k * n for k, n in demand.items())
        assert len(got) * packing.SEQUENCE <= 1.04 * tokens + 2 * packing.SEQUENCE
    assert filled({}) == {}
    assert len(filled({1: 1})) == 1
    assert sum(filled({3: 5, 64: 2, 63: 4}, 64).values()) == 15 + 128 + 252


def test_a_sequence_that_is_no_multiple_of_a_unit_is_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="multiple"):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sequence=100)


def test_the_linear_program_ends_in_a_process_that_has_forked():
    """Starting Spark forks; a long program then refreshes its inverse."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import subprocess, numpy as np; from arborwell.llm import packing; subprocess.run(['true'], preexec_fn=lambda: None);"
        "rng = np.random.default_rng(1); need = {k: int(n) for k, n in enumerate(rng.integers(1, 60, 256), 1)};"
        "calls = []; price = packing._price; packing._price = lambda *a: calls.append(1) or price(*a); used = packing.solve_patterns(need, 256);"
        "got = {k: sum(p.get(k, 0) * n for p, n in used) for k in need}; assert got == need and len(calls) > 200, len(calls)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60, cwd=Path(packing.__file__).parents[2])


def kept_words():
    _, _, parts, words, _ = packing.worker_cache()[packing.TOKENIZER]
    return parts, words


def test_what_a_worker_keeps_is_bounded_and_words_in_use_stay(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 400)
    packing.worker_cache().clear()
    encode = packing.encoder(packing.TOKENIZER)
    syllables = [a + b for a in "bdfgklmn" for b in "aeiou"]
    texts = ["Always, " + " ".join(f"{syllables[k % 40]}{syllables[k // 40 % 40]}{syllables[(k + n) % 40]}." for k in range(n, n + 30)) for n in range(0, 1_500, 30)]
    got, most = [], 0
    for n, t in enumerate(texts):
        got += encode([t])
        parts, words = kept_words()
        most = max(most, len(parts) + len(words))
        assert any("Always," in d for d in (parts, words)), n
    assert 200 < most <= 400 + 64
    packing.worker_cache().clear()
    monkeypatch.undo()
    assert packing.encoder(packing.TOKENIZER)(texts) == got
    packing.worker_cache().clear()


def test_placing_pieces_frees_the_words():
    import pyarrow as pa

    packing.worker_cache().clear()
    packing.encoder(packing.TOKENIZER)(["some words, and more"])
    assert any(kept_words())
    batch = pa.RecordBatch.from_pydict({"bin": [3, 3], "rank": [0, 1]})
    assert [b.column(2).to_pylist() for b in packing._assign(packing.Plan({3: 2}, packing.SEQUENCE))(iter([batch]))] == [[0, 0]]
    assert not any(kept_words())
    assert len(packing.encoder(packing.TOKENIZER)(["some words, and more"])[0]) == 20
    packing.worker_cache().clear()


def test_many_long_texts_are_encoded_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    sizes = []

    def encoder(path):
        return lambda texts: sizes.append(sum(map(len, texts))) or [b"\x05\0\0\0" * len(t) for t in texts]

    monkeypatch.setattr(packing, "encoder", encoder)
    cuts = []
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: cuts.append(f) or self)
    packing.pieces(df, "doc_id", "text")
    texts = ["x" * n for n in (packing.BYTES // 4,) * 12] + [None, "", "y" * 3 * packing.BYTES, "z"]
    out = pa.Table.from_batches(cuts[0](iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])))
    assert max(sizes) <= 4 * packing.BYTES and max(n for n in sizes if n < 3 * packing.BYTES) <= 1.25 * packing.BYTES
    assert sum(out.column("length").to_pylist()) == sum(len(t or "") + 1 for t in texts)
    assert sorted(set(out.column("id").to_pylist())) == list(range(len(texts)))


def test_small_results_are_few_partitions_and_ranks_need_no_table_of_counts(spark, sf, tmp_path):
    root = packing.stage.__globals__["stage_root"](spark)
    from pathlib import Path

    seen = lambda: {str(p) for p in Path(root.split("://")[-1].removeprefix("file:")).glob("arborwell-*/*")}
    before = seen()
    aqe, parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = packing.op4_packing(spark, sf(documents=spark.range(300).selectExpr("id doc_id", "repeat('a b c ', cast(id % 70 as int)) text")))
        staged = seen() - before
        assert sorted(p.rsplit("/", 1)[1] for p in staged) == ["bases", "pieces"]
        assert all(len(list(Path(p).glob("*.parquet"))) <= 8 for p in staged if p.endswith("bases"))
        assert out.rdd.getNumPartitions() == 1
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 300
    for pieces in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= packing.SEQUENCE
