"""Learned-partition search against brute force."""

import numpy as np
import pandas as pd
import pytest

from arborwell.llm import ann_partition

SCHEMA = "vec_id long, embedding array<float>, label int, part string"


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v):
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], dtype=np.float32).astype(np.float64)
    out = {}
    for p, i in enumerate(ids):
        if i % 20 == 0:
            s = (x * x[p]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if j != p][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_one_partition_is_exact_with_odd_rows(spark, sf):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(rng.standard_normal((300, 16)))]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]  # ties
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0]), (None, rows[1][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = {}
    for r in ann_partition.op2_ann_partition(spark, sf(embeddings=df)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert ann_partition.op2_ann_partition(spark, sf(embeddings=df.limit(0))).count() == 0


def test_recall_with_many_partitions(spark, sf):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[rng.integers(0, 12, 5000)] + rng.standard_normal((5000, 16))).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = {}
    for r in ann_partition.op2_ann_partition(spark, sf(embeddings=df)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & {i for i, _ in v}) / 20 for q, v in want.items()]) >= 0.9


@pytest.mark.parametrize("combine", [10, 1_000_000])
def test_a_task_combines_its_blocks(combine):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 4)).astype(np.float32)
    frames = []
    for part in range(3):
        rows = [(i, x[i], False) for i in range(part, 90, 3)] + [(q, x[q], True) for q in range(0, 90, 10)]
        frames.append(pd.DataFrame({"id": [r[0] for r in rows], "vec": [r[1] for r in rows], "query": [r[2] for r in rows], "part": part, "block": 0, "chunk": 0}))
    whole = pd.concat(frames, ignore_index=True)
    old = ann_partition.COMBINE
    ann_partition.COMBINE = combine
    try:
        found = pd.concat(list(ann_partition._score_task(iter([whole.iloc[:17], whole.iloc[17:50], whole.iloc[50:]]), 5)))
    finally:
        ann_partition.COMBINE = old
    for q in range(0, 90, 10):
        s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        s[q] = -np.inf
        mine = found[found.query_id == q].sort_values("score", ascending=False).head(5)
        assert list(mine.id) == list(np.argsort(-s)[:5])
    if combine > 1000:
        assert len(found) == 9 * 5
