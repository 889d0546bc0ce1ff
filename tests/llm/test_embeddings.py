import numpy as np
import pytest

from arborwell.llm import embed_dedup


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(n // 2, n):  # near copies on both sides of the threshold
        x[k] = x[rng.integers(0, n // 2)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.3, 0.4])
    return x.astype(np.float32)


@pytest.mark.parametrize("tile", [2048, 16])
def test_dedup_matches_all_pairs(spark, sf, tile):
    x = vectors(400)
    rows = [(k, [float(c) for c in v], int(k % 3)) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [None] * 16, 0), (1005, [1.0, 2.0], 0), (1006, [float("inf")] * 16, 2)]
    rows += [(2000 + k, rows[7][1], 1) for k in range(60)] + [(2000, rows[7][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    old = embed_dedup.TILE
    embed_dedup.TILE = tile
    try:
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.op5_embed_dedup(spark, sf(embeddings=df)).collect())
    finally:
        embed_dedup.TILE = old
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.array([rows[k][1] for k in good], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([rows[k][2] for k in good])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    ids = np.array([rows[k][0] for k in good])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 1 << 60).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    want = {k: (0, rows[k][0]) for k in range(len(rows))} | {k: (int(link[p].sum()), int(comp[p])) for p, k in enumerate(good)}
    assert got == sorted((rows[k][0], n, c, rows[k][0] == c) for k, (n, c) in want.items())
    assert embed_dedup.op5_embed_dedup(spark, sf(embeddings=df.limit(0))).count() == 0


def test_labels_of_any_type_and_vectors_in_double(spark, sf):
    rows = [(1, [1.0, 0.0], "1.2"), (2, [1.0, 1e-9], "1.2"), (3, [1.0, 0.0], "1.7"), (4, [1.0, 0.0], None), (5, [0.93, 0.36756], "1.2"), (6, [0.9, 0.43589], "1.2")]
    for kind, as_label in (("string", str), ("double", float)):
        df = spark.createDataFrame([(i, v, as_label(x) if x else None) for i, v, x in rows], f"vec_id long, embedding array<double>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.op5_embed_dedup(spark, sf(embeddings=df)).collect()}
        assert got[3] == (0, 3) and got[4] == (0, 4)
        u = {i: np.array(v) / np.linalg.norm(v) for i, v, x in rows if x == "1.2"}
        want = {i: sum(1 for j in u if j != i and u[i] @ u[j] >= 0.93) for i in u}
        assert {i: got[i][0] for i in u} == want


def test_a_pair_within_the_threshold_keeps_its_sketch(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b  # cosine 0.93 exactly
    d = np.bitwise_count((embed_dedup._sketches(a) ^ embed_dedup._sketches(b)).view(np.uint64)).sum(axis=1)
    assert d.max() <= embed_dedup.SKETCH_RADIUS
    far = np.bitwise_count((embed_dedup._sketches(a) ^ embed_dedup._sketches(a[::-1])).view(np.uint64)).sum(axis=1)
    assert (far <= embed_dedup.SKETCH_RADIUS).mean() < 0.001
    zero = np.zeros(len(a), dtype=np.int64)
    met = (embed_dedup._keys(a, zero) == embed_dedup._keys(b, zero)).any(axis=1)
    assert met.mean() > 0.999
