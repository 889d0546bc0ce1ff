"""Trained operators: held-out accuracy of the quality classifier, language-model scores, and the pipeline's stages."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborwell.llm import lm_scoring, quality, simhash
from arborwell.llm.common import stage

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_quality_ranks_held_out_documents(spark):
    got = quality.op8_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = np.array([r["score"] for r in rows if r["quality"] == 1]), np.array([r["score"] for r in rows if r["quality"] == 0])
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    print("AUC", auc, "kept", (good >= quality.THRESHOLD).mean(), (bad >= quality.THRESHOLD).mean())
    assert auc > 0.8
    assert all(r["predicted"] == (r["score"] >= quality.THRESHOLD) for r in rows)


def test_quality_without_labels_and_with_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, ""), (3, "word " * 50_000)], "doc_id long, text string")
    path = sf(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = quality.op8_quality(spark, path).collect()
    assert len(rows) == 5 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    empty = sf(documents=docs.limit(0))
    assert quality.op8_quality(spark, empty).count() == 0


def test_lm_scores_match_plain_sums_and_prefer_the_corpus_order(spark):
    rng = random.Random(3)
    sentences = ["the cat sat on the mat .", "a dog ran in the park .", "we read an old book at home ."]
    texts = [" ".join(rng.choice(sentences) for _ in range(40)) for _ in range(60)]
    words = texts[0].split()
    mixed = " ".join(rng.sample(words, len(words)))
    df = spark.createDataFrame([*enumerate(texts), (100, mixed), (101, None), (102, ""), (None, "The CAT"), (102, "")], "id long, text string")
    vocab = lm_scoring.vocabulary(df, "text")
    assert vocab[b"."] == 0 or vocab[b"the"] == 0
    w = lm_scoring.fit(df, "text", vocab, every=1, rounds=12)
    rows = lm_scoring.score(df, "id", "text", vocab, w).collect()
    by = {r["id"]: r for r in rows}
    assert len(rows) == 65 and by[100]["n_words"] == by[0]["n_words"]
    assert by[0]["score"] > by[100]["score"]
    assert by[101]["n_words"] == by[102]["n_words"] == 0 and by[102]["log_prob"] == 0 and by[102]["score"] is None
    assert by[None]["n_words"] == 2

    def plain(text):
        edge = [lm_scoring.EDGE] * lm_scoring.WINDOW
        ids = edge + lm_scoring._ids(lm_scoring.words_of(text), vocab).tolist() + edge
        total = 0.0
        for k in range(lm_scoring.WINDOW, len(ids) - lm_scoring.WINDOW):
            near = ids[k - lm_scoring.WINDOW : k] + ids[k + 1 : k + 1 + lm_scoring.WINDOW]
            h = np.tanh(np.concatenate([w[0][i] for i in near]) @ w[1] + w[2])
            c, m = divmod(ids[k], lm_scoring.MEMBERS)
            for z, at in ((h @ w[3] + w[4], c), (h @ w[5][c] + w[6][c], m)):
                total += float(z[at] - np.log(np.exp(z).sum()))
        return total

    for k, text in ((0, texts[0]), (100, mixed)):
        assert by[k]["log_prob"] == pytest.approx(plain(text), rel=1e-4)
    assert lm_scoring.score(df.limit(0), "id", "text", vocab, w).count() == 0


def test_lm_every_word_has_its_own_probability(spark, sf):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(lm_scoring.IDS)]  # more than the network's own words
    texts = [" ".join(common * 3)] + [" ".join(rng.choice(common) for _ in range(50)) for _ in range(5)]
    seen = {lm_scoring.zlib.crc32(w.encode()) % lm_scoring.BUCKETS: w for w in (f"r{k}" for k in range(2000))}
    rare, often = next((r, o) for b, r in seen.items() for o in (f"o{k}" for k in range(2000)) if lm_scoring.zlib.crc32(o.encode()) % lm_scoring.BUCKETS == b)
    texts += [f"c1 c2 {rare} c3 c4", f"c1 c2 {often} c3 c4", f"c1 c2 {often} c3 c4"]  # one bucket, one context
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, texts[7])], "doc_id long, text string")
    rows = lm_scoring.op6_lm_scoring(spark, sf(documents=docs)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 2 and by[None]["n_words"] == 0 and by[None]["score"] is None and by[None]["log_prob"] == 0
    assert by[7]["log_prob"] - by[6]["log_prob"] == pytest.approx(np.log(3), abs=1e-6)  # often stands three times, rare once
    counts = stage(lm_scoring.word_counts(docs, "text"), "words")
    vocab, w = lm_scoring.head(counts), lm_scoring.initial()
    sums = lm_scoring.bucket_sums(counts, vocab)
    n = {bytes(r["w"]): r["n"] for r in counts.collect()}
    assert sums.sum() == sum(k for x, k in n.items() if x not in vocab) > 0
    plain = {r["id"]: r["log_prob"] for r in lm_scoring.score(docs, "doc_id", "text", vocab, w).collect()}
    for r in lm_scoring.score_words(docs, "doc_id", "text", counts, vocab, w).collect():
        own = [x for x in lm_scoring.words_of(dict(enumerate(texts)).get(r["id"])) if x not in vocab]
        share = sum(np.log(n[x] / (sums[lm_scoring.zlib.crc32(x) % lm_scoring.BUCKETS] + 1)) for x in own)
        assert r["log_prob"] == pytest.approx(plain[r["id"]] + share, rel=1e-6)
    new = spark.createDataFrame([(1, "never counted")], "doc_id long, text string")
    assert np.isfinite(lm_scoring.score_words(new, "doc_id", "text", counts, vocab, w).first()["log_prob"])


def test_lm_query_trains_on_all_documents(spark, sf):
    rng = random.Random(7)
    sentences = ["the cat sat on the mat .", "a dog ran in the park .", "we read an old book at home ."]
    texts = [" ".join(rng.choice(sentences) for _ in range(40)) for _ in range(1200)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").where(F.pmod(F.xxhash64("text"), F.lit(16)) != 0)  # none that a stride of 16 takes
    words = texts[0].split()
    mixed = spark.createDataFrame([(-1, " ".join(rng.sample(words, len(words))))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_scoring.op6_lm_scoring(spark, sf(documents=df.union(mixed))).collect()}
    scores = [r["score"] for k, r in rows.items() if k >= 0]
    assert len(scores) > 1000 and min(scores) > rows[-1]["score"] + 0.5
    assert np.mean(scores) > -2.5  # about -7 by the initial weights


@needs_data
def test_each_stage_of_the_pipeline_takes_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], folder).write.parquet(f"{tmp_path}/{name}")
        docs.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, good, single, clean, mixed, packed = docs
    assert good.columns == single.columns == clean.columns == mixed.columns == raw.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.op8_quality(spark, folder).collect()}
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert ids == {k for k, p in scores.items() if p == 1} and 0 < len(ids) < len(scores)
    groups = simhash.similar_documents(good, "doc_id", "text").select("component").distinct()
    assert {r[0] for r in groups.collect()} == {r[0] for r in single.select("doc_id").collect()}
    assert single.count() == groups.count()
    # brute force: no two that stay share nine tenths of their five-word shingles, and who went shares half of them with another
    shingles = {r["doc_id"]: frozenset(zip(*[(r["text"] or "").lower().split()[k:] for k in range(5)], strict=False)) for r in good.collect()}
    share = lambda a, b: len(a & b) / max(1, len(a | b))
    stay = {r[0] for r in single.select("doc_id").collect()}
    by: dict = {}
    for i, s in shingles.items():
        for x in s:
            by.setdefault(x, set()).add(i)
    for i, s in shingles.items():
        others = {j for x in s for j in by[x]} - {i}
        best = max((share(s, shingles[j]) for j in others), default=0.0)
        assert i not in stay or all(share(s, shingles[j]) < 0.9 for j in others & stay)
        assert i in stay or best > 0.5 or len(s) < 2
    before, after = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (single, clean))
    assert before.keys() == after.keys()
    key = re.compile("[0-9a-f]{16,}")
    assert any(key.search(t or "") for t in before.values()) and not any(key.search(t or "") for t in after.values())
    assert {r["text"] for r in mixed.select("text").collect()} <= set(after.values())
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert tokens.where("n > 4096 OR n <> e").count() == 0
    assert packed.where("start = 0").count() == mixed.count()


def plain_quality(x, y, ids, fold):
    """Ridge on Fourier features and isotonic calibration, all rows at once."""
    use = np.array([lm_scoring.zlib.crc32(str(i).encode()) % 4 != 2 for i in ids])
    mean, std = x.mean(axis=0), x.std(axis=0)
    model = {"mean": mean, "std": np.where(std > 1e-9, std, 1.0)}
    phi = quality._phi(x, model)

    def ridge(rows):
        a = phi[rows]
        penalty = np.full(a.shape[1], quality.RIDGE * max(1.0, len(a)) + 1e-6)
        penalty[-1] = 1e-9
        return np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y[rows])

    raw = np.zeros(len(x))
    for f in range(quality.FOLDS):
        raw[fold == f] = phi[fold == f] @ ridge(use & (fold != f))
    bins: dict = {}
    for k in np.flatnonzero(use):
        bins.setdefault(int(np.clip(np.floor((raw[k] + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)), []).append(k)
    groups = [bins[b] for b in sorted(bins)]
    i = 0
    while i < len(groups) - 1:  # join neighbours until means rise
        if y[groups[i]].mean() >= y[groups[i + 1]].mean():
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
            i = max(0, i - 1)
        else:
            i += 1
    level, at = [y[g].mean() for g in groups], [raw[g].mean() for g in groups]
    where = [raw[bins[b]].mean() for b in sorted(bins)]
    spread = max(1e-6, np.ptp(where))
    at, level = [at[0] - spread, *at, at[-1] + spread], [max(0.0, level[0] - 0.01), *level, min(1.0, level[-1] + 0.01)]
    return np.clip(np.interp(phi @ ridge(use), at, level), 0, 1)


def test_quality_matches_a_plain_version_and_ignores_held_out_labels(spark, sf):
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "quietly", "on", "mats", "near", "rivers", "today", "."]) for _ in range(rng.randrange(20, 120)))
    bad = lambda: " ".join(rng.choice(["$$$", "BUY", "now!!", "x9x9", "click", "123", "%%%"]) for _ in range(rng.randrange(3, 60)))
    y = [int(rng.random() < 0.5) for _ in range(400)]
    texts = [(good if v ^ (rng.random() < 0.1) else bad)() for v in y]
    docs = spark.createDataFrame([(k, t, "clash", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, id string, score double")
    label = lambda flip: spark.createDataFrame([(k, 1 - v if flip and lm_scoring.zlib.crc32(str(k).encode()) % 4 == 2 else v, "clash") for k, v in enumerate(y)], "doc_id long, quality int, y string")
    rows = [sorted((r["doc_id"], r["score"], r["held_out"]) for r in quality.op8_quality(spark, sf(documents=docs, labels=label(flip))).collect()) for flip in (False, True)]
    assert np.allclose([s for _, s, _ in rows[0]], [s for _, s, _ in rows[1]], atol=1e-9)
    assert all(h == (lm_scoring.zlib.crc32(str(k).encode()) % 4 == 2) for k, _, h in rows[0])
    fold = np.array([r[0] for r in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)), "doc_id").orderBy("doc_id").collect()])
    want = plain_quality(np.array([quality.statistics(t) for t in texts]), np.array(y, dtype=float), range(400), fold)
    assert np.allclose([s for _, s, _ in rows[0]], want, atol=1e-6)


def test_pipeline_stages_on_odd_rows(spark, sf):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "by", "rivers", "."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["$$$", "BUY!!", "%%%", "x9"]) for _ in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _aw_x string, rank int, component string, id long"
    row = lambda i, t, s="a": (i, t, "en", s, len(t or ""), "clash", 7, "clash", 8)
    rows = [row(k, good() if k % 2 else bad(), "ab"[k % 3 == 0]) for k in range(60)]
    rows += [row(100, None), row(101, ""), row(None, good()), row(None, good(), None), rows[1], rows[1], row(102, good() + " password=abcdefghijklmn")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, schema)
    folder = sf(documents=docs, labels=labels)
    done = [docs]
    for name, step in corpus_pipeline.STAGES:
        done.append(stage(step(spark, done[-1], folder), name))
        empty = step(spark, docs.limit(0), folder)
        assert empty.count() == 0 and empty.columns == done[-1].columns
    _, kept, single, clean, mixed, packed = done
    assert kept.columns == single.columns == clean.columns == mixed.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {k for k in ids if k is not None and k < 60} == set(range(1, 60, 2)) and ids.count(1) == 3 and ids.count(None) == 2
    assert sorted((r["doc_id"] for r in single.where("doc_id < 60").collect())) == list(range(1, 60, 2))
    assert single.where("doc_id IS NULL").count() == 2 and single.where("rank = 7 AND component = 'clash'").count() == single.count()
    redacted = clean.where("doc_id = 102").first()
    assert redacted["text"].endswith("[SECRET]") and redacted["n_chars"] == len(redacted["text"]) and clean.count() == single.count()
    for r in clean.where("doc_id < 60 OR doc_id IS NULL").collect():
        assert r["n_chars"] == len(r["text"])
    times = mixed.groupBy("doc_id", "text").count().collect()
    assert all(r["count"] <= 2 for r in times) and {r["text"] for r in times} <= {r["text"] for r in clean.collect()}
    assert packed.where("start = 0").count() == mixed.count()
    whole = corpus_pipeline.run(spark, folder)
    key = lambda d: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in d.collect())
    assert key(whole) == key(packed)
