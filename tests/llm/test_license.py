"""Licence scan on whole licences, changed licences and odd texts, against a plain version."""

import random
import re

import pytest

from arborwell.llm import license_scan as ls

INDEX = ls.build_index()


def plain(text):
    """Words, places (template, start, score), by trying every template at every word."""
    w = re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for k, x in enumerate(INDEX):
        n = len(x["phrase"])
        for s in range(len(w) - n + 1):
            if w[s : s + n] != x["phrase"]:
                continue
            near = [(s + p - x["lo"], word, weight) for p, (word, weight) in enumerate(zip(x["words"], x["weights"], strict=True))]
            found = sum(weight for at, word, weight in near if word in w[max(at - ls.SLACK, 0) : max(at + ls.SLACK + 1, 0)])
            score = round(found / sum(x["weights"]), 6)
            if score >= x["floor"]:
                out.add((k, s, score))
    return len(w), out


def whole(label):
    return max((t for name, t, _, _ in ls.TEMPLATES if name == label), key=len)


def sprinkled(text, every, rnd):
    return " ".join(w if rnd.random() > 1 / every else f"{w} x{rnd.randrange(99)}" for w in text.split())


def texts():
    rnd = random.Random(5)
    out = [None, "", "no licence here", "Cc-By-NC " * 400, "license version " * 3000 + "Apache License, Version 2.0", "public domain", "mit " * 2000]
    for label, t, phrase, _ in ls.TEMPLATES:
        out += [t, t.upper(), f"before {t} after", phrase, sprinkled(t, 12, rnd), t.replace(phrase.split()[-1], "changed")]
    bag = sorted({w for _, t, _, _ in ls.TEMPLATES for w in t.split()})
    out += [" ".join(rnd.choice(bag) for _ in range(rnd.randrange(400))) for _ in range(30)]
    out += [" ".join(rnd.choice(ls.TEMPLATES)[1] for _ in range(6)) for _ in range(10)]
    return out


def test_against_a_plain_version(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id int, text string, places string, n_words int")
    got = {r.doc_id: r for r in ls.scan_licenses(df, "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, places = plain(t)
        assert got[i].n_words == n
        assert len(got[i].places) == len(places)
        assert {(p.template, p.start) for p in got[i].places} == {p[:2] for p in places}
        assert got[i].score == pytest.approx(max((p[2] for p in places), default=0.0), abs=2e-6)


def test_words_put_in_do_not_hide_a_licence(spark):
    changed = {
        "mit": whole("mit").replace("to permit persons", "Copyright ACME Inc to permit other persons").replace("without limitation", "without any limitation"),
        "isc": whole("isc").replace("any purpose", "any lawful purpose"),
        "bsd,bsd-3-clause": whole("bsd-3-clause").replace("the name of the copyright holder", "the name of Acme Corp nor the name of the holder"),
        "gpl-3": whole("gpl-3"),
        "": whole("zlib").replace("plainly marked", "clearly marked"),  # the key phrase is mandatory
    }
    df = spark.createDataFrame([(k, t) for k, t in changed.items()], "want string, text string")
    for r in ls.scan_licenses(df, "want", "text").collect():
        assert ",".join(r.labels) == r.want
        assert (r.score > 0.9) == bool(r.want)


def test_a_key_phrase_alone_is_below_its_floor(spark):
    df = spark.createDataFrame([(1, "it shall be included in all copies or substantial portions of the software")], "id int, text string")
    assert ls.scan_licenses(df, "id", "text").first().labels == []


def test_a_leading_word_twice_in_a_phrase(spark):
    df = spark.createDataFrame([(1, "zz a zz zz a zz b"), (2, "zz a zz a zz")], "id int, text string")
    got = {r.id: sorted(p.start for p in r.places) for r in ls.scan_licenses(df, "id", "text", [("l", "zz a zz", "zz a zz", 0.0), ("m", "a b a", "a b", 0.0)]).collect()}
    assert got == {1: [0, 3], 2: [0, 2]}


def test_sql_on_the_same_texts(spark, tmp_path):
    import duckdb

    rows = list(enumerate(texts()))
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(ls.ORACLES["op3_license_scan"]).fetchall())
    assert sorted(map(tuple, ls.op3_license_scan(spark, str(tmp_path)).collect())) == want
