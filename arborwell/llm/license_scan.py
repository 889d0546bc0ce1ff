"""License scan by a positional index of rare words.

Native: one pass, no shuffle. A template is a licence text or notice, as words, with a mandatory key phrase. Over the templates, a
word's inverse document frequency is its weight. The index maps a word to its postings: templates and places in them.
Of each file, the words of key phrases that it holds are looked up; a template is a candidate if its whole key phrase is
among them, and the candidate's highest-weight word there leads. (A text is tokenised only if it holds a leading word at all.)
Each occurrence of a leading word looks up its postings and so proposes a template at a relative position; the postings of the
phrase's next rare words are intersected by testing the word at their relative positions; then the key phrase is verified
word by word. Every place of a key phrase holds its leading word, so no place is missed.

score of a place: the share, by weight, of the template's words that stand within SLACK words of where the place expects them, so
words put in or left out do not hide a licence. A place counts if its score reaches the template's floor. One list of
templates is one literal of the plan: the plan does not grow an expression for each template.

Null text counts as empty: no words, no labels, score 0. Nulls elsewhere, repeated rows and extra columns do not
matter (only id and text are read); an empty table gives an empty result. Texts are read whole. A row's score is the largest of its places.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word; upper case counts as its lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts of public licences that several templates share.
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation "
    "either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution "
)
#: Fixed values: (label, template, mandatory key phrase in it, least score). The first three are the base.
TEMPLATES = [
    ("mit", "under the mit license", "under the mit license", 0.0),
    ("apache-2", "apache license version 2", "apache license version 2", 0.0),
    ("cc-by-nc", "cc by nc", "cc by nc", 0.0),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", 0.0),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2", 0.0),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license", 0.0),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license", 0.0),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", 0.0),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa", 0.0),
    ("cc-by", "licensed under the creative commons attribution license", "creative commons attribution", 0.0),
    ("cc0", "dedicated to the public domain under cc0", "public domain", 0.5),
    ("gpl-3", _GNU.format("general public license", 3), "gnu general public license as published by the free software foundation either version 3", 0.5),
    ("gpl-2", _GNU.format("general public license", 2), "gnu general public license as published by the free software foundation either version 2", 0.5),
    ("lgpl", _GNU.format("lesser general public license", 3), "gnu lesser general public license as published by the free software foundation", 0.5),
    ("agpl-3", _GNU.format("affero general public license", 3), "gnu affero general public license as published by the free software foundation", 0.5),
    ("bsd", _BSD.strip(), "redistribution and use in source and binary forms", 0.5),
    (
        "bsd-3-clause",
        _BSD + "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
        0.5,
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "shall be included in all copies or substantial portions of the software",
        0.5,
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "permission notice appear in all copies",
        0.5,
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
        "altered source versions must be plainly marked as such",
        0.5,
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "accompanying documentation covered by this license",
        0.5,
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
        "you may not use this file except in compliance with the license",
        0.5,
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software", 0.0),
]
N_BASE = 3
#: Rare words of a key phrase that are intersected before it is verified; words that a word may be out of place; units of a weight.
RARE, SLACK, UNIT = 3, 8, 1000


def build_index(templates=TEMPLATES) -> list[dict]:
    """For each template its words with weights, and its key phrase: place, words, and the places of its words from the highest weight down."""
    split = [t.split() for _, t, _, _ in templates]
    df = Counter(w for words in split for w in set(words))
    weight = {w: round(UNIT * math.log(1 + len(templates) / n)) for w, n in df.items()}
    index = []
    for (label, _, phrase, floor), words in zip(templates, split, strict=True):
        phrase = phrase.split()
        lo = next(p for p in range(len(words)) if words[p : p + len(phrase)] == phrase)
        ranked = sorted(range(len(phrase)), key=lambda p: (-weight[phrase[p]], -len(phrase[p]), p))
        index.append({"label": label, "words": words, "weights": [weight[w] for w in words], "lo": lo, "phrase": phrase, "rare": ranked[:RARE], "floor": floor})
    return index


def _literal(value, kind: str) -> Column:
    """A nested value as one literal: the optimizer folds it once, however many entries it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _literals(index: list[dict]) -> tuple[Column, Column, Column]:
    """The index as literals: templates by number, postings of leading words, words of key phrases."""
    rows, postings = [], {}
    for k, x in enumerate(index):
        lead = x["rare"][0]
        rare = [{"p": p, "w": x["phrase"][p]} for p in x["rare"]]
        words = [{"w": w, "p": p - x["lo"], "n": n} for p, (w, n) in enumerate(zip(x["words"], x["weights"], strict=True))]
        rows.append({"lead": x["phrase"][lead], "phrase": x["phrase"], "rare": rare, "words": words, "total": float(sum(x["weights"])), "floor": x["floor"]})
        # the leading word may stand several times in its phrase: one of its places proposes every place of the phrase
        postings.setdefault(x["phrase"][lead], []).append({"template": k, "p": lead})
    kind = "array<struct<lead:string,phrase:array<string>,rare:array<struct<p:int,w:string>>,words:array<struct<w:string,p:int,n:int>>,total:double,floor:double>>"
    key_words = sorted({w for x in index for w in x["phrase"]})
    return _literal(rows, kind), _literal(postings, "map<string,array<struct<template:int,p:int>>>"), _literal(key_words, "array<string>")


def scan_licenses(df: DataFrame, id_col: str, text: str, templates=TEMPLATES) -> DataFrame:
    """One row per row of df: id_col, n_words, places array<struct<template, start, score>> (start of the key phrase), labels, score."""
    index = build_index(templates)
    by_number, postings, key_words = _literals(index)
    leads = sorted({x["phrase"][x["rare"][0]] for x in index})
    d = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    upper_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    holds = F.col("_t").rlike("(?i)" + "|".join(leads))
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.translate(F.col("_t"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    d = d.select("_id", F.regexp_count(F.col("_t"), F.lit(upper_word)).cast("long").alias("n_words"), F.when(holds, words).otherwise(none).alias("_w"))
    w = F.col("_w")
    d = d.withColumn("_own", F.array_intersect(w, key_words))
    can = F.filter(by_number, lambda t: F.size(F.array_except(t["phrase"], F.col("_own"))) == 0)
    d = d.withColumn("_leads", F.when(F.size("_own") > 0, F.array_distinct(F.transform(can, lambda t: t["lead"]))).otherwise(none))
    at = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: F.array_contains("_leads", h["w"]))
    d = d.withColumn("_hits", F.when(F.size("_leads") > 0, at).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def stands(s: Column, t: Column) -> Column:
        rare = F.forall(t["rare"], lambda r: F.coalesce(F.get(w, s + r["p"]) == r["w"], F.lit(False)))
        return (s >= 0) & rare & (F.slice(w, F.greatest(s, F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"])

    def covered(s: Column, t: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            lo, hi = F.greatest(s + x["p"] - SLACK, F.lit(0)), s + x["p"] + SLACK
            return acc + F.when(F.array_contains(F.slice(w, lo + 1, F.greatest(hi - lo + 1, F.lit(0))), x["w"]), x["n"]).otherwise(0)

        return F.round(F.aggregate(t["words"], F.lit(0), add) / t["total"], 6)

    def proposed(h: Column) -> Column:
        starts = F.transform(F.element_at(postings, h["w"]), lambda p: F.struct(p["template"].alias("template"), (h["i"] - p["p"]).alias("start")))
        return F.filter(starts, lambda p: stands(p["start"], F.get(by_number, p["template"])))

    d = d.withColumn("_found", F.flatten(F.transform("_hits", proposed)))
    scored = F.transform("_found", lambda p: F.struct(p["template"].alias("template"), p["start"].cast("long").alias("start"), covered(p["start"], F.get(by_number, p["template"])).alias("score")))
    d = d.withColumn("places", F.filter(scored, lambda p: p["score"] >= F.get(by_number, p["template"])["floor"]))
    names = F.array(*[F.lit(x["label"]) for x in index])
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.get(names, p["template"]))))
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0))
    return d.select(F.col("_id").alias(id_col), "n_words", "places", labels.alias("labels"), score.alias("score"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of every whole document: base phrases with their places, labels and score."""
    from .common import table

    found = scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = found.withColumn("base", F.filter("places", lambda p: p["template"] < N_BASE))
    starts = F.transform("base", lambda p: p["start"])
    names = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: F.get(names, p["template"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql() -> str:
    index = build_index()
    rows = ", ".join(f"({k}, '{x['label']}', {x['words']}, {x['weights']}, {x['lo']}, {x['phrase']}, {x['floor']}::DOUBLE)" for k, x in enumerate(index))
    key_words = sorted({x["phrase"][0] for x in index})
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    t(k, label, words, weights, lo, phrase, floor) AS (VALUES {rows}),
    h AS (SELECT r, w, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN ({", ".join(f"'{x}'" for x in key_words)})),
    q AS (SELECT r, k, label, i - 1 AS start, floor,
                 round(list_sum([CASE WHEN list_contains(w[greatest(i - lo + x - 1 - {SLACK}, 1)::BIGINT : greatest(i - lo + x - 1 + {SLACK}, 0)::BIGINT], words[x]) THEN weights[x] ELSE 0 END
                                 FOR x IN range(1, len(words) + 1)]) / list_sum(weights)::DOUBLE, 6) AS score
          FROM h JOIN t ON h.w[h.i] = t.phrase[1] AND h.w[h.i:h.i + len(t.phrase) - 1] = t.phrase),
    p AS (SELECT * FROM q WHERE score >= floor),
    g AS (SELECT r, count(*) FILTER (k < {N_BASE}) AS n_base, min(start) FILTER (k < {N_BASE}) AS first_word, max(start) FILTER (k < {N_BASE}) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k < {N_BASE}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
          FROM p GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN g USING (r)"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _sql()}
