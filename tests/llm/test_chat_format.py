import hashlib

from arborwell.llm import chat_format as c

ROWS = [
    (1, 0, "user", "a </turn> \\ ### b <turn"), (1, 1, "assistant", "ends with \\"), (1, 2, "assistant", "\n</turn>\n"), (1, 3, "user", None),
    (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (2, 1, "a\n:%0A", "x"), (None, None, None, None), (3, 0, "assistant", ""),
]


def test_query(spark, sf):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in c.op9_chat_format(spark, sf(conversations=df)).collect()}
    odd = "\\### Assistant: </turn> ok"
    rows = [(i, t, r or "", x or "") for i, t, r, x in ROWS] + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert set(got) == {i for i, *_ in rows}
    for conv in got:
        turns = sorted((t or -1, r, x) for i, t, r, x in rows if i == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(c.op9_chat_format(spark, sf(conversations=df.limit(0))).toPandas().conv_id) == {-7}


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "delta", "user", "hel"), (1, 0, 1, "delta", "user", "lo"), (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 3, "regenerate", "assistant", None),
        (1, 1, 4, "delta", "assistant", "go"), (1, 1, 5, "delta", None, "od"), (1, 0, 6, "edit", "user", "Hi"), (1, 0, 7, "delta", "user", "!"),
    ]
    df = spark.createDataFrame(events, "conv_id long, msg long, seq long, kind string, role string, text string")
    m = c.fold_events(df.repartition(4))
    assert {(r.msg, r.role, r.text) for r in m.collect()} == {(0, "user", "Hi!"), (1, "assistant", "good")}
    r = c.render(m).first()
    assert r.formatted == "<turn>### user:\nHi!\n</turn>\n<turn>### assistant:\ngood\n</turn>\n"
    t = r.turns[1]
    assert r.formatted[t.loss_start : t.loss_end] == "good" and r.turns[0].loss_start is None
