"""Chat formatting from event logs.

Native. A log has one row per event: conversation, message number, sequence, kind, role, text. Kinds:

- delta: text is appended to its message;
- edit: text replaces what its message held;
- regenerate: its message starts anew (text, if any, is the new beginning).

Events of a message are folded in order of sequence (ties by kind, role, text): everything before the last edit or
regenerate falls away, the rest is joined. A message's role is that of its last event that has one, else empty.
A log is dealt by conversation once; folding, rendering and reading back follow in the same stage, so a text moves once. A
conversation is one row of output, so one conversation's events meet in one task.

Rendering: `<turn>### role:\n` text `\n</turn>\n`. Inside texts a backslash stands before every backslash, `###`,
`<turn` and `</turn`, which reading takes off again; in roles % and newline are written %25 and %0A. loss_spans are
the texts of assistant messages, as code points of formatted.

Null text counts as empty. Null conversation, message or sequence are ordinary keys and come first. Repeated events
count again, as a log says. Extra columns are ignored; an empty log gives no rows. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, TAIL = "<turn>### ", ":\n", "\n</turn>\n"
#: Characters of a streamed delta and of a draft in as_log().
DELTA, DRAFT = 2048, 16
CONTROL = r"(\\|###|</?turn)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def fold_events(events: DataFrame, conv: str = "conv_id", msg: str = "msg", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: conv, msg, role, text."""
    e = events.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{msg}`").alias("msg"),
        F.struct(F.col(f"`{seq}`").alias("seq"), F.coalesce(F.col(f"`{kind}`"), F.lit("delta")).alias("kind"), F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("e"),
    )
    e = e.repartition("conv").groupBy("conv", "msg").agg(F.array_sort(F.collect_list("e")).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(0)))
    live = F.slice("e", F.array_max(resets) + 1, F.size("e"))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    return e.select(
        "conv", "msg",
        F.coalesce(F.element_at(F.concat(F.array(F.lit("")), roles), -1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, order: tuple[str, ...] = ("msg",)) -> DataFrame:
    """One row per conversation, its messages by order: conv, formatted, turns array<struct<start, loss_start, loss_end>> in code points; the loss pair is null off the mask."""
    coded = F.replace(F.replace(F.col("role"), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    head, body = F.concat(F.lit(HEAD), coded, F.lit(MID)), escape(F.col("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(*order))
    m = messages.select("conv", "role", head.alias("head"), body.alias("body"), place.alias("place"))
    m = m.withColumn("n", F.length("head") + F.length("body") + F.lit(len(TAIL)))
    before = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    at = F.col("start") + F.length("head")
    on = F.col("role") == "assistant"
    turn = F.struct("start", F.when(on, at).alias("loss_start"), F.when(on, at + F.length("body")).alias("loss_end"), F.concat("head", "body", F.lit(TAIL)).alias("t"))
    g = m.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return g.select(
        "conv",
        F.array_join(F.transform("t", lambda x: x["t"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"], x["loss_start"], x["loss_end"])).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, turns array<struct<role, text>>, loss_text: what a reader of formatted and its mask gets."""
    pieces = F.split(F.col("formatted"), "\n</turn>\n", -1)
    f = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = F.substring(head, F.lit(len(HEAD) + 1), F.length(head) - len(HEAD) - 1)
        role = F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.struct(role.alias("role"), unescape(F.substring(p, F.length(head) + 2, F.length(p))).alias("text"))

    masked = F.zip_with("pieces", "turns", lambda p, t: F.when(t["loss_start"].isNotNull(), F.substring(p, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))))
    return f.select("conv", "formatted", F.transform("pieces", turn).alias("read"), F.array_join(F.transform(masked, unescape), "").alias("loss_text"))


def as_log(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The log of finished rows: a draft that a regeneration (assistant) or an edit (others) throws away, then the text as streamed deltas.

    Rows that share a turn are messages of their own, in order of role and text.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    r = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    msg = F.struct(F.col(f"`{turn}`").alias("turn"), r.alias("role"), F.monotonically_increasing_id().alias("row"))

    def event(seq: Column, kind: Column, text: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), kind.alias("kind"), text.alias("text"))

    start = F.when(r == "assistant", F.lit("regenerate")).otherwise(F.lit("edit"))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / DELTA).cast("int")), lambda k: event(k + 2, F.lit("delta"), F.substring(t, k * DELTA + 1, F.lit(DELTA))))
    events = F.concat(F.array(event(F.lit(0), F.lit("delta"), F.substring(t, 1, DRAFT)), event(F.lit(1), start, F.lit(""))), deltas)
    e = rows.select(F.col(f"`{conv}`").alias("conv_id"), msg.alias("msg"), r.alias("role"), events.alias("events"))  # a row's number before it becomes several
    e = e.select("conv_id", "msg", "role", F.explode("events").alias("e"))
    return e.select("conv_id", "msg", "e.seq", "e.kind", "role", "e.text")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, from a log of drafts, regenerations, edits and deltas, formatted and read back."""
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    messages = fold_events(as_log(rows.unionByName(more), "conv_id", "turn", "role", "text"))
    out = read_back(render(messages, ("msg.turn", "msg.role", "text", "msg.row")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum({len(HEAD) + len(MID) + len(TAIL)} + length(replace(replace(role, '%', '%25'), chr(10), '%0A'))
             + length(regexp_replace(text, '{CONTROL}', '\\\1', 'g')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": _SQL}
