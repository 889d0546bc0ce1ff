"""Secret scan: strong patterns alone, weak ones only where complementary parts of a credential co-occur.

Native: every step is a DataFrame function on one row, so there is no shuffle and no key that could be hot.

Strong kinds are reported wherever they stand: assign, access, hex. Weak kinds are parts of a multipart credential:
cred (a short or loosely named secret, a bearer, or a long unnamed token beside an access id), ident (who logs in) and endpoint (where). The parts of a
text are sorted by start and interval-joined within a scope of SCOPE code points, from the end of one part to the start of
the next, by a sweep: a running maximum of ends gives each part the nearest earlier part of every class, a running minimum of
starts from the back the nearest later one. cred is reported with an identifier or an endpoint in its scope, ident with a
secret, endpoint with both an identifier and a secret; assign and hex count as secrets there. An access key's name after "secret" is no
identifier. Every pattern and every sweep takes time linear in the text.

Null text counts as empty: no spans. Nulls elsewhere, repeated rows and extra columns pass through; an empty table
gives an empty result. Texts are read whole. Spans that start together are ordered by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan

#: The patterns of the strong kinds, letters of the names in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more holds its first AKIA: the same spans as AKIA[A-Z0-9]+ of 18+
HEX = r"[0-9a-f]{16,}"


def _either(name: str) -> str:
    """A pattern of name with its ASCII letters in either case; other signs are pattern signs."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in name)


_SAYS = r"""["']?\x20*[:=]\x20*["']?"""
_NAMES = {
    "cred": ["pwd", "passphrase", "credential", "private_?key", "secret_?(access_?)?key", "auth_?key"],
    "ident": ["user(name|_?id)?", "login", "account", "client_?id", "(secret_?)?access_?key(_?id)?"],
    "endpoint": ["host(name)?", "endpoint", "server"],
}
#: Weak kinds. No part of a pattern can run over a text again and again, so a scan is linear in it.
CRED = f"(({'|'.join(map(_either, _NAMES['cred']))}){_SAYS}[A-Za-z0-9+/_.=-]{{6,}}|{_either('bearer')}\\x20+[A-Za-z0-9+/_.=-]{{16,}})"
IDENT = f"({'|'.join(map(_either, _NAMES['ident']))}){_SAYS}[A-Za-z0-9_.@+-]{{3,}}"
SECRET_KEY = f"^{_either('secret')}"  # an ident that starts so is the name of a secret, not of who logs in
ENDPOINT = f"([a-z][a-z0-9+]{{0,15}}://[A-Za-z0-9._~:@/?#%&=+-]+|({'|'.join(map(_either, _NAMES['endpoint']))}){_SAYS}[A-Za-z0-9.-]{{4,}})"
#: A long unnamed run with letters in both cases; a part only beside an access id.
TOKEN = r"[A-Za-z0-9+/_.=-]{32,}"
ASSIGN_MIN, CRED_MIN, SCOPE = 12, 6, 200
#: Kinds in their order.
KINDS = ["assign", "access", "hex", "cred", "ident", "endpoint"]
_FAR = 1 << 40


def _hits(text: Column, pattern: str) -> Column:
    """array<struct<t, gap>>: each match, leftmost and non-overlapping, with the length of what stands before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda t, g: F.struct(t.alias("t"), F.length(g).cast("long").alias("gap")))


def _spans(hits: Column, ends: Column, kind: int) -> Column:
    return F.zip_with(
        hits,
        ends,
        lambda h, e: F.struct((e - F.length(h["t"])).cast("long").alias("start"), F.lit(kind).alias("kind"), e.cast("long").alias("end"), h["t"].alias("t")),
    )


def find_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Add out: array<struct<start, kind, end>>, sorted; kind is a place in KINDS. Positions are code points."""
    keep = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    work = df.select(keep.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    none_hits = F.array().cast("array<struct<t:string,gap:bigint>>")
    patterns = [ASSIGN, ACCESS, HEX, CRED, IDENT, ENDPOINT, TOKEN]
    # what a match cannot do without is looked for first: that is much cheaper than a pattern
    said = F.contains("_t", F.lit("=")) | F.contains("_t", F.lit(":"))
    bearer = F.contains(F.lower("_t"), F.lit("bearer "))
    access = F.contains("_t", F.lit("AKIA"))
    needs = [said, access, F.lit(True), said | bearer, said, said, access]
    has = [n & F.col("_t").rlike(p) for n, p in zip(needs, patterns, strict=True)]
    has[6] = has[1] & has[6]
    work = work.select("_row", *[F.when(has[k], _hits(F.col("_t"), p)).otherwise(none_hits).alias(f"_h{k}") for k, p in enumerate(patterns)])
    none_ends = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def ends(k: int) -> Column:
        lens = F.transform(F.col(f"_h{k}"), lambda h: h["gap"] + F.length(h["t"]))
        return F.when(F.size(f"_h{k}") > 0, scan(lens, zero, lambda a, b: a + b)).otherwise(none_ends)

    work = work.select("*", *[ends(k).alias(f"_e{k}") for k in range(7)])
    work = work.select("_row", *[_spans(F.col(f"_h{k}"), F.col(f"_e{k}"), k).alias(f"_s{k}") for k in range(7)])
    def assigned(lo: int, hi: int, kind: int) -> Column:
        def ok(s: Column) -> Column:
            n = F.length(F.regexp_extract(s["t"], ASSIGN, 2))
            return (n >= lo) & (n < hi)

        return F.transform(F.filter(F.col("_s0"), ok), lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"]))

    def bare(k: int, ok=None) -> Column:
        some = F.filter(F.col(f"_s{k}"), lambda s: ok(s["t"])) if ok else F.col(f"_s{k}")
        return F.transform(some, lambda s: F.struct(s["start"], s["kind"], s["end"]))

    work = work.select(
        "_row",
        F.concat(assigned(ASSIGN_MIN, _FAR, 0), bare(1), bare(2)).alias("_base"),
        F.concat(assigned(CRED_MIN, ASSIGN_MIN, 3), bare(3), bare(4, lambda t: ~t.rlike(SECRET_KEY)), bare(5)).alias("_weak"),
        bare(6, lambda t: t.rlike("[A-Z]") & t.rlike("[a-z]")).alias("_tokens"),
    )
    none_parts = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def nearest(classes: dict[str, tuple[int, ...]], back: bool) -> Column:
        """For each part, the nearest end of an earlier part of each class, or (back) the nearest start of a later one; a part is its own neighbour."""
        p = F.reverse(F.col("_parts")) if back else F.col("_parts")
        far, step = F.lit(_FAR if back else -_FAR).cast("long"), F.least if back else F.greatest
        at = F.transform(p, lambda s: F.struct(*[F.when(s["kind"].isin(*kinds), s["start"] if back else s["end"]).otherwise(far).alias(c) for c, kinds in classes.items()]))
        kind = f"struct<{','.join(f'{c}:bigint' for c in classes)}>"
        run = scan(at, F.struct(*[far.alias(c) for c in classes]), lambda a, b: F.struct(*[step(a[c], b[c]).alias(c) for c in classes]), kind)
        return F.when(F.size("_parts") > 0, F.reverse(run) if back else run).otherwise(F.array().cast(f"array<{kind}>"))

    def near(s: Column, i: Column, c: str) -> Column:
        return (s["start"] - F.get(F.col("_back"), i)[c] <= SCOPE) | (F.get(F.col("_ahead"), i)[c] - s["end"] <= SCOPE)

    # tokens beside an access id become parts of kind cred
    access = F.filter(F.col("_base"), lambda s: s["kind"] == 1)
    work = work.select("_row", "_base", "_weak", F.when(F.size("_tokens") > 0, F.array_sort(F.concat(access, "_tokens"))).otherwise(none_parts).alias("_parts"))
    work = work.select("*", nearest({"id": (1,)}, False).alias("_back"), nearest({"id": (1,)}, True).alias("_ahead"))
    tokens = F.filter(F.col("_parts"), lambda s, i: (s["kind"] == 6) & near(s, i, "id"))
    weak = F.concat("_weak", F.transform(tokens, lambda s: F.struct(s["start"], F.lit(3).alias("kind"), s["end"])))
    work = work.select("_row", "_base", weak.alias("_weak"))
    # the sweep runs only where there is a weak part
    work = work.select("_row", "_base", F.when(F.size("_weak") > 0, F.array_sort(F.concat("_base", "_weak"))).otherwise(none_parts).alias("_parts"))
    classes = {"sec": (0, 2, 3), "who": (1, 4), "end": (5,)}
    work = work.select("_row", "_base", "_parts", nearest(classes, False).alias("_back"), nearest(classes, True).alias("_ahead"))

    def kept(s: Column, i: Column) -> Column:
        return (
            F.when(s["kind"] == 3, near(s, i, "who") | near(s, i, "end"))
            .when(s["kind"] == 4, near(s, i, "sec"))
            .when(s["kind"] == 5, near(s, i, "who") & near(s, i, "sec"))
            .otherwise(F.lit(False))
        )

    linked = F.filter(F.col("_parts"), kept)
    return work.select("_row.*", F.array_sort(F.concat("_base", linked)).alias(out))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by mark; overlapping spans count as one. Null texts stay null."""
    cols = df.columns
    work = find_spans(df, text, "_aw_spans")
    # end of everything before a span, for gaps between merged spans
    reach = scan(F.transform(F.col("_aw_spans"), lambda s: s["end"]), F.lit(0).cast("long"), F.greatest)
    work = work.withColumn("_aw_reach", F.when(F.size("_aw_spans") > 0, reach))
    whole = F.col(f"`{text}`")

    def piece(s: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get(F.col("_aw_reach"), i - 1)).otherwise(F.lit(0).cast("long"))
        gap = whole.substr((start + 1).cast("int"), F.greatest(s["start"] - start, F.lit(0)).cast("int"))
        return F.when((s["start"] < start) | ((s["start"] == start) & (i > 0)), F.lit("")).otherwise(F.concat(gap, F.lit(mark)))

    end = F.element_at(F.col("_aw_reach"), -1)
    tail = whole.substr((end + 1).cast("int"), F.lit(2**31 - 1))
    new = F.when(F.size("_aw_spans") > 0, F.concat(F.array_join(F.transform(F.col("_aw_spans"), piece), ""), tail)).otherwise(whole)
    return work.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in cols])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets, over whole texts: counts and digest of the strong spans, and all spans."""
    from .common import table

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    base = F.filter(F.col("spans"), lambda s: s["kind"] < 3)
    found = found.select("doc_id", "spans", base.alias("base"))

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == k)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def _sql_hits(kind: int, pattern: str, extra: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, t, e - length(t) AS s, e FROM (
      SELECT r, t, sum(length(t) + length(g)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
        SELECT r, unnest(f) AS t, unnest(g[1:len(f)]) AS g, unnest(range(len(f))) AS i FROM (
          SELECT r, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS g FROM d)))
      WHERE {extra}"""


def _sql() -> str:
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    a = ASSIGN.replace("'", "''")
    value = f"length(regexp_extract(t, '{a}', 2))"
    close = f"p.s - q.e <= {SCOPE} AND q.s - p.e <= {SCOPE}"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    strong AS ({_sql_hits(0, ASSIGN, f"{value} >= {ASSIGN_MIN}")} UNION ALL {_sql_hits(1, ACCESS)} UNION ALL {_sql_hits(2, HEX)}),
    tokens AS ({_sql_hits(3, TOKEN, "regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]')")}),
    weak AS ({_sql_hits(3, ASSIGN, f"{value} >= {CRED_MIN} AND {value} < {ASSIGN_MIN}")} UNION ALL {_sql_hits(3, CRED)}
             UNION ALL {_sql_hits(4, IDENT, f"NOT regexp_matches(t, '{SECRET_KEY}')")} UNION ALL {_sql_hits(5, ENDPOINT)}
             UNION ALL SELECT * FROM tokens p WHERE EXISTS (SELECT 1 FROM strong q WHERE q.r = p.r AND q.kind = 1 AND {close})),
    parts AS (SELECT r, kind, s, e FROM strong UNION ALL SELECT r, kind, s, e FROM weak),
    near AS (SELECT p.r, p.kind, p.s, p.e, coalesce(bool_or(q.kind IN (0, 2, 3)), FALSE) AS sec, coalesce(bool_or(q.kind IN (1, 4)), FALSE) AS who, coalesce(bool_or(q.kind = 5), FALSE) AS wher
             FROM (SELECT *, row_number() OVER () AS k FROM weak) p LEFT JOIN parts q ON p.r = q.r AND {close} GROUP BY p.k, p.r, p.kind, p.s, p.e),
    spans AS (SELECT r, kind, s, e FROM strong UNION ALL
              SELECT r, kind, s, e FROM near WHERE (kind = 3 AND (who OR wher)) OR (kind = 4 AND sec) OR (kind = 5 AND who AND sec)),
    t AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                 string_agg(({names})[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
                 string_agg(({names})[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind, e) AS spans
          FROM spans GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN t USING (r)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _sql()}
