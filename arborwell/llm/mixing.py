"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target number of words (capped at max_repeat times what it has, the excess shared among the others
by weight) and a weight schedule over training progress, linear from (1 - slope) to (1 + slope) times its mean.
Integrating the schedule gives the source's cumulative demand D(p) = target * ((1 - slope) p + slope p^2). Documents
of a source stand in an order drawn by hash; the stream of a source is repeated as often as the target needs, so a
document whose words start at offset c of epoch e is wanted from demand e * size + c on. Inverting D there
gives its position in training, and documents are range-sorted by position. The last document that a target reaches
is taken in part, so a source's taken words are its target, rounded down.

Offsets are running sums in hash buckets (see common.running_offset): a source with a third of all rows is many small
window partitions. Targets come from one row per source, solved with array functions: no row is collected.

Null text counts 0 words; such documents are never taken. Null sources form one source, last. Repeated rows are
documents of their own. Extra columns are kept by mix() and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offset, small, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the place of a source in code point order, repeating; slopes likewise.
WEIGHTS, SLOPES = (3.0, 1.0, 2.0), (0.5, -0.5, 0.0)
SHARE, MAX_REPEAT = 1.5, 2.0


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source of sizes (source, size): source, source_size, target, slope.

    Water-filling in closed form: source i is at its cap when the level reaches cap_i / w_i, so with sources ordered by
    that ratio, the level is found where running sums of caps and remaining weights meet the total.
    Window partitions here hold one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    # binary order of UTF-8 is code point order
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (place % len(xs)).cast("int"))
    s = s.select("source", "source_size", pick(WEIGHTS).alias("w"), pick(SLOPES).alias("slope"))
    whole = Window.partitionBy()
    s = s.withColumns({"cap": MAX_REPEAT * F.col("source_size"), "total": SHARE * F.sum("source_size").over(whole)})
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level)
    # the first source that its level does not fill sets the level of all that follow
    s = s.withColumn("open", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("open.level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"), "slope")


def _position(demand: Column) -> Column:
    """Progress at which the source's cumulative demand reaches demand words."""
    u = F.least(demand / F.col("target"), F.lit(1.0))
    a = F.col("slope")
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * F.when(a != 0, a).otherwise(1.0))
    return F.when(a == 0, u).otherwise(root)


def plan(df: DataFrame, id_col: str, text: str, source: str, keep: list[str] = ()) -> DataFrame:
    """One row per row of df: id, the columns keep, size, source_size, target, takes array<struct<epoch, position, words>>."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        F.shiftleft(F.conv(F.substring(F.md5(F.concat_ws("|", t, F.col(f"`{id_col}`").cast("string"), F.col(f"`{source}`"))), 1, 15), 16, 10).cast("long"), 4).alias("h"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    )
    rows = stage(rows, "sizes")
    targets = stage(source_targets(rows.select("source", "size")), "targets")
    placed = running_offset(rows, ["source"], ["h", "id", "size"], F.col("size"), "offset")
    placed = placed.join(small(targets.withColumnRenamed("source", "ts")), F.col("source").eqNullSafe(F.col("ts"))).drop("ts")

    def take(e: Column) -> Column:
        start = e * F.col("source_size") + F.col("offset")
        words = F.least(F.col("size"), F.floor(F.col("target")) - start.cast("long")).cast("long")
        return F.struct(e.cast("int").alias("epoch"), _position(start).alias("position"), words.alias("words"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(MAX_REPEAT) - 1)), take), lambda x: x["words"] > 0)
    return placed.select("id", "size", "source_size", "target", F.when(F.col("size") > 0, takes).otherwise(F.filter(takes, lambda x: F.lit(False))).alias("takes"), *(["kept"] if keep else []))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows in training order, each as often as it is taken (a part counts if it is half the document or more)."""
    p = plan(df, id_col, text, source, keep=df.columns)
    p = p.select("kept", F.explode(F.filter("takes", lambda x: 2 * x["words"] >= F.col("size"))).alias("take"), "id")
    return p.repartitionByRange(F.col("take.position"), F.col("id")).sortWithinPartitions("take.position", "id").select("kept.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, range-sorted by the position of its first take (never taken: last)."""
    from .common import table

    p = plan(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    out = p.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.round(F.array_min(F.transform("takes", lambda x: x["position"])), 9).alias("position"),
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def _sql() -> str:
    case = lambda xs: "CASE (place % 3) " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(xs)) + " END"
    return rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                      substr(md5(concat_ws('|', coalesce(text, ''), doc_id::VARCHAR, source)), 1, 15) AS h FROM documents),
    s0 AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    s1 AS (SELECT source, source_size, {case(WEIGHTS)} AS w, {case(SLOPES)} AS slope, {MAX_REPEAT}::DOUBLE * source_size AS cap,
                  {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s0),
    s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
    s3 AS (SELECT *, (SELECT arg_min(level, cap / w) FROM s2 WHERE level * w < cap) AS open FROM s2),
    s AS (SELECT source, source_size, slope, least(cap, coalesce(open * w, cap)) AS target FROM s3),
    o AS (SELECT d.doc_id, d.size, s.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
          FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
    u AS (SELECT *, least(off / target, 1.0) AS u, greatest(least(size, floor(target)::BIGINT - off::BIGINT), 0) + greatest(least(size, floor(target)::BIGINT - (source_size + off)::BIGINT), 0) AS taken FROM o)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target, taken::BIGINT AS taken,
           round(CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN u
                 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 9) + 0.0 AS position
    FROM u"""


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": _sql()}
