"""What several operators share: tables staged in the shared folder, scans inside arrays, ranks without a global sort.

No function here collects rows whose number grows with the input.
"""

from __future__ import annotations

import atexit
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_STAGED: list[tuple[SparkSession, str]] = []
#: Elements per block of a scan inside an array: appending to an array copies it, so blocks keep a scan linear.
SCAN_BLOCK = 256
#: Files of a staged table with a row per thousand rows.
FILES = 8


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/arborwell-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    files = set(df.inputFiles())
    for entry in [e for e in _STAGED if any(e[1].split("://")[-1] in f for f in files)]:
        _STAGED.remove(entry)
        _remove(entry[0], entry[1].rsplit("/", 1)[0])


def staged_since(mark: int) -> list[tuple[SparkSession, str]]:
    """Tables staged after mark (an earlier len(staged_since(0))) that are still there."""
    return _STAGED[mark:]


def drop_staged(entries: list[tuple[SparkSession, str]], but_for: DataFrame) -> None:
    """Delete staged tables, but for those that a plan reads."""
    read = but_for.inputFiles()
    for entry in entries:
        if entry in _STAGED and not any(entry[1].split("://")[-1] in f for f in read):
            _STAGED.remove(entry)
            _remove(entry[0], entry[1].rsplit("/", 1)[0])


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        try:
            _remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001 - the session is gone; its scheduler cleans the folder
            return


def worker_cache() -> dict:
    """A dict that outlives a task in its Python worker. Operators that don't use it call drop_worker_cache() in their tasks."""
    module = sys.modules.setdefault("_arborwell_worker", types.ModuleType("_arborwell_worker"))
    return module.__dict__.setdefault("cache", {})


def drop_worker_cache() -> None:
    """Free what an earlier operator left in this Python worker: workers are reused, and their memory is one executor's."""
    worker_cache().clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(values: Column, zero: Column, step, kind: str = "bigint") -> Column:
    """Inclusive running fold of an array of kind (step must be associative, zero neutral), in time linear in its size."""
    n_blocks = F.ceil(F.size(values) / F.lit(SCAN_BLOCK)).cast("int")
    blocks = F.transform(
        F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(values, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)),
    )
    start = F.struct(zero.alias("s"), F.array().cast(f"array<{kind}>").alias("a"))

    def add(acc: Column, x: Column) -> Column:
        s = step(acc["s"], x)
        return F.struct(s.alias("s"), F.concat(acc["a"], F.array(s)).alias("a"))

    inner = F.transform(blocks, lambda b: F.aggregate(b, start, add))
    outer = F.aggregate(
        inner,
        F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("a")),
        lambda acc, b: F.struct(
            step(acc["s"], b["s"]).alias("s"),
            F.concat(acc["a"], F.array(F.transform(b["a"], lambda v: step(acc["s"], v)))).alias("a"),
        ),
    )
    return F.flatten(outer["a"])


def tree_fold(parts: DataFrame, schema: str, fold, fan: int = 32) -> DataFrame:
    """One row (none of an empty table): fold over lists of parts' rows (tuples), in a tree whose groups hold about fan rows.

    parts has a row per partition or few; the number of levels follows the number of partitions, a group's size does not.
    """
    names = parts.columns

    def run(rows: pa.Table) -> pa.Table:
        branch = rows.column("_branch")[0].as_py()
        got = fold(list(zip(*[rows.column(c).to_pylist() for c in names], strict=True)))
        return pa.table({"_branch": [branch // fan], **{c: [v] for c, v in zip(names, got, strict=True)}}, schema=pa.schema([("_branch", pa.int64()), *[(c, kinds[c]) for c in names]]))

    kinds = {f.name: to_arrow_type(f.dataType) for f in parts.schema}
    left = parts.rdd.getNumPartitions()
    parts = parts.withColumn("_branch", F.floor(F.spark_partition_id() / fan).cast("long"))
    while True:
        parts = parts.groupBy("_branch").applyInArrow(run, f"_branch long, {schema}")
        left = -(-left // fan)
        if left <= 1:
            return parts.drop("_branch")


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A staged df, marked for broadcast if it has at most so many rows; else a plain join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_offset(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, rows_per_bucket: int = 1024, group_rows: Column | None = None) -> DataFrame:
    """Add the sum of weight over all earlier rows of the same group, in the order of the columns order.

    order[0] must be an evenly spread long (a hash). A group is cut into buckets by ranges of that hash, about
    rows_per_bucket rows each, so a group with a third of all rows is still many small window partitions;
    the offsets of buckets come from a table with one row per bucket. Equal rows may take each other's place.
    Nulls form a group. df is read three times (twice where group_rows, the size of its group, is given): stage it first.
    """
    key = F.struct(*[F.col(c) for c in group])
    keyed = df.withColumns({"_g": key, "_w": weight.cast("long")})
    n_buckets = lambda n: F.greatest(F.ceil(n / rows_per_bucket), F.lit(1))
    if group_rows is None:
        counts = df.groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        counts = small(stage(counts.select(F.col("_g").alias("_cg"), n_buckets(F.col("_n")).alias("_nb")), "counts"))
        keyed = keyed.join(counts, F.col("_g").eqNullSafe(F.col("_cg"))).drop("_cg")
    else:
        keyed = keyed.withColumn("_nb", n_buckets(group_rows))
    bucket = F.floor((F.shiftrightunsigned(F.col(order[0]), 1) / F.lit(float(2**63))) * F.col("_nb"))
    rows = keyed.withColumn("_b", F.least(bucket, F.col("_nb") - 1).cast("long")).drop("_nb")
    sums = rows.groupBy("_g", "_b").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # a row per bucket: few files, since Hadoop starts processes for each that is written
    sums = sums.select(F.col("_g").alias("_cg"), F.col("_b").alias("_cb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base")).coalesce(FILES)
    sums = small(stage(sums, "bases"))
    inside = Window.partitionBy("_g", "_b").orderBy(*[F.shiftrightunsigned(F.col(order[0]), 1), *order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return (
        rows.join(sums, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_b") == F.col("_cb")))
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_g", "_b", "_w", "_in", "_cg", "_cb", "_base")
    )
