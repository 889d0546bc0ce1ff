"""LIBSVM text and wide tables as cells (ins_id, fid, value) and labels (ins_id, label).

A cell that is null or 0 in a wide table is absent; a stored 0 of a text file is kept. NaN raises when cells are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, line: str = "value", ins_id: str | None = None) -> DataFrame:
    """ins_id, label, fids, values of each text line; blank lines and lines that start with # are skipped.

    Fields part at white space or commas; ids are taken as they stand. Without an ins_id column, ids are unique but not dense.
    """
    t = F.trim(F.col(line))
    rows = lines.select(t.alias("t"), (F.col(ins_id) if ins_id else F.monotonically_increasing_id()).alias("ins_id")).where((t != "") & ~t.startswith("#"))
    parts = F.filter(F.split("t", r"[\s,]+"), lambda x: x != "")
    cells = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.split(x, ":"))
    return rows.select(
        "ins_id",
        F.element_at(parts, 1).cast("double").alias("label"),
        F.transform(cells, lambda c: F.get(c, F.lit(0)).cast("int")).alias("fids"),
        F.transform(cells, lambda c: F.get(c, F.lit(1)).cast("double")).alias("values"),
    )


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_libsvm(df: DataFrame, label: str, features: list[str], path: str) -> None:
    """One line per row, ids from 0, absent cells left out."""
    df.select(libsvm_line(F.col(label), features).alias("value")).write.mode("overwrite").text(path)


def libsvm_line(label: Column, features: list[str]) -> Column:
    cell = lambda k, c: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(f"{k}:"), F.col(c).cast("double").cast("string")))
    return F.concat_ws(" ", label.cast("int").cast("string"), *[cell(k, c) for k, c in enumerate(features)])


def explode_cells(parsed: DataFrame) -> DataFrame:
    """Cells of parse_lines' rows."""
    return parsed.select("ins_id", F.explode(F.arrays_zip("fids", "values")).alias("c")).select("ins_id", F.col("c.fids").alias("fid"), F.col("c.values").alias("value"))


def wide_to_cells(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, fid, value: one row per present cell. One pass, no shuffle."""
    cells = F.array(*[F.struct(F.lit(k).alias("fid"), F.col(c).cast("double").alias("value")) for k, c in enumerate(features)])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.fid", "c.value").where("value IS NOT NULL AND value <> 0")


def cells_to_wide(cells: DataFrame, num_feature: int, keys: list[str]) -> DataFrame:
    """One row per key with columns f0..f{num_feature-1}; absent cells are null. For tables of moderate width."""
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col("fid") == k, F.col("value"))).alias(f"f{k}") for k in range(num_feature)])


def remap_labels(df: DataFrame, label: str, num_class: int) -> DataFrame:
    """Labels as 0..num_class-1. Binary: exactly two distinct values, -1 becomes 0. Multi: whole numbers; 1..K become 0..K-1."""
    y = F.col(label).cast("double")
    s = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_distinct(y).alias("n"), F.max((y != F.floor(y)).cast("int")).alias("frac"), F.count(F.when(y.isNull() | F.isnan(y), 1)).alias("bad")).first()
    if s["bad"] or s["lo"] is None:
        raise ValueError("labels must be present")
    if num_class == 2:
        if s["n"] != 2:
            raise ValueError(f"binary labels need two distinct values, found {s['n']}")
        return df.withColumn(label, F.when(y == -1, 0.0).otherwise(y))
    if s["frac"] or s["lo"] < 0 or s["hi"] > num_class or s["hi"] - s["lo"] >= num_class:
        raise ValueError(f"labels must be whole numbers of {num_class} classes")
    return df.withColumn(label, y - 1 if s["hi"] == num_class else y)


def random_split(df: DataFrame, key: Column, valid_ratio: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows by a hash of key: the same rows fall to the same side in every run."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return df.where(u >= valid_ratio), df.where(u < valid_ratio)
