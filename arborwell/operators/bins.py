"""Cut points, feature metadata and bins over cells (fid, value). Values are present cells only; NaN raises."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def nnz(cells: DataFrame) -> DataFrame:
    return cells.groupBy("fid").agg(F.count("value").alias("nnz"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def value_counts(cells: DataFrame) -> DataFrame:
    """fid, value, n: what every later step reads; combined before the shuffle, so repeated values cost nothing."""
    return cells.groupBy("fid", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_probe(counts: DataFrame, threshold: int = 32) -> DataFrame:
    """fid, n_distinct, is_categorical."""
    d = counts.groupBy("fid").agg(F.count(F.lit(1)).alias("n_distinct"))
    return d.withColumn("is_categorical", F.col("n_distinct") <= threshold)


def _ranked(counts: DataFrame) -> DataFrame:
    """counts with the ranks lo..hi-1 of each value among total cells of its feature.

    Running counts go through value ranges, so one feature with very many values is many window partitions.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = counts.repartitionByRange(parts, "fid", "value").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "fid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = cut(d.withColumn("upto", F.sum("n").over(inside)))  # both uses below see the same ranges
    totals = d.groupBy("fid", "part").agg(F.sum("n").alias("pn"))
    before = Window.partitionBy("fid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("fid").alias("tf"), F.col("part").alias("tp"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("base"), F.sum("pn").over(Window.partitionBy("fid")).alias("total"))
    d = d.join(totals, (F.col("fid") == F.col("tf")) & (F.col("part") == F.col("tp")))
    hi = F.col("base") + F.col("upto")
    return d.select("fid", "value", (hi - F.col("n")).alias("lo"), hi.alias("hi"), "total")


def exact_cuts(counts: DataFrame, num_split: int) -> DataFrame:
    """fid, idx, cut: the item at rank (n * i) div num_split for i in 0..num_split-1, equal cuts once."""
    d = _ranked(counts)
    # i with lo <= (total * i) div q < hi, that is ceil(lo q / total) <= i < ceil(hi q / total)
    first = (F.col("lo") * num_split + F.col("total") - 1) / F.col("total")
    last = (F.col("hi") * num_split + F.col("total") - 1) / F.col("total")
    d = d.where(F.floor(first) < F.least(F.floor(last), F.lit(num_split)))
    return d.select("fid", (F.row_number().over(Window.partitionBy("fid").orderBy("value")) - 1).alias("idx"), F.col("value").alias("cut"))


def quantiles_at(counts: DataFrame, fractions: list[float]) -> DataFrame:
    """fid, fraction, value: the item at rank floor(n * fraction); 0 gives the smallest, 1 the largest."""
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie in [0, 1]")
    rank = lambda f: F.least(F.floor(F.col("total") * f), F.col("total") - 1)
    here = F.filter(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: (rank(f) >= F.col("lo")) & (rank(f) < F.col("hi")))
    return _ranked(counts).select("fid", F.explode(here).alias("fraction"), "value")


def kll_cuts(cells: DataFrame, num_split: int, k: int = 2048) -> DataFrame:
    """As exact_cuts from a mergeable sketch, whose ranks are off by about 1.8 / k ** 0.9 of the cells (0.2 %): one row per feature and partition is all that is shuffled."""
    ranks = F.array(*[F.lit(i / num_split) for i in range(num_split)])  # the function wants constants
    s = cells.groupBy("fid").agg(F.expr(f"kll_sketch_agg_double(value, {k})").alias("s"), F.min("value").alias("low"))
    found = F.slice(F.call_function("kll_sketch_get_quantile_double", F.col("s"), ranks), 2, num_split)
    cuts = s.select("fid", F.array_distinct(F.concat(F.array("low"), found)).alias("c"))  # the first cut is the smallest value
    return cuts.select("fid", F.posexplode("c").alias("idx", "cut"))


def feature_info(counts: DataFrame, cuts: DataFrame, threshold: int = 32) -> DataFrame:
    """fid, is_categorical, splits, num_bin, default_bin, nnz. Categorical: one bin per value and one for absent cells."""
    probe = distinct_probe(counts, threshold)
    values = counts.join(probe.where("is_categorical").select(F.col("fid").alias("pf")), F.col("fid") == F.col("pf"), "left_semi")
    values = values.groupBy("fid").agg(F.array_sort(F.collect_list("value")).alias("vals"))  # threshold values at most
    numeric = cuts.groupBy("fid").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    n = counts.groupBy("fid").agg(F.sum("n").alias("nnz"))
    d = n.join(probe, "fid").join(numeric, "fid").join(values, "fid", "left")
    splits = F.when(F.col("is_categorical"), F.col("vals")).otherwise(F.col("cuts"))
    d = d.withColumn("splits", splits)
    return d.select(
        "fid", "is_categorical", "splits",
        (F.size("splits") + F.col("is_categorical").cast("int")).alias("num_bin"),
        F.when(F.col("is_categorical"), F.size("splits")).otherwise(bin_of(F.col("splits"), F.lit(0.0))).cast("int").alias("default_bin"),
        "nnz",
    )


def bin_of(splits: Column, x: Column) -> Column:
    """(number of splits <= x) - 1, at least 0."""
    return F.greatest(F.size(F.filter(splits, lambda c: c <= x)) - 1, F.lit(0))


def feature_groups(info: DataFrame, groups: int) -> DataFrame:
    """fid, rr_group, balanced_group, even_group: by fid, by number of cells, and by contiguous ranges. One row per feature."""
    r = F.row_number().over(Window.orderBy("nnz", "fid")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    d = info.select("fid", r.alias("r"), n.alias("n"))
    rr = F.pmod("fid", F.lit(groups))
    width = F.when((F.col("n") % groups) > F.col("n") / 2, F.ceil(F.col("n") / groups)).otherwise(F.greatest(F.floor(F.col("n") / groups), F.lit(1)))
    return d.select("fid", rr.cast("int").alias("rr_group"), F.when(F.col("r") < F.floor(F.col("n") / 2), rr).otherwise(groups - 1 - rr).cast("int").alias("balanced_group"), F.least(F.floor(F.col("fid") / width), F.lit(groups - 1)).cast("int").alias("even_group"))


def bin_columns(df: DataFrame, features: list[str], info: dict[int, dict], keep: list[str]) -> DataFrame:
    """keep and b0..: bins of wide rows, by binary search in Arrow batches. info: fid -> row of feature_info; others get bin 0."""
    tables = [(np.array(info[k]["splits"], dtype=np.float64), info[k]["default_bin"], info[k]["is_categorical"]) if k in info else None for k in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(i) for i in range(len(keep))]
            for k, t in enumerate(tables):
                x = b.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(np.float64)
                if t is None:
                    out.append(pa.array(np.zeros(len(x), dtype=np.int32)))
                    continue
                splits, default, categorical = t
                at = np.maximum(np.searchsorted(splits, x, side="right") - 1, 0)
                absent = np.isnan(x) | (x == 0)
                if categorical:  # a value that training did not see counts as absent
                    absent |= splits[at] != x
                out.append(pa.array(np.where(absent, default, at).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *[f"b{k}" for k in range(len(tables))]])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"b{k} int" for k in range(len(features))])
    return df.select(*keep, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)]).mapInArrow(run, schema)


def grouped_rows(cells: DataFrame, info: DataFrame, groups: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The layout by feature groups for wide tables: ins_id, grp, keep, fids array<smallint>, bins array<smallint>, dealt by group.

    cells: ins_id, fid, value (and keep); groups: fid, grp, place (a feature's number inside its group). A group's rows hold only its
    present cells, binned, so a task of a group reads no other feature; absent cells stay in the default bin (see histogram.fill_default).
    """
    meta = info.join(groups, "fid").select("fid", "splits", "grp", "place")  # one row per feature
    c = cells.join(F.broadcast(meta), "fid")
    cell = F.struct(F.col("place").cast("smallint").alias("fid"), bin_of(F.col("splits"), F.col("value")).cast("smallint").alias("bin"))
    rows = c.groupBy("grp", "ins_id", *keep).agg(F.array_sort(F.collect_list(cell)).alias("c"))  # a row's cells in one group
    return rows.select("ins_id", "grp", *keep, F.col("c.fid").alias("fids"), F.col("c.bin").alias("bins"))


def dense_groups(info: DataFrame, count: int, kind: str = "balanced_group") -> DataFrame:
    """fid, grp, place: feature_groups() with features numbered inside their group. One row per feature."""
    g = feature_groups(info, count).select("fid", F.col(kind).alias("grp"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("fid")) - 1)
