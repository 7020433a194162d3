"""Schemas, checked joins, first rows and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import materialize


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {missing}")
    return df


def coerce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: absent ones null, others dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that more than one row has, and how many have each; null keys count too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """df, or an error that names a key held twice: one aggregation that stops at the first."""
    found = duplicates(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{name} has a key of more than one row: {found[0].asDict()}")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose cardinality holds or raises: one_to_one, one_to_many, many_to_one or many_to_many."""
    one_left, _, one_right = validate.split("_")
    if one_left == "one":
        require_unique(left, on, "the left side")
    if one_right == "one":
        require_unique(right, on, "the right side")
    return left.join(right, list(on), how)


def outer_merge(left: DataFrame, right: DataFrame, on: str, shared: Sequence[str]) -> DataFrame:
    """A full outer join; of a shared column the left text if it isn't blank, else the right. `origin`: both, left or right."""
    l, r = left.withColumn("_l", F.lit(1)), right.select(on, *(F.col(c).alias(f"_{c}") for c in right.columns if c in shared), *(c for c in right.columns if c not in shared and c != on), F.lit(1).alias("_r"))
    out = l.join(r, on, "full_outer").withColumn("origin", F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both"))
    for c in shared:
        out = out.withColumn(c, F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")))
    return out.drop("_l", "_r", *(f"_{c}" for c in shared))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key; the order must end in something unique. Spark's window limit drops the rest before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def lookup_any(facts: DataFrame, dimension: DataFrame, pairs: Sequence[tuple[str, str]], key: str, value: str) -> DataFrame:
    """(key, value) of facts whose any pair of columns is equal: a union of equi-joins, not one join on OR."""
    parts = [facts.select(key, F.col(a).alias("_k")).join(dimension.select(F.col(b).alias("_k"), value), "_k").select(key, value) for a, b in pairs]
    return reduce(DataFrame.union, parts).distinct()


def union_aligned(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reindexed(df: DataFrame, keys: DataFrame, fill: dict[str, object]) -> DataFrame:
    """A row for each of keys, absent ones filled."""
    return keys.join(df, keys.columns, "left").fillna(fill)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "column_name", value: str = "raw_value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, names: Sequence[str], value: Column, fill: float | None = None) -> DataFrame:
    """One column for each of names; giving them spares a pass to find them."""
    out = df.groupBy(*ids).pivot(name, list(names)).agg(value)
    return out if fill is None else out.fillna(fill, list(names))


def filled_forward(df: DataFrame, keys: Sequence[str], order: str, column: str, header: Column) -> DataFrame:
    """column: the last header text at or above each row; header is null on rows of data."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(header, ignorenulls=True).over(w))


def dense_index(df: DataFrame, key: str, index: str = "index", first: int = 1) -> DataFrame:
    """The distinct keys in order, numbered: by their place in a range of keys and the sizes of the ranges before."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_total(keys, key, "_one").select(key, (F.col("running") - 1 + first).alias(index))


def running_total(counts: DataFrame, value: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """counts with running: n summed over values up to each, within keys. A window in each of many ranges of values, and the few
    ranges' own sums before it, so that no task orders all values, of a hot key either. Values are different within keys."""
    ranged = materialize(counts.repartitionByRange(value, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    before = ranged.groupBy(*keys, "_p").agg(F.sum(n).alias("_s"))
    before = before.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")).drop("_s")
    before = before.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate((*keys, "_p"))})
    own = F.sum(n).over(Window.partitionBy(*keys, "_p").orderBy(value))
    match = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate((*keys, "_p"))]
    return ranged.withColumn("_own", own).join(before, reduce(Column.__and__, match)).withColumn("running", F.col("_own") + F.col("_before")).select(*counts.columns, "running")
