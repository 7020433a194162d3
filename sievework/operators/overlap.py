"""What sources have in common: axes by code and by name, items by name, and how far units convert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import mass_factor
from .gates import first_reason

_joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";")


def shared_axes(axes: DataFrame, source: str, code: str, name: Column, axis: str) -> DataFrame:
    """basis, key, sources, axes: official codes of two sources or more, and names that are so only among axes without a code in
    that way. A name is a candidate, never a merge. axis is unique within its source."""
    known = F.nullif(F.upper(F.trim(code)), F.lit(""))
    rows = axes.select(source, axis, known.alias("_code"), F.nullif(name, F.lit("")).alias("_name"))

    def several(df: DataFrame, key: str, basis: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.countDistinct(source).alias("sources"), _joined(axis).alias("axes")).where("sources > 1").select(F.lit(basis).alias("basis"), "key", "sources", "axes")

    by_code = several(rows, "_code", "official_code")
    rest = rows.join(by_code.select(F.col("key").alias("_code")), "_code", "left_anti")
    return by_code.union(several(rest, "_name", "name_candidate"))


def name_overlap(items: DataFrame, source: str, key: Column) -> DataFrame:
    """a, b, shared: how many names each two sources share. Sources meet within a name once each, however many items bear it."""
    one = items.select(source, key.alias("_k")).where(F.col("_k") != "").distinct()
    pairs = one.select(F.col(source).alias("a"), "_k").join(one.select(F.col(source).alias("b"), "_k"), "_k").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def unit_compatibility(facts: DataFrame, axis: str, unit: str) -> DataFrame:
    """axis, rows, units (joined), convertible (rows), status. Each distinct pair of axis and unit is looked at once."""
    pairs = facts.groupBy(axis, unit).agg(F.count(F.lit(1)).alias("_n"))
    fits = F.coalesce(mass_factor(F.col(unit)).isNotNull(), F.lit(False))
    out = pairs.groupBy(axis).agg(F.sum("_n").alias("rows"), _joined(unit).alias("units"), F.sum(F.when(fits, F.col("_n")).otherwise(0)).alias("convertible"))
    status = first_reason([(F.col("convertible") == F.col("rows"), "all_exact_mass"), (F.col("convertible") == 0, "no_exact_mass")], "mixed_units_review")
    return out.withColumn("status", status)


def core_coverage(facts: DataFrame, item: str, axis: str, source: str, value: str, axes: Sequence[str], tolerance: float = 0.05, least: int = 100) -> DataFrame:
    """axis, items, conflicting, sources, status for each of axes, those that nobody reports too. An item counts if its source's values
    lie within tolerance of the largest; else it conflicts, and counts for neither side."""
    cells = facts.where(F.col(axis).isin(*axes) & F.col(value).isNotNull()).groupBy(axis, source, item).agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    agreed = (F.col("_h") == F.col("_l")) | ((F.col("_h") - F.col("_l")) <= tolerance * F.col("_h"))
    found = cells.groupBy(axis).agg(F.countDistinct(F.when(agreed, F.col(item))).alias("items"), F.count_if(~agreed).alias("conflicting"), F.countDistinct(F.when(agreed, F.col(source))).alias("sources"))
    every = facts.sparkSession.createDataFrame([(a,) for a in axes], f"{axis} string")
    out = every.join(found, axis, "left").fillna(0, ["items", "conflicting", "sources"])
    return out.withColumn("status", first_reason([(F.col("items") == 0, "not_reported"), (F.col("items") < least, "insufficient_items"), (F.col("sources") == 1, "single_source")], "covered"))


def axis_roles(facts: DataFrame, axis: str, item: str, source: str, value: str, held: Sequence[str], least_train: int, least_test: int) -> DataFrame:
    """axis, items, positive, zero, spread of log1p, remaining (items outside held sources), tested (in them) and a role. Items
    count once, and by the sign of any of their values."""
    v, outside = F.col(value), ~F.col(source).isin(*held)
    one = facts.where(v.isNotNull()).groupBy(axis, item).agg(F.max(v > 0).alias("_p"), F.max(v == 0).alias("_z"), F.max(outside).alias("_o"), F.max(~outside).alias("_i"), F.avg(v).alias("_v"))
    out = one.groupBy(axis).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("_p").alias("positive"), F.count_if("_z").alias("zero"), F.stddev_pop(F.log1p("_v")).alias("spread"), F.count_if("_o").alias("remaining"), F.count_if("_i").alias("tested"),
    )
    return out.withColumn("role", first_reason([(F.col("spread") <= 1e-8, "constant"), (F.col("remaining") < least_train, "context_only"), (F.col("tested") < least_test, "train_only")], "train_and_test"))
