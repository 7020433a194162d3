"""Admission: ordered reasons, the first or the last of which holds, flags that all hold, and support to a fixed point."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    return F.coalesce(*(F.when(c, F.lit(r)) for c, r in rules), F.lit(otherwise).cast("string"))


def last_reason(rules: Sequence[tuple[Column, str]], guarded: tuple[Column, str] | None = None) -> Column:
    """The last rule that holds; `guarded` only where none does."""
    return first_reason([*reversed(rules), *([guarded] if guarded else [])])


def all_flags(rules: Sequence[tuple[Column, str]], sep: str = ";") -> Column:
    return F.concat_ws(sep, *(F.when(c, F.lit(r)) for c, r in rules))


def mass_eligible(value: Column, status: Column, censored: Column, ranged: Column, factor: Column, basis: Column, fresh: str) -> Column:
    """Observed or explicitly zero, not negative, uncensored, not a range, exactly convertible, per fresh weight. Null is no."""
    return F.coalesce(value.isNotNull() & (value >= 0) & status.isin("observed", "explicit_zero") & ~censored & ~ranged & factor.isNotNull() & (basis == fresh), F.lit(False))


def training_gate(df: DataFrame, layers: Sequence[str] = ("primary_reference", "locked_source_validation"), curated: str = "curated_reference_training") -> DataFrame:
    """df with eligible, strict and exclusion_reason (kept where it was given): strict needs independent evidence, tier A or B and
    a reference layer; curated records need tier C and evidence."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    numeric, independent = yes(F.col("main_value_eligible")), yes(F.col("independent_evidence"))
    tier, layer = yes(F.col("quality_tier").isin("A", "B")), yes(F.col("data_layer").isin(*layers))
    strict = independent & tier & layer
    own = yes((F.col("data_layer") == curated) & (F.col("quality_tier") == "C") & (F.coalesce("quality_evidence", F.lit("")) != ""))
    eligible = numeric & (strict | own)
    reason = first_reason(
        [(F.col("value_status") == "invalid_mass_fraction_above_100", "mass_fraction_exceeds_100_g_per_100_g"), (~independent, "non_independent_or_derived_value"), (~tier, "insufficient_value_level_quality"), (~layer, "non_primary_data_layer")]
    )
    kept = F.coalesce(F.when(F.trim("exclusion_reason") != "", F.col("exclusion_reason")), F.when(~eligible, reason))
    return df.withColumn("exclusion_reason", kept).withColumn("strict", numeric & strict).withColumn("eligible", eligible)


def quarantine(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that no rule meets, the others with the first one's reason)."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def supported(df: DataFrame, item: str, axis: str, items_per_axis: int, axes_per_item: int, materialize, rounds: int = 100) -> DataFrame:
    """The distinct (item, axis) left when axes of few items and items of few axes go until none do. Each round is a table."""
    live = materialize(df.select(item, axis).distinct())
    n = live.count()
    for _ in range(rounds):
        axes = live.groupBy(axis).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= items_per_axis).select(axis)
        kept = live.join(axes, axis, "left_semi")
        items = kept.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= axes_per_item).select(item)
        live = materialize(kept.join(items, item, "left_semi"))
        before, n = n, live.count()
        if n == before:
            break
    return live


def checks(*parts: tuple[str, str, DataFrame, str]) -> DataFrame:
    """check_id, severity, observed, passed, requirement: one row for each (id, severity, one-row count, requirement); a check
    passes if its count of violations is 0. Nothing is collected."""
    rows = [df.select(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), F.col(df.columns[0]).cast("long").alias("observed"), (F.col(df.columns[0]) == 0).alias("passed"), F.lit(r).alias("requirement")) for i, s, df, r in parts]
    return reduce(DataFrame.unionByName, rows)


def release_allowed(result: DataFrame) -> bool:
    return result.where("severity = 'critical' AND NOT passed").isEmpty()
