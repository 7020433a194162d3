"""From measurements to cells: choose or summarise, and say how records disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by, require_unique
from .stats import tolerant_distinct


def select_records(
    df: DataFrame, keys: Sequence[str], sources: Sequence[str], value: str = "value", source: str = "source_key", tier: str = "quality_tier", sample: str = "sample_count", id_col: str = "measurement_id", check_ids: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(winners, audit). The winner of a cell: best source by precedence, then tier, then largest sample, then id.

    An unlisted source or a value that isn't in [0, 100] fails the job that reads it. With check_ids, an id held twice raises at
    once, at the price of a shuffle of all ids.
    """
    if not sources or len(sources) != len(set(sources)):
        raise ValueError("sources must be given once each")
    if check_ids:
        require_unique(df, [id_col], "measurements")
    fine = F.coalesce(F.col(source).isin(*sources) & F.col(value).between(0, 100), F.lit(False))
    told = F.concat(F.lit("a source without precedence or a value out of bounds: "), F.to_json(F.struct(source, value, id_col)))
    rank = F.when(fine, F.array_position(F.array(*map(F.lit, sources)), F.col(source))).otherwise(F.raise_error(told).cast("long"))
    quality = F.coalesce(F.element_at(F.create_map(*(x for i, t in enumerate("ABCD") for x in (F.lit(t), F.lit(i)))), F.col(tier)), F.lit(99))
    size = F.greatest(F.coalesce(F.col(sample), F.lit(0)), F.lit(0))
    winners = first_by(df, keys, rank, quality, size.desc(), F.col(id_col))
    # The least of structs is the first record by the same order, found by partial aggregation: one shuffle, of a row for each
    # cell and task.
    first = F.min(F.struct(rank.alias("r"), quality.alias("q"), (-size).alias("s"), F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(value).alias("value")))
    audit = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.size(F.collect_set(source)).cast("long").alias("candidate_sources"), F.min(value).alias("low"), F.max(value).alias("high"), first.alias("_m"))
    audit = audit.withColumn("disagreement", F.col("low") != F.col("high"))
    return winners, audit.select(*keys, "candidates", "candidate_sources", "low", "high", "disagreement", F.col("_m.id").alias("selected_id"), F.col("_m.source").alias("selected_source"), F.col("_m.value").alias("selected_value"))


def summarise(df: DataFrame, keys: Sequence[str], value: str = "value", source: str = "source_key") -> DataFrame:
    """Counts, bounds, median, span relative to it (infinite over a zero median), distinct values within tolerance, status."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"), F.min(value).alias("low"), F.median(value).alias("median"), F.max(value).alias("high"), tolerant_distinct(F.collect_list(value)).alias("distinct_values"),
    )
    span = F.when(F.col("median") != 0, (F.col("high") - F.col("low")) / F.abs("median")).when(F.col("high") > F.col("low"), float("inf")).otherwise(0.0)
    status = F.when((F.col("sources") > 1) & (F.col("distinct_values") > 1), "disagreement").when(F.col("sources") > 1, "same_value").otherwise("single_source")
    return out.withColumn("span", span).withColumn("status", status)


def collisions(df: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 0.05) -> DataFrame:
    """keys, n, value: the median where (max - min) / max is within tolerance, else null; resolved says which."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_a"), F.max(value).alias("_b"), F.median(value).alias("_m"))
    fine = F.when(F.col("_b") == 0, F.lit(True)).otherwise((F.col("_b") - F.col("_a")) / F.col("_b") <= tolerance)
    return out.select(*keys, "n", F.when(fine, F.col("_m")).alias("value"), fine.alias("resolved"))


def agree_or_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str = "value", tolerance: float = 0.05) -> DataFrame:
    """keys, value, rule: the median where records agree, else the first record's value by order."""
    agreed = collisions(df, keys, value, tolerance)
    first = first_by(df, keys, *order).select(*keys, F.col(value).alias("_first"))
    return agreed.join(first, list(keys)).select(*keys, F.when(F.col("resolved"), F.col("value")).otherwise(F.col("_first")).alias("value"), F.when(F.col("resolved"), "agreement").otherwise("priority").alias("rule"))


def nested_median(df: DataFrame, levels: Sequence[Sequence[str]], value: str = "value") -> DataFrame:
    """Median of medians: by the first level's keys, then of those by the next's, and so on."""
    out = df
    for keys in levels:
        out = out.groupBy(*keys).agg(F.median(value).alias("_m"), F.count(F.lit(1)).alias("members")).withColumnRenamed("_m", value)
    return out


def summary(df: DataFrame, axis: str, source: str, value: str = "value") -> DataFrame:
    """Statistics of each axis, overall (source null, level `axis`) and by source, in one pass over grouping sets."""
    return df.sparkSession.sql(
        f"""SELECT {axis}, {source}, CASE WHEN grouping({source}) = 1 THEN 'axis' ELSE 'source' END AS level, count(*) AS n, count_if({value} = 0) AS zeros, count_if({value} > 0) AS positives,
                   min({value}) AS low, percentile({value}, 0.25) AS q1, median({value}) AS median, percentile({value}, 0.75) AS q3, max({value}) AS high, avg({value}) AS mean, stddev_samp({value}) AS sd
            FROM {{rows}} GROUP BY GROUPING SETS (({axis}), ({axis}, {source}))""",
        rows=df,
    )


def capability_coverage(df: DataFrame, axis: str, source: str, item: str) -> DataFrame:
    """axis, observed items, capable items (of sources that report the axis at all), coverage."""
    observed = df.groupBy(axis).agg(F.countDistinct(item).alias("observed"))
    capable = df.select(axis, source).distinct().join(df.select(source, item).distinct(), source).groupBy(axis).agg(F.countDistinct(item).alias("capable"))
    return observed.join(capable, axis).withColumn("coverage", F.col("observed") / F.col("capable"))


def training_role(coverage: Column, observed: Column, least: int = 100, share: float = 0.02) -> Column:
    return F.when((observed >= least) & (coverage >= share), "train_and_evaluate").when(observed >= least, "train_only").otherwise("insufficient_support")


def equal_source_weights(df: DataFrame, cell: Sequence[str], source: str, profile: str) -> DataFrame:
    """df with weight 1 / (sources of the cell x profiles of the source in it x records of the profile in it)."""
    sources = df.groupBy(*cell).agg(F.countDistinct(source).alias("_s"))
    profiles = df.groupBy(*cell, source).agg(F.countDistinct(profile).alias("_p"))
    records = F.count(F.lit(1)).over(Window.partitionBy(*cell, source, profile))
    out = df.join(sources, list(cell)).join(profiles, [*cell, source]).withColumn("weight", 1 / (F.col("_s") * F.col("_p") * records))
    return out.drop("_s", "_p")
