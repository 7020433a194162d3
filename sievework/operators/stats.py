"""Robust scales, distributions, weighted medians and effect pooling, all as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import running_total


def quantile(c: Column, p: float) -> Column:
    """Exact, linear between neighbours; never an approximation."""
    return F.percentile(c, F.lit(p))


def robust_scale(df: DataFrame, keys: Sequence[str], value: Column, least: float = 1e-8, log: bool = True) -> DataFrame:
    """keys, center, q1, q3, mad, scale = max(IQR / 1.349, 1.4826 MAD), degenerate (then scale is 1). Two passes."""
    rows = df.select(*keys, (F.log1p(value) if log else value).alias("_v")).where(F.col("_v").isNotNull())
    first = rows.groupBy(*keys).agg(F.median("_v").alias("center"), quantile(F.col("_v"), 0.25).alias("q1"), quantile(F.col("_v"), 0.75).alias("q3"))
    mad = rows.join(first.select(*keys, "center"), list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col("_v") - F.col("center"))).alias("mad"))
    scale = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.col("mad") * 1.4826)
    return first.join(mad, list(keys)).withColumn("degenerate", scale <= least).withColumn("scale", F.when(scale <= least, 1.0).otherwise(scale))


def positive_scale(df: DataFrame, keys: Sequence[str], value: str, least: float = 1e-4) -> DataFrame:
    """keys, center and scale of log1p of positive values: the median, and the root mean square about it, at least `least`."""
    rows = df.where(F.col(value) > 0).select(*keys, F.log1p(value).alias("_v"))
    center = rows.groupBy(*keys).agg(F.median("_v").alias("center"), F.count(F.lit(1)).alias("n"))
    out = rows.join(center, list(keys)).groupBy(*keys, "center", "n").agg(F.sqrt(F.avg((F.col("_v") - F.col("center")) ** 2)).alias("s"))
    return out.select(*keys, "n", "center", F.greatest("s", F.lit(least)).alias("scale"))


def iqr_scale(df: DataFrame, keys: Sequence[str], value: Column, least: float = 1e-3) -> DataFrame:
    """keys, q05, q25, q50, q75, q95 and scale = max(IQR, least)."""
    out = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("_q"))
    out = out.select(*keys, *(F.col("_q")[i].alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))))
    return out.withColumn("scale", F.greatest(F.col("q75") - F.col("q25"), F.lit(least)))


def distribution_profile(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Quantiles, moments, adjusted and Bowley skewness, share outside Tukey's fences, and the share of the squared deviation
    that the top hundredth of the values holds."""
    ps = {"q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    rows = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd_samp"), F.stddev_pop("_v").alias("sd_pop"), F.skewness("_v").alias("_skew"), F.percentile("_v", F.array(*map(F.lit, ps.values()))).alias("_q"))
    first = first.select("*", *(F.col("_q")[i].alias(k) for i, k in enumerate(ps))).drop("_q")
    near = rows.join(first, list(keys)).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v"))))
    square = (F.col("_v") - F.col("mean")) ** 2
    iqr = F.col("q75") - F.col("q25")
    out = near.groupBy(*keys).agg(
        F.median(F.abs(F.col("_v") - F.col("q50"))).alias("mad"),
        F.avg(((F.col("_v") < F.col("q25") - 1.5 * iqr) | (F.col("_v") > F.col("q75") + 1.5 * iqr)).cast("double")).alias("tukey_outside"),
        (F.sum(F.when(F.col("_rn") <= F.ceil(F.col("n") * 0.01), square)) / F.sum(square)).alias("top_share"),
    )
    n = F.col("n")
    adjusted = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_skew"))
    bowley = (F.col("q75") + F.col("q25") - 2 * F.col("q50")) / F.when(iqr > 0, iqr)
    return first.join(out, list(keys)).withColumn("skewness", adjusted).withColumn("bowley", bowley).withColumn("iqr", iqr).drop("_skew")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, *order: str) -> DataFrame:
    """keys, weighted_median: the first value at which the weights summed in order reach half of all."""
    own = Window.partitionBy(*keys)
    running = F.sum(weight).over(own.orderBy(value, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.select(*keys, F.col(value).alias("_v"), running.alias("_c"), F.sum(weight).over(own).alias("_t"))
    return rows.where(F.col("_c") >= 0.5 * F.col("_t")).groupBy(*keys).agg(F.min("_v").alias("weighted_median"))


def tolerant_distinct(values: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """How many values an array has, one within tolerance of the last counted being the same as it."""
    start = F.struct(F.lit(None).cast("double").alias("rep"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        new = acc.rep.isNull() | (F.abs(x - acc.rep) > atol + rtol * F.abs(acc.rep))
        return F.struct(F.when(new, x).otherwise(acc.rep).alias("rep"), (acc.n + F.when(new, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.array_sort(values), start, step, lambda acc: acc.n)


def pooled_effect(df: DataFrame, keys: Sequence[str], value: str, standard_error: Column, weight: Column, source: str, tiers: Sequence[str], tier: str) -> DataFrame:
    """One value for each key, or null where its records disagree.

    Records of the best tier count. With two or more usable standard errors: random effects on log1p (DerSimonian and Laird);
    else the median weighted by sample size. Disagreement: I2 over 0.75, or of two sources or more a ratio of largest to
    smallest over 3, or zeros beside positive values. A single record stands as it is.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(x for i, t in enumerate(tiers) for x in (F.lit(t), F.lit(i)))), F.col(tier)), F.lit(99))
    ranked = df.withColumn("_rank", rank)
    best = ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).where("_rank = _best")
    v, se = F.col(value), standard_error / (1 + F.col(value))
    w = F.when(se > 0, 1 / (se * se))
    rows = best.select(*keys, v.alias("_v"), F.log1p(v).alias("_y"), w.alias("_w"), F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1.0)).alias("_n"), F.col(source).alias("_s"))
    # The window has dealt the rows by key, so this is one shuffle of one scan. Medians hold a cell's values too.
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("_w").alias("_k"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_y")).alias("_swy"), F.sum(F.col("_w") ** 2).alias("_sw2"), F.sum("_n").alias("_sn"),
        F.size(F.collect_set("_s")).cast("long").alias("sources"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"), F.median("_v").alias("median"),
        F.sort_array(F.collect_list(F.struct("_y", "_n", "_w"))).alias("_rows"),
    )
    total = lambda f: F.aggregate("_rows", F.lit(0.0), lambda s, r: s + F.coalesce(f(r), F.lit(0.0)))
    stats = stats.withColumn("_q", total(lambda r: r["_w"] * (r["_y"] - F.col("_swy") / F.col("_sw")) ** 2))
    c = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (F.col("_q") - (F.col("_k") - 1)) / c)).otherwise(0.0)
    i2 = F.when((F.col("_k") >= 2) & (F.col("n") > 1), F.when(F.col("_q") > 0, F.greatest(F.lit(0.0), (F.col("_q") - (F.col("_k") - 1)) / F.col("_q"))).otherwise(0.0))
    stats = stats.withColumn("_tau2", tau2).withColumn("i2", i2)
    random = lambda r: 1 / (1 / r["_w"] + F.col("_tau2"))

    def reach(s: Column, r: Column) -> Column:
        """The first value at which the summed weights are half of all."""
        done = s["c"] + r["_n"]
        return F.struct(done.alias("c"), F.when(s["y"].isNull() & (done >= 0.5 * F.col("_sn")), r["_y"]).otherwise(s["y"]).alias("y"))

    middle = F.aggregate("_rows", F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("y")), reach, lambda s: s["y"])
    out = stats.withColumn("_center", F.when(F.col("_k") >= 2, total(lambda r: random(r) * r["_y"]) / total(random))).withColumn("_middle", middle)
    ratio = F.when(F.col("low") > 0, F.col("high") / F.col("low"))
    conflict = (F.col("sources") >= 2) & (F.col("low") == 0) & (F.col("high") > 0)
    review = (F.col("n") > 1) & (F.coalesce(F.col("i2") > 0.75, F.lit(False)) | F.coalesce((F.col("sources") >= 2) & (ratio > 3), F.lit(False)) | conflict)
    center = F.when(F.col("n") == 1, F.col("low")).otherwise(F.expm1(F.when(F.col("_k") >= 2, F.col("_center")).otherwise(F.col("_middle"))))
    method = F.when(F.col("n") == 1, "single_record").when(F.col("_k") >= 2, "random_effects").otherwise("weighted_median")
    return out.select(*keys, F.when(~review, center).alias("value"), F.when(review, "review").otherwise("accepted").alias("status"), method.alias("method"), "n", "sources", "mean", "median", "low", "high", "i2", ratio.alias("ratio"), conflict.alias("zero_conflict"))


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, n, share at or below it, within keys. Counts by value first, so that the running sum is over distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    out = running_total(counts, value, "n", keys)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    out = out.join(totals, list(keys)) if keys else out.crossJoin(F.broadcast(totals))  # one row
    return out.select(*keys, value, "n", (F.col("running") / F.col("_t")).alias("share"))


def average_rank(c: str, keys: Sequence[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, c)) - 1) / 2
