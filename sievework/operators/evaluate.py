"""Metrics, skill, intervals and simple baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import average_rank


def regression_metrics(df: DataFrame, keys: Sequence[str], true: str, predicted: str) -> DataFrame:
    """By key: n, MAE, MSE, RMSE, R2 (null for constant truth), Spearman's correlation, quartiles of the truth."""
    rows = df.where(F.col(true).isNotNull() & F.col(predicted).isNotNull())
    rows = rows.withColumn("_rt", average_rank(true, keys)).withColumn("_rp", average_rank(predicted, keys))
    err = F.col(predicted) - F.col(true)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(true).alias("_v"), F.corr("_rt", "_rp").alias("spearman"),
        F.min(true).alias("low"), F.percentile(F.col(true), 0.25).alias("q1"), F.median(true).alias("median"), F.percentile(F.col(true), 0.75).alias("q3"), F.max(true).alias("high"),
    )
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))).drop("_v")


def macro(metrics: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Means over axes, of all and of each group."""
    every = metrics.agg(F.lit("all").alias("scope"), F.count(F.lit(1)).alias("axes"), *(F.avg(c).alias(c) for c in columns))
    if group is None:
        return every
    return every.unionByName(metrics.groupBy(F.col(group).cast("string").alias("scope")).agg(F.count(F.lit(1)).alias("axes"), *(F.avg(c).alias(c) for c in columns)))


def skill(df: DataFrame, keys: Sequence[str], true: str, predicted: str, baseline: str, tail: Column) -> DataFrame:
    """By key: 1 - MAE / the baseline's MAE, and the MAE of rows in the tail."""
    own, base = F.abs(F.col(predicted) - F.col(true)), F.abs(F.col(baseline) - F.col(true))
    out = df.groupBy(*keys).agg(F.avg(own).alias("mae"), F.avg(base).alias("baseline_mae"), F.avg(F.when(tail, own)).alias("tail_mae"))
    return out.withColumn("skill", F.when(F.col("baseline_mae") > 0, 1 - F.col("mae") / F.col("baseline_mae")))


def masked_mse(df: DataFrame, keys: Sequence[str], true: str, predicted: str, mask: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(mask) * (F.col(true) - F.col(predicted)) ** 2) / (F.sum(mask) + 1e-8)).alias("masked_mse"))


def _weights(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """How often each replicate draws each cluster: by a Poisson law of mean one, from the cluster's hash and the replicate."""
    x = clusters.view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    chances = np.exp(-1) / np.cumprod(np.maximum(1, np.arange(9)))
    return np.searchsorted(np.cumsum(chances), (x ^ (x >> np.uint64(31))) / 2.0**64, side="right").astype(float)


def cluster_interval(df: DataFrame, cluster: str, axis: str, error: str, replicates: int = 200, seed: str = "b") -> DataFrame:
    """low, high: 95 % interval of the macro mean error, clusters drawn again with Poisson weights by hash.

    Rows are first summed by cluster and axis; a task multiplies its sums by their clusters' weights of all replicates at once, and
    returns a row of sums for each of its batches' axes, so replicates multiply neither rows nor hashes.
    """
    sums = df.groupBy(cluster, axis).agg(F.sum(error).cast("double").alias("e"), F.count(F.lit(1)).cast("double").alias("n"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("axis").dictionary_encode()
            place, e, n = coded.indices.to_numpy(zero_copy_only=False), batch.column("e").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            w = _weights(batch.column("key").to_numpy(), replicates)
            out = np.zeros((2, len(coded.dictionary), replicates))
            np.add.at(out[0], place, w * e[:, None])
            np.add.at(out[1], place, w * n[:, None])
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(list(x), pa.list_(pa.float64())) for x in out)], ["axis", "we", "wn"])

    keyed = sums.where("e IS NOT NULL").select(F.col(axis).cast("string").alias("axis"), F.xxhash64(F.lit(seed), F.col(cluster)).alias("key"), "e", "n")
    parts = keyed.mapInArrow(drawn, "axis string, we array<double>, wn array<double>").select("axis", F.posexplode(F.arrays_zip("we", "wn")).alias("rep", "s"))
    by_axis = parts.groupBy("rep", "axis").agg((F.sum("s.we") / F.nullif(F.sum("s.wn"), F.lit(0.0))).alias("_m"))
    return by_axis.groupBy("rep").agg(F.avg("_m").alias("_m")).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))


def holm(df: DataFrame, keys: Sequence[str], p: str, id_col: str) -> DataFrame:
    """df with p_adjusted: Holm's step-down, a running maximum of (tests left) x p, at most 1."""
    w = Window.partitionBy(*keys).orderBy(p, id_col)
    rank, m = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("_s", (m - rank + 1) * F.col(p))
    return rows.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_s")


def knn_predictions(neighbours: DataFrame, values: DataFrame, id_col: str, axis: str, value: str) -> DataFrame:
    """query, axis, predicted: the neighbours' mean by max(similarity, 0) + 1e-6."""
    w = F.greatest("similarity", F.lit(0.0)) + 1e-6
    rows = neighbours.join(values.select(F.col(id_col).alias("neighbour"), axis, F.col(value).alias("_v")), "neighbour")
    return rows.groupBy("query", axis).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("predicted"))


def group_mean_predictions(train: DataFrame, asked: DataFrame, group: str, axis: str, value: str) -> DataFrame:
    """asked with predicted: the group's mean on the axis, else the axis's."""
    own = train.groupBy(group, axis).agg(F.avg(value).alias("_g"))
    every = train.groupBy(axis).agg(F.avg(value).alias("_a"))
    return asked.join(own, [group, axis], "left").join(every, axis, "left").withColumn("predicted", F.coalesce("_g", "_a")).drop("_g", "_a")


@F.pandas_udf(T.DoubleType())
def _chance_of_less(n: pd.Series, plus: pd.Series, center: pd.Series, spread: pd.Series, exact: pd.Series) -> pd.Series:
    def one(n: int, plus: float, center: float, spread: float, exact: bool) -> float:
        if exact:
            ways = np.ones(1)
            for rank in range(1, int(n) + 1):
                ways = np.concatenate([ways, np.zeros(rank)]) + np.concatenate([np.zeros(rank), ways])
            return float(ways[: int(plus) + 1].sum() / ways.sum())
        return 0.5 * math.erfc((center - plus) / spread / math.sqrt(2)) if spread > 0 else 1.0

    return pd.Series([one(*row) for row in zip(n, plus, center, spread, exact)])


def signed_rank(df: DataFrame, keys: Sequence[str], difference: str, least: int = 10, most_exact: int = 50) -> DataFrame:
    """By key: n, r_plus (the rank sum of differences above zero), mean_difference and p, one-sided, that differences lie below zero.

    Zeros are ranked and then left out. Up to most_exact differences without zeros or ties the distribution is exact, else normal with
    corrections for both. p is 1 for fewer than least pairs and where no difference exceeds 1e-8. Differences are one per cluster.
    """
    rows = df.where(F.col(difference).isNotNull()).withColumn("_a", F.abs(F.col(difference))).withColumn("_r", average_rank("_a", keys))
    d, zero = F.col(difference), F.col("_a") == 0
    tied = rows.where(~zero).groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double").alias("_ties"))
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("_z"), F.sum(F.when(d > 0, F.col("_r")).otherwise(0.0)).alias("r_plus"), F.avg(d).alias("mean_difference"), F.max("_a").alias("_max"),
    )
    out = found.join(tied, list(keys), "left").fillna(0.0, ["_ties"])
    ranks = lambda c: F.col(c).cast("double") * (F.col(c) + 1)
    center = (ranks("n") - ranks("_z")) / 4
    spread = F.sqrt((ranks("n") * (2 * F.col("n") + 1) - ranks("_z") * (2 * F.col("_z") + 1) - F.col("_ties") / 2) / 24)
    exact = (F.col("n") <= most_exact) & (F.col("_z") == 0) & (F.col("_ties") == 0)
    p = F.when((F.col("n") < least) | (F.col("_max") <= 1e-8), 1.0).otherwise(_chance_of_less("n", "r_plus", center, spread, exact))
    return out.select(*keys, "n", "r_plus", "mean_difference", p.alias("p"))
