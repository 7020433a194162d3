"""Tables for models: features of named contents, long and wide, and masked targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_label_key, blank_to_null, slug
from .relational import require_unique


def features(facts: DataFrame, item: str, source: str, value: str, names: DataFrame, prefix: str, least: int = 1, fallback: str | None = None) -> DataFrame:
    """(item, feature, value): the mean of an item's values of a feature, which is prefix and the slug of its source's name.

    names: (source, name), one row each. A source without a name takes fallback's, and goes without one where fallback is null or
    blank; without fallback it is an error. Names of fewer than least items go. Slugs that several sources share take their ids.
    """
    rows = facts.where(F.col(value).isNotNull()).join(require_unique(names, [source], "names"), source, "left")
    if fallback is None:
        lost = rows.where(F.col("name").isNull()).select(source).distinct()
        if not lost.isEmpty():
            raise ValueError("contents of sources without a name")
    else:
        rows = rows.withColumn("name", F.coalesce("name", blank_to_null(F.trim(fallback)))).where(F.col("name").isNotNull())
    common = rows.groupBy("name").agg(F.countDistinct(item).alias("_n")).where(F.col("_n") >= least).select("name")
    named = rows.join(common, "name", "left_semi").withColumn("feature", F.concat(F.lit(prefix), slug(F.col("name"))))
    # a source with several recovered names counts once for each slug
    sharing = named.select(source, "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("_s"))
    named = named.join(sharing, "feature").withColumn("feature", F.when(F.col("_s") > 1, F.concat("feature", F.lit("__id"), F.col(source).cast("string"))).otherwise(F.col("feature")))
    return named.groupBy(item, "feature").agg(F.avg(value).alias("value"))


def wide(long: DataFrame, item: str, most: int = 10_000) -> DataFrame:
    """A row for each item and a column for each feature, in order; an error above `most` features, whose names come to the driver."""
    found = sorted(r[0] for r in long.select("feature").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} features; keep the table long")
    return long.groupBy(item).pivot("feature", found).agg(F.first("value"))


def targets(table: DataFrame, columns: Sequence[str], suffix: str = "_pct") -> DataFrame:
    """For each column its share (percent columns / 100), as log1p, 0 where missing, and <column>_mask. Fails, when it runs, at negatives."""
    def share(c: str) -> Column:
        x = F.col(c).cast("double") / (100.0 if c.endswith(suffix) else 1.0)
        return F.when(F.isnan(x) | x.isNull(), 0.0).when(x < 0, F.raise_error(F.lit(f"negative target in {c}")).cast("double")).otherwise(F.log1p(x))

    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return table.withColumns({c: share(c) for c in columns} | {f"{c}_mask": known(c) for c in columns})


def word_weights(df: DataFrame, id_col: str, label: Column) -> DataFrame:
    """id_col, word, weight: each label's words by count times ln((1 + labels) / (1 + labels with it)) + 1, scaled to length one.
    The sparse matrix stays long; the number of labels is one row."""
    words = df.select(id_col, F.explode(F.split(ascii_label_key(label), " ")).alias("word")).where("word <> ''").groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("_tf"))
    holding = words.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    every = words.agg(F.countDistinct(id_col).alias("_n"))
    weighed = words.join(holding, "word").join(F.broadcast(every)).withColumn("_w", F.col("_tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    return weighed.select(id_col, "word", (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))).alias("weight"))
