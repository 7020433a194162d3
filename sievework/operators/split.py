"""Splits, masks and weights without leaks: by hash, by group, never by chance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_bucket, hash_fraction, hash_order


def group_split(df: DataFrame, group: Column, share: float = 0.15) -> DataFrame:
    """df with partition: validation for groups of hash below share, all rows of a group alike."""
    return df.withColumn("partition", F.when(hash_fraction(group) < share, "validation").otherwise("train"))


def folds(df: DataFrame, key: Column, n: int = 5) -> DataFrame:
    return df.withColumn("cv_fold", hash_bucket(key, n))


def stratified(df: DataFrame, stratum: str, key: str, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """df with partition by hash rank within the stratum."""
    place = (F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key)), key)) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(stratum))
    bounds, upto = [], 0.0
    for name, share in shares[:-1]:
        upto += share
        bounds.append((name, upto))
    out = F.lit(shares[-1][0])
    for name, upto in reversed(bounds):
        out = F.when(place <= upto + 1e-12, name).otherwise(out)
    return df.withColumn("partition", out)


def sample_for_review(df: DataFrame, risky: Column, key: Column, one_in: int = 10) -> DataFrame:
    """All risky rows and every one_in-th other, by hash."""
    return df.where(risky | (hash_bucket(key, one_in) == 0))


def first_fit(sizes: Iterable[tuple[str, int]], target: int, smallest: int = 1) -> tuple[list[str], int]:
    """Of families in order with their sizes, each taken that still fits; and how much of the target stays empty. Reads no further
    than until less is left than the smallest family has."""
    taken, room = [], target
    for name, size in sizes:
        if size <= room:
            taken.append(name)
            room -= size
        if room < smallest:
            break
    return taken, room


def holdout_families(sizes: Iterable[tuple[str, int]], target: int) -> list[str]:
    """first_fit() where it fills the target exactly; else an error."""
    taken, room = first_fit(sizes, target)
    if room:
        raise ValueError(f"hash order leaves {room} of {target} unfilled")
    return taken


def family_holdout(df: DataFrame, family: str, target: int, exact: bool = True) -> DataFrame:
    """df with partition and unfilled. Families are put in hash order by Spark and read one by one until no other fits, so the driver
    holds only those taken, which meet the rows by a join. Families are never split: exact, a target that whole families in this
    order don't fill is an error; else unfilled says by how much."""
    counted = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    smallest = counted.agg(F.min("n")).first()[0] or 1
    sizes = counted.orderBy(hash_order(F.col(family).cast("string")), family)
    chosen, room = first_fit(((r[family], r["n"]) for r in sizes.toLocalIterator()), target, smallest)
    if room and exact:
        raise ValueError(f"hash order leaves {room} of {target} unfilled")
    return _placed(df, family, chosen, "validation", "train").withColumn("unfilled", F.lit(room).cast("long"))


def _placed(df: DataFrame, key: str, chosen: Sequence, inside: str, outside: str) -> DataFrame:
    """df with partition, by whether a row's key is among those chosen."""
    kind = df.schema[key].dataType.simpleString()
    named = df.sparkSession.createDataFrame([(c,) for c in chosen], f"_c {kind}").withColumn("_in", F.lit(True))
    return df.join(named, F.col(key) == F.col("_c"), "left").withColumn("partition", F.when(F.col("_in"), inside).otherwise(outside)).drop("_c", "_in")


def cover_groups(support: dict[str, dict[str, int]], totals: dict[str, int], least_test: int, least_train: int) -> list[str]:
    """Groups for a test side that gives each axis least_test items where it can and leaves it least_train; greedy by how much
    of what is missing a group gives, ties by name. support: group to axis to items; totals: axis to items."""
    chosen: list[str] = []
    have = dict.fromkeys(totals, 0)
    open_groups = set(support)
    while open_groups:
        def gain(g: str) -> int:
            return sum(min(n, max(0, least_test - have[a])) for a, n in support[g].items())

        fits = [g for g in open_groups if all(totals[a] - have[a] - n >= least_train for a, n in support[g].items())]
        best = min(fits, key=lambda g: (-gain(g), g), default=None)
        if best is None or not gain(best):
            break
        chosen.append(best)
        open_groups.remove(best)
        for a, n in support[best].items():
            have[a] += n
    return chosen


def test_cover(df: DataFrame, group: str, axis: str, item: str, least_test: int, least_train: int, most: int = 1_000_000) -> DataFrame:
    """df with partition test or train. Counts by group and axis come to the driver, as each choice depends on those before; over
    `most` of them are an error."""
    counts = df.groupBy(group, axis).agg(F.countDistinct(item).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"over {most} counts of groups and axes")
    support: dict[str, dict[str, int]] = {}
    totals: dict[str, int] = {}
    for r in counts:
        support.setdefault(r[group], {})[r[axis]] = r["n"]
        totals[r[axis]] = totals.get(r[axis], 0) + r["n"]
    chosen = cover_groups(support, totals, least_test, least_train)
    return _placed(df, group, chosen, "test", "train")


def family_masks(cells: DataFrame, item: str, family: str, visibilities: Sequence[float] = (0.1, 0.3, 0.5, 0.7)) -> DataFrame:
    """item, visibility, hidden (sorted families): of an item's families, those whose cell counts sum nearest to what is to be
    hidden (of equal ones the smaller sum), never all. Subset sums by item."""
    counts = cells.groupBy(item, family).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(family).cast("string").alias("f"), "n"))).alias("parts"))
    kind = cells.schema[item].dataType.simpleString()

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, shown, hidden = [], [], []
            for at, parts in enumerate(batch.column("parts").to_pylist()):
                total, reach = sum(p["n"] for p in parts), {0: ()}
                for p in parts:
                    for s, names in list(reach.items()):
                        reach.setdefault(s + p["n"], (*names, p["f"]))
                sums = [s for s in reach if 0 < s < total]
                for v in visibilities if sums else ():
                    place.append(at)
                    shown.append(v)
                    hidden.append(sorted(reach[min(sums, key=lambda s: (abs(s - total * (1 - v)), s))]))
            yield pa.RecordBatch.from_arrays([batch.column(item).take(pa.array(place, pa.int64())), pa.array(shown, pa.float64()), pa.array(hidden, pa.list_(pa.string()))], [item, "visibility", "hidden"])

    return rows.mapInArrow(hide, f"{item} {kind}, visibility double, hidden array<string>")


def leave_one_family_out(cells: DataFrame, item: str, family: str) -> DataFrame:
    """item, hidden_family, cells left visible and hidden: one job for each family of an item with others beside it."""
    jobs = cells.groupBy(item, family).agg(F.count(F.lit(1)).alias("hidden"))
    w = Window.partitionBy(item)
    return jobs.withColumn("visible", F.sum("hidden").over(w) - F.col("hidden")).where("visible > 0").withColumnRenamed(family, "hidden_family")


def sequential_masks(cells: DataFrame, item: str, axis: str, share: float = 0.5, most: int = 5) -> DataFrame:
    """item, axis, step: the first ceil(share n) axes of an item in hash order, `most` at most."""
    w = Window.partitionBy(item)
    rows = cells.select(item, axis).distinct().withColumn("step", F.row_number().over(w.orderBy(hash_order(F.concat_ws("|", item, axis)), axis))).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("step") <= F.least(F.ceil(F.col("_n") * share), F.lit(most))).drop("_n")


def hidden_family(cells: DataFrame, item: str, family: str) -> DataFrame:
    """item, family of least hash with the item."""
    return cells.select(item, family).distinct().groupBy(item).agg(F.min_by(family, hash_order(F.concat_ws("|", item, family))).alias("hidden_family"))
