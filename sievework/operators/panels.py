"""Panels of targets, canonical profiles and audits of frozen panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from .cells import summarise
from .relational import first_by, join_checked, require_unique
from .stats import pooled_effect


def finalised_panel(draft: DataFrame, name: str, family: str, synonyms: DataFrame, extension: DataFrame, version: str, undefined: Sequence[str] = ()) -> DataFrame:
    """target_axis_id, canonical_name, family, originals (joined), origin: drafts by their canonical name (synonyms: key, canonical;
    else their own), then the extension's names that are new. A name of two families, or of an undefined one, is an error, and so
    is a name that is left twice."""
    given = draft.select(F.col(name).alias("_name"), F.col(family).alias("family")).join(synonyms.select(F.col("key").alias("_name"), "canonical"), "_name", "left")
    grouped = given.groupBy(F.coalesce("canonical", "_name").alias("canonical_name")).agg(F.collect_set("family").alias("_f"), F.array_join(F.array_sort(F.collect_set("_name")), " | ").alias("originals"))
    told = lambda what: F.raise_error(F.concat(F.lit(what), F.col("canonical_name"))).cast("string")
    only = F.element_at("_f", 1)
    checked = F.when(F.size("_f") != 1, told("several families of ")).when(only.isin(*undefined) if undefined else F.lit(False), told("an undefined family of ")).otherwise(only)
    own = grouped.select("canonical_name", checked.alias("family"), "originals", F.lit("draft").alias("origin"))
    more = extension.select(F.col(name).alias("canonical_name"), F.col(family).alias("family")).join(own.select("canonical_name"), "canonical_name", "left_anti")
    out = own.unionByName(more.select("canonical_name", "family", F.lit("").alias("originals"), F.lit("extension").alias("origin")))
    require_unique(out, ["canonical_name"], "the panel")
    return out.withColumn("target_axis_id", stable_id("food_prediction_axis", F.lit(version), F.col("canonical_name")))


def canonical_profiles(
    measurements: DataFrame, foods: DataFrame, components: DataFrame, partitions: DataFrame, eligible: Column, validation: Column, holdout_source: str,
    value: str, standard_error: Column, weight: Column, source: str, tiers: Sequence[str], tier: str, food: str = "food_id", component: str = "component_id",
) -> tuple[DataFrame, DataFrame]:
    """(profiles, conflicts): one value for each concept of food and component from the records that may be labels.

    foods and components map observations to concepts (food, concept / component, concept); partitions: concept, partition,
    holdout. Outside of the training side, records must meet `validation`; of concepts held out, only the holdout source's count.
    Conflicts are the profiles that pooled_effect() leaves for review; their value is null.
    """
    rows = measurements.where(F.coalesce(eligible, F.lit(False)) & F.col(value).isNotNull())
    rows = join_checked(rows, foods.select(food, F.col("concept").alias("food_concept")), [food], "inner")
    rows = join_checked(rows, components.select(component, F.col("concept").alias("component_concept")), [component], "inner")
    rows = join_checked(rows, partitions.select(F.col("concept").alias("food_concept"), "partition", "holdout"), ["food_concept"], "inner")
    rows = rows.where((F.col("partition") == "train") | F.coalesce(validation, F.lit(False))).where(~F.col("holdout") | (F.col(source) == holdout_source))
    out = pooled_effect(rows, ["food_concept", "component_concept", "partition"], value, standard_error, weight, source, tiers, tier)
    return out, out.where("status <> 'accepted'")


def frozen_audit(panel: DataFrame, target: str, measurements: DataFrame, component: str, mapping: DataFrame, food: str, value: str, source: str, fits: Column) -> tuple[DataFrame, DataFrame]:
    """(cells, distributions): measurements on a frozen panel's targets by an exact map (component, target); each cell's counts,
    bounds and agreement, and each target's and source's quartiles. A target that the panel lacks is an error."""
    require_unique(panel, [target], "the panel")
    known = mapping.join(panel.select(target, F.lit(True).alias("_in")), target, "left")
    told = F.raise_error(F.concat(F.lit("a target outside of the panel: "), F.col(target).cast("string"))).cast("boolean")
    known = known.where(F.when(F.col("_in").isNull(), told).otherwise(F.col("_in"))).select(component, target)
    rows = join_checked(measurements, known, [component], "inner").where(F.coalesce(fits, F.lit(False)))
    quartiles = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    spread = rows.groupBy(target, source).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(food).alias("foods"), F.min(value).alias("low"), quartiles.alias("_q"), F.max(value).alias("high"))
    spread = spread.select(target, source, "n", "foods", "low", *(F.col("_q")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))), "high")
    return summarise(rows, [food, target], value, source), spread


def imported_components(measurements: DataFrame, id_col: str, component: str, original: str, imported: Column, registry: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """(measurements, components): records imported under another database's numbers get a component of their own for each
    component and number that the registry knows, whichever id the importer gave them; original_component keeps that one. An
    ambiguous number is an error. components: component, parent, number."""
    require_unique(registry, [number], "the registry of numbers")
    known = registry.select(F.col(number).cast("string").alias("_n"), F.lit(True).alias("_known"))
    rows = measurements.withColumn("_n", F.when(imported, F.col(original).cast("string"))).join(known, "_n", "left")
    own = F.when(F.col("_known"), stable_id("compobs", F.col(component).cast("string"), F.lit("original_number"), F.col("_n")))
    rows = rows.withColumn("original_component", F.col(component)).withColumn(component, F.coalesce(own, F.col(component).cast("string")))
    made = rows.where("_known").select(component, F.col("original_component").alias("parent"), F.col("_n").alias("number")).distinct()
    return rows.drop("_n", "_known"), made


def composition_checks(values: DataFrame, food: str, tag: str, value: str, sums: Sequence[tuple[str, Sequence[str], float, float]], ratios: Sequence[tuple[str, Column, str, float]]) -> DataFrame:
    """check, food, total, reference, ratio, status. sums: (check, tags, low, high): foods with all tags, whose total must be within
    bounds. ratios: (check, which rows are parts, the whole's tag, most): parts' total by the whole. A food's tag of several records
    counts as none."""
    once = values.groupBy(food, tag).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v")).where("_n = 1")
    none = F.lit(None).cast("double")
    parts = []
    for check, tags, low, high in sums:
        total = once.where(F.col(tag).isin(*tags)).groupBy(food).agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == len(tags))
        parts.append(total.select(F.lit(check).alias("check"), food, "total", none.alias("reference"), none.alias("ratio"), F.when(F.col("total").between(low, high), "pass").otherwise("review").alias("status")))
    for check, which, whole, most in ratios:
        total = once.groupBy(food).agg(F.sum(F.when(which, F.col("_v"))).alias("total"), F.max(F.when(F.col(tag) == whole, F.col("_v"))).alias("reference")).where("total IS NOT NULL AND reference IS NOT NULL")
        ratio = F.when(F.col("reference") > 0, F.col("total") / F.col("reference")).when(F.col("total") > 0, float("inf")).otherwise(0.0)
        parts.append(total.select(F.lit(check).alias("check"), food, "total", "reference", ratio.alias("ratio"), F.when(ratio <= most, "pass").otherwise("review").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repaired_support(support: DataFrame, group: str, axis: str, counts: Sequence[tuple[str, int]], assignment: DataFrame, most: int = 1_000_000) -> DataFrame:
    """group, partition, moved: validation groups given back to the training side until each axis has as much of every count there
    as asked (counts: column, least). The axis of fewest groups that lacks most goes first; of its groups the one that gives most of
    what any axis lacks, of equals the last by name. An error where no group is left to give.

    Sums by group and axis come to the driver, as each move depends on those before: over `most` of them, or of groups, are an error.
    """
    columns, least = [c for c, _ in counts], [n for _, n in counts]
    placed = {r[0]: r[1] for r in assignment.select(group, "partition").limit(most + 1).collect()}
    gives: dict[str, dict[str, list[int]]] = {}
    holders: dict[str, list[str]] = {}
    sums = support.groupBy(group, axis).agg(*(F.sum(c).alias(c) for c in columns)).limit(most + 1).collect()
    if max(len(sums), len(placed)) > most:
        raise ValueError(f"over {most} groups, or sums of groups and axes")
    for r in sums:
        gives.setdefault(r[group], {})[r[axis]] = [r[c] for c in columns]
        holders.setdefault(r[axis], []).append(r[group])
    missing = {a: list(least) for a in holders}

    def take(g: str) -> None:
        for a, amounts in gives.get(g, {}).items():
            missing[a] = [m - n for m, n in zip(missing[a], amounts, strict=True)]

    for g, side in placed.items():
        if side == "train":
            take(g)
    moved = set()
    while short := [a for a, m in missing.items() if max(m) > 0]:
        a = min(short, key=lambda x: (len(holders[x]), x))
        able = [g for g in holders[a] if placed.get(g) == "validation"]
        if not able:
            raise ValueError(f"no group is left to support {a}")
        worth = {g: sum(min(n, max(0, m)) for x, amounts in gives[g].items() for n, m in zip(amounts, missing[x], strict=True)) for g in able}
        best = max(able, key=lambda g: (worth[g], g))
        placed[best] = "train"
        moved.add(best)
        take(best)
    kind = assignment.schema[group].dataType.simpleString()
    return assignment.sparkSession.createDataFrame([(g, side, g in moved) for g, side in sorted(placed.items())], f"{group} {kind}, partition string, moved boolean")


def newest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    return first_by(df, keys, F.col(version).desc())
