"""Catalogues, coverage plans and reports: composites of the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import distinct_text
from .relational import first_by


def concepts_and_relations(axes: DataFrame, concept: Column, edges: Sequence[tuple[str, Column]], order: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(concepts: concept_id, members, first label; relations: subject, relation, object, each once). edges: relation and the
    object's column; null objects give none."""
    rows = axes.withColumn("concept_id", concept)
    out = rows.groupBy("concept_id").agg(F.count(F.lit(1)).alias("members"), F.min_by(label, order).alias("label"))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("relation"), c.cast("string").alias("object")) for name, c in edges)))
    relations = rows.select(F.col("concept_id").alias("subject"), pairs.alias("e")).select("subject", "e.*").where("object IS NOT NULL").dropDuplicates()
    return out, relations


def expression_groups(axes: DataFrame, name: str, expression: Sequence[str], source: str) -> DataFrame:
    """expression_id, members, names, sources, conflict: axes are one only if unit, denominator, method and definition agree;
    conflict where one name has several expressions."""
    rows = axes.withColumn("expression_id", stable_id("axis", *(F.col(c) for c in expression)))
    groups = rows.groupBy("expression_id").agg(F.count(F.lit(1)).alias("members"), distinct_text(F.col(name)).alias("names"), distinct_text(F.col(source)).alias("sources"), F.min(name).alias("_n"))
    several = rows.groupBy(F.col(name).alias("_n")).agg((F.countDistinct("expression_id") > 1).alias("conflict"))
    return groups.join(several, "_n", "left").drop("_n")


def requirement_evidence(requirements: DataFrame, key: str, listed: str, evidence: DataFrame, id_col: str, numeric: Column) -> DataFrame:
    """key, listed ids found, numeric ones, status; listed holds ids joined by ;. Exploded, so that it is an equi-join."""
    wanted = requirements.select(key, F.explode(F.split(listed, ";")).alias("_id")).withColumn("_id", F.trim("_id"))
    found = wanted.join(evidence.select(F.col(id_col).cast("string").alias("_id"), numeric.alias("_num")), "_id").groupBy(key).agg(F.countDistinct("_id").alias("found"), F.count_if("_num").alias("numeric"))
    out = requirements.select(key).join(found, key, "left").fillna(0, ["found", "numeric"])
    return out.withColumn("status", F.when(F.col("numeric") > 0, "covered").when(F.col("found") > 0, "registered_only").otherwise("gap"))


def gap_grid(requirements: DataFrame, key: str, sources: DataFrame, source: str, seen: DataFrame) -> DataFrame:
    """key, source, n for every pair, zeros among them."""
    return requirements.select(key).crossJoin(sources.select(source).distinct()).join(seen, [key, source], "left").fillna(0, ["n"])


def new_targets(catalogue: DataFrame, key: str, seeds: DataFrame, order: str) -> DataFrame:
    """The catalogue's targets by key, and the seeds whose key it lacks; origin says which."""
    own = catalogue.groupBy(key).agg(F.count(F.lit(1)).alias("axes")).withColumn("origin", F.lit("catalogue"))
    added = first_by(seeds.join(own, key, "left_anti"), [key], F.col(order)).select(key, F.lit(0).cast("long").alias("axes"), F.lit("seed").alias("origin"))
    return own.unionByName(added)


def match_counts(targets: DataFrame, key: str, candidates: DataFrame, axis: str, method: str, methods: Sequence[str]) -> DataFrame:
    """key and for each method the distinct axes that it proposes; none is 0."""
    wide = candidates.groupBy(key).pivot(method, list(methods)).agg(F.countDistinct(axis))
    return targets.select(key).join(wide, key, "left").fillna(0, list(methods))


def observed_axes(registry: DataFrame, axis: str, facts: DataFrame, usable: Column, least: int = 1) -> DataFrame:
    """axis, n, decision: retained with `least` usable values, else removed."""
    n = facts.where(usable).groupBy(axis).agg(F.count(F.lit(1)).alias("n"))
    return registry.select(axis).distinct().join(n, axis, "left").fillna(0, ["n"]).withColumn("decision", F.when(F.col("n") >= least, "retained").otherwise("removed"))


def holdout_roles(facts: DataFrame, axis: str, item: str, source: str, least_train: int, least_test: int) -> DataFrame:
    """axis, source, test and remaining items, role: what holding the source out would test and leave. Items counted once."""
    cell = facts.select(axis, item, source).distinct()
    test = cell.groupBy(axis, source).agg(F.countDistinct(item).alias("test"))
    alone = cell.groupBy(axis, item).agg(F.count(F.lit(1)).alias("_s"), F.min(source).alias(source)).where("_s = 1").groupBy(axis, source).agg(F.count(F.lit(1)).alias("_only"))
    total = cell.groupBy(axis).agg(F.countDistinct(item).alias("_all"))
    out = test.join(total, axis).join(alone, [axis, source], "left").withColumn("remaining", F.col("_all") - F.coalesce("_only", F.lit(0))).drop("_all", "_only")
    return out.withColumn("role", F.when((F.col("test") >= least_test) & (F.col("remaining") >= least_train), "holdout_test").when(F.col("remaining") >= least_train, "train_only").otherwise("insufficient"))


def without_axis(items: DataFrame, item: str, facts: DataFrame) -> DataFrame:
    return items.join(facts.select(item).distinct(), item, "left_anti")


def identity_collisions(mapping: DataFrame, number: Column, concept: str) -> DataFrame:
    """number, concepts: numbers that stand for several concepts."""
    return mapping.withColumn("number", number).groupBy("number").agg(F.array_join(F.array_sort(F.collect_set(F.col(concept).cast("string"))), ";").alias("concepts"), F.countDistinct(concept).alias("n")).where("n > 1")


def merge_groups(df: DataFrame, item: str, members: DataFrame, representative: str, member: str) -> DataFrame:
    """df with item replaced by its reviewed group's representative; original keeps what it was. A member of two groups raises."""
    twice = members.groupBy(member).agg(F.countDistinct(representative).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][member]} is in two groups")
    m = members.select(F.col(member).alias("_m"), F.col(representative).alias("_r")).distinct()
    return df.join(m, F.col(item) == F.col("_m"), "left").withColumn("original", F.col(item)).withColumn(item, F.coalesce("_r", item)).drop("_m", "_r")


def resolve_copies(imported: DataFrame, origin: DataFrame, keys: Sequence[str], value: str, rtol: float = 1e-4) -> DataFrame:
    """imported with copy_status: the origin's value within rtol, another, or none."""
    o = origin.groupBy(*keys).agg(F.median(value).alias("_o"))
    out = imported.join(o, list(keys), "left")
    same = F.abs(F.col(value) - F.col("_o")) <= rtol * F.abs("_o")
    return out.withColumn("copy_status", F.when(F.col("_o").isNull(), "origin_absent").when(same, "resolved").otherwise("differs")).drop("_o")


def search_index(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """id, terms: the sorted distinct terms of all (frame, id column, term column), joined."""
    rows = None
    for df, i, t in parts:
        own = df.select(F.col(i).alias("id"), F.col(t).alias("term"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("id").agg(distinct_text(F.lower("term"), " | ").alias("terms"))


def literature(records: DataFrame, ids: Sequence[tuple[str, str]], title: str, order: str) -> DataFrame:
    """One record for each work: keyed by the first identifier that isn't blank, else by its title's hash; first by order."""
    key = F.coalesce(*(F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:"), F.lower(F.trim(c)))) for name, c in ids), stable_id("title", F.lower(F.trim(title))))
    return first_by(records.withColumn("work", key), ["work"], F.col(order))


def common_cells(predictions: DataFrame, keys: Sequence[str], method: str, methods: Sequence[str], value: str) -> DataFrame:
    """keys and a column of medians for each method, for the keys that every method has."""
    wide = predictions.groupBy(*keys).pivot(method, list(methods)).agg(F.median(value))
    return wide.dropna(subset=list(methods))


def mass_balance(cells: DataFrame, item: str, tag: str, value: str, parts: Sequence[str], low: float, high: float) -> DataFrame:
    """item, total, plausible: the sum of the parts, where all of them are there once."""
    once = cells.groupBy(item, tag).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v")).where(F.col("_n") == 1)
    out = once.where(F.col(tag).isin(*parts)).groupBy(item).agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == len(parts))
    return out.select(item, "total", F.col("total").between(low, high).alias("plausible"))


def next_action(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    return F.coalesce(*(F.when(c, F.lit(a)) for c, a in rules), F.lit(otherwise))
