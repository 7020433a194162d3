"""Audits of candidate sources: what of a source's cells could be evidence, for which components and foods, and what is still open."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key
from ..functions.values import parse_value, parsed


@dataclass(frozen=True)
class CandidatePolicy:
    """expressions: (codes, status) in order, for components that aren't plain masses; grams: of the units that are; measured: the
    origin that is an analysis; derived: the one counted as recipes."""

    expressions: Sequence[tuple[Sequence[str], str]]
    grams: dict[str, float]
    measured: str
    derived: str
    mass: str = "mass_expression_candidate"


#: Codes of the German nutrient database that aren't plain masses.
BLS = CandidatePolicy(
    [(("ENERCJ", "ENERCC"), "energy_excluded"), (("VITA", "VITAA", "NIAEQ", "FOL", "NACL"), "equivalent_expression_excluded"), (("VITE",), "duplicate_alpha_tocopherol_alias_hold"), (("FAX",), "unspecified_other_fatty_acids_hold")],
    {"g": 1.0, "mg": 1e-3, "µg": 1e-6}, "Analyse", "Rezeptberechnung",
)


@dataclass(frozen=True)
class CandidateAudit:
    cells: DataFrame
    components: DataFrame
    foods: DataFrame


def candidate_audit(cells: DataFrame, components: DataFrame, foods: DataFrame, policy: CandidatePolicy = BLS) -> CandidateAudit:
    """cells (food_id, code, raw_value, origin, reference) with status, mass and whether each is a candidate: a positive analysed
    value of a component that is a plain mass, at most 100 g per 100 g. components (code, unit) and foods (food_id) with their
    counts, zero for none. A cell that is there twice, or without its component, is an error: found by one aggregation."""
    status = F.lit(policy.mass)
    for codes, name in reversed(policy.expressions):
        status = F.when(F.col("code").isin(*codes), name).otherwise(status)
    factor = F.coalesce(*(F.when(F.col("unit") == u, F.lit(g)) for u, g in policy.grams.items()))
    known = components.withColumn("expression_status", status).withColumn("factor", factor)
    rows = parsed(cells, "raw_value", parse_value, "_v").join(known.select("code", "expression_status", "factor"), "code", "left")
    seen = rows.groupBy("food_id", "code").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("expression_status").isNull()).alias("lost")).where("n > 1 OR lost").limit(1).collect()
    if seen:
        raise ValueError(f"a cell that is there twice, or whose component isn't known: {seen[0].asDict()}")
    mass = F.col("_v.numeric_value") * F.col("factor")
    rows = rows.select(*cells.columns, "expression_status", F.col("_v.value_status").alias("value_status"), mass.alias("g_per_100g")).withColumn("is_mass", F.col("expression_status") == policy.mass)
    fine = F.col("is_mass") & (F.col("origin") == policy.measured) & (F.col("value_status") == "observed") & (F.col("g_per_100g") > 0) & (F.col("g_per_100g") <= 100)
    invalid = F.col("is_mass") & ~F.col("g_per_100g").between(0, 100)
    rows = rows.withColumn("candidate", F.coalesce(fine, F.lit(False))).withColumn("invalid_mass", F.coalesce(invalid, F.lit(False)))
    own = rows.where("candidate")
    support = own.groupBy("code").agg(F.countDistinct("food_id").alias("positive_foods"), F.min("g_per_100g").alias("least"), F.max("g_per_100g").alias("most"), F.count_if(F.trim(F.coalesce("reference", F.lit(""))).isin("", "-")).alias("without_reference"))
    by_food = rows.groupBy("food_id").agg(F.count_if("candidate").alias("analysed_cells"), F.count_if(F.col("origin") == policy.derived).alias("recipe_cells"))
    return CandidateAudit(rows, known.join(support, "code", "left").fillna(0, ["positive_foods", "without_reference"]), foods.join(by_food, "food_id", "left").fillna(0, ["analysed_cells", "recipe_cells"]))


def name_candidates(foods: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """foods that share a name's key with known ones (concept_id, name, partition): candidates for review, never merges."""
    keyed = lambda df: df.select(F.col(name).alias("_n")).distinct().withColumn("_k", label_key(F.col("_n")))
    left = foods.join(keyed(foods).withColumnRenamed("_n", "_ln"), F.col(name) == F.col("_ln")).drop("_ln")
    right = known.withColumnRenamed(name, "known_name").join(keyed(known).withColumnRenamed("_n", "_rn"), F.col("known_name") == F.col("_rn")).drop("_rn")
    return left.where("_k <> ''").join(right, "_k").drop("_k")


def tag_candidates(axes: DataFrame, registry: DataFrame) -> DataFrame:
    """axes (component_key `source:TAG:basis`, ...) beside the registry's components of the same literal tag (concept_id, tag): the
    same code is a reason to review, not an identity. An axis without one asks for a review of its own."""
    tagged = axes.withColumn("tag", F.split("component_key", ":")[1])
    out = tagged.join(registry.select("tag", "concept_id"), "tag", "left")
    return out.withColumn("review_status", F.when(F.col("concept_id").isNull(), "requires_source_specific_identity_review").otherwise("same_literal_code_only_definition_and_method_review_required"))
