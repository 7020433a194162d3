"""Databases whose tables need more than rules: sample results linked to foods over several tables, numbers that must be known,
and observations that are made up of a record's own columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_text
from ..operators.relational import join_checked, require_unique
from .adapters import ADAPTERS, Adapter, Bundle

_BASIS = "per 100 g edible portion, fresh weight"


def linked_methods(results: DataFrame, methods: DataFrame, hops: Sequence[tuple[DataFrame, str, str]], food: str, nutrient: str) -> DataFrame:
    """food, nutrient, methods: the methods that a food's own sample results were made by. results: (the first hop's key, nutrient,
    method); methods: (method, label); hops: (table, key, next key), each key unique, from a result's sample up to the food. A
    list of methods that could have been used is no such link."""
    rows = join_checked(results, methods.select("method", "label"), ["method"], "inner")
    for table, key, onward in hops:
        rows = join_checked(rows, table.select(key, onward), [key], "inner").drop(key)
    return rows.groupBy(food, nutrient).agg(distinct_text(F.col("label"), "; ").alias("methods"))


def foundation(foods: DataFrame, nutrients: DataFrame, values: DataFrame, methods: DataFrame) -> Bundle:
    """foods: (fdc_id, name, ndb_number); nutrients: (nutrient_id, name, unit); values: (id, fdc_id, nutrient_id, amount, low, high,
    data_points); methods: as linked_methods() gives them. Values of foods that aren't listed (samples) go."""
    rows = join_checked(values, nutrients.select("nutrient_id", F.col("unit").alias("raw_unit")), ["nutrient_id"])
    rows = join_checked(rows, methods.withColumnRenamed("methods", "analytical_method"), ["fdc_id", "nutrient_id"])
    lineage = foods.select(F.col("fdc_id").alias("_f"), "ndb_number")
    rows = rows.join(lineage, F.col("fdc_id") == F.col("_f")).drop("_f")
    facts = rows.select(F.col("fdc_id").alias("source_food_id"), F.col("nutrient_id").alias("source_component_id"), F.col("amount").cast("string").alias("raw_value"), F.col("low").alias("raw_min"), F.col("high").alias("raw_max"), "raw_unit", F.lit(_BASIS).alias("raw_basis"),
                        "data_points", "ndb_number", F.coalesce("analytical_method", F.lit("")).alias("analytical_method"), F.lit("foundation").alias("quality_evidence"))
    return ADAPTERS["usda_foundation"].bundle(foods.withColumnRenamed("fdc_id", "source_food_id"), nutrients.withColumnRenamed("nutrient_id", "source_component_id"), facts)


def survey(foods: DataFrame, nutrients: DataFrame, values: DataFrame) -> Bundle:
    """foods: (fdc_id, name); nutrients: (id, number, name, unit); values: (fdc_id, number, amount). Values carry the official
    number, not the catalogue's row id. Two nutrients of a number, and a number that no nutrient has, are errors; nutrients
    without a number stay apart under their own id."""
    plain = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\.0$", "")
    named = nutrients.withColumn("source_component_id", F.when(plain("number") == "", F.concat(F.lit("internal:"), F.col("id").cast("string"))).otherwise(plain("number")))
    require_unique(named, ["source_component_id"], "nutrient numbers")
    rows = values.withColumn("source_component_id", plain("number")).join(named.select("source_component_id", F.col("unit").alias("raw_unit"), F.lit(True).alias("_known")), "source_component_id", "left")
    told = F.raise_error(F.concat(F.lit("a number that no nutrient has: "), F.col("source_component_id"))).cast("boolean")
    rows = rows.where(F.when(F.col("_known"), F.lit(True)).otherwise(told))
    none = F.lit(None).cast("string")
    facts = rows.select(F.col("fdc_id").alias("source_food_id"), "source_component_id", F.col("amount").cast("string").alias("raw_value"), none.alias("raw_min"), none.alias("raw_max"), "raw_unit", F.lit(_BASIS).alias("raw_basis"), F.lit("calculated_or_survey_dish_auxiliary_only").alias("exclusion_reason"))
    return ADAPTERS["fndds"].bundle(foods.withColumnRenamed("fdc_id", "source_food_id"), named, facts)


def cited_key(content: DataFrame) -> Column:
    """citation|food|part|preparation of a record: the importer's own food where it names one, else the database's."""
    text = lambda c, none: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(none)))
    return F.concat_ws("|", text("citation", "FOODB"), F.coalesce(F.col("orig_food_id").cast("string"), F.col("food_id").cast("string")), text("part", ""), text("preparation", ""))


def citation_lineage(citation: Column) -> Column:
    """The database that a citation copies from, else the citation itself."""
    text = F.lower(F.coalesce(citation, F.lit("")))
    named = [("usda", "usda_sr_legacy"), ("dtu", "frida"), ("frida", "frida"), ("phenol", "phenol_explorer"), ("duke", "duke_phytochemical_database")]
    out = F.concat(F.lit("foodb_lineage:"), F.when(text == "", "unknown").otherwise(text))
    for word, key in reversed(named):
        out = F.when(text.contains(word), key).otherwise(out)
    return out


#: Values of citations: copies of other databases, and those of specialists.
_COPIED, _SPECIALIST = "USDA|DTU|FRIDA|PHENOL", "PHENOL|DUKE|ARTICLE|PUBMED"


def cited_contents(base_foods: DataFrame, components: DataFrame, content: DataFrame) -> Bundle:
    """base_foods: (food_id, name); components: (source_component_id, name); content: (food_id, orig_food_id, orig_name, part,
    preparation, citation, source_component_id, amount, unit, basis). A food is what a citation reports of a part in one
    preparation, so foods are found in the content first, a partial aggregate of it; their name is the least that their records
    give, else the database's. Records of one key meet it by a join, however many there are."""
    keyed = content.withColumn("source_food_id", cited_key(content))
    own = keyed.groupBy("source_food_id").agg(F.min("orig_name").alias("_own"), F.min("food_id").alias("food_id"), F.min(F.trim(F.coalesce("citation", F.lit("FOODB")))).alias("_citation"))
    named = own.join(base_foods.select("food_id", F.col("name").alias("_base")), "food_id", "left")
    foods = named.select("source_food_id", F.coalesce("_own", "_base", F.concat(F.lit("food "), F.col("food_id").cast("string"))).alias("name"), citation_lineage(F.col("_citation")).alias("lineage"))
    citation = F.upper(F.trim(F.coalesce("citation", F.lit("FOODB"))))
    none = F.lit(None).cast("string")
    copied = citation.rlike(_COPIED)
    facts = keyed.select("source_food_id", "source_component_id", F.col("amount").cast("string").alias("raw_value"), none.alias("raw_min"), none.alias("raw_max"), F.col("unit").alias("raw_unit"), F.coalesce("basis", "unit").alias("raw_basis"), citation_lineage(F.col("citation")).alias("lineage"), copied.alias("copied"),
                         (citation.rlike(_SPECIALIST) & ~copied).alias("specialist"), F.when(copied, "copied_value_retained_for_provenance_only").otherwise("specialist_layer_not_primary_benchmark").alias("exclusion_reason"))
    rules = Adapter("foodb", [("specialist", "C")], "D", layer="specialist_composition", independent="NOT copied", lineage="lineage", implicit_per_100g=False)
    return rules.bundle(foods, components, facts)
