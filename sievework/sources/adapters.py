"""Source adapters: each a table of rules that turns one database's tables into foods, components and measurements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.units import normalize_unit
from ..functions.values import bounded_mass, mass_status, parse_value
from ..operators.gates import training_gate


@dataclass(frozen=True)
class Bundle:
    foods: DataFrame
    components: DataFrame
    measurements: DataFrame


@dataclass(frozen=True)
class Adapter:
    """SQL expressions over the source's own columns. tiers and zeros: (condition, value) in order, the first that holds."""

    key: str
    tiers: Sequence[tuple[str, str]]
    default_tier: str = "D"
    layer: str = "primary_reference"
    independent: str = "true"
    lineage: str = "NULL"
    zeros: Sequence[tuple[str, str]] = ()
    implicit_per_100g: bool = True
    options: Mapping[str, str] = field(default_factory=dict)

    def _case(self, rules: Sequence[tuple[str, str]], otherwise: str) -> str:
        whens = " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules)
        return f"CASE {whens} ELSE {otherwise} END" if rules else otherwise

    def bundle(self, foods: DataFrame, components: DataFrame, facts: DataFrame) -> Bundle:
        """foods: (source_food_id, name, ...); components: (source_component_id, name, ...); facts: those two ids, raw_value,
        raw_min, raw_max, raw_unit, raw_basis, and whatever the rules name. A fact without its food or component goes with it."""
        food = foods.withColumns({"source_key": F.lit(self.key), "food_observation_id": stable_id("foodobs", F.lit(self.key), F.col("source_food_id"))})
        component = components.withColumns({"source_key": F.lit(self.key), "component_observation_id": stable_id("compobs", F.lit(self.key), F.col("source_component_id"))})
        rows = facts.join(food.select("source_food_id", "food_observation_id"), "source_food_id").join(component.select("source_component_id", "component_observation_id"), "source_component_id")
        return Bundle(food, component, self.measured(rows))

    def measured(self, rows: DataFrame) -> DataFrame:
        """Facts with parsed value, converted mass, tier, independence, lineage and the training gate's verdict."""
        units = rows.select("raw_unit", "raw_basis").distinct().withColumn("_u", normalize_unit(F.col("raw_unit"), F.col("raw_basis"), self.implicit_per_100g))
        out = rows.join(units.withColumnsRenamed({"raw_unit": "_ru", "raw_basis": "_rb"}), F.col("raw_unit").eqNullSafe(F.col("_ru")) & F.col("raw_basis").eqNullSafe(F.col("_rb"))).drop("_ru", "_rb")
        out = out.withColumn("_v", parse_value(F.col("raw_value"), F.col("raw_min"), F.col("raw_max"))).select("*", "_v.*").drop("_v")
        mass = bounded_mass(F.col("numeric_value") * F.col("_u.factor"))
        out = out.withColumns({
            "source_key": F.lit(self.key), "measurement_id": stable_id("meas", F.lit(self.key), F.col("source_food_id"), F.col("source_component_id"), F.col("raw_value"), F.col("raw_unit")),
            "conversion_status": F.col("_u.status"), "measurement_modality": F.col("_u.modality"), "conversion_factor": F.col("_u.factor"), "normalized_value_g_per_100g": mass, "value_status": mass_status(F.col("value_status"), mass),
            "quality_tier": F.expr(self._case(self.tiers, f"'{self.default_tier}'")), "zero_semantics": F.expr(self._case(self.zeros, "CASE WHEN numeric_value = 0 THEN 'source_reported_numeric_zero' ELSE 'not_zero' END")),
            "independent_evidence": F.expr(self.independent), "data_layer": F.lit(self.layer), "lineage_key": F.expr(self.lineage),
        }).drop("_u")
        for c, e in (("quality_evidence", "''"), ("exclusion_reason", "CAST(NULL AS STRING)")):
            if c not in out.columns:
                out = out.withColumn(c, F.expr(e))
        fine = F.coalesce((F.col("normalized_value_g_per_100g") >= 0) & (F.col("normalized_value_g_per_100g") <= 100) & (F.col("zero_semantics") != "assumed_zero"), F.lit(False))
        return training_gate(out.withColumn("main_value_eligible", fine))


# The databases' own codes of how a value came about, and the tier that each gives.
ADAPTERS = {
    a.key: a
    for a in [
        Adapter("usda_sr_legacy", [("derivation_source_id = 1", "B"), ("derivation_source_id = 10", "C")], lineage="concat('USDA:NDB:', ndb_number)", zeros=[("numeric_value = 0 AND (derivation_source_id = 5 OR derivation_code LIKE '%assumed%')", "assumed_zero")]),
        Adapter("usda_foundation", [("data_points > 0", "A")], "B", lineage="concat('USDA:NDB:', ndb_number)"),
        Adapter("fndds", [], "D", layer="auxiliary", independent="false"),
        Adapter("cnf", [("value_source_code = 3", "A"), ("value_source_code = 7", "B"), ("value_source_code IN (10, 17)", "C")], lineage="CASE WHEN value_source_code IN (0, 4, 5) THEN 'usda_sr_legacy' WHEN value_source_code = 82 THEN 'frida' WHEN value_source_code = 83 THEN 'fineli' END", zeros=[("numeric_value = 0 AND value_source_code = 12", "assumed_zero")]),
        Adapter("frida", [("source_ids <> '' AND determinations > 0", "B")], "C"),
        Adapter("ciqual", [("confidence = 'A'", "A"), ("confidence = 'B'", "B"), ("confidence = 'C'", "C")]),
        Adapter("afcd", [("derivation = 'analysed'", "C")], layer="curated_reference_training", zeros=[("numeric_value = 0", "reported_zero_unresolved")]),
        Adapter("cofid", [("reference <> ''", "C")], layer="curated_reference_training"),
        Adapter("foodb", [("citation_type = 'EXPERIMENTAL'", "C")], independent="NOT coalesce(citation LIKE '%DATABASE%', false)", lineage="CASE WHEN citation LIKE '%USDA%' THEN 'usda_sr_legacy' END", options={"food_key": "citation|food_id|part|preparation"}),
        Adapter("norway", [("source_reference LIKE 'analysis%'", "B")], "C", zeros=[("numeric_value = 0 AND source_reference = '50'", "assumed_zero")]),
        *(Adapter(k, [("NOT coalesce(origin LIKE '%calcul%' OR origin LIKE '%recipe%' OR origin LIKE '%estimat%', false)", "C")], layer="curated_reference_training") for k in ("wafct_2019", "bangladesh_2013", "smiling", "infoods", "lesotho_2006", "swiss_7", "mext_2023", "efsa_2013", "bls_4")),
    ]
}
