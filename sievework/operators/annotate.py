"""What is said about records, labels and axes by ordered rules and reviewed tables; nothing here changes a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_label_key
from .gates import first_reason
from .relational import first_by, join_checked, require_unique

# Statuses of values and the (role, code) that they give.
STATUS_ROLES = {
    "reported_zero_unresolved": ("evidence_only_value_semantics", "reported_zero_unresolved"),
    "assumed_zero": ("evidence_only_value_semantics", "assumed_zero"),
    "below_limit": ("evidence_only_value_semantics", "below_detection_or_quantification_limit"),
    "range_only": ("evidence_only_value_semantics", "range_without_point_estimate"),
    "trace_or_censored": ("evidence_only_value_semantics", "trace_or_censored"),
    "invalid": ("evidence_only_value_semantics", "invalid_source_numeric_expression"),
    "bracketed_or_parenthesized_estimate": ("review_required_estimated_value", "bracketed_or_parenthesized_estimate"),
}
# Origins of values that are exact masses in bounds, and the (role, code) that they give.
ORIGIN_ROLES = {
    "source_linked_analytical_project": ("tier_b_source_linked_analytical_candidate", "source_linked_analytical_project"),
    "compiled_food_level_analytical_reference": ("review_required_compilation", "compiled_or_harmonized_reference"),
    "official_harmonized_compilation": ("review_required_compilation", "compiled_or_harmonized_reference"),
    "bibliography_contradicts_independent_assay_or_remains_unresolved": ("evidence_only_unresolved_provenance", "unresolved_or_conflicting_bibliography"),
    "survey_or_calculated_dish": ("evidence_only_derived_or_recipe", "derived_recipe_or_borrowed_expression"),
    "source_derived_or_calculated": ("evidence_only_derived_or_recipe", "derived_recipe_or_borrowed_expression"),
    "unreviewed_calculated_or_borrowed": ("evidence_only_derived_or_recipe", "derived_recipe_or_borrowed_expression"),
    "recipe_or_estimation": ("evidence_only_derived_or_recipe", "derived_recipe_or_borrowed_expression"),
    "recipe_calculated": ("evidence_only_derived_or_recipe", "derived_recipe_or_borrowed_expression"),
}
# What marks a food and its profile as analysed, in the notes of one origin.
DERIVED_FOODS, ANALYSED = "food_level_derivation_not_individual_assay_certification", "profile_derivation=Analysed; food_details_derivation=Analysed"


def _looked_up(key: Column, table: dict[str, tuple[str, str]], i: int) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]))))[key]


def review_roles(df: DataFrame, direct: str = "direct_mass_label_candidate", status: str = "value_status", value: str = "normalized_value_g_per_100g", conversion: str = "conversion_status", origin: str = "source_value_origin", note: str = "source_note") -> DataFrame:
    """df with training_review_role and training_review_code: what a record may be used for. Of the rules, the later one counts:
    provenance over modality over status; direct labels stand apart from all of them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    exact = F.coalesce(F.col(conversion) == "converted_exact_mass", F.lit(False))
    bounded = F.coalesce(F.col(value).between(0, 100), F.lit(False))
    sound = exact & bounded & text(status).isin("observed", "explicit_zero")

    def column(i: int, direct_is: str, analysed: str, other: str, outside: str, modality: str, unknown: str) -> Column:
        known = F.when((text(origin) == DERIVED_FOODS) & (text(note) == ANALYSED), analysed)
        provenance = F.when(sound, F.coalesce(_looked_up(text(origin), ORIGIN_ROLES, i), known, F.when(text(origin) != "source_reported", other)))
        rules = [provenance, F.when(exact & ~bounded, outside), F.when(~exact, modality), _looked_up(text(status), STATUS_ROLES, i), F.lit(unknown)]
        return F.when(F.lower(text(direct)) == "true", direct_is).otherwise(F.coalesce(*rules))

    role = column(0, "strict_model_label", "tier_b_curated_analytical_candidate", "review_required_provenance", "review_required_measurement_range", "evidence_only_measurement_modality", "needs_record_review")
    code = column(1, "direct_mass_quality_gate_passed", "afcd_food_and_profile_marked_analysed", "non_source_reported_value_origin", "mass_fraction_outside_physical_range", "not_exact_fresh_weight_mass", "unclassified_non_strict_record")
    return df.withColumn("training_review_role", role).withColumn("training_review_code", code)


#: A unit that ends a label in parentheses.
_UNIT_NOTE = r"(?i)\s*\([^()]*?(?:/100|mg|µg|ug|kcal|kj)[^()]*\)\s*$"


def modal_label(df: DataFrame, keys: Sequence[str], label: str, order: str, authority: DataFrame | None = None, name: str = "authority_name") -> DataFrame:
    """keys, label, basis: the authority's name where there is one (keys, name), else of the labels, without units behind them, the
    shortest of the most frequent key (of equally frequent ones, of that which comes first), of equals the first by letters."""
    text = F.trim(F.regexp_replace(F.col(label), _UNIT_NOTE, ""))
    rows = df.select(*keys, text.alias("_l"), F.col(order).alias("_o")).where(F.col("_l") != "").withColumn("_k", ascii_label_key(F.col("_l")))
    best = F.min(F.struct(F.length("_l").alias("n"), F.lower("_l").alias("f"), F.col("_l").alias("l")))
    counted = rows.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"), best.alias("_best"))
    out = counted.groupBy(*keys).agg(F.min_by("_best", F.struct(-F.col("_n"), "_first", "_k")).alias("_b")).select(*keys, F.col("_b.l").alias("label"))
    out = df.select(*keys).distinct().join(out, list(keys), "left").withColumn("basis", F.when(F.col("label").isNotNull(), "modal official source label"))
    if authority is None:
        return out
    known = authority.where(F.trim(name) != "").select(*keys, F.trim(name).alias("_a"))
    joined = join_checked(out, known, list(keys))
    return joined.select(*keys, F.coalesce("_a", "label").alias("label"), F.when(F.col("_a").isNotNull(), "authority").otherwise(F.col("basis")).alias("basis"))


def classified(axes: DataFrame, id_col: str, keys: Sequence[str], rules: DataFrame, legacy: str | None = None) -> DataFrame:
    """axes with what a reviewed table of rules (one row for each of keys) says of them; an axis without a rule or an id held twice
    is an error. legacy: columns of this prefix stay under legacy_ names."""
    require_unique(axes, [id_col], "axes")
    renamed = axes.withColumnsRenamed({c: f"legacy_{c}" for c in axes.columns if legacy and c.startswith(legacy)})
    out = join_checked(renamed, rules.withColumn("_rule", F.lit(True)), list(keys))
    told = F.concat(F.lit("an identity that no rule covers: "), F.to_json(F.struct(*keys)))
    return out.withColumn("_rule", F.when(F.col("_rule").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.col("_rule"))).where("_rule").drop("_rule")


def remapped(df: DataFrame, source: str, pattern: str, mapping: DataFrame, axis: str = "axis_id", name: str = "axis_name") -> DataFrame:
    """df with axis and name replaced where source holds a code (the pattern's group) that mapping (code, axis, name) knows."""
    known = mapping.select(F.col("code").cast("string").alias("_c"), F.col(axis).alias("_x"), F.col(name).alias("_y"))
    met = join_checked(df.withColumn("_c", F.regexp_extract(source, pattern, 1)), known, ["_c"])
    return met.withColumns({axis: F.coalesce("_x", axis), name: F.when(F.col("_x").isNotNull(), F.col("_y")).otherwise(F.col(name))}).drop("_c", "_x", "_y")


# Tags and words that a role goes by, as (role, tags, beginnings of tags, whole names, words in name or group).
_MINERALS = ("CA", "FE", "MG", "P", "K", "NA", "ZN", "CU", "MN", "SE", "I", "CR", "MO", "CLD", "F", "CO")
_AMINO = ("ALA", "ARG", "ASP", "ASPN", "CYS", "CYST", "GLU", "GLN", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
_AMINO_NAMES = (
    "alanine", "arginine", "aspartic acid", "asparagine", "cysteine", "cystine", "cystine plus cysteine", "glutamic acid", "glutamine", "glycine", "histidine", "isoleucine", "leucine", "lysine",
    "methionine", "phenylalanine", "proline", "serine", "threonine", "tryptophan", "tyrosine", "valine",
)
ROLES = (
    ("essential_nutrient_choline", ("CHOLN",), (), ("choline", "choline total"), ()),
    ("macronutrient", (), (), ("protein", "total protein", "fat total", "total fat", "carbohydrate", "dietary fibre", "dietary fiber"), ()),
    ("macronutrient", ("PROCNT", "PROT", "FAT", "FATCE", "CHOCDF", "CHOT", "CHOAVL", "FIBTG", "FIBT"), (), (), ()),
    ("other_nutritional_component", ("WATER", "ASH", "ALC"), (), (), ()),
    ("micronutrient_mineral", _MINERALS, (), (), ("calcium", "iron", "magnesium", "phosphorus", "potassium", "sodium", "zinc", "copper", "manganese", "selenium", "iodine", "molybdenum", "chloride")),
    ("micronutrient_vitamin", (), ("VITA", "RETOL", "CART", "THIA", "RIBF", "NIA", "VITB6", "FOL", "VITB12", "VITC", "VITD", "TOCP", "VITE", "VITK", "PANTAC", "BIOT"), (), ("vitamin", "thiamin", "riboflavin", "niacin", "folate", "biotin", "pantothenic", "cobalamin", "tocopherol")),
    ("nutrient_constituent_fatty_acid", (), ("FA", "FASAT", "FAMS", "FAPU"), (), ("fatty acid",)),
    ("nutrient_constituent_amino_acid", _AMINO, ("AA",), _AMINO_NAMES, ("amino acid",)),
    ("nutrient_constituent_carbohydrate", (), (), (), ("sugar", "glucose", "fructose", "sucrose", "starch", "oligosaccharide")),
)
NO_ROLE = "other_food_component"


def nutritional_role(tag: Column, name: Column, group: Column) -> Column:
    """Struct of role and basis (tag, name or none): the first of ROLES that a component's tag, name or group meets."""
    tag, own, words = F.upper(F.coalesce(tag, F.lit(""))), ascii_label_key(name), ascii_label_key(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(group, F.lit(""))))
    no = F.lit(False)
    out = F.struct(F.lit(NO_ROLE).alias("role"), F.lit("none").alias("basis"))
    for role, tags, starts, names, held in reversed(ROLES):
        by_tag = tag.isin(*tags) if tags else no
        for s in starts:
            by_tag |= tag.startswith(s)
        by_name = own.isin(*names) if names else no
        for w in held:
            by_name |= words.contains(w)
        out = F.when(by_tag | by_name, F.struct(F.lit(role).alias("role"), F.when(by_tag, "tag").otherwise("name").alias("basis"))).otherwise(out)
    return out


# Units of mass, after ascii_label_key().
MASS_UNITS = ("g", "mg", "ug", "kg", "ng", "mcg", "gram", "milligram", "microgram")


def unit_relation(unit: Column, others: Column) -> Column:
    """How a source's unit stands to a target's units, an array."""
    own = ascii_label_key(unit)
    keys = F.filter(F.transform(F.coalesce(others, F.array().cast("array<string>")), ascii_label_key), lambda k: k != "")
    mass = F.exists(keys, lambda k: k.isin(*MASS_UNITS))
    return (
        F.when((own == "") | (F.size(keys) == 0), "unit_not_stated_in_one_or_both_catalogues")
        .when(own.isin(*MASS_UNITS) & mass, "both_report_mass_units; conversion_not_performed_here")
        .when(F.array_contains(keys, own), "same_raw_unit")
        .otherwise("unit_or_expression_review_required")
    )


def title_crosswalk(directory: DataFrame, id_col: str, title: str, registry: DataFrame, registry_id: str, registry_name: str) -> DataFrame:
    """id_col, key, registry_ids (joined), status: entries of a directory by their title, without a country or year in parentheses
    before it, against a registry's names. Candidates only; nothing is merged."""
    key = lambda c: ascii_label_key(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\([^)]*\)\s*", ""))
    known = registry.select(ascii_label_key(F.col(registry_name)).alias("key"), F.col(registry_id).cast("string").alias("_r")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("_r")), ";").alias("registry_ids"))
    out = directory.select(id_col, key(title).alias("key")).join(known, "key", "left")
    return out.select(id_col, "key", F.coalesce("registry_ids", F.lit("")).alias("registry_ids"), F.when(F.col("registry_ids").isNotNull(), "exact_title_candidate").otherwise("unmatched_requires_review").alias("status"), F.lit(False).alias("automatic_entity_merge"))


def outcomes(registry: DataFrame, key: str, found: DataFrame, default: str = "not_attempted") -> DataFrame:
    """registry with status, detail and n of what was done about each entry; default where nothing was."""
    out = join_checked(registry, found.select(key, "status", "detail", "n"), [key])
    return out.fillna(default, ["status"]).fillna("", ["detail"]).fillna(0, ["n"])


def unmapped_reasons(items: DataFrame, item: str, mapped: DataFrame, content: DataFrame, axis: str, unresolved: Column, known: Column, numeric: Column) -> DataFrame:
    """item, counts of its content and reason, for each item of no mapped measurement: why there is none."""
    pending = items.select(item).distinct().join(mapped.select(item), item, "left_anti")
    rows = content.join(pending, item, "left_semi")
    seen = rows.groupBy(item).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(axis).alias("axes"), F.count_if(numeric).alias("numeric"), F.count_if(unresolved).alias("unresolved"), F.count_if(known).alias("known"))
    out = pending.join(seen, item, "left").fillna(0)
    reason = first_reason(
        [
            (F.col("rows") == 0, "no_source_content_row_found"),
            (F.col("known") > 0, "mapped_source_axis_present_but_no_mapped_numeric_measurement_retained"),
            (F.col("unresolved") == F.col("rows"), "all_source_content_rows_reference_an_unresolved_component"),
        ],
        "unmapped_source_components_outside_current_prediction_panel",
    )
    return out.withColumn("reason", reason)


def first_filled(df: DataFrame, keys: Sequence[str], column: str, order: str) -> DataFrame:
    """keys and the first text of column, by order, that isn't blank."""
    return first_by(df.where(F.trim(column) != "").select(*keys, column, order), keys, F.col(order), F.col(column)).select(*keys, column)
