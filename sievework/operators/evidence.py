"""What sources say about how their values came about: admission, bibliography, provenance, and what links training to validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_label_key
from .gates import all_flags, first_reason
from .graph import groups
from .relational import require_columns

# The policy, its sources, what may be lifted, and the tests of a record in order; the first that holds names the reason.
POLICY = "trusted_sr_cnf_foodb_v1"
TRUSTED = ("usda_sr_legacy", "cnf", "foodb")
COPIED = "external_reference_requires_origin_resolution_and_deduplication"
LIFTED = ("", "non_independent_or_derived_value", "insufficient_value_level_quality", "non_primary_data_layer", "specialist_layer_not_primary_benchmark", "copied_value_retained_for_provenance_only")
HOLDS = (
    ("NOT _sound", "invalid_missing_censored_assumed_zero_or_non_mass_value"),
    ("NOT _liftable", "existing_value_or_definition_hold"),
    ("_origin RLIKE '(?i)assumed zero|assumed to be zero'", "assumed_zero_not_measured_zero"),
    ("_origin RLIKE '(?i)label|claim|declaration|regulations|product standard'", "label_or_regulatory_value_not_reference_target"),
    ("_origin RLIKE '(?i)recipe|based on physical composition|surveys only|nutrition canada survey'", "recipe_or_survey_calculation_auxiliary_only"),
    ("_method RLIKE '(?i)imput|similar food|another form|different food|regression|estimated formulation'", "explicit_imputation_or_prediction_not_reference_target"),
    ("_origin RLIKE '(?i)less than|greater than|below.*(?:limit|detection|quantification)'", "censoring_in_source_metadata_requires_review"),
    ("_reference RLIKE '(?i)imput' AND NOT _routine", "imputed_or_unresolved_calculated_imputed_origin"),
    ("_copied", COPIED),
)
ROUTINE = r"""_method RLIKE '(?i)^(?:Calculated|Summed|Calculated field)$' OR startswith(_method, 'Nutrient that is based on other nutrient/s')
  OR _reference RLIKE '(?i)^(?:Calculated from analytical Canadian data|Calculated field)$'"""
COPY = r"""CASE source_key WHEN 'foodb' THEN _reference RLIKE '(?i)^(?:USDA|DTU|FRIDA|PHENOL[- ]EXPLORER)(?:$|[ \t:/,(-])' WHEN 'cnf' THEN coalesce(lineage_source_key, 'cnf') <> 'cnf'
  WHEN 'usda_sr_legacy' THEN _method RLIKE '(?i)another source|other tables of food composition' ELSE false END"""
SOUND = """coalesce(normalized_value_g_per_100g BETWEEN 0 AND 100 AND value_status IN ('observed', 'explicit_zero') AND conversion_status = 'converted_exact_mass'
  AND measurement_modality = 'mass_fraction_fresh_weight', false)"""
EQUIVALENT_TAGS = ("VITA", "VITA-", "VITARE", "VITDEQ", "NIATRP", "NIAEQ", "FOLDFE", "CARTBEQ", "VITE", "VITE-")
ACTIVITY, NITROGEN = "activity_equivalent_not_chemical_mass", "nitrogen_denominator_not_food_mass"


def _said(c: str) -> Column:
    """Booleans, and texts that read true in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.col(c).cast("string")) == "true", F.lit(False))


def admit(df: DataFrame, policy: str = POLICY) -> DataFrame:
    """df with the verdict of the source policy: records of trusted sources are admitted unless a rule holds them; others stay as
    they were. What was decided before stays in source_gate_previous_*. Refuses unknown policies and tables it already judged."""
    if policy != POLICY:
        raise ValueError(f"unknown source policy: {policy}")
    if "source_admission_policy" in df.columns:
        raise ValueError("the table has been judged by a source policy before")
    needed = "measurement_id source_key main_value_eligible strict_validation_eligible normalized_value_g_per_100g value_status conversion_status measurement_modality is_censored is_range_only source_reference method_expression analytical_method lineage_source_key independent_evidence exclusion_reason"
    require_columns(df, needed.split(), "source policy")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    main, reason = _said("main_value_eligible"), F.coalesce("exclusion_reason", F.lit(""))
    rows = df.withColumns({"_reference": text("source_reference"), "_method": text("method_expression"), "_trusted": F.coalesce(F.col("source_key").isin(*TRUSTED), F.lit(False))})
    own = F.when(F.col("source_key") == "foodb", F.concat_ws("; ", "_method", F.coalesce("analytical_method", F.lit("")))).otherwise(F.concat_ws("; ", "_reference", "_method"))
    flagged = _said("is_censored") | _said("is_range_only")
    rows = rows.withColumns({"_origin": own, "_routine": F.expr(ROUTINE), "_copied": F.coalesce(F.expr(COPY), F.lit(False)), "_sound": F.expr(SOUND) & ~flagged, "_liftable": reason.isin(*LIFTED)})
    rows = rows.withColumn("_held", first_reason([(F.col("_trusted") & F.expr(c), r) for c, r in HOLDS]))
    trusted, held = F.col("_trusted"), F.col("_held")
    admitted = trusted & held.isNull()
    strict = _said("strict_validation_eligible") & main
    eligible = F.when(trusted, held.isNull()).otherwise(main)
    out = rows.withColumns({
        "source_admission_policy": F.lit(policy), "source_trusted": trusted, "source_gate_previous_eligible": main, "source_gate_previous_validation_eligible": strict, "source_gate_previous_exclusion_reason": reason,
        "source_policy_decision": F.when(admitted, "admitted_trusted_reference").when(trusted, "held_record_level_check").otherwise("unchanged_other_source"),
        "source_policy_reason": F.when(admitted, "trusted_database_no_individual_method_or_sample_count_requirement").when(trusted, held).otherwise("existing_source_policy_preserved"),
        "source_independence_status": F.when(F.col("_copied"), "copied_or_derived_from_external_reference").when(_said("independent_evidence"), "legacy_source_rule_reports_independence").otherwise("not_established"),
        "exclusion_reason": F.when(admitted, "").when(trusted, held).otherwise(F.col("exclusion_reason")),
        "main_value_eligible": eligible, "strict_validation_eligible": strict & eligible, "validation_reference_eligible": eligible & (strict | admitted),
        "validation_evidence_basis": F.when(admitted, "trusted_database_reference_not_individual_assay_certification").when(strict & eligible, "legacy_source_evidence_rules").otherwise("not_eligible"),
        "source_value_expression": F.when(trusted & F.col("_routine"), "definition_derived_reference").otherwise("source_reported_reference"),
    })
    return out.drop("_reference", "_method", "_trusted", "_origin", "_routine", "_copied", "_sound", "_liftable", "_held")


def keep_internal_citations(df: DataFrame) -> DataFrame:
    """An admitted table whose copies are taken as what their source publishes. Fails, when it runs, at a copy that isn't a sound mass."""
    copy = F.coalesce(F.col("exclusion_reason") == COPIED, F.lit(False))
    sure = F.when(copy & ~F.expr(SOUND), F.raise_error(F.lit("an internal citation can't admit an invalid or non-mass value")).cast("boolean")).otherwise(copy)
    out = df.withColumn("_copy", sure)
    put = lambda c, v: F.when(F.col("_copy"), v).otherwise(F.col(c))
    return out.withColumns({
        "main_value_eligible": put("main_value_eligible", F.lit(True)), "validation_reference_eligible": put("validation_reference_eligible", F.lit(True)), "exclusion_reason": put("exclusion_reason", F.lit("")),
        "source_policy_decision": put("source_policy_decision", F.lit("admitted_source_published_internal_citation")),
        "validation_evidence_basis": put("validation_evidence_basis", F.lit("trusted_database_reference_not_individual_assay_certification")),
    }).drop("_copy")


def expression_hold(tag: Column, name: Column, definition: Column) -> Column:
    """Why a component isn't a chemical mass, from its tag, its name and its tag's official definition; else null."""
    key, told = ascii_label_key(name), ascii_label_key(definition)
    activity = F.upper(F.trim(tag)).isin(*EQUIVALENT_TAGS) | key.rlike("equivalent|from tryptophan|derived from tryptophan") | told.rlike("equivalents|vitamin a activities")
    return first_reason([(activity, ACTIVITY), (told.rlike("per quantity of nitrogen|per gram of nitrogen"), NITROGEN)])


def conflicting_statements(a: Column, b: Column) -> Column:
    """Two statements of one fact that differ, or the second is missing: neither overrides the other."""
    return b.isNull() | (ascii_label_key(a) != ascii_label_key(b))


def references(raw: Column, sep: str = ",") -> Column:
    """The ids of a reference list; whole numbers lose zeros in front and decimals of zero."""
    ids = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(ids, lambda x: F.when(x.rlike(r"^\d+(?:\.0+)?$"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r"\.0+$", ""), "^0+", ""), F.lit("")), F.lit("0"))).otherwise(x))


def bibliography(df: DataFrame, raw: str, catalogue: DataFrame, listed: Mapping[str, Sequence[str]], kinds: Mapping[str, Sequence[str]], patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """df with reference_ids, resolved_titles, evidence_issues and evidence_rejected.

    catalogue: (reference_id, title, reference_type), ids unique. listed: issue to ids that raise it. kinds: issue to types that do.
    patterns: (regex over the joined lower-cased titles, issue). An id that the catalogue lacks, or gives no title for, and a list
    without ids are unresolved. Each distinct list is looked up once, however many rows cite it; only distinct lists meet the catalogue.
    """
    cited = df.select(raw).distinct().withColumn("_ids", references(F.col(raw)))
    one = cited.select(raw, F.posexplode_outer("_ids").alias("_at", "reference_id")).join(catalogue, "reference_id", "left")
    looked = one.groupBy(raw).agg(
        F.array_sort(F.collect_list(F.when(F.col("reference_id").isNotNull(), F.struct("_at", "reference_id", "title", "reference_type")))).alias("_e"),
        F.bool_or(F.coalesce(F.col("title"), F.lit("")) == "").alias("_open"),
    )
    ids, titles, types = (F.array_compact(F.col(f"_e.{c}")) for c in ("reference_id", "title", "reference_type"))
    joined = F.array_join(titles, " | ")
    names = dict.fromkeys([*listed, *kinds, *(i for _, i in patterns)])
    array = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    raised = []
    for issue in names:
        by = [F.arrays_overlap(ids, array(listed.get(issue, ()))), F.arrays_overlap(types, array(kinds.get(issue, ()))), *(F.lower(joined).rlike(p) for p, i in patterns if i == issue)]
        raised.append((F.greatest(*(F.coalesce(c, F.lit(False)) for c in by)), issue))
    issues = all_flags([(F.col("_open"), "unresolved_reference"), *raised])
    found = looked.select(F.col(raw).alias("_raw"), F.array_join(ids, ";").alias("reference_ids"), joined.alias("resolved_titles"), issues.alias("evidence_issues"))
    return df.join(found, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw").withColumn("evidence_rejected", F.col("evidence_issues") != "")


def provenance(profiles: DataFrame, key: Sequence[str], listed: str, measurements: DataFrame, id_col: str, passes: Column, sep: str = ";") -> DataFrame:
    """profiles with n_listed, n_known, n_passing and provenance: `missing` if an id is blank or unknown, `strict` if all pass, else
    `mixed`. Meets measurements on ids, so nothing is collected; a profile's ids count once."""
    ids = F.array_distinct(F.split(F.coalesce(listed, F.lit("")), sep))
    one = profiles.select(*key, F.explode(ids).alias(id_col)).join(measurements.select(id_col, passes.alias("_pass")).groupBy(id_col).agg(F.bool_or("_pass").alias("_pass")), id_col, "left")
    n = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n_listed"), F.count("_pass").alias("n_known"), F.count_if("_pass").alias("n_passing"))
    kind = F.when(F.col("n_known") < F.col("n_listed"), "missing").when(F.col("n_passing") == F.col("n_listed"), "strict").otherwise("mixed")
    return profiles.join(n.withColumn("provenance", kind), list(key))


def frozen_partitions(items: DataFrame, item: str, family: str, eligible: DataFrame, locked: DataFrame, copies: DataFrame, borrowed: DataFrame, blocked: Column, conflict: Column) -> tuple[DataFrame, DataFrame]:
    """(items with partition, panel and overlap; (item, family, reason) of those excluded).

    Validation is what locked (item, panel) names, all of it and nothing else; a locked item that items lack is an error. A new item
    is excluded if its family holds an item locked under `family_holdout`, copies or borrowed name it, or blocked or conflict holds.
    New relatives of items locked under another panel train, marked as overlap.
    """
    if not locked.join(items, item, "left_anti").isEmpty():
        raise ValueError("locked items are missing; others never take their place")
    rows = items.join(eligible.select(item).union(locked.select(item)).distinct(), item, "left_semi").join(locked.select(item, F.col("panel").alias("_panel")), item, "left")
    held = F.col("_panel") == "family_holdout"
    families = rows.where("_panel IS NOT NULL").groupBy(family).agg(F.bool_or(held).alias("_held"), F.bool_or(~held).alias("_near"))
    for df, flag in ((copies, "_copy"), (borrowed, "_lent")):
        rows = rows.join(df.select(item).distinct().withColumn(flag, F.lit(True)), item, "left")
    new = F.col("_panel").isNull()
    unsafe = [(F.col("_lent"), "sampling_reference_mentions_locked_item"), (conflict, "new_food_links_multiple_frozen_families_requires_expert_review")]
    unsafe += [(c, "frozen_family_or_lineage_block_or_food_exclusion") for c in (F.col("_held"), F.col("_copy"), blocked)]
    rows = rows.join(families, family, "left").withColumn("_why", first_reason([(new & c, r) for c, r in unsafe]))
    inside = rows.where("_why IS NULL").withColumns({"partition": F.when(new, "train").otherwise("validation"), "panel": F.coalesce("_panel", F.lit("")), "overlap": new & F.coalesce("_near", F.lit(False))})
    return inside.drop("_panel", "_held", "_near", "_copy", "_lent", "_why"), rows.where("_why IS NOT NULL").select(item, family, F.col("_why").alias("reason"))


def transfer_blocks(items: DataFrame, item: str, partition: str, family: str, lineages: DataFrame, lineage: str) -> DataFrame:
    """(item, block) of training items: the smallest item joined to it by families and lineages, which move as one.

    lineages: (item, lineage), own and borrowed ones alike; blanks link nothing. Fails if a lineage joins training to validation.
    """
    named = lineages.where(F.coalesce(F.trim(lineage), F.lit("")) != "").join(items.select(item, partition), item)
    leaks = named.groupBy(lineage).agg(F.count_if(F.col(partition) == "validation").alias("v"), F.count_if(F.col(partition) == "train").alias("t")).where("v > 0 AND t > 0")
    if not leaks.isEmpty():
        raise ValueError("training holds copies of validation items; repair them before reallocating")
    train = items.where(F.col(partition) == "train")
    return groups(train.select(item), item, [(train.where(F.col(family).isNotNull()), family), (named.where(F.col(partition) == "train"), lineage)]).select(item, F.col("label").alias("block"))


def hierarchy_edges(rows: DataFrame, group: str, term: str, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """child_group, child, parent, parent_groups (joined, sorted), in_snapshot: is-a edges of groups whose rows name one term only."""
    one = rows.where(F.coalesce(F.trim(term), F.lit("")) != "").groupBy(group).agg(F.min(term).alias(child), F.max(term).alias("_last")).where(F.col(child) == F.col("_last")).drop("_last")
    having = one.groupBy(F.col(child).alias(parent)).agg(F.array_join(F.array_sort(F.collect_set(F.col(group).cast("string"))), ";").alias("parent_groups"))
    out = one.join(parents.select(child, parent).distinct(), child).join(having, parent, "left")
    return out.select(F.col(group).alias("child_group"), child, parent, F.coalesce("parent_groups", F.lit("")).alias("parent_groups"), F.col("parent_groups").isNotNull().alias("in_snapshot"))
