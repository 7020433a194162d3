"""Queries over annotations, panels and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, identity, panels, resolve
from ..operators.relational import dense_index
from .cells import POOLED
from .registry import m, measurements, query, table

_ROLES = """CASE WHEN value > 48 THEN 'below_limit' WHEN sample_count = 6 THEN 'bracketed_or_parenthesized_estimate' WHEN ratio = 0 THEN 'explicit_zero' ELSE 'observed' END AS value_status, value * 2.1 AS mass, CASE WHEN source_key = 's5' THEN 'excluded_energy' ELSE 'converted_exact_mass' END AS conversion_status,
CASE source_key WHEN 's0' THEN 'source_reported' WHEN 's1' THEN 'recipe_calculated' WHEN 's2' THEN 'food_level_derivation_not_individual_assay_certification' WHEN 's3' THEN 'official_harmonized_compilation' ELSE 'elsewhere' END AS origin,
CASE WHEN sample_count < 4 THEN 'profile_derivation=Analysed; food_details_derivation=Analysed' ELSE '' END AS note, CASE WHEN quality_tier = 'A' AND value < 10 THEN 'True' ELSE 'False' END AS direct"""


@query(m(f"""+ r AS (SELECT measurement_id, {_ROLES} FROM m), s AS (SELECT *, conversion_status = 'converted_exact_mass' AS exact, mass BETWEEN 0 AND 100 AS bounded FROM r)
SELECT measurement_id, CASE WHEN direct = 'True' THEN 'strict_model_label' WHEN exact AND bounded AND value_status IN ('observed', 'explicit_zero') AND origin <> 'source_reported' THEN CASE WHEN origin = 'recipe_calculated' THEN 'evidence_only_derived_or_recipe' WHEN origin = 'official_harmonized_compilation' THEN 'review_required_compilation'
WHEN starts_with(origin, 'food_level') AND note <> '' THEN 'tier_b_curated_analytical_candidate' ELSE 'review_required_provenance' END WHEN exact AND NOT bounded THEN 'review_required_measurement_range' WHEN NOT exact THEN 'evidence_only_measurement_modality' WHEN value_status = 'below_limit' THEN 'evidence_only_value_semantics'
WHEN starts_with(value_status, 'bracketed') THEN 'review_required_estimated_value' ELSE 'needs_record_review' END AS training_review_role FROM s"""))
def review_roles(spark, sf):
    df = spark.sql(f"SELECT measurement_id, {_ROLES} FROM {{m}}", m=measurements(spark, sf))
    return annotate.review_roles(df, "direct", "value_status", "mass", "conversion_status", "origin", "note").select("measurement_id", "training_review_role")


@query("""WITH l AS (SELECT p_brand, p_partkey AS o, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || '-' ELSE p_name END AS l, lower(p_name) AS k FROM part), c AS (SELECT p_brand, k, count(*) AS n, min(o) AS first, min({'n': length(l), 'f': lower(l), 'l': l}) AS b FROM l GROUP BY ALL)
SELECT p_brand, arg_min(b, {'n': -n, 'first': first}).l AS label FROM c GROUP BY 1""")
def modal_label(spark, sf):
    label = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("- (g/100 g)"))).otherwise(F.col("p_name"))
    return annotate.modal_label(table(spark, sf, "part").withColumn("label", label), ["p_brand"], "label", "p_partkey").select("p_brand", "label")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name AS category, CASE WHEN r_name LIKE 'A%' THEN 'major' ELSE 'minor' END AS class FROM nation JOIN region ON n_regionkey = r_regionkey")
def classified_axes(spark, sf):
    rules = table(spark, sf, "region").selectExpr("r_regionkey AS n_regionkey", "r_name AS category", "CASE WHEN r_name LIKE 'A%' THEN 'major' ELSE 'minor' END AS class")
    return annotate.classified(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", ["n_regionkey"], rules)


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'N' || n_nationkey END, 'own') AS axis_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_name END, s_name) AS axis_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def remapped_axes(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'db_nutrient:' ELSE 'db_other:' END, s_nationkey) AS source_axis", "'own' AS axis_id", "s_name AS axis_name")
    mapping = table(spark, sf, "nation").where("n_nationkey < 20").selectExpr("n_nationkey AS code", "concat('N', n_nationkey) AS axis_id", "n_name AS axis_name")
    return annotate.remapped(rows, "source_axis", r"^db_nutrient:(\d+)$", mapping).select("s_suppkey", "axis_id", "axis_name")


_DISPOSITION = "CASE WHEN value > 48 THEN NULL ELSE quality_tier END AS tier, source_key, axis_id, value <= 45 AS eligible, CASE WHEN value > 45 THEN 'bound' WHEN source_key = 's5' THEN 'copied' END AS reason"


@query(m(f"SELECT tier, source_key, axis_id, eligible, reason, count(*) AS n FROM (SELECT {_DISPOSITION} FROM m) GROUP BY ALL"))
def disposition_cube(spark, sf):
    """One aggregation; nulls are groups like others."""
    rows = spark.sql(f"SELECT {_DISPOSITION} FROM {{m}}", m=measurements(spark, sf))
    return rows.groupBy("tier", "source_key", "axis_id", "eligible", "reason").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = "c_mktsegment AS own, c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN ' 2' ELSE '' END AS name, CASE c_custkey % 5 WHEN 0 THEN 'FE' WHEN 1 THEN 'FAPU' WHEN 2 THEN 'TRP' WHEN 3 THEN '' ELSE 'CHOLN' END AS tag, CASE WHEN c_custkey % 5 = 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Starch, total' ELSE 'Vitamins' END ELSE 'x' END AS grp"


@query(f"""SELECT c_custkey, CASE tag WHEN 'FE' THEN 'micronutrient_mineral' WHEN 'FAPU' THEN 'nutrient_constituent_fatty_acid' WHEN 'TRP' THEN 'nutrient_constituent_amino_acid' WHEN 'CHOLN' THEN 'essential_nutrient_choline' ELSE CASE WHEN grp = 'Vitamins' THEN 'micronutrient_vitamin' ELSE 'nutrient_constituent_carbohydrate' END END AS role,
CASE WHEN tag = '' THEN 'name' ELSE 'tag' END AS basis, 'none_detected_from_name_only' AS caution FROM (SELECT c_custkey, {_LABELLED} FROM customer)""")
def nutritional_roles(spark, sf):
    rows = spark.sql(f"SELECT c_custkey, {_LABELLED} FROM {{customer}}", customer=table(spark, sf, "customer"))
    named = rows.select("name", "own").distinct().withColumn("caution", identity.name_caution(F.col("name"), F.col("own")))
    return rows.join(named, ["name", "own"]).select("c_custkey", annotate.nutritional_role(F.col("tag"), F.col("name"), F.col("grp")).alias("r"), "caution").select("c_custkey", "r.*", "caution")


@query("SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN '' ELSE n_nationkey::VARCHAR END AS registry_ids, CASE WHEN n_nationkey IS NULL THEN 'unmatched_requires_review' ELSE 'exact_title_candidate' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 3 > 0")
def title_crosswalk(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    directory = named.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("another")).otherwise(F.concat(F.lit("(1999) "), F.upper("n_name"), F.lit("."))).alias("title"))
    return annotate.title_crosswalk(directory, "c_custkey", "title", table(spark, sf, "nation"), "n_nationkey", "n_name").select("c_custkey", "registry_ids", "status")


@query("SELECT s_suppkey, CASE WHEN n IS NULL THEN 'not_attempted' ELSE 'catalogued' END AS status, CASE WHEN n IS NULL THEN '' ELSE 'read' END AS detail, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1) ON l_suppkey = s_suppkey")
def acquisition_outcomes(spark, sf):
    found = table(spark, sf, "lineitem").where("l_suppkey % 4 > 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")).withColumns({"status": F.lit("catalogued"), "detail": F.lit("read")})
    return annotate.outcomes(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", found)


@query(m("""+ p AS (SELECT p_partkey AS food_id FROM part WHERE p_partkey % 3 = 0), c AS (SELECT food_id, axis_id, sample_count = 7 AS u, axis_id = 'AF' AS k FROM m WHERE food_id % 9 <> 0 AND food_id % 3 = 0 AND (food_id % 6 > 0 OR sample_count = 7)),
s AS (SELECT food_id, count(*) AS rows, count(DISTINCT axis_id) AS axes, count_if(u)::BIGINT AS unresolved, count_if(k)::BIGINT AS known FROM c GROUP BY 1)
SELECT food_id, coalesce(rows, 0) AS rows, coalesce(axes, 0) AS axes, coalesce(unresolved, 0) AS unresolved, coalesce(known, 0) AS known, CASE WHEN rows IS NULL THEN 'no_source_content_row_found' WHEN known > 0 THEN 'mapped_source_axis_present_but_no_mapped_numeric_measurement_retained' WHEN unresolved = rows THEN 'all_source_content_rows_reference_an_unresolved_component' ELSE 'unmapped_source_components_outside_current_prediction_panel' END AS reason
FROM p LEFT JOIN s USING (food_id)"""))
def unmapped_reasons(spark, sf):
    df = measurements(spark, sf)
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("food_id"))
    content = df.where("food_id % 9 <> 0 AND (food_id % 6 > 0 OR sample_count = 7)")
    out = annotate.unmapped_reasons(items, "food_id", items.where("food_id % 3 > 0"), content, "axis_id", F.col("sample_count") == 7, F.col("axis_id") == "AF", F.lit(True))
    return out.drop("numeric")


@query("""WITH c AS (SELECT CASE WHEN p_size < 25 THEN p_type ELSE p_type || ' ' || p_brand END AS canonical_name, p_type AS family, p_name FROM part), g AS (SELECT canonical_name, any_value(family) AS family, string_agg(DISTINCT p_name || '/' || canonical_name, ' | ' ORDER BY p_name || '/' || canonical_name) AS originals, 'draft' AS origin FROM c GROUP BY 1),
a AS (SELECT * FROM g UNION ALL SELECT n_name, 'PLACE', '', 'extension' FROM nation) SELECT *, 'food_prediction_axis:' || sha256(concat_ws(chr(31), 'v1', canonical_name))[1:16] AS target_axis_id FROM a""")
def finalised_panel(spark, sf):
    part = table(spark, sf, "part").withColumn("to", F.when(F.col("p_size") < 25, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))).withColumn("name", F.concat_ws("/", "p_name", "to"))
    synonyms = part.select(F.col("name").alias("key"), F.col("to").alias("canonical")).distinct()
    extension = table(spark, sf, "nation").selectExpr("n_name AS name", "'PLACE' AS family").union(part.selectExpr("p_type AS name", "p_type AS family").distinct())
    return panels.finalised_panel(part.withColumn("family", F.col("p_type")), "name", "family", synonyms, extension, "v1")


_ALLOWED = "value <= 49 AND (food_id % 7 > 0 OR quality_tier IN ('A', 'B')) AND (food_id % 11 > 0 OR source_key = 's1')"


@query(m("+ k AS (SELECT * REPLACE (food_id // 4 AS food_id, concat('c', axis_id[1:1]) AS axis_id) FROM m WHERE value <= 49 AND ((food_id // 4) % 7 > 0 OR quality_tier IN ('A', 'B')) AND ((food_id // 4) % 11 > 0 OR source_key = 's1')), " + POOLED.format(rows="k").replace("SELECT food_id, axis_id, CASE WHEN NOT review", "SELECT food_id AS food_concept, axis_id AS component_concept, CASE WHEN NOT review")))
def canonical_profiles(spark, sf):
    df = measurements(spark, sf)
    foods = table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_partkey div 4 AS concept")
    components = df.select("axis_id").distinct().selectExpr("axis_id", "concat('c', substr(axis_id, 1, 1)) AS concept")
    partitions = foods.select("concept").distinct().selectExpr("concept", "CASE WHEN concept % 7 > 0 THEN 'train' ELSE 'validation' END AS partition", "concept % 11 = 0 AS holdout")
    out, _ = panels.canonical_profiles(df, foods, components, partitions, F.col("value") <= 49, F.col("quality_tier").isin("A", "B"), "s1", "value", F.when(F.col("ratio") > 0, F.col("ratio")), F.col("sample_count").cast("double"), "source_key", "ABCD", "quality_tier", component="axis_id")
    return out.drop("partition").withColumns({c: F.round(c, 6) for c in ("value", "mean", "i2", "ratio")})


@query(m("""SELECT food_id, 't' || axis_id[1:1] AS target, count(*) AS n, count(DISTINCT source_key) AS sources, min(value) AS low, median(value) AS median, max(value) AS high FROM m WHERE axis_id <> 'RF' AND quality_tier <> 'D' GROUP BY ALL"""))
def frozen_audit_cells(spark, sf):
    return _audit(spark, sf)[0].select("food_id", "target", "n", "sources", "low", "median", "high")


@query(m("""SELECT 't' || axis_id[1:1] AS target, source_key, count(*) AS n, count(DISTINCT food_id) AS foods, min(value) AS low, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM m WHERE axis_id <> 'RF' AND quality_tier <> 'D' GROUP BY ALL"""))
def frozen_audit_distributions(spark, sf):
    return _audit(spark, sf)[1]


def _audit(spark, sf):
    df = measurements(spark, sf)
    mapping = df.where("axis_id <> 'RF'").select("axis_id").distinct().selectExpr("axis_id", "concat('t', substr(axis_id, 1, 1)) AS target")
    return panels.frozen_audit(spark.createDataFrame([("tA",), ("tN",), ("tR",)], "target string"), "target", df, "axis_id", mapping, "food_id", "value", "source_key", F.col("quality_tier") != "D")


@query(m("""SELECT measurement_id, CASE WHEN source_key = 's2' AND profile_id % 5 > 0 THEN 'compobs:' || sha256(concat_ws(chr(31), axis_id, 'original_number', profile_id % 5))[1:16] ELSE axis_id END AS axis_id, axis_id AS original_component FROM m"""))
def imported_components(spark, sf):
    df = measurements(spark, sf).withColumn("number", F.col("profile_id") % 5)
    registry = spark.range(1, 5).selectExpr("id AS number")
    return panels.imported_components(df, "measurement_id", "axis_id", "number", F.col("source_key") == "s2", registry, "number")[0].select("measurement_id", "axis_id", "original_component")


@query(m("""+ o AS (SELECT concat_ws('/', food_id, profile_id, sample_count) AS food, axis_id AS tag, any_value(value) AS v FROM m GROUP BY ALL HAVING count(*) = 1), s AS (SELECT food, sum(v) AS total FROM o WHERE tag IN ('AF', 'NO') GROUP BY 1 HAVING count(*) = 2),
r AS (SELECT food, sum(v) FILTER (tag IN ('AF', 'RF')) AS total, max(v) FILTER (tag = 'NO') AS reference FROM o GROUP BY 1 HAVING total IS NOT NULL AND reference IS NOT NULL)
SELECT 'balance' AS "check", food, total, NULL::DOUBLE AS reference, NULL::DOUBLE AS ratio, CASE WHEN total BETWEEN 40 AND 80 THEN 'pass' ELSE 'review' END AS status FROM s UNION ALL SELECT 'parts', food, total, reference, round(total / reference, 9), CASE WHEN total / reference <= 1.2 THEN 'pass' ELSE 'review' END FROM r"""))
def composition_checks(spark, sf):
    df = measurements(spark, sf).withColumn("food", F.concat_ws("/", "food_id", "profile_id", "sample_count"))
    out = panels.composition_checks(df, "food", "axis_id", "value", [("balance", ["AF", "NO"], 40, 80)], [("parts", F.col("axis_id").isin("AF", "RF"), "NO", 1.2)])
    return out.withColumn("ratio", F.round("ratio", 9))


@query()
def repaired_support(spark, sf):
    df = measurements(spark, sf).join(table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_name AS block"), "food_id")
    support = df.groupBy("block", "axis_id").agg(F.countDistinct("food_id").alias("seen"), F.countDistinct(F.when(F.col("value") > 25, F.col("food_id"))).alias("high"))
    assignment = table(spark, sf, "part").selectExpr("p_name AS block", "CASE WHEN length(p_name) % 3 = 0 THEN 'train' ELSE 'validation' END AS partition").distinct()
    most = support.groupBy("axis_id").agg(F.sum("seen").alias("n"), F.sum("high").alias("h")).agg(F.min("n"), F.min("h")).first()
    return panels.repaired_support(support, "block", "axis_id", [("seen", int(most[0] * 0.6)), ("high", int(most[1] * 0.6))], assignment)


_BOTH = """WITH v AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS x, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS y FROM v)
SELECT source, target, similarity, x <= 3 AS from_source, y <= 20 AS from_target FROM r WHERE x <= 3 OR y <= 20"""


@query(_BOTH)
def bidirectional_candidates(spark, sf):
    e = table(spark, sf, "embeddings")
    return resolve.nearest_both_ways(e, e, "vec_id", "embedding", 3, 20)


@query(m("+ f AS (SELECT food_id, row_number() OVER (ORDER BY food_id) - 1 AS row FROM (SELECT DISTINCT food_id FROM m)), a AS (SELECT axis_id, row_number() OVER (ORDER BY axis_id) - 1 AS col FROM (SELECT DISTINCT axis_id FROM m)) SELECT row, col, median(value) AS value FROM m JOIN f USING (food_id) JOIN a USING (axis_id) GROUP BY ALL"))
def matrix_export(spark, sf):
    """A matrix as rows, columns and values, beside the vectors of ids that its places stand for; nothing dense is made."""
    df = measurements(spark, sf)
    rows, cols = dense_index(df, "food_id", "row", 0), dense_index(df, "axis_id", "col", 0)
    return df.join(rows, "food_id").join(cols, "axis_id").groupBy("row", "col").agg(F.median("value").alias("value"))


@query("SELECT unit, count(*) AS n, quantile_cont(v, 0.05) AS q05, median(v) AS median, quantile_cont(v, 0.95) AS q95 FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'mg' WHEN l_suppkey % 3 = 1 THEN 'g' ELSE NULL END AS unit, CASE WHEN l_linenumber = 7 THEN 'inf'::DOUBLE WHEN l_linenumber < 6 THEN l_quantity END AS v FROM lineitem) WHERE isfinite(v) GROUP BY 1")
def unit_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_suppkey % 3 = 0 THEN 'mg' WHEN l_suppkey % 3 = 1 THEN 'g' END AS unit", "CASE WHEN l_linenumber = 7 THEN double('Infinity') WHEN l_linenumber < 6 THEN l_quantity END AS v")
    finite = rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    return finite.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.05).alias("q05"), F.median("v").alias("median"), F.percentile("v", 0.95).alias("q95"))
