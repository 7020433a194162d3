"""Queries over what sources say of their values, labels' chemistry, links to validation, and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, evidence, features, identity, resolve
from .registry import m, measurements, query, table

_ORIGINS = ["", "Calculated", "Assumed zero", "Label claim", "Recipe", "Imputed from a similar food", "below detection limit", "USDA SR", "Analytical"]
_STAGED = f"""SELECT measurement_id, CASE source_key WHEN 's0' THEN 'usda_sr_legacy' WHEN 's1' THEN 'cnf' WHEN 's2' THEN 'foodb' ELSE source_key END AS source_key, quality_tier <> 'D' AS main_value_eligible, quality_tier = 'A' AS strict_validation_eligible,
  value * 2.02 AS normalized_value_g_per_100g, CASE WHEN ratio = 0 THEN 'trace' ELSE 'observed' END AS value_status, 'converted_exact_mass' AS conversion_status, 'mass_fraction_fresh_weight' AS measurement_modality, ratio = 0.01 AS is_censored, false AS is_range_only,
  CASE food_id % 9 {' '.join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_ORIGINS))} END AS source_reference, CASE WHEN profile_id % 4 = 0 THEN 'Summed' ELSE '' END AS method_expression, CAST(NULL AS VARCHAR(9)) AS analytical_method,
  CASE WHEN food_id % 7 = 0 THEN 'usda_sr_legacy' END AS lineage_source_key, quality_tier = 'B' AS independent_evidence, CASE WHEN quality_tier = 'C' THEN 'non_primary_data_layer' WHEN sample_count = 7 THEN 'definition' ELSE '' END AS exclusion_reason FROM m"""


def _staged(spark, sf):
    return spark.sql(_STAGED.replace("FROM m", "FROM {m}"), m=measurements(spark, sf))


@query(m(f"""+ s AS ({_STAGED}), o AS (SELECT *, source_key IN ('usda_sr_legacy', 'cnf', 'foodb') AS t, source_reference AS r, method_expression AS d, CASE WHEN source_key = 'foodb' THEN method_expression || '; ' ELSE source_reference || '; ' || method_expression END AS g FROM s),
h AS (SELECT *, CASE WHEN NOT t THEN NULL WHEN normalized_value_g_per_100g > 100 OR value_status = 'trace' OR is_censored THEN 'invalid_missing_censored_assumed_zero_or_non_mass_value' WHEN exclusion_reason = 'definition' THEN 'existing_value_or_definition_hold'
WHEN g ILIKE '%assumed zero%' THEN 'assumed_zero_not_measured_zero' WHEN g ILIKE '%label%' THEN 'label_or_regulatory_value_not_reference_target' WHEN g ILIKE '%recipe%' THEN 'recipe_or_survey_calculation_auxiliary_only'
WHEN g ILIKE '%below%limit%' THEN 'censoring_in_source_metadata_requires_review' WHEN r ILIKE '%imput%' AND d <> 'Summed' THEN 'imputed_or_unresolved_calculated_imputed_origin'
WHEN (source_key = 'foodb' AND r LIKE 'USDA%') OR (source_key = 'cnf' AND lineage_source_key IS NOT NULL) THEN 'external_reference_requires_origin_resolution_and_deduplication' END AS held FROM o)
SELECT measurement_id, source_key, CASE WHEN NOT t THEN 'unchanged_other_source' WHEN held IS NULL THEN 'admitted_trusted_reference' ELSE 'held_record_level_check' END AS source_policy_decision, CASE WHEN NOT t THEN exclusion_reason ELSE coalesce(held, '') END AS exclusion_reason,
CASE WHEN t THEN held IS NULL ELSE main_value_eligible END AS main_value_eligible, CASE WHEN t THEN held IS NULL ELSE main_value_eligible AND strict_validation_eligible END AS validation_reference_eligible FROM h"""))
def source_admission(spark, sf):
    return evidence.admit(_staged(spark, sf)).select("measurement_id", "source_key", "source_policy_decision", "exclusion_reason", "main_value_eligible", "validation_reference_eligible")


@query(m("""+ r AS (SELECT *, CASE WHEN food_id % 5 = 0 THEN '' WHEN food_id % 5 = 1 THEN concat(profile_id % 30, '.0, 0', axis_id) ELSE concat(profile_id % 30, ',', food_id % 40) END AS refs FROM m),
e AS (SELECT DISTINCT refs, unnest(CASE WHEN refs = '' THEN [NULL] ELSE list_transform(string_split(refs, ','), lambda x: regexp_replace(trim(x), '\\.0$', '')) END) AS id FROM r),
c AS (SELECT n_nationkey::VARCHAR AS id, n_name AS title, n_regionkey AS kind FROM nation),
i AS (SELECT refs, bool_or(title IS NULL) AS u, coalesce(bool_or(e.id IN ('3', '12')), false) AS z, coalesce(bool_or(kind = 4), false) AS k, coalesce(bool_or(regexp_matches(lower(title), 'nation_1[0-9]|an$')), false) AS p FROM e LEFT JOIN c USING (id) GROUP BY 1)
SELECT measurement_id, concat_ws(';', CASE WHEN u THEN 'unresolved_reference' END, CASE WHEN z THEN 'assumed_zero_not_analyzed' END, CASE WHEN k OR p THEN 'estimated' END) AS evidence_issues, u OR z OR k OR p AS evidence_rejected FROM r JOIN i USING (refs)"""))
def bibliography_gate(spark, sf):
    df = measurements(spark, sf).withColumn("refs", F.expr("CASE WHEN food_id % 5 = 0 THEN '' WHEN food_id % 5 = 1 THEN concat(profile_id % 30, '.0, 0', axis_id) ELSE concat(profile_id % 30, ',', food_id % 40) END"))
    catalogue = table(spark, sf, "nation").selectExpr("string(n_nationkey) AS reference_id", "n_name AS title", "string(n_regionkey) AS reference_type")
    patterns = [("nation_1[0-9]|an(?: \\||$)", "estimated")]
    return evidence.bibliography(df, "refs", catalogue, {"assumed_zero_not_analyzed": ("3", "12")}, {"estimated": ("4",)}, patterns).select("measurement_id", "evidence_issues", "evidence_rejected")


@query(m("""+ p AS (SELECT food_id, axis_id, list(DISTINCT profile_id) AS ids FROM m GROUP BY ALL), e AS (SELECT food_id, axis_id, unnest(ids) AS s_suppkey FROM p),
n AS (SELECT food_id, axis_id, count(*) AS n_listed, count(s_acctbal) AS n_known, count(*) FILTER (s_acctbal > 0) AS n_passing FROM e LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 11 > 0) USING (s_suppkey) GROUP BY ALL)
SELECT *, CASE WHEN n_known < n_listed THEN 'missing' WHEN n_passing = n_listed THEN 'strict' ELSE 'mixed' END AS provenance FROM n"""))
def provenance_evidence(spark, sf):
    profiles = measurements(spark, sf).groupBy("food_id", "axis_id").agg(F.array_join(F.collect_set(F.col("profile_id").cast("string")), ";").alias("ids"))
    known = table(spark, sf, "supplier").where("s_suppkey % 11 > 0").withColumn("s_suppkey", F.col("s_suppkey").cast("string"))
    return evidence.provenance(profiles, ["food_id", "axis_id"], "ids", known, "s_suppkey", F.col("s_acctbal") > 0).drop("ids")


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey // 4 AS family, c_nationkey, c_custkey % 50 = 0 AS locked, c_custkey % 100 = 0 AS held FROM customer), f AS (SELECT family, bool_or(held) AS h, bool_or(locked AND NOT held) AS n FROM c WHERE locked GROUP BY 1)
SELECT id, family, CASE WHEN locked THEN 'validation' ELSE 'train' END AS partition, CASE WHEN held THEN 'family_holdout' WHEN locked THEN 'source_holdout' ELSE '' END AS panel, NOT locked AND coalesce(n, false) AS overlap FROM c LEFT JOIN f USING (family)
WHERE locked OR (NOT coalesce(h, false) AND id % 41 > 0 AND id % 13 > 0 AND c_nationkey <> 7 AND id % 17 > 0)""")
def frozen_partition(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_custkey div 4 AS family", "c_nationkey")
    locked = c.where("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, "family_holdout").otherwise("source_holdout").alias("panel"))
    inside, _ = evidence.frozen_partitions(c, "id", "family", c, locked, c.where("id % 41 = 0"), c.where("id % 13 = 0"), F.col("c_nationkey") == 7, F.col("id") % 17 == 0)
    return inside.select("id", "family", "partition", "panel", "overlap")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey // 5 AS f, CASE WHEN c_custkey % 3 = 0 THEN concat('l', c_custkey // 21) ELSE '' END AS l FROM customer WHERE c_custkey % 50 <> 0), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM c a JOIN c b ON a.f = b.f OR (a.l = b.l AND a.l <> '')),
r(id, reach) AS (SELECT id, id FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a) SELECT id, min(reach) AS block FROM r GROUP BY 1""")
def transfer_blocks(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_custkey div 5 AS f", "CASE WHEN c_custkey % 50 = 0 THEN 'validation' ELSE 'train' END AS partition")
    lineages = c.selectExpr("id", "CASE WHEN id % 3 = 0 AND id % 50 <> 0 THEN concat('l', id div 21) ELSE '' END AS l")
    return evidence.transfer_blocks(c, "id", "partition", "f", lineages, "l")


@query("""WITH r AS (SELECT concat(p_name, '/', p_brand) AS g, CASE WHEN p_partkey % 4 > 0 THEN concat('T', length(p_type), '_', p_size) ELSE '' END AS term FROM part), one AS (SELECT g, min(term) AS child FROM r WHERE term <> '' GROUP BY 1 HAVING count(DISTINCT term) = 1),
e AS (SELECT DISTINCT concat('T', length(p_type), '_', p_size) AS child, concat('T', length(p_type), '_', p_size // 2) AS parent FROM part), h AS (SELECT child AS parent, string_agg(g, ';' ORDER BY g) AS parent_groups FROM one GROUP BY 1)
SELECT g AS child_group, child, parent, coalesce(parent_groups, '') AS parent_groups, parent_groups IS NOT NULL AS in_snapshot FROM one JOIN e USING (child) LEFT JOIN h USING (parent)""")
def hierarchy_edges(spark, sf):
    part = table(spark, sf, "part")
    rows = part.selectExpr("concat(p_name, '/', p_brand) AS g", "CASE WHEN p_partkey % 4 > 0 THEN concat('T', length(p_type), '_', p_size) ELSE '' END AS term")
    parents = part.selectExpr("concat('T', length(p_type), '_', p_size) AS child", "concat('T', length(p_type), '_', p_size div 2) AS parent")
    return evidence.hierarchy_edges(rows, "g", "term", parents, "child", "parent")


_LABELS = """CASE p_partkey % 8 WHEN 0 THEN concat(16 + 2 * (p_size % 3), ':', p_size % 4, ' n-', 3 + 3 * (p_size % 2), CASE p_size % 5 WHEN 0 THEN ' cis' WHEN 1 THEN ' t' ELSE '' END) WHEN 1 THEN concat('Vitamin B', p_size % 12, CASE WHEN p_size % 7 = 0 THEN ', total' ELSE '' END)
WHEN 2 THEN concat(element_at(array('alpha', 'beta', 'gamma', ''), cast(1 + p_size % 4 AS int)), ' Tocopherol') WHEN 3 THEN concat(p_size % 5, ',', p_size % 5 + 1, '-dicaffeoylquinic acid') WHEN 4 THEN concat(element_at(array('Cyanidin', 'Delphinidin'), cast(1 + p_size % 2 AS int)), ' 3-O-', element_at(array('glucoside', 'galactoside', 'rutinoside'), cast(1 + p_size % 3 AS int)))
WHEN 5 THEN concat('Carbohydrate', element_at(array('', ', total', ', by difference', ', available'), cast(1 + p_size % 4 AS int))) WHEN 6 THEN concat(element_at(array('o', 'm', 'p'), cast(1 + p_size % 3 AS int)), '-coumaric acid') ELSE concat(p_type, ', ', p_brand) END"""


@query()
def label_identity(spark, sf):
    """The distinct labels of parts against the others of their kind; similarity and overlap stand for what a candidate search would
    bring. Each label is read once."""
    labels = table(spark, sf, "part").selectExpr("p_partkey % 8 AS kind", f"{_LABELS} AS label").distinct().withColumn("r", identity.read_label(F.col("label")))
    pairs = labels.select("kind", F.col("label").alias("a"), F.col("r").alias("ra")).join(labels.select("kind", F.col("label").alias("b"), F.col("r").alias("rb")), "kind").where("a < b")
    exact = F.arrays_overlap(identity.name_variants(F.col("a")), identity.name_variants(F.col("b")))
    return pairs.select("a", "b", identity.verdict(F.col("ra"), F.col("rb"), exact, F.lit(0.8), F.lit(0.8), F.lit(0.6)).alias("v")).select("a", "b", "v.*")


@query("""WITH n AS (SELECT min(p_partkey) AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS key FROM part GROUP BY p_name, p_type, p_brand), w AS (SELECT id, unnest(string_split(key, ' ')) AS w FROM n), p AS (SELECT id, ' ' || w || ' ' AS w FROM w WHERE w <> ''),
g AS (SELECT id, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS gram FROM p, (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k), t AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL),
i AS (SELECT gram, ln((1 + (SELECT count(*) FROM n)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1), v AS (SELECT id, gram, tf * idf AS w FROM t JOIN i USING (gram)), u AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v),
s AS (SELECT x.id AS q, y.id AS o, round(sum(x.w * y.w), 9) AS similarity FROM u x JOIN u y ON x.gram = y.gram AND x.id <> y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.78), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, o) AS rn FROM s),
l AS (SELECT id, list_distinct(string_split(key, ' ')) AS l FROM n)
SELECT DISTINCT least(q, o) AS a, greatest(q, o) AS b, round(similarity, 6) AS similarity, round(len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))), 6) AS word_overlap FROM k JOIN l x ON x.id = least(q, o) JOIN l y ON y.id = greatest(q, o)
WHERE rn <= 6 AND len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))) >= 0.5""")
def similar_names(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("id")).withColumn("key", F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")))
    return resolve.similar_names(names, "id", "key").withColumns({c: F.round(c, 6) for c in ("similarity", "word_overlap")})


@query(m("""+ d AS (SELECT axis_id, food_id, round(avg(value) - 25, 1) AS d FROM m GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY axis_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY axis_id, abs(d)) - 1) / 2 AS r FROM d)
SELECT axis_id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS r_plus, round(avg(d), 6) AS mean_difference FROM r GROUP BY 1"""))
def paired_signed_rank(spark, sf):
    df = measurements(spark, sf).groupBy("axis_id", "food_id").agg(F.round(F.avg("value") - 25, 1).alias("d"))
    return evaluate.signed_rank(df, ["axis_id"], "d").select("axis_id", "n", "r_plus", F.round("mean_difference", 6).alias("mean_difference"))


@query(m("""+ f AS (SELECT *, CASE WHEN profile_id % 3 > 0 THEN lower(regexp_replace(concat('Axis ', profile_id % 5), ' ', '_')) WHEN axis_id = 'NO' THEN 'axis_0' END AS slug FROM m), k AS (SELECT slug FROM f WHERE slug IS NOT NULL GROUP BY 1 HAVING count(DISTINCT food_id) >= 20),
s AS (SELECT slug, count(DISTINCT profile_id) AS n FROM f WHERE slug IS NOT NULL GROUP BY 1) SELECT food_id, 'x_' || slug || CASE WHEN n > 1 THEN '__id' || profile_id ELSE '' END AS feature, round(avg(value), 6) AS value FROM f JOIN k USING (slug) JOIN s USING (slug) GROUP BY ALL"""))
def named_features(spark, sf):
    df = measurements(spark, sf).withColumn("own_name", F.when(F.col("axis_id") == "NO", " axis_0 "))
    names = table(spark, sf, "supplier").where("s_suppkey % 3 > 0").selectExpr("s_suppkey AS profile_id", "concat('Axis ', s_suppkey % 5) AS name")
    return features.features(df, "food_id", "profile_id", "value", names, "x_", 20, "own_name").withColumn("value", F.round("value", 6))


def _support(spark, sf):
    df = measurements(spark, sf).join(table(spark, sf, "part").selectExpr("p_partkey AS food_id", "concat(p_brand, '/', p_size) AS block"), "food_id")
    return df.withColumn("axis", F.concat_ws("/", "axis_id", F.col("sample_count").cast("string"))).withColumn("partition", F.when(F.col("food_id") % 20 == 0, "validation").otherwise("train"))


_SUPPORT = """+ c AS (SELECT food_id, concat_ws('/', axis_id, sample_count) AS axis, concat(p_brand, '/', p_size) AS block, CASE WHEN food_id % 20 = 0 THEN 'validation' ELSE 'train' END AS partition, quality_tier IN ('A', 'B') AS strict FROM m JOIN part ON p_partkey = food_id),
l AS (SELECT axis, count(DISTINCT food_id) FILTER (partition = 'train') AS train, count(DISTINCT food_id) FILTER (partition = 'validation') AS validation, count(DISTINCT food_id) FILTER (partition = 'train' AND strict) AS strict_train, count(DISTINCT block) FILTER (partition = 'train') AS train_blocks FROM c GROUP BY 1),
d AS (SELECT *, greatest(0, 30 - validation) AS deficit, train - greatest(0, 30 - validation) AS train_after FROM l)"""


@query(m(f"{_SUPPORT} SELECT *, train_after >= 100 AND strict_train >= deficit AS feasible FROM d"))
def support_ledger(spark, sf):
    from ..operators import allocate

    return allocate.ledger(_support(spark, sf), "food_id", "axis", "partition", F.col("quality_tier").isin("A", "B"), "block")


@query(m(f"""{_SUPPORT}, r AS (SELECT *, CASE WHEN partition = 'train' AND block LIKE '%3/1%' THEN 'validation' ELSE partition END AS candidate FROM c), n AS (SELECT axis, count(DISTINCT food_id) FILTER (candidate = 'train') AS proposed_train, count(DISTINCT food_id) FILTER (candidate = 'validation') AS proposed_validation FROM r WHERE candidate = 'train' OR strict GROUP BY 1),
e AS (SELECT d.*, coalesce(proposed_train, 0) AS proposed_train, coalesce(proposed_validation, 0) AS proposed_validation FROM d LEFT JOIN n USING (axis))
SELECT axis, proposed_train, proposed_validation, CASE WHEN train < 100 THEN 'insufficient_training_support_review' WHEN train_after < 100 THEN 'insufficient_total_support_review' WHEN strict_train < deficit THEN 'validation_evidence_insufficient_not_fixed_by_split'
WHEN proposed_train < 100 OR proposed_validation < 30 THEN 'family_block_or_joint_allocation_infeasible_review' WHEN deficit > 0 THEN 'coverage_restored_by_training_transfer' ELSE 'counts_already_sufficient' END AS decision FROM e"""))
def support_recheck(spark, sf):
    from ..operators import allocate

    cells = _support(spark, sf)
    out, _ = allocate.rechecked(cells, "food_id", "axis", "partition", F.col("quality_tier").isin("A", "B"), "block", cells.where("block LIKE '%3/1%'").select("block"))
    return out.select("axis", "proposed_train", "proposed_validation", "decision")


@query("""SELECT o_custkey AS source, sum(CASE WHEN o_orderstatus = 'F' THEN w ELSE 0 END)::BIGINT AS score, sum(CASE WHEN o_orderstatus = 'F' THEN w ELSE 0 END) >= 30 AS passed FROM orders JOIN (SELECT DISTINCT o_orderpriority, 10 * ascii(o_orderpriority) - 480 AS w FROM orders) USING (o_orderpriority) GROUP BY 1""")
def source_screening(spark, sf):
    from ..operators import allocate

    orders = table(spark, sf, "orders")
    weights = orders.select("o_orderpriority").distinct().selectExpr("o_orderpriority", "bigint(10 * ascii(o_orderpriority) - 480) AS w")
    answers = orders.selectExpr("o_custkey AS source", "o_orderpriority", "CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS answer")
    return allocate.screened(answers, "source", "o_orderpriority", "answer", weights, "w", 30)


@query()
def block_allocation(spark, sf):
    """Brands to move whole to validation so that each return flag has eight parts there."""
    from ..operators import allocate

    df = measurements(spark, sf).join(table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_brand AS block"), "food_id").withColumn("partition", F.expr("CASE WHEN food_id <= 3 THEN 'validation' ELSE 'train' END"))
    return allocate.allocated(df, "food_id", "axis_id", "partition", F.col("quality_tier").isin("A", "B"), "block", F.col("axis_id").startswith("N"), 20, 8)


@query("""WITH a AS (SELECT p_brand AS source, p_partkey AS axis, upper(CASE WHEN p_size % 3 = 0 THEN concat('c', p_size, p_name) ELSE '' END) AS code, lower(p_name || ' ' || p_type) AS name FROM part),
c AS (SELECT 'official_code' AS basis, code AS key, count(DISTINCT source) AS sources, string_agg(DISTINCT axis::VARCHAR, ';' ORDER BY axis::VARCHAR) AS axes FROM a WHERE code <> '' GROUP BY code HAVING count(DISTINCT source) > 1)
SELECT * FROM c UNION ALL SELECT 'name_candidate', name, count(DISTINCT source), string_agg(DISTINCT axis::VARCHAR, ';' ORDER BY axis::VARCHAR) FROM a WHERE code NOT IN (SELECT key FROM c) GROUP BY name HAVING count(DISTINCT source) > 1""")
def shared_axes(spark, sf):
    from ..functions import text
    from ..operators import overlap

    a = table(spark, sf, "part").selectExpr("p_brand AS source", "p_partkey AS axis", "CASE WHEN p_size % 3 = 0 THEN concat('c', p_size, p_name) ELSE '' END AS code", "concat(p_name, ' ', p_type) AS name")
    return overlap.shared_axes(a, "source", "code", text.ascii_label_key(F.col("name")), "axis")


@query("WITH n AS (SELECT DISTINCT p_brand, lower(p_name) AS k FROM part) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS shared FROM n x JOIN n y ON x.k = y.k AND x.p_brand < y.p_brand GROUP BY ALL")
def source_name_overlap(spark, sf):
    from ..functions import text
    from ..operators import overlap

    return overlap.name_overlap(table(spark, sf, "part"), "p_brand", text.ascii_label_key(F.col("p_name")))


@query(m("""+ f AS (SELECT axis_id, CASE WHEN axis_id = 'NO' THEN 'mg' WHEN sample_count > 3 AND axis_id <> 'AF' THEN 'IU' WHEN axis_id = 'AF' THEN 'kcal' ELSE 'g' END AS unit FROM m), r AS (SELECT axis_id, count(*) AS rows, string_agg(DISTINCT unit, ';' ORDER BY unit) AS units, count(*) FILTER (unit IN ('g', 'mg')) AS convertible FROM f GROUP BY 1)
SELECT *, CASE WHEN convertible = rows THEN 'all_exact_mass' WHEN convertible = 0 THEN 'no_exact_mass' ELSE 'mixed_units_review' END AS status FROM r"""))
def unit_compatibility(spark, sf):
    from ..operators import overlap

    df = measurements(spark, sf).withColumn("unit", F.expr("CASE WHEN axis_id = 'NO' THEN 'mg' WHEN sample_count > 3 AND axis_id <> 'AF' THEN 'IU' WHEN axis_id = 'AF' THEN 'kcal' ELSE 'g' END"))
    return overlap.unit_compatibility(df, "axis_id", "unit")


@query(m("""+ c AS (SELECT axis_id, source_key, food_id, max(value) - min(value) <= 0.05 * max(value) AS ok FROM m GROUP BY ALL), k AS (SELECT axis_id, count(DISTINCT food_id) FILTER (ok) AS items, count(*) FILTER (NOT ok) AS conflicting, count(DISTINCT source_key) FILTER (ok) AS sources FROM c GROUP BY 1),
j AS (SELECT a AS axis_id, coalesce(items, 0) AS items, coalesce(conflicting, 0) AS conflicting, coalesce(sources, 0) AS sources FROM (VALUES ('AF'), ('NF'), ('NO'), ('ZZ')) v(a) LEFT JOIN k ON axis_id = a)
SELECT *, CASE WHEN items = 0 THEN 'not_reported' WHEN items < 100 THEN 'insufficient_items' WHEN sources = 1 THEN 'single_source' ELSE 'covered' END AS status FROM j"""))
def core_coverage(spark, sf):
    from ..operators import overlap

    return overlap.core_coverage(measurements(spark, sf), "food_id", "axis_id", "source_key", "value", ["AF", "NF", "NO", "ZZ"])


@query(m("""+ o AS (SELECT axis_id, food_id, max(ratio > 0) AS p, max(ratio = 0) AS z, max(source_key NOT IN ('s1', 's4')) AS o, max(source_key IN ('s1', 's4')) AS i, avg(ratio) AS v FROM m GROUP BY ALL),
r AS (SELECT axis_id, count(*) AS items, count(*) FILTER (p) AS positive, count(*) FILTER (z) AS zero, stddev_pop(ln(1 + v)) AS s, count(*) FILTER (o) AS remaining, count(*) FILTER (i) AS tested FROM o GROUP BY 1)
SELECT axis_id, items, positive, zero, remaining, tested, round(s, 9) AS spread, CASE WHEN s <= 1e-8 THEN 'constant' WHEN remaining < 100 THEN 'context_only' WHEN tested < 80 THEN 'train_only' ELSE 'train_and_test' END AS role FROM r"""))
def axis_roles(spark, sf):
    from ..operators import overlap

    return overlap.axis_roles(measurements(spark, sf), "axis_id", "food_id", "source_key", "ratio", ["s1", "s4"], 100, 80).withColumn("spread", F.round("spread", 9))
