"""Queries over catalogues and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units, values
from ..functions.ids import code_text
from ..operators import catalog
from .parsing import RAW, raw_values
from .registry import m, measurements, query, table


@query("SELECT p_type AS concept_id, count(*) AS members, min_by(p_name, p_partkey) AS label FROM part GROUP BY 1")
def axis_concepts(spark, sf):
    return catalog.concepts_and_relations(table(spark, sf, "part"), F.col("p_type"), [("brand", F.col("p_brand"))], "p_partkey", "p_name")[0]


@query("SELECT DISTINCT p_type AS subject, 'brand' AS relation, p_brand AS object FROM part UNION SELECT DISTINCT p_type, 'size', p_size::VARCHAR FROM part WHERE p_size > 40")
def axis_relations(spark, sf):
    edges = [("brand", F.col("p_brand")), ("size", F.when(F.col("p_size") > 40, F.col("p_size")))]
    return catalog.concepts_and_relations(table(spark, sf, "part"), F.col("p_type"), edges, "p_partkey", "p_name")[1]


@query("""WITH g AS (SELECT 'axis:' || sha256(concat_ws(chr(31), p_name, p_type))[1:16] AS expression_id, p_name, count(*) AS members, string_agg(DISTINCT p_name, ';') AS names, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS sources FROM part GROUP BY p_name, p_type),
c AS (SELECT p_name, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1) SELECT expression_id, members, names, sources, conflict FROM g JOIN c USING (p_name)""")
def axis_expression_groups(spark, sf):
    return catalog.expression_groups(table(spark, sf, "part"), "p_name", ["p_name", "p_type"], "p_brand")


@query("""WITH w AS (SELECT DISTINCT c_custkey, unnest([c_custkey * 3, c_custkey * 5]) AS id FROM customer), f AS (SELECT c_custkey, count(DISTINCT id) AS found, count_if(o_totalprice > 250000)::BIGINT AS numeric FROM w JOIN orders ON o_orderkey = id GROUP BY 1)
SELECT c_custkey, coalesce(found, 0) AS found, coalesce(numeric, 0) AS numeric, CASE WHEN coalesce(numeric, 0) > 0 THEN 'covered' WHEN coalesce(found, 0) > 0 THEN 'registered_only' ELSE 'gap' END AS status FROM customer LEFT JOIN f USING (c_custkey)""")
def requirement_evidence(spark, sf):
    wanted = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey = 0 THEN '0' ELSE concat(c_custkey * 3, ';', c_custkey * 5) END AS ids")
    return catalog.requirement_evidence(wanted, "c_custkey", "ids", table(spark, sf, "orders"), "o_orderkey", F.col("o_totalprice") > 250000)


@query(m("SELECT p_partkey AS food_id, s AS source_key, coalesce(n, 0) AS n FROM part CROSS JOIN (SELECT DISTINCT source_key AS s FROM m) LEFT JOIN (SELECT food_id AS t, source_key AS k, count(*) AS n FROM m GROUP BY ALL) ON t = p_partkey AND k = s"))
def gap_grid(spark, sf):
    df = measurements(spark, sf)
    seen = df.groupBy("food_id", "source_key").agg(F.count(F.lit(1)).alias("n"))
    return catalog.gap_grid(table(spark, sf, "part").select(F.col("p_partkey").alias("food_id")), "food_id", df, "source_key", seen)


@query("SELECT p_name AS key, count(*) AS axes, 'catalogue' AS origin FROM part GROUP BY 1 UNION ALL SELECT n_name, 0, 'seed' FROM nation")
def target_registry(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_name", "key")
    seeds = table(spark, sf, "nation").selectExpr("n_name AS key", "n_nationkey AS o").union(part.selectExpr("key", "cast(p_partkey AS int) AS o"))
    return catalog.new_targets(part, "key", seeds, "o")


@query("SELECT p_name, coalesce(count(DISTINCT p_partkey) FILTER (p_size > 25), 0) AS fuzzy, coalesce(count(DISTINCT p_partkey) FILTER (p_size <= 25 AND p_size > 3), 0) AS exact FROM part GROUP BY 1")
def candidate_match_counts(spark, sf):
    part = table(spark, sf, "part")
    candidates = part.where("p_size > 3").withColumn("method", F.when(F.col("p_size") > 25, "fuzzy").otherwise("exact"))
    return catalog.match_counts(part.select("p_name").distinct(), "p_name", candidates, "p_partkey", "method", ["exact", "fuzzy"])


@query(m("SELECT p_partkey AS food_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 2 THEN 'retained' ELSE 'removed' END AS decision FROM part LEFT JOIN (SELECT food_id, count(*) AS n FROM m WHERE value > 48 GROUP BY 1) ON food_id = p_partkey"))
def observed_axes(spark, sf):
    return catalog.observed_axes(table(spark, sf, "part").withColumnRenamed("p_partkey", "food_id"), "food_id", measurements(spark, sf), F.col("value") > 48, 2)


@query(m("""+ c AS (SELECT DISTINCT axis_id, food_id, source_key FROM m), t AS (SELECT axis_id, source_key, count(DISTINCT food_id) AS test FROM c GROUP BY ALL),
r AS (SELECT t.axis_id, t.source_key, t.test, (SELECT count(DISTINCT food_id) FROM c WHERE c.axis_id = t.axis_id AND c.source_key <> t.source_key) AS remaining FROM t)
SELECT *, CASE WHEN test >= 300 AND remaining >= 1000 THEN 'holdout_test' WHEN remaining >= 1000 THEN 'train_only' ELSE 'insufficient' END AS role FROM r"""))
def holdout_roles(spark, sf):
    return catalog.holdout_roles(measurements(spark, sf), "axis_id", "food_id", "source_key", 1000, 300)


@query(m("SELECT p_partkey AS food_id, p_name FROM part ANTI JOIN (SELECT food_id FROM m WHERE axis_id = 'NF') ON food_id = p_partkey"))
def foods_without_axis(spark, sf):
    return catalog.without_axis(table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_name"), "food_id", measurements(spark, sf).where("axis_id = 'NF'"))


@query("SELECT p_size::VARCHAR AS number, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS concepts, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING n > 1")
def identity_collisions(spark, sf):
    return catalog.identity_collisions(table(spark, sf, "part"), code_text(F.concat(F.col("p_size").cast("string"), F.lit(".0"))), "p_type")


@query(m("SELECT food_id - food_id % 10 AS food_id, count(*) AS n, count(DISTINCT food_id) AS originals FROM m GROUP BY 1"))
def reviewed_merge(spark, sf):
    members = table(spark, sf, "part").selectExpr("p_partkey - p_partkey % 10 AS rep", "p_partkey AS member")
    return catalog.merge_groups(measurements(spark, sf), "food_id", members, "rep", "member").groupBy("food_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("original").alias("originals"))


@query(m("""+ o AS (SELECT food_id, axis_id, median(value) AS o FROM m WHERE source_key = 's1' GROUP BY ALL)
SELECT measurement_id, CASE WHEN o IS NULL THEN 'origin_absent' WHEN abs(value - o) <= 1e-4 * abs(o) THEN 'resolved' ELSE 'differs' END AS copy_status FROM m LEFT JOIN o USING (food_id, axis_id) WHERE source_key = 's4'"""))
def copy_resolution(spark, sf):
    df = measurements(spark, sf)
    return catalog.resolve_copies(df.where("source_key = 's4'"), df.where("source_key = 's1'"), ["food_id", "axis_id"], "value").select("measurement_id", "copy_status")


@query("SELECT p_partkey AS id, CASE WHEN lower(p_brand) < lower(p_name) THEN lower(p_brand) || ' | ' || lower(p_name) ELSE lower(p_name) || ' | ' || lower(p_brand) END AS terms FROM part")
def search_index(spark, sf):
    part = table(spark, sf, "part")
    return catalog.search_index((part, "p_partkey", "p_name"), (part, "p_partkey", "p_brand"), (part, "p_partkey", "p_name"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'doi:' || p_size % 7 WHEN p_size < 30 THEN 'pmid:' || p_size ELSE 'title:' || sha256(lower(p_name))[1:16] END AS work FROM part) SELECT work, min(p_partkey) AS p_partkey FROM r GROUP BY 1""")
def literature_union(spark, sf):
    part = table(spark, sf, "part").withColumns({"doi": F.when(F.col("p_size") < 20, (F.col("p_size") % 7).cast("string")), "pmid": F.when(F.col("p_size") < 30, F.col("p_size").cast("string"))})
    return catalog.literature(part, [("doi", F.col("doi")), ("pmid", F.col("pmid"))], "p_name", "p_partkey").select("work", "p_partkey")


@query(m("SELECT food_id, axis_id, median(value) FILTER (source_key = 's0') AS s0, median(value) FILTER (source_key = 's1') AS s1 FROM m GROUP BY ALL HAVING s0 IS NOT NULL AND s1 IS NOT NULL"))
def common_cells(spark, sf):
    return catalog.common_cells(measurements(spark, sf), ["food_id", "axis_id"], "source_key", ["s0", "s1"], "value")


@query(m("""+ o AS (SELECT concat_ws('/', food_id, profile_id, sample_count) AS food_id, axis_id, any_value(value) AS v FROM m GROUP BY ALL HAVING count(*) = 1) SELECT food_id, sum(v) AS total, sum(v) BETWEEN 60 AND 110 AS plausible FROM o WHERE axis_id IN ('AF', 'NO') GROUP BY 1 HAVING count(*) = 2"""))
def mass_balance(spark, sf):
    return catalog.mass_balance(measurements(spark, sf).withColumn("food_id", F.concat_ws("/", "food_id", "profile_id", "sample_count")), "food_id", "axis_id", "value", ["AF", "NO"], 60, 110)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'request' WHEN s_acctbal < 3000 THEN 'download' ELSE 'none' END AS action FROM supplier")
def pending_actions(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", catalog.next_action([(F.col("s_acctbal") < 0, "request"), (F.col("s_acctbal") < 3000, "download")], "none").alias("action"))


@query("SELECT p_partkey, CASE WHEN abs(p_retailprice - 1000) <= 1e-8 + 0.01 * 1000 THEN true ELSE false END AS near, round(CASE WHEN p_retailprice = 0 THEN 0.0 ELSE abs(p_retailprice - 1000) / greatest(p_retailprice, 1000) END, 9) AS difference FROM part")
def closeness(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", values.is_close(p, F.lit(1000.0), 0.01).alias("near"), F.round(values.relative_difference(p, F.lit(1000.0)), 9).alias("difference"))


@query(f"""SELECT DISTINCT unit, CASE WHEN unit = 'kcal' THEN 'energy' WHEN unit = 'IU' THEN 'activity' WHEN unit = '%' THEN 'fraction' WHEN unit = 'g/100 ml' THEN 'volume' ELSE 'mass' END AS modality FROM ({RAW})""")
def unit_modalities(spark, sf):
    return raw_values(spark, sf).select("unit").distinct().select("unit", units.unit_modality(F.col("unit")).alias("modality"))
