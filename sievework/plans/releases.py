"""Queries over registries, catalogues and release checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import releases
from .cells import _CELL, _RANK, _SOURCES
from .registry import m, measurements, query, table


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'no_local_file' WHEN p_partkey IS NULL THEN 'file_missing' ELSE 'hashed' END AS hash_status, CASE WHEN s_suppkey % 5 > 0 THEN sha256(p_name) END AS sha256, CASE WHEN n_nationkey < 10 THEN 'stated' ELSE 'not_stated' END AS version_status FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_partkey % 3 > 0 AND s_suppkey % 5 > 0 LEFT JOIN nation ON n_nationkey = s_suppkey")
def enriched_registry(spark, sf):
    registry = table(spark, sf, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 5 > 0 THEN concat('f', s_suppkey) ELSE '' END AS raw")
    artifacts = table(spark, sf, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("f"), "p_partkey").alias("file"), F.sha2("p_name", 256).alias("sha256"), F.length("p_name").alias("bytes"))
    versions = table(spark, sf, "nation").where("n_nationkey < 10").selectExpr("cast(n_nationkey AS bigint) AS s_suppkey", "n_name AS version")
    return releases.enriched(registry, "s_suppkey", "raw", artifacts, versions).select("s_suppkey", "hash_status", "sha256", "version_status")


_OBSERVED = "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'USDA' WHEN 1 THEN ' DUKE ' END AS citation, o_custkey // 4 AS food, CASE WHEN o_orderkey % 7 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS name FROM orders"


@query(f"""WITH c AS (SELECT *, concat_ws('|', trim(coalesce(citation, '')), food) AS key, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k FROM ({_OBSERVED})), i AS (SELECT key, row_number() OVER (ORDER BY key) AS observation_id FROM (SELECT DISTINCT key FROM c)),
n AS (SELECT key, k, count(*) AS n, min(o_orderkey) AS first, min({{'n': length(name), 'f': lower(name), 'l': name}}).l AS l FROM c GROUP BY ALL) SELECT observation_id, key, arg_min(l, {{'n': -n, 'first': first}}) AS name FROM n JOIN i USING (key) GROUP BY ALL""")
def rebuilt_observations(spark, sf):
    rows = spark.sql(_OBSERVED.replace("//", "div").replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))
    return releases.rebuilt_observations(rows, [F.col("citation"), F.col("food")], "name", "o_orderkey")[0]


@query(m("""+ r AS (SELECT profile_id AS axis, count(*) AS records, string_agg(DISTINCT quality_tier, ';' ORDER BY quality_tier) AS sources FROM m WHERE profile_id % 4 > 0 GROUP BY 1)
SELECT s_suppkey AS axis, s_name AS name, CASE WHEN n_nationkey IS NULL THEN '' ELSE n_name END AS definition, coalesce(records, 0) AS records, coalesce(sources, '') AS sources FROM supplier LEFT JOIN r ON axis = s_suppkey LEFT JOIN nation ON n_nationkey = s_suppkey"""))
def composition_catalogue(spark, sf):
    axes = table(spark, sf, "supplier").selectExpr("s_suppkey AS axis", "s_name AS name")
    definitions = table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS axis", "n_name AS definition")
    records = measurements(spark, sf).where("profile_id % 4 > 0").withColumnRenamed("profile_id", "axis")
    return releases.catalogue(axes, "axis", "name", definitions, records, "quality_tier")


@query("SELECT n_name, count(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY, CASE WHEN count(c_custkey) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) > 0 THEN 'covered' ELSE 'absent_locally' END AS status FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 5 > 0 GROUP BY 1")
def external_audit(spark, sf):
    nation = table(spark, sf, "nation")
    local = table(spark, sf, "customer").join(nation.where("n_nationkey % 5 > 0"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("label", F.upper("n_name"))
    return releases.external_audit(nation, "n_name", local, "label", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query(m("""+ a AS (SELECT food_id, axis_id, median(value) AS v FROM m WHERE food_id % 17 > 0 GROUP BY ALL), b AS (SELECT food_id, axis_id, CASE WHEN food_id % 13 = 0 THEN median(value) + 1 ELSE median(value) END AS w FROM m WHERE food_id % 19 > 0 GROUP BY food_id, axis_id)
SELECT CASE WHEN v IS NULL THEN 'table_only' WHEN w IS NULL THEN 'matrix_only' WHEN v = w THEN 'equal' ELSE 'different' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (food_id, axis_id) GROUP BY 1"""))
def matrix_equality(spark, sf):
    cells = measurements(spark, sf).groupBy("food_id", "axis_id").agg(F.median("value").alias("value"))
    other = cells.where("food_id % 19 > 0").withColumn("value", F.when(F.col("food_id") % 13 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return releases.matrix_equality(cells.where("food_id % 17 > 0"), other, ["food_id", "axis_id"], "value")


@query(m(f"""+ w AS (SELECT *, row_number() OVER (PARTITION BY food_id, axis_id ORDER BY {_RANK}, quality_tier, sample_count DESC, measurement_id) AS rn, row_number() OVER (PARTITION BY food_id, axis_id ORDER BY quality_tier, measurement_id) AS old FROM m),
n AS (SELECT food_id, axis_id, measurement_id AS selected_id FROM w WHERE rn = 1), p AS (SELECT food_id, axis_id, measurement_id AS previous_id FROM w WHERE old = 1 AND food_id % 23 > 0)
SELECT food_id, axis_id, selected_id, previous_id, CASE WHEN previous_id IS NULL THEN 'new' WHEN selected_id = previous_id THEN 'same' ELSE 'changed' END AS verdict FROM n LEFT JOIN p USING (food_id, axis_id)"""))
def verified_winners(spark, sf):
    from ..operators.relational import first_by

    df = measurements(spark, sf)
    previous = first_by(df.where("food_id % 23 > 0"), _CELL, F.col("quality_tier"), F.col("measurement_id"))
    return releases.verified_winners(df, _CELL, _SOURCES, previous)
