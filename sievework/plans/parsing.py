"""Queries over texts of values and units, reshaping and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, units, values
from ..operators import gates, relational
from .registry import m, measurements, query, table

#: One raw text for each order line, in turn of every kind.
RAW = """SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_shipdate AS date), cast(round(l_extendedprice*100) AS bigint)) AS id, CASE l_partkey % 10 WHEN 0 THEN cast(cast(l_quantity AS int) AS varchar(20)) WHEN 1 THEN concat('<', cast(cast(l_quantity AS int) AS varchar(20)))
WHEN 2 THEN 'Trace' WHEN 3 THEN concat(cast(cast(l_quantity AS int) AS varchar(20)), '-', cast(cast(l_quantity AS int) + 5 AS varchar(20))) WHEN 4 THEN '0' WHEN 5 THEN 'N/A' WHEN 6 THEN concat('(', cast(cast(l_quantity AS int) AS varchar(20)), ')') WHEN 7 THEN concat(cast(cast(l_quantity AS int) AS varchar(20)), ',5') WHEN 8 THEN '-' ELSE NULL END AS raw,
CASE l_suppkey % 9 WHEN 0 THEN 'mg/100 g' WHEN 1 THEN 'g' WHEN 2 THEN 'kcal' WHEN 3 THEN 'µg/100g' WHEN 4 THEN 'g/100 ml' WHEN 5 THEN 'mg/g nitrogen' WHEN 6 THEN '%' WHEN 7 THEN 'IU' ELSE 'mg/serving' END AS unit FROM lineitem"""


def raw_values(spark, sf):
    return spark.sql(RAW.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))


@query(f"""WITH r AS ({RAW}), v AS (SELECT id, raw, try_cast(replace(raw, ',', '.') AS DOUBLE) AS num FROM r)
SELECT id, CASE WHEN raw IS NULL OR raw IN ('N/A', '-') THEN 'missing' WHEN starts_with(raw, '<') THEN 'below_limit' WHEN raw = 'Trace' THEN 'trace' WHEN contains(raw, '-') THEN 'range_only' WHEN num = 0 THEN 'explicit_zero' WHEN num IS NOT NULL THEN 'observed' ELSE 'invalid' END AS value_status,
CASE WHEN raw NOT LIKE '%-%' AND raw NOT LIKE '<%' THEN num END AS numeric_value, CASE WHEN raw LIKE '%-%' AND raw <> '-' THEN split_part(raw, '-', 1)::DOUBLE END AS parsed_min, CASE WHEN raw LIKE '%-%' AND raw <> '-' THEN split_part(raw, '-', 2)::DOUBLE END AS parsed_max,
coalesce(num = 0, false) AS is_explicit_zero, coalesce(raw LIKE '<%' OR raw = 'Trace', false) AS is_censored, coalesce(raw LIKE '%-%' AND raw <> '-', false) AS is_range_only, CASE WHEN raw LIKE '<%' THEN raw[2:]::DOUBLE END AS censor_limit FROM v""")
def parse_value(spark, sf):
    return values.parsed(raw_values(spark, sf), "raw", values.parse_value).select("id", "s.*")


@query(f"""WITH r AS ({RAW}) SELECT id, try_cast(replace(trim(raw, '()'), ',', '.') AS DOUBLE) AS number,
CASE WHEN raw IS NULL OR raw IN ('N/A', '-') THEN 'missing_or_not_reported' WHEN raw = 'Trace' OR raw LIKE '<%' THEN 'trace_or_censored' WHEN raw LIKE '%-%' THEN 'unparsed_non_numeric' WHEN raw LIKE '(%' THEN 'bracketed_or_parenthesized_estimate' WHEN raw = '0' THEN 'explicit_zero' ELSE 'observed' END AS status,
coalesce(raw NOT LIKE '(%' AND raw NOT LIKE '%-%' AND try_cast(replace(raw, ',', '.') AS DOUBLE) IS NOT NULL, false) AS usable FROM r""")
def parse_bracketed_value(spark, sf):
    return values.parsed(raw_values(spark, sf), "raw", values.parse_bracketed).select("id", "s.*")


@query(f"""WITH r AS ({RAW}) SELECT id, CASE WHEN raw NOT LIKE '%,%' THEN try_cast(trim(raw, '()') AS DOUBLE) END AS number, coalesce(raw LIKE '(%', false) AS estimated,
CASE WHEN raw IS NULL THEN 'missing_blank' WHEN raw = '-' THEN 'unmeasured_dash' WHEN raw LIKE '%,%' OR try_cast(trim(raw, '()') AS DOUBLE) IS NULL THEN 'unparsed_requires_review' WHEN raw LIKE '(%' THEN 'estimated_positive' WHEN raw = '0' THEN 'reported_zero_censored_or_nondetect' ELSE 'reported_positive_origin_unresolved' END AS status FROM r""")
def parse_dagger_value(spark, sf):
    return values.parsed(raw_values(spark, sf), "raw", values.parse_dagger).select("id", "s.*")


@query(f"""WITH r AS (SELECT DISTINCT unit FROM ({RAW})) SELECT unit, CASE unit WHEN 'mg/100 g' THEN 1e-3 WHEN 'µg/100g' THEN 1e-6 END::DOUBLE AS factor,
CASE unit WHEN 'mg/100 g' THEN 'converted_exact_mass' WHEN 'µg/100g' THEN 'converted_exact_mass' WHEN 'g' THEN 'missing_denominator' WHEN 'kcal' THEN 'excluded_energy' WHEN 'g/100 ml' THEN 'requires_density_conversion' WHEN 'mg/g nitrogen' THEN 'requires_nitrogen_or_protein_conversion' WHEN '%' THEN 'excluded_relative_fraction' WHEN 'IU' THEN 'excluded_biological_equivalent' ELSE 'requires_portion_conversion' END AS status,
CASE unit WHEN 'mg/100 g' THEN 1e-3 WHEN 'µg/100g' THEN 1e-6 WHEN 'g' THEN 1.0 WHEN 'g/100 ml' THEN 1.0 WHEN 'mg/g nitrogen' THEN 1e-3 WHEN 'mg/serving' THEN 1e-3 END::DOUBLE AS grams FROM r""")
def normalize_unit(spark, sf):
    return raw_values(spark, sf).select("unit").distinct().select("unit", units.normalize_unit(F.col("unit")).alias("s"), units.mass_factor(F.col("unit")).alias("grams")).select("unit", "s.factor", "s.status", "grams")


@query(f"""WITH r AS ({RAW}), v AS (SELECT id, unit, CASE WHEN raw NOT LIKE '%-%' AND raw NOT LIKE '<%' THEN try_cast(replace(raw, ',', '.') AS DOUBLE) END * CASE unit WHEN 'mg/100 g' THEN 1e-3 WHEN 'µg/100g' THEN 1e-6 END AS x FROM r)
SELECT id, round(x, 12) AS g_per_100g, coalesce(x BETWEEN 0 AND 100, false) AS eligible FROM v""")
def apply_value_and_unit(spark, sf):
    raw = raw_values(spark, sf)
    factors = raw.select("unit").distinct().select("unit", units.normalize_unit(F.col("unit")).factor.alias("factor"))
    x = values.bounded_mass(values.parse_value(F.col("raw")).numeric_value * F.col("factor"))
    return raw.join(factors, "unit").select("id", F.round(x, 12).alias("g_per_100g"), F.coalesce(x.between(0, 100), F.lit(False)).alias("eligible"))


@query("SELECT p_partkey, name AS column_name, v AS raw_value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME name VALUE v)")
def melt(spark, sf):
    return relational.to_long(table(spark, sf, "part").selectExpr("p_partkey", "double(p_size) AS p_size", "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(m("SELECT food_id, coalesce(sum(value) FILTER (axis_id = 'AF'), 0) AS AF, coalesce(sum(value) FILTER (axis_id = 'NO'), 0) AS NO, coalesce(sum(value) FILTER (axis_id = 'RF'), 0) AS RF FROM m GROUP BY 1"))
def pivot(spark, sf):
    return relational.to_wide(measurements(spark, sf), ["food_id"], "axis_id", ["AF", "NO", "RF"], F.sum("value"), 0.0)


@query("SELECT p_partkey, CASE WHEN p_size <= 19 THEN 'low' WHEN p_size <= 49 THEN 'middle' ELSE 'high' END AS bin FROM part")
def bins(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 19, "low").when(F.col("p_size") <= 49, "middle").otherwise("high").alias("bin"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("SELECT event_id, to_json({'event_id': event_id, 'event_type': event_type, 'user_id': user_id})::VARCHAR AS record FROM events")
def json_records(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("record"))


@query("""WITH k AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN concat('E', event_id) END AS h FROM events) SELECT event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM k""")
def fill_forward(spark, sf):
    e = table(spark, sf, "events")
    return relational.filled_forward(e, ["user_id"], "event_id", "section", F.when(F.col("event_type") == "error", F.concat(F.lit("E"), "event_id"))).select("event_id", "section")


@query("SELECT * FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ('the', 'la', 'der', 'el') GROUP BY ALL)")
def exploded_words(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.where(F.col("word").isin("the", "la", "der", "el")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(p_name)[1:2] AS shard, count(*) AS n FROM part GROUP BY 1")
def shard_counts(spark, sf):
    return table(spark, sf, "part").select(F.substring(ids.hash_order(F.col("p_name")), 1, 2).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT *, observed = 0 AS passed FROM (
SELECT 'unique_part' AS check_id, 'critical' AS severity, count(*)::BIGINT AS observed, 'each part key once' AS requirement FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orphan_line', 'critical', count(*)::BIGINT, 'each line has its part' FROM lineitem ANTI JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'quantity_bound', 'critical', count_if(l_quantity NOT BETWEEN 0 AND 100)::BIGINT, 'quantities in [0, 100]' FROM lineitem
UNION ALL SELECT 'negative_balance', 'warning', count_if(c_acctbal < 0)::BIGINT, 'no negative balance' FROM customer
UNION ALL SELECT 'family_leak', 'critical', count(*)::BIGINT, 'a name is on one side only' FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT sha256(p_name)[1:1]) > 1))""")
def audit_checks(spark, sf):
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    count = F.count(F.lit(1))
    return gates.checks(
        ("unique_part", "critical", relational.duplicates(part, ["p_partkey"]).agg(count), "each part key once"),
        ("orphan_line", "critical", lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(count), "each line has its part"),
        ("quantity_bound", "critical", lines.agg(F.count_if(~F.col("l_quantity").between(0, 100))), "quantities in [0, 100]"),
        ("negative_balance", "warning", table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0)), "no negative balance"),
        ("family_leak", "critical", part.groupBy("p_name").agg(F.countDistinct(F.substring(ids.hash_order(F.col("p_name")), 1, 1)).alias("n")).where("n > 1").agg(count), "a name is on one side only"),
    )


@query("""WITH a AS (SELECT o_orderkey AS k, round(o_totalprice, 1) AS v FROM orders WHERE o_orderkey % 7 > 0), b AS (SELECT o_orderkey AS k, round(o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END) AS v FROM orders WHERE o_orderkey % 5 > 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def version_compare(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 7 > 0").selectExpr("o_orderkey AS k", "round(o_totalprice, 1) AS v")
    b = o.where("o_orderkey % 5 > 0").selectExpr("o_orderkey AS j", "CASE WHEN o_orderkey % 11 = 0 THEN round(o_totalprice, 0) ELSE round(o_totalprice, 1) END AS w")
    change = F.when(F.col("k").isNull(), "added").when(F.col("j").isNull(), "removed").when(F.col("v") == F.col("w"), "unchanged").otherwise("changed")
    return a.join(b, F.col("k") == F.col("j"), "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))
