"""Queries over cells: selection, conflict, pooling, scales, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, gates, stats
from .registry import m, measurements, query, table

_SOURCES = ["s3", "s0", "s5", "s1", "s4", "s2"]
_CELL = ["food_id", "axis_id"]
_RANK = "list_position(['s3','s0','s5','s1','s4','s2'], source_key)"


@query(m(f"""+ w AS (SELECT *, row_number() OVER (PARTITION BY food_id, axis_id ORDER BY {_RANK}, quality_tier, sample_count DESC, measurement_id) AS rn FROM m),
a AS (SELECT food_id, axis_id, count(*) AS candidates, count(DISTINCT source_key) AS candidate_sources, min(value) AS low, max(value) AS high FROM m GROUP BY ALL)
SELECT a.*, low <> high AS disagreement, measurement_id AS selected_id, source_key AS selected_source, value AS selected_value FROM a JOIN w USING (food_id, axis_id) WHERE rn = 1"""))
def cell_select(spark, sf):
    return cells.select_records(measurements(spark, sf), _CELL, _SOURCES, check_ids=False)[1]


@query(m("""+ g AS (SELECT food_id, axis_id, count(*) AS n, count(DISTINCT source_key) AS sources, min(value) AS low, median(value) AS median, max(value) AS high, count(DISTINCT value) AS distinct_values FROM m GROUP BY ALL)
SELECT *, CASE WHEN median <> 0 THEN round((high - low) / abs(median), 9) WHEN high > low THEN 'inf'::DOUBLE ELSE 0.0 END AS span,
CASE WHEN sources > 1 AND distinct_values > 1 THEN 'disagreement' WHEN sources > 1 THEN 'same_value' ELSE 'single_source' END AS status FROM g"""))
def cell_summary_conflict(spark, sf):
    out = cells.summarise(measurements(spark, sf), _CELL)
    return out.withColumn("span", F.round("span", 9)).withColumn("distinct_values", F.col("distinct_values").cast("long"))


#: SQL of pooled values of the records of a table; the select list ends with the columns of a profile.
POOLED = """r AS (SELECT *, min(quality_tier) OVER (PARTITION BY food_id, axis_id) AS best FROM {rows}),
b AS (SELECT food_id, axis_id, value AS v, ln(1 + value) AS y, CASE WHEN ratio > 0 THEN 1 / pow(ratio / (1 + value), 2) END AS w, greatest(sample_count, 1) AS wt, source_key FROM r WHERE quality_tier = best),
f AS (SELECT food_id, axis_id, count(*) AS n, count(w) AS k, sum(w) AS sw, sum(w * y) AS swy, sum(w * w) AS sw2, count(DISTINCT source_key) AS sources, min(v) AS low, max(v) AS high, avg(v) AS mean, median(v) AS median FROM b GROUP BY ALL),
q AS (SELECT food_id, axis_id, sum(w * pow(y - swy / sw, 2)) AS q FROM b JOIN f USING (food_id, axis_id) GROUP BY ALL),
s AS (SELECT *, CASE WHEN sw - sw2 / sw > 0 THEN greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0.0 END AS tau2, CASE WHEN k >= 2 AND n > 1 THEN CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q) ELSE 0.0 END END AS i2 FROM f JOIN q USING (food_id, axis_id)),
t AS (SELECT food_id, axis_id, sum(y / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS c FROM b JOIN s USING (food_id, axis_id) GROUP BY ALL),
o AS (SELECT food_id, axis_id, y, sum(wt) OVER (PARTITION BY food_id, axis_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS run, sum(wt) OVER (PARTITION BY food_id, axis_id) AS tot FROM b),
d AS (SELECT food_id, axis_id, min(y) AS mid FROM o WHERE run >= 0.5 * tot GROUP BY ALL),
x AS (SELECT *, n > 1 AND (coalesce(i2 > 0.75, false) OR coalesce(sources >= 2 AND high / nullif(low, 0) > 3, false) OR (sources >= 2 AND low = 0 AND high > 0)) AS review FROM s JOIN t USING (food_id, axis_id) JOIN d USING (food_id, axis_id))
SELECT food_id, axis_id, CASE WHEN NOT review THEN round(CASE WHEN n = 1 THEN low WHEN k >= 2 THEN exp(c) - 1 ELSE exp(mid) - 1 END, 6) END AS value, CASE WHEN review THEN 'review' ELSE 'accepted' END AS status,
CASE WHEN n = 1 THEN 'single_record' WHEN k >= 2 THEN 'random_effects' ELSE 'weighted_median' END AS method, n, sources, round(mean, 6) AS mean, median, low, high, round(i2, 6) AS i2, round(high / nullif(low, 0), 6) AS ratio, sources >= 2 AND low = 0 AND high > 0 AS zero_conflict FROM x"""


@query(m("+ " + POOLED.format(rows="m")))
def heterogeneity_aggregate(spark, sf):
    df = measurements(spark, sf)
    out = stats.pooled_effect(df, _CELL, "value", F.when(F.col("ratio") > 0, F.col("ratio")), F.col("sample_count").cast("double"), "source_key", "ABCD", "quality_tier")
    return out.withColumns({c: F.round(c, 6) for c in ("value", "mean", "i2", "ratio")})


@query(m("""+ v AS (SELECT axis_id, ln(1 + ratio) AS v FROM m),
f AS (SELECT axis_id, median(v) AS center, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1),
d AS (SELECT axis_id, median(abs(v - center)) AS mad FROM v JOIN f USING (axis_id) GROUP BY 1),
s AS (SELECT *, greatest((q3 - q1) / 1.349, mad * 1.4826) AS s FROM f JOIN d USING (axis_id))
SELECT axis_id, round(center, 9) AS center, round(q1, 9) AS q1, round(q3, 9) AS q3, round(mad, 9) AS mad, s <= 1e-8 AS degenerate, round(CASE WHEN s <= 1e-8 THEN 1.0 ELSE s END, 9) AS scale FROM s"""))
def robust_scale(spark, sf):
    out = stats.robust_scale(measurements(spark, sf), ["axis_id"], F.col("ratio"))
    return out.withColumns({c: F.round(c, 9) for c in ("center", "q1", "q3", "mad", "scale")})


@query(m("""+ v AS (SELECT axis_id, ln(1 + ratio) AS v FROM m WHERE ratio > 0), f AS (SELECT axis_id, median(v) AS center, count(*) AS n FROM v GROUP BY 1)
SELECT axis_id, any_value(n) AS n, round(any_value(center), 9) AS center, round(greatest(sqrt(avg(pow(v - center, 2))), 1e-4), 9) AS scale FROM v JOIN f USING (axis_id) GROUP BY 1"""))
def positive_scale(spark, sf):
    return stats.positive_scale(measurements(spark, sf), ["axis_id"], "ratio").withColumns({c: F.round(c, 9) for c in ("center", "scale")})


@query(m("""+ q AS (SELECT axis_id, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95 FROM m GROUP BY 1)
SELECT axis_id, round(q05, 9) AS q05, round(q25, 9) AS q25, round(q50, 9) AS q50, round(q75, 9) AS q75, round(q95, 9) AS q95, round(greatest(q75 - q25, 1e-3), 9) AS scale FROM q"""))
def iqr_scale(spark, sf):
    return stats.iqr_scale(measurements(spark, sf), ["axis_id"], F.col("value")).withColumns({c: F.round(c, 9) for c in ("q05", "q25", "q50", "q75", "q95", "scale")})


_PS = {"q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


@query(m(f"""+ f AS (SELECT axis_id, count(*) AS n, avg(price) AS mean, stddev_samp(price) AS sd_samp, stddev_pop(price) AS sd_pop, skewness(price) AS skewness, {', '.join(f'quantile_cont(price, {p}) AS {k}' for k, p in _PS.items())} FROM m GROUP BY 1),
r AS (SELECT m.axis_id, price, f.*, row_number() OVER (PARTITION BY m.axis_id ORDER BY price DESC) AS rn FROM m JOIN f ON m.axis_id = f.axis_id),
o AS (SELECT axis_id, median(abs(price - q50)) AS mad, avg((price < q25 - 1.5 * (q75 - q25) OR price > q75 + 1.5 * (q75 - q25))::DOUBLE) AS tukey_outside, sum(CASE WHEN rn <= ceil(n * 0.01) THEN pow(price - mean, 2) END) / sum(pow(price - mean, 2)) AS top_share FROM r GROUP BY 1)
SELECT axis_id, n, round(mean, 4) AS mean, round(sd_samp, 4) AS sd_samp, round(sd_pop, 4) AS sd_pop, {', '.join(f'round({k}, 4) AS {k}' for k in _PS)}, round(mad, 4) AS mad, round(tukey_outside, 6) AS tukey_outside, round(top_share, 6) AS top_share,
round(skewness, 6) AS skewness, round((q75 + q25 - 2 * q50) / (q75 - q25), 6) AS bowley, round(q75 - q25, 4) AS iqr FROM f JOIN o USING (axis_id)"""))
def distribution_profile(spark, sf):
    out = stats.distribution_profile(measurements(spark, sf), ["axis_id"], F.col("price"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd_samp", "sd_pop", *_PS, "mad", "iqr")} | {c: F.round(c, 6) for c in ("tukey_outside", "top_share", "skewness", "bowley")})


@query(m("""SELECT axis_id, source_key, CASE WHEN grouping(source_key) = 1 THEN 'axis' ELSE 'source' END AS level, count(*) AS n, count_if(ratio = 0)::BIGINT AS zeros, count_if(ratio > 0)::BIGINT AS positives, min(ratio) AS low,
round(quantile_cont(ratio, 0.25), 9) AS q1, round(median(ratio), 9) AS median, round(quantile_cont(ratio, 0.75), 9) AS q3, max(ratio) AS high, round(avg(ratio), 9) AS mean, round(stddev_samp(ratio), 9) AS sd FROM m GROUP BY GROUPING SETS ((axis_id), (axis_id, source_key))"""))
def axis_measurement_summary(spark, sf):
    return cells.summary(measurements(spark, sf), "axis_id", "source_key", "ratio").withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3", "mean", "sd")})


@query(m("""+ w AS (SELECT axis_id, value AS v, sum(sample_count) OVER (PARTITION BY axis_id ORDER BY value, measurement_id ROWS UNBOUNDED PRECEDING) AS c, sum(sample_count) OVER (PARTITION BY axis_id) AS t FROM m)
SELECT axis_id, min(v) AS weighted_median FROM w WHERE c >= 0.5 * t GROUP BY 1"""))
def weighted_median(spark, sf):
    return stats.weighted_median(measurements(spark, sf), ["axis_id"], "value", "sample_count", "measurement_id")


_COLLIDE = "CASE WHEN max(value) = 0 THEN true ELSE (max(value) - min(value)) / max(value) <= 0.05 END"


@query(m(f"SELECT food_id, axis_id, source_key, count(*) AS n, CASE WHEN {_COLLIDE} THEN median(value) END AS value, {_COLLIDE} AS resolved FROM m GROUP BY 1, 2, 3"))
def collision_resolution(spark, sf):
    return cells.collisions(measurements(spark, sf), [*_CELL, "source_key"])


@query(m(f"""+ g AS (SELECT food_id, axis_id, median(value) AS med, {_COLLIDE} AS ok FROM m GROUP BY 1, 2),
f AS (SELECT food_id, axis_id, value AS first FROM m QUALIFY row_number() OVER (PARTITION BY food_id, axis_id ORDER BY {_RANK}, measurement_id) = 1)
SELECT food_id, axis_id, CASE WHEN ok THEN med ELSE first END AS value, CASE WHEN ok THEN 'agreement' ELSE 'priority' END AS rule FROM g JOIN f USING (food_id, axis_id)"""))
def priority_resolution(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, _SOURCES)), F.col("source_key"))
    return cells.agree_or_first(measurements(spark, sf), _CELL, [rank, F.col("measurement_id")])


@query(m("""+ c1 AS (SELECT p_name, axis_id, source_key, profile_id, median(value) AS v FROM m JOIN part ON food_id = p_partkey GROUP BY ALL),
c2 AS (SELECT p_name, axis_id, source_key, median(v) AS v FROM c1 GROUP BY ALL) SELECT p_name, axis_id, median(v) AS value, count(*) AS members FROM c2 GROUP BY ALL"""))
def cross_source_candidates(spark, sf):
    df = measurements(spark, sf).join(table(spark, sf, "part"), F.col("food_id") == F.col("p_partkey"))
    return cells.nested_median(df, [["p_name", "axis_id", "source_key", "profile_id"], ["p_name", "axis_id", "source_key"], ["p_name", "axis_id"]]).select("p_name", "axis_id", "value", "members")


@query(m("""+ s AS (SELECT food_id, axis_id, count(DISTINCT source_key) AS s FROM m GROUP BY ALL), p AS (SELECT food_id, axis_id, source_key, count(DISTINCT profile_id) AS p FROM m GROUP BY ALL)
SELECT measurement_id, round(1.0 / (s * p * count(*) OVER (PARTITION BY food_id, axis_id, source_key, profile_id)), 12) AS weight FROM m JOIN s USING (food_id, axis_id) JOIN p USING (food_id, axis_id, source_key)"""))
def equal_source_weights(spark, sf):
    return cells.equal_source_weights(measurements(spark, sf), _CELL, "source_key", "profile_id").select("measurement_id", F.round("weight", 12).alias("weight"))


@query(m("""+ o AS (SELECT axis_id, count(DISTINCT food_id) AS observed FROM m GROUP BY 1),
c AS (SELECT axis_id, count(DISTINCT food_id) AS capable FROM (SELECT DISTINCT axis_id, source_key FROM m) JOIN (SELECT DISTINCT source_key, food_id FROM m) USING (source_key) GROUP BY 1)
SELECT axis_id, observed, capable, round(observed / capable, 9) AS coverage, CASE WHEN observed >= 100 AND observed / capable >= 0.4 THEN 'train_and_evaluate' WHEN observed >= 100 THEN 'train_only' ELSE 'insufficient_support' END AS role FROM o JOIN c USING (axis_id)"""))
def capability_coverage(spark, sf):
    out = cells.capability_coverage(measurements(spark, sf), "axis_id", "source_key", "food_id")
    return out.withColumn("role", cells.training_role(F.col("coverage"), F.col("observed"), 100, 0.4)).withColumn("coverage", F.round("coverage", 9))


@query(m("SELECT threshold, axis_id, foods, foods >= 1000 * threshold AS supported FROM (SELECT axis_id, count(DISTINCT food_id) AS foods FROM m GROUP BY 1), (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS threshold)"))
def axis_support_sensitivity(spark, sf):
    cell = measurements(spark, sf).select("food_id", "axis_id").distinct().groupBy("axis_id").agg(F.count(F.lit(1)).alias("foods"))
    out = cell.withColumn("threshold", F.explode(F.array(F.lit(0.01), F.lit(0.02), F.lit(0.05))))
    return out.select("threshold", "axis_id", "foods", (F.col("foods") >= 1000 * F.col("threshold")).alias("supported"))


@query(m("SELECT source_key, count(*) AS records, count(DISTINCT food_id) AS foods, count(DISTINCT axis_id) AS axes, count_if(ratio = 0)::BIGINT AS zeros, count_if(quality_tier IN ('A', 'B'))::BIGINT AS strict_tier FROM m GROUP BY 1"))
def source_coverage(spark, sf):
    return measurements(spark, sf).groupBy("source_key").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("food_id").alias("foods"), F.countDistinct("axis_id").alias("axes"), F.count_if(F.col("ratio") == 0).alias("zeros"), F.count_if(F.col("quality_tier").isin("A", "B")).alias("strict_tier"))


@query(m("SELECT p_partkey, p_name, coalesce(axes, 0) AS axes, coalesce(sources, 0) AS sources FROM part LEFT JOIN (SELECT food_id, count(DISTINCT axis_id) AS axes, count(DISTINCT source_key) AS sources FROM m GROUP BY 1) ON p_partkey = food_id"))
def food_coverage(spark, sf):
    seen = measurements(spark, sf).groupBy("food_id").agg(F.countDistinct("axis_id").alias("axes"), F.countDistinct("source_key").alias("sources"))
    return table(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("food_id"), "left").select("p_partkey", "p_name", F.coalesce("axes", F.lit(0)).alias("axes"), F.coalesce("sources", F.lit(0)).alias("sources"))


@query(m("SELECT axis_id, value, n, round(sum(n) OVER (PARTITION BY axis_id ORDER BY value) / sum(n) OVER (PARTITION BY axis_id), 9) AS share FROM (SELECT axis_id, value, count(*) AS n FROM m GROUP BY ALL)"))
def ecdf(spark, sf):
    out = stats.ecdf(measurements(spark, sf), "value", ["axis_id"])
    return out.select("axis_id", "value", "n", F.round("share", 9).alias("share"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL")
def value_counts(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(m("""SELECT measurement_id, CASE WHEN quality_tier NOT IN ('A','B') AND NOT (quality_tier = 'C' AND source_key = 's4') THEN 'x' END IS NULL AND value <= 45 AND (source_key <> 's5') AND (source_key = 's4' AND quality_tier = 'C' OR quality_tier IN ('A','B') AND source_key NOT IN ('s4')) AS eligible,
value <= 45 AND source_key <> 's5' AND quality_tier IN ('A','B') AND source_key <> 's4' AS strict,
CASE WHEN value <= 45 AND (source_key NOT IN ('s4','s5') AND quality_tier IN ('A','B') OR source_key = 's4' AND quality_tier = 'C') THEN NULL WHEN value > 45 THEN 'mass_fraction_exceeds_100_g_per_100_g' WHEN source_key = 's5' THEN 'non_independent_or_derived_value'
WHEN quality_tier NOT IN ('A','B') THEN 'insufficient_value_level_quality' WHEN source_key = 's4' THEN 'non_primary_data_layer' END AS exclusion_reason FROM m"""))
def training_gate(spark, sf):
    df = measurements(spark, sf).withColumns({
        "main_value_eligible": F.col("value") <= 45, "value_status": F.when(F.col("value") > 45, "invalid_mass_fraction_above_100").otherwise("observed"), "independent_evidence": F.col("source_key") != "s5",
        "data_layer": F.when(F.col("source_key") == "s4", "curated_reference_training").otherwise("primary_reference"), "quality_evidence": F.lit("bibliography"), "exclusion_reason": F.lit(None).cast("string"),
    })
    return gates.training_gate(df).select("measurement_id", "eligible", "strict", "exclusion_reason")


_HOLD = [("value > 48", "value_bound"), ("source_key = 's2' AND ratio = 0", "copied_zero"), ("quality_tier = 'D'", "tier_d"), ("price > 90000", "price_bound")]


@query(m(f"SELECT measurement_id, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{r}{chr(39)}' for c, r in _HOLD)} END AS first_reason, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{r}{chr(39)}' for c, r in reversed(_HOLD))} ELSE 'other_nonreported' END AS role, concat_ws(';', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{r}{chr(39)} END' for c, r in _HOLD)}) AS flags FROM m"))
def source_policy_gate(spark, sf):
    rules = [(F.expr(c), r) for c, r in _HOLD]
    return measurements(spark, sf).select("measurement_id", gates.first_reason(rules).alias("first_reason"), gates.last_reason(rules, (F.lit(True), "other_nonreported")).alias("role"), gates.all_flags(rules).alias("flags"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative_value' ELSE 'above_bound' END AS reason FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def invalid_quarantine(spark, sf):
    _, bad = gates.quarantine(table(spark, sf, "customer"), [(F.col("c_acctbal") < 0, "negative_value"), (F.col("c_acctbal") > 9000, "above_bound")])
    return bad.select("c_custkey", "reason")


@query(m(f"""+ e AS (SELECT DISTINCT food_id, profile_id FROM m WHERE value >= 44) {''.join(f''', a{i} AS (SELECT * FROM {'e' if i == 0 else f'b{i - 1}'} WHERE profile_id IN (SELECT profile_id FROM {'e' if i == 0 else f'b{i - 1}'} GROUP BY 1 HAVING count(*) >= 56)),
b{i} AS (SELECT * FROM a{i} WHERE food_id IN (SELECT food_id FROM a{i} GROUP BY 1 HAVING count(*) >= 3))''' for i in range(9))} SELECT food_id, profile_id FROM b8"""))
def fixpoint_filter(spark, sf):
    from ..tables import materialize

    return gates.supported(measurements(spark, sf).where("value >= 44"), "food_id", "profile_id", 56, 3, lambda df: materialize(df, "support", few_files=True))
