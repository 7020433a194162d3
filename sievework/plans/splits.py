"""Queries over splits, masks, metrics and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import evaluate, resolve, split, trees
from .registry import m, measurements, query, table

_HASH = "concat('0x', sha256({0})[1:8])::BIGINT"


@query("SELECT p_partkey, concat('0x', sha256(p_name)[1:8])::BIGINT % 5 AS cv_fold, CASE WHEN concat('0x', sha256(p_name)[1:15])::BIGINT / pow(2, 60) < 0.15 THEN 'validation' ELSE 'train' END AS partition FROM part")
def hash_split(spark, sf):
    return split.folds(split.group_split(table(spark, sf, "part"), F.col("p_name")), F.col("p_name")).select("p_partkey", "cv_fold", "partition")


@query(f"SELECT p_partkey FROM part WHERE p_size > 45 OR {_HASH.format('p_partkey::VARCHAR')} % 10 = 0")
def expert_sample(spark, sf):
    return split.sample_for_review(table(spark, sf, "part"), F.col("p_size") > 45, F.col("p_partkey")).select("p_partkey")


@query("""WITH r AS (SELECT p_partkey, p_type, (row_number() OVER (PARTITION BY p_type ORDER BY sha256(p_partkey::VARCHAR), p_partkey) - 0.5) / count(*) OVER (PARTITION BY p_type) AS x FROM part)
SELECT p_partkey, p_type, CASE WHEN x <= 0.7 + 1e-12 THEN 'train' WHEN x <= 0.85 + 1e-12 THEN 'validation' ELSE 'test' END AS partition FROM r""")
def stratified_split(spark, sf):
    return split.stratified(table(spark, sf, "part"), "p_type", "p_partkey").select("p_partkey", "p_type", "partition")


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_brand || '/' || p_name AS family FROM part), f AS (SELECT family, n, row_number() OVER (ORDER BY sha256(family), family) AS i FROM (SELECT family, count(*) AS n FROM p GROUP BY 1)),
g(i, room) AS (SELECT 0::BIGINT, greatest(1, count(*) // 5)::BIGINT FROM f UNION ALL SELECT f.i, CASE WHEN n <= room THEN room - n ELSE room END FROM g JOIN f ON f.i = g.i + 1),
t AS (SELECT family FROM f JOIN g ON g.i = f.i - 1 WHERE n <= room) SELECT p_partkey, family, CASE WHEN family IN (SELECT family FROM t) THEN 'validation' ELSE 'train' END AS partition, (SELECT min(room) FROM g) AS unfilled FROM p""")
def family_holdout_split(spark, sf):
    """A fifth as many parts as there are families, in whole families by hash; what they leave unfilled is said."""
    part = table(spark, sf, "part").withColumn("family", F.concat_ws("/", "p_brand", "p_name"))
    n = part.select("family").distinct().count()
    return split.family_holdout(part, "family", max(1, n // 5), exact=False).select("p_partkey", "family", "partition", "unfilled")


@query()
def group_test_cover(spark, sf):
    df = measurements(spark, sf).join(table(spark, sf, "part"), F.col("food_id") == F.col("p_partkey"))
    return split.test_cover(df, "p_brand", "axis_id", "food_id", 150, 200).groupBy("p_brand", "partition").agg(F.countDistinct("food_id").alias("foods"))


@query()
def family_masks(spark, sf):
    return split.family_masks(measurements(spark, sf), "food_id", "axis_id")


@query(m("""+ j AS (SELECT food_id, axis_id AS hidden_family, count(*) AS hidden FROM m GROUP BY ALL), w AS (SELECT *, (sum(hidden) OVER (PARTITION BY food_id) - hidden)::BIGINT AS visible FROM j) SELECT * FROM w WHERE visible > 0"""))
def leave_one_family_out_jobs(spark, sf):
    return split.leave_one_family_out(measurements(spark, sf), "food_id", "axis_id")


@query(m("""+ r AS (SELECT food_id, axis_id, row_number() OVER (PARTITION BY food_id ORDER BY sha256(concat_ws('|', food_id, axis_id)), axis_id)::INT AS step, count(*) OVER (PARTITION BY food_id) AS n FROM (SELECT DISTINCT food_id, axis_id FROM m))
SELECT food_id, axis_id, step FROM r WHERE step <= least(ceil(n * 0.5), 5)"""))
def sequential_masks(spark, sf):
    return split.sequential_masks(measurements(spark, sf), "food_id", "axis_id")


@query(m("SELECT food_id, min_by(axis_id, sha256(concat_ws('|', food_id, axis_id))) AS hidden_family FROM m GROUP BY 1"))
def hidden_family(spark, sf):
    return split.hidden_family(measurements(spark, sf), "food_id", "axis_id")


_PRED = "SELECT axis_id, food_id, source_key, value AS y, avg(value) OVER (PARTITION BY food_id) AS p, median(value) OVER (PARTITION BY axis_id) AS b FROM m"


def _predictions(spark, sf):
    return spark.sql(_PRED.replace("FROM m", "FROM {m}"), m=measurements(spark, sf))


_METRICS = f"""+ p AS ({_PRED}), r AS (SELECT *, rank() OVER (PARTITION BY axis_id ORDER BY y) + (count(*) OVER (PARTITION BY axis_id, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY axis_id ORDER BY p) + (count(*) OVER (PARTITION BY axis_id, p) - 1) / 2 AS rp FROM p),
k AS (SELECT axis_id, count(*) AS n, avg(abs(p - y)) AS mae, avg(pow(p - y, 2)) AS mse, corr(ry, rp) AS spearman, min(y) AS low, quantile_cont(y, 0.25) AS q1, median(y) AS median, quantile_cont(y, 0.75) AS q3, max(y) AS high, sqrt(avg(pow(p - y, 2))) AS rmse, 1 - avg(pow(p - y, 2)) / var_pop(y) AS r2 FROM r GROUP BY 1)"""


@query(m(f"{_METRICS} SELECT axis_id, n, round(mae, 6) AS mae, round(mse, 6) AS mse, round(spearman, 6) AS spearman, low, q1, median, q3, high, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM k"))
def regression_metrics(spark, sf):
    out = evaluate.regression_metrics(_predictions(spark, sf), ["axis_id"], "y", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "mse", "spearman", "rmse", "r2")})


@query(m(f"""{_METRICS} SELECT 'all' AS scope, count(*) AS axes, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse FROM k UNION ALL SELECT axis_id[1:1], count(*), round(avg(mae), 6), round(avg(rmse), 6) FROM k GROUP BY axis_id[1:1]"""))
def macro_average(spark, sf):
    by_axis = evaluate.regression_metrics(_predictions(spark, sf), ["axis_id"], "y", "p").withColumn("loss_group", F.substring("axis_id", 1, 1))
    return evaluate.macro(by_axis, ["mae", "rmse"], "loss_group").withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


@query(m(f"""+ p AS ({_PRED}) SELECT axis_id, round(avg(abs(p - y)), 6) AS mae, round(avg(abs(b - y)), 6) AS baseline_mae, round(avg(abs(p - y)) FILTER (y > 47.5), 6) AS tail_mae, round(1 - avg(abs(p - y)) / avg(abs(b - y)), 6) AS skill FROM p GROUP BY 1"""))
def relative_skill(spark, sf):
    out = evaluate.skill(_predictions(spark, sf), ["axis_id"], "y", "p", "b", F.col("y") > 47.5)
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "baseline_mae", "tail_mae", "skill")})


@query(m(f"+ p AS ({_PRED}) SELECT axis_id, round(sum((food_id % 2) * pow(y - p, 2)) / (sum(food_id % 2) + 1e-8), 6) AS masked_mse FROM p GROUP BY 1"))
def masked_mse(spark, sf):
    df = _predictions(spark, sf).withColumn("mask", F.col("food_id") % 2)
    return evaluate.masked_mse(df, ["axis_id"], "y", "p", "mask").withColumn("masked_mse", F.round("masked_mse", 6))


@query()
def cluster_bootstrap_interval(spark, sf):
    df = _predictions(spark, sf).withColumn("error", F.abs(F.col("p") - F.col("y")))
    return evaluate.cluster_interval(df, "food_id", "axis_id", "error").withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("""WITH p AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 7919 % 1000) / 20000.0::DOUBLE AS p FROM supplier), r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY p, s_suppkey))
SELECT s_suppkey, round(least(1.0, max((n - k + 1) * p) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 12) AS p_adjusted FROM r""")
def holm_adjustment(spark, sf):
    df = table(spark, sf, "supplier").withColumn("p", (F.col("s_suppkey") * 7919 % 1000).cast("double") / 20000.0)
    return evaluate.holm(df, ["s_nationkey"], "p", "s_suppkey").select("s_suppkey", F.round("p_adjusted", 12).alias("p_adjusted"))


_TOP = """SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10"""


@query(f"WITH t AS ({_TOP}) SELECT query, 'label' AS axis, round(sum((greatest(similarity, 0.0) + 1e-6) * label) / sum(greatest(similarity, 0.0) + 1e-6), 6) AS predicted FROM t JOIN embeddings ON vec_id = neighbour GROUP BY 1")
def text_knn(spark, sf):
    e = table(spark, sf, "embeddings")
    values = e.select("vec_id", F.lit("label").alias("axis"), F.col("label").cast("double").alias("label"))
    return evaluate.knn_predictions(resolve.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10), values, "vec_id", "axis", "label").withColumn("predicted", F.round("predicted", 6))


@query(m("""+ x AS (SELECT m.*, p_type FROM m JOIN part ON food_id = p_partkey), t AS (SELECT * FROM x WHERE food_id % 5 > 0 AND NOT (p_type = 'ECONOMY' AND axis_id = 'NO')), a AS (SELECT DISTINCT food_id, p_type, axis_id FROM x WHERE food_id % 5 = 0),
g AS (SELECT p_type, axis_id, avg(value) AS g FROM t GROUP BY ALL), e AS (SELECT axis_id, avg(value) AS e FROM t GROUP BY ALL)
SELECT food_id, a.p_type, a.axis_id, round(coalesce(g, e), 6) AS predicted FROM a LEFT JOIN g USING (p_type, axis_id) LEFT JOIN e USING (axis_id)"""))
def group_mean_baseline(spark, sf):
    x = measurements(spark, sf).join(table(spark, sf, "part"), F.col("food_id") == F.col("p_partkey"))
    train = x.where("food_id % 5 > 0 AND NOT (p_type = 'ECONOMY' AND axis_id = 'NO')")
    asked = x.where("food_id % 5 = 0").select("food_id", "p_type", "axis_id").distinct()
    return evaluate.group_mean_predictions(train, asked, "p_type", "axis_id", "value").select("food_id", "p_type", "axis_id", F.round("predicted", 6).alias("predicted"))


@query(m("""+ k AS (SELECT DISTINCT food_id FROM m WHERE food_id % 4 > 0) SELECT DISTINCT food_id, coalesce(i, 0) AS token FROM m LEFT JOIN (SELECT food_id, row_number() OVER (ORDER BY food_id) AS i FROM k) USING (food_id)"""))
def vocabulary_index(spark, sf):
    from ..operators.relational import dense_index

    df = measurements(spark, sf).select("food_id").distinct()
    vocabulary = dense_index(df.where("food_id % 4 > 0"), "food_id", "token")
    return df.join(vocabulary, "food_id", "left").fillna(0, ["token"])


@query(m("SELECT food_id, (sum(n) OVER (ORDER BY food_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY food_id))::BIGINT AS stop FROM (SELECT food_id, count(*) AS n FROM m GROUP BY 1)"))
def token_offsets(spark, sf):
    from ..operators.relational import running_total

    n = measurements(spark, sf).groupBy("food_id").agg(F.count(F.lit(1)).alias("n"))
    return running_total(n, "food_id", "n").select("food_id", (F.col("running") - F.col("n")).alias("start"), F.col("running").alias("stop"))


@query()
def forest_baseline(spark, sf):
    """A forest of 20 trees for each axis, all grown at once, on an embedding, size, price, what the item's other axes show and
    whether they show it, a third of the items with an axis masked: rows only, as no other engine grows the same trees."""
    cells = measurements(spark, sf).groupBy("food_id", "axis_id").agg(F.avg("value").alias("value"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("food_id"), F.slice("embedding", 1, 8).alias("vector"))
    items = table(spark, sf, "part").selectExpr("p_partkey AS food_id", "double(p_size) AS size", "p_retailprice AS price").join(vectors, "food_id", "left")
    masked = cells.where("food_id % 3 = 0 AND axis_id = 'NO'").select("food_id", "axis_id")
    out = trees.forests(cells, "food_id", "axis_id", "value", items, ["size", "price"], F.col("food_id") % 5 > 0, masked=masked, vector="vector")
    return out.withColumn("mae", F.round("mae", 9))


_TREE_ROWS = "SELECT p_partkey AS item, l_returnflag || l_linestatus AS axis, sum(l_quantity)::BIGINT AS y, max(p_size)::DOUBLE AS f0, max(p_partkey % 7)::DOUBLE AS f1 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"


def _level(rows: str, name: str) -> str:
    """The best split of each axis and node, by least squares over all values of both features."""
    return f"""{name}h AS (SELECT axis, node, f, x, count(*) AS n, sum(y)::BIGINT AS s FROM (SELECT axis, node, 0 AS f, f0 AS x, y FROM {rows} UNION ALL SELECT axis, node, 1, f1, y FROM {rows}) GROUP BY ALL),
{name}c AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER v AS nt, sum(s) OVER v AS st FROM {name}h WINDOW w AS (PARTITION BY axis, node, f ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY axis, node, f)),
{name}g AS (SELECT *, sl::DOUBLE * sl::DOUBLE / nl + (st - sl)::DOUBLE * (st - sl)::DOUBLE / (nt - nl) AS gain FROM {name}c WHERE nl >= 3 AND nt - nl >= 3),
{name} AS (SELECT axis, node, f, x AS cut FROM {name}g WHERE gain > st::DOUBLE * st::DOUBLE / nt * (1 + 1e-12) QUALIFY row_number() OVER (PARTITION BY axis, node ORDER BY gain DESC, f, x) = 1)"""


@query(f"""WITH r0 AS (SELECT *, 1 AS node FROM ({_TREE_ROWS})), {_level("r0", "a")}, r1 AS (SELECT r.* EXCLUDE (node), CASE WHEN a.f IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN CASE a.f WHEN 0 THEN f0 ELSE f1 END > a.cut THEN 1 ELSE 0 END END AS node FROM r0 r LEFT JOIN a USING (axis, node)),
{_level("(SELECT * FROM r1 WHERE node > 1)", "b")}, r2 AS (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN CASE b.f WHEN 0 THEN f0 ELSE f1 END > b.cut THEN 1 ELSE 0 END END AS node FROM r1 r LEFT JOIN b USING (axis, node)),
n AS (SELECT axis, node, y FROM r0 UNION ALL SELECT axis, node, y FROM r1 WHERE node > 1 UNION ALL SELECT axis, node, y FROM r2 WHERE node > 3)
SELECT axis, node, any_value(s.f) AS feature, any_value(s.cut) AS cut, count(*) AS n, round(sum(y) / count(*), 9) AS mean FROM n LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) s USING (axis, node) GROUP BY ALL""")
def axis_trees(spark, sf):
    """A tree of two levels for each axis, all grown at once, without bagging: the same splits as exact ones."""
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part").selectExpr("p_partkey AS item", "array(double(p_size), double(p_partkey % 7)) AS features")
    cells = lines.groupBy(F.col("l_partkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.sum("l_quantity").cast("long").alias("y"))
    names = sorted(r[0] for r in cells.select("name").distinct().collect())
    cuts = trees.cut_points(parts, "features", 128)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    rows = trees.binned(parts, "features", cuts, ["item"]).join(cells.select("item", place.alias("axis"), "y"), "item")
    forest = trees.grow(rows.select("axis", F.xxhash64("item").alias("key"), "y", "bins"), names, cuts, trees=1, depth=2, bagged=False)
    return trees.node_table(spark, forest).select("axis", "node", "feature", "cut", "n", F.round("mean", 9).alias("mean"))


@query()
def principal_components(spark, sf):
    """The first 32 principal components of the training vectors, and every vector's place on them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=32, inputCol="features", outputCol="p").fit(e.where("vec_id % 5 > 0"))
    return model.transform(e).select("vec_id", F.transform(vector_to_array("p"), lambda v: F.round(F.abs(v), 6)).alias("place"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part), t AS (SELECT p_partkey, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
i AS (SELECT word, ln((1 + (SELECT count(DISTINCT p_partkey) FROM t)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1), v AS (SELECT p_partkey, word, tf * idf AS w FROM t JOIN i USING (word))
SELECT p_partkey, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 9) AS weight FROM v""")
def word_weights(spark, sf):
    from ..operators.features import word_weights

    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return word_weights(part, "p_partkey", F.col("label")).withColumn("weight", F.round("weight", 9))


@query()
def sequential_prediction(spark, sf):
    """Hidden axes predicted order by order: the predictions of one order are context of the next only once it is done."""
    from ..tables import materialize

    cells = measurements(spark, sf).groupBy("food_id", "axis_id").agg(F.median("value").alias("value"))
    masks = split.sequential_masks(cells, "food_id", "axis_id")
    context = cells.join(masks, ["food_id", "axis_id"], "left_anti")
    center = materialize(cells.groupBy("axis_id").agg(F.median("value").alias("center")), "center", few_files=True)
    done = None
    for step in range(1, 6):
        shift = context.join(center, "axis_id").groupBy("food_id").agg(F.avg(F.col("value") - F.col("center")).alias("shift"))
        now = masks.where(F.col("step") == step).join(center, "axis_id").join(shift, "food_id", "left")
        now = materialize(now.select("food_id", "axis_id", "step", (F.col("center") + F.coalesce("shift", F.lit(0.0))).alias("predicted")), "order", few_files=True)
        context = context.unionByName(now.select("food_id", "axis_id", F.col("predicted").alias("value")))
        done = now if done is None else done.unionByName(now)
    return done.withColumn("predicted", F.round("predicted", 6))
