"""Queries over entities: joins, names, candidates, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import graph, relational, resolve
from .registry import m, measurements, query, table


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def lineage_join_checked(spark, sf):
    t = lambda n: table(spark, sf, n)
    nation = relational.join_checked(t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), t("region"), ["r_regionkey"], "inner")
    customer = relational.join_checked(t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), nation, ["n_nationkey"], "inner")
    orders = relational.join_checked(t("orders").withColumnRenamed("o_custkey", "c_custkey"), customer, ["c_custkey"], "inner")
    lines = relational.join_checked(t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), orders, ["o_orderkey"], "inner")
    return lines.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("""WITH a AS (SELECT concat('k', s_suppkey % 150) AS code, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name, s_nationkey AS nation FROM supplier),
b AS (SELECT concat('k', n_nationkey * 4) AS code, n_name AS name, n_regionkey AS region FROM nation)
SELECT coalesce(a.code, b.code) AS code, coalesce(nullif(a.name, ''), b.name) AS name, nation, region, CASE WHEN a.code IS NULL THEN 'right' WHEN b.code IS NULL THEN 'left' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.code = b.code""")
def outer_registry_merge(spark, sf):
    a = table(spark, sf, "supplier").selectExpr("concat('k', s_suppkey % 150) AS code", "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name", "s_nationkey AS nation")
    b = table(spark, sf, "nation").selectExpr("concat('k', n_nationkey * 4) AS code", "n_name AS name", "n_regionkey AS region")
    return relational.outer_merge(a, b, "code", ["name"]).select("code", "name", "nation", "region", "origin")


@query("SELECT c_custkey, true AS ordered FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, false FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def semi_anti(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return customer.join(orders, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("ordered")).union(customer.join(orders, "c_custkey", "left_anti").select("c_custkey", F.lit(False)))


@query("""SELECT r_name, p AS o_orderpriority, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) LEFT JOIN
(SELECT r_name AS r, o_orderpriority AS op, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) ON r = r_name AND op = p""")
def cross_product_grid(spark, sf):
    t = lambda n: table(spark, sf, n)
    seen = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grid = t("region").select("r_name").crossJoin(t("orders").select("o_orderpriority").distinct())
    return relational.reindexed(seen.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), grid, {"n": 0})


@query("SELECT p_name AS key, count(*) AS members, min(p_partkey) AS first_item, string_agg(DISTINCT p_partkey::VARCHAR, ';' ORDER BY p_partkey::VARCHAR) AS items FROM (SELECT lower(trim(p_name)) AS p_name, p_partkey FROM part) GROUP BY 1")
def exact_name_groups(spark, sf):
    return resolve.name_groups(table(spark, sf, "part"), text.ascii_label_key(F.col("p_name")), "p_partkey")


@query("WITH n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS r FROM (SELECT DISTINCT p_name FROM part)) SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON b.r - a.r BETWEEN 1 AND 4")
def name_band_candidates(spark, sf):
    return resolve.band_candidates(table(spark, sf, "part"), "p_name")


@query()
def name_band_similarity(spark, sf):
    pairs = resolve.band_candidates(table(spark, sf, "part"), "p_name")
    return pairs.select("a", "b", F.round(text.composite_similarity(F.col("a"), F.col("b")), 6).alias("score"), F.lit(False).alias("automatic_merge"))


@query("WITH a AS (SELECT p_partkey, p_name FROM part) SELECT x.p_name, x.p_partkey AS a, y.p_partkey AS b FROM a x JOIN a y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey")
def within_name_pairs(spark, sf):
    return resolve.within_name_pairs(table(spark, sf, "part"), "p_name", "p_partkey")


@query("""WITH n AS (SELECT min(p_partkey) AS id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part GROUP BY p_name, p_type)
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 9) AS similarity FROM n x JOIN n y ON x.id < y.id WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.5""")
def token_block_jaccard(spark, sf):
    n = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id")).withColumn("w", text.tokens(F.concat_ws(" ", "p_name", "p_type")))
    return resolve.token_block_candidates(n, n, "id", "w").withColumn("similarity", F.round("similarity", 9))


@query("""WITH i AS (SELECT DISTINCT p_brand AS target, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS alias FROM part), q AS (SELECT p_name AS item FROM part UNION SELECT p_type FROM part),
h AS (SELECT item, count(DISTINCT target) AS n, min(target) AS t FROM q JOIN i ON trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) = alias GROUP BY 1)
SELECT item, CASE WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status, CASE WHEN n = 1 THEN t END AS target FROM q LEFT JOIN h USING (item)""")
def alias_mapping(spark, sf):
    """All names and types of parts against an index of all names: brands that a name alone has are its target."""
    part = table(spark, sf, "part")
    index = part.select(F.col("p_brand").alias("target"), text.ascii_label_key(F.col("p_name")).alias("key")).distinct()
    items = part.select(F.col("p_name").alias("item")).union(part.select("p_type")).distinct().withColumn("alias", text.ascii_label_key(F.col("item")))
    return resolve.by_alias(items, "item", "alias", index, "target", "key")


@query("""WITH s AS (SELECT p_name, p_brand, count(*) AS score FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_brand) AS rn, lead(score) OVER (PARTITION BY p_name ORDER BY score DESC, p_brand) AS nx FROM s)
SELECT p_name, CASE WHEN nx IS DISTINCT FROM score THEN p_brand END AS p_brand, score, CASE WHEN nx IS DISTINCT FROM score THEN 'mapped' ELSE 'ambiguous' END AS status FROM r WHERE rn = 1""")
def strict_unique_winner(spark, sf):
    return resolve.strict_winner(table(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("score")), ["p_name"], "p_brand", "score")


_LINKS = "SELECT c_custkey AS id, concat('n', c_nationkey, '/', c_custkey % 40) AS k1, concat(c_mktsegment, '/', c_custkey // 29) AS k2 FROM customer"


@query(f"""WITH RECURSIVE c AS ({_LINKS.replace('//', '//')}), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM c a JOIN c b ON a.k1 = b.k1 OR a.k2 = b.k2),
r(id, reach) AS (SELECT id, id FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a) SELECT id, min(reach) AS label FROM r GROUP BY 1""")
def connected_components(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('n', c_nationkey, '/', c_custkey % 40) AS k1", "concat(c_mktsegment, '/', c_custkey div 29) AS k2")
    return graph.groups(c, "id", [(c, "k1"), (c, "k2")])


@query()
def facet_union_find(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"))
    label = graph.groups(part, "p_partkey", [(part, "p_name")])
    return graph.constrained_groups(part.join(label, "p_partkey"), "p_partkey", "p_type", "label", "p_name")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), a(child, ancestor, distance) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT a.child, e.parent, distance + 1 FROM a JOIN e ON a.ancestor = e.child WHERE distance < 4)
SELECT child, ancestor, min(distance)::INT AS distance FROM a GROUP BY 1, 2""")
def ontology_ancestors(spark, sf):
    e = table(spark, sf, "part").where("p_partkey > 0").selectExpr("p_partkey AS child", "p_partkey div 3 AS parent")
    return graph.ancestors(e, "child", "parent", 4)


@query()
def frozen_block_attachment(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    frozen = part.where("id % 5 = 0").select("id", F.concat(F.lit("b"), (F.col("id") % 7).cast("string")).alias("block"))
    edges = part.where("id % 3 = 0").selectExpr("id AS a", "id + 1 AS b").join(part.withColumnRenamed("id", "b"), "b", "left_semi")
    return graph.attach_to_frozen(part, "id", frozen, "block", edges)


@query("SELECT p_partkey, 'part:' || sha256(concat_ws(chr(31), p_name, p_brand, '', p_size))[1:16] AS stable_id, concat('0x', sha256(p_name)[1:8])::BIGINT % 5 AS fold, sha256(concat_ws(chr(31), p_name, p_brand, '', p_size))[1:2] AS shard FROM part")
def stable_ids(spark, sf):
    sid = ids.stable_id("part", F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", sid.alias("stable_id"), ids.hash_bucket(F.col("p_name"), 5).alias("fold"), ids.shard(sid).alias("shard"))


@query("""WITH v AS (SELECT DISTINCT p_partkey AS id, axis_id, max(value) OVER (PARTITION BY p_partkey, axis_id) AS v FROM part JOIN (SELECT l_partkey, concat(l_returnflag, l_linestatus) AS axis_id, l_quantity AS value FROM lineitem) ON l_partkey = p_partkey),
p AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey)
SELECT a, b, count(*) AS shared, count_if(abs(l.v - r.v) <= 0.05 * greatest(l.v, r.v))::BIGINT AS agreeing FROM p JOIN v l ON l.id = a JOIN v r ON r.id = b AND r.axis_id = l.axis_id GROUP BY 1, 2""")
def shared_axis_agreement(spark, sf):
    part = table(spark, sf, "part")
    values = measurements(spark, sf).groupBy(F.col("food_id").alias("p_partkey"), "axis_id").agg(F.max("value").alias("v"))
    return resolve.name_agreement(part, "p_name", "p_partkey", values, "axis_id", "v")


@query("""SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def embedding_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return resolve.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query(m("SELECT food_id, p_partkey FROM m JOIN part ON food_id = p_partkey UNION SELECT food_id, p_partkey FROM m JOIN part ON sample_count = p_partkey"))
def multi_key_lookup(spark, sf):
    facts = measurements(spark, sf).withColumn("n", F.col("sample_count").cast("long"))
    return relational.lookup_any(facts, table(spark, sf, "part"), [("food_id", "p_partkey"), ("n", "p_partkey")], "food_id", "p_partkey")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def sorted_distinct_text(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"), text.distinct_text(F.col("event_type")).alias("kinds"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM f)
SELECT user_id, string_agg(event_type, '; ' ORDER BY o) FILTER (rn <= 3) || CASE WHEN any_value(n) > 3 THEN '; ... (' || any_value(n) - 3 || ' more)' ELSE '' END AS kinds FROM r GROUP BY 1""")
def first_seen_text(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(text.first_seen_text(F.col("event_type"), F.col("event_id"), 3).alias("kinds"))


@query("SELECT p_partkey, p_name FROM part EXCEPT SELECT p_partkey, p_name FROM part WHERE p_size > 10")
def set_difference(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", "p_name").subtract(part.where("p_size > 10").select("p_partkey", "p_name"))


@query("SELECT n_of AS sources, count(*) AS foods FROM (SELECT food_id, count(DISTINCT source_key) AS n_of FROM (SELECT l_partkey AS food_id, concat('s', l_suppkey % 6) AS source_key FROM lineitem) GROUP BY 1) GROUP BY 1")
def exactly_k_sources(spark, sf):
    wide = relational.to_wide(measurements(spark, sf), ["food_id"], "source_key", [f"s{i}" for i in range(6)], F.first(F.lit(1)), 0)
    return wide.select(sum(F.col(f"s{i}") for i in range(6)).cast("long").alias("sources")).groupBy("sources").agg(F.count(F.lit(1)).alias("foods"))


@query("SELECT count(*) AS documents, count(DISTINCT text) AS distinct_texts, count(*) - count(DISTINCT text) AS copies FROM documents")
def dup_documents(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))
    return n.withColumn("copies", F.col("documents") - F.col("distinct_texts"))


@query("""SELECT p_partkey, 'name: ' || p_name || '. group: ' || p_type || CASE WHEN p_size > 25 THEN '. size: ' || p_size ELSE '' END AS label, replace(p_name, ' ', '_') AS slug FROM part""")
def food_text(spark, sf):
    parts = {"name": F.col("p_name"), "group": F.col("p_type"), "size": F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))}
    return table(spark, sf, "part").select("p_partkey", text.labelled(parts).alias("label"), text.slug(F.col("p_name")).alias("slug"))


@query()
def unicode_keys(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return words.select("word", text.label_key(F.col("word")).alias("label_key"), text.name_key(F.col("word")).alias("name_key"))
