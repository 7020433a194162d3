"""Sparse matrices, rule trees, constraints, recovered identities, withdrawn labels and sharded files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints, matrix, recovery, rules
from ..operators.constraints import Constraint
from ..sources import pages
from ..sources.readers import artifacts
from ..tables import new_path
from .registry import query, table

_CELLS = "SELECT l_partkey AS item, l_suppkey AS pos, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL"


def _matrix(spark, sf, where: str = "true"):
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("at")).agg(F.sum("l_quantity").cast("double").alias("v")).where(where)
    return matrix.blocked(cells, "item", "at", "v")


@query(f"""SELECT item, pos // 32 AS block, bit_or(1::BIGINT << (pos % 32)::INT) AS observed, count(*) AS n, round(sum(v), 6) AS total FROM ({_CELLS}) GROUP BY ALL""")
def blocked_matrix(spark, sf):
    """Parts by suppliers as blocks of 32 columns, and back to cells again."""
    m = _matrix(spark, sf)
    back = matrix.cells(m, "item").groupBy("item", F.floor(F.col("column") / 32).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return m.select("item", "block", "observed").join(back, ["item", "block"])


@query(f"""WITH c AS ({_CELLS}), a AS (SELECT * FROM c WHERE NOT (pos % 7 = 0 AND item % 3 = 0)), b AS (SELECT item, pos, v * 2 AS v FROM c WHERE pos % 5 > 0)
SELECT pos // 32 AS block, count(*) AS n, round(sum((a.v - b.v) ** 2), 6) AS squared, round(sum(abs(a.v - b.v)), 6) AS absolute FROM a JOIN b USING (item, pos) WHERE pos % 2 = 0 GROUP BY 1""")
def masked_matrix_error(spark, sf):
    """Errors of a matrix against another over masked cells, after some cells of the first were withdrawn, block by block."""
    true, hidden, mask = _matrix(spark, sf), _matrix(spark, sf, "at % 7 = 0 AND item % 3 = 0"), _matrix(spark, sf, "at % 2 = 0")
    predicted = _matrix(spark, sf, "at % 5 > 0").withColumn("values", F.transform("values", lambda x: x * 2))
    out = matrix.masked_error(matrix.withdrawn(true, "item", hidden), predicted, "item", mask)
    return out.select("block", "n", F.round("squared", 6).alias("squared"), F.round("absolute", 6).alias("absolute"))


@query("""WITH k AS (SELECT ps AS name, row_number() OVER (ORDER BY ps) - 1 AS i FROM (SELECT DISTINCT p_type || ' ' || p_brand AS ps FROM part)), c AS (SELECT l_orderkey AS o, i, avg(l_quantity)::DOUBLE AS v FROM lineitem JOIN part ON p_partkey = l_partkey JOIN k ON name = p_type || ' ' || p_brand GROUP BY ALL),
g AS (SELECT o, count(DISTINCT i // 32) AS blocks, count(*) AS cells, round(sum(ln(1 + v / CASE WHEN i % 2 = 0 THEN 100 ELSE 1 END)), 6) AS total FROM c GROUP BY 1) SELECT o_orderkey, o_orderpriority, coalesce(blocks, 0) AS blocks, coalesce(cells, 0) AS cells, coalesce(total, 0) AS total FROM orders LEFT JOIN g ON o = o_orderkey""")
def model_table(spark, sf):
    """Orders with the kinds of their parts as blocked targets: percents as shares, log1p."""
    part = table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "concat(p_type, ' ', p_brand) AS kind")
    lines = table(spark, sf, "lineitem").join(part, "l_partkey")
    cells = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), "kind").agg(F.avg("l_quantity").cast("double").alias("v"))
    index = matrix.column_index(part, "kind")
    cells = matrix.target_cells(cells.join(index, "kind"), "v", F.col("index") % 2 == 0).drop("index")
    rows = matrix.model_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", {"kinds": matrix.blocked(cells, "o_orderkey", "kind", "v", index)})
    total = F.aggregate("kinds", F.lit(0.0), lambda a, b: a + F.aggregate(b["values"], F.lit(0.0), lambda x, y: x + y))
    n = F.aggregate("kinds", F.lit(0), lambda a, b: a + F.size(b["values"]))
    return rows.select("o_orderkey", "o_orderpriority", F.size("kinds").cast("long").alias("blocks"), n.cast("long").alias("cells"), F.round(total, 6).alias("total"))


_TAG = ["FATCE", "", "FASAT", "CHOLN", "VITB12", "", "FIBTG", "XX1", "TRP", ""]
_NAME = ["Total fat", "Starch, wheat", "Fatty acids", "Choline", "Cobalamin", "Protein from amino acids", "Dietary fibre", "Vitamin X", "Tryptophan", "Iron, total", "Nothing known", "Biotin"]
_ROLE = ["macronutrient", "micronutrient_vitamin", "micronutrient_mineral", "other_food_component"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_KEYED = f"""WITH p AS (SELECT p_partkey AS id, {_list(_TAG)}[1 + p_partkey % 10] AS t, {_list(_NAME)}[1 + p_partkey % 12] AS name, {_list(_ROLE)}[1 + p_size % 4] AS role FROM part),
k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n, CASE WHEN t <> '' THEN t ELSE 'label:' || sha256(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')))[1:16] END AS tl FROM p)"""


def _vitamin_sql() -> str:
    whens = []
    for v, tags, words in rules._VITAMINS:
        tests = [f"starts_with(t, '{x}')" for x in tags] + [f"contains(n, '{w}')" for w in words]
        whens.append(f"WHEN role = 'micronutrient_vitamin' AND ({' OR '.join(tests)}) THEN 'vitamin:{v}'")
    return " ".join(whens)


_FAMILY = f"""CASE WHEN t = 'CHOLN' OR role = 'essential_nutrient_choline' THEN 'choline_family'
WHEN (role = 'macronutrient' OR starts_with(t, 'FA') OR contains(n, 'fatty acid')) AND (starts_with(t, 'FA') OR contains(n, 'fat')) THEN 'lipid_and_fatty_acid_family'
WHEN t = 'TRP' OR n = 'tryptophan' OR contains(n, 'protein') OR contains(n, 'amino acid') THEN 'protein_and_amino_acid_family' WHEN starts_with(t, 'FIB') OR contains(n, 'starch') OR contains(n, 'fibre') THEN 'carbohydrate_family'
{_vitamin_sql()} WHEN role = 'micronutrient_vitamin' THEN 'vitamin_unresolved:' || tl WHEN role = 'micronutrient_mineral' THEN 'mineral:' || CASE WHEN t <> '' THEN t ELSE split_part(n, ' ', 1) END ELSE 'component:' || tl END"""


@query(f"""{_KEYED} SELECT {_FAMILY} AS family, count(*) AS n, min(id) AS first FROM k GROUP BY 1""")
def component_families(spark, sf):
    """The family of each part read as a component, by tag, name and role: the first rule that holds."""
    pick = lambda xs, by: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + {by} AS int))"
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{pick(_TAG, 'p_partkey % 10')} AS tag", f"{pick(_NAME, 'p_partkey % 12')} AS name", f"{pick(_ROLE, 'p_size % 4')} AS role")
    return rules.families(parts, "id", "tag", "name", "role").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_CATEGORY, _BY, _AUTHORITY = ["element_boundary", "unresolved", "non_mass_or_censored", "micro_vitamin", "proximate", "lipid"], ["salt", "x", "B1_salt", "cryptoxanthin", "y"], ["INCHIKEY", "SOURCE", "CHEBI"]
_REVIEW_KEYS = f"SELECT p_partkey AS id, {_list(_CATEGORY)}[1 + p_partkey % 6] AS category, {_list(_BY)}[1 + p_size % 5] AS by_rule, {_list(_AUTHORITY)}[1 + p_partkey // 7 % 3] AS authority FROM part"


@query(f"""SELECT id, CASE WHEN authority = 'INCHIKEY' AND category = 'micro_vitamin' THEN 'source_expression_and_structure_review' WHEN authority = 'SOURCE' AND category NOT IN ('non_mass_or_censored', 'unresolved', 'proximate') THEN 'source_label_family_assignment'
WHEN by_rule = 'salt' THEN 'measurement_expression_review' WHEN by_rule = 'cryptoxanthin' THEN 'isomer_activity_review' WHEN by_rule = 'B1_salt' THEN 'measurement_expression_review' WHEN category = 'non_mass_or_censored' THEN 'numerical_use_requires_correction'
WHEN category = 'unresolved' THEN 'identity_unresolved' WHEN category = 'element_boundary' THEN 'qualified_nutritional_status' ELSE 'evidence_supported_project_assignment' END AS review_status FROM ({_REVIEW_KEYS})""")
def classification_reviews(spark, sf):
    pick = lambda xs, by: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + {by} AS int))"
    axes = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{pick(_CATEGORY, 'p_partkey % 6')} AS category", f"{pick(_BY, 'p_size % 5')} AS by_rule", f"{pick(_AUTHORITY, '(p_partkey DIV 7) % 3')} AS authority")
    return rules.reviewed(axes, "id", "category", "by_rule", "authority").select("id", "review_status")


_CHECKS = [
    Constraint("price_bound", "lines", "row", "l_extendedprice NOT BETWEEN 0 AND 90000"),
    Constraint("discounted_return", "lines", "row", "l_discount > 0.09 AND l_returnflag = 'R'", severity="warning"),
    Constraint("late_ship", "lines", "row", "l_quantity > 45", where="l_linestatus = 'O'"),
    Constraint("one_line", "lines", "unique", columns=("l_orderkey", "l_linenumber")),
    Constraint("one_supplier_a_part", "lines", "unique", columns=("l_partkey", "l_suppkey", "l_linenumber")),
    Constraint("line_order", "lines", "order", "l_linenumber", ("l_orderkey",)),
    Constraint("known_part", "lines", "reference", columns=("l_partkey",), other="parts", other_columns=("p_partkey",)),
    Constraint("used_part", "lines", "covers", columns=("l_partkey",), other="parts", other_columns=("p_partkey",), severity="warning"),
    Constraint("mean_quantity", "lines", "total", "avg(l_quantity) > 20"),
    Constraint("no_size_zero", "parts", "row", "p_size < 1"),
]


@query("""WITH l AS (SELECT * FROM lineitem), p AS (SELECT * FROM part WHERE p_partkey % 10 > 0), v AS (
SELECT 'price_bound' AS c, count(*) AS violations, count(*)::BIGINT AS rows FROM l WHERE l_extendedprice NOT BETWEEN 0 AND 90000 UNION ALL SELECT 'discounted_return', count(*), count(*)::BIGINT FROM l WHERE l_discount > 0.09 AND l_returnflag = 'R' UNION ALL SELECT 'late_ship', count(*), count(*)::BIGINT FROM l WHERE l_quantity > 45 AND l_linestatus = 'O'
UNION ALL SELECT 'one_line', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'one_supplier_a_part', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM l GROUP BY l_partkey, l_suppkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'line_order', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM l GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) <> count(*) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*))
UNION ALL SELECT 'known_part', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM p) GROUP BY l_partkey) UNION ALL SELECT 'used_part', count(*), count(*)::BIGINT FROM p WHERE p_partkey NOT IN (SELECT l_partkey FROM l)
UNION ALL SELECT 'mean_quantity', count_if(m > 20), CASE WHEN any_value(m) > 20 THEN any_value(n) ELSE 0 END::BIGINT FROM (SELECT avg(l_quantity) AS m, count(*) AS n FROM l) UNION ALL SELECT 'no_size_zero', count(*), count(*)::BIGINT FROM p WHERE p_size < 1)
SELECT c AS "constraint", CASE WHEN c IN ('discounted_return', 'used_part') THEN 'warning' ELSE 'critical' END AS severity, violations, rows, violations = 0 AS passed FROM v""")
def constraint_summary(spark, sf):
    """Ten constraints over two tables; the three of rows of one table are one scan."""
    tables = {"lines": table(spark, sf, "lineitem"), "parts": table(spark, sf, "part").where("p_partkey % 10 > 0")}
    return constraints.summary(constraints.violations(tables, _CHECKS, {"lines": ["l_orderkey", "l_linenumber"], "parts": ["p_partkey"]}), _CHECKS)


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey % 50 AS a, o_orderkey % 700 AS b, o_custkey AS c FROM orders), f AS (SELECT p_partkey % 40 AS k, min(p_brand) AS lo, max(p_brand) AS hi, count(DISTINCT p_brand) AS n FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 40 < 20 GROUP BY 1),
s AS (SELECT s_suppkey AS k, s_name AS x FROM supplier), q AS (SELECT k, arg_min(x, (length(x), x)) AS x FROM (SELECT c_nationkey + 100 * (c_custkey % 3) AS k, c_name AS x FROM customer) GROUP BY 1)
SELECT id, CASE WHEN id % 97 = 0 THEN 'unresolved' WHEN f.n > 1 THEN 'ambiguous' WHEN f.n = 1 OR s.x IS NOT NULL OR q.x IS NOT NULL THEN 'recovered' ELSE 'unresolved' END AS decision, CASE WHEN f.n IS NOT NULL THEN 'content' WHEN s.x IS NOT NULL THEN 'registry' WHEN q.x IS NOT NULL THEN 'synonym' END AS step,
CASE WHEN id % 97 = 0 OR f.n > 1 THEN NULL WHEN f.n = 1 THEN f.lo WHEN s.x IS NOT NULL THEN s.x ELSE q.x END AS recovered_name FROM o LEFT JOIN f ON f.k = a LEFT JOIN s ON s.k = b LEFT JOIN q ON q.k = c""")
def recovered_identities(spark, sf):
    """Orders read as orphans: by the brands under their first key, by a registry, then by the shortest of several synonyms."""
    orphans = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 50 AS a", "o_orderkey % 700 AS b", "o_custkey AS c")
    content = table(spark, sf, "part").where("p_partkey % 3 = 0 AND p_partkey % 40 < 20").selectExpr("p_partkey % 40 AS key", "p_brand AS name")
    registry = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name")
    synonyms = table(spark, sf, "customer").selectExpr("c_nationkey + 100 * (c_custkey % 3) AS key", "c_name AS name")
    steps = [recovery.Step("content", "a", content), recovery.Step("registry", "b", registry), recovery.Step("synonym", "c", synonyms, "least")]
    return recovery.recovered(orphans, "id", steps, F.col("id") % 97 == 0).select("id", "decision", "step", "recovered_name")


_SOURCES = "['foodb', 'usda_foundation', 'ciqual', 'cnf']"
_AUTHORITIES = f"""WITH c AS (SELECT p_partkey AS id, {_SOURCES}[1 + p_partkey % 4] AS source_key, ['FAT', 'PROT', 'nan', 'QQ', ''][1 + p_size % 5] AS t, CASE WHEN p_partkey % 3 = 0 THEN 'Nutrient number ' || (200 + p_size) || '.5' ELSE 'none' END AS d, CASE WHEN p_partkey % 5 = 0 THEN 'chebi:' || p_partkey ELSE '' END AS chebi,
CASE WHEN p_partkey % 7 = 0 THEN 'abcdefghijklmn-opqrstuvwx-y' ELSE 'bad' END AS ik, CASE WHEN p_partkey % 11 = 0 THEN 'E' || p_size END AS eu, ['Fat label', 'x by difference', 'retinol equivalent', 'plain'][1 + p_size % 4] AS name FROM part),
v AS (SELECT *, CASE WHEN name = 'Fat label' THEN 'label_expression' WHEN name = 'x by difference' THEN 'calculated_by_difference' WHEN name = 'retinol equivalent' THEN 'biological_equivalent' ELSE 'standard_expression' END AS var FROM c)"""


@query(_AUTHORITIES + """ SELECT id, CASE WHEN t IN ('FAT', 'PROT') THEN 'INFOODS' WHEN source_key IN ('usda_foundation', 'cnf') AND d <> 'none' THEN 'USDA_CNF_NUTRIENT_NBR' WHEN chebi <> '' THEN 'CHEBI' WHEN ik <> 'bad' THEN 'INCHIKEY' WHEN eu IS NOT NULL THEN 'EUROFIR_EFSA' ELSE 'SOURCE' END AS namespace,
CASE WHEN t IN ('FAT', 'PROT') THEN CASE t WHEN 'PROT' THEN 'PROCNT' ELSE t END WHEN source_key IN ('usda_foundation', 'cnf') AND d <> 'none' THEN split_part(d, ' ', 3) WHEN chebi <> '' THEN split_part(chebi, ':', 2) WHEN ik <> 'bad' THEN upper(ik) WHEN eu IS NOT NULL THEN eu ELSE source_key || ':' || id END AS authority_id,
CASE WHEN t IN ('FAT', 'PROT') OR source_key IN ('usda_foundation', 'cnf') AND d <> 'none' THEN var WHEN chebi <> '' OR ik <> 'bad' THEN 'chemical_identity' ELSE var END AS variant FROM v""")
def authority_keys(spark, sf):
    pick = lambda xs, by: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + {by} AS int))"
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", f"{pick(['foodb', 'usda_foundation', 'ciqual', 'cnf'], 'p_partkey % 4')} AS source_key", "p_partkey AS source_component_id", f"{pick(['FAT', 'PROT', 'nan', 'QQ', ''], 'p_size % 5')} AS infoods_tag",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('Nutrient number ', 200 + p_size, '.5') ELSE 'none' END AS source_definition", "CASE WHEN p_partkey % 5 = 0 THEN concat('chebi:', p_partkey) ELSE '' END AS chebi_id", "CASE WHEN p_partkey % 7 = 0 THEN 'abcdefghijklmn-opqrstuvwx-y' ELSE 'bad' END AS inchikey",
        "CASE WHEN p_partkey % 11 = 0 THEN concat('E', p_size) END AS eurofir_component_id", f"{pick(['Fat label', 'x by difference', 'retinol equivalent', 'plain'], 'p_size % 4')} AS original_name")
    tags = spark.createDataFrame([("fat",), ("PROCNT",)], "tag string")
    return recovery.authority_keys(parts, tags).select("id", "namespace", "authority_id", "variant")


@query("""WITH t AS (SELECT * FROM (VALUES ('FAT'), ('FE'), ('MG')) x(tag)), c AS (SELECT p_partkey AS id, ['Total Fat', 'Iron', 'other', 'Magnesium!'][1 + p_partkey % 4] AS name, ['', 'FAT', 'FE', 'ZZ'][1 + p_size % 4] AS own, p_partkey % 6 AS chem FROM part),
j AS (SELECT *, CASE name WHEN 'Total Fat' THEN 'FAT' WHEN 'Iron' THEN 'FE' WHEN 'Magnesium!' THEN 'MG' END AS by_name, CASE chem WHEN 1 THEN 'MG' END AS by_chem, own IN (SELECT tag FROM t) AS known FROM c)
SELECT CASE WHEN by_chem IS NOT NULL AND NOT known THEN by_chem WHEN by_name IS NOT NULL AND (NOT known OR own = by_name) THEN by_name ELSE own END AS harmonised_tag, CASE WHEN by_chem IS NOT NULL AND NOT known THEN 'chemical_identity_to_tag' WHEN by_name IS NOT NULL AND (NOT known OR own = by_name) THEN 'reviewed_exact_label_to_tag' ELSE 'own_identifier_or_source_specific' END AS identity_rule,
CASE WHEN by_name IS NOT NULL AND known AND own <> by_name THEN by_name || ' / ' || own END AS clash, count(*) AS n FROM j GROUP BY ALL""")
def harmonised_tags(spark, sf):
    """Labels and chemicals to tags, with the clashes between a label's tag and a component's own."""
    pick = lambda xs, by: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + {by} AS int))"
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{pick(['Total Fat', 'Iron', 'other', 'Magnesium!'], 'p_partkey % 4')} AS original_name", f"{pick(['', 'FAT', 'FE', 'ZZ'], 'p_size % 4')} AS infoods_tag", "p_partkey % 6 AS chebi_id")
    aliases = spark.createDataFrame([("total fat", "FAT"), ("iron", "FE"), ("magnesium", "MG"), ("other", "NOT_THERE")], "alias string, tag string")
    chemicals = spark.createDataFrame([("1", "MG"), ("2", "NOT_THERE")], "chemical string, tag string")
    out = recovery.crosswalked(parts, aliases, chemicals, spark.createDataFrame([("FAT",), ("FE",), ("MG",)], "tag string"))
    return out.groupBy("harmonised_tag", "identity_rule", "clash").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT p_size AS number, p_size || ' native' AS name FROM part WHERE p_size <= 30 GROUP BY 1), f AS (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS component, p_size AS number FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT component AS parent_component_id, number::VARCHAR AS number, name, count(*) AS facts FROM f JOIN n USING (number) GROUP BY ALL""")
def imported_components(spark, sf):
    """Facts under the component that their own number names, and the components made for that."""
    part = table(spark, sf, "part")
    native = part.where("p_size <= 30").select(F.col("p_size").alias("number")).distinct().withColumn("name", F.concat(F.col("number").cast("string"), F.lit(" native")))
    facts = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).selectExpr("l_orderkey", "l_linenumber", "l_partkey % 20 AS component_id", "p_size")
    return recovery.import_components(facts, native, "p_size")[1].select("parent_component_id", "number", "name", "facts")


@query("""WITH l AS (SELECT l_orderkey AS item, l_suppkey % 5 AS axis, l_discount > 0.08 AS rejected FROM lineitem), c AS (SELECT DISTINCT item, axis FROM l WHERE axis > 0), g AS (SELECT item, axis, bool_or(rejected) AS gone, count(*) AS n, count(*) FILTER (rejected) AS r FROM l GROUP BY ALL),
k AS (SELECT c.*, axis > 1 AS target, gone, n, r FROM c JOIN g USING (item, axis)) SELECT item, count(*) AS n_cells, count(*) FILTER (target) AS n_targets, count(*) FILTER (gone) AS n_lost, sum(n)::BIGINT AS records, sum(r)::BIGINT AS rejected_records, bool_or(target) AS scorable,
item IN (SELECT item FROM k WHERE target AND NOT gone) AS still_scorable FROM k GROUP BY item""")
def withdrawn_labels(spark, sf):
    """What orders could still be scored on if labels with a high discount were withdrawn; the SQL counts again without them."""
    labels = table(spark, sf, "lineitem").selectExpr("l_orderkey AS item", "l_suppkey % 5 AS axis", "l_discount > 0.08 AS rejected")
    cells = labels.select("item", "axis").where("axis > 0").distinct()
    return recovery.without_labels(cells, labels, "item", "axis", "rejected", F.col("axis") > 1).drop("n_lost_targets")


@query("""WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1500 AS shard FROM orders) SELECT lpad(shard::VARCHAR, 5, '0') || '.json.gz' AS path, count(*) AS records, count(*) AS recount, min(o_orderkey) AS first, max(o_orderkey) AS last, true AS same_digest FROM p GROUP BY shard""")
def sharded_records(spark, sf):
    """Orders as shards of 1500 JSON records; the manifest against the files' own digests, and their rows as they are read back."""
    path = new_path(spark, "shards")
    listed = pages.write_shards(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, F.col("o_orderkey"))
    files = artifacts(spark, path, "*.json.gz").select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("sha256").alias("_own"))
    rows = pages.read_pages(spark, path).withColumn("k", F.get_json_object("record", "$.o_orderkey").cast("long"))
    seen = rows.groupBy(F.format_string("%05d.json.gz", "page").alias("path")).agg(F.count(F.lit(1)).alias("recount"), F.min("k").alias("first"), F.max("k").alias("last"))
    return listed.join(files, "path").join(seen, "path").select("path", "records", "recount", "first", "last", (F.col("sha256") == F.col("_own")).alias("same_digest"))
