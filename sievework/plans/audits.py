"""Footnoted tables, candidate sources and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, literature
from ..sources import footnotes, readers, writers
from ..tables import materialize
from .registry import query, table

_FULL = "translate(cast(q AS string), '0123456789', '０１２３４５６７８９')"
_TOKEN = f"CASE q % 10 WHEN 0 THEN 'Tr' WHEN 1 THEN concat('(', q, ')') WHEN 2 THEN NULL WHEN 3 THEN '0' WHEN 4 THEN '-' WHEN 5 THEN concat(q, '†') WHEN 6 THEN '*' WHEN 7 THEN 'x?' WHEN 8 THEN '(Tr)' ELSE {_FULL} END"
_NOTE = "CASE p % 6 WHEN 0 THEN 'ビタミンD活性代謝物を含む' WHEN 1 THEN '鉄： Trであるが10001と00002' WHEN 2 THEN '†は規定法による測定値 推計' WHEN 3 THEN '米国' END"
#: Columns of the made tables: (table, line number, column, tag, unit).
_TAGS = [("main", 1, 23, "NA", ""), ("main", 2, 28, "FE", ""), ("main", 3, 43, "VITD", ""), ("main", 4, 48, "VITK", ""), ("main", 5, 60, "NACL_EQ", ""), ("main", 6, 4, "REFUSE", ""), ("organic_acids", 2, 4, "FE", "mg/100 g"), ("organic_acids", 7, 5, "CITAC", "g/100 g"), ("fatty_acids_relative", 3, 4, "FASATF", "g/100 g")]
_RULES = [footnotes.Footnote("†は規定法による測定値", "verified", marker="†"), *footnotes.NOTES[1:]]


#: Parts in an edition, whose tables are a book each.
_EDITION = 4000


def _noted(spark, sf) -> footnotes.Noted:
    """Three workbooks of the parts of each edition: the main table lacks every seventh part, and the others have half or a third of them."""
    parts = table(spark, sf, "part").selectExpr("p_partkey AS p", "p_name AS name", f"{_NOTE} AS note", f"p_partkey DIV {_EDITION} AS edition")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("k")).agg(F.max("l_quantity").cast("int").alias("q"))
    cells = None
    for t, where, first, last, shown in (("main", "p % 7 > 0", 12, 61, _TOKEN), ("organic_acids", "p % 2 = 0", 6, 6, _TOKEN.replace(_FULL, "CASE p % 4 WHEN 0 THEN cast(q AS string) ELSE cast(q + 1 AS string) END").replace("'0'", "'0.0'")), ("fatty_acids_relative", "p % 3 = 0", 6, 6, _TOKEN)):
        rows = parts.where(where).withColumn("row", F.expr(f"cast({first} - 1 + row_number() OVER (PARTITION BY edition ORDER BY p) AS int)"))
        wide = rows.select("edition", "row", F.posexplode(F.array(F.expr("cast(p % 18 AS string)"), F.expr("lpad(cast(p % 100000 AS string), 5, '0')"), F.lit(None), F.col("name"))).alias("col", "text"))
        wide = wide.unionByName(rows.selectExpr("edition", "row", f"{last} AS col", "note AS text"))
        own = spark.createDataFrame([(k, col) for name, k, col, _, _ in _TAGS if name == t], "k int, col int")
        wide = wide.unionByName(rows.join(lines, "p").join(F.broadcast(own), "k").selectExpr("edition", "row", "col", f"{shown} AS text"))
        tag_row = first - 1 if t == "main" else first - 2
        heads = [(tag_row, col, tag) for name, _, col, tag, _ in _TAGS if name == t] + [(tag_row + 1, col, u) for name, _, col, _, u in _TAGS if name == t and u] + [(3, col, f"name of {tag}") for name, _, col, tag, _ in _TAGS if name == t] + [(3, last, "notes")]
        heads = F.broadcast(spark.createDataFrame(heads, "row int, col int, text string"))
        wide = wide.unionByName(rows.select("edition").distinct().join(heads)).selectExpr(f"concat('{t}-', edition) AS path", "'whole' AS sheet", "row", "col", "text")
        cells = wide if cells is None else cells.unionByName(wide)
    books = materialize(writers.workbooks(cells), "books")
    back = readers.cells_of(books).withColumns({"table": F.regexp_extract("path", "^(.*)-[^-]*$", 1), "edition": F.regexp_extract("path", "-([^-]*)$", 1)})
    return footnotes.read(materialize(back, "cells"), [t for t in footnotes.TABLES if t.name in ("main", "organic_acids", "fatty_acids_relative")], _RULES)


_NOTED = f"""WITH v AS (SELECT l_partkey AS p, l_linenumber AS k, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL), c(t, k, tag, g, basis, m) AS (VALUES ('main', 1, 'NA', 1e-3, '100g_edible_food', 'mass_per_100g_edible_food'), ('main', 2, 'FE', 1e-3, '100g_edible_food', 'mass_per_100g_edible_food'), ('main', 3, 'VITD', 1e-6, '100g_edible_food', 'mass_per_100g_edible_food'),
('main', 4, 'VITK', NULL, '100g_edible_food', 'mixed_mass_equivalent_definition_hold'), ('main', 5, 'NACL_EQ', NULL, '100g_edible_food', 'equivalent_expression_excluded'), ('main', 6, 'REFUSE', NULL, '100g_edible_food', 'refuse_fraction_metadata'), ('organic_acids', 2, 'FE', 1e-3, '100g_edible_food', 'mass_per_100g_edible_food'), ('organic_acids', 7, 'CITAC', 1, '100g_edible_food', 'mass_per_100g_edible_food'), ('fatty_acids_relative', 3, 'FASATF', NULL, '100g_total_fatty_acids', 'relative_denominator_excluded')),
f AS (SELECT t, p_partkey AS p, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS food_id FROM part, (VALUES ('main'), ('organic_acids'), ('fatty_acids_relative')) x(t) WHERE CASE t WHEN 'main' THEN p_partkey % 7 > 0 WHEN 'organic_acids' THEN p_partkey % 2 = 0 ELSE p_partkey % 3 = 0 END),
r AS (SELECT f.t AS "table", f.p, food_id, c.tag, c.g::DOUBLE AS g, 'mext:' || c.tag || ':' || basis AS component_key, q % 10 AS d, CASE WHEN f.t = 'organic_acids' AND f.p % 4 > 0 AND q % 10 = 9 THEN q + 1 ELSE q END AS q,
  CASE WHEN c.tag = 'VITD' AND f.p % 6 = 0 THEN 'food_specific_vitamin_D_active_metabolite_expression_hold' ELSE m END AS modality, CASE WHEN c.tag = 'VITD' AND f.p % 6 = 0 THEN 'active_metabolites' WHEN c.tag = 'FE' AND f.p % 6 = 1 THEN 'explicit_trace' ELSE '' END AS hold
  FROM f JOIN c ON c.t = f.t LEFT JOIN v ON v.p = f.p AND v.k = c.k),
s AS (SELECT *, CASE WHEN hold = 'explicit_trace' THEN 'trace_with_numeric_display_not_exact_point_label' WHEN d IS NULL OR d = 2 THEN 'missing_blank' WHEN d = 0 THEN 'trace_interval' WHEN d = 1 THEN 'estimated_positive' WHEN d = 3 THEN 'reported_zero_censored_or_nondetect' WHEN d = 4 THEN 'unmeasured_dash' WHEN d = 5 AND p % 6 = 2 THEN 'reported_positive_origin_unresolved' WHEN d IN (5, 7) THEN 'unparsed_requires_review' WHEN d = 6 THEN 'footnote_only_value_unresolved' WHEN d = 8 THEN 'estimated_trace' ELSE 'reported_positive_origin_unresolved' END AS value_status,
  CASE WHEN d = 3 THEN 0 WHEN d IN (1, 9) OR d = 5 AND p % 6 = 2 THEN q END::DOUBLE AS x, CASE d WHEN 3 THEN CASE WHEN "table" = 'organic_acids' THEN '0.0' ELSE '0' END WHEN 1 THEN '(' || q || ')' WHEN 0 THEN 'Tr' WHEN 4 THEN '-' WHEN 5 THEN q || '†' WHEN 6 THEN '*' WHEN 7 THEN 'x?' WHEN 8 THEN '(Tr)' WHEN 9 THEN q::VARCHAR ELSE '' END AS token FROM r),
k AS (SELECT food_id, component_key, count(*) AS n_tables, count(DISTINCT x) AS numbers, count(DISTINCT value_status) AS statuses, count(DISTINCT token) AS tokens FROM s GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT s.*, coalesce(numbers > 1 OR statuses > 1, false) AS conflict, p % 7 > 0 AS in_main, CASE WHEN modality = 'mass_per_100g_edible_food' THEN x * g END AS mass FROM s LEFT JOIN k USING (food_id, component_key))"""


@query(_NOTED + """ SELECT "table", component_key, modality, value_status, hold, conflict, in_main, coalesce(value_status = 'reported_positive_origin_unresolved' AND mass > 0 AND mass <= 100, false) AS candidate, count(*) AS n, round(sum(mass), 6) AS mass FROM w GROUP BY ALL""")
def footnoted_cells(spark, sf):
    values, _ = footnotes.audited(_noted(spark, sf))
    return values.groupBy("table", "component_key", "modality", "value_status", "hold", "conflict", "in_main", "candidate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("g_per_100g"), 6).alias("mass"))


@query(_NOTED + """ SELECT component_key, CASE WHEN numbers > 1 THEN 'different_numeric_values' WHEN statuses > 1 THEN 'different_origin_or_missingness_notation' WHEN tokens > 1 THEN 'formatting_only_difference' ELSE 'identical_repeated_record' END AS review_type, count(*) AS n FROM k GROUP BY ALL""")
def repeated_cell_reviews(spark, sf):
    return footnotes.repeated(_noted(spark, sf).values).groupBy("component_key", "review_type").agg(F.count(F.lit(1)).alias("n"))


@query(_NOTED + """ SELECT kind, "table", count(*) AS n, count(DISTINCT food_id) AS foods FROM (SELECT unnest(list_filter([CASE WHEN value_status IN ('unparsed_requires_review', 'invalid_negative') THEN 'unparsed_or_negative' END, CASE WHEN mass < 0 OR mass > 100 THEN 'impossible_mass' END, CASE WHEN hold <> '' THEN 'definition_hold' END, CASE WHEN value_status = 'footnote_only_value_unresolved' THEN 'footnote_only' END, CASE WHEN conflict THEN 'tables_disagree' END], lambda z: z IS NOT NULL)) AS kind, "table", food_id FROM w
UNION ALL SELECT 'food_of_a_subtable_only', t, food_id FROM f WHERE t <> 'main' AND p % 7 = 0) GROUP BY ALL""")
def footnote_queue(spark, sf):
    values, held = footnotes.audited(_noted(spark, sf))
    return footnotes.open_items(values, held).groupBy("kind", "table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("food_id").alias("foods"))


@query(_NOTED + """, u AS (SELECT food_id, component_key, min(mass) AS mass FROM w WHERE value_status = 'reported_positive_origin_unresolved' AND mass > 0 AND mass <= 100 AND NOT conflict AND in_main GROUP BY ALL), a AS (SELECT component_key, count(*) AS foods FROM u GROUP BY 1)
SELECT component_key, foods, s_suppkey AS concept_id, CASE WHEN s_suppkey IS NULL THEN 'requires_source_specific_identity_review' ELSE 'same_literal_code_only_definition_and_method_review_required' END AS review_status FROM a LEFT JOIN supplier ON split_part(component_key, ':', 2) = ['NA', 'FE', 'MG', 'ZN'][1 + s_suppkey % 4]""")
def footnoted_axis_proposals(spark, sf):
    """Components with candidates beside a registry's of the same tag."""
    values, _ = footnotes.audited(_noted(spark, sf))
    axes = footnotes.candidates(values).groupBy("component_key").agg(F.count(F.lit(1)).alias("foods"))
    registry = table(spark, sf, "supplier").selectExpr("s_suppkey AS concept_id", "element_at(array('NA', 'FE', 'MG', 'ZN'), 1 + cast(s_suppkey % 4 AS int)) AS tag")
    return audits.tag_candidates(axes, registry).select("component_key", "foods", "concept_id", "review_status")


_CODES = "element_at(array('ENERCJ', 'FE', 'VITE', 'PROT', 'FAX', 'CA', 'NACL'), {})"
_ORIGINS = "CASE l_suppkey % 3 WHEN 0 THEN 'Analyse' WHEN 1 THEN 'Rezeptberechnung' ELSE 'Aggregation' END"
_AUDIT = f"""WITH c AS (SELECT l_partkey AS food_id, {_CODES.replace('element_at(array(', 'list_extract([').replace('), {}', '], {}').format('l_linenumber')} AS code, max(l_quantity)::INT AS q, min({_ORIGINS}) AS origin, min(l_suppkey) AS ref FROM lineitem GROUP BY ALL),
m AS (SELECT *, CASE code WHEN 'ENERCJ' THEN 'energy_excluded' WHEN 'NACL' THEN 'equivalent_expression_excluded' WHEN 'VITE' THEN 'duplicate_alpha_tocopherol_alias_hold' WHEN 'FAX' THEN 'unspecified_other_fatty_acids_hold' ELSE 'mass_expression_candidate' END AS e, q % 7 AS d, q * CASE WHEN code IN ('FE', 'CA') THEN 0.001 ELSE 4 END::DOUBLE AS mass FROM c),
x AS (SELECT *, e = 'mass_expression_candidate' AND origin = 'Analyse' AND d NOT IN (0, 1) AND mass <= 100 AS candidate FROM m)"""


def _source(spark, sf) -> audits.CandidateAudit:
    own = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("food_id"), F.expr(_CODES.format("l_linenumber")).alias("code"))
    rows = own.agg(F.max("l_quantity").cast("int").alias("q"), F.min(F.expr(_ORIGINS)).alias("origin"), F.min("l_suppkey").alias("_r"))
    cells = rows.selectExpr("food_id", "code", "CASE q % 7 WHEN 0 THEN 'Spuren' WHEN 1 THEN concat('<', q) ELSE cast(q * CASE WHEN code IN ('FE', 'CA') THEN 1 ELSE 4 END AS string) END AS raw_value", "origin", "CASE WHEN _r % 2 = 0 THEN '-' ELSE concat('r', _r) END AS reference")
    components = spark.createDataFrame([("ENERCJ", "kJ"), ("FE", "mg"), ("VITE", "mg"), ("PROT", "g"), ("FAX", "g"), ("CA", "mg"), ("NACL", "g")], "code string, unit string")
    return audits.candidate_audit(cells, components, table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_name AS name"))


@query(_AUDIT + """ SELECT k.code, k.e AS expression_status, coalesce(n, 0) AS positive_foods, least, most, coalesce(w, 0) AS without_reference FROM (VALUES ('ENERCJ', 'energy_excluded'), ('FE', 'mass_expression_candidate'), ('VITE', 'duplicate_alpha_tocopherol_alias_hold'), ('PROT', 'mass_expression_candidate'), ('FAX', 'unspecified_other_fatty_acids_hold'), ('CA', 'mass_expression_candidate'), ('NACL', 'equivalent_expression_excluded')) k(code, e)
LEFT JOIN (SELECT code, count(DISTINCT food_id) AS n, min(mass) AS least, max(mass) AS most, count(*) FILTER (ref % 2 = 0) AS w FROM x WHERE candidate GROUP BY 1) USING (code)""")
def candidate_components(spark, sf):
    return _source(spark, sf).components.select("code", "expression_status", "positive_foods", "least", "most", "without_reference")


@query(_AUDIT + """ SELECT food_id, coalesce(a, 0) AS analysed_cells, coalesce(r, 0) AS recipe_cells, coalesce(i, 0) AS concepts FROM (SELECT p_partkey AS food_id, p_name FROM part) LEFT JOIN (SELECT food_id, count(*) FILTER (candidate) AS a, count(*) FILTER (origin = 'Rezeptberechnung') AS r FROM x GROUP BY 1) USING (food_id)
LEFT JOIN (SELECT p_name, count(*) AS i FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) USING (p_name)""")
def candidate_foods(spark, sf):
    """Foods of a candidate source with their cells, and how many known foods have their name."""
    foods = _source(spark, sf).foods
    known = table(spark, sf, "part").where("p_partkey % 2 = 0").selectExpr("p_partkey AS concept_id", "p_name AS name", "'train' AS partition")
    same = audits.name_candidates(foods.select("food_id", "name"), known.groupBy("name").agg(F.count(F.lit(1)).alias("n"))).groupBy("food_id").agg(F.sum("n").alias("concepts"))
    return foods.join(same, "food_id", "left").select("food_id", "analysed_cells", "recipe_cells", F.coalesce("concepts", F.lit(0)).alias("concepts"))


_CITES = "SELECT o_custkey AS citing, 1 + (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM customer) AS cited FROM orders"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_CITES}) WHERE citing <> cited), s AS (SELECT c_custkey AS seed FROM customer WHERE c_custkey % 100 = 0),
b(seed, work, hop) AS (SELECT seed, seed, 0 FROM s UNION SELECT b.seed, e.cited, hop + 1 FROM b JOIN e ON e.citing = b.work WHERE hop < 2), f(seed, work, hop) AS (SELECT seed, seed, 0 FROM s UNION SELECT f.seed, e.citing, hop + 1 FROM f JOIN e ON e.cited = f.work WHERE hop < 2),
a AS (SELECT seed, work, 'backward' AS direction, min(hop) AS hop FROM b GROUP BY ALL UNION ALL SELECT seed, work, 'forward', min(hop) FROM f GROUP BY ALL) SELECT * FROM a WHERE hop > 0""")
def citation_walks(spark, sf):
    """Two hops both ways from every hundredth customer, orders as citations between customers."""
    customers = table(spark, sf, "customer")
    cites = spark.sql(_CITES.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), customer=customers, orders=table(spark, sf, "orders"))
    return literature.citation_walk(customers.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("work")), cites, 2)


@query(f"""WITH e AS (SELECT DISTINCT * FROM ({_CITES}) WHERE citing <> cited), k AS (SELECT c_custkey AS work FROM customer WHERE c_custkey % 10 > 0), w AS (SELECT citing AS seed, 'backward' AS direction, cited AS t FROM e UNION ALL SELECT cited, 'forward', citing FROM e),
g AS (SELECT seed, direction, count(*) AS expected, count(*) FILTER (t IN (SELECT work FROM k)) AS retrieved FROM w GROUP BY ALL)
SELECT c_custkey AS seed, d.direction, coalesce(expected, 0) AS expected, coalesce(retrieved, 0) AS retrieved, CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN coalesce(expected = retrieved, true) THEN 'completed' ELSE 'incomplete' END AS status FROM (SELECT c_custkey FROM customer WHERE c_custkey % 25 = 0) CROSS JOIN (VALUES ('backward'), ('forward')) d(direction) LEFT JOIN g ON seed = c_custkey AND g.direction = d.direction""")
def citation_log(spark, sf):
    """Whether all works one citation away are on record; a tenth of the customers aren't."""
    customers = table(spark, sf, "customer")
    cites = spark.sql(_CITES.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), customer=customers, orders=table(spark, sf, "orders"))
    seeds = customers.where("c_custkey % 25 = 0").select(F.col("c_custkey").alias("work"))
    return literature.walk_log(literature.citation_walk(seeds, cites, 1), seeds, cites, customers.where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("work")))


_KEYS = ["CASE WHEN o_orderkey % 3 = 0 THEN concat('10.', o_custkey) END AS doi", "CASE WHEN o_orderkey % 5 = 0 THEN concat('p', cast(floor(o_custkey / 4) AS bigint)) END AS pmid", "concat('title ', o_custkey, ' ', o_orderkey % 4) AS title"]


@query(f"""WITH RECURSIVE r AS (SELECT o_orderkey AS id, {', '.join(_KEYS)} FROM orders), k AS (SELECT id, 'd' || doi AS k FROM r WHERE doi IS NOT NULL UNION ALL SELECT id, 'p' || pmid FROM r WHERE pmid IS NOT NULL UNION ALL SELECT id, 't' || title FROM r),
m AS (SELECT k, min(id) AS hub FROM k GROUP BY 1), h AS (SELECT DISTINCT id AS a, hub AS b FROM k JOIN m USING (k) WHERE id <> hub), e AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
g(id, reach) AS (SELECT id, id FROM r UNION SELECT g.id, e.b FROM g JOIN e ON g.reach = e.a), l AS (SELECT id, min(reach) AS label FROM g GROUP BY 1), n AS (SELECT label, count(*) AS n_records, min(doi) AS d, min(pmid) AS p, min(title) AS t FROM l JOIN r USING (id) GROUP BY 1)
SELECT id, n_records, coalesce('doi:' || d, 'pmid:' || p, 'title:' || sha256(t)[1:16]) AS identity FROM l JOIN n USING (label)""")
def record_identities(spark, sf):
    """Records that share a doi, a pmid or a title, directly or through others, under one identity."""
    records = table(spark, sf, "orders").selectExpr("o_orderkey AS id", *_KEYS)
    return literature.same_records(records, "id", [("doi", "doi"), ("pmid", "pmid"), ("title", "title")]).select("id", "n_records", "identity")
