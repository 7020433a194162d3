"""Admission, bibliography, chemistry of labels, links to validation and model tables, case by case."""

import itertools
import math
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import catalogue
from sievework.operators import evaluate, evidence, features, identity, resolve

RECORD = {
    "measurement_id": "m", "source_key": "cnf", "main_value_eligible": "False", "strict_validation_eligible": "False", "normalized_value_g_per_100g": 1.0, "value_status": "observed", "conversion_status": "converted_exact_mass",
    "measurement_modality": "mass_fraction_fresh_weight", "is_censored": "False", "is_range_only": "False", "source_reference": "", "method_expression": "", "analytical_method": None, "lineage_source_key": "cnf", "independent_evidence": "False", "exclusion_reason": "insufficient_value_level_quality",
}
SCHEMA = ", ".join(f"{c} {'double' if isinstance(v, float) else 'string'}" for c, v in RECORD.items())


def records(spark, *changes):
    return spark.createDataFrame([tuple((RECORD | {"measurement_id": str(i)} | c).values()) for i, c in enumerate(changes)], SCHEMA)


def test_trusted_records_are_admitted_unless_held(spark):
    df = records(
        spark, {}, {"source_key": "foodb", "source_reference": "USDA"}, {"source_key": "other"}, {"normalized_value_g_per_100g": 0.0, "value_status": "explicit_zero"}, {"value_status": "trace"}, {"is_censored": "TRUE"}, {"exclusion_reason": "unit_unknown"},
        {"source_reference": "Assumed zero"}, {"source_reference": "Imputed from beef"}, {"source_reference": "Imputed from beef", "method_expression": "Calculated"}, {"lineage_source_key": "frida"}, {"source_key": "foodb", "source_reference": "A paper on labels"}, {"normalized_value_g_per_100g": None},
    )
    got = {int(r.measurement_id): r for r in evidence.admit(df).collect()}
    assert [i for i in sorted(got) if got[i].main_value_eligible] == [0, 3, 9, 11]
    assert got[0].exclusion_reason == "" and got[0].validation_reference_eligible and not got[0].strict_validation_eligible
    assert got[1].exclusion_reason == evidence.COPIED and got[1].source_independence_status.startswith("copied")
    assert got[2].exclusion_reason == RECORD["exclusion_reason"] and got[2].source_policy_decision == "unchanged_other_source"
    assert got[9].source_value_expression == "definition_derived_reference"
    with pytest.raises(ValueError):
        evidence.admit(evidence.admit(df))
    with pytest.raises(ValueError):
        evidence.admit(df, "another")


def test_internal_citations(spark):
    judged = evidence.admit(records(spark, {"source_key": "foodb", "source_reference": "FRIDA"}, {"value_status": "trace"}))
    assert [r.main_value_eligible for r in evidence.keep_internal_citations(judged).orderBy("measurement_id").collect()] == [True, False]
    with pytest.raises(Exception, match="internal citation"):
        evidence.keep_internal_citations(judged.withColumn("normalized_value_g_per_100g", F.lit(101.0))).collect()


def test_component_expressions(spark):
    rows = [("vita", "Vitamin A", None), ("RETOL", "Retinol", ""), ("X", "Niacin from tryptophan", None), ("Y", "Lysine", "mg per gram of nitrogen"), (None, None, None)]
    df = spark.createDataFrame(rows, "tag string, name string, told string")
    assert [r[0] for r in df.select(evidence.expression_hold(F.col("tag"), F.col("name"), F.col("told"))).collect()] == [evidence.ACTIVITY, None, evidence.ACTIVITY, evidence.NITROGEN, None]


def test_statements_and_references(spark):
    df = spark.createDataFrame([("Analysed", "Recipe"), ("Analysed", " analysed"), ("Analysed", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(evidence.conflicting_statements(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]
    df = spark.createDataFrame([("2201, 2187",), ("007.0,E5,, 0",), (None,)], "r string")
    assert [r[0] for r in df.select(evidence.references(F.col("r"))).collect()] == [["2201", "2187"], ["7", "E5", "0"], []]


def test_bibliography_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "1655"), (2, "1655"), (3, "9"), (4, None), (5, ""), (6, "5,5")], "id int, refs string")
    catalogue = spark.createDataFrame([("1655", "Zero", "A"), ("5", "A calculated table", "B"), ("9", "", "E")], "reference_id string, title string, reference_type string")
    got = evidence.bibliography(df, "refs", catalogue, {"zero": ("1655",)}, {"estimated": ("E",)}, [("calcul", "estimated")]).orderBy("id").collect()
    assert [r.evidence_issues for r in got] == ["zero", "zero", "unresolved_reference;estimated", "unresolved_reference", "unresolved_reference", "estimated"]
    assert got[5].reference_ids == "5;5" and all(r.evidence_rejected for r in got)


def test_provenance(spark):
    p = spark.createDataFrame([(1, "m1;m2"), (2, "m1"), (3, "m1;m9"), (4, None), (5, "m1;m1")], "p int, ids string")
    m = spark.createDataFrame([("m1", True), ("m2", False)], "m string, ok boolean")
    assert [r.provenance for r in evidence.provenance(p, ["p"], "ids", m, "m", F.col("ok")).orderBy("p").collect()] == ["mixed", "strict", "missing", "missing", "strict"]


def test_frozen_partitions_and_blocks(spark):
    items = spark.createDataFrame([(1, "f1"), (2, "f1"), (3, "f2"), (4, "f3"), (5, "f3")], "i int, f string")
    locked = spark.createDataFrame([(1, "family_holdout"), (4, "source_holdout")], "i int, panel string")
    none = items.where("false")
    inside, out = evidence.frozen_partitions(items, "i", "f", items, locked, none, none, F.lit(False), F.lit(None).cast("boolean"))
    assert {r.i: (r.partition, r.overlap) for r in inside.collect()} == {1: ("validation", False), 3: ("train", False), 4: ("validation", False), 5: ("train", True)}
    assert [(r.i, r.reason) for r in out.collect()] == [(2, "frozen_family_or_lineage_block_or_food_exclusion")]
    with pytest.raises(ValueError):
        evidence.frozen_partitions(items, "i", "f", items, locked.withColumn("i", F.lit(99)), none, none, F.lit(False), F.lit(False))
    parts = spark.createDataFrame([(1, "train", "a"), (2, "train", "b"), (3, "train", "b"), (4, "validation", "v"), (5, "train", None)], "i int, p string, f string")
    lineages = spark.createDataFrame([(1, "x"), (2, "x"), (4, ""), (5, "")], "i int, l string")
    assert {r.i: r.block for r in evidence.transfer_blocks(parts, "i", "p", "f", lineages, "l").collect()} == {1: 1, 2: 1, 3: 1, 5: 5}
    with pytest.raises(ValueError):
        evidence.transfer_blocks(parts, "i", "p", "f", lineages.replace("", "x", "l"), "l")


@pytest.mark.parametrize(
    ("a", "b", "accepted", "reason"),
    [
        ("20:5 n-3", "EPA 20:5 n-3", True, "matching_explicit_structural_signature"), ("18:2 n-6", "18:3 n-3", False, "different_explicit_structural_or_vitamer_signature"), ("Vitamin B6", "Vitamin B12", False, "different_explicit_structural_or_vitamer_signature"),
        ("alpha tocopherol", "beta tocopherol", False, "different_explicit_chemical_form"), ("Tocopherol", "alpha tocopherol", False, "under_or_over_specified_chemical_form"), ("Carbohydrate, total", "Carbohydrate, by difference", False, "different_calculated_or_nutritional_expression"),
        ("16:1 cis", "16:1 trans", False, "different_explicit_chemical_form"), ("18:1 c", "18:1 t", False, "different_explicit_fatty_acid_isomer_state"), ("18:1 c", "18:1", False, "source_is_more_specific_fatty_acid_isomer"),
        ("Pyridoxal", "Pyridoxamine", False, "different_explicit_vitamer_chemical_form"), ("Cyanidin glucoside", "Cyanidin galactoside", False, "different_glycoside_or_acylated_form"), ("Cyanidin 3-O-glucoside", "Delphinidin 3-O-glucoside", False, "different_glycoside_aglycone"),
        ("3,4-dicaffeoyl", "3,5-dicaffeoyl", False, "different_explicit_positional_isomer"), ("o-coumaric acid", "p-coumaric acid", False, "different_explicit_small_molecule_position"), ("Iron", "Zinc", False, "semantic_similarity_without_identity_bearing_name_evidence"),
    ],
)
def test_labels_that_differ_in_chemistry(spark, a, b, accepted, reason):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    verdict = identity.identity_verdict(F.col("a"), F.col("b"), F.lit(False), F.lit(0.9), F.lit(0.5), F.lit(0.1))
    assert tuple(df.select(verdict.alias("v")).select("v.*").first()) == (accepted, reason)


def test_labels_of_a_table_by_plain_sets(spark, sf_dir):
    from sievework.plans.evidence import label_identity

    rows = label_identity(spark, sf_dir).collect()
    assert len(rows) > 500 and len({r["reason"] for r in rows}) > 8

    def refused(a, b):
        for aspect, relations, reason in identity.REASONS:
            x, y = set(a[aspect]), set(b[aspect])
            how = "same" if x == y else "first" if not y else "second" if not x else "overlaps" if x & y else "differs"
            if how in relations:
                return reason

    for r in rows:
        want = refused(identity.reading(r["a"]), identity.reading(r["b"]))
        assert r["accepted"] == (want is None) and (want is None or r["reason"] == want)


def test_labels_are_read_token_by_token():
    said = identity.reading("(9Z)-Octadecenoic acid 18:1 n-9, cis/trans unspecified")
    assert said["signature"] == ["chain 18:1:9"] and said["locant"] == ["9z"] and said["state"] == [] and said["form"] == []
    assert identity.reading("ω-3 (20:5ω3)")["signature"] == ["chain 20:5:3"] and identity.reading("Menaquinone-7")["signature"] == ["menaquinone 7"]
    assert identity.reading("vitamin b-12 or B 6")["signature"] == ["vitamin b12", "vitamin b6"] and identity.reading("[6]-Gingerol")["position"] == ["[6]-gingerol"]
    assert identity.reading("18:2 conjugated")["state"] == ["conjugated"] and identity.reading("cis")["state"] == [] and identity.reading(None)["numbers"] == []


def test_scores_decide_only_where_chemistry_allows(spark):
    df = spark.createDataFrame([("Iron", "Iron salt", 0.9), ("Iron", "Iron salt", 0.5), ("alpha carotene", "beta carotene", 1.0), (None, "", 0.9)], "a string, b string, s double")
    v = identity.identity_verdict(F.col("a"), F.col("b"), F.lit(None).cast("boolean"), F.col("s"), F.lit(0.8), F.lit(0.5))
    assert [r.v.accepted for r in df.select(v.alias("v")).collect()] == [True, False, False, True]
    names = spark.createDataFrame([("Selenium, Se (total)",), (None,), ("Tocotrienol, alpha",)], "n string")
    assert [r[0] for r in names.select(identity.name_variants(F.col("n"))).collect()] == [["se total selenium", "selenium", "selenium se", "selenium se total"], [], ["alpha tocotrienol", "tocotrienol", "tocotrienol alpha"]]


def test_signed_rank_matches_all_sign_patterns(spark):
    d = [-1.5, 2.0, -3.0, -4.5, 0.5, -6.0, -7.0, 1.0, -9.0, -2.5]
    ranks = {v: i + 1 for i, v in enumerate(sorted(map(abs, d)))}
    plus = sum(ranks[abs(v)] for v in d if v > 0)
    exact = sum(sum(r for r, s in zip(ranks.values(), signs) if s) <= plus for signs in itertools.product([0, 1], repeat=len(d))) / 2 ** len(d)
    rows = [("exact", v) for v in d] + [("few", -1.0)] * 9 + [("zero", 0.0)] * 12 + [("ties", v) for v in [0.0, 0.0, -1.0, -1.0, 1.0, -2.0, -3.0, -4.0, -5.0, -6.0, None]]
    got = {r.k: r for r in evaluate.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"], "d").collect()}
    assert got["exact"].p == pytest.approx(exact) and got["few"].p == 1 and got["zero"].p == 1
    # ranks 1.5 (zeros), 4 (three ones), 6 to 10: mean (110 - 6) / 4, variance (10*11*21 - 2*3*5 - 24/2) / 24
    z = (4 - 26) / ((2310 - 30 - 12) / 24) ** 0.5
    import math

    assert got["ties"].n == 10 and got["ties"].r_plus == 4 and got["ties"].p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)))


def test_similar_names(spark):
    rows = [(1, "roasted chicken leg"), (2, "roasted chicken legs"), (3, "beef"), (4, ""), (5, None), (6, "beef"), (7, "ox")]
    got = resolve.similar_names(spark.createDataFrame(rows, "i int, n string"), "i", "n").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (3, 6)]
    assert resolve.similar_names(spark.createDataFrame([], "i int, n string"), "i", "n").count() == 0


def test_features(spark):
    facts = spark.createDataFrame([(1, 1, 2.0, ""), (1, 1, 4.0, ""), (1, 2, 5.0, ""), (2, 3, 1.0, " Iron "), (2, 4, 1.0, ""), (2, 1, None, "")], "food int, src int, v double, own string")
    names = spark.createDataFrame([(1, "Vitamin C"), (2, "vitamin-c"), (3, None), (4, None)], "src int, name string")
    long = features.features(facts, "food", "src", "v", names, "n_", fallback="own")
    assert sorted(map(tuple, long.collect())) == [(1, "n_vitamin_c__id1", 3.0), (1, "n_vitamin_c__id2", 5.0), (2, "n_iron", 1.0)]
    assert features.wide(long, "food").columns == ["food", "n_iron", "n_vitamin_c__id1", "n_vitamin_c__id2"]
    with pytest.raises(ValueError):
        features.wide(long, "food", most=2)
    with pytest.raises(ValueError):
        features.features(facts, "food", "src", "v", names, "n_")
    t = features.targets(spark.createDataFrame([(50.0, 1.0), (None, float("nan"))], "a_pct double, b double"), ["a_pct", "b"]).collect()
    assert (t[0].a_pct, t[0].a_pct_mask, t[1].a_pct, t[1].b_mask) == (pytest.approx(0.4054651), True, 0.0, False)
    with pytest.raises(Exception, match="negative target"):
        features.targets(spark.createDataFrame([(-1.0,)], "a double"), ["a"]).collect()


@pytest.mark.parametrize("block", [10_000, 40])
def test_nearest_both_ways_against_all_pairs(spark, block):
    """Copies, ties, and vectors without a direction; some rows are on both sides."""
    pick = random.Random(3)
    rows = [(i, [float(pick.randint(-2, 2)) for _ in range(4)]) for i in range(130)] + [(200 + i, [1.0, 1.0, 0.0, 2.0]) for i in range(30)] + [(300, None), (301, [0.0] * 4), (302, [float("nan"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for few in (df, df.where("id % 3 = 0"), df.where("id > 1000"), df.where("id = 5")):
        targets = [r["id"] for r in few.collect()]
        known = {i: v for i, v in rows if v and any(v) and not any(map(math.isnan, v))}
        near = {(a, b): round(sum(map(operator.mul, known[a], known[b])) / math.hypot(*known[a]) / math.hypot(*known[b]), 9) + 0.0 for a in known for b in targets if b in known and a != b}
        own = {(a, b) for a in known for b in sorted((b for x, b in near if x == a), key=lambda b: (-near[a, b], b))[:3]}
        back = {(a, b) for b in targets if b in known for a in sorted((a for a, y in near if y == b), key=lambda a: (-near[a, b], a))[:20]}
        got = {(r["source"], r["target"]): (r["similarity"], r["from_source"], r["from_target"]) for r in resolve.nearest_both_ways(df, few, "id", "v", 3, 20, block).collect()}
        assert got == {p: (near[p], p in own, p in back) for p in own | back}


def test_all_vectors_are_searched_both_ways(spark, sf_dir):
    rows = catalogue.queries()["bidirectional_candidates"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = rows.agg(F.count_if("from_source"), F.count_if("from_target"), F.count_distinct("source"), F.count_distinct("target")).first()
    assert tuple(got) == (3 * n, 20 * n, n, n)


def test_pairs_of_a_name_by_tiles(spark):
    # Three items to a tile: most pairs are of two tiles, some ids stand twice, and one name is null.
    rows = [(f"n{i % 3}", i) for i in range(60)] + [("n0", 0), ("n9", 99), (None, 7)]
    df = spark.createDataFrame(rows, "name string, id long")
    want = sorted((n, a, b) for n, a in rows for m, b in rows if n is not None and n == m and a < b)
    assert sorted(tuple(r) for r in resolve.within_name_pairs(df, "name", "id", tile=3).collect()) == want
    texts = df.select("name", F.concat(F.lit("i"), "id").alias("id"))
    assert resolve.within_name_pairs(texts, "name", "id", tile=3).where("a < b").count() == len(want)


@pytest.mark.parametrize("twice", [False, True])
def test_agreement_by_tiles(spark, twice):
    rng = np.random.default_rng(0)
    rows = [(f"n{i % 3}", i) for i in range(60)] + [("n0", 3)] * twice
    special = [0.0, -1.0, float("nan"), float("inf"), None]
    cells = [(i, f"x{x}", special[rng.integers(5)] if rng.random() < 0.2 else float(rng.integers(90, 110))) for i in range(70) for x in range(6) if rng.random() < 0.6]
    df, values = spark.createDataFrame(rows, "name string, id long"), spark.createDataFrame(cells, "id long, axis string, v double")
    l, r = values.selectExpr("id AS a", "axis", "v AS x"), values.selectExpr("id AS b", "axis", "v AS y")
    near = F.coalesce(F.expr("abs(x - y) <= 0.05 * greatest(abs(x), abs(y))") & F.expr("x IS NOT NULL AND y IS NOT NULL"), F.lit(False))
    pairs = df.selectExpr("name", "id AS a").join(df.selectExpr("name", "id AS b"), "name").where("a < b")
    want = pairs.join(l, "a").join(r, ["b", "axis"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(near).alias("agreeing"))
    got = resolve.name_agreement(df, "name", "id", values, "axis", "v", tile=3)
    assert got.dtypes == want.dtypes and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
