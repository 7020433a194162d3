"""Roles, labels, panels and support against small cases and plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import annotate, identity, panels, relational


def test_roles_in_their_order(spark):
    base = ("false", "observed", 5.0, "converted_exact_mass", "source_reported", "")
    cases = [
        (("True", "invalid", None, "x", "", ""), "strict_model_label"), (base, "needs_record_review"), (("false", "assumed_zero", 0.0, "x", "", ""), "evidence_only_measurement_modality"), (("false", "assumed_zero", 0.0, "converted_exact_mass", "", ""), "evidence_only_value_semantics"),
        (("false", "range_only", 120.0, "converted_exact_mass", "", ""), "review_required_measurement_range"), (("false", "observed", 5.0, "converted_exact_mass", "recipe_calculated", ""), "evidence_only_derived_or_recipe"), (("false", "bracketed_or_parenthesized_estimate", 5.0, "converted_exact_mass", "recipe_calculated", ""), "review_required_estimated_value"),
        (("false", "explicit_zero", 0.0, "converted_exact_mass", annotate.DERIVED_FOODS, annotate.ANALYSED), "tier_b_curated_analytical_candidate"), (("false", "observed", 5.0, "converted_exact_mass", annotate.DERIVED_FOODS, ""), "review_required_provenance"), ((None, None, None, None, None, None), "evidence_only_measurement_modality"),
        (("false", "observed", 5.0, "converted_exact_mass", "source_linked_analytical_project", ""), "tier_b_source_linked_analytical_candidate"), (("false", "observed", None, "converted_exact_mass", "recipe_calculated", ""), "review_required_measurement_range"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, direct_mass_label_candidate string, value_status string, normalized_value_g_per_100g double, conversion_status string, source_value_origin string, source_note string")
    assert [r["training_review_role"] for r in annotate.review_roles(df).orderBy("i").collect()] == [w for _, w in cases]


def test_labels(spark):
    rows = [(1, "Iron, Fe (mg/100 g)", 1), (1, "IRON FE", 2), (1, "Zinc", 0), (2, "b", 1), (2, "a", 0), (3, None, 0), (3, " ", 1), (4, "x", 0)]
    df = spark.createDataFrame(rows, "k int, l string, o int")
    got = {r["k"]: (r["label"], r["basis"]) for r in annotate.modal_label(df, ["k"], "l", "o", spark.createDataFrame([(4, " Known ")], "k int, authority_name string")).collect()}
    assert got == {1: ("IRON FE", "modal official source label"), 2: ("a", "modal official source label"), 3: (None, None), 4: ("Known", "authority")}


def test_rules_must_cover_axes(spark):
    axes = spark.createDataFrame([(1, "T", "a"), (2, "T", "b")], "id int, ns string, nutritional_role string")
    rules = spark.createDataFrame([("T", "macro")], "ns string, category string")
    out = annotate.classified(axes, "id", ["ns"], rules, "nutritional_role")
    assert out.columns == ["ns", "id", "legacy_nutritional_role", "category"] and out.count() == 2
    with pytest.raises(Exception, match="no rule covers"):
        annotate.classified(axes, "id", ["ns"], rules.where("false")).collect()
    with pytest.raises(ValueError):
        annotate.classified(axes.union(axes), "id", ["ns"], rules)


def test_nutritional_roles(spark):
    rows = [("FE", "x", "", "micronutrient_mineral"), ("", "Total protein", "", "macronutrient"), ("FAT", "", "", "macronutrient"), ("FAPU", "", "", "nutrient_constituent_fatty_acid"), ("", "Folate, total", "", "micronutrient_vitamin"), ("", "Leucine", "", "nutrient_constituent_amino_acid"), ("", "Quercetin", "Flavonols", annotate.NO_ROLE), (None, None, None, annotate.NO_ROLE)]
    df = spark.createDataFrame(rows, "t string, n string, g string, want string")
    assert all(r["role"] == r["want"] for r in df.select("want", annotate.nutritional_role(F.col("t"), F.col("n"), F.col("g"))["role"].alias("role")).collect())
    pairs = [("18 2 acid", "18 3 acid", "numeric_form_or_homologue_differs"), ("L-alanine", "alanine", "stereochemical_form_not_confirmed"), ("3 hydroxy", "hydroxy", "positional_or_isomeric_form_not_confirmed"), ("iron", "iron", "none_detected_from_name_only")]
    got = spark.createDataFrame(pairs, "a string, b string, want string").select("want", identity.name_caution(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r["want"] == r["c"] or r["want"] in r["c"] for r in got)
    units = [("mg", ["g"], "both_report_mass_units; conversion_not_performed_here"), ("", ["g"], "unit_not_stated_in_one_or_both_catalogues"), ("IU", ["iu"], "same_raw_unit"), ("IU", ["g"], "unit_or_expression_review_required"), ("g", None, "unit_not_stated_in_one_or_both_catalogues")]
    assert all(r["w"] == r["r"] for r in spark.createDataFrame(units, "u string, o array<string>, w string").select("w", annotate.unit_relation(F.col("u"), F.col("o")).alias("r")).collect())


def test_panels(spark):
    draft = spark.createDataFrame([("Vit C", "Vitamins"), ("ascorbate", "Vitamins"), ("Iron", "Minerals")], "name string, family string")
    synonyms = spark.createDataFrame([("Vit C", "Ascorbic acid"), ("ascorbate", "Ascorbic acid")], "key string, canonical string")
    more = spark.createDataFrame([("Iron", "Minerals"), ("Rutin", "Flavonoids")], "name string, family string")
    got = {r["canonical_name"]: (r["family"], r["originals"], r["origin"]) for r in panels.finalised_panel(draft, "name", "family", synonyms, more, "v").collect()}
    assert got == {"Ascorbic acid": ("Vitamins", "Vit C | ascorbate", "draft"), "Iron": ("Minerals", "Iron", "draft"), "Rutin": ("Flavonoids", "", "extension")}
    with pytest.raises(Exception, match="several families"):
        panels.finalised_panel(draft.replace("Vitamins", "Acids", "family").where("name = 'ascorbate'").union(draft.where("name = 'Vit C'")), "name", "family", synonyms, more, "v").collect()
    with pytest.raises(Exception, match="undefined family"):
        panels.finalised_panel(draft, "name", "family", synonyms, more, "v", ["Minerals"]).collect()
    with pytest.raises(ValueError):
        panels.finalised_panel(draft, "name", "family", synonyms, more.union(more), "v")
    facts = spark.createDataFrame([("c", "f", 1.0, "s")], "component string, food string, v double, s string")
    with pytest.raises(Exception, match="outside of the panel"):
        panels.frozen_audit(spark.createDataFrame([("t",)], "target string"), "target", facts, "component", spark.createDataFrame([("c", "u")], "component string, target string"), "food", "v", "s", F.lit(True))[0].collect()


def test_support_is_repaired(spark):
    rng = random.Random(3)
    support = [(f"g{g}", f"a{a}", rng.randrange(1, 9), rng.randrange(3)) for g in range(14) for a in range(4) if rng.random() < 0.6]
    sides = {f"g{g}": "train" if g < 4 else "validation" for g in range(14)}
    df = spark.createDataFrame(support, "g string, a string, n int, p int")
    placed = spark.createDataFrame(list(sides.items()), "g string, partition string")
    got = {r["g"]: (r["partition"], r["moved"]) for r in panels.repaired_support(df, "g", "a", [("n", 20), ("p", 3)], placed).collect()}
    train = {g for g, (side, _) in got.items() if side == "train"}
    for a in {r[1] for r in support}:
        assert sum(r[2] for r in support if r[1] == a and r[0] in train) >= 20 and sum(r[3] for r in support if r[1] == a and r[0] in train) >= 3
    assert all(moved == (sides[g] != side) for g, (side, moved) in got.items()) and {g for g, s in sides.items() if s == "train"} <= train
    # No move is idle: without the last one or any, an axis lacks something.
    moved = [g for g, (_, m) in got.items() if m]
    assert moved and not any(all(sum(r[2] for r in support if r[1] == a and r[0] in train - {g}) >= 20 and sum(r[3] for r in support if r[1] == a and r[0] in train - {g}) >= 3 for a in {r[1] for r in support}) for g in moved[-1:]) or len(moved) > 1
    with pytest.raises(ValueError):
        panels.repaired_support(df, "g", "a", [("n", 10_000)], placed)


def test_running_totals_and_indexes(spark):
    rows = [(k, v, n) for k, (v, n) in itertools.product("ab", zip(range(300), itertools.cycle([1, 2, 3])))]
    got = relational.running_total(spark.createDataFrame(rows, "k string, v int, n int").repartition(7), "v", "n", ["k"]).collect()
    total = dict.fromkeys("ab", 0)
    for r in sorted(got, key=lambda r: r["v"]):
        total[r["k"]] += r["n"]
        assert r["running"] == total[r["k"]]
    names = spark.createDataFrame([("c",), ("a",), (None,), ("b",), ("a",)], "n string")
    assert sorted(tuple(r) for r in relational.dense_index(names, "n").collect()) == [("a", 1), ("b", 2), ("c", 3)]
