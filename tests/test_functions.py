"""Parsers, units, keys, joins, gates, splits, writers: the cases in which they differ."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import ids, text, units, values
from sievework.operators import cells, evaluate, gates, graph, relational, split, stats
from sievework.sources import adapters, readers, writers


def column(spark, data, kind="string"):
    return spark.createDataFrame([(x,) for x in data], f"x {kind}")


def test_value_states(spark):
    cases = {"0": "explicit_zero", "0,0": "explicit_zero", "1.5": "observed", "< 0,1": "below_limit", "Tr": "trace", "nd": "trace", "1-2": "range_only", "1 – 2": "range_only", "": "missing", "--": "missing", "N/A": "missing", None: "missing", "abc": "invalid", "1d": "invalid", "inf": "invalid", "NaN": "invalid", "1_0": "invalid", "-3": "observed"}
    got = {r[0]: r[1] for r in column(spark, cases).select("x", values.parse_value(F.col("x")).value_status).collect()}
    assert got == cases


def test_bounds_beside_a_missing_value_are_a_range(spark):
    df = spark.createDataFrame([(None, "1", "2")], "x string, a string, b string")
    r = df.select(values.parse_value(F.col("x"), F.col("a"), F.col("b")).alias("s")).first().s
    assert (r.value_status, r.parsed_min, r.parsed_max, r.numeric_value) == ("range_only", 1.0, 2.0, None)


def test_the_other_vocabularies(spark):
    cases = {"[1.2]": "bracketed_or_parenthesized_estimate", "spur": "trace_or_censored", "n.i.": "missing_or_not_reported", "-1": "invalid_negative", "x": "unparsed_non_numeric", "0": "explicit_zero"}
    assert {r[0]: r[1] for r in column(spark, cases).select("x", values.parse_bracketed(F.col("x")).status).collect()} == cases
    cases = {"(0)": "estimated_zero", "(Tr)": "estimated_trace", "Tr": "trace_interval", "*": "footnote_only_value_unresolved", "–": "unmeasured_dash", "": "missing_blank", "5†": "unparsed_requires_review"}
    assert {r[0]: r[1] for r in column(spark, cases).select("x", values.parse_dagger(F.col("x")).status).collect()} == cases
    assert column(spark, ["5†"]).select(values.parse_dagger(F.col("x"), F.lit(True)).number).first()[0] == 5.0


def test_units(spark):
    cases = {"mg/100 g": "converted_exact_mass", "μg/100 g edible portion": "converted_exact_mass", "g": "missing_denominator", "kJ": "excluded_energy", "mg RE": "excluded_biological_equivalent", "mmol/l": "excluded_molar", "% of DM": "excluded_relative_fraction", "g/100 g fatty acid": "excluded_relative_fraction",
             "mg per 100 g dry matter": "requires_moisture_conversion", "mg/100ml": "requires_density_conversion", "mg/portion": "requires_portion_conversion", "mg/kg": "unsupported_explicit_denominator", "": "unsupported_or_missing_unit"}
    assert {r[0]: r[1] for r in column(spark, cases).select("x", units.normalize_unit(F.col("x")).status).collect()} == cases
    assert column(spark, ["kg", "2 mcg", "g", "x"]).select(units.mass_factor(F.col("x"))).toPandas().iloc[:, 0].tolist()[:3] == [1000.0, 1e-6, 1.0]


def test_keys(spark):
    r = column(spark, ["Straße  Ａ-1"]).select(text.label_key(F.col("x")), text.name_key(F.col("x"))).first()
    assert tuple(r) == ("strasse a 1", "strasse a-1")
    assert [r[0] for r in column(spark, ["338.0", "338.10", "7"]).select(ids.code_text(F.col("x"))).collect()] == ["338", "338.1", "7"]
    assert column(spark, [None]).select(ids.stable_id("p", F.col("x"), F.lit("a"))).first()[0] == column(spark, [""]).select(ids.stable_id("p", F.col("x"), F.lit("a"))).first()[0]


def test_checked_joins_raise(spark):
    twice = column(spark, ["a", "a"])
    with pytest.raises(ValueError):
        relational.join_checked(column(spark, ["a"]), twice, ["x"], validate="many_to_one")
    with pytest.raises(ValueError):
        relational.join_checked(twice, column(spark, ["a"]), ["x"], validate="one_to_one")
    assert relational.join_checked(twice, column(spark, ["a"]), ["x"]).count() == 2
    with pytest.raises(ValueError):
        relational.require_columns(twice, ["y", "x"])


def test_selection_refuses_bad_input(spark):
    schema = "f int, a string, value double, source_key string, quality_tier string, sample_count int, measurement_id string"
    row = (1, "x", 1.0, "s", "A", 1, "m1")
    for bad in [[row, row], [(*row[:2], 101.0, *row[3:])], [(*row[:3], "t", *row[4:])]]:
        # An id held twice raises at once, the others fail the job that reads them.
        with pytest.raises(Exception, match="more than one row|out of bounds"):
            cells.select_records(spark.createDataFrame(bad, schema), ["f", "a"], ["s"])[1].collect()
    winners, audit = cells.select_records(spark.createDataFrame([row, (1, "x", 2.0, "s", "A", 5, "m2"), (1, "x", 3.0, "s", "B", 9, "m3")], schema), ["f", "a"], ["s"])
    assert winners.first().measurement_id == "m2" and audit.first().disagreement


def test_tolerant_distinct_follows_the_last_counted(spark):
    df = spark.createDataFrame([([1.0, 1.0 + 5e-10, 1.0 + 1.2e-9, 2.0],)], "v array<double>")
    assert df.select(stats.tolerant_distinct(F.col("v"))).first()[0] == 3


def test_pooling_flags_conflict(spark):
    rows = [(1, 1.0, 0.1, "a"), (1, 1.1, 0.1, "b"), (2, 0.0, None, "a"), (2, 1.0, None, "b"), (3, 5.0, None, "a"), (4, 1.0, None, "a"), (4, 9.0, None, "b")]
    df = spark.createDataFrame([(*r, "A") for r in rows], "k int, v double, se double, s string, t string")
    got = {r.k: r for r in stats.pooled_effect(df, ["k"], "v", F.col("se"), F.lit(None).cast("double"), "s", "ABCD", "t").collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["accepted", "review", "accepted", "review"]
    assert got[1].method == "random_effects" and got[3].value == 5.0 and got[2].zero_conflict and got[4].value is None


def test_vetoed_unions_keep_facets_apart(spark):
    rows = spark.createDataFrame([(1, "raw", 1, "x"), (2, None, 1, "x"), (3, "dry", 1, "x"), (4, "dry", 1, "x")], "n long, f string, label long, name string")
    got = {r.n: r.group for r in graph.constrained_groups(rows, "n", "f", "label", "name").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_holdout_fills_exactly_or_raises():
    assert sum({"a": 3, "b": 2, "c": 1}[f] for f in split.holdout_families([("a", 3), ("b", 2), ("c", 1)], 6)) == 6
    with pytest.raises(ValueError):
        split.holdout_families([("a", 4)], 3)


def test_masks_never_hide_all(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a")], "i int, f string")
    rows = split.family_masks(df, "i", "f").collect()
    assert {r.i for r in rows} == {1} and all(0 < len(r.hidden) < 3 for r in rows)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double").withColumn("g", F.lit(1))
    assert [round(r.p_adjusted, 6) for r in evaluate.holm(df, ["g"], "p", "i").orderBy("i").collect()] == [0.03, 0.06, 0.06]


def test_gate_keeps_given_reasons(spark):
    schema = "main_value_eligible boolean, value_status string, independent_evidence boolean, quality_tier string, data_layer string, quality_evidence string, exclusion_reason string"
    rows = [(True, "observed", True, "A", "primary_reference", None, None), (True, "observed", None, "A", "primary_reference", None, "given"), (True, "observed", False, "C", "curated_reference_training", "ref", "")]
    got = gates.training_gate(spark.createDataFrame(rows, schema)).collect()
    assert [(r.eligible, r.strict, r.exclusion_reason) for r in got] == [(True, True, None), (False, False, "given"), (True, False, None)]


def test_writers_and_readers(spark, tmp_path):
    df = spark.createDataFrame([("NA", 1), ('say "a", b', 2), (None, 3)], "t string, n int")
    writers.write_csv(df, f"{tmp_path}/c")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_csv(df, f"{tmp_path}/c")
    writers.write_manifest({"a": float("nan"), "n": 1}, f"{tmp_path}/m.json")
    assert '"a": null' in (tmp_path / "m.json").read_text()
    before = writers.snapshot(spark, f"{tmp_path}", "*.json")
    assert before.count() == 1
    (tmp_path / "m.json").write_text("x")
    assert [r.change for r in writers.changed(before, writers.snapshot(spark, f"{tmp_path}", "*.json")).collect()] == ["different"]
    writers.append_record(spark, f"{tmp_path}/ledger", {"id": "e1", "v": 1}, "id")
    with pytest.raises(ValueError):
        writers.append_record(spark, f"{tmp_path}/ledger", {"id": "e1", "v": 2}, "id")
    assert writers.package(f"{tmp_path}/c", f"{tmp_path}/r.zip")
    assert readers.zip_members(spark, f"{tmp_path}/r.zip", "MANIFEST").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.cached_json(tmp_path, "none")


def test_adapters_name_tiers(spark):
    facts = spark.createDataFrame([(1, "c", "0", None, None, "mg", None, 12), (1, "d", "3", None, None, "g", None, 3)], "source_food_id int, source_component_id string, raw_value string, raw_min string, raw_max string, raw_unit string, raw_basis string, value_source_code int")
    got = {r.source_component_id: r for r in adapters.ADAPTERS["cnf"].measured(facts).collect()}
    assert (got["c"].zero_semantics, got["c"].eligible, got["d"].quality_tier, got["d"].eligible) == ("assumed_zero", False, "A", True)


def test_frozen_blocks_flag_conflicts(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "n long")
    frozen = spark.createDataFrame([(0, "b0"), (1, "b1")], "n long, block string")
    edges = spark.createDataFrame([(0, 2), (2, 3), (0, 4), (1, 4)], "a long, b long")
    got = {r.n: (r.block, r.conflict) for r in graph.attach_to_frozen(nodes, "n", frozen, "block", edges).collect()}
    assert got == {2: ("b0", False), 3: ("b0", False), 4: ("new:4", True), 5: ("new:5", False)}
