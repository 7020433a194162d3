"""Matrices in blocks, ordered rules, constraints, recovered identities and sharded files, over small tables made here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import constraints, literature, matrix, recovery, rules
from sievework.operators.constraints import Constraint
from sievework.sources import footnotes, layouts, pages, readers, writers


def test_blocks_hold_what_cells_say(spark):
    rows = [(1, 0, 5.0), (1, 3, 7.0), (1, 31, 9.0), (1, 32, 0.0), (2, 63, -1.0), (2, 3, None), (3, 700, float("nan"))]
    m = matrix.blocked(spark.createDataFrame(rows, "r int, c int, v double"), "r", "c", "v")
    assert sorted((r["r"], r["column"], repr(r["value"])) for r in matrix.cells(m, "r").collect()) == sorted((r, c, repr(v)) for r, c, v in rows if v is not None)
    hidden = matrix.blocked(spark.createDataFrame([(1, 0, 1.0), (1, 32, 1.0)], "r int, c int, v double"), "r", "c", "v")
    assert sorted((r["r"], r["column"], r["value"]) for r in matrix.cells(matrix.withdrawn(m, "r", hidden), "r").collect() if r["r"] < 3) == [(1, 3, 7.0), (1, 31, 9.0), (2, 63, -1.0)]
    dense = {(r["r"], r["block"]): (r["x"], r["seen"]) for r in matrix.dense_blocks(m, "r").collect()}
    assert dense[1, 0][0][31] == 9.0 and dense[1, 1][0][0] == 0.0 and dense[1, 1][1][0] == 1.0 and sum(dense[2, 1][1]) == 1
    for bad in ([(1, 1, 1.0), (1, 1, 2.0)], [(1, -1, 1.0)]):
        with pytest.raises(Exception, match="twice|below 0"):
            matrix.blocked(spark.createDataFrame(bad, "r int, c int, v double"), "r", "c", "v").collect()


def test_model_rows_need_their_items(spark):
    items = spark.createDataFrame([(1,), (2,)], "r int")
    m = matrix.blocked(spark.createDataFrame([(1, 40, 2.0)], "r int, c int, v double"), "r", "c", "v")
    assert {r["r"]: len(r["a"]) for r in matrix.model_rows(items, "r", {"a": m}).collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError, match="without its item"):
        matrix.model_rows(items.where("r = 2"), "r", {"a": m})
    with pytest.raises(Exception, match="negative target"):
        matrix.target_cells(spark.createDataFrame([(-1.0,)], "v double"), "v").collect()


def test_the_first_rule_decides(spark):
    items = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, t string")
    keys = spark.createDataFrame([(1, "k:x"), (1, "k:y"), (2, "k:y"), (2, "n:no"), (3, "k:z")], "id int, key string")
    known = [rules.Rule("both", {"o": "both {t}"}, [["k:x"], ["k:y", "k:q"]]), rules.Rule("y", {"o": "y"}, [["k:y"]], ["n:no"])]
    with pytest.raises(Exception, match="no rule covers"):
        rules.first_rule(items, "id", keys, known, ["t"]).collect()
    out = rules.first_rule(items, "id", keys, [*known, rules.Rule("rest", {"o": "<{t}>"}, none_of=["k:x"])], ["t"])
    assert {r["id"]: (r["rule"], r["o"]) for r in out.collect()} == {1: ("both", "both b"), 2: ("rest", "<a>"), 3: ("rest", "<>")}


def test_families_by_words_inside_names(spark):
    items = spark.createDataFrame([(1, "", "Fat, total", "macronutrient"), (2, None, "Soluble dietary fibres", None), (3, "VITB12", "x", "micronutrient_vitamin"), (4, "", "Nonsense", "micronutrient_vitamin"), (5, "CA", "Calcium", "micronutrient_mineral"), (6, "", "", None)], "id int, tag string, name string, role string")
    got = {r["id"]: r["family"] for r in rules.families(items, "id", "tag", "name", "role").collect()}
    assert got[1] == "lipid_and_fatty_acid_family" and got[2] == "carbohydrate_family" and got[3] == "vitamin:b12" and got[4].startswith("vitamin_unresolved:label:") and got[5] == "mineral:CA" and got[6].startswith("component:label:")


def test_panels_must_hold_their_constraints(spark):
    schema = "canonical_name string, target_axis_id string, axis_family string, target_aliases string, selection_tier string, recommended_training_stage int, measurement_modality string"
    good = [("iron", "a1", "mineral", "fe", "nutrition_core", 1, "mass"), ("quercetin", "a2", "flavonoid", "", "food_metabolome_extension", 2, "mass")]
    draft = spark.createDataFrame([("iron",)], "canonical_name string")
    panel, counts = constraints.finalised(spark.createDataFrame(good, schema), draft)
    assert [r["canonical_name"] for r in panel.collect()] == ["iron", "quercetin"] and counts.count() == 2
    bad = {"one_name": [good[0], (*good[0][:1], "a3", *good[0][2:])], "fields": [good[0], (" ", *good[1][1:])], "draft_kept": good[1:], "not_excluded": [(*good[0][:6], "energy")], "in_draft": [good[0], ("zinc", "a4", "mineral", "zn", "nutrition_core", 1, "mass")]}
    for name, rows in bad.items():
        with pytest.raises(ValueError, match=name):
            constraints.finalised(spark.createDataFrame(rows, schema), draft)


def test_numbers_in_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", 2)], "g string, n int")
    found = constraints.violations({"t": df}, [Constraint("o", "t", "order", "n", ("g",)), Constraint("r", "t", "row", "n > 2")], {"t": ["g", "n"]}).collect()
    assert sorted((r["constraint"], r["key"], r["rows"]) for r in found) == [("o", "b", 2), ("o", "c", 2), ("o", "d", 1), ("r", "b|3", 1)]


def test_identities_by_the_first_key_that_is_known(spark):
    orphans = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, None, "q"), (4, None, None)], "id int, a string, b string")
    first = spark.createDataFrame([("x", "ex"), ("x", " ex "), ("y", "one"), ("y", "two")], "key string, name string")
    second = spark.createDataFrame([("p", "longer"), ("q", "bb"), ("q", "aa"), ("q", "ccc"), ("", "no")], "key string, name string")
    got = recovery.recovered(orphans, "id", [recovery.Step("one", "a", first), recovery.Step("two", "b", second, "least")]).collect()
    assert {r["id"]: (r["decision"], r["step"], r["recovered_name"], r["conflicts"]) for r in got} == {1: ("recovered", "one", "ex", None), 2: ("ambiguous", "one", None, "one | two"), 3: ("recovered", "two", "aa", None), 4: ("unresolved", None, None, None)}
    with pytest.raises(Exception, match="two tags"):
        twice = spark.createDataFrame([("A", "T1"), ("a", "T2")], "alias string, tag string")
        recovery.crosswalked(spark.createDataFrame([("a", "", "")], "original_name string, infoods_tag string, chebi_id string"), twice, spark.createDataFrame([], "chemical string, tag string"), spark.createDataFrame([("T1",), ("T2",)], "tag string")).collect()


def test_conversions_that_do_not_agree(spark):
    df = spark.createDataFrame([(2.0, 0.5, 1.0), (2.0, 0.5, 1.1), (None, 0.5, None), (None, 0.5, 1.0)], "v double, f double, c double")
    assert [tuple(r) for r in recovery.conversion_mismatches(df, "v", "f", "c").orderBy("v").collect()] == [(None, 0.5, 1.0), (2.0, 0.5, 1.1)]


def test_walks_end_in_circles(spark):
    cites = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")], "citing string, cited string")
    got = literature.citation_walk(spark.createDataFrame([("a",), ("z",), (None,)], "work string"), cites, 9).collect()
    assert sorted((r["seed"], r["work"], r["direction"], r["hop"]) for r in got) == [("a", "b", "backward", 1), ("a", "b", "forward", 2), ("a", "c", "backward", 2), ("a", "c", "forward", 1), ("a", "d", "forward", 1)]


def test_shards_are_there_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(3700).select("id", F.concat(F.lit('é"'), F.col("id").cast("string")).alias("t")).repartition(5)
    listed = pages.write_shards(df, str(tmp_path / "s"), F.col("id")).orderBy("path").collect()
    assert [(r["path"], r["records"]) for r in listed] == [("00000.json.gz", 1500), ("00001.json.gz", 1500), ("00002.json.gz", 700)]
    assert json.loads(gzip.decompress((tmp_path / "s/00002.json.gz").read_bytes()))[-1] == {"id": 3699, "t": 'é"3699'}
    assert pages.read_pages(spark, str(tmp_path / "s")).select("page", "place").distinct().count() == 3700
    with pytest.raises(Exception, match="FileExists"):
        pages.write_shards(df, str(tmp_path / "s"), F.col("id"))
    failing = df.withColumn("t", F.when(F.col("id") == 3000, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception):  # noqa: B017 - the task's own error, wrapped
        pages.write_shards(failing, str(tmp_path / "f"), F.col("id"))
    assert not list((tmp_path / "f").glob("**/*")) if (tmp_path / "f").exists() else True


def test_cached_pages(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"W1_forward_{n:03d}.json").write_text(json.dumps({"meta": {"count": 5}, "results": [{"id": 2 * n}, {"id": 2 * n + 1}][: 1 if n == 3 else 2]}))
    rows = pages.read_pages(spark, str(tmp_path), "W1_forward", "results").collect()
    assert sorted((r["page"], json.loads(r["record"])["id"], r["expected"]) for r in rows) == [(1, 2, 5), (1, 3, 5), (2, 4, 5), (2, 5, 5), (3, 6, 5)]
    (tmp_path / "W1_forward_002.json").unlink()
    for key in ("W1_forward", "W2"):
        with pytest.raises(Exception, match="cached"):
            pages.read_pages(spark, str(tmp_path), key, "results").collect()


def _cells(spark, source, sheets):
    return spark.createDataFrame([(source, "b", s, r, c, str(t)) for s, rows in sheets.items() for r, row in enumerate(rows) for c, t in enumerate(row) if t is not None], "source string, path string, sheet string, row int, col int, text string")


def test_layouts_of_odd_sheets(spark):
    swiss = {"Nutrient codes": [[], [], ["h"], ["FE", None, None, "Iron (mg)", "Fer (mg)"]], "Aliments génériques": [[], [], ["ID", "Nom", "Catégorie", "Fer (mg)", "Dérivation de la valeur", "Source", "Zinc (mg)", "x"], ["1", "Pain", "g", "3", "Calculé", None, "4", "5"], [None, "no id", "g", "3"], ["2", None, "g", "3"]]}
    out = layouts.read(_cells(spark, "swiss_fcdb_7_1", swiss))
    assert [(r["source_food_id"], r["source_component_id"], r["source_value_origin"], r["normalized_value_g_per_100g"]) for r in out.measurements.collect()] == [("Aliments génériques:1", "FE", "recipe_or_calculated", 0.003)]
    # Headings head the rows below until the next one; a sheet that no layout names is left out.
    laos = {"FCTB": [["LAO_FOOD_CODE", "food name english", "FOOD_GROUP", "Fe (mg)"], ["1", "a", "g1", "tr"], ["2", "b", "g2", None]], "Other": [["x"]]}
    laos = laos | {"FCTB": [["LAO_FOOD_CODE", "FOOD_NAME_ENGLISH", *laos["FCTB"][0][2:]], *laos["FCTB"][1:]]}
    out = layouts.read(_cells(spark, "smiling_laos_2013", laos))
    assert sorted((r["source_food_id"], r["value_status"], r["direct_mass_label_candidate"]) for r in out.measurements.collect()) == [("1", "trace_or_censored", False), ("2", "missing_or_not_reported", False)]
    assert layouts.read(_cells(spark, "unknown", laos)).foods.count() == 0


def test_long_sheets_need_their_headers(spark):
    heads = ["COUNTRY", "code", "efsaprodcode2_recoded", "level1", "level2", "level3", "NUTRIENT_ID", "NUTRIENT_TEXT", "UNIT", "LEVEL"]
    row = ["AT", "A1", "Bread", "g", "s", None, "7", "Calcium (Ca)", "Milligram", "30"]
    out = layouts.read_long(_cells(spark, "e", {"COMPO7": [heads, row, [*row[:9], "31"]]}))
    assert out.foods.count() == 1 and sorted(r["normalized_value_g_per_100g"] for r in out.measurements.collect()) == [0.03, 0.031]
    with pytest.raises(Exception, match="lacks headers: LEVEL"):
        layouts.read_long(_cells(spark, "e", {"COMPO7": [heads[:9], row[:9]]})).measurements.collect()


def test_workbooks_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("b1", "S & <T>", 0, 0, "a & b"), ("b1", "S & <T>", 2, 27, " 1.50"), ("b1", "T", 0, 0, "007"), ("b2", "S", 1, 1, "-3.25"), ("b2", "S", 1, 2, None)], "path string, sheet string, row int, col int, text string")
    books = writers.workbooks(cells)
    assert sorted(tuple(r) for r in readers.cells_of(books).collect()) == sorted(tuple(r) for r in cells.collect() if r["text"])
    assert writers.save_files(books.select(F.concat("path", F.lit(".xlsx")).alias("path"), "content"), str(tmp_path / "x")) == 2
    assert readers.sheet_cells(spark, str(tmp_path / "x")).count() == 4
    with pytest.raises(Exception, match="exists"):
        writers.save_files(books.select(F.concat("path", F.lit(".xlsx")).alias("path"), "content"), str(tmp_path / "x"))


def test_footnotes_change_what_they_are_about(spark):
    def book(foods):
        rows = [[] for _ in range(12)] + foods
        rows[11] = [None, None, None, None, "VITD", "FE"]
        cells = [("main", "p", r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t is not None]
        return spark.createDataFrame(cells, "table string, path string, row int, col int, text string")

    own = [footnotes.NotedTable("main", 11, "100g_edible_food", (1, 9), (("ug/100 g", 4, 4), ("mg/100 g", 5, 5)))]
    foods = [["1", "03032", None, "a", "１４.０†", "(2)", "†は規定法による測定値"], ["1", "03033", None, "b", "14†", "2", "†は規定法による測定値"], ["1", "03034", None, "c", "5", "1", "ビタミンD活性代謝物を含む。鉄: Trであるが"], ["1", "03035", None, "d", None, "NA", None]]
    noted = footnotes.read(book(foods), own)
    got = {(r["food_id"], r["tag"]): (r["value_status"], r["modality"] == footnotes.MASS, r["numeric_value"], r["hold"]) for r in noted.values.collect()}
    assert got["03032", "VITD"] == ("reported_positive_origin_unresolved", True, 14.0, "") and got["03032", "FE"][0] == "estimated_positive"
    assert got["03033", "VITD"][0] == "unparsed_requires_review" and got["03034", "VITD"][1:] == (False, 5.0, "active_metabolites")
    assert got["03034", "FE"] == ("trace_with_numeric_display_not_exact_point_label", True, 1.0, "explicit_trace") and got["03035", "VITD"][0] == "missing_blank" and got["03035", "FE"][0] == "unparsed_requires_review"
    with pytest.raises(Exception, match="a food twice"):
        footnotes.read(book([foods[0], foods[0]]), own).foods.collect()
    with pytest.raises(Exception, match="unknown unit"):
        footnotes.read(book(foods), [footnotes.NotedTable("main", 11, "100g_edible_food", (1, 9), (("cup", 4, 9),))]).values.collect()


def test_long_sheets_of_rows(spark):
    heads = ["COUNTRY", "code", "efsaprodcode2_recoded", "level1", "level2", "level3", "NUTRIENT_ID", "NUTRIENT_TEXT", "UNIT", "LEVEL"]
    row = ["AT", "A1", "Bread", "g", "s", None, "7", "Calcium (Ca)", "Milligram", "30"]
    # Books whose columns stand in different orders, one with a column that no one asks for and one with a header twice.
    books = {"a": [heads, row, [*row[:9], None]], "b": [["x", *heads[::-1]], [None, *row[::-1]], ["y", "31", *row[8::-1]]], "c": [[*heads, "LEVEL"], [*row, "5"], [*row[:9], None, "5"]]}
    rows = spark.createDataFrame([(p, "COMPO7", at, list(x)) for p, rs in books.items() for at, x in enumerate(rs)], "path string, sheet string, row int, texts array<string>")
    back = readers.rows_of(writers.row_workbooks(rows))
    assert sorted((r["path"], r["row"], dict(zip(r["cols"], r["texts"], strict=True))) for r in back.collect()) == sorted((p, at, {c: t for c, t in enumerate(x) if t is not None}) for p, rs in books.items() for at, x in enumerate(rs))
    out = layouts.read_long_rows(back)
    assert sorted((r["path"], r["row"], r["raw_value"]) for r in out.measurements.collect()) == [("a", 1, "30"), ("a", 2, ""), ("b", 1, "30"), ("b", 2, "31"), ("c", 1, "5"), ("c", 2, "5")]
    assert out.foods.count() == 1 and [(r["source_component_id"], r["component"], r["unit"]) for r in out.components.collect()] == [("7", "Calcium (Ca)", "Milligram")]


def test_families_are_told_once_for_each_kind(spark, monkeypatch):
    seen, label_keys = [], rules.label_keys
    monkeypatch.setattr(rules, "label_keys", lambda items, *more: seen.append(items.count()) or label_keys(items, *more))
    names = spark.createDataFrame([("FE", "Iron, total", "micronutrient_mineral"), (None, "Iron, total", "micronutrient_mineral"), ("", "Protein", None)], "tag string, name string, role string")
    items = spark.range(500).crossJoin(names).withColumn("id", F.monotonically_increasing_id())
    out = rules.families(items, "id", "tag", "name", "role")
    assert sorted((r["family"], r["count"]) for r in out.groupBy("family").count().collect()) == [("mineral:FE", 500), ("mineral:iron", 500), ("protein_and_amino_acid_family", 500)]
    assert seen == [3] and out.columns == ["id", "tag", "name", "role", "rule", "family"]
