"""Workbooks, matrices, databases with their errors, frozen panels and review queues, over small tables made here."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import catalogue
from sievework.sources import adapters, databases, readers, writers


def workbook(sheets):
    """An .xlsx file's bytes: shared, inline and plain cells in turn."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, out = [], io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (_, rows) in enumerate(sheets.items()):
            xml = []
            for r, row in enumerate(rows):
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r + 1}"
                    if v is None:
                        xml.append(f'<c r="{ref}"/>')
                    elif isinstance(v, (int, float)):
                        xml.append(f'<c r="{ref}"><v>{v}</v></c>')
                    elif c % 2:
                        xml.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                    else:
                        shared.append(v)
                        xml.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData><row>{"".join(xml)}</row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{t}</t></si>" for t in shared)}</sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>""" for i, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"""<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>""" for i in range(len(sheets)))}</Relationships>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    data = {"Foods": [["code", "name", "kcal"], ["f1", "Rice", 120.5], ["f2", None, 7]], "Wide": [[None, "E1", "E2"], [None, "a", "b"], ["f", 1, None], ["g", 2, 3]]}
    for i in range(2):
        (tmp_path / f"{i}.xlsx").write_bytes(workbook(data))
    foods = readers.sheet_rows(readers.sheet_cells(spark, str(tmp_path), "Foods"))
    assert foods.columns[3:] == ["code", "name", "kcal"] and sorted(tuple(r)[3:] for r in foods.collect())[0] == ("f1", "Rice", "120.5") and foods.count() == 4
    wide = readers.unstacked_headers(readers.sheet_cells(spark, f"{tmp_path}/0.xlsx", "Wide"), 2, 1)
    assert sorted((r["ids"], r["heads"], r["text"]) for r in wide.collect()) == [(["f"], ["E1", "a"], "1"), (["g"], ["E1", "a"], "2"), (["g"], ["E2", "b"], "3")]
    cells = lambda name, rows: (tmp_path / name).write_bytes(workbook({"D": rows})) and readers.sheet_cells(spark, f"{tmp_path}/{name}")
    assert [tuple(r) for r in readers.component_names(cells("d1.xlsx", [["x", "y"], ["Component", "Name"], ["A", "alpha"], ["A", "alpha"], [None, "note"]])).collect()] == [("A", "alpha")]
    for rows in ([["Component", ""], ["X", "a"], ["X", "b"]], [["nothing", "here"]]):
        with pytest.raises(Exception, match="two names|no row begins"):
            readers.component_names(cells("d2.xlsx", rows)).collect()
    with pytest.raises(ValueError):
        readers.sheet_rows(cells("d3.xlsx", [["a", "a"], ["1", "2"]]))


def test_matrices(spark, tmp_path):
    np.savez(tmp_path / "m.npz", a=np.array([[1.0, np.nan], [np.nan, 4.0]]))
    assert sorted((r["i"], r["j"], r["value"]) for r in readers.array_table(spark, f"{tmp_path}/m.npz", "a").collect()) == [(0, 0, 1.0), (1, 1, 4.0)]


def test_tag_lists(spark, tmp_path):
    (tmp_path / "tags.txt").write_bytes("<A>first\n text <B-1> b\xe9\n<A> again".encode("latin-1"))
    assert {r["tag"]: r["description"] for r in readers.read_tags(spark, f"{tmp_path}/tags.txt").collect()} == {"A": "first text", "B-1": "bé"}


def test_ontology_classes(spark, tmp_path):
    body = '<owl:Class rdf:about="http://x/FOODON_1"><rdfs:label>food</rdfs:label><rdfs:subClassOf rdf:resource="http://x/FOODON_0"/><rdfs:subClassOf rdf:resource="http://x/OTHER_0"/></owl:Class><owl:Class rdf:about="http://x/FOODON_2"/>'
    (tmp_path / "o.owl").write_text(f'<rdf:RDF xmlns:owl="o" xmlns:rdf="r" xmlns:rdfs="s">{body}</rdf:RDF>')
    got = readers.read_classes(spark, f"{tmp_path}/o.owl", "FOODON").collect()
    assert sorted((r["id"][9:], r["label"], r["parents"]) for r in got) == [("FOODON_1", "food", ["http://x/FOODON_0"]), ("FOODON_2", None, [])]


def test_numbers_must_be_known(spark):
    foods = spark.createDataFrame([(1, "dish")], "fdc_id int, name string")
    good = spark.createDataFrame([(1, "301.0", "Calcium", "MG"), (2, None, "x", "G"), (3, None, "y", "G")], "id int, number string, name string, unit string")
    values = lambda n: spark.createDataFrame([(1, n, 5.0)], "fdc_id int, number string, amount double")
    got = databases.survey(foods, good, values("301")).measurements.collect()
    assert [(r["source_component_id"], r["normalized_value_g_per_100g"], r["eligible"], r["quality_tier"]) for r in got] == [("301", 0.005, False, "D")]
    with pytest.raises(Exception, match="no nutrient has"):
        databases.survey(foods, good, values("1")).measurements.collect()
    with pytest.raises(ValueError):
        databases.survey(foods, good.union(good.where("id = 1").withColumn("id", F.lit(9))), values("301"))


def test_methods_by_their_own_samples(spark):
    results = spark.createDataFrame([(1, 7, "m1"), (2, 7, "m2"), (2, 7, "m1"), (9, 7, "m2")], "sample int, nutrient int, method string")
    hops = [(spark.createDataFrame([(1, 10), (2, 20)], "sample int, acquisition int"), "sample", "acquisition"), (spark.createDataFrame([(10, 100), (20, 100)], "acquisition int, food int"), "acquisition", "food")]
    methods = spark.createDataFrame([("m1", "dry"), ("m2", "wet")], "method string, label string")
    assert [tuple(r) for r in databases.linked_methods(results, methods, hops, "food", "nutrient").collect()] == [(100, 7, "dry; wet")]


def test_foods_of_cited_contents(spark):
    content = spark.createDataFrame([(1, None, None, "leaf", None, "USDA", "N:1", 5.0, "mg", "mg/100 g"), (1, None, None, " leaf ", "", "USDA ", "N:2", 5.0, "mg", "mg/100 g"), (1, 77, "Kale", None, "boiled", None, "N:1", 5.0, "mg", None), (2, None, None, None, None, "DUKE", "N:1", 3.0, "mg", "mg/100 g")],
                                    "food_id int, orig_food_id int, orig_name string, part string, preparation string, citation string, source_component_id string, amount double, unit string, basis string")
    out = databases.cited_contents(spark.createDataFrame([(1, "cabbage")], "food_id int, name string"), spark.createDataFrame([("N:1", "a"), ("N:2", "b")], "source_component_id string, name string"), content)
    assert sorted((r["source_food_id"], r["name"], r["lineage"]) for r in out.foods.collect()) == [("DUKE|2||", "food 2", "duke_phytochemical_database"), ("FOODB|77||boiled", "Kale", "foodb_lineage:foodb"), ("USDA|1|leaf|", "cabbage", "usda_sr_legacy")]
    assert sorted((r["source_food_id"], r["quality_tier"], r["independent_evidence"], r["eligible"]) for r in out.measurements.collect()) == [("DUKE|2||", "C", True, False), ("FOODB|77||boiled", "D", True, False), ("USDA|1|leaf|", "D", False, False), ("USDA|1|leaf|", "D", False, False)]


def test_panels_freeze_once(spark, tmp_path):
    panel = spark.createDataFrame([("a", 1), ("b", 2)], "axis string, n int")
    for _ in range(2):
        assert writers.freeze(panel, "axis", f"{tmp_path}/p").count() == 2
    assert writers.freeze(panel.select("n", "axis").orderBy("n"), "axis", f"{tmp_path}/p").count() == 2
    with pytest.raises(ValueError):
        writers.freeze(panel.withColumn("n", F.lit(3)), "axis", f"{tmp_path}/p")
    with pytest.raises(ValueError):
        writers.freeze(panel.union(panel), "axis", f"{tmp_path}/q")
    panel.write.parquet(f"{tmp_path}/half/panel")
    with pytest.raises(FileExistsError):
        writers.freeze(panel, "axis", f"{tmp_path}/half")


def test_review_queues(spark, tmp_path):
    items = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string").coalesce(1)
    hashes = writers.review_queue(items, items.where("id = 1"), "id", f"{tmp_path}/q").collect()
    assert len(hashes) == 1 and len(hashes[0]["sha256"]) == 64
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/q/queue", header=True).collect()] == [("2", "y", None, None, None)]
    with pytest.raises(Exception, match="exists"):
        writers.review_queue(items, items.where("id = 1"), "id", f"{tmp_path}/q")
    assert writers.markdown_table(items).count("\n") == 3
    with pytest.raises(ValueError):
        writers.markdown_table(spark.range(300))


def test_facts_that_are_alike_are_judged_once(spark, sf_dir, monkeypatch):
    seen, measured = [], adapters.Adapter.measured
    monkeypatch.setattr(adapters.Adapter, "measured", lambda self, rows: seen.append((rows.count(), rows.agg(F.sum("n")).first()[0])) or measured(self, rows))
    out = catalogue.queries()["national_adapters"](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kinds = lines.selectExpr("l_linenumber", "CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_quantity END AS v").distinct().count()
    assert seen == [(kinds, lines.count())] * 7 and kinds < lines.count() and out.agg(F.sum("n")).first()[0] == 7 * lines.count()
