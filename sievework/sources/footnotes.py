"""Tables whose cells are qualified by footnotes: markers in cells, notes on rows, and what a note changes in the cells it is about."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import parse_dagger


@dataclass(frozen=True)
class NotedTable:
    """A sheet of foods whose last column holds notes. tag_row: the row of tags; name_rows: rows of headers that make up a
    component's name; units: (unit, first column, last column) where the sheet has no row of units below its tags."""

    name: str
    tag_row: int
    basis: str
    name_rows: tuple[int, int]
    units: tuple[tuple[str, int, int], ...] = ()


@dataclass(frozen=True)
class Footnote:
    """What a row's note changes, if it holds `says`: in the cells of `tag` (empty: all), of the food `food` (empty: any) and with
    `marker` at their end (empty: any). effect: `verified` (the marker is a note on method, not part of the value), `status` or
    `modality`, which `to` replaces; hold: why a value can't be used as it stands."""

    says: str
    effect: str
    to: str = ""
    tag: str = ""
    food: str = ""
    marker: str = ""
    hold: str = ""


_MASS = "100g_edible_food"
# Units by column of the main table, tables by name, tag row and basis, tags that aren't masses, and notes.
_MAIN_UNITS = (("%", 4, 4), ("kJ", 5, 5), ("kcal", 6, 6), ("g/100 g", 7, 10), ("mg/100 g", 11, 11), ("g/100 g", 12, 13), ("g/100 g", 15, 16), ("g/100 g", 18, 22), ("mg/100 g", 23, 31), ("ug/100 g", 33, 43), ("mg/100 g", 44, 47), ("ug/100 g", 48, 48), ("mg/100 g", 49, 53), ("ug/100 g", 54, 55), ("mg/100 g", 56, 56), ("ug/100 g", 57, 57), ("mg/100 g", 58, 58), ("g/100 g", 59, 60))
TABLES = [
    NotedTable("main", 11, _MASS, (1, 9), _MAIN_UNITS),
    NotedTable("amino_acids_mass", 4, _MASS, (3, 3)),
    NotedTable("amino_acids_per_reference_nitrogen", 4, "1g_reference_nitrogen", (3, 3)),
    NotedTable("amino_acids_per_residue_protein", 4, "1g_amino_acid_residue_protein", (3, 3)),
    NotedTable("amino_acids_per_nitrogen_protein", 4, "1g_nitrogen_based_protein", (3, 3)),
    NotedTable("fatty_acids_mass", 4, _MASS, (3, 3)),
    NotedTable("fatty_acids_relative", 4, "100g_total_fatty_acids", (3, 3)),
    NotedTable("fatty_acids_per_lipid", 4, "1g_total_lipid", (3, 3)),
    NotedTable("carbohydrates", 4, _MASS, (3, 3)),
    NotedTable("dietary_fibre", 7, _MASS, (3, 6)),
    NotedTable("organic_acids", 4, _MASS, (3, 3)),
]
MODALITIES = [
    (("ENERC", "ENERC_KCAL"), "energy_excluded"),
    (("REFUSE",), "refuse_fraction_metadata"),
    (("FATNLEA", "CHOAVLM", "CARTBEQ", "VITA_RAE", "NE", "NACL_EQ"), "equivalent_expression_excluded"),
    (("VITK",), "mixed_mass_equivalent_definition_hold"),
    (("FAUN",), "unidentified_substances_excluded"),
]
NOTES = [
    Footnote("†は規定法による測定値", "verified", food="03032", marker="†"),
    Footnote("ビタミンD活性代謝物を含む", "modality", "food_specific_vitamin_D_active_metabolite_expression_hold", tag="VITD", hold="active_metabolites"),
    Footnote("鉄: Trであるが", "status", "trace_with_numeric_display_not_exact_point_label", tag="FE", hold="explicit_trace"),
]
GRAMS = {"g/100 g": 1.0, "mg/100 g": 1e-3, "ug/100 g": 1e-6}
FOREIGN = "米国|アメリカ|豪州|オーストラリア|英国|イギリス|デンマーク|カナダ|外国"
ESTIMATED = "推計|推定|原材料|配合割合|計算"
MASS = "mass_per_100g_edible_food"


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t or "").strip())


@dataclass(frozen=True)
class Noted:
    components: DataFrame
    values: DataFrame
    foods: DataFrame


def modality(tag: Column, basis: Column) -> Column:
    """Whether a tag on a basis is a mass of food, or what else; the first that holds."""
    out = F.lit(MASS)
    for tags, name in reversed(MODALITIES):
        out = F.when(tag.isin(*tags), name).otherwise(out)
    return F.when(basis != _MASS, "relative_denominator_excluded").otherwise(out)


def _effects(food: Column, note: Column, notes: Sequence[Footnote]) -> Column:
    """The footnotes that a row's note calls up, as an array of structs, in their order."""
    kinds = ("effect", "to", "tag", "marker", "hold")
    own = [F.when(note.contains(n.says) & (F.lit(n.food == "") | (food == n.food)), F.struct(*(F.lit(getattr(n, k)).alias(k) for k in kinds))) for n in notes]
    return F.filter(F.array(*own), lambda x: x.isNotNull())


def _must(condition: Column, message: str, *parts: Column) -> Column:
    """True, or an error where the condition doesn't hold."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit(message), *parts)).cast("boolean"))


def read(cells: DataFrame, tables: Sequence[NotedTable] = tuple(TABLES), notes: Sequence[Footnote] = tuple(NOTES)) -> Noted:
    """Components, values and foods of cells (table, path, row, col, text and, where tables come in several editions, edition), rows
    and columns from 0.

    A food is a row whose column 1 holds five digits; its note is in its sheet's last column. A value is a food's cell in a tagged
    column, blank cells too. Notes are matched once for each food and meet its cells in one join; markers are looked for in the
    cells. A value keeps its token; its status is of the dagger vocabulary. candidate: a positive value of unresolved origin, a
    mass of at most 100 g per 100 g. Ids tell foods of one edition apart. A food twice in an edition's table, a table without tags
    or foods, and a mass in a unit that isn't known are errors.
    """
    spark = cells.sparkSession
    if "edition" not in cells.columns:
        cells = cells.withColumn("edition", F.lit(""))
    spec = spark.createDataFrame([(t.name, t.tag_row, t.basis, *t.name_rows, [u for u in t.units]) for t in tables], "table string, tag_row int, basis string, name_from int, name_to int, units array<struct<unit: string, lo: int, hi: int>>")
    texts = cells.select("text").distinct().withColumn("_t", _compatible("text"))
    at = cells.join(texts, "text").withColumn("text", F.col("_t")).drop("_t").join(F.broadcast(spec), "table")
    head = at.where("row <= tag_row + 1").groupBy("table", "path", "col").agg(
        *(F.first(c).alias(c) for c in ("basis", "units")), F.max(F.when(F.col("row") == F.col("tag_row"), F.col("text"))).alias("tag"), F.max(F.when(F.col("row") == F.col("tag_row") + 1, F.col("text"))).alias("below"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row").between(F.col("name_from"), F.col("name_to")) & (F.col("text") != ""), F.struct("row", "text")))), lambda x: x["text"]), " | ").alias("name"),
    )
    of_range = F.get(F.filter("units", lambda u: F.col("col").between(u["lo"], u["hi"])), 0)["unit"]
    columns = head.where(F.col("tag").rlike(r"^[A-Z][A-Z0-9_\-]*$") & (F.col("col") > 3)).withColumn("unit", F.when(F.size("units") > 0, of_range).otherwise(F.col("below")))
    columns = columns.withColumn("modality", modality(F.col("tag"), F.col("basis"))).withColumn("factor", F.coalesce(*(F.when(F.col("unit") == u, F.lit(g)) for u, g in GRAMS.items())))
    columns = columns.where(_must((F.col("modality") != MASS) | F.col("factor").isNotNull(), "a mass in an unknown unit:", F.col("table"), F.col("tag"), F.coalesce("unit", F.lit("none"))))
    columns = columns.withColumn("component_key", F.concat_ws(":", F.lit("mext"), "tag", "basis"))
    width = at.groupBy("table", "path").agg(F.max("col").alias("_last"))
    rows = at.join(width, ["table", "path"]).where("row > tag_row")
    pick = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    foods = rows.where((F.col("col") < 4) | (F.col("col") == F.col("_last"))).groupBy("table", "edition", "path", "row").agg(pick(0).alias("food_group_id"), pick(1).alias("food_id"), pick(3).alias("original_food_name"), F.coalesce(pick(F.col("_last")), F.lit("")).alias("source_note"))
    foods = foods.where(F.col("food_id").rlike(r"^\d{5}$")).withColumn("food_group_id", F.lpad(F.coalesce("food_group_id", F.lit("")), 2, "0"))
    note = F.col("source_note")
    foods = foods.withColumns({"foreign_source_note": note.rlike(FOREIGN), "recipe_or_estimation_note": note.rlike(ESTIMATED), "referenced_food_ids": F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(note, F.lit(r"(?<!\d)(\d{5})(?!\d)"), F.lit(1)))), ";"), "_effects": _effects(F.col("food_id"), note, notes)})
    twice = foods.groupBy("table", "edition", "food_id").agg(F.count(F.lit(1)).alias("_n"))
    foods = foods.join(twice, ["table", "edition", "food_id"]).where(_must(F.col("_n") == 1, "a food twice in a table:", F.col("table"), F.col("food_id"))).drop("_n")
    values = foods.select("table", "edition", "path", "row", "food_id", "_effects").join(columns.select("table", "path", "col", "tag", "unit", "basis", "modality", "factor", "component_key"), ["table", "path"])
    values = values.join(at.select("table", "path", "row", "col", "text"), ["table", "path", "row", "col"], "left").withColumn("token", F.coalesce("text", F.lit(""))).drop("text")
    mine = F.filter("_effects", lambda e: ((e["tag"] == "") | (e["tag"] == F.col("tag"))) & ((e["marker"] == "") | F.endswith("token", e["marker"])))
    values = values.withColumn("_effects", mine)
    first = lambda kind: F.get(F.filter("_effects", lambda e: e["effect"] == kind), 0)["to"]
    values = values.withColumn("verified", F.exists("_effects", lambda e: e["effect"] == "verified"))
    read_ = values.select("token", "verified").distinct().withColumn("_s", parse_dagger(F.col("token"), F.col("verified"))).withColumnsRenamed({"token": "_token", "verified": "_v"})
    values = values.join(read_, (F.col("token") == F.col("_token")) & (F.col("verified") == F.col("_v"))).withColumns({
        "modality": F.coalesce(first("modality"), F.col("modality")), "value_status": F.coalesce(first("status"), F.col("_s.status")), "numeric_value": F.col("_s.number"), "estimated": F.col("_s.estimated"),
        "hold": F.array_join(F.array_distinct(F.filter(F.transform("_effects", lambda e: e["hold"]), lambda h: h != "")), ";"),
    })
    mass = F.when(F.col("modality") == MASS, F.col("numeric_value") * F.col("factor"))
    values = values.withColumn("g_per_100g", mass).withColumns({
        "candidate": F.coalesce((F.col("value_status") == "reported_positive_origin_unresolved") & (F.col("g_per_100g") > 0) & (F.col("g_per_100g") <= 100), F.lit(False)),
        "invalid_mass": F.coalesce((F.col("g_per_100g") < 0) | (F.col("g_per_100g") > 100), F.lit(False)),
    })
    listed = columns.select("table", "component_key", "tag", "name", "unit", "basis", "modality", "factor").distinct()
    return Noted(listed, values.drop("_effects", "_s", "_token", "_v", "factor", "path"), foods.drop("_effects", "path"))


def repeated(values: DataFrame) -> DataFrame:
    """The cells that several tables hold, of one edition or of several: food_id, component_key, tables, variants of token, number and status, review_type. What
    differs in number comes before what differs in status, and that before what differs in form alone."""
    seen = values.groupBy("food_id", "component_key").agg(F.count(F.lit(1)).alias("n_tables"), F.countDistinct("token").alias("tokens"), F.countDistinct("numeric_value").alias("numbers"), F.countDistinct("value_status").alias("statuses"), F.array_join(F.array_sort(F.collect_set("table")), ";").alias("tables"))
    kind = F.when(F.col("numbers") > 1, "different_numeric_values").when(F.col("statuses") > 1, "different_origin_or_missingness_notation").when(F.col("tokens") > 1, "formatting_only_difference").otherwise("identical_repeated_record")
    return seen.where("n_tables > 1").withColumn("review_type", kind)


def audited(noted: Noted, main: str = "main") -> tuple[DataFrame, DataFrame]:
    """values with conflict (its tables disagree in number or status) and in_main (its food is in its edition's main table); and
    foods that only other tables have, which wait for an official identity."""
    known = noted.foods.where(F.col("table") == main).select("edition", "food_id").distinct().withColumn("_m", F.lit(True))
    clash = repeated(noted.values).where(F.col("review_type").isin("different_numeric_values", "different_origin_or_missingness_notation")).select("food_id", "component_key", F.lit(True).alias("_c"))
    values = noted.values.join(clash, ["food_id", "component_key"], "left").join(known, ["edition", "food_id"], "left")
    values = values.withColumn("conflict", F.col("_c").isNotNull()).withColumn("in_main", F.col("_m").isNotNull()).drop("_c", "_m")
    return values, noted.foods.join(known, ["edition", "food_id"], "left_anti")


def candidates(values: DataFrame) -> DataFrame:
    """One candidate cell of each food and component, of the first table by name: no conflict, and a food of the main table."""
    fine = values.where("candidate AND NOT conflict AND in_main")
    return fine.groupBy("food_id", "component_key").agg(F.min_by("g_per_100g", "table").alias("g_per_100g"), F.min("table").alias("table"))


def open_items(values: DataFrame, held_foods: DataFrame) -> DataFrame:
    """kind, table, food_id, component_key, token: what a reviewer has to settle, an item for each reason that holds."""
    reasons = {
        "unparsed_or_negative": F.col("value_status").isin("unparsed_requires_review", "invalid_negative"), "impossible_mass": F.col("invalid_mass"), "definition_hold": F.col("hold") != "",
        "footnote_only": F.col("value_status") == "footnote_only_value_unresolved", "tables_disagree": F.col("conflict"),
    }
    kinds = F.filter(F.array(*(F.when(c, k) for k, c in reasons.items())), lambda x: x.isNotNull())
    own = values.select(F.explode(kinds).alias("kind"), "table", "food_id", "component_key", "token")
    return own.unionByName(held_foods.select(F.lit("food_of_a_subtable_only").alias("kind"), "table", "food_id", F.lit(None).cast("string").alias("component_key"), F.lit(None).cast("string").alias("token")))
