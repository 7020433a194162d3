"""Component dictionaries of released workbooks and tables: where each begins, which of its columns say what, as a table of layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import ascii_label_key

_SAYS = ("name", "local", "tag", "unit", "eurofir", "definition", "method", "ident")


@dataclass(frozen=True)
class Dictionary:
    """A kind of dictionary sheet. sheets: pattern of their names; begin: pattern over a row's cells, joined by ` | ` in lower case;
    the first of the first 30 rows that it is found in holds the headers. rows: each row below is a component, and name, local, tag,
    unit, eurofir, definition, method and ident are patterns of the lower-cased headers, of which the first column that fits counts;
    columns: each header is a component itself, but for those in others; split: pattern of a header's code and unit. code: pattern
    of what of a tag is a code, if a tag may hold more. skip: names that are no components."""

    source: str
    sheets: str
    begin: str
    kind: str = "rows"
    name: str = ""
    local: str = ""
    tag: str = ""
    unit: str = ""
    eurofir: str = ""
    definition: str = ""
    method: str = ""
    ident: str = ""
    others: str = ""
    split: str = ""
    code: str = ""
    skip: str = ""


_NAMES = {"name": "component name|^ *nutrients *$", "tag": "tagname", "unit": "^ *unit *$", "definition": "definition", "code": "^([A-Za-z0-9_:-]+)"}
#: How the released workbooks name their sheets and headers. `*` stands for sources that no other row is about.
DICTIONARIES = [
    Dictionary("ciqual_2025", "^INFOODS codes$", "infdstag", name="^const_nom_eng$", local="^const_nom_fr$", tag="^infdstag$"),
    Dictionary("frida_6_1", "^Parameter$", "parametername", name="^parametername$", local="^parameternavn$", unit="^unit$", ident="^parameterid$"),
    Dictionary("cofid_2021", r"^1\.\d+", "food code", "columns", others="food code|food name|description|group|previous|main data references|notes"),
    Dictionary("afcd_release_3", "^(?i)(?!contents$)", r"(^|\| )component( \||$)", name="^ *component *$", tag="infoods", unit="^ *units? *$", definition="description", method="analytical method"),
    Dictionary("bls_4_0", "", "component", name="english|bezeichnung", unit="unit", ident="component code|^id$|^nr$"),
    Dictionary("lesotho_fct_2006", "^reference DB$", "foodname", "columns", others="code|progress|type|priorityclass|foodname|long foodname|scientific name|edible", split="^([A-Za-z0-9_]+)--?(.+)$"),
    *(Dictionary(f"smiling_{c}_2013", "(?i)component|tagname", "component name|nutrients.*tagname|tagname.*nutrients", **_NAMES) for c in ("cambodia", "indonesia", "laos", "thailand", "vietnam")),
    Dictionary("*", "(?i)component|nutrient|parameter|detail", "(component|parameter|nutrient).*(unit|infoods|eurofir)|(unit|infoods|eurofir).*(component|parameter|nutrient)", name="component|parameter|nutrient", tag="infoods", unit="^ *(unit|units|unité) *$", eurofir="eurofir", definition="definition|description|method", skip="^(?i)(nan|component|nutrient)$"),
]


def _axis(rows: DataFrame) -> DataFrame:
    """source_axis_id and the columns that it is made of; literal repeats within a source and place are one row."""
    keys = ["source_key", "source_component_id", "original_name", "raw_unit", "table_locator"]
    rows = rows.withColumn("source_axis_id", stable_id("source_axis", *(F.col(c) for c in keys)))
    return rows.dropDuplicates(keys)


def _clean(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin("nan", "none", "<na>"), "").otherwise(text)


def sheet_axes(cells: DataFrame, dictionaries: Sequence[Dictionary] = tuple(DICTIONARIES)) -> DataFrame:
    """The source axes of the workbooks' cells (source_key, path, sheet, row, col, text), all sources in one pass: headers are found by
    one aggregation over first rows, columns by their headers, rows by joins on the sheet. A sheet without a header row has none."""
    spark = cells.sparkSession
    table = spark.createDataFrame([tuple(asdict(d).values()) for d in dictionaries], ", ".join(f"`{f.name}` string" for f in fields(Dictionary)))
    named = [d.source for d in dictionaries if d.source != "*"]
    layout = table.select(F.col("source").alias("_source"), F.struct(*(f.name for f in fields(Dictionary))).alias("l"))
    cells = cells.withColumn("text", _clean(F.col("text"))).where("text <> ''")
    own = cells.withColumn("_source", F.when(F.col("source_key").isin(*named), F.col("source_key")).otherwise("*"))
    at = own.join(F.broadcast(layout), "_source").drop("_source").where(F.expr("sheet RLIKE l.sheets"))
    place = ["source_key", "path", "sheet"]
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.lower("text").alias("t")))), lambda x: x["t"]), " | ")
    lines = at.where("row < 30").groupBy(*place, "row").agg(F.first("l").alias("l"), line.alias("line"))
    begin = lines.where(F.expr("line RLIKE l.begin")).groupBy(*place).agg(F.min("row").alias("_head"))
    at = at.join(begin, place)
    headers = at.where("row = _head").select(*place, "col", F.col("text").alias("header"), "l", "_head")
    in_columns = headers.where("l.kind = 'columns'").where(~F.array_contains(F.transform(F.split("l.others", r"\|"), ascii_label_key), ascii_label_key(F.col("header"))) & ~F.lower("header").startswith("unnamed"))
    split = F.expr("l.split <> '' AND header RLIKE l.split")
    by_column = in_columns.select(
        *place, F.when(split, F.expr("regexp_extract(header, l.split, 1)")).when(F.col("l.split") != "", F.col("header")).otherwise(F.concat_ws(":", "sheet", F.lit("column"), (F.col("col") + 1).cast("string"))).alias("source_component_id"),
        F.col("header").alias("original_name"), F.when(split, F.expr("regexp_extract(header, l.split, 2)")).otherwise("").alias("raw_unit"), *(F.lit("").alias(c) for c in ("original_name_local", "infoods_tag", "eurofir_id", "source_definition", "method")), F.lit("extracted_column_dictionary").alias("status"),
    )
    low = F.lower("header")
    first = [F.min(F.when((F.col(f"l.{r}") != "") & F.expr(f"lower(header) RLIKE l.{r}"), F.col("col"))).alias(f"_{r}") for r in _SAYS]
    roles = headers.where("l.kind = 'rows'").withColumn("low", low).groupBy(*place).agg(F.first("l").alias("l2"), *first)
    body = at.where("l.kind = 'rows' AND row > _head").select(*place, "row", "col", "text").join(roles, place)
    said = body.groupBy(*place, "row").agg(F.first("l2").alias("l"), *(F.coalesce(F.max(F.when(F.col("col") == F.col(f"_{r}"), F.col("text"))), F.lit("")).alias(r) for r in _SAYS))
    said = said.where((F.col("name") != "") & ~F.expr("l.skip <> '' AND name RLIKE l.skip"))
    tag = F.when(F.col("l.code") != "", F.upper(F.expr("regexp_extract(tag, l.code, 1)"))).otherwise(F.col("tag"))
    ident = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("ident", "tag")), F.concat_ws(":", "sheet", F.lit("row"), (F.col("row") + 1).cast("string")))
    by_row = said.select(*place, ident.alias("source_component_id"), F.col("name").alias("original_name"), F.col("unit").alias("raw_unit"), F.col("local").alias("original_name_local"), tag.alias("infoods_tag"), F.col("eurofir").alias("eurofir_id"), F.col("definition").alias("source_definition"), "method", F.lit("extracted").alias("status"))
    out = by_row.unionByName(by_column).withColumn("table_locator", F.concat_ws(":", "path", "sheet")).drop("path", "sheet")
    return _axis(out.withColumn("value_availability", F.lit("food_value_table_present")))


def table_axes(source: str, rows: DataFrame, columns: Mapping[str, str], locator: str, availability: str = "food_value_table_present") -> DataFrame:
    """The source axes of a table, whose columns are named by what they say (SQL expressions by axis column)."""
    known = ("source_component_id", "original_name", "raw_unit", "original_name_local", "infoods_tag", "eurofir_id", "source_definition", "method")
    out = rows.select(F.lit(source).alias("source_key"), *(_clean(F.expr(f"cast({columns[c]} AS string)")).alias(c) if c in columns else F.lit("").alias(c) for c in known), F.lit("extracted").alias("status"), F.lit(locator).alias("table_locator"), (F.expr(columns["value_availability"]) if "value_availability" in columns else F.lit(availability)).alias("value_availability"))
    return _axis(out.where("original_name <> ''"))


def availability(content: DataFrame, kind: str, ident: str, numbers: Sequence[str], bounds: Sequence[str]) -> DataFrame:
    """kind, ident, availability: the best that a component's contents say: a number, else bounds alone, else an association. One
    aggregation over all contents; components without contents have no row, and are definitions only."""
    numeric = F.coalesce(*(F.col(c).cast("string").try_cast("double") for c in numbers)).isNotNull()
    bounded = F.coalesce(*(F.col(c).cast("string").try_cast("double") for c in bounds)).isNotNull()
    seen = content.where(F.col(ident).isNotNull()).groupBy(F.lower(F.trim(kind)).alias("kind"), F.col(ident).cast("string").alias("ident")).agg(F.max(numeric).alias("_n"), F.max(~numeric & bounded).alias("_r"))
    best = F.when(F.col("_n"), "food_numeric_measurement_present").when(F.col("_r"), "food_range_only_measurement_present").otherwise("food_association_without_quantified_value")
    return seen.select("kind", "ident", best.alias("availability"))


#: The syntax of identifiers.
SYNTAX = {"inchi": "^InChI=1S?/", "inchikey": "^[A-Z]{14}-[A-Z]{10}-[A-Z]$", "cas_number": r"^\d{2,7}-\d{2}-\d$"}


def by_syntax(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """rows with inchi, inchikey and cas_number from the columns named, each only where it has the form of one; what hasn't stays in
    raw_identifiers. For tables whose headers have drifted from their columns."""
    value = {k: _clean(F.col(c).cast("string")) for k, c in columns.items()}
    value = {k: F.upper(v) if k == "inchikey" else v for k, v in value.items()}
    fits = {k: v.rlike(SYNTAX[k]) for k, v in value.items()}
    raw = F.concat_ws("; ", *(F.when((v != "") & ~fits[k], F.concat(F.lit(f"raw_{k}:"), v)) for k, v in value.items()))
    return rows.withColumns({k: F.when(fits[k], v).otherwise("") for k, v in value.items()} | {"raw_identifiers": raw})
