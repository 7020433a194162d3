"""Denial constraints as data. All row constraints of a table are found in one scan of it, whatever their number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = ("row", "unique", "reference", "covers", "order", "total")


@dataclass(frozen=True)
class Constraint:
    """What must not be. kind:

    row: `deny`, an SQL condition, holds of a row; unique: rows share `columns`; reference: `columns` aren't in `other`'s
    `other_columns`; covers: `other` has keys that aren't here; order: within `columns`, `deny` (a column of numbers) isn't 1, 2, ...
    once each; total: of all rows, `deny`, an SQL condition over aggregates, holds. where: the rows that it is about.
    """

    name: str
    table: str
    kind: str
    deny: str = ""
    columns: tuple[str, ...] = ()
    other: str = ""
    other_columns: tuple[str, ...] = ()
    where: str = "true"
    severity: str = "critical"

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"unknown kind {self.kind}")


def _key(columns: Sequence[str]):
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in columns))


def _row_violations(df: DataFrame, checks: Sequence[Constraint], id_cols: Sequence[str]) -> DataFrame:
    """One scan: each row's broken constraints, as an array of names, and a row for each of them."""
    broken = F.array_compact(F.array(*(F.when(F.expr(f"({c.where}) AND ({c.deny})"), F.lit(c.name)) for c in checks)))
    return df.select(F.explode(broken).alias("constraint"), _key(id_cols).alias("key"), F.lit(1).cast("long").alias("rows"))


def _grouped(df: DataFrame, c: Constraint, tables: dict[str, DataFrame]) -> DataFrame:
    rows = df.where(c.where)
    if c.kind == "unique":
        out = rows.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        return out.select(F.lit(c.name).alias("constraint"), _key(c.columns).alias("key"), "rows")
    if c.kind == "order":
        n = F.col("rows")
        numbers = rows.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("rows"), F.min(c.deny).alias("_lo"), F.max(c.deny).alias("_hi"), F.countDistinct(c.deny).alias("_d"))
        return numbers.where((F.col("_d") != n) | (F.col("_lo") != 1) | (F.col("_hi") != n)).select(F.lit(c.name).alias("constraint"), _key(c.columns).alias("key"), "rows")
    if c.kind == "total":
        return rows.agg(F.expr(c.deny).alias("_bad"), F.count(F.lit(1)).alias("rows")).where("_bad").select(F.lit(c.name).alias("constraint"), F.lit("(all)").alias("key"), "rows")
    here = rows.groupBy(*(F.col(x).alias(f"k{i}") for i, x in enumerate(c.columns))).agg(F.count(F.lit(1)).alias("rows"))
    there = tables[c.other].groupBy(*(F.col(x).alias(f"k{i}") for i, x in enumerate(c.other_columns or c.columns))).agg(F.count(F.lit(1)).alias("rows"))
    keys = [f"k{i}" for i in range(len(c.columns))]
    left, right = (here, there) if c.kind == "reference" else (there, here)
    lost = left.join(right, keys, "left_anti")
    return lost.select(F.lit(c.name).alias("constraint"), _key(keys).alias("key"), "rows")


def violations(tables: dict[str, DataFrame], constraints: Sequence[Constraint], id_cols: dict[str, Sequence[str]]) -> DataFrame:
    """constraint, key, rows of everything that breaks a constraint: rows by their table's id_cols, groups by their columns. A
    constraint that evaluates to null isn't broken, as in SQL."""
    parts = []
    for name in dict.fromkeys(c.table for c in constraints):
        own = [c for c in constraints if c.table == name]
        by_row = [c for c in own if c.kind == "row"]
        if by_row:
            parts.append(_row_violations(tables[name], by_row, id_cols[name]))
        parts += [_grouped(tables[name], c, tables) for c in own if c.kind != "row"]
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """constraint, severity, violations, rows, passed for every constraint, those that nothing breaks as well."""
    known = found.sparkSession.createDataFrame([(c.name, c.severity) for c in constraints], "constraint string, severity string")
    counted = found.groupBy("constraint").agg(F.count(F.lit(1)).alias("violations"), F.sum("rows").alias("rows"))
    out = known.join(counted, "constraint", "left").fillna(0, ["violations", "rows"])
    return out.withColumn("passed", F.col("violations") == 0)


def require(tables: dict[str, DataFrame], constraints: Sequence[Constraint], id_cols: dict[str, Sequence[str]], most: int = 20) -> None:
    """An error that names what breaks critical constraints, `most` of them; nothing if none is broken."""
    critical = [c for c in constraints if c.severity == "critical"]
    found = violations(tables, critical, id_cols).limit(most).collect() if critical else []
    if found:
        raise ValueError("constraints are broken: " + "; ".join(f"{r['constraint']} by {r['key']}" for r in found))


#: What a final panel of axes must be: one name and one id for each, all required fields, and stages that are known.
PANEL = [
    Constraint("one_name", "panel", "unique", columns=("canonical_name",)),
    Constraint("one_id", "panel", "unique", columns=("target_axis_id",)),
    Constraint("fields", "panel", "row", "canonical_name IS NULL OR trim(canonical_name) = '' OR axis_family IS NULL OR target_aliases IS NULL"),
    Constraint("in_draft", "panel", "reference", columns=("canonical_name",), other="draft", where="selection_tier = 'nutrition_core'"),
    Constraint("draft_kept", "panel", "covers", columns=("canonical_name",), other="draft"),
    Constraint("not_excluded", "panel", "row", "measurement_modality IN ('energy', 'activity_equivalent', 'relative_fraction')"),
]


def finalised(panel: DataFrame, draft: DataFrame, constraints: Sequence[Constraint] = tuple(PANEL)) -> tuple[DataFrame, DataFrame]:
    """The panel in order of stage, family and name, and its summary by tier, stage and family; broken constraints are an error."""
    require({"panel": panel, "draft": draft}, constraints, {"panel": ["target_axis_id"], "draft": ["canonical_name"]})
    counts = panel.groupBy("selection_tier", "recommended_training_stage", "axis_family").agg(F.count(F.lit(1)).alias("axis_count"))
    return panel.orderBy("recommended_training_stage", "axis_family", "canonical_name"), counts
