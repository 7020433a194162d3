"""Joins with small tables lose no rows when those tables aren't small."""

from pyspark.sql import functions as F

from sievework.operators import catalog
from sievework.plans import parsing


def test_gap_grid_has_every_source(spark):
    sources = spark.range(1200).select(F.col("id").cast("string").alias("s"))
    seen = spark.createDataFrame([("a", "1199", 4)], "k string, s string, n long")
    grid = catalog.gap_grid(spark.createDataFrame([("a",), ("b",)], "k string"), "k", sources, "s", seen)
    assert (grid.count(), grid.distinct().count(), grid.agg(F.sum("n")).first()[0]) == (2400, 2400, 4)


def test_values_of_every_unit_stay(spark, sf_dir, monkeypatch):
    raw = spark.range(10_500).select("id", F.lit("5").alias("raw"), F.when(F.col("id") == 0, "mg/100 g").otherwise(F.concat(F.lit("unit "), "id")).alias("unit"))
    monkeypatch.setattr(parsing, "raw_values", lambda spark, sf: raw)
    out = parsing.apply_value_and_unit(spark, sf_dir)
    assert (out.count(), out.where("id = 0").first()["g_per_100g"]) == (10_500, 0.005)
