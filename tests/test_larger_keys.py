"""Queries on tables whose keys run on beyond what a code or a sheet can hold, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import QUERIES, SQL, table

from sievework.sources import writers

BASES = (0, 99_960, 100_000, 203_990)


@pytest.fixture(scope="module")
def far_keys(spark, sf_dir, tmp_path_factory):
    """Twenty parts from each of some numbers on, with their order lines."""
    folder = str(tmp_path_factory.mktemp("far"))
    part, lines, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "supplier"))
    span = spark.createDataFrame([(b,) for b in BASES], "base long")
    part.where("p_partkey < 20").join(span).selectExpr("* EXCEPT (p_partkey, base)", "p_partkey + base AS p_partkey").select(part.columns).coalesce(1).write.parquet(f"{folder}/part.parquet")
    lines.where("l_partkey < 20").join(span).selectExpr("* EXCEPT (l_partkey, base)", "l_partkey + base AS l_partkey").select(lines.columns).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    supplier.coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, rel = QUERIES[name](spark, folder), con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert table(df.columns, df.collect()) == table(names, rel.fetchall())


@pytest.mark.parametrize("name", ["footnote_queue", "footnoted_axis_proposals", "footnoted_cells", "repeated_cell_reviews"])
def test_footnoted_tables_of_several_editions(spark, far_keys, name):
    same_as_sql(spark, far_keys, name)


@pytest.mark.parametrize("name", ["afcd_bundle", "cofid_bundle", "dictionary_axes"])
def test_sheets_of_several_books(spark, far_keys, name, monkeypatch):
    made, workbooks = [], writers.workbooks
    monkeypatch.setattr(writers, "workbooks", lambda cells: made.append(cells.groupBy("path").agg(F.countDistinct("row").alias("n"))) or workbooks(cells))
    same_as_sql(spark, far_keys, name)
    # No book has all rows of a sheet, of which a task would hold them.
    assert made[0].agg(F.max("n")).first()[0] < 2 * 20 + 10
