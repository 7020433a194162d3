"""Sparse matrices as rows of blocks: which cells are observed, as a bitmap, and their values; for tables of more columns than a
pivot has. A block is 32 columns, so its bitmap is one number and sums over it stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import dense_index, join_checked

WIDTH = 32
_BLOCK = "block", "observed", "values"


def column_index(cells: DataFrame, column: str) -> DataFrame:
    """column, index: the distinct columns in order, from 0, whatever their number."""
    return dense_index(cells, column, "index", first=0)


def blocked(cells: DataFrame, row: str, column: str, value: str, index: DataFrame | None = None) -> DataFrame:
    """row, block, observed, values: a row for each block of 32 columns in which a row has a cell; bit i of observed says that its
    column i is there, values holds these in order. A cell is there if its value isn't null; NaN is a value. Columns are numbers
    already, or get theirs from index (column, index), where one that it doesn't have is an error. A cell that is there twice is an
    error too, as a sum over blocks would count it twice."""
    rows = cells.where(F.col(value).isNotNull())
    if index is not None:
        rows = join_checked(rows, index.withColumnRenamed("index", "_at"), [column])
        rows = rows.withColumn("_at", F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("a column without a place: "), F.col(column).cast("string"))).cast("long")).otherwise(F.col("_at")))
    else:
        rows = rows.withColumn("_at", F.col(column).cast("long"))
    rows = rows.withColumn("_at", F.when(F.col("_at") < 0, F.raise_error(F.lit("a column below 0")).cast("long")).otherwise(F.col("_at")))
    bit = (F.col("_at") % WIDTH).cast("int")
    rows = rows.select(row, F.floor(F.col("_at") / WIDTH).alias("block"), bit.alias("_b"), F.col(value).cast("double").alias("_v"))
    out = rows.groupBy(row, "block").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("observed"), F.array_sort(F.collect_list(F.struct("_b", "_v"))).alias("_c"))
    twice = F.raise_error(F.concat(F.lit("a cell that is there twice, in row "), F.col(row).cast("string"))).cast("array<double>")
    return out.select(row, "block", "observed", F.when(F.size("_c") == F.bit_count("observed"), F.transform("_c", lambda c: c["_v"])).otherwise(twice).alias("values"))


def _bits(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.getbit(mask, i) == 1)


def _at(observed: Column, values: Column, i: Column) -> Column:
    """The value of bit i, which must be set: as many set bits stand below it as values before it."""
    below = F.bit_count(observed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1))
    return F.get(values, below)


def cells(matrix: DataFrame, row: str) -> DataFrame:
    """row, column (a number), value of each cell: blocked() undone."""
    pairs = F.arrays_zip(_bits(F.col("observed")).alias("i"), F.col("values").alias("v"))
    return matrix.select(row, "block", F.explode(pairs).alias("_p")).select(row, (F.col("block") * WIDTH + F.col("_p.i")).alias("column"), F.col("_p.v").alias("value"))


def withdrawn(matrix: DataFrame, row: str, hidden: DataFrame) -> DataFrame:
    """The matrix without the cells that hidden (row, block, observed) marks; blocks that are left empty go. A join of bitmaps."""
    h = hidden.select(row, "block", F.col("observed").alias("_h"))
    out = matrix.join(h, [row, "block"], "left").withColumn("_keep", F.col("observed").bitwiseAND(F.bitwise_not(F.coalesce("_h", F.lit(0).cast("long")))))
    kept = F.transform(_bits(F.col("_keep")), lambda i: _at(F.col("observed"), F.col("values"), i))
    # Two steps: a name given in a select is seen by lambdas beside it before the column of that name is.
    out = out.where("_keep <> 0").withColumn("_values", kept)
    return out.select(row, "block", F.col("_keep").alias("observed"), F.col("_values").alias("values"))


def masked_error(true: DataFrame, predicted: DataFrame, row: str, mask: DataFrame | None = None) -> DataFrame:
    """block, n, squared, absolute: over the cells that both matrices have, and mask (row, block, observed) marks: sums of errors
    by block of columns. Blocks meet as blocks; a cell is never a row of its own."""
    p = predicted.select(row, "block", F.col("observed").alias("_po"), F.col("values").alias("_pv"))
    both = true.join(p, [row, "block"])
    common = F.col("observed").bitwiseAND(F.col("_po"))
    if mask is not None:
        both = both.join(mask.select(row, "block", F.col("observed").alias("_m")), [row, "block"])
        common = common.bitwiseAND(F.col("_m"))
    both = both.withColumn("_d", F.transform(_bits(common), lambda i: _at(F.col("observed"), F.col("values"), i) - _at(F.col("_po"), F.col("_pv"), i)))
    total = lambda f: F.sum(F.aggregate("_d", F.lit(0.0), lambda a, x: a + f(x)))
    return both.groupBy("block").agg(F.sum(F.size("_d")).cast("long").alias("n"), total(lambda x: x * x).alias("squared"), total(F.abs).alias("absolute"))


def dense_blocks(matrix: DataFrame, row: str) -> DataFrame:
    """row, block, x, seen: each block's 32 values, 0 where it has none, and whether it has: what a model reads, block by block."""
    places = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    has = lambda i: F.getbit(F.col("observed"), i) == 1
    x = F.transform(places, lambda i: F.when(has(i), _at(F.col("observed"), F.col("values"), i)).otherwise(0.0))
    return matrix.select(row, "block", x.alias("x"), F.transform(places, lambda i: has(i).cast("double")).alias("seen"))


def model_rows(items: DataFrame, item: str, parts: dict[str, DataFrame]) -> DataFrame:
    """items with an array of blocks (block, observed, values) for each named matrix, empty where it has none: the wide table of a
    model, whose columns are blocks' bits. Items must be told apart by item; a matrix's row without its item is an error."""
    out = items
    for name, matrix in parts.items():
        lost = matrix.join(items.select(item), item, "left_anti").select(item).limit(1).collect()
        if lost:
            raise ValueError(f"{name} has a row without its item: {lost[0][0]}")
        own = matrix.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(*_BLOCK))).alias(name))
        out = join_checked(out, own, [item], validate="one_to_one").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def target_cells(long: DataFrame, value: str, percent: Column | None = None) -> DataFrame:
    """long with its values as targets: percents as shares, log1p of all; null and NaN go, and a negative one is an error."""
    x = F.col(value).cast("double")
    share = x if percent is None else F.when(percent, x / 100.0).otherwise(x)
    told = F.raise_error(F.concat(F.lit("a negative target: "), x.cast("string"))).cast("double")
    return long.where(x.isNotNull() & ~F.isnan(x)).withColumn(value, F.when(x < 0, told).otherwise(F.log1p(share)))

