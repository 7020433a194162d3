"""Shards of near equal bytes by a k-d tree over metadata: nodes are split at weighted medians of their widest column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import dense_index, running_total
from .shared import discard, materialize

#: The columns of documents that the tree splits on.
DIMS = ("source", "lang", "n_chars")
#: Shards are nodes of a tree of which a level's rows are grouped; more than this is a mistake in units.
MOST = 1 << 20


def _coded(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Columns _d0, _d1, ... in place of dims: numbers as they are, others by their place among the distinct values; null, and
    what isn't finite, below all. Each is scaled to 0..1 by all rows' least and greatest value."""
    kinds = dict(rows.dtypes)
    for i, c in enumerate(dims):
        if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal"):
            v = F.col(c).cast("double")
            rows = rows.withColumn(f"_d{i}", F.when(F.abs(v) < float("inf"), v))
        else:
            places = dense_index(rows, c, "_at").withColumnRenamed(c, "_key")
            rows = rows.join(places, F.col(c) == F.col("_key"), "left").withColumn(f"_d{i}", F.col("_at").cast("double")).drop("_key", "_at")
    return rows.drop(*dims)


def _node_stats(rows: DataFrame, n_dims: int) -> DataFrame:
    """Of each node that is to be split: its bytes, and the widest of its columns by the share of that column's whole range."""
    edges = [f(f"_d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = rows.where("_m > 1").groupBy("_node", "_m").agg(F.sum("size").alias("_total"), *edges)
    widths = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(n_dims)]
    widest, at = widths[0], F.lit(0)
    for i, w in enumerate(widths[1:], 1):
        at, widest = F.when(w > widest, i).otherwise(at), F.greatest(widest, w)
    return stats.select("_node", "_m", "_total", at.alias("_dim"))


def placed(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = DIMS, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """id_col, size, text_crc32, shard, slot for every row of docs: `shards` shards, or as many as target_bytes asks for.

    A node of m shards is parted in two, of (m + 1) / 2 and the other shards, where its rows' bytes, in order of its widest column,
    are nearest to their shares; widths are shares of the column's whole range, and the first column of the widest is taken. Rows
    of equal values go by id (null first), then by a number of their own, so a value that most rows have is parted as well. What
    differs from equal bytes is half a document at each cut. A text's size is its UTF-8 bytes and 1, so null and blank texts weigh
    1; a null value of a column is below all others. An empty table gives an empty result. Columns beside dims, id and text are
    not read, but for `row`, a column of numbers that are different in each row, which is returned as well.

    Each level shuffles rows of a few numbers, without texts, to ranges of values; a median is found from the ranges' sums, so no
    task holds a node. Slots number a shard's rows by id from 0 in the same way.
    """
    own = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(own.alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(dims)))
    rows = materialize(rows, "sized")
    coded = _coded(rows, [f"_c{i}" for i in range(len(dims))])
    whole = coded.agg(F.sum("size").alias("n"), *(f(f"_d{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not shards:
        shards = max(1, -(-(whole["n"] or 0) // target_bytes))
    if shards > MOST:
        raise ValueError(f"over {MOST} shards")

    def scaled(i: int) -> Column:
        lo, hi = whole[f"lo{i}"], whole[f"hi{i}"]
        return F.lit(0.0) if lo is None or hi == lo else F.coalesce((F.col(f"_d{i}") - lo) / (hi - lo), F.lit(-1 / 1024))

    now = coded.withColumns({f"_d{i}": scaled(i) for i in range(len(dims))} | {"_node": F.lit(0).cast("long"), "_m": F.lit(shards).cast("long")})
    left = F.expr("(_m + 1) div 2")
    m, level = shards, None
    while m > 1:
        chosen = _node_stats(now, len(dims)).drop("_m")
        value = F.lit(0.0)
        for i in range(len(dims)):
            value = F.when(F.col("_dim") == i, F.col(f"_d{i}")).otherwise(value)
        ordered = now.join(chosen, "_node", "left").withColumn("_v", F.struct(value.alias("v"), "_id", "_row"))
        ordered = running_total(ordered, "_v", "size", ["_node"])
        # A row is left of the cut if its middle is: then the cut is where the sum is nearest to the share.
        is_left = (2 * F.col("running") - F.col("size")) * F.col("_m") <= 2 * F.col("_total") * left
        node = F.when((F.col("_m") == 1) | is_left, F.col("_node")).otherwise(F.col("_node") + left)
        size = F.when(F.col("_m") == 1, F.lit(1)).when(is_left, left).otherwise(F.col("_m") - left)
        before = level
        level = materialize(ordered.select("_row", "_id", "size", "text_crc32", *(f"_d{i}" for i in range(len(dims))), node.cast("long").alias("_node"), size.cast("long").alias("_m")), "level")
        if before is not None:
            discard(before)
        now, m = level, (m + 1) // 2
    counted = running_total(now.withColumn("_v", F.struct("_id", "_row")).withColumn("_one", F.lit(1).cast("long")), "_v", "_one", ["_node"])
    out = counted.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("_node").cast("int").alias("shard"), (F.col("running") - 1).alias("slot"), *([F.col("_row").alias(row)] if row else []))
    return out


def manifest(docs: DataFrame, dims: Sequence[str] = DIMS, bytes_col: str = "size") -> DataFrame:
    """shard, rows, bytes, and the least and greatest value of each of dims: what a reader needs to leave shards out."""
    edges = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return docs.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(bytes_col).alias("bytes"), *edges)


def write(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = DIMS, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1_000_000) -> DataFrame:
    """docs' rows as Parquet under path, a folder shard=N for each shard, in order of their slots; the manifest is returned.
    Columns `shard`, `slot` and `_row` of docs' own would clash with the folders and are an error."""
    clash = {"shard", "slot", "_row"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the shards' own")
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    where = placed(numbered, shards, target_bytes, dims, id_col, text_col, row="_row").select("_row", "shard", "slot", "size")
    out = numbered.join(where, "_row").drop("_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.drop("size").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    return manifest(back.withColumn("size", F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 1), dims)


def sql(shards: int = 16, dims: Sequence[str] = DIMS) -> str:
    """The tree as a chain of common tables, a level each."""
    number = "CASE WHEN {0} IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY {0} NULLS LAST) END"
    codes = ", ".join(f"({c if c == 'n_chars' else number.format(c)})::DOUBLE AS c{i}" for i, c in enumerate(dims))
    scaled = ", ".join(f"CASE WHEN max(c{i}) OVER () > min(c{i}) OVER () THEN coalesce((c{i} - min(c{i}) OVER ()) / (max(c{i}) OVER () - min(c{i}) OVER ()), -1.0 / 1024) ELSE 0 END::DOUBLE AS d{i}" for i in range(len(dims)))
    parts = [f"r AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text, {codes} FROM documents)", f"l0 AS MATERIALIZED (SELECT doc_id, size, text, {scaled}, 0 AS node, {shards} AS m FROM r)"]
    level, m = 0, shards
    widths = [f"(max(d{i}) OVER (PARTITION BY node) - min(d{i}) OVER (PARTITION BY node))" for i in range(len(dims))]
    value = " ".join(f"WHEN {widths[i]} = greatest({', '.join(widths)}) THEN d{i}" for i in range(len(dims)))
    keep = ", ".join(f"d{i}" for i in range(len(dims)))
    while m > 1:
        parts.append(
            f"""v{level} AS MATERIALIZED (SELECT *, CASE {value} END AS v, sum(size) OVER (PARTITION BY node) AS total FROM l{level}),
s{level} AS MATERIALIZED (SELECT *, m = 1 OR (2 * sum(size) OVER (PARTITION BY node ORDER BY v, doc_id ROWS UNBOUNDED PRECEDING) - size) * m <= 2 * total * ((m + 1) // 2) AS l FROM v{level}),
l{level + 1} AS MATERIALIZED (SELECT doc_id, size, text, {keep}, CASE WHEN l THEN node ELSE node + (m + 1) // 2 END AS node, CASE WHEN m = 1 THEN 1 WHEN l THEN (m + 1) // 2 ELSE m - (m + 1) // 2 END AS m FROM s{level})"""
        )
        level, m = level + 1, (m + 1) // 2
    # A text's CRC-32, from the table of its polynomial, made by rule.
    bit = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    parts.append(f"crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: {bit})) AS k)")
    parts.append(f"y AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: concat('0x', h)::BIGINT) AS b FROM l{level})")
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, c: xor(x >> 8, k[1 + (xor(x, c) & 255)])), 4294967295)"
    slot = "row_number() OVER (PARTITION BY node ORDER BY doc_id) - 1"
    return f"WITH {', '.join(parts)} SELECT doc_id, size::BIGINT AS size, {crc}::BIGINT AS text_crc32, 'bytes' AS law, node::INT AS shard, {slot} AS slot, NULL::INT AS grown_shard FROM y, crc"
