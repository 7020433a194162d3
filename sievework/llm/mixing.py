"""Mixing sources to target weights: a splitting tree of block quotas, then disjoint draws. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .laws import hypergeometric
from .shared import WORD, materialize


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: water-filling of total x all sizes by weight under `most` x a source's own size.

    sizes: (source, source_size), one row a source. Weights repeat over the sources by code point, null last. The level is
    found in one pass: sources in the order in which they reach their limit, with the sums over those before.
    """
    n = len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_i") % n + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.withColumn("sum_all", F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
    full = full.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = (total * F.col("sum_all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    full = full.withColumn("_level", level).withColumn("_k", F.row_number().over(order))
    full = full.withColumn("level", F.min(F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.struct("_k", "_level"))).over(everything)["_level"])
    return full.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def shard_quotas(leaves: DataFrame, quotas: DataFrame, depth: int, seed: str) -> DataFrame:
    """source, shard, quota: quotas' blocks of each source (source, quota), dealt to its shards (source, shard, blocks).

    A binary tree over shard numbers: a node with N blocks, L of them on its left, passes on to the left as many of its q quota
    blocks as fall there when q of N are taken without replacement, an exact hypergeometric draw by a hash of the node, and the
    rest to the right. So the leaves' quotas are one multivariate hypergeometric draw, and stay whole. Each leaf walks down from
    the root on its own, making its path's draws again, which are the same for all leaves below: one pass, no round a level.
    """
    paths = leaves.select("source", "shard", "blocks", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    paths = paths.withColumn("node", F.expr(f"shiftright(shard, {depth} - level)")).withColumn("on_left", F.expr(f"shiftright(shard, {depth} - 1 - level) % 2 = 0"))
    nodes = paths.groupBy(F.col("source").alias("_s"), F.col("level").alias("_level"), F.col("node").alias("_node")).agg(F.sum("blocks").alias("n"), F.sum(F.when(F.col("on_left"), F.col("blocks")).otherwise(0)).alias("left"))
    met = paths.join(nodes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_level")) & (F.col("node") == F.col("_node")))
    name = F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit(_NONE)), F.col("level").cast("string"), F.col("node").cast("string"))
    steps = met.groupBy("source", "shard").agg(F.array_sort(F.collect_list(F.struct("level", "n", "left", "on_left", name.alias("name")))).alias("path"))

    def step(q: Column, e: Column) -> Column:
        return F.transform(F.array(hypergeometric(e["n"], e["left"], q, e["name"])), lambda d: F.when(e["on_left"], d).otherwise(q - d))[0]

    dealt = steps.join(quotas.select(F.col("source").alias("_s"), "quota"), F.col("source").eqNullSafe(F.col("_s")))
    whole = F.filter("path", lambda e: e["n"] > 0)
    return dealt.select("source", "shard", F.aggregate(whole, F.col("quota"), step).alias("quota"))


#: What stands for a null in hashes.
_NONE = "(none)"


#: A prime under 2^31: products of two numbers below it, and sums with a third, are whole numbers of 64 bits.
PRIME = 2147483647


def _place(b: Column) -> Column:
    """Of block b in its shard's permutation: 62 bits, two polynomials of b modulo PRIME with a row's own coefficients, six numbers
    of its hash. Arithmetic alone, so that it costs little for each block and any engine gives the same."""

    def poly(i: int) -> Column:
        x, y, z = (F.col("coefficients")[i + j] for j in range(3))
        return ((x * b + y) % PRIME * b + z) % PRIME

    return poly(0) * PRIME + poly(3)


def _coefficients() -> Column:
    return F.array(*(F.conv(F.substring("h", 13 + 8 * i, 8), 16, 10).cast("long") % PRIME for i in range(6)))


def _depth(docs: DataFrame, depth: int | None) -> int:
    if depth is None:
        rows, depth = docs.count(), 8
        while rows >> depth > _PER_SHARD:
            depth += 1
    return depth


def _shard(depth: int) -> Column:
    return F.conv(F.substring("h", 1, 12), 16, 10).cast("long") % (1 << depth)


#: Rows of a shard at most, on average, before there are more shards.
_PER_SHARD = 1 << 14


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """row, id, source, size, h (a hash of id, source and text) and more, for each of docs; row is a number that no other row has,
    once this is written."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(_NONE)) for c in (id_col, source_col, text_col)]
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), h.alias("h"), *more)


def _planned(rows: DataFrame, depth: int, block: int, seed: str) -> tuple[DataFrame, Column]:
    """(cuts, the blocks of a row that are drawn, as a column over rows joined with their cut).

    cuts: source, shard, source_size, target, passes, and last: the place of the last block drawn in the shard's permutation.
    """
    shard = _shard(depth)
    n = F.ceil(F.col("size") / block).cast("int")
    leaves = materialize(rows.groupBy("source", shard.alias("shard")).agg(F.sum(n.cast("long")).alias("blocks"), F.sum("size").alias("size")), "shards", few_files=True)
    sources = leaves.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("n"))
    plan = targets(sources.select("source", "source_size"))
    plan = plan.join(sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    plan = materialize(plan.withColumn("quota", F.when(F.col("source_size") > 0, F.floor(F.col("n") * rest / F.col("source_size") + 0.5)).otherwise(0).cast("long")), "plan", few_files=True)
    quotas = materialize(shard_quotas(leaves, plan.select("source", "quota"), depth, seed).toDF("_s", "_shard", "quota"), "quotas", few_files=True)

    # A struct is ordered by its place, and where blocks of equal rows tie, by row.
    at = lambda b: F.struct(_place(b).alias("p"), F.col("row").alias("r"), b.alias("b"))
    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)
    spread = rows.where("size > 0").select("source", shard.alias("shard"), "row", _coefficients().alias("coefficients"), F.explode(blocks).alias("b")).select("source", "shard", at(F.col("b")).alias("at"))
    ranked = spread.withColumn("k", F.row_number().over(Window.partitionBy("source", "shard").orderBy("at")))
    met = ranked.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard"))).where(F.col("k") <= F.col("quota"))
    last = materialize(met.groupBy("_s", "_shard").agg(F.max("at").alias("last")), "last", few_files=True)
    cuts = quotas.select("_s", "_shard").join(last.toDF("_t", "_u", "last"), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_shard") == F.col("_u")), "left")
    cuts = cuts.join(plan.select("source", "source_size", "target", "passes"), F.col("_s").eqNullSafe(F.col("source"))).select("_s", "_shard", "source_size", "target", "passes", "last")
    last = F.col("last")
    before = lambda b: (_place(b) < last["p"]) | ((_place(b) == last["p"]) & (F.struct(F.col("row"), b) <= F.struct(last["r"], last["b"])))
    chosen = F.when((F.col("size") > 0) & last.isNotNull(), F.filter(blocks, before)).otherwise(F.array().cast("array<long>"))
    return materialize(cuts, "cuts", few_files=True), chosen


def _met(rows: DataFrame, cuts: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("shard", _shard(depth)).withColumn("coefficients", _coefficients()).join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int | None = None, block: int = 16, seed: str = "mix") -> DataFrame:
    """id_col, source, size, source_size, target, taken, passes, partial_blocks, shard: what the mix takes of each row.

    Each source gives `passes` whole passes over its documents, and blocks of `block` words for the rest of its target (a
    document's last block may be shorter). The rest's blocks are split among 2^depth output shards by shard_quotas(); a
    document's shard is a hash of it. In each shard its quota's blocks are the first of a random permutation of the blocks of
    all its documents, so no block is drawn twice. Without depth, there are 256 shards or more, of about 16,000 rows at most.

    Null and repeated ids are documents like others, null texts are of size 0, null sources are a source; rows equal in id,
    source and text are drawn from apart. An empty table gives an empty result; other columns are not read. A hot source is
    dealt to all shards, and nothing but numbers of a row and its blocks moves.
    """
    rows = materialize(_numbered(docs, id_col, text_col, source_col), "sizes")
    depth = _depth(rows, depth)
    cuts, chosen = _planned(rows, depth, block, seed)
    out = _met(rows, cuts, depth).withColumn("chosen", chosen)
    drawn = F.aggregate("chosen", F.lit(0).cast("long"), lambda s, b: s + F.least(F.lit(block), F.col("size") - b * block))
    taken = F.col("passes") * F.col("size") + drawn
    return out.select(F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", taken.alias("taken"), "passes", F.size("chosen").alias("partial_blocks"), "shard")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int | None = None, block: int = 16, seed: str = "mix") -> DataFrame:
    """The mix itself, with docs' columns, whatever their names: a row for each whole pass over a document, and one with its
    partial draw's words; what mixed() says of each row. n_chars, where there is one, follows the text.

    A partial draw of all blocks is the whole text; else the drawn blocks' words, in order, joined by spaces. Rows lie by output
    shard, shuffled within it: texts are written once by shard, and rows of a shard put in an order by hash after they are cut.
    """
    columns = docs.columns
    doc = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")
    depth = _depth(docs, depth)
    rows = _numbered(docs, id_col, text_col, source_col, doc).drop("row").repartition(_shard(depth))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    cuts, chosen = _planned(rows.select("row", "source", "size", "h"), depth, block, seed)
    text = F.col(f"doc.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # An array of one element, so that a text is split once and not again for each block.
    cut = F.array_join(F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform("chosen", lambda b: F.slice(w, (b * block + 1).cast("int"), F.lit(block)))))), " ")
    whole = F.array_repeat(text, F.col("passes").cast("int"))
    part = F.when(F.size("chosen") == 0, F.array().cast("array<string>")).when(F.size("chosen") * block >= F.col("size"), F.array(text)).otherwise(F.array(cut))
    met = _met(rows, cuts, depth).withColumn("chosen", chosen)
    out = met.select("doc", "shard", "h", F.posexplode(F.concat(whole, part)).alias("pass", "text"))
    out = out.sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "h", "pass"), "text")
    new = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return out.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns))
