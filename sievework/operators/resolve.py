"""Entity resolution: exact evidence maps, similarity only proposes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..tables import materialize
from .relational import dense_index, duplicates


def name_groups(df: DataFrame, key: Column, item: str) -> DataFrame:
    """key, members, the sorted items' ids joined, smallest."""
    return df.withColumn("key", key).groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(item).alias("first_item"), F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ";").alias("items"))


#: Items in a tile of a name, and pairs of tiles in a task.
_TILE, _TILE_PAIRS = 1024, 32


def _tile_pairs(members: DataFrame, key: str, item: str, tile: int) -> DataFrame:
    """key, _one (whether the tiles are the same one), _a, _b: each pair of tiles of a key. members has key, item and _m, what a
    tile holds of an item. A key's items are dealt by hash to as many tiles as it takes, so a task holds two tiles of a key, however
    many items have it; null keys and items have no pairs."""
    rows = members.where(F.col(key).isNotNull() & F.col(item).isNotNull())
    held = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_n"))
    rows = rows.join(held, key).withColumn("_t", F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("_n")).cast("int"))
    tiles = materialize(rows.groupBy(key, "_n", "_t").agg(F.collect_list("_m").alias("_a")), "tiles")
    # Tiles are small and their pairs many, so tasks are counted by pairs of tiles; Spark would join partitions by their bytes.
    n = tiles.agg(F.sum(F.col("_n") - F.col("_t"))).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // _TILE_PAIRS)
    left = tiles.select(key, "_a", F.col("_t").alias("_s"), F.explode(F.sequence("_t", F.col("_n") - 1)).alias("_t")).repartition(tasks, key, "_s", "_t")
    right = tiles.select(key, F.col("_a").alias("_b"), "_t", F.explode(F.sequence(F.lit(0), "_t")).alias("_s")).repartition(tasks, key, "_s", "_t")
    return left.join(right.hint("merge"), [key, "_s", "_t"]).select(key, (F.col("_s") == F.col("_t")).alias("_one"), "_a", "_b")


def within_name_pairs(df: DataFrame, key: str, item: str, tile: int = _TILE) -> DataFrame:
    """(key, a, b), a < b, of each name's items. For names of many items use star edges instead: graph.groups(). The rows are as many
    as there are pairs, and are made where they are read: what is shuffled are tiles of items, n^2 / tile of them for a name of n."""
    pairs = _tile_pairs(df.select(key, F.col(item).alias("_m"), item), key, item, tile)
    # The pairs inside a tile are those of each item with the later ones; transform() keeps the two explosions apart, so that no
    # more than a tile's rows wait at a time.
    own = pairs.where("_one").withColumn("_a", F.array_sort("_a"))
    own = own.select(key, F.posexplode(F.transform("_a", lambda x: x)).alias("_i", "a"), F.col("_a").alias("_b")).select(key, "a", F.explode(F.slice("_b", F.col("_i") + 2, F.size("_b"))).alias("b")).where("a < b")
    two = pairs.where("NOT _one").select(key, F.explode(F.transform("_a", lambda x: x)).alias("a"), "_b").select(key, "a", F.explode("_b").alias("b"))
    return own.unionByName(two.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def band_candidates(names: DataFrame, name: str, width: int = 4) -> DataFrame:
    """(a, b): each distinct name with the `width` names before it in order."""
    ranked = materialize(dense_index(names, name, "_r"), "ranks")
    later = ranked.select(F.col(name).alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.col("_r") + i)).alias("_r"))
    return later.join(ranked.withColumnRenamed(name, "b"), "_r").select("a", "b")


def token_block_candidates(left: DataFrame, right: DataFrame, id_col: str, words: str, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) of pairs that share a word and whose Jaccard similarity is least or more. Always candidates.

    Exact: of n words in order of rarity, two sets of that similarity share one among the first n - ceil(least n) + 1 of each, so
    only these are joined on and the most frequent words seldom meet. Pairs of ids move; words are fetched for them after.
    """
    sides = {"a": left, "b": right}
    every = left.select(words).unionByName(right.select(words)).select(F.explode(words).alias("_t"))
    df = materialize(every.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")), "words", few_files=True)

    def fronts(name: str) -> DataFrame:
        rows = sides[name].select(F.col(id_col).alias(name), F.explode(words).alias("_t")).join(df, "_t")
        ranked = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_df", "_t"))).alias("_w"))
        n = F.size("_w")
        return ranked.select(name, F.explode(F.slice("_w", F.lit(1), n - F.ceil(least * n).cast("int") + 1)).alias("_x")).select(name, F.col("_x._t").alias("_t"))

    met = fronts("a").join(fronts("b"), "_t").where("a < b").select("a", "b").distinct()
    full = met.join(left.select(F.col(id_col).alias("a"), F.col(words).alias("_wa")), "a").join(right.select(F.col(id_col).alias("b"), F.col(words).alias("_wb")), "b")
    return full.select("a", "b", jaccard(F.col("_wa"), F.col("_wb")).alias("similarity")).where(F.col("similarity") >= least)


def by_alias(items: DataFrame, item: str, alias: str, index: DataFrame, target: str, index_alias: str) -> DataFrame:
    """item, status, target: exact alias hits. One distinct target maps, several are ambiguous (target null), none is unmapped."""
    hits = items.select(item, alias).join(index.select(F.col(index_alias).alias(alias), target), alias).groupBy(item).agg(F.collect_set(target).alias("_t"))
    out = items.select(item).distinct().join(hits, item, "left")
    n = F.coalesce(F.size("_t"), F.lit(0))
    return out.select(item, F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unmapped").alias("status"), F.when(n == 1, F.element_at("_t", 1)).alias("target"))


def strict_winner(scored: DataFrame, keys: Sequence[str], target: str, score: str) -> DataFrame:
    """keys, target, score, status: the best target if no other has its score; a tie is ambiguous, and maps to nothing."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), target)
    rows = scored.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_rn = 1")
    tie = F.coalesce(F.col("_next") == F.col(score), F.lit(False))
    return rows.select(*keys, F.when(~tie, F.col(target)).alias(target), score, F.when(tie, "ambiguous").otherwise("mapped").alias("status"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, block: int = 10_000) -> DataFrame:
    """query, neighbour, similarity, rank: the k most similar others of each query by cosine, ties by id; ids are whole numbers and
    vectors of one length. Rows of null vectors are left out.

    Blocked: both sides are dealt to blocks of about `block` rows, every two blocks meet in a task as one product of matrices, and
    each keeps its k best for a query before the final rank, so that what is ranked is queries x blocks x k rows. Meant for a
    stated set of queries against all rows.
    """
    sides = [df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for df in (queries, base)]
    n_q, n_b = (max(1, -(-df.count() // block)) for df in sides)
    asked = sides[0].withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_q))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_b - 1).cast("long"))))
    known = sides[1].withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_b))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        a, b = (_unit(t["v"]) for t in (left, right))
        ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ids_b, kind="stable")
        b, ids_b = b[order], ids_b[order]
        parts = []
        for at in range(0, len(a), 256):
            own = np.round(a[at : at + 256] @ b.T, 9)
            own[ids_a[at : at + 256, None] == ids_b] = -np.inf
            # Ids rise along a row, so a stable sort gives the smaller id of equals.
            top = np.argsort(-own, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(own, top, axis=1)
            fine = score > -np.inf
            parts.append(pa.table({"query": np.repeat(ids_a[at : at + 256], fine.sum(axis=1)), "neighbour": ids_b[top[fine]], "similarity": score[fine]}))
        return pa.concat_tables(parts)

    met = asked.groupBy("q", "b").cogroup(known.groupBy("q", "b")).applyInArrow(best, "query long, neighbour long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "neighbour", "similarity", "rank")


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _at_least(own: np.ndarray, k: int, axis: int) -> np.ndarray:
    """For each row (axis 1) or column (axis 0) a bound that its k best reach: the k-th of the maxima of groups of its entries; -inf
    where there are fewer than k."""
    n, across = own.shape[axis], own.shape[1 - axis]
    if n < k:
        return np.full(across, -np.inf, own.dtype)
    wide = max(1, n // max(4 * k, 64))
    used = n // wide * wide
    tops = own[:, :used].reshape(across, wide, -1).max(axis=1) if axis else np.ascontiguousarray(own[:used].reshape(wide, -1, across).max(axis=0).T)
    return np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]


def _best_of_pairs(left: pa.Table, right: pa.Table, of_left: int, of_right: int, tile: int = 2500) -> pa.Table:
    """query, neighbour, similarity, own: for each row of left its of_left most similar rows of right (own), and for each row of
    right its of_right ones of left, ties by id; no row with itself. One product of matrices serves both. It is in single precision
    and only says which pairs can't be among the best, by more than its error; similarities are taken in double precision."""
    parts = []
    (a, ids_a), (b, ids_b) = (_by_id(t) for t in (left, right))
    rough_a, rough_b = a.astype(np.float32), b.astype(np.float32)
    # Twice the error of either of two sums of products, and what rounds to the same similarity.
    slack = np.float32(4 * (a.shape[1] + 4) * 2.0**-24 + 2e-9)
    kept: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
    least = {True: np.full(len(a), -np.inf, np.float32), False: np.full(len(b), -np.inf, np.float32)}
    for i in range(0, len(a), tile):
        for j in range(0, len(b), tile):
            own = rough_a[i : i + tile] @ rough_b[j : j + tile].T
            if np.isin(ids_a[i : i + tile], ids_b[j : j + tile]).any():
                own[ids_a[i : i + tile, None] == ids_b[j : j + tile]] = -np.inf
            for mine, at, k in ((True, i, of_left), (False, j, of_right)):
                bound = least[mine][at : at + tile]
                np.maximum(bound, _at_least(own, k, int(mine)), out=bound)
                enough = np.maximum(bound - slack, np.float32(-2))
                found = np.flatnonzero(own >= (enough[:, None] if mine else enough))
                x, y = np.divmod(found, own.shape[1])
                kept[mine].append((x + i, y + j, own.ravel()[found]) if mine else (y + j, x + i, own.ravel()[found]))
    for mine, x, y, ids, others, k in ((True, a, b, ids_a, ids_b, of_left), (False, b, a, ids_b, ids_a, of_right)):
        row, col, score = (np.concatenate(c) for c in zip(*kept.pop(mine), strict=True)) if kept[mine] else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        some = score >= least[mine][row] - slack
        row, col = row[some], col[some]
        score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[row[at : at + 50_000]], y[col[at : at + 50_000]]) for at in range(0, len(row), 50_000))])
        score = np.round(score, 9)
        # Both sides are in order of ids.
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        fine = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append(pa.table({"query": ids[row[fine]], "neighbour": others[col[fine]], "similarity": score[fine], "own": np.full(int(fine.sum()), mine)}))
    return pa.concat_tables(parts)


def _by_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, ids) in order of ids; vectors that have no direction are left out."""
    if not len(table):
        return np.empty((0, 0)), np.empty(0, np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = _unit(table["v"])
    ids = table["id"].to_numpy()
    fine = np.flatnonzero(np.isfinite(v).all(axis=1))
    fine = fine[np.argsort(ids[fine], kind="stable")]
    return v[fine], ids[fine]


def nearest_both_ways(sources: DataFrame, targets: DataFrame, id_col: str, vector: str, of_source: int, of_target: int, block: int = 20_000) -> DataFrame:
    """source, target, similarity, from_source, from_target: each source's of_source best targets and each target's of_target best
    sources; a source that is nearer to others may still be the best that a target has. Ids are whole numbers, and vectors of one
    length; those that are null, zero or not finite are left out.

    All pairs are compared: blocked as in nearest(), but each pair once for both directions.
    """
    sides = [df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for df in (sources, targets)]
    n_s, n_t = (max(1, -(-df.count() // block)) for df in sides)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = sides[0].withColumn("s", F.pmod(F.xxhash64("id"), F.lit(n_s))).withColumn("t", every(n_t))
    right = sides[1].withColumn("t", F.pmod(F.xxhash64("id"), F.lit(n_t))).withColumn("s", every(n_s))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        return _best_of_pairs(a, b, of_source, of_target)

    met = left.groupBy("s", "t").cogroup(right.groupBy("s", "t")).applyInArrow(best, "query long, neighbour long, similarity double, own boolean")
    rank = F.row_number().over(Window.partitionBy("own", "query").orderBy(F.desc("similarity"), "neighbour"))
    kept = met.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("own"), of_source).otherwise(of_target))
    source, target = (F.when(F.col("own"), F.col(x)).otherwise(F.col(y)) for x, y in (("query", "neighbour"), ("neighbour", "query")))
    both = kept.groupBy(source.alias("source"), target.alias("target"))
    return both.agg(F.max("similarity").alias("similarity"), F.max("own").alias("from_source"), F.max(~F.col("own")).alias("from_target"))


def name_grams(key: Column, low: int = 3, high: int = 5) -> Column:
    """The low- to high-grams of each word of a key, the word between two spaces, repeats included."""
    words = F.transform(F.filter(F.split(key, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of_size = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: of_size(w, n)))))


def similar_names(names: DataFrame, id_col: str, key: str, least: float = 0.78, overlap: float = 0.5, k: int = 6, bare: float = 0.4) -> DataFrame:
    """(a, b, similarity, word_overlap), a < b: pairs of which one is among the other's k most similar, ties by id, by the cosine of
    their grams' weights, least or more, and whose words overlap enough. Ids are unique; blank keys match nothing.

    Exact: a gram's weight is its count times ln((1 + names) / (1 + names with it)) + 1, scaled to length one. A name's front is its
    grams from the rarest on, until what remains is shorter than bare (at most least). Two names of a cosine of least or more share
    a gram of their fronts, so only these are joined on, and the most frequent grams never meet. The front's part of the cosine
    and the longer rest bound the whole; only pairs that may still reach least are scored in full.
    """
    rows = names.select(F.col(id_col).alias("id"), key).where(F.trim(key) != "")
    tf = rows.select("id", F.explode(name_grams(F.col(key))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    weight = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighed = tf.join(df, "gram").withColumn("w", weight)
    vectors = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "w"))).alias("g"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    vectors = vectors.withColumn("g", F.transform("g", lambda x: F.struct(x["gram"].alias("gram"), (x["w"] / F.col("_norm")).alias("w")))).drop("_norm")
    # the squared length of what is left before each gram; grams are in front while that isn't below bare squared
    rest = F.aggregate("g", F.struct(F.lit(1.0).alias("left"), F.lit(0).alias("n")), lambda s, x: F.struct(
        F.when(s["left"] >= bare * bare, s["left"] - x["w"] * x["w"]).otherwise(s["left"]).alias("left"), F.when(s["left"] >= bare * bare, s["n"] + 1).otherwise(s["n"]).alias("n")))
    vectors = materialize(materialize(vectors, "names").withColumn("_r", rest).join(rows, "id"), "fronts")
    fronts = vectors.select("id", F.sqrt(F.greatest(F.lit(0.0), F.col("_r.left"))).alias("rest"), F.explode(F.slice("g", F.lit(1), F.col("_r.n"))).alias("x")).select("id", "rest", "x.gram", "x.w")
    vectors = vectors.select("id", key, F.map_from_entries("g").alias("g"))
    a, b = (fronts.select("gram", *(F.col(c).alias(c + side) for c in ("id", "rest", "w"))) for side in "ab")
    met = a.join(b, "gram").where("ida < idb").groupBy(F.col("ida").alias("a"), F.col("idb").alias("b")).agg(F.sum(F.col("wa") * F.col("wb")).alias("_front"), F.first(F.greatest("resta", "restb")).alias("_rest"))
    met = materialize(met.where(F.col("_front") + F.col("_rest") >= least - 1e-6).select("a", "b"), "pairs")
    full = met.join(vectors.select(F.col("id").alias("a"), F.col("g").alias("_g"), F.col(key).alias("_x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("g").alias("_h"), F.col(key).alias("_y")), "b")
    dot = F.aggregate(F.map_entries("_g"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("_h", e["key"]), F.lit(0.0)))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    scored = full.select("a", "b", F.round(dot, 9).alias("similarity"), jaccard(words(F.col("_x")), words(F.col("_y"))).alias("word_overlap")).where(F.col("similarity") >= least)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "other")
    both = scored.withColumn("_s", F.explode(F.array(F.struct(F.col("a").alias("query"), F.col("b").alias("other")), F.struct(F.col("b").alias("query"), F.col("a").alias("other"))))).select("a", "b", "similarity", "word_overlap", "_s.*")
    return both.withColumn("_rn", F.row_number().over(best)).where((F.col("_rn") <= k) & (F.col("word_overlap") >= overlap)).select("a", "b", "similarity", "word_overlap").distinct()


def name_agreement(df: DataFrame, key: str, item: str, values: DataFrame, axis: str, value: str, tolerance: float = 0.05, tile: int = _TILE) -> DataFrame:
    """a, b, shared axes and those whose values are within tolerance of each other, relative to the larger, of each name's items, a < b
    (ids are whole numbers). values has a row for each item and axis, its item in the column that df names so; a pair that shares no axis has no row.

    An item's values go with it into its tile, and a pair of tiles is compared at once, so neither pairs nor what they share are
    shuffled. Only where items are in df more than once are pairs added up.
    """
    own = values.where(F.col(axis).isNotNull()).groupBy(item).agg(F.collect_list(F.struct(F.col(axis).cast("string").alias("x"), F.col(value).cast("double").alias("v"))).alias("_p"))
    members = df.select(key, item).join(own, item).select(key, item, F.struct(F.col(item).cast("long").alias("id"), F.col("_p").alias("p")).alias("_m"))
    pairs = _tile_pairs(members, key, item, tile)

    def read(tile_: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        lists = tile_.field("p")
        cells = lists.flatten()
        numbers = cells.field("v")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        return tile_.field("id").to_numpy(), row, numbers.is_valid().to_numpy(zero_copy_only=False), cells.field("x"), numbers.fill_null(0).to_numpy()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.column("_one").to_pylist()
            sides = [batch.column(c) for c in ("_a", "_b")]
            for at, same in enumerate(one):
                yield from _tile_agreement(*(read(x.slice(at, 1).flatten()) for x in sides), same, tolerance)

    found = pairs.select("_one", "_a", "_b").mapInArrow(compared, "a long, b long, shared int, agreeing int")
    out = found.select("a", "b", F.col("shared").cast("long").alias("shared"), F.col("agreeing").cast("long").alias("agreeing"))
    if duplicates(df.where(F.col(key).isNotNull() & F.col(item).isNotNull()), [item]).isEmpty():
        return out
    return out.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("agreeing").alias("agreeing"))


def _tile_agreement(a: tuple, b: tuple, same: bool, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The pairs of two tiles (ids, row, whether a number is there, axis, number), or of one with itself, that share an axis."""
    axes = pa.concat_arrays([a[3], b[3]]).dictionary_encode()
    codes, width = axes.indices.to_numpy(), len(axes.dictionary)

    def wide(side: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held, x = np.zeros((width, len(side[0])), np.float32), np.full((width, len(side[0])), np.nan)
        told = np.zeros(held.shape, bool)
        held[own, side[1]] = 1
        told[own[side[2]], side[1][side[2]]] = True
        x[own[side[2]], side[1][side[2]]] = side[4][side[2]]
        return held, x, told

    (held_a, x_a, told_a), (held_b, x_b, told_b) = wide(a, codes[: len(a[3])]), wide(b, codes[len(a[3]) :])
    # Compared in blocks that a core's cache holds. Where a number isn't there, x is NaN and nothing is near; a number that is
    # itself none is, as in SQL, above all others and equal to itself.
    none = np.isnan(x_a[told_a]).any() or np.isnan(x_b[told_b]).any()
    both = np.flatnonzero(told_a.any(1) & told_b.any(1))
    near_a, near_b, kind = tolerance * np.abs(x_a), tolerance * np.abs(x_b), np.int8 if len(both) < 128 else np.int32
    for begin in range(0, len(a[0]), 32):
        rows = slice(begin, begin + 32)
        shared = (held_a[:, rows].T @ held_b).astype(np.int32)
        agreeing, apart, limit, close = np.zeros(shared.shape, kind), np.empty(shared.shape), np.empty(shared.shape), np.empty(shared.shape, bool)
        with np.errstate(invalid="ignore"):
            for k in both:
                np.subtract(x_a[k, rows, None], x_b[k], out=apart)
                np.abs(apart, out=apart)
                np.maximum(near_a[k, rows, None], near_b[k], out=limit)
                np.less_equal(apart, limit, out=close)
                if none:
                    close |= np.isnan(limit)
                    close &= told_a[k, rows, None] & told_b[k]
                agreeing += close.view(np.int8)
        ids_a, ids_b = a[0][rows, None], b[0]
        out = [np.minimum(ids_a, ids_b), np.maximum(ids_a, ids_b), shared, agreeing.astype(np.int32)]
        kept = (shared > 0) & (ids_a < ids_b) if same else shared > 0
        out = [x.ravel() if kept.all() else x[kept] for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "shared", "agreeing"])
