"""Hard negatives of anchors: exact search by inner product over one-dimensional distance keys. Vectors are augmented so that inner
products become distances, stored by (nearest pivot, distance to it), and searched in rounds of wider key intervals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, grouped, materialize
from .vectors import _matrix

#: What distances are widened by, as a share of the longest vector, for their rounding.
_SLACK = 1e-6
_FOUND = "q long, span int, id long, score long"


@dataclass(frozen=True)
class _Space:
    """The vectors of one length: the squared length that all are augmented to, the pivots, and whether doubles hold all products."""

    longest: float
    pivots: np.ndarray
    exact: bool

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, self.longest - (v * v).sum(axis=1)))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)))


def _learn(sample: np.ndarray, longest: float, pivots: int, exact: bool, rounds: int = 8, seed: int = 5) -> _Space:
    """Pivots are means of the augmented sample's nearest rows (Lloyd's rounds)."""
    x = _Space(longest, sample, exact).augmented(sample)
    at = x[np.random.default_rng(seed).permutation(len(x))[:pivots]]
    for _ in range(rounds):
        near = _distances(x, at).argmin(axis=1)
        n = np.bincount(near, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return _Space(longest, at, exact)


def _numbered(df: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """df in order of columns, with _pos, its place from 0, from the sizes of ranges; and the table that holds it."""
    stored = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    sizes = stored.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    placed = stored.withColumn("_p", part).join(before, "_p").withColumn("_pos", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return placed.drop("_p", "_m", "_before"), stored


def _top(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best that fit in each row, by score and then least id, in that order."""
    least = np.iinfo(np.int64).min
    s = np.where(fits, score, least)
    if s.shape[1] > k:
        fits = fits & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None])
    r, c = np.nonzero(fits)
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def _scan(batches: Iterator[pa.RecordBatch], spaces: dict[int, _Space], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """For each pair of a block of searches and an annulus: the k best rows of each search's spans there."""
    for table in grouped(batches, "pair"):
        pair, stored = table.column("pair").to_numpy(), table.column("stored").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        for a, b in zip(first, np.append(first[1:], len(pair)), strict=True):
            cut = a + int(np.count_nonzero(~stored[a:b]))
            asks, rows = table.slice(a, cut - a), table.slice(cut, b - cut)
            if not len(asks) or not len(rows):
                continue
            length = len(asks.column("v")[0].as_py())
            space = spaces[length]
            to, reach = (asks.column(c).to_numpy() for c in ("dist", "reach"))
            dist, slack = rows.column("dist").to_numpy(), _SLACK * (1 + np.sqrt(space.longest))
            lo, hi = np.searchsorted(dist, (np.min(to - reach) - slack, np.max(to + reach) + slack))
            if hi <= lo:
                continue
            rows = rows.slice(lo, hi - lo)
            q, x = (_matrix(t.column("v")).reshape(len(t), length) for t in (asks, rows))
            score = np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64) if space.exact else q @ x.T
            (own, own_label, n_q), (ids, label) = (asks.column(c).to_numpy() for c in ("id", "label", "q")), (rows.column(c).to_numpy() for c in ("id", "label"))
            fits = ((own_label[:, None] == label) if same else (own_label[:, None] != label)) & (own[:, None] != ids)
            low, high = (_matrix(asks.column(c)) for c in ("low", "high"))
            for s in range(low.shape[1]):
                r, c = _top(score, fits & (score >= low[:, s, None]) & (score <= high[:, s, None]), ids, k)
                if len(r):
                    yield pa.RecordBatch.from_pydict({"q": n_q[r], "span": np.full(len(r), s, np.int32), "id": ids[c], "score": score[r, c]})


def _pairs(blocks: DataFrame, annuli: DataFrame) -> DataFrame:
    """block, key, annulus, near, nth, pair: by distance keys alone, the least distance that a block's searches can have from an
    annulus, and the annulus' place among the block's, nearest first. Those beyond all searches' bounds are left out."""
    near = F.greatest(F.lit(0.0), F.col("to_lo") - F.col("hi"), F.col("lo") - F.col("to_hi"))
    both = blocks.join(annuli, "key").withColumn("near", near).withColumn("far", F.col("to_hi") + F.col("hi")).where((F.col("near") <= F.col("reach")) & (F.col("far") >= F.col("inner")))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("near", "key", "annulus"))
    return both.withColumn("nth", nth).select("block", "key", "annulus", "near", "nth", F.monotonically_increasing_id().alias("pair"))


def _search(index: DataFrame, annuli: DataFrame, asks: DataFrame, spaces: dict[int, _Space], k: int, same: bool, first: int) -> DataFrame:
    """q, span, id, score, nth: for each of asks (q, block, id, label, v, n, to, low, high: distances to all pivots, and spans of
    scores) and each of its spans the k best rows of its label, or of others, best first; ties by least id.

    A round scans the annuli that are next in distance, four times as many as the last one, for the searches that they can still
    matter to. A search is at its end when no annulus is nearer than its k-th best distance (or its spans' lower ends): then
    nothing that is left can be among the best.
    """
    slack = {n: _SLACK * (1 + s.longest**0.5) for n, s in spaces.items()}
    longest = F.create_map(*(F.lit(x) for n, s in spaces.items() for x in (n, s.longest)))[F.col("n")]
    wide = F.create_map(*(F.lit(x) for n, s in slack.items() for x in (n, s)))[F.col("n")]
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    away = lambda s: F.sqrt(F.greatest(F.lit(0.0), norm + longest - 2 * s.cast("double")))
    # The lower end of a span is raised to its k-th best score once there is one.
    state = asks.withColumn("reach", away(F.array_min("low")) + wide).withColumn("inner", away(F.array_max("high")) - wide)
    keyed = state.select("block", "reach", "inner", F.posexplode("to").alias("pivot", "t"), "n").withColumn("key", F.col("n") * (1 << 20) + F.col("pivot"))
    blocks = keyed.groupBy("block", "key").agg(F.min("t").alias("to_lo"), F.max("t").alias("to_hi"), F.max("reach").alias("reach"), F.min("inner").alias("inner"))
    pairs = materialize(_pairs(blocks, annuli), "pairs")
    best, done, step = None, 0, first
    while True:
        reach = state.groupBy("block").agg(F.max("reach").alias("reach"))
        todo = pairs.where(F.col("nth") > done).join(reach, "block").where("near <= reach")
        if todo.isEmpty():
            break
        todo = todo.where(F.col("nth") <= done + step).select("block", "key", "annulus", "pair")
        rows = index.join(todo.drop("block"), ["key", "annulus"]).select("pair", F.lit(True).alias("stored"), "dist", "id", "label", "v", *(F.lit(None).cast(t).alias(c) for c, t in (("q", "long"), ("reach", "double"), ("low", "array<long>"), ("high", "array<long>"))))
        pivot = (F.col("key") % (1 << 20)).cast("int")
        mine = state.withColumn("_n", F.col("n")).join(todo, "block").where(F.floor(F.col("key") / (1 << 20)) == F.col("_n"))
        mine = mine.select("pair", F.lit(False).alias("stored"), F.element_at("to", pivot + 1).alias("dist"), "id", "label", "v", "q", "reach", "low", "high")
        dealt = rows.unionByName(mine).repartition("pair").sortWithinPartitions("pair", "stored", "dist")
        found = dealt.mapInArrow(lambda b: _scan(b, spaces, k, same), _FOUND)
        found = found if best is None else found.unionByName(best.drop("nth"))
        nth = F.row_number().over(Window.partitionBy("q", "span").orderBy(F.desc("score"), "id"))
        older, best = best, materialize(found.withColumn("nth", nth).where(F.col("nth") <= k), "best", few_files=True)
        if older is not None:
            discard(older)
        full = best.where(F.col("nth") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("span", "score"))).alias("_k"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("_k")[i.cast("int")], x)))
        state = asks.join(full, "q", "left").withColumn("low", F.when(F.col("_k").isNull(), F.col("low")).otherwise(raised)).drop("_k")
        state = state.withColumn("reach", away(F.array_min("low")) + wide)
        done, step = done + step, 4 * step
    discard(pairs)
    return best if best is not None else asks.sparkSession.createDataFrame([], _FOUND + ", nth int")


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", pivots: int = 32, annulus: int = 4096, block: int = 256, sample: int = 4096, first: int = 8, most_lengths: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: rows of an id, a label and a vector of integers (array<long>); anchor: a condition on them. Rows with a null id, label
    or vector, or a null component, take no part. Scores are integer inner products, of rows of one length only; higher ones come
    first, ties go by smaller id. An anchor's positives are the first rows of its label and another id; of each positive, the
    negatives are the first rows of other labels whose score is at least share (numerator, denominator) of the positive's and at
    most the positive's, so a positive below zero has none. Anchors that are equal in id, label and vector are one; repeated rows
    are rows like others. Products that a long may not hold are an error. An empty table, or one without anchors, gives an empty
    result; other columns are not read.

    The pivots are fitted on about `sample` vectors of each length, of least hash, and every row is indexed: by its nearest pivot and
    its distance to that, in annuli of `annulus` rows. Equal vectors are parted by id, so that a frequent one fills many annuli.
    Searches go in blocks of `block` anchors that are near to each other; a task compares a block with an annulus.
    """
    v = F.col(vector_col).cast("array<long>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).withColumn("n", F.size("v").cast("long"))
    rows = materialize(rows, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    stats = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max(norm).alias("longest"), F.max("anchor").alias("some")).limit(most_lengths + 1).collect()
    if len(stats) > most_lengths:
        raise ValueError(f"vectors of over {most_lengths} lengths")
    if any(s["longest"] >= 2.0**62 for s in stats):
        raise ValueError("inner products that a 64-bit integer may not hold")
    if not any(s["some"] for s in stats):
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    portion = F.lit(0)
    for s in stats:
        portion = F.when(F.col("n") == s["n"], min(1 << 20, 4 * sample * (1 << 20) // s["rows"] + 1)).otherwise(portion)
    some = rows.withColumn("_h", F.xxhash64("id", "v")).where(F.pmod("_h", F.lit(1 << 20)) < portion)
    drawn = some.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("_h", "id"))).where(F.col("_r") <= sample).select("v").toArrow()["v"].to_pylist()
    # A product is at most the square of the longest vector's length, so below 2^52 a double holds every partial sum.
    samples = {s["n"]: [x for x in drawn if len(x) == s["n"]] for s in stats}
    spaces = {s["n"]: _learn(np.array(samples[s["n"]], float).reshape(len(samples[s["n"]]), s["n"]), s["longest"], pivots, s["longest"] < 2.0**52) for s in stats}

    def keyed(batches: Iterator[pa.RecordBatch], ask: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for length in np.unique(n):
                part, space = batch.filter(pa.array(n == length)), spaces[int(length)]
                x = _matrix(part.column("v")).astype(float).reshape(part.num_rows, length)
                far = _distances(np.column_stack([x, np.zeros(len(x))]) if ask else space.augmented(x), space.pivots)
                near = far.argmin(axis=1)
                more = [pa.array(length * (1 << 20) + near), pa.array(far[np.arange(len(x)), near])] + ([pa.array(list(far), pa.list_(pa.float64()))] if ask else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "key", "dist", *(["to"] if ask else [])])

    kind = "id long, label long, v array<long>, n long, key long, dist double"
    index, stored = _numbered(rows.drop("anchor").mapInArrow(lambda b: keyed(b, False), kind), "index", "key", "dist", "id")
    index = index.withColumn("annulus", F.floor(F.col("_pos") / annulus)).drop("_pos")
    annuli = materialize(index.groupBy("key", "annulus").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")), "annuli", few_files=True)
    asks = rows.where("anchor").drop("anchor").dropDuplicates(["id", "label", "v"]).mapInArrow(lambda b: keyed(b, True), kind + ", to array<double>")
    asks, held = _numbered(asks, "anchors", "key", "dist", "id")
    # A block holds anchors of one length: the length is the upper part of its number.
    asks = asks.select(F.col("_pos").alias("q"), (F.col("n") * (1 << 40) + F.floor(F.col("_pos") / block)).alias("block"), "id", "label", "v", "n", "to")
    all_scores = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((-(1 << 62), "low"), (1 << 62, "high"))]
    liked = _search(index, annuli, asks.select("*", *all_scores), spaces, positives, True, first)
    # Spans of equal positives in number for each anchor: absent ones are spans that nothing fits.
    num, den = share
    spans = liked.where("score >= 0").groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("s"))
    low = F.array(*(F.coalesce(F.expr(f"({num}L * s[{i}] + {den - 1}L) div {den}L"), F.lit(1 << 62)) for i in range(1, positives + 1)))
    high = F.array(*(F.coalesce(F.col("s")[i], F.lit(-(1 << 62))) for i in range(1, positives + 1)))
    hard = _search(index, annuli, asks.join(spans, "q").select(*asks.columns, low.alias("low"), high.alias("high")), spaces, negatives, False, first)
    liked = liked.select("q", (F.col("nth") - 1).alias("span"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(liked, ["q", "span"]).join(asks.select("q", F.col("id").alias("anchor_id")), "q").select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    result = materialize(out, "negatives", few_files=True)
    for used in (rows, stored, held, annuli):
        discard(used)
    return result


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""
