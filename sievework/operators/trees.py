"""Regression forests of many axes at once: histogram trees of all axes grown a level at a time, a job for each level."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, materialize

#: Rows that a task handles at once, and cells of its histograms.
_ROWS, _CELLS = 1 << 17, 1 << 21


@dataclass
class Forest:
    """Trees of all axes. Nodes are numbered from 1, children 2n and 2n + 1; feature is -1 in a leaf; a row goes left if its value
    is at most cuts[feature][cut]. value is a node's mean in steps of 1 / scale of its axis."""

    axes: list[str]
    cuts: list[np.ndarray]
    trees: int
    depth: int
    bagged: bool
    scale: np.ndarray
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.axes), self.trees, 2 << self.depth)
        self.feature, self.cut = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.total, self.weight = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def nodes(self, axis: np.ndarray, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        node, row = np.ones(len(axis), np.int64), np.arange(len(axis))
        for _ in range(self.depth):
            f = self.feature[axis, tree, node]
            right = bins[row, np.maximum(f, 0)] > self.cut[axis, tree, node]
            node = np.where(f < 0, node, 2 * node + right)
        return node

    def weights(self, key: np.ndarray, tree: int) -> np.ndarray:
        """How often a tree's sample has each row: once, or, bagged, by a Poisson law of mean one from the row's own hash."""
        if not self.bagged:
            return np.ones(len(key), np.int64)
        x = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (x ^ (x >> np.uint64(31))) / 2.0**64
        chances = np.exp(-1) / np.cumprod(np.maximum(1, np.arange(9)))
        return np.searchsorted(np.cumsum(chances), u, side="right").astype(np.int64)

    def predicted(self, axis: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(axis))
        for t in range(self.trees):
            node = self.nodes(axis, t, bins)
            out += self.total[axis, t, node] / np.maximum(1, self.weight[axis, t, node])
        return out / self.trees / self.scale[axis]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(table), -1)
    return table.column("axis").to_numpy(), bins


def _histograms(forest: Forest, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, f, bin, w, wy: of the rows in each open node of the level, by feature and bin. A group is an axis, a tree and a node."""
    first, n_bins = 1 << level, max(len(c) for c in forest.cuts) + 1
    for table in _chunks(batches):
        axis, bins = _columns(table)
        y, key = table.column("y").to_numpy(), table.column("key").to_numpy()
        for t in range(forest.trees):
            w, node = forest.weights(key, t), forest.nodes(axis, t, bins)
            here = np.flatnonzero((w > 0) & (node >= first))
            if not len(here):
                continue
            group = (axis[here] * forest.trees + t) * first + node[here] - first
            order = np.argsort(group, kind="stable")
            here, group = here[order], group[order]
            names, own = np.unique(group, return_inverse=True)
            per = max(1, _CELLS // (bins.shape[1] * n_bins))
            for lo in range(0, len(names), per):
                a, b = np.searchsorted(own, (lo, lo + per))
                at = here[a:b]
                cell = ((own[a:b] - lo)[:, None] * bins.shape[1] + np.arange(bins.shape[1])) * n_bins + bins[at]
                size = min(per, len(names) - lo) * bins.shape[1] * n_bins
                # Sums of whole numbers below 2^53 are exact in doubles: a chunk's targets are below 2^24 each.
                sw = np.bincount(cell.ravel(), np.repeat(w[at], bins.shape[1]), size)
                sy = np.bincount(cell.ravel(), np.repeat(w[at] * y[at], bins.shape[1]), size)
                got = np.flatnonzero(sw)
                g, rest = np.divmod(got, bins.shape[1] * n_bins)
                f, x = np.divmod(rest, n_bins)
                yield pa.RecordBatch.from_pydict({"group": names[g + lo], "f": f.astype(np.int32), "bin": x.astype(np.int32), "w": sw[got].astype(np.int64), "wy": sy[got].astype(np.int64)})


def _splits(sums: DataFrame, least: int, share: float, per_axis: int, hidden: DataFrame | None) -> DataFrame:
    """group, n, s, and of its best split f, bin, wl, sl (null if none is better than no split). Least squares; ties by feature and cut."""
    axis = F.floor(F.col("group") / per_axis)
    open_ = sums.withColumn("_axis", axis)
    if hidden is not None:
        open_ = open_.join(hidden, (F.col("_axis") == F.col("_hidden_axis")) & (F.col("f") == F.col("_hidden_f")), "left_anti")
    if share < 1:
        open_ = open_.where(F.pmod(F.xxhash64("group", "f"), F.lit(1 << 20)) < int(share * (1 << 20)))
    w = Window.partitionBy("group", "f")
    up = w.orderBy("bin")
    cum = open_.select("group", "f", "bin", F.sum("w").over(up).alias("wl"), F.sum("wy").over(up).alias("sl"), F.sum("w").over(w).alias("n"), F.sum("wy").over(w).alias("s"))
    square = lambda s, n: F.col(s).cast("double") * F.col(s).cast("double") / F.col(n)
    rest = cum.withColumn("wr", F.col("n") - F.col("wl")).withColumn("sr", F.col("s") - F.col("sl")).where((F.col("wl") >= least) & (F.col("wr") >= least))
    gain = square("sl", "wl") + square("sr", "wr")
    better = rest.withColumn("gain", gain).where(gain > square("s", "n") * (1 + 1e-12))
    best = better.groupBy("group").agg(F.max_by(F.struct("f", "bin", "wl", "sl"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("b"))
    every = sums.where("f = 0").groupBy("group").agg(F.sum("w").alias("n"), F.sum("wy").alias("s"))
    return every.join(best, "group", "left").select("group", "n", "s", "b.*")


def cut_points(rows: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """For each place of the arrays, at most bins - 1 values that part its values evenly; a value that many rows have is one of them."""
    asked = [i / (bins - 1) for i in range(1, bins - 1)]
    long = rows.select(F.posexplode(features).alias("f", "x"))
    found = long.groupBy("f").agg(F.percentile_approx("x", asked, 20_000).alias("cuts"), F.min("x").alias("lo")).collect()
    cuts = {r["f"]: np.unique([r["lo"], *r["cuts"]]) for r in found}
    return [cuts[i] for i in range(len(cuts))]


def binned(rows: DataFrame, features: str, cuts: Sequence[np.ndarray], columns: Sequence[str]) -> DataFrame:
    """columns and bins, a byte for each feature: how many of its cuts lie below its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(cuts)))
            b = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([r.tobytes() for r in b], pa.binary())], [*columns, "bins"])

    kinds = dict(rows.dtypes)
    return rows.select(*columns, F.col(features).cast("array<double>").alias(features)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "bins binary"]))


def grow(rows: DataFrame, axes: Sequence[str], cuts: Sequence[np.ndarray], trees: int = 20, depth: int = 5, least: int = 3, share: float = 1.0, bagged: bool = True, hidden: DataFrame | None = None, most_nodes: int = 1 << 22) -> Forest:
    """A forest for each of axes from rows (axis, item's key, y, bins): axis is a place in axes, key a hash of the item.

    Each level is one scan of rows: tasks lead them down the trees so far and sum histograms, which are added up by group and
    feature; best splits are picked by windows over bins. So jobs grow with depth, not with axes or trees. The driver and the
    tasks hold the trees, at most most_nodes nodes, or it is an error. hidden (axis, f): features that an axis doesn't see; share:
    of the others, those that a node looks at, by hash. Targets are whole steps of about 2^-24 of their axis's largest, so sums
    are exact and the same trees grow whatever the order of rows.
    """
    if len(axes) * trees * (2 << depth) > most_nodes:
        raise ValueError(f"over {most_nodes} nodes")
    top = {r[0]: r[1] for r in rows.groupBy("axis").agg(F.max(F.abs("y"))).collect()}
    scale = np.array([2.0 ** (24 - np.ceil(np.log2(t + 1))) if (t := top.get(i) or 0) > 0 else 1.0 for i in range(len(axes))])
    forest = Forest(list(axes), list(cuts), trees, depth, bagged, scale)
    if not cuts:
        raise ValueError("no features")
    steps = F.element_at(F.array(*(F.lit(float(s)) for s in scale)), F.col("axis").cast("int") + 1)
    whole = materialize(rows.select("axis", "key", F.round(F.col("y") * steps).cast("long").alias("y"), "bins"), "binned")
    unseen = None if hidden is None else hidden.toDF("_hidden_axis", "_hidden_f")
    for level in range(depth + 1):
        sums = whole.mapInArrow(lambda b, f=forest, n=level: _histograms(f, n, b), "group long, f int, bin int, w long, wy long")
        sums = materialize(sums.groupBy("group", "f", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")), "histograms", few_files=True)
        open_nodes = 0
        for r in _splits(sums, least, share, trees << level, unseen).toLocalIterator():
            path, node = divmod(r["group"], 1 << level)
            at = (path // trees, path % trees, node + (1 << level))
            forest.total[at], forest.weight[at] = r["s"], r["n"]
            if r["f"] is not None and level < depth:
                forest.feature[at], forest.cut[at] = r["f"], r["bin"]
                open_nodes += 1
        discard(sums)
        if not open_nodes:
            break
    discard(whole)
    return forest


def node_table(spark, forest: Forest) -> DataFrame:
    """axis, tree, node, feature, cut (the value), n, mean of every node that rows came to."""
    rows = []
    for a, t, n in zip(*np.nonzero(forest.weight), strict=True):
        f = int(forest.feature[a, t, n])
        mean = float(forest.total[a, t, n] / forest.weight[a, t, n] / forest.scale[a])
        rows.append((forest.axes[a], int(t), int(n), f if f >= 0 else None, float(forest.cuts[f][forest.cut[a, t, n]]) if f >= 0 else None, int(forest.weight[a, t, n]), mean))
    return spark.createDataFrame(rows, "axis string, tree int, node int, feature int, cut double, n long, mean double")


def predict(rows: DataFrame, forest: Forest, columns: Sequence[str]) -> DataFrame:
    """columns and predicted, for rows (axis, bins, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            axis, bins = _columns(table)
            arrays = [table.column(c).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(forest.predicted(axis, bins))], [*columns, "predicted"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "predicted double"]))


def assembled(items: DataFrame, item: str, columns: Sequence[str], cells: DataFrame, axis: str, value: str, axes: Sequence[str], masked: DataFrame | None = None, vector: str | None = None) -> DataFrame:
    """item, features: the item's vector (zeros if it has none, of the length that others have), its columns, then the value of each
    of axes, 0 where it isn't seen, and whether it is. masked (item, axis): cells that aren't to be seen. Cells meet as one map of
    an item's axes, so no column is made for any of them before the array is."""
    own = cells if masked is None else cells.join(masked, [item, axis], "left_anti")
    seen = own.where(F.col(axis).isin(*axes) & F.col(value).isNotNull()).groupBy(item, axis).agg(F.avg(value).alias("_v")).groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(F.col(axis), "_v"))).alias("_m"))
    rows = items.join(seen, item, "left")
    names = F.array(*map(F.lit, axes))
    here = lambda a: F.when(F.col("_m").isNull(), None).otherwise(F.col("_m")[a])
    parts = [F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns)), F.transform(names, lambda a: F.coalesce(here(a), F.lit(0.0))), F.transform(names, lambda a: here(a).isNotNull().cast("double"))]
    if vector:
        length = items.agg(F.max(F.size(vector))).first()[0]
        parts.insert(0, F.when(F.size(vector) == length, F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), length)))
    return rows.select(item, F.concat(*parts).alias("features"))


def forests(cells: DataFrame, item: str, axis: str, value: str, items: DataFrame, columns: Sequence[str], train: Column, family: dict[str, str] | None = None, masked: DataFrame | None = None, vector: str | None = None, trees: int = 20, depth: int = 5, bins: int = 128, share: float = 0.5, most_axes: int = 4096) -> DataFrame:
    """axis, n, mae: a forest for each axis, grown all at once on the items of `train` that have it, and judged on the others. Axes
    of an axis's own family (by default itself) are hidden from it."""
    names = sorted(r[0] for r in cells.select(axis).distinct().limit(most_axes + 1).collect())
    if len(names) > most_axes:
        raise ValueError(f"over {most_axes} axes")
    spark = cells.sparkSession
    if not names:
        return spark.createDataFrame([], f"{axis} string, n long, mae double")
    x = materialize(assembled(items, item, columns, cells, axis, value, names, masked, vector), "features")
    cuts = cut_points(x, "features", bins)
    of = family or {a: a for a in names}
    before = len(cuts) - 2 * len(names)
    hidden = spark.createDataFrame([(i, before + k * len(names) + j) for i, a in enumerate(names) for j, b in enumerate(names) if of.get(a, a) == of.get(b, b) for k in (0, 1)], "axis long, f int")
    place = F.array_position(F.array(*map(F.lit, names)), F.col(axis)) - 1
    rows = binned(x, "features", cuts, [item]).join(cells.where(F.col(value).isNotNull()).select(item, place.alias("axis"), F.col(value).alias("y")), item)
    rows = materialize(rows.select(item, "axis", F.xxhash64(F.col(item)).alias("key"), "y", "bins"), "rows")
    forest = grow(rows.join(items.where(train).select(item), item, "left_semi"), names, cuts, trees, depth, share=share, hidden=hidden)
    judged = predict(rows.join(items.where(train).select(item), item, "left_anti"), forest, ["axis", "y"])
    named = F.element_at(F.array(*map(F.lit, names)), F.col("axis").cast("int") + 1)
    return judged.groupBy(named.alias(axis)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted") - F.col("y"))).alias("mae"))
