"""Forests of all axes at once against plain trees, and the features that they see."""

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import evaluate, trees


def plain(x, y, least, depth, node=1):
    """{node: (feature, cut, n, mean)} of a least-squares tree over all values."""
    out = {node: (None, None, len(y), y.mean())}
    best = (y.sum() ** 2 / len(y) * (1 + 1e-12), None)
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f]):
                left = x[:, f] <= v
                if least <= left.sum() <= len(y) - least:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()
                    if gain > best[0]:
                        best = (gain, (f, v))
        if best[1]:
            f, v = best[1]
            left = x[:, f] <= v
            out[node] = (f, v, len(y), y.mean())
            out |= plain(x[left], y[left], least, depth - 1, 2 * node) | plain(x[~left], y[~left], least, depth - 1, 2 * node + 1)
    return out


def test_trees_of_all_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = {a: (x @ rng.integers(-4, 5, 3) + rng.integers(0, 3, 300)).astype(int) for a in range(3)}
    rows = [(a, i, float(y[a][i]), x[i].tolist()) for a in range(3) for i in range(300) if (i + a) % 4]
    df = spark.createDataFrame(rows, "axis long, item long, y double, features array<double>").repartition(5)
    cuts = trees.cut_points(df, "features", 64)
    binned = trees.binned(df, "features", cuts, ["axis", "item", "y"]).withColumn("key", F.xxhash64("item"))
    hidden = spark.createDataFrame([(2, 0)], "axis long, f int")
    forest = trees.grow(binned, ["a", "b", "c"], cuts, trees=1, depth=3, bagged=False, hidden=hidden)
    got = {(r["axis"], r["node"]): (r["feature"], r["cut"], r["n"], round(r["mean"], 9)) for r in trees.node_table(spark, forest).collect()}
    want = {}
    for a, name in enumerate("abc"):
        own = np.array([i for i in range(300) if (i + a) % 4])
        seen = x[own].copy()
        if a == 2:
            seen[:, 0] = 0
        want |= {(name, n): (f, v, k, round(float(m), 9)) for n, (f, v, k, m) in plain(seen, y[a][own], 3, 3).items()}
    assert got == want


def test_bagged_forests_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(x @ [1, 2] + rng.normal() / 9), *map(float, x)) for i, x in enumerate(rng.normal(size=(400, 2)))]
    cells = spark.createDataFrame([r[:3] for r in rows], "i long, axis string, v double")
    items = spark.createDataFrame([(r[0], *r[3:]) for r in rows], "i long, p double, q double")
    out = [{r["axis"]: (r["n"], r["mae"]) for r in trees.forests(cells.repartition(n), "i", "axis", "v", items.repartition(n), ["p", "q"], F.col("i") % 4 > 0, trees=10, share=1.0).collect()} for n in (1, 7)]
    assert {a: n for a, (n, _) in out[0].items()} == {"a": 100} and abs(out[0]["a"][1] - out[1]["a"][1]) < 1e-12 and out[0]["a"][1] < 0.8
    assert trees.forests(cells.limit(0), "i", "axis", "v", items, ["p"], F.lit(True)).count() == 0


def test_features_leave_masked_cells_out(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "i int, x string, v double")
    items = spark.createDataFrame([(1, 9.0, [1.0]), (2, 8.0, None), (3, None, [2.0, 3.0])], "i int, s double, e array<double>")
    masked = spark.createDataFrame([(1, "a")], "i int, x string")
    got = {r["i"]: r["features"] for r in trees.assembled(items, "i", ["s"], cells, "x", "v", ["a", "b"], masked, "e").collect()}
    assert got == {1: [0, 0, 9, 0, 2, 0, 1], 2: [0, 0, 8, 3, 0, 1, 0], 3: [2, 3, 0, 0, 0, 0, 0]}


def test_clusters_are_drawn_as_wholes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), "ab"[int(c + i) % 2], float(rng.random())) for c in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "c long, axis string, e double").repartition(3)
    keys = {r["c"]: r["k"] for r in df.select("c", F.xxhash64(F.lit("b"), F.col("c")).alias("k")).distinct().collect()}
    w = {c: evaluate._weights(np.array([k]), 50)[0] for c, k in keys.items()}
    means = []
    for rep in range(50):
        own = [(sum(w[c][rep] * e for c, a, e in rows if a == axis), sum(w[c][rep] for c, a, _ in rows if a == axis)) for axis in "ab"]
        means.append(np.mean([s / n for s, n in own if n]))
    got = evaluate.cluster_interval(df, "c", "axis", "e", 50).first()
    assert np.allclose([got["low"], got["high"]], np.percentile(means, [2.5, 97.5])) and abs(np.mean(list(w.values())) - 1) < 0.1
