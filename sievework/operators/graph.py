"""Connected components, ancestors, and unions under vetoes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable over edges, for every node that has an edge to another.

    Rounds of hooking to the smallest neighbour and pointer jumping; edges shrink to edges between groups, as tables in the
    shared folder. A node's many edges meet in partial aggregates and skew-split joins, never in one task or the driver.
    """
    spark = edges.sparkSession
    live = materialize(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges", few_files=True)
    labels = None
    while not live.isEmpty():
        both = live.union(live.select("v", "u")).toDF("n", "m")
        up = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p"))
        hooks = materialize(up, "hooks", few_files=True)
        up = hooks
        for _ in range(2):
            higher = up.toDF("p", "pp")
            up = up.join(higher, "p", "left").select("n", F.coalesce("pp", "p").alias("p"))
        up = materialize(up, "hooks", few_files=True)
        old_live, old_labels = live, labels
        live = materialize(
            live.join(up.toDF("u", "pu"), "u").join(up.toDF("v", "pv"), "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct(), "edges", few_files=True
        )
        if labels is None:
            labels = up.toDF("node", "label")
        else:
            labels = materialize(labels.join(up.toDF("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels", few_files=True)
            discard(old_labels)
            discard(up)
        discard(old_live)
        discard(hooks)
    discard(live)
    if labels is None:
        kind = edges.schema[a].dataType
        return spark.createDataFrame([], "node long, label long").select(F.col("node").cast(kind), F.col("label").cast(kind))
    return labels


def groups(nodes: DataFrame, node: str, links: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """node, label for every node: components over shared keys. links: (frame with node and a key, the key's column). Members of
    a key are linked to its smallest member, a star and not all pairs."""
    edges = None
    for df, key in links:
        rows = df.where(F.col(key).isNotNull()).select(node, F.col(key).alias("_k"))
        star = rows.join(rows.groupBy("_k").agg(F.min(node).alias("_m")), "_k").select(F.col(node).alias("a"), F.col("_m").alias("b")).where("a <> b")
        edges = star if edges is None else edges.union(star)
    found = components(edges).toDF(node, "label")
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("label", node).alias("label"))


def ancestors(edges: DataFrame, child: str, parent: str, depth: int) -> DataFrame:
    """child, ancestor, distance: the shortest, up to depth. Each round joins only pairs not reached before."""
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    out = materialize(base.withColumn("distance", F.lit(1)), "ancestors")
    for d in range(2, depth + 1):
        step = base.toDF("ancestor", "next")
        further = out.where(F.col("distance") == d - 1).join(step, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        further = further.join(out, ["child", "ancestor"], "left_anti").withColumn("distance", F.lit(d))
        if further.isEmpty():
            break
        out = materialize(out.unionByName(further), "ancestors")
    return out


def attach_to_frozen(nodes: DataFrame, node: str, frozen: DataFrame, block: str, edges: DataFrame) -> DataFrame:
    """node, block, conflict for new nodes: the one frozen block that its component touches; else a block of its own, with
    conflict true where it touches several. edges: (a, b) between nodes, new or frozen."""
    new = nodes.join(frozen, node, "left_anti")
    inner = edges.join(new.select(F.col(node).alias("a")), "a", "left_semi").join(new.select(F.col(node).alias("b")), "b", "left_semi")
    label = new.select(node).join(components(inner).toDF(node, "_l"), node, "left").select(node, F.coalesce("_l", node).alias("_l"))
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    touched = label.join(both.toDF(node, "_o"), node).join(frozen.select(F.col(node).alias("_o"), F.col(block).alias("_b")), "_o").groupBy("_l").agg(F.collect_set("_b").alias("_bs"))
    out = label.join(touched, "_l", "left")
    n = F.coalesce(F.size("_bs"), F.lit(0))
    return out.select(node, F.when(n == 1, F.element_at("_bs", 1)).otherwise(F.concat(F.lit("new:"), F.col("_l").cast("string"))).alias("block"), (n > 1).alias("conflict"))


def constrained_groups(rows: DataFrame, node: str, facet: str, label: str, name: str) -> DataFrame:
    """node, group: unions within each `label` component, vetoed where two groups hold different facets (null agrees with all).

    The outcome depends on the order, which is fixed: names in order, and within a name each node against the earlier ones, by
    node. Components are replayed one by one in Python, so a component must fit in a task; names are its blocks.
    """
    kind = rows.schema[node].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([name, node], kind="stable")
        up = {n: n for n in pdf[node]}
        held = {n: (set() if pd.isna(f) else {f}) for n, f in zip(pdf[node], pdf[facet], strict=True)}

        def top(n):
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        for _, block in pdf.groupby(name, sort=True, dropna=True):
            seen: list = []
            for n in block[node]:
                for other in seen:
                    a, b = sorted((top(n), top(other)))
                    if a != b and len(held[a] | held[b]) <= 1:
                        up[b] = a
                        held[a] |= held[b]
                # One earlier node of each group is enough: its group's facets are what vetoes.
                if all(top(n) != top(other) for other in seen):
                    seen.append(n)
        return pd.DataFrame({node: pdf[node], "group": [top(n) for n in pdf[node]]})

    return rows.select(node, facet, F.col(label).alias("_label"), name).groupBy("_label").applyInPandas(replay, f"{node} {kind}, group {kind}")
