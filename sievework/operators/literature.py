"""Literature records: walks along citations, and one identity for records that share any of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..tables import discard, materialize
from .graph import groups


def citation_walk(seeds: DataFrame, cites: DataFrame, hops: int, work: str = "work", citing: str = "citing", cited: str = "cited") -> DataFrame:
    """seed, work, direction, hop: every work within `hops` citations of each of seeds, backward (what it cites, what those cite,
    ...) and forward (what cites it), at the least number of hops. A seed is in neither of its own walks.

    A round joins the frontier with the citations and takes out what the walk has been to, so a work is expanded once for each
    seed and direction, and citations in circles end. Both directions go in one join, over citations of both kinds; a work that
    very many cite is a skewed key of a sort-merge join, which Spark splits. Each round's frontier is a table in the shared folder.
    """
    ways = cites.select(F.lit("backward").alias("direction"), F.col(citing).alias("_at"), F.col(cited).alias("_to")).union(cites.select(F.lit("forward"), F.col(cited), F.col(citing))).where("_at <> _to").distinct()
    ways = materialize(ways, "citations")
    start = seeds.select(F.col(work).alias("seed")).where("seed IS NOT NULL").distinct()
    here = start.select("seed", F.col("seed").alias("work"), F.explode(F.array(F.lit("backward"), F.lit("forward"))).alias("direction"), F.lit(0).alias("hop"))
    levels = [materialize(here, "frontier", few_files=True)]
    for hop in range(1, hops + 1):
        been = levels[0]
        for level in levels[1:]:
            been = been.union(level)
        on = levels[-1].join(ways, (levels[-1]["work"] == ways["_at"]) & (levels[-1]["direction"] == ways["direction"]))
        on = on.select("seed", F.col("_to").alias("work"), levels[-1]["direction"], F.lit(hop).alias("hop")).distinct()
        new = materialize(on.join(been.drop("hop"), ["seed", "work", "direction"], "left_anti"), "frontier", few_files=True)
        if new.isEmpty():
            discard(new)
            break
        levels.append(new)
    out = levels[0].where("hop > 0")
    for level in levels[1:]:
        out = out.union(level.select(*out.columns))
    return out


def walk_log(found: DataFrame, seeds: DataFrame, cites: DataFrame, works: DataFrame, work: str = "work", citing: str = "citing", cited: str = "cited") -> DataFrame:
    """seed, direction, expected, retrieved, status: whether the first hop's works are all on record; an unknown seed has failed."""
    ways = cites.select(F.col(citing).alias("seed"), F.lit("backward").alias("direction"), F.col(cited).alias("_to")).union(cites.select(F.col(cited), F.lit("forward"), F.col(citing))).where("seed <> _to").distinct()
    asked = seeds.select(F.col(work).alias("seed")).distinct().select("seed", F.explode(F.array(F.lit("backward"), F.lit("forward"))).alias("direction"))
    expected = ways.groupBy("seed", "direction").agg(F.count(F.lit(1)).alias("expected"))
    got = found.where("hop = 1").join(works.select(F.col(work).alias("work")).distinct(), "work").groupBy("seed", "direction").agg(F.count(F.lit(1)).alias("retrieved"))
    known = works.select(F.col(work).alias("seed")).distinct().withColumn("_known", F.lit(True))
    out = asked.join(expected, ["seed", "direction"], "left").join(got, ["seed", "direction"], "left").join(known, "seed", "left").fillna(0, ["expected", "retrieved"])
    status = F.when(F.col("_known").isNull(), "failed").when(F.col("expected") == F.col("retrieved"), "completed").otherwise("incomplete")
    return out.select("seed", "direction", "expected", "retrieved", status.alias("status"))


def same_records(records: DataFrame, record: str, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """records with identity and n_records: those that share any of keys (name of the key, its column; blank ones don't count) are
    one, and so are those that such records join. identity is the least value of the first key that any of them has, with the
    key's name before it, so it is the same whichever of them is asked, and stays when records without that key come in."""
    filled = records.select(record, *(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))).alias(f"_k{i}") for i, (_, c) in enumerate(keys)))
    label = groups(records.select(record), record, [(filled.select(record, f"_k{i}"), f"_k{i}") for i in range(len(keys))])
    least = filled.join(label, record).groupBy("label").agg(F.count(F.lit(1)).alias("n_records"), *(F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(keys))))
    named = [F.when(F.col(f"_k{i}").isNotNull(), F.concat(F.lit(f"{name}:"), f"_k{i}") if name != "title" else stable_id("title", F.col(f"_k{i}"))) for i, (name, _) in enumerate(keys)]
    known = least.select("label", "n_records", F.coalesce(*named, F.concat(F.lit("record:"), F.col("label").cast("string"))).alias("identity"))
    return records.join(label.join(known, "label").drop("label"), record)
