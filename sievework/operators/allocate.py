"""Validation support: what axes lack, which whole blocks to move from training to mend it, and what holds after the move."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import first_reason


@dataclass(frozen=True)
class Block:
    name: str
    size: int
    loss: Mapping[str, int]
    gain: Mapping[str, int]

    @property
    def tie(self) -> float:
        return int(hashlib.sha256(self.name.encode()).hexdigest()[:8], 16) / 2**32


def ledger(cells: DataFrame, item: str, axis: str, partition: str, strict: Column, block: str, least_train: int = 100, least_validation: int = 30) -> DataFrame:
    """By axis: distinct items in train, validation and strictly labelled in train, blocks in train, the deficit of validation, and
    whether moving as many strict items as it lacks would leave enough in train. One aggregation; an item counts once."""
    one = cells.groupBy(axis, item).agg(*(F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("_t", F.col(partition) == "train"), ("_v", F.col(partition) == "validation"), ("_s", (F.col(partition) == "train") & strict))), F.max(F.when(F.col(partition) == "train", F.col(block))).alias("_b"))
    out = one.groupBy(axis).agg(F.sum("_t").alias("train"), F.sum("_v").alias("validation"), F.sum("_s").alias("strict_train"), F.countDistinct("_b").alias("train_blocks"))
    out = out.withColumn("deficit", F.greatest(F.lit(0).cast("long"), least_validation - F.col("validation")))
    out = out.withColumn("train_after", F.col("train") - F.col("deficit"))
    return out.withColumn("feasible", (F.col("train_after") >= least_train) & (F.col("strict_train") >= F.col("deficit")))


class _Search:
    """Depth-first over kinds of like blocks, most of a kind first tried last; bounds cut what can't beat the best found."""

    def __init__(self, blocks: Sequence[Block], deficit: Mapping[str, int], first: Mapping[str, bool], spare: Mapping[str, int], guarded: Sequence[str], most_nodes: int):
        kinds: dict[tuple, list[Block]] = {}
        for b in sorted(blocks, key=lambda b: (b.tie, b.name)):
            kinds.setdefault((b.size, tuple(sorted(b.loss.items())), tuple(sorted(b.gain.items()))), []).append(b)
        self.kinds = sorted(kinds.values(), key=lambda k: (-sum(min(n, deficit[a]) for a, n in k[0].gain.items() if a in deficit) / k[0].size, k[0].name))
        self.deficit, self.first, self.spare, self.guarded = deficit, first, spare, guarded
        self.left = most_nodes
        self.rest = [{a: sum(len(k) * k[0].gain.get(a, 0) for k in self.kinds[i:]) for a in deficit} for i in range(len(self.kinds) + 1)]
        self.rate = [{a: min((k[0].size / k[0].gain[a] for k in self.kinds[i:] if k[0].gain.get(a)), default=0.0) for a in deficit} for i in range(len(self.kinds) + 1)]
        self.share = len(blocks) + 1
        self.best: tuple | None = None
        self.taken: list[Block] = []

    def _bound(self, i: int, loss: dict, gain: dict, cost: float) -> tuple:
        open_ = [a for a, d in self.deficit.items() if gain[a] + self.rest[i][a] >= d and loss[a] <= self.spare[a]]
        score = (-sum(self.first[a] for a in open_), -sum(not self.first[a] for a in open_))
        more = max(((self.deficit[a] - gain[a]) * self.rate[i][a] for a in open_ if gain[a] < self.deficit[a]), default=0.0)
        # what is still to be paid counts only where every open axis must be met to equal the best
        return (*score, cost + more) if self.best and score == self.best[:2] else (*score, cost)

    def run(self, i: int = 0, loss: dict | None = None, gain: dict | None = None, cost: float = 0.0, held: tuple = ()) -> None:
        loss, gain = loss or dict.fromkeys({*self.deficit, *self.guarded}, 0), gain or dict.fromkeys(self.deficit, 0)
        self.left -= 1
        if self.left < 0:
            raise RuntimeError("the allocation wasn't proven best within its number of nodes")
        if self.best and self._bound(i, loss, gain, cost) >= self.best:
            return
        if i == len(self.kinds):
            met = [a for a, d in self.deficit.items() if gain[a] >= d and loss[a] <= self.spare[a]]
            found = (-sum(self.first[a] for a in met), -sum(not self.first[a] for a in met), cost)
            if self.best is None or found < self.best:
                self.best, self.taken = found, list(held)
            return
        kind = self.kinds[i]
        for n in range(len(kind), -1, -1):
            lost = {a: v + n * kind[0].loss.get(a, 0) for a, v in loss.items()}
            if any(lost[a] > self.spare[a] for a in self.guarded):
                continue
            won = {a: v + n * kind[0].gain.get(a, 0) for a, v in gain.items()}
            self.run(i + 1, lost, won, cost + sum(b.size + b.tie / self.share for b in kind[:n]), (*held, *kind[:n]))


def choose(blocks: Sequence[Block], deficit: Mapping[str, int], first: Mapping[str, bool], spare: Mapping[str, int], guarded: Sequence[str] = (), most_nodes: int = 500_000) -> tuple[list[str], dict[str, int]]:
    """(names of the blocks to move, what that meets): as many `first` axes as can be, then as many others, then the fewest items.

    An axis is met if the moved blocks gain its deficit and lose no more than it can spare; guarded axes never lose more. Exact: an
    error, not a guess, if the search doesn't end within most_nodes. Ties go by hashes of the names.
    """
    if not deficit:
        return [], {"first": 0, "others": 0, "moved": 0}
    search = _Search([b for b in blocks if any(b.gain.get(a) for a in deficit)], deficit, first, spare, guarded, most_nodes)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, len(search.kinds) + 1000))
    try:
        search.run()
    finally:
        sys.setrecursionlimit(limit)
    return sorted(b.name for b in search.taken), {"first": -search.best[0], "others": -search.best[1], "moved": sum(b.size for b in search.taken)}


def allocated(cells: DataFrame, item: str, axis: str, partition: str, strict: Column, block: str, first: Column, least_train: int = 100, least_validation: int = 30, most_blocks: int = 5_000, most_nodes: int = 500_000) -> DataFrame:
    """(block): those of training to move whole to validation, chosen from presence and labels alone, never values.

    first says of an axis whether it is of the first importance. Counts by axis and block come to the driver, at most most_blocks
    blocks' (an error beyond), as the search is a small one by nature. Axes that have enough of both are guarded.
    """
    known = ledger(cells, item, axis, partition, strict, block, least_train, least_validation).withColumn("first", first).collect()
    short = {r[axis]: r for r in known if r["feasible"] and r["deficit"] > 0}
    guarded = [r[axis] for r in known if r["deficit"] == 0 and r["train"] >= least_train]
    train = cells.where((F.col(partition) == "train") & F.col(block).isNotNull())
    useful = train.where(F.col(axis).isin(*short) & strict).select(block).distinct() if short else train.select(block).where("false")
    if useful.limit(most_blocks + 1).count() > most_blocks:
        raise ValueError(f"more than {most_blocks} blocks could move")
    near = train.join(useful, block, "left_semi")
    sizes = {r[0]: r[1] for r in near.groupBy(block).agg(F.countDistinct(item)).collect()}
    loss, gain = {b: {} for b in sizes}, {b: {} for b in sizes}
    watched = [*short, *guarded]
    for r in near.where(F.col(axis).isin(*watched)).groupBy(block, axis).agg(F.countDistinct(item).alias("n"), F.countDistinct(F.when(strict, F.col(item))).alias("s")).collect() if watched else []:
        loss[r[block]][r[axis]] = r["n"]
        if r[axis] in short and r["s"]:
            gain[r[block]][r[axis]] = r["s"]
    blocks = [Block(str(b), n, loss[b], gain[b]) for b, n in sizes.items()]
    spare = {r[axis]: r["train"] - least_train for r in known if r[axis] in short or r[axis] in guarded}
    names, _ = choose(blocks, {a: r["deficit"] for a, r in short.items()}, {a: bool(r["first"]) for a, r in short.items()}, spare, guarded, most_nodes)
    return useful.where(F.col(block).cast("string").isin(*names)) if names else useful.where("false")


def rechecked(cells: DataFrame, item: str, axis: str, partition: str, strict: Column, block: str, moved: DataFrame, least_train: int = 100, least_validation: int = 30) -> tuple[DataFrame, DataFrame]:
    """(by axis: counts before and after the move and a decision; the moved cells withheld, as their labels aren't strict)."""
    before = ledger(cells, item, axis, partition, strict, block, least_train, least_validation)
    rows = cells.join(moved.select(F.col(block).alias("_m")).distinct(), F.col(block) == F.col("_m"), "left").withColumn("candidate", F.when(F.col("_m").isNotNull() & (F.col(partition) == "train"), "validation").otherwise(F.col(partition)))
    allowed = F.coalesce((F.col("candidate") == "train") | strict, F.lit(False))
    n = rows.where(allowed).groupBy(axis).agg(*(F.countDistinct(F.when(F.col("candidate") == p, F.col(item))).alias(f"proposed_{p}") for p in ("train", "validation")))
    out = before.join(n, axis, "left").fillna(0, ["proposed_train", "proposed_validation"])
    enough = (F.col("proposed_train") >= least_train) & (F.col("proposed_validation") >= least_validation)
    decision = first_reason(
        [(F.col("train") < least_train, "insufficient_training_support_review"), (F.col("train_after") < least_train, "insufficient_total_support_review"), (F.col("strict_train") < F.col("deficit"), "validation_evidence_insufficient_not_fixed_by_split"), (~enough, "family_block_or_joint_allocation_infeasible_review"), (F.col("deficit") > 0, "coverage_restored_by_training_transfer")],
        "counts_already_sufficient",
    )
    return out.withColumn("decision", decision), rows.where(~allowed).drop("_m")


def screened(answers: DataFrame, key: str, question: str, answer: str, weights: DataFrame, weight: str, threshold: int = 100) -> DataFrame:
    """key, score (the weights of questions answered yes), passed: a first screening, not an assessment."""
    points = F.when(F.lower(F.trim(answer)) == "yes", F.col(weight)).otherwise(0)
    return answers.join(F.broadcast(weights.select(question, weight)), question).groupBy(key).agg(F.sum(points).alias("score")).withColumn("passed", F.col("score") >= threshold)
