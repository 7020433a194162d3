"""The choice of blocks to move against all subsets, and what is left after the move."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators.allocate import Block, allocated, choose, rechecked


def value(chosen, deficit, first, spare, guarded):
    loss = lambda a: sum(b.loss.get(a, 0) for b in chosen)
    if any(loss(a) > spare[a] for a in guarded):
        return None
    met = [a for a, d in deficit.items() if sum(b.gain.get(a, 0) for b in chosen) >= d and loss(a) <= spare[a]]
    return -sum(first[a] for a in met), -sum(not first[a] for a in met), sum(b.size for b in chosen)


@pytest.mark.parametrize("seed", range(25))
def test_choice_is_the_best_of_all_subsets(seed):
    r = random.Random(seed)
    axes, guarded = ["a", "b", "c"], ["g"]
    blocks = []
    for i in range(9):
        gain = {a: r.randint(1, 3) for a in axes if r.random() < 0.6}
        blocks.append(Block(f"b{i}", r.randint(1, 5), {a: n + r.randint(0, 2) for a, n in gain.items()} | ({"g": r.randint(1, 3)} if r.random() < 0.5 else {}), gain))
    deficit, first = {a: r.randint(1, 8) for a in axes}, {a: r.random() < 0.5 for a in axes}
    spare = {a: r.randint(3, 12) for a in [*axes, *guarded]}
    names, _ = choose(blocks, deficit, first, spare, guarded)
    best = min(v for n in range(10) for s in itertools.combinations(blocks, n) if (v := value(s, deficit, first, spare, guarded)))
    assert value([b for b in blocks if b.name in names], deficit, first, spare, guarded) == best


def test_no_deficit_and_no_proof():
    assert choose([], {}, {}, {})[0] == []
    assert choose([], {"a": 3}, {"a": True}, {"a": 9}) == ([], {"first": 0, "others": 0, "moved": 0})
    blocks = [Block(f"b{i}", i + 1, {"a": 1}, {"a": 1}) for i in range(12)]
    with pytest.raises(RuntimeError):
        choose(blocks, {"a": 6}, {"a": True}, {"a": 9}, most_nodes=5)


@pytest.mark.parametrize(("blocks", "moves", "decision"), [(14, 30, "coverage_restored_by_training_transfer"), (1, 0, "family_block_or_joint_allocation_infeasible_review")])
def test_whole_blocks_move(spark, blocks, moves, decision):
    cells = spark.range(140).selectExpr("id AS item", "'a' AS axis", "'train' AS partition", f"concat('b', id div {140 // blocks}) AS block", "true AS strict")
    args = (cells, "item", "axis", "partition", F.col("strict"), "block")
    moved = allocated(*args, F.lit(True))
    assert cells.join(moved, "block", "left_semi").count() == moves
    out, withheld = rechecked(*args, moved)
    row = out.first()
    assert (row.proposed_train, row.proposed_validation, row.decision, withheld.count()) == (140 - moves, moves, decision, 0)


def test_counts_that_cannot_fund_both(spark):
    cells = spark.range(109).selectExpr("id AS item", "'a' AS axis", "CASE WHEN id < 104 THEN 'train' ELSE 'validation' END AS partition", "string(id) AS block", "true AS strict")
    args = (cells, "item", "axis", "partition", F.col("strict"), "block")
    moved = allocated(*args, F.lit(True))
    row = rechecked(*args, moved)[0].first()
    assert (row.deficit, row.train_after, row.feasible, moved.count(), row.decision) == (25, 79, False, 0, "insufficient_total_support_review")
    empty = cells.where("false")
    assert allocated(empty, "item", "axis", "partition", F.col("strict"), "block", F.lit(True)).count() == 0
