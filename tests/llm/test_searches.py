"""Hard negatives, shards and ranked search: whole queries against plain versions, odd and empty tables, and their parts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import negatives, search, sharding
from sievework.llm import queries as q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_ranks(docs, items, k):
    """{item number: [(doc id, score)]} of rows (id, text), row by row."""
    terms = [Counter(TERM.findall(lower(t or ""))) for _, t in docs]
    held = [c for c in terms if c]
    n_docs, n_terms, df = len(held), sum(c.total() for c in held), Counter(t for c in held for t in c)
    out = {}
    for at, (_, text) in enumerate(items):
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(TERM.findall(lower(text or ""))) if df[t]}
        scored = []
        for (i, _), c in zip(docs, terms, strict=True):
            m = 50 + 50 * c.total() * n_docs // n_terms if c else 0
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out[at] = [(None if none else i, -s) for s, none, i in sorted(scored)[:k]]
    return out


def test_op13_is_the_plain_ranking(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(items[at][0], rank, d, s) for at, rows in plain_ranks(docs, items, 50).items() for rank, (d, s) in enumerate(rows, 1)}
    rows = [tuple(r) for r in q.op13_search(spark, sf_dir).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "Beta", "gamma"]) + str(rng.randrange(700)) for _ in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n.,", None), (4, long, "b"), (5, "Alpha beta ÉCLAIR", "b"), (6, "alpha Éclair", "b"), (7, "same words", None), (7, "same words", None), (None, "alpha alpha", "c"), (None, "alpha alpha", "c"), (9, "x\x00y alpha", "c"), (8, "alpha alpha", "c")]
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, source string, _text string, row int").repartition(3)


def test_search_of_odd_tables(spark, odd):
    items = [(1, "ALPHA éclair Éclair"), (2, None), (3, "nothing here"), (None, "same"), (None, "y"), (4, "alpha alpha1 beta2 " * 40)]
    table = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, item string").coalesce(1)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_ranks(docs, items, 5)
    index = search.indexed(odd)
    for block in (1 << 18, 2):
        got = search.ranked(index, table, 5, block=block).collect()
        for i in (1, 4):
            at = [x[0] for x in items].index(i)
            assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == i] == want[at]
        assert sorted((r["doc_id"], r["score"]) for r in got if r["item_id"] is None) == sorted(want[3] + want[4])
        assert not [r for r in got if r["item_id"] in (2, 3)]
    assert search.ranked(search.indexed(odd.limit(0)), table).count() == 0 and search.ranked(index, table.limit(0)).count() == 0


def test_bytes_bound_impacts():
    tf, m = np.meshgrid(np.arange(1, 60), np.array([50, 51, 77, 100, 300, 5000, 10**7]))
    impact = search._impacts(tf.ravel(), m.ravel())
    steps = -(-impact // search.STEP)
    assert steps.max() <= 255 and (steps * search.STEP >= impact).all() and ((steps - 1) * search.STEP < impact).all()


def plain_negatives(rows, k=5, low=(80, 100), every=100):
    out = set()
    for i, label, v in {(i, label, tuple(v)) for i, label, v in rows if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, other, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:k]:
            fits = [(t, o) for t, o, same in scored if not same and low[0] * -s <= low[1] * -t <= low[1] * -s][:k]
            out |= {(i, j, rank, o, -s, -t) for rank, (t, o) in enumerate(fits, 1)}
    return out


def test_op11_is_the_plain_search(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    fine = [r for r in table if r["label"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in fine]
    assert {tuple(r) for r in q.op11_negatives(spark, sf_dir).collect()} == plain_negatives(rows)


def test_negatives_of_odd_tables(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (6, 8))
    rows = [(i, i % 3, (centres[i % 6] + rng.integers(-9, 10, 8)).tolist()) for i in range(900)]
    # A frequent vector with many labels, vectors of another length, of no length, and of zeros.
    rows += [(900 + i, i % 4, centres[0].tolist()) for i in range(300)] + [(1300 + i, i % 2, [int(i % 5), 3]) for i in range(110)] + [(1500 + i, i % 2, []) for i in range(101)] + [(1700 + i, i % 2, [0] * 8) for i in range(3)]
    none = [(2000, None, [1] * 8), (2100, 1, None), (None, 1, [1] * 8), (2200, 1, [1, None] + [1] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + none], "vec_id long, label long, vector array<long>, v string, dist double").repartition(4)
    anchor = F.col("vec_id") % 100 == 0
    want = plain_negatives(rows)
    assert any(a == 1300 for a, *_ in want) and any(a == 1500 for a, *_ in want)
    for annulus, block, first in ((64, 4, 2), (4096, 256, 8)):
        got = [tuple(r) for r in negatives.mined(df, anchor, annulus=annulus, block=block, first=first).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert negatives.mined(df.limit(0), anchor).count() == 0 and negatives.mined(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="64-bit"):
        negatives.mined(spark.createDataFrame([(100, 1, [1 << 40])], "vec_id long, label long, vector array<long>"), anchor)


def test_far_annuli_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(c * 1000 + i, i % 2, (np.eye(8, dtype=int)[c] * 20_000 + rng.integers(0, 50, 8)).tolist()) for c in range(8) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    counts, pairs = [], negatives._pairs

    def counted(blocks, annuli):
        out = negatives.materialize(pairs(blocks, annuli), "pairs")
        counts.append((out.count(), blocks.select("block").distinct().count() * annuli.count()))
        return out

    monkeypatch.setattr(negatives, "_pairs", counted)
    got = {tuple(r) for r in negatives.mined(df, F.col("vec_id") % 1000 == 0, annulus=25, block=1, first=1, pivots=8).collect()}
    assert got == plain_negatives(rows, every=1000) and len(got) == 8 * 25
    # Negatives of a bounded score are looked for in one cluster's annuli only.
    assert counts[1][0] < counts[1][1] / 2


def test_op12_lays_equal_bytes_out(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op12_sharding(spark, sf_dir).collect()
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    size, slots = Counter(), {}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean, most = sum(size.values()) / 16, max(r["size"] for r in rows)
    assert sorted(size) == list(range(16)) and max(abs(x - mean) for x in size.values()) <= most
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_odd_tables(spark, odd):
    out = sharding.placed(odd, shards=3, dims=("source", "row")).collect()
    assert len(out) == odd.count() and sorted({r["shard"] for r in out}) == [0, 1, 2]
    assert sharding.placed(odd.limit(0), shards=3, dims=("source",)).count() == 0
    assert {r["shard"] for r in sharding.placed(odd, target_bytes=10**9, dims=("source",)).collect()} == {0}
    # A value that nearly all rows have is parted as well, rows that are the same in all columns too.
    same = spark.createDataFrame([(1, "ten bytes.", "hot", 1)] * 1000 + [(2, "x", "cold", None)], "doc_id long, text string, source string, n int").repartition(3)
    for n in (4, 7):
        size = Counter(r["shard"] for r in sharding.placed(same, shards=n, dims=("source", "n")).collect())
        assert sorted(size) == list(range(n)) and max(size.values()) - min(size.values()) <= 3


def test_the_tree_splits_the_widest_column(spark):
    rows = [(i, "t", float(i % 10), float(i // 10) / 1000) for i in range(100)] + [(100, "t", None, float("inf"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, a double, b double")
    got = {r["doc_id"]: r["shard"] for r in sharding.placed(df, shards=4, dims=("a", "b")).collect()}
    # First by a (both are as wide as their range: the first), then by b, which is now the wider one.
    assert all((got[i] < 2) == (i % 10 < 5) and (got[i] % 2 == 0) == (i // 10 < 5) for i in range(100))


def test_shards_as_files(spark, odd, tmp_path):
    docs = odd.drop("row")
    listed = sharding.write(docs, str(tmp_path / "s"), shards=3, dims=("source",)).collect()
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda r: repr((r["doc_id"], r["text"], r["source"], r["_text"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    assert {r["shard"]: r["rows"] for r in listed} == {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    with pytest.raises(ValueError, match="clash"):
        sharding.write(docs.withColumn("slot", F.lit(1)), str(tmp_path / "t"), shards=2, dims=("source",))
