"""Each stage of the pipeline against a plain version of it, on its own input and on odd rows."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import mixing, pii, queries, toxicity
from sievework.tables import shared_folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of each stage, as run() hands it on."""
    spark.conf.set("spark.sievework.pseudonym.key", queries.SECRET)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows and ids, and columns of the names that stages use within."""
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (5, "mail me@there.org now " * 30, "en", "b", 9), (7, "same words here", "en", None, 1), (7, "same words here", "en", None, 1),
            (7, "another text of one id", "en", None, 1), (None, "no id at all", "de", "c", 2), (9, "a b " * 400_000, "en", "c", 1_600_000)]
    clash = ["_kept", "_s", "_last", "_place", "_n", "_shard", "n_pii", "_n_pii", "fp", "key", "size", "row", "_id", "_text"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(3) for c in clash}).repartition(3)


def whole(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_toxic_rows_go(spark, sf_dir, stages):
    docs, got = whole(stages[0]), whole(stages[1])
    model = toxicity.learn(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def toxic(text):
        found = toxicity.tokens(text or "")
        return bool(found) and sum(model.weights.get(w, 0.0) for w in found) > model.thresholds[0]

    assert got == Counter({r: n for r, n in docs.items() if not toxic(r[1])}) and got.total() < docs.total()


def _print(text, words=8):
    parts = text.encode().lower().split()
    grams = {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()
    ones, mask = [0] * (64 * words), (1 << 64) - 1
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for w in range(words):
            x = h
            if w:
                x = (h + w * 0x9E3779B97F4A7C15) & mask
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
                x ^= x >> 31
            for b in range(64):
                ones[64 * w + b] += x >> b & 1
    return sum(1 << i for i, n in enumerate(ones) if 2 * n > len(grams)), grams


def test_one_of_each_group_stays(spark, stages):
    docs, got = whole(stages[1]), whole(stages[2])
    assert max(got.values()) == 1 and not got - docs
    rows = sorted(docs, key=lambda r: r[0])
    prints = [_print(r[1] or "") for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    def meet(x):
        byte = [x >> (8 * b) & 255 for b in range(64)]
        return any(not byte[b] and not byte[b + 1] for b in range(0, 64, 2)) or any(not byte[2 * b] and not byte[2 * b + 33] for b in range(16))

    for i, (a, own) in enumerate(prints):
        for j in range(i):
            b, other = prints[j]
            bits = (a ^ b).bit_count()
            if bits <= 110 and meet(a ^ b) and (bits <= 48 or len(own & other) >= 0.8 * len(own | other)):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    assert set(got) == {rows[top(i)] for i in range(len(rows))}


def test_personal_data_is_replaced_where_it_stands(stages):
    key = hashlib.sha256(queries.SECRET.encode()).digest()
    want = Counter()
    for (i, text, lang, source, _), n in whole(stages[2]).items():
        new = None if text is None else pii.pseudonymise(text, key)[0]
        want[i, new, lang, source, None if new is None else len(new)] += n
    assert whole(stages[3]) == want


def test_the_mix_meets_its_targets(stages):
    want = {r["doc_id"]: r for r in mixing.mixed(stages[3]).collect()}
    size, target, source = Counter(), {}, {}
    texts = {r["doc_id"]: r for r in stages[3].collect()}
    got = defaultdict(list)
    for r in stages[4].collect():
        got[r["doc_id"]].append(r)
    for i, rows in got.items():
        words = (texts[i]["text"] or "").split()
        assert sum(len((r["text"] or "").split()) for r in rows) == want[i]["taken"]
        for r in rows:
            assert (r["lang"], r["source"]) == (texts[i]["lang"], texts[i]["source"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
            part = (r["text"] or "").split()
            # In order: each block of the draw is found behind the one before.
            at = 0
            for b in range(0, len(part), 16):
                block = part[b : b + 16]
                at = next(k for k in range(at, len(words)) if words[k : k + len(block)] == block) + len(block)
    for i, r in want.items():
        source[i] = texts[i]["source"]
        size[source[i]] += r["taken"]
        target[source[i]] = r["target"]
    assert all(abs(size[s] - t) <= max(64, 0.03 * t) for s, t in target.items())


def test_sequences_hold_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in stages[4].collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            want[r["doc_id"], at, b"".join(x.to_bytes(4, "little") for x in ids[at : at + 4096])] += 1
    rows = stages[5].collect()
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


@pytest.mark.parametrize("at", range(5))
def test_odd_rows_empty_tables_and_clashes(spark, sf_dir, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, sf_dir)
    rows = out.collect()
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    if name != "packing":
        assert out.columns == odd.columns and all(r["_kept"] == r["_s"] == r["n_pii"] == 3 for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    if name in ("toxicity", "personal_data"):
        assert ids == Counter(r["doc_id"] for r in odd.collect())
    if name == "near_duplicates":
        assert ids == Counter([1, 5, 7, 7, None, 9])
    # Without n_chars and with only the columns that the stages read.
    few = stage(spark, odd.select("doc_id", "text", "source"), sf_dir)
    assert few.count() == len(rows)


def test_without_a_key_runs_are_not_linked(spark, odd, monkeypatch):
    spark.conf.unset("spark.sievework.pseudonym.key")
    texts = [{r["text"] for r in corpus_pipeline.hide_personal_data(spark, odd.where("doc_id = 5"), "").collect()} for _ in range(2)]
    assert texts[0] != texts[1]
    spark.conf.set("spark.sievework.pseudonym.key", queries.SECRET)


def test_near_duplicates_leave_no_sets_behind(spark, stages, sf_dir):
    """Sets of shingles are about as large as the texts: later stages would need the disk for both."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = corpus_pipeline.drop_near_duplicates(spark, stages[1], sf_dir)
    left = {p.name.partition("-")[0] for p in set(folder.iterdir()) - before}
    assert "stay" in left and not left & {"fingerprints", "classes", "groups"}
    assert whole(out) == whole(stages[2])


def test_the_driver_learns_toxicity_in_little_memory():
    """Bytes for each word of the sample at the most; what train() has chosen doesn't depend on the order of the dictionary."""
    rng = np.random.default_rng(0)
    labels = (np.arange(4000) % 3 == 0).astype(np.int64)
    bad = (labels[:, None] > 0) & ((np.arange(4000)[:, None] + np.arange(20)) % 4 > 0)
    rows = [[f"bad{k}" for k in np.flatnonzero(b)] + [f"w{k}" for k in np.unique(r)] for b, r in zip(bad, rng.integers(0, 20_000, (4000, 500)), strict=True)]
    words = pa.array(rows, pa.list_(pa.string()))
    tracemalloc.start()
    model = toxicity.train(words, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(words.flatten())
    codes = {w: i for i, w in enumerate(sorted({w for r in rows for w in r}, reverse=True))}
    coded = pa.DictionaryArray.from_arrays(pa.array([codes[w] for r in rows for w in r], pa.int32()), pa.array(list(codes)))
    again = toxicity.train(pa.ListArray.from_arrays(words.offsets, coded), labels)
    assert again.weights == model.weights and again.thresholds == model.thresholds
