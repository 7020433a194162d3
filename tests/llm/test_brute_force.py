"""Each query over its whole tables against a plain version of its contract."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sievework.llm import queries as q

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def result(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_op1_held_out_accuracy(spark, sf_dir, docs):
    got = result(q.op1_language_id(spark, sf_dir))
    assert got.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.95


def test_op3_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    v = np.array([r["embedding"] for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    root = roots(((ids[i], ids[j]) for i, j in np.argwhere(near)), ids)
    got = result(q.op3_vectors(spark, sf_dir), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (int(near[k].sum()), root[i], root[i] == i) for k, i in enumerate(ids)}


def test_op4_targets_and_limits(spark, sf_dir, docs):
    size = {i: len(WORD.findall((r["text"] or "").encode())) for i, r in docs.items()}
    own = defaultdict(int)
    for i, r in docs.items():
        own[r["source"]] += size[i]
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, todo = {}, 1.5 * sum(own.values()), set(names)
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] > 2 * own[s]}
        for s in full or todo:
            target[s] = 2.0 * own[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        todo = todo - full if full else set()
    got = result(q.op4_mixing(spark, sf_dir))
    assert got.keys() == docs.keys()
    taken = defaultdict(int)
    for i, r in got.items():
        s = docs[i]["source"]
        assert (r["size"], r["source_size"]) == (size[i], own[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * size[i]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(64, 0.02 * target[s])
    assert got == result(q.op4_mixing(spark, sf_dir))


def test_op5_windows(spark, sf_dir, docs):
    words = {i: WORD.findall((r["text"] or "").encode()) for i, r in docs.items()}
    seen = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    got = result(q.op5_substrings(spark, sf_dir))
    assert got.keys() == docs.keys()
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_op6_finds_toxic_rows(spark, sf_dir):
    got = result(q.op6_toxicity(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [got[r["doc_id"]]["toxic"] for r in labels if not r["toxic"] and r["doc_id"] in got]
    toxic = [got[r["doc_id"]]["toxic"] for r in labels if r["toxic"] and r["doc_id"] in got]
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.7


def test_op7_fingerprints_and_groups(spark, sf_dir, docs):
    prints = {}
    for i, r in docs.items():
        w = WORD.findall((r["text"] or "").encode().lower())
        grams = [b" ".join(w[s : s + 3]) for s in range(max(1, len(w) - 2))] if w else []
        bits = sum(((np.uint64(xxhash.xxh64_intdigest(g, seed=42)) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int) for g in grams) if grams else np.zeros(64, int)
        prints[i] = sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))
    ids = sorted(prints)
    root = roots(((a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3), ids)
    got = result(q.op7_simhash(spark, sf_dir))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_op8_counts(spark, sf_dir, docs):
    got = result(q.op8_quality(spark, sf_dir))
    assert got.keys() == docs.keys()
    for i, r in docs.items():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = Counter(tuple(words[s : s + 3]) for s in range(len(words) - 2))
        repeat = len({s + o for s in range(len(words) - 2) if tri[tuple(words[s : s + 3])] > 1 for o in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (len(words) < 50 or 100 * repeat > 50 * len(words))
        assert not (g["base_failed"] and g["kept"])


def test_op10_ids_and_places(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    rows = q.op10_packing(spark, sf_dir).collect()
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    n = total = 0
    for i, d in docs.items():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            r = got[i, p]
            n += 1
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert n == len(rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= 1.03 * total / 4096 + 2
