"""Operators give whole texts and ids, not only counts and checksums of them."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from sievework.llm import pii, quality
from sievework.llm.queries import tokenizer_path


def test_sequences_hold_the_ids_of_their_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    # One id for two texts, as the mix gives them, besides a text of many pieces, an empty one and a null.
    texts = [(1, "the whole text of a document"), (1, "whole of document"), (2, " ".join(f"word{i}" for i in range(3000))), (3, ""), (4, None)]
    rows = corpus_pipeline.pack(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(3), sf_dir).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], np.frombuffer(r["ids"], "<u4").tolist()))
    held = []
    for parts in sequences.values():
        ids = []
        for offset, part in sorted(parts):
            assert offset == len(ids)
            ids += part
        assert len(ids) <= 4096
        held += ids
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts]
    assert sorted(held) == sorted(x for ids in want for x in ids)
    cut = sorted((i, ids[at : at + 4096]) for (i, _), ids in zip(texts, want, strict=True) for at in range(0, len(ids), 4096))
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == cut


def test_lines_above_the_limit_are_cut_out(spark):
    own = [f"own line {'abcdefgh'[i % 8] * (i // 8 + 1)} of words " + " ".join(f"w{j}" for j in range(60)) for i in range(40)]
    rows = [(i, f"Menu  home 1{i % 10}\n\n{own[i]}\nmenu HOME 99", "h") for i in range(40)]
    # The same line on another host, and an id and text twice, one of them there.
    rows += [(50, "menu home 11\nx", "other"), (0, rows[0][1], "h"), (0, rows[0][1], "other"), (60, None, "h"), (None, "menu home 00", "h"), (61, "menu home 22\n", None)]
    got = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "source").collect()
    want = [(i, "\n" + own[i], 6) for i in range(40)] + [(50, rows[40][1], 0), (0, "\n" + own[0], 6), (0, rows[0][1], 0), (60, None, 0), (None, "", 3), (61, "menu home 22\n", 0)]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_removed"]) for r in got))) == sorted(map(repr, want))
    assert [r["kept"] for r in got if r["doc_id"] == 5] == [True]


def test_secrets_of_letters_only_are_replaced():
    for text in ("password: swordfishes", "passwd=hunterabcd", "pwd = correcthorse", "AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcdEFGH" * 4 + "abcd"):
        new, n = pii.pseudonymise(text, b"k" * 32)
        assert n == 1 and new != text and len(new) == len(text)
    assert pii.pseudonymise("a word to pass on: keys and tokens", b"k" * 32) == ("a word to pass on: keys and tokens", 0)


def test_long_secrets_are_replaced_to_their_end():
    key, body = b"k" * 32, "aZ3x" * 400
    new, n = pii.pseudonymise(f"api_key={body} end", key)
    value = new.removeprefix("api_key=").removesuffix(" end")
    assert n == 1 and len(value) == len(body)
    assert all(value[i : i + 16] != body[i : i + 16] for i in range(0, len(body), 16))
    # Equal chunks after different ones are replaced differently, and the first 64 characters as they are alone.
    assert value[64:128] != value[:64] == pii.pseudonymise(f"api_key={body[:64]} end", key)[0][8:72]


def test_ibans_before_other_words():
    key, ibans = b"k" * 32, ["AT61 1904 3002 3457 3201", "ES9121000418450200051332", "SE45 5000 0000 0583 9825 7466"]
    for iban in ibans:
        alone = pii.pseudonymise(iban, key)[0]
        assert alone != iban
        for after in ("", " EUR", " 2024", ", EUR", " EUR 20"):
            assert pii.pseudonymise(f"to {iban}{after}", key) == (f"to {alone}{after}", 1)
    both = pii.pseudonymise(" ".join(ibans), key)
    assert both == (" ".join(pii.pseudonymise(i, key)[0] for i in ibans), 3)
    assert pii.pseudonymise("ES9221000418450200051332 EUR", key)[1] == 0
