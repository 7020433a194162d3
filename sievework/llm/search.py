"""Ranked lexical search over a two-level index: a byte for each impact, whose steps bound a score from both sides, and the counts
from which a score is taken exactly where its upper bound asks for it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running_total
from .shared import discard, materialize, pieces, rows_of, word_arrays

#: Impacts are below a million; a byte counts them in such steps, rounded up.
STEP = 3922
#: By byte: a letter or digit of ASCII, lower-cased, or a part of a character beyond ASCII stays; all others are spaces.
_LEVELLED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Places (document, item) and additions to them that a step of a task handles at once.
_CELLS = 1 << 20


@dataclass(frozen=True)
class Index:
    """postings: row, id, n, m, terms (a document's distinct ones, joined by spaces), tf and impacts (in the terms' order), for each
    document with a term. vocabulary: term, df. n_docs and n_terms: documents with a term, and all their terms."""

    postings: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int

    def discard(self) -> None:
        discard(self.postings)
        discard(self.vocabulary)


def _levelled(text: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of texts of which only their terms are left, each in its place. Null texts are empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return at - at[0], (data.to_pybytes()[at[0] : at[-1]] if data else b"").translate(_LEVELLED)


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """word_arrays() of the texts' terms."""
    at, data = _levelled(text)
    return word_arrays(pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch, how many texts have a term, and how many terms there are."""
    for batch in pieces(batches, "_text"):
        at, data = _levelled(batch.column("_text"))
        full = np.frombuffer(data, np.uint8) != 32
        first = full.copy()
        first[1:] &= ~full[:-1]
        edge = at[:-1][at[:-1] < len(full)]
        first[edge] = full[edge]
        n = np.diff(np.concatenate(([0], np.cumsum(first)))[at])
        yield pa.RecordBatch.from_pydict({"docs": [int((n > 0).sum())], "terms": [int(n.sum())]})


def _impacts(w: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * w // (1000 * w + 20 * m)


def _lists(kind: type, starts: np.ndarray, values: np.ndarray) -> pa.Array:
    if kind is pa.BinaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(values.tobytes())])
    return kind.from_arrays(pa.array(starts.astype(np.int32)), values)


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all of docs.

    Terms are the runs of letters and digits of ASCII and of characters beyond it, in whole texts, A-Z lower-cased. Null and blank
    texts have none and are left out, and so don't count; rows of null or repeated ids are documents like others. An empty table
    makes an empty index; other columns are not read. Texts are read twice, as an impact depends on all texts' sizes; postings stay
    where their documents are, so nothing but the vocabulary's counts is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sizes = rows.select("_text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = sizes["docs"] or 0, sizes["terms"] or 0

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            starts, codes, words = _terms(batch.column("_text"))
            n = np.diff(starts)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            key, tf = np.unique(rows_of(starts) * len(words) + codes, return_counts=True)
            row, m = key // len(words), 50 + 50 * n * n_docs // n_terms
            at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))[some])))
            steps = -(-_impacts(tf, m[row]) // STEP)
            terms = pc.binary_join(_lists(pa.ListArray, at, words.take(pa.array(key % len(words))).cast(pa.string())), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(some)), pa.array(n[some]), pa.array(m[some]), terms, _lists(pa.ListArray, at, pa.array(tf.astype(np.int32))), _lists(pa.BinaryArray, at, steps.astype(np.uint8))],
                ["id", "n", "m", "terms", "tf", "impacts"],
            )

    postings = rows.mapInArrow(post, "id long, n long, m long, terms string, tf array<int>, impacts binary")
    postings = materialize(postings.withColumn("row", F.monotonically_increasing_id()), "postings")
    words = postings.select(F.explode(F.split("terms", " ")).alias("term"))
    return Index(postings, materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "vocabulary"), n_docs, n_terms)


@dataclass(frozen=True)
class _Asked:
    """A block of items: their distinct terms, and for each term its run of entries (an item's number, the weight)."""

    words: pa.Array
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    w: np.ndarray
    n_items: int


def _asked(entries: pa.Table) -> tuple[_Asked, pa.Table]:
    """The block, and its items by number."""
    items = entries.select(["item", "item_id"]).group_by(["item", "item_id"]).aggregate([])
    number = pc.index_in(entries["item"].combine_chunks(), value_set=items["item"].combine_chunks()).to_numpy()
    coded = entries["term"].combine_chunks().dictionary_encode()
    term = coded.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    count = np.bincount(term, minlength=len(coded.dictionary))
    return _Asked(coded.dictionary, np.cumsum(count) - count, count, number[order], entries["w"].to_numpy()[order], len(items)), items


class _Best:
    """The best k documents of each item so far; ties by id, null ids last, then by row."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.full(n_items, -1, np.int64)
        self.found = np.empty((5, 0), np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        x = np.hstack([self.found, np.stack([item, score, none, ids, row])])
        x = x[:, np.lexsort((x[4], x[3], x[2], -x[1], x[0]))]
        start = np.searchsorted(x[0], x[0])
        self.found = x[:, np.arange(x.shape[1]) - start < self.k]
        last = np.flatnonzero((np.arange(x.shape[1]) - start) == self.k - 1)
        self.least[x[0, last]] = np.maximum(self.least[x[0, last]], x[1, last])


def _scored(asked: _Asked, best: _Best, doc: np.ndarray, term: np.ndarray, steps: np.ndarray, tf: np.ndarray, m: np.ndarray, of: tuple[np.ndarray, ...]) -> None:
    """Bounds of all documents (postings by doc from 0) for all items; exact scores of those whose upper bound reaches the k-th
    best lower bound."""
    n, reps = len(of[0]), asked.count[term]
    at = np.repeat(np.arange(len(term)), reps)
    entry = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps) + asked.first[term][at]
    item, w = asked.item[entry], asked.w[entry]
    cell = doc[at] * asked.n_items + item
    upper = np.bincount(cell, w * steps[at], n * asked.n_items).astype(np.int64).reshape(n, -1) * STEP
    lower = upper - np.bincount(cell, w, n * asked.n_items).astype(np.int64).reshape(n, -1) * STEP
    if n >= best.k:
        best.least = np.maximum(best.least, np.partition(lower, n - best.k, axis=0)[n - best.k])
    wanted = ((upper >= best.least) & (upper > 0)).ravel()
    mine = np.flatnonzero(wanted[cell])
    place = np.flatnonzero(wanted)
    score = np.zeros(len(place), np.int64)
    p = at[mine]
    np.add.at(score, np.searchsorted(place, cell[mine]), w[mine] * _impacts(tf[p].astype(np.int64), m[doc[p]]))
    some = score > 0
    d, i = np.divmod(place[some], asked.n_items)
    best.add(i, score[some], *(x[d] for x in of))


def _searched(asked: _Asked, items: pa.Table, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = _Best(asked.n_items, k)
    for batch in pieces(batches, "terms", 1 << 20):
        starts, codes, words = word_arrays(batch.column("terms"))
        known = pc.fill_null(pc.index_in(words.cast(asked.words.type), value_set=asked.words), -1).to_numpy()
        term, doc = known[codes], rows_of(starts)
        steps = np.frombuffer(b"".join(batch.column("impacts").to_pylist()), np.uint8)
        tf = batch.column("tf").flatten().to_numpy()
        hit = np.flatnonzero(term >= 0)
        doc, term, steps, tf = doc[hit], term[hit], steps[hit].astype(np.int64), tf[hit]
        ids, m, row = batch.column("id"), batch.column("m").to_numpy(), batch.column("row").to_numpy()
        of = (pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(ids, 0).to_numpy(), row)
        work = np.cumsum(np.bincount(doc, asked.count[term], batch.num_rows) + asked.n_items)
        cuts = [0, *(np.flatnonzero(np.diff(work // _CELLS)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            a, b = np.searchsorted(doc, (lo, hi))
            if b > a:
                _scored(asked, best, doc[a:b] - lo, term[a:b], steps[a:b], tf[a:b], m[lo:hi], tuple(x[lo:hi] for x in of))
    item, score, none, ids, row = best.found
    number = pa.array(item)
    yield pa.RecordBatch.from_arrays([items["item"].combine_chunks().take(number), items["item_id"].combine_chunks().take(number), pa.array(score), pa.array(ids, mask=none == 1), pa.array(row)], ["item", "item_id", "score", "doc_id", "row"])


def ranked(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block: int = 1 << 18) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each of items, of those with a score above 0.

    A document scores weight x impact for each of an item's distinct terms that it holds; the weight falls with the number of
    documents that hold the term, the impact grows with its occurrences and falls with the document's length. Scores are exact
    integers; ties go by id, null ids last, then by row. Items of null or blank texts, and those no document shares a weighted
    term with, have no rows; items of null or repeated ids are answered one by one. An empty table of items or documents gives an
    empty result; other columns are not read.

    Items go through the index in blocks of `block` pairs of item and term (or of one item with more), all that tasks are given at
    once. In a task, bytes bound the scores of all its documents; those whose upper bound reaches the k-th best lower bound there,
    and so every one that reaches that of all documents, are scored exactly, and each task returns k rows for an item at most.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            starts, codes, words = _terms(batch.column("_text"))
            if len(codes):
                key = np.unique(rows_of(starts) * len(words) + codes)
                mine = pa.array(key // len(words))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(mine), batch.column("item_id").take(mine), words.take(pa.array(key % len(words))).cast(pa.string())], ["item", "item_id", "term"])

    spark = items.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("_text"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    entries = rows.mapInArrow(terms, "item long, item_id long, term string").join(index.vocabulary, "term").select("item", "item_id", "term", weight.alias("w")).where("w > 0")
    entries = materialize(entries, "entries")
    placed = running_total(entries.groupBy("item").agg(F.count(F.lit(1)).alias("_n")), "item", "_n").select("item", F.floor((F.col("running") - F.col("_n")) / block).alias("_block"))
    entries = materialize(entries.join(placed, "item"), "entries")
    found = []
    for (b,) in entries.select("_block").distinct().orderBy("_block").toLocalIterator():
        asked, numbered = _asked(entries.where(F.col("_block") == b).select("item", "item_id", "term", "w").toArrow())
        hits = index.postings.select("row", "id", "m", "terms", "tf", "impacts").mapInArrow(lambda x, a=asked, n=numbered: _searched(a, n, k, x), "item long, item_id long, score long, doc_id long, row long")
        found.append(materialize(hits, "hits"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), g AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score FROM w JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
