"""Substring deduplication: an index of window fingerprints in sorted immutable runs, merged with each new batch and compacted.

Two windows of `width` words are equal only if they hold the same k-word gram of least hash at the same place. So what is
indexed is that anchor: a run of windows in a row with one anchor is one entry, with a hash of all words that they span. Equal
entries make all their windows repeated. Where an anchor has entries that differ, the windows themselves are compared. Each
comparison takes the anchor's 64 bits and the 64 of another hash together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, mixed, new_path, pieces, rows_of, word_arrays, word_hashes

_ANCHOR, _SPAN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPAN_BACK = np.uint64(pow(int(_SPAN), -1, 1 << 64))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k hashes in a row, by doubling."""
    out, width, power, step, factor = None, 0, h, 1, int(_ANCHOR)
    while k:
        if k & 1:
            out = power if out is None else out[: len(power) - width] * np.uint64(factor) + power[width:]
            width += step
        k >>= 1
        if k:
            power = power[:-step] * np.uint64(factor) + power[step:]
            step, factor = 2 * step, factor * factor % (1 << 64)
    return mixed(out)


def _least(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(least of each w entries in a row, whether it is there twice), by doubling over disjoint halves."""
    out = twice = None
    low, two, step, width = g, np.zeros(len(g), bool), 1, 0
    while w:
        if w & 1:
            if out is None:
                out, twice = low, two
            else:
                a, b = out[: len(low) - width], low[width:]
                twice = np.where(a < b, twice[: len(a)], two[width:] & (a >= b) | (a == b))
                out = np.minimum(a, b)
            width += step
        w >>= 1
        if w:
            a, b = low[:-step], low[step:]
            two = np.where(a < b, two[:-step], two[step:] & (a >= b) | (a == b))
            low, step = np.minimum(a, b), 2 * step
    return out, twice


class _Spans:
    """A 64-bit hash of any stretch of words, from sums of powers."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            ones = np.full(len(h), _SPAN, np.uint64)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(ones))))
            self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), _SPAN_BACK, np.uint64))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _entries(starts: np.ndarray, h: np.ndarray, h2: np.ndarray, width: int, k: int):
    """(row, first window in the row, windows, anchor, span hash, tied) of each run of windows with one anchor. tied: equal
    windows may be within the run."""
    none = np.empty(0, np.int64)
    n = len(h) - width + 1
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    low, twice = _least(_grams(h, k), width - k + 1)
    row = rows_of(starts)
    valid = row[:n] == row[width - 1 :]
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    m, r = low[s], row[s]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (r[1:] != r[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    at = s[first]
    tied = (np.add.reduceat(twice[s].astype(np.int64), first) > 0) | (count > width - k + 1)
    return r[first], at - starts[r[first]], count, m[first], _Spans(h2).of(at, at + count + width - 1), tied


_KEY = "_k long, _j int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_k, _j: 96 bits that stand for a row's id and text; rows equal in both have one result."""
    return docs.select(F.xxhash64(id_col, text_col).alias("_k"), F.hash(F.lit(1), id_col, text_col).alias("_j"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def entries(rows: DataFrame, width: int, k: int) -> DataFrame:
    """_k, _j, start, windows, fp, span, tied for the texts of rows (_k, _j, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            starts, codes, words = word_arrays(batch.column("_text"))
            row, start, count, fp, span, tied = _entries(starts, word_hashes(words, 11)[codes], word_hashes(words, 12)[codes], width, k)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k").take(take), batch.column("_j").take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(span.view(np.int64)), pa.array(tied)],
                ["_k", "_j", "start", "windows", "fp", "span", "tied"],
            )

    return rows.select("_k", "_j", "_text").mapInArrow(run, f"{_KEY}, start int, windows int, fp long, span long, tied boolean")


_RUN = "fp long, span long, n long, tied boolean"


class FingerprintIndex:
    """Runs of (fp, span, n, tied): immutable tables sorted by fp and span in a folder, which append() adds to and compact()
    merges into one. Equal entries are one row of a run, however many documents hold them. A log of the runs that count, a table
    of numbered states in the same folder, is what makes a run part of the index: one half written is never read, and an index is
    opened again by the path of its folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = 8):
        self.spark, self.most_runs = spark, most_runs
        self.path = path or new_path(spark, "index")
        try:
            states = spark.read.schema("state long, runs array<string>").parquet(f"{self.path}/log").orderBy(F.col("state").desc()).limit(1).collect()
        except AnalysisException:  # a new folder
            states = []
        self.state, self.names = (states[0]["state"], list(states[0]["runs"])) if states else (0, [])

    def _log(self, names: list[str]) -> None:
        self.state, self.names = self.state + 1, names
        self.spark.createDataFrame([(self.state, names)], "state long, runs array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, counts: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("fp", "span").write.parquet(f"{self.path}/{name}")
        return name

    def entries(self) -> DataFrame:
        """fp, span, n, tied of all runs, an entry at most once in each run."""
        if not self.names:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*(f"{self.path}/{name}" for name in self.names))

    def append(self, batch: DataFrame) -> DataFrame:
        """Merge a batch's entries (fp, span, tied) with the runs so far, and add them as a new run. Returns fp, the anchors of
        the batch at which windows may be repeated: those that an earlier run holds too, and those that the batch holds more than
        once or in a run of windows that may repeat itself. Over all batches, these are all such anchors of the index."""
        name = self._write(batch.groupBy("fp", "span").agg(F.count(F.lit(1)).alias("n"), F.max("tied").alias("tied")))
        new = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")
        own = new.groupBy("fp").agg(F.sum("n").alias("t"), F.max("tied").alias("any"))
        older = self.entries().select("fp").distinct().withColumn("known", F.lit(True))
        touched = own.join(older, "fp", "left").where("t > 1 or any or known").select("fp")
        touched = materialize(touched, "touched")
        self._log([*self.names, name])
        if len(self.names) > self.most_runs:
            self.compact()
        return touched

    def compact(self) -> None:
        """One run in place of all: counts of equal entries are added up. The old runs are removed once the log is written."""
        old = self.names
        if len(old) < 2:
            return
        gone = [self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}") for name in old]
        self._log([self._write(self.entries().groupBy("fp", "span").agg(F.sum("n").alias("n"), F.max("tied").alias("tied")))])
        for run in gone:
            discard(run)


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """_k, _j, pos, fp, window, weight: the hash of each window of the stretches `parts` (start, windows, fp, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            starts, codes, words = word_arrays(batch.column("_text"))
            spans = _Spans(word_hashes(words, 12)[codes])
            parts = batch.column("parts")
            flat = parts.flatten()
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(parts).to_numpy())
            start, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            part = np.repeat(np.arange(len(flat)), count)
            pos = start[part] + np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
            at = starts[row[part]] + pos
            take, of = pa.array(row[part]), pa.array(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k").take(take), batch.column("_j").take(take), pa.array(pos.astype(np.int32)), flat.field(2).take(of), pa.array(spans.of(at, at + width).view(np.int64)), flat.field(3).take(of)],
                ["_k", "_j", "pos", "fp", "window", "weight"],
            )

    return rows.mapInArrow(run, f"{_KEY}, pos int, fp long, window long, weight int")


#: Parts that rows of a hot window are dealt to.
_SALTS = 32


def _repeated(windows: DataFrame) -> DataFrame:
    """The rows of weight 1 whose (fp, window) is there more than once. Rows are told of others in their own part of a key first;
    only those that are alone in theirs, a few for each key however hot, meet the count of the whole key."""
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("_k", "_j", "pos"), F.lit(_SALTS)))
    own = materialize(salted.withColumn("own", F.sum("weight").over(Window.partitionBy("fp", "window", "salt"))), "windows")
    alone = own.where("own = 1")
    # A key's parts, each a row: more than one, or one with more than a window in it.
    seen = own.groupBy("fp", "window").agg(F.min("salt").alias("a"), F.max("salt").alias("z"), F.max("own").alias("most")).where("a < z or most > 1").select("fp", "window")
    return own.where("own > 1").drop("own").unionByName(alone.join(seen, ["fp", "window"]).drop("own")).where("weight = 1")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, k: int = 8, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """id_col, n_words, n_removed, kept: for each row, its words that no window covers which also starts anywhere else, joined
    by spaces. Windows are `width` words in a row of one text, compared as they are; null texts have none.

    The rows come to the index in `batches` by a hash, as days of a crawl would; the result doesn't depend on how. Only anchors
    that the merges found are looked up in it, and only texts that hold them are looked at again. With an index of earlier
    documents, which are not among docs, stretches of windows that they hold too are repeated; only where a shared passage begins
    and ends, windows under one anchor of which the earlier text has more or fewer are compared among docs alone. Null and repeated ids are rows like others, and rows equal in id and text
    repeat each other; an empty table gives an empty result; other columns are not read. A passage that a third of all documents
    hold is one row of each task before any shuffle by content; where rows meet their entries again, the join's large partitions
    can be split, and hot windows are dealt to parts. Two windows are taken as equal where two independent 64-bit hashes of
    theirs are, one of eight words and one of all of their words: for 10^12 windows a false match has a probability of 10^-14.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col)
    index = index or FingerprintIndex(spark)
    found = materialize(entries(rows, width, k), "entries")
    touched = [index.append(found.where(F.pmod("_j", F.lit(batches)) == b).select("fp", "span", "tied")) for b in range(batches)]
    every = touched[0]
    for t in touched[1:]:
        every = every.union(t)
    at = index.entries().join(every.distinct(), "fp").groupBy("fp", "span").agg(F.sum("n").alias("n"), F.max("tied").alias("tied"))
    at = materialize(at, "at")
    anchors = at.groupBy("fp").agg(F.count(F.lit(1)).alias("spans"), F.max("tied").alias("any_tied"))
    known = materialize(at.join(anchors, "fp").selectExpr("fp", "span", "n > 1 as whole", "spans > 1 or any_tied as open").where("whole or open"), "repeated")
    hits = materialize(found.drop("tied").join(known, ["fp", "span"]), "hits")
    for t in (*touched, at, known, found):
        discard(t)
    single = hits.where("open and not whole").select("_k", "_j", F.struct("start", "windows", "fp", F.lit(1).alias("weight")).alias("p"))
    first = hits.where("open and whole").groupBy("fp", "span").agg(F.min(F.struct("_k", "_j", "start", "windows")).alias("m"))
    first = first.select("m._k", "m._j", F.struct("m.start", "m.windows", "fp", F.lit(2).alias("weight")).alias("p"))
    # Sets: rows equal in id and text find the same.
    asked = single.union(first).groupBy("_k", "_j").agg(F.collect_set("p").alias("parts"))
    texts = rows.select("_k", "_j", "_text").join(asked, ["_k", "_j"]).dropDuplicates(["_k", "_j"])
    more = _repeated(_windows(texts, width)).select("_k", "_j", F.col("pos").alias("start"), F.lit(1).alias("windows"))
    cover = hits.where("whole").select("_k", "_j", "start", "windows").union(more).groupBy("_k", "_j").agg(F.collect_set(F.struct("start", "windows")).alias("cover"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            texts = pc.fill_null(batch.column("_text"), "").cast(pa.binary()).to_pylist()
            lists = batch.column("cover")
            flat, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start, count = (flat.field(i).to_numpy() for i in (0, 1))
            n_words, n_removed, kept = [], [], []
            lo = 0
            for t, hi in zip(texts, ends.tolist(), strict=True):
                words = t.split()
                if hi > lo:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, start[lo:hi], 1)
                    np.add.at(depth, start[lo:hi] + count[lo:hi] + width - 1, -1)
                    own = [w for w, gone in zip(words, (np.cumsum(depth[:-1]) > 0).tolist(), strict=True) if not gone]
                else:
                    own = words
                lo = hi
                n_words.append(len(words))
                n_removed.append(len(words) - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_id", "n_words", "n_removed", "kept"])

    out = rows.join(cover, ["_k", "_j"], "left").select("_id", "_text", "cover")
    return out.mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("_id", id_col)
