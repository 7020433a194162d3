"""What several corpus operators need: tables in the shared folder, word arrays, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..tables import discard, materialize, new_path, shared_folder

__all__ = ["components", "discard", "materialize", "new_path", "shared_folder", "give_back", "pieces", "word_arrays", "word_hashes", "rows_of", "mixed", "grouped", "hook", "component_ids", "buckets", "dealt", "tiled", "tiles"]

#: The characters between words: space, and tab to carriage return. bytes.split() and Arrow's ASCII split part at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Return freed memory to the system: at a task's end, as workers live on between tasks, and where a process has little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of about most_bytes of text, so that arrays made of their words stay small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
    give_back()


def word_arrays(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each row and the end, code of each word, distinct words by code). A null text has no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(text)), counts)[full.to_numpy(zero_copy_only=False)]
    starts = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(text)), out=starts[1:])
    coded = pc.dictionary_encode(flat.filter(full))
    return starts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def rows_of(starts: np.ndarray) -> np.ndarray:
    """The row that each word is in."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes become well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(batches: Iterator[pa.RecordBatch], key: str, most_rows: int = 1 << 17) -> Iterator[pa.Table]:
    """From batches sorted by key, tables that hold all rows of the keys in them; about most_rows, or one key's rows if those are more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most_rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
            most_rows = max(most_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over whole arrays: join a[i] with b[i]; every entry of root ends at its group's smallest index."""
    while True:
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if (lo == hi).all():
            return
        np.minimum.at(root, hi, lo)
        while (root != root[root]).any():
            root[:] = root[root]


def component_ids(classes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label, component_id for every row of classes (node, real): the smallest node that links (a, b) between nodes reach,
    and the smallest real, null if all those are null."""
    labels = components(links).toDF("node", "label")
    known = classes.select("node", "real").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("real").alias("component_id"))
    return known.join(least, "label").select("node", "label", "component_id")


def tiled(spread: DataFrame, tile: int) -> DataFrame:
    """Rows (key, node, ...) dealt out by key and sorted, for tiles(): with lo, hi and own. A key of over `tile` rows is dealt to
    tiles, and each of its rows goes to every pair of tiles with its own one in it, so that no task gets a hot key whole, all
    pairs of a key's rows still meet, and each once. The keys over `tile` are a table of at most rows / tile entries, whose size
    Spark knows when it chooses the join."""
    sizes = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile), "large", few_files=True)
    rows = spread.join(sizes, "key", "left").withColumn("_tiles", F.coalesce(F.ceil(F.col("_n") / tile), F.lit(1)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "_tiles").cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    rows = rows.withColumn("lo", F.least("own", "_b")).withColumn("hi", F.greatest("own", "_b")).drop("_n", "_tiles", "_b")
    return dealt(rows)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def buckets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(first row, rows, (left, right)) of each key and pair of tiles in a table of dealt rows; left and right count from its
    first row: they are the same array, or the rows of two tiles."""
    key, lo, hi, own = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "own"))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    size = np.diff(np.append(first, len(key)))
    sides = []
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        at = np.arange(n) if n > 1 else _ONE
        sides.append((at, at) if lo[a] == hi[a] else (np.flatnonzero(own[a : a + n] == lo[a]), np.flatnonzero(own[a : a + n] == hi[a])))
    return first, size, sides


_ONE = np.zeros(1, np.int64)


def tiles(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 17) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, left, right) of each key and pair of tiles with two rows or more."""
    for table in grouped(batches, "key", most_rows):
        for a, n, (left, right) in zip(*buckets(table), strict=True):
            if n > 1:
                yield table.slice(a, n), left, right
