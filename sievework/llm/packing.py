"""Best-fit packing of documents into sequences: linear grouping of large lengths, few-size configurations, best fit for the rest."""

from __future__ import annotations

import gc
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, pieces, word_arrays

#: Entries that a worker's tables of words and of their parts keep before they start afresh.
_MOST_WORDS, _MOST_PARTS = 50_000, 400_000
#: Words of which the tokenizer's own splitting rule can be followed here: ASCII and Latin-1 letters, no special token. Those with
#: an apostrophe are split one by one, all others at once by the kinds of their bytes.
_PLAIN, _SIMPLE = r"^[\x21-\x7eÀ-ÖØ-öø-ÿ]+$", r"^[\x21-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]+$"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Kinds of bytes of lower-cased plain words: 1 letters (bytes over 127 are parts of letters), 2 digits, 3 others.
_KIND = np.full(256, 3, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[128:] = 1
_KIND[ord("0") : ord("9") + 1] = 2


class _Words:
    """Token ids, as little-endian unsigned 32-bit numbers, of words between white space: looked up, or made by tokenizers.

    A tokenizer that lower-cases, splits words into runs of letters, single digits and runs of others, and ends each part's last
    token with </w> is asked for new parts only, many at once; any other one, and words that aren't plain, for whole words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_parts = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") and spec["model"].get("end_of_word_suffix") == "</w>"
        self.by_parts &= "Lowercase" in json.dumps(spec["normalizer"])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _of_parts(self, names: list[str]) -> list[bytes]:
        known = self.parts
        new = [p for p in names if p not in known]
        if len(known) + len(new) > _MOST_PARTS:
            self.parts = known = {}
            new = names
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = self._encode(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                cuts = [0, *ends.tolist()]
                known.update((p, ids[a:z].tobytes()) for p, a, z in zip(some, cuts, cuts[1:], strict=False))
            else:
                known.update((p, self._encode(p).tobytes()) for p in some)
        return [known[p] for p in names]

    def _one_by_one(self, words: list[str], plain: list[bool]) -> list[bytes]:
        if len(self.words) > _MOST_WORDS:
            self.words = {}
        for word, simple in zip(words, plain, strict=True):
            if word not in self.words:
                self.words[word] = b"".join(self._of_parts(_PARTS.findall(word.lower()))) if simple else self._encode(word).tobytes()
        return [self.words[w] for w in words]

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, length): word i has the ids from first[i] on."""
        words = words.cast(pa.large_string())
        special = pc.match_substring(words, "<|")
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), special) if self.by_parts else pa.array(np.zeros(len(words), bool))
        simple = pc.and_(plain, pc.match_substring_regex(words, _SIMPLE))
        at, odd = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (simple, pc.invert(simple)))
        first, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        # All simple words' bytes in a row: a part begins with a word, where the kind changes, and at each digit.
        low = pc.utf8_lower(words.take(pa.array(at)))
        edges = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
        data = np.frombuffer(low.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.empty(0, np.uint8)
        ends = edges[1:] - edges[0]
        kind = _KIND[data]
        begins = np.concatenate((np.ones(min(1, len(kind)), bool), (kind[1:] != kind[:-1]) | (kind[1:] == 2)))
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))
        coded = pc.dictionary_encode(parts)
        code = coded.indices.to_numpy(zero_copy_only=False)
        found = self._of_parts(coded.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[code]
        sums = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - sums[:-1], n) + np.arange(sums[-1])]
        cut = sums[np.concatenate(([0], np.searchsorted(starts, ends)))]
        first[at], length[at] = cut[:-1], np.diff(cut)
        if len(odd):
            rest = pa.array(odd)
            own = self._one_by_one(words.take(rest).to_pylist(), plain.take(rest).to_pylist())
            length[odd] = np.fromiter(map(len, own), np.int64, len(own)) // 4
            first[odd] = len(ids) + np.cumsum(length[odd]) - length[odd]
            ids = np.concatenate((ids, np.frombuffer(b"".join(own), "<u4")))
        return ids, first, length


@cache
def _words(path: str) -> _Words:
    """A worker process keeps its table from task to task."""
    return _Words(path)


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """id_col, piece, start, length, ids: a row for each piece of at most capacity ids; each document ends with end_id.

    ids are little-endian unsigned 32-bit integers, 4 * length bytes: np.frombuffer(ids, "<u4"). Words between ASCII white space
    are tokenized one by one and remembered: for a tokenizer that never joins across white space this gives the ids of the whole
    text. A null text is an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        for batch in pieces(batches, "_text", 2 << 20):
            starts, codes, distinct = word_arrays(batch.column("_text"))
            gc.disable()  # many small objects and no cycles among them
            flat, first, lens = words.ids(distinct)
            gc.enable()
            n = lens[codes]
            ends = np.cumsum(n)
            own = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(int(n.sum()))]
            bounds = np.concatenate(([0], ends))[starts]
            own = np.insert(own, bounds[1:], end_id)
            sizes = np.diff(bounds) + 1
            parts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(capacity, sizes[row] - piece * capacity)
            at = np.concatenate(([0], np.cumsum(length)))
            for lo in range(0, len(row), 1024):
                hi = min(lo + 1024, len(row))
                values = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * (at[lo : hi + 1] - at[lo])).astype(np.int32)), pa.py_buffer(own[at[lo] : at[hi]].astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(row[lo:hi])), pa.array(piece[lo:hi].astype(np.int32)), pa.array(piece[lo:hi] * capacity), pa.array(length[lo:hi]), values], ["_id", "piece", "start", "length", "ids"]
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("_id", id_col)


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(items of each size, how often) of the fractional packing with fewest bins, by column generation: the dual prices of a
    basis, and the dearest configuration that fits under them by a knapsack over the capacity."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(counts, float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = [i for i in range(k) if price[i] > 1e-12]
        for i in order:
            s, p = sizes[i], price[i]
            # An unbounded knapsack: at most capacity // s more of this size, each step a shift of the whole row.
            for _ in range(capacity // s):
                better = value[:-s] + p > value[s:] + 1e-12
                if not better.any():
                    break
                at = np.flatnonzero(better) + s
                value[at] = value[at - s] + p
                choice[at] = i
        column, left = np.zeros(k), capacity
        while left > 0:
            if choice[left] < 0:
                left -= 1
                continue
            column[choice[left]] += 1
            left -= sizes[choice[left]]
        if column @ price <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k) if x[j] > 1e-9]


class _Bins:
    """Bins in runs of equal free space. A placement (length, lo, hi, sequence, offset, per_bin) puts the pieces of that length
    ranked lo to hi - 1 into bins from sequence on, per_bin to each, the first of each at offset."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.placements = capacity, 0, []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []

    def keep(self, free: int, first: int, n: int) -> None:
        if n > 0 and free > 0:
            if free not in self.runs:
                self.runs[free] = []
                insort(self.free, free)
            self.runs[free].append((first, n))

    def open(self, n: int) -> int:
        self.used += n
        return self.used - n

    def fit(self, length: int, lo: int, hi: int) -> None:
        """Best fit: into the bins with least free space that take this length, as many to each as fit; then into new ones."""
        while lo < hi:
            at = bisect_left(self.free, length)
            if at < len(self.free):
                free = self.free[at]
                first, n = self.runs[free].pop()
                if not self.runs[free]:
                    del self.runs[free]
                    self.free.pop(at)
            else:
                free = self.capacity
                n = -(-(hi - lo) // (free // length))
                first = self.open(n)
            per = free // length
            take = min(hi - lo, n * per)
            self.placements.append((length, lo, lo + take, first, self.capacity - free, per))
            full, rest = divmod(take, per)
            self.keep(free - per * length, first, full)
            self.keep(free - rest * length, first + full, int(rest > 0))
            self.keep(free, first + full + (rest > 0), n - full - (rest > 0))
            lo += take


def solve(histogram: dict[int, int], capacity: int = 4096, groups: int = 48, small: int = 512) -> tuple[list[tuple[int, ...]], int]:
    """(placements, bins) for so many pieces of each length. All it holds grows with the number of lengths, at most capacity.

    Lengths over `small` are dealt, longest first, to groups of equal numbers of pieces, and rounded up to their group's
    longest; whole parts of the best fractional use of configurations of these sizes are made, their places filled with the
    pieces themselves; what is left over of the large pieces, then the small ones, longest first, go where they fit best.
    """
    bins = _Bins(capacity)
    for _ in range(histogram.get(capacity, 0) and 1):
        n = histogram[capacity]
        bins.placements.append((capacity, 0, n, bins.open(n), 0, 1))
    large = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if small < length < capacity and n > 0]
    total = sum(n for _, n in large)
    # Each group: its size, and its pieces as (length, lo, hi), longest first.
    queues: list[tuple[int, list[tuple[int, int, int]]]] = []
    done = 0
    for length, n in large:
        lo = 0
        while lo < n:
            group = done * groups // total
            take = min(n - lo, -(-(group + 1) * total // groups) - done)
            if done == -(-group * total // groups) or not queues:
                queues.append((length, []))
            queues[-1][1].append((length, lo, lo + take))
            lo, done = lo + take, done + take
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, segments in queues:
        by_size.setdefault(size, []).extend(segments)
    sizes = sorted(by_size, reverse=True)
    waiting = {size: by_size[size][::-1] for size in sizes}
    counts = [sum(hi - lo for _, lo, hi in by_size[size]) for size in sizes]
    for column, times in configurations(sizes, counts, capacity) if sizes else []:
        n = int(times + 1e-6)
        if not n:
            continue
        runs = [(capacity, bins.open(n), n)]
        for i, items in enumerate(column):
            for _ in range(items):
                filled = []
                for free, first, bins_left in runs:
                    queue = waiting[sizes[i]]
                    while bins_left and queue:
                        length, lo, hi = queue.pop()
                        take = min(bins_left, hi - lo)
                        bins.placements.append((length, lo, lo + take, first, capacity - free, 1))
                        filled.append((free - length, first, take))
                        if lo + take < hi:
                            queue.append((length, lo + take, hi))
                        first, bins_left = first + take, bins_left - take
                    if bins_left:
                        filled.append((free, first, bins_left))
                runs = filled
        for free, first, m in runs:
            bins.keep(free, first, m)
    rest = [seg for queue in waiting.values() for seg in queue] + [(length, 0, n) for length, n in histogram.items() if length <= small and n > 0]
    for length, lo, hi in sorted(rest, key=lambda x: (-x[0], x[1])):
        bins.fit(length, lo, hi)
    return bins.placements, bins.used


def packed(rows: DataFrame, id_col: str = "doc_id", capacity: int = 4096, per_bucket: int = 20_000) -> DataFrame:
    """rows (id_col, piece, length, ids, ...) with sequence_id and offset: which sequence holds each piece, and where. A sequence is
    the ids of its pieces by offset.

    Only the histogram of lengths comes to the driver (at most capacity rows), and only placements by length go back (their
    number is bounded by the lengths too, so they are broadcast). A piece finds its place by its rank among those of its
    length: by its place in a bucket of about per_bucket pieces, plus the sizes of the buckets before, so that a very common
    length is many tasks' work, whatever ids its rows have. Repeated rows and rows of null ids are pieces of their own; an empty
    table gives an empty result; further columns stay, whatever their names, but for a sequence_id or offset of their own, which
    the new ones replace. Ranks are found without the ids, which move once, to meet their place by a number that no two rows share.
    """
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), "length", F.col(f"`{id_col}`").alias("id"), "piece", F.crc32("ids").alias("crc"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements, _ = solve(histogram, capacity)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for p in placements:
        by_length.setdefault(p[0], []).append(p[1:])
    table = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], "length long, at array<struct<lo long, hi long, seq long, off long, per long>>")
    buckets = max(1, -(-sum(histogram.values()) // per_bucket))
    keyed = rows.select("row", "id", "piece", "length", "crc").withColumn("_b", F.pmod(F.xxhash64(F.col("id").cast("string"), "piece", "crc", "row"), F.lit(buckets)))
    ahead = keyed.groupBy(F.col("length").alias("_l"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("_l").orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("id", "piece", "crc", "row")) - 1
    ranked = keyed.withColumn("_r", rank).join(ahead.drop("_n"), (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_c"))).withColumn("_r", F.col("_r") + F.col("_ahead"))
    found = ranked.join(F.broadcast(table), "length").withColumn("_p", F.filter("at", lambda p: (p.lo <= F.col("_r")) & (F.col("_r") < p.hi))[0])
    k = F.col("_r") - F.col("_p.lo")
    seq = F.col("_p.seq") + F.floor(k / F.col("_p.per")).cast("long")
    off = F.col("_p.off") + (k % F.col("_p.per")) * F.col("length")
    return rows.select("row", "doc").join(found.select("row", seq.alias("sequence_id"), off.alias("offset")), "row").select("doc.*", "sequence_id", "offset")
