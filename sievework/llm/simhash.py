"""SimHash near-duplicates: fingerprints that differ in few bits share a block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import buckets, component_ids, dealt, discard, grouped, hook, materialize, mixed, pieces, tiled, tiles

#: Bits of shingles unpacked at once, in 64-bit words.
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and compared.

    words: 64-bit words of a fingerprint; distance: bits in which linked ones differ at most. The bits are cut into `blocks`
    equal blocks, and fingerprints meet that agree in `agree` of them, in a table for each choice of these blocks. By the
    pigeonhole principle these are all within the distance if agree <= blocks - distance; with fewer, wider blocks than that,
    pairs meet with a probability that grows with their similarity.
    """

    k: int = 3
    words: int = 1
    distance: int = 3
    blocks: int = 6
    agree: int = 3


#: All pairs within 3 of 64 bits.
EXACT = Scheme()


@dataclass(frozen=True)
class Similar:
    """How texts are found whose sets of k-word shingles have a Jaccard similarity of `least` or more.

    Fingerprints of 64 * words bits over a text's distinct shingles. At a similarity of 0.8 their cosine is 0.89, an angle of 27
    degrees, and 78 of 512 bits differ on average, with a deviation of 8. Those within `distance` bits, four deviations more,
    are candidates, compared by their sets; those within `certain` bits, 3.6 deviations less, are links as they are. They meet
    in tables whose keys are two bytes: each byte and the next, and `further` ones of bytes of different words. Of 48 they share
    one with a probability of 97 % at 0.8 and 99.8 % at 0.85. Sets of over `kept` shingles are compared by their least hashes
    up to the largest that both have, which are a sample of the union by hash, of `kept` or more: a deviation of 0.4 % at most.
    """

    least: float = 0.8
    k: int = 5
    words: int = 8
    distance: int = 110
    certain: int = 48
    further: int = 16
    kept: int = 8192

    def tables(self) -> list[tuple[int, int]]:
        n = 8 * self.words
        return [(i, i + 1) for i in range(0, n, 2)] + [(2 * i, (2 * i + n // 2 + 1) % n) for i in range(self.further)]


SIMILAR = Similar()


def _shingles(text: bytes, k: int, digest) -> np.ndarray:
    """The hash of each k-word shingle; of the whole sequence if it is shorter."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(tokens))
    n = len(tokens) - k + 1
    spans = map(slice, starts[:n].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(digest, map(joined.__getitem__, spans)), "<u8", n)


def _fingerprint(hashes: np.ndarray, words: int) -> bytes:
    n = len(hashes)
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, n, _BLOCK // words):
        part = hashes[lo : lo + _BLOCK // words]
        # Further words are made of the first by a bijective mix, each with its own start.
        wide = np.column_stack([part, *(mixed(part + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) for w in range(1, words))]) if words > 1 else part[:, None]
        ones += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """id_col, fp (an array of longs): the SimHash of each whole text's k-word shingles, repeats counted; A-Z is lower-cased first.

    A null or blank text gets 0; a text of fewer than k words is one shingle. The first word's hashes are XXH64, seed 42.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in pieces(batches, "_text"):
            texts = pc.fill_null(batch.column("_text"), "").cast(pa.binary()).to_pylist()
            flat = np.frombuffer(b"".join(_fingerprint(_shingles(t, scheme.k, digest), scheme.words) for t in texts), "<i8")
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * scheme.words, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists], ["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, fp array<long>").withColumnRenamed("_id", id_col)


def _keys(scheme: Scheme) -> list[Column]:
    """A key for each table: its number and the bits of its blocks. A block doesn't reach over the end of a 64-bit word."""
    per = scheme.blocks // scheme.words
    sizes = [64 // per + (i < 64 % per) for i in range(per)]
    parts = [(w, sum(sizes[:i]), sizes[i]) for w in range(scheme.words) for i in range(per)]
    keys = []
    for t, chosen in enumerate(combinations(parts, scheme.agree)):
        at, terms = 0, [f"{t}L * {1 << 48}L"]
        for w, shift, n in chosen:
            terms.append(f"shiftleft(shiftrightunsigned(fp[{w}], {shift}) & {(1 << n) - 1}L, {at})")
            at += n
        keys.append(F.expr(" + ".join(terms)))
    return keys


def _linked(fp: np.ndarray, sides: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of one side, or between those of two, that join all that their links join, at most one for each
    row: search outward from each."""
    waiting = list(sides)
    found, by, todo = [], [], []
    while True:
        if not todo:
            side = next((s for s, w in enumerate(waiting) if len(w)), None)
            if side is None:
                break
            todo.append((int(waiting[side][0]), side))
            waiting[side] = waiting[side][1:]
        at, side = todo.pop()
        other = 0 if len(sides) == 1 else 1 - side
        rest = waiting[other]
        near = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1) <= distance
        if near.any():
            got = rest[near]
            waiting[other] = rest[~near]
            found.append(got)
            by.append(np.full(len(got), at))
            todo.extend((x, other) for x in got.tolist())
    none = np.empty(0, np.int64)
    return (np.concatenate(by), np.concatenate(found)) if found else (none, none)


def links(reps: DataFrame, scheme: Scheme = EXACT, tile: int = 20_000, small: int = 32) -> DataFrame:
    """a, b: links between rows (fp, node) of distinct fingerprints that meet in a table and differ in at most distance bits;
    enough of them that whatever is connected through all such links is connected through these.

    A bucket yields fewer links than it has fingerprints; one of over `tile` fingerprints is dealt to pairs of tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "key"):
            fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
            node = table.column("node").to_numpy()
            first, size, sides = buckets(table)
            some = size <= small
            some &= [left is right for left, right in sides]
            member = np.repeat(some, size)
            bucket = np.repeat(np.arange(len(size)), size)
            root = np.arange(len(node))
            # Small buckets all at once: each row against the one o rows on.
            for o in range(1, int(size[some].max(initial=1))):
                i = np.flatnonzero(member[:-o] & (bucket[o:] == bucket[:-o]))
                i = i[np.bitwise_count(fp[i] ^ fp[i + o]).sum(axis=1) <= scheme.distance]
                hook(root, i, i + o)
            own = np.flatnonzero(root != np.arange(len(node)))
            out = [(own, root[own])]
            for b in np.flatnonzero(~some):
                left, right = sides[b]
                out.append(_linked(fp, [first[b] + left] if left is right else [first[b] + left, first[b] + right], scheme.distance))
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate([x[i] for x in out])]) for i in (0, 1)], ["a", "b"])

    spread = reps.select("node", "fp", F.explode(F.array(*_keys(scheme))).alias("key"))
    return tiled(spread, tile).mapInArrow(run, "a long, b long").distinct()


def _classes(fps: DataFrame, id_of: Column, scheme: Scheme) -> DataFrame:
    """fp, component_id for each distinct fingerprint: the smallest id of its component."""
    reps = fps.groupBy("fp").agg(F.min(id_of).alias("real")).withColumn("node", F.monotonically_increasing_id())
    reps = materialize(reps, "classes")
    return reps.join(component_ids(reps, links(reps, scheme)), "node").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """id_col (a long), fp (an array of longs), component_id: the smallest id that links between fingerprints reach; a row for
    each of docs.

    Documents with equal fingerprints, the blank ones among them, are one class. Rows of null or repeated ids are documents like
    others; a component of null ids alone has a null component_id. An empty table gives an empty result; other columns than
    these two are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t"))
    fps = materialize(fingerprints(rows, "_i", "_t", scheme), "fingerprints")
    return fps.join(_classes(fps, F.col("_i"), scheme), "fp").select(F.col("_i").alias(id_col), "fp", "component_id")


def _sets(rows: DataFrame, scheme: Similar) -> DataFrame:
    """key, fp, grams: the fingerprint of a text's distinct shingles, and the least 32-bit hashes of these in order."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in pieces(batches, "text"):
            prints, grams = [], []
            for text in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist():
                hashes = np.unique(_shingles(text, scheme.k, digest))
                prints.append(_fingerprint(hashes, scheme.words))
                grams.append(np.unique(hashes.astype(np.uint32).view(np.int32))[: scheme.kept])
            flat = pa.array(np.frombuffer(b"".join(prints), "<i8"))
            fps = pa.ListArray.from_arrays(np.arange(len(prints) + 1, dtype=np.int32) * scheme.words, flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), fps, pa.array(grams, pa.list_(pa.int32()))], ["key", "fp", "grams"])

    return rows.select("key", "text").mapInArrow(run, f"key {kind}, fp array<long>, grams array<int>")


def _words(table: pa.Table) -> np.ndarray:
    return np.ascontiguousarray(table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1))


def _first_met(fp: np.ndarray, a: np.ndarray, b: np.ndarray, tables: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs share no key of these (earlier) tables."""
    if not tables or not len(a):
        return np.ones(len(a), bool)
    parts = fp.view(np.uint8)
    same = parts[a] == parts[b]
    left, right = map(list, zip(*tables, strict=True))
    return ~(same[:, left] & same[:, right]).any(axis=1)


def _candidates(batches: Iterator[pa.RecordBatch], scheme: Similar, small: int) -> Iterator[pa.RecordBatch]:
    """Certain links (other, at), which join what all such links of a bucket join; and the rows (key, lo, hi, own) that are
    within the distance of a row there that certain links don't join with them and that no earlier table holds with them."""
    tables = scheme.tables()
    for table in grouped(batches, "key"):
        fp, key = _words(table), table.column("key").to_numpy()
        first, size, sides = buckets(table)
        some = size <= small
        some &= np.array([left is right for left, right in sides], bool)
        member, bucket = np.repeat(some, size), np.repeat(np.arange(len(size)), size)
        root, near, loose = np.arange(len(fp)), np.zeros(len(fp), bool), []

        def flag(x: np.ndarray, y: np.ndarray) -> None:
            """Rows of pairs in different groups that meet here first; pairs are of one table each run of keys."""
            apart = root[x] != root[y]  # noqa: B023
            x, y = x[apart], y[apart]
            number = key[x] >> 48  # noqa: B023
            for t in np.unique(number).tolist():
                i, j = x[number == t], y[number == t]
                new = _first_met(fp, i, j, tables[:t])  # noqa: B023
                near[i[new]] = near[j[new]] = True  # noqa: B023

        for o in range(1, int(size[some].max(initial=1))):
            i = np.flatnonzero(member[:-o] & (bucket[o:] == bucket[:-o]))
            far = np.bitwise_count(fp[i] ^ fp[i + o]).sum(axis=1)
            hook(root, i[far <= scheme.certain], i[far <= scheme.certain] + o)
            i = i[(far > scheme.certain) & (far <= scheme.distance)]
            loose.append((i, i + o))
        big = np.flatnonzero(~some)
        for b in big:
            left, right = (first[b] + side for side in sides[b])
            x, y = _linked(fp, [left] if sides[b][0] is sides[b][1] else [left, right], scheme.certain)
            hook(root, x, y)
        for x, y in loose:
            flag(x, y)
        for b in big:
            left, right = (first[b] + side for side in sides[b])
            groups, counts = np.unique(root[right], return_counts=True)
            if not len(left) or not len(right) or (len(groups) == 1 and (root[left] == groups[0]).all()):
                continue
            # The largest group needs no look at itself.
            main = groups[counts.argmax()]
            for one, all_of in ((left[root[left] != main], right), *(() if left is right else ((left[root[left] == main], right[root[right] != main]),))):
                for at in one.tolist():
                    others = all_of[np.bitwise_count(fp[all_of] ^ fp[at]).sum(axis=1) <= scheme.distance]
                    flag(np.full(len(others), at), others)
        own = np.flatnonzero(root != np.arange(len(root)))
        node = table.column("node").to_numpy()
        at, n = np.flatnonzero(near), len(own)
        # Links, then rows; each has nulls where the other has its columns.
        columns = [pa.concat_arrays([pa.nulls(n, kind), pa.array(table.column(c).to_numpy()[at], kind)]) for c, kind in _PLACE]
        nodes = pa.array(np.concatenate((node[own], node[at])))
        yield pa.RecordBatch.from_arrays([*columns, nodes, pa.concat_arrays([pa.array(node[root[own]]), pa.nulls(len(at), pa.int64())])], [*(c for c, _ in _PLACE), "node", "at"])


_PLACE = [("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.int32())]


def _similar(grams: list[np.ndarray], at: int, others: np.ndarray, scheme: Similar) -> np.ndarray:
    """Which of the others' sets are similar to that of `at`."""
    own, out = grams[at], np.zeros(len(others), bool)
    for n, o in enumerate(others.tolist()):
        a, b = own, grams[o]
        ends = [x[-1] for x in (a, b) if len(x) == scheme.kept]
        if ends:
            a, b = (x[: np.searchsorted(x, min(ends), "right")] for x in (a, b))
        if min(len(a), len(b)) >= scheme.least * max(len(a), len(b)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[n] = both >= scheme.least * (len(a) + len(b) - both) - 1e-9
    return out


def _verified(batches: Iterator[pa.RecordBatch], scheme: Similar) -> Iterator[pa.RecordBatch]:
    """Links between the rows of a bucket that are similar by their sets, enough to join what all of them join."""
    tables = scheme.tables()
    for table, left, right in tiles(batches, 1 << 12):
        fp, node = _words(table), table.column("node").to_numpy()
        label = table.column("label").to_numpy()
        column = table.column("grams").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        grams = [flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
        number = int(table.column("key")[0].as_py()) >> 48
        root = np.unique(label, return_index=True, return_inverse=True)
        root = root[1][root[2]].astype(np.int64)
        start = root.copy()
        for at in left.tolist():
            rest = right[right > at] if left is right else right
            rest = rest[root[rest] != root[at]]
            rest = rest[np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1) <= scheme.distance]
            rest = rest[_first_met(fp, np.full(len(rest), at), rest, tables[:number])]
            got = rest[_similar(grams, at, rest, scheme)]
            hook(root, np.full(len(got), at), got)
        own = np.flatnonzero(root != start)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])


def similar_labels(fps: DataFrame, scheme: Similar = SIMILAR, tile: int = 4000, small: int = 32) -> DataFrame:
    """fp, label for each distinct fingerprint of fps (key, fp, grams): a number of what links of similar sets connect.

    Equal fingerprints are one class, whose set is that of its least key. A bucket of over `tile` classes is dealt to pairs of
    tiles. Sets are fetched for classes alone that a bucket brings near one which certain links don't join them with.
    """
    reps = fps.groupBy("fp").agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id())
    reps = materialize(reps, "classes")
    byte = lambda b: f"(shiftrightunsigned(fp[{b // 8}], {8 * (b % 8)}) & 255L)"
    keys = [F.expr(f"{t}L * {1 << 48}L + {byte(a)} * 256L + {byte(b)}") for t, (a, b) in enumerate(scheme.tables())]
    spread = reps.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    met = tiled(spread, tile).mapInArrow(lambda b: _candidates(b, scheme, small), "key long, lo int, hi int, own int, node long, at long")
    met = materialize(met, "met", few_files=True)
    certain = met.where("at is not null").select(F.col("node").alias("a"), F.col("at").alias("b")).distinct()
    labels = materialize(component_ids(reps.select("node", F.lit(0).alias("real")), certain).select("node", "label"), "labels")
    loose = met.where("at is null").drop("at").join(labels, "node")
    place = ["key", "lo", "hi"]
    mixed_places = loose.groupBy(*place).agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x < _y").select(*place)
    waiting = loose.join(mixed_places, place).join(reps.select("node", "fp", F.col("key").alias("of")), "node")
    sets = fps.select(F.col("key").alias("of"), F.col("fp").alias("_fp"), "grams")
    sets = sets.join(waiting.select("of").distinct(), "of", "left_semi").dropDuplicates(["of"]).select("of", "grams")
    fetched = waiting.join(sets, "of").select(*place, "own", "node", "label", "fp", "grams")
    found = materialize(dealt(fetched).mapInArrow(lambda b: _verified(b, scheme), "a long, b long"), "similar", few_files=True)
    out = materialize(component_ids(reps.select("node", F.lit(0).alias("real")), certain.union(found)).select("node", "label"), "groups")
    discard(labels)
    discard(found)
    discard(met)
    return reps.join(out, "node").select("fp", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Similar = SIMILAR) -> DataFrame:
    """docs' rows, all columns whatever their names: of each group that links between similar texts (sets of five-word shingles
    with a Jaccard similarity of 0.8 or more) connect, the document of smallest id (null ids last, then by a hash of the text)
    stays. Rows equal in id and text are one document, of which any row stays. Blank and null texts are one group. Texts move
    once, to meet the keys that stay. An empty table gives an empty one."""
    key = [F.xxhash64(F.lit(n), F.col(id_col).isNull(), id_col, text_col).alias(x) for n, x in ((1, "a"), (2, "b"))]
    number = F.col(id_col).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.struct(number.isNull().alias("none"), number.alias("id"), *key).alias("key"))
    fps = materialize(_sets(rows.select("key", F.col(f"doc.`{text_col}`").alias("text")), scheme), "fingerprints")
    best = fps.select("key", "fp").join(similar_labels(fps, scheme), "fp").groupBy("label").agg(F.min("key").alias("m"))
    # All that is needed further on is two numbers a document; sets are about as large as the texts.
    stay = materialize(best.select(F.col("m.a").alias("_a"), F.col("m.b").alias("_b")), "stay")
    discard(best)
    out = rows.withColumn("_a", F.col("key.a")).withColumn("_b", F.col("key.b")).join(stay, ["_a", "_b"]).dropDuplicates(["_a", "_b"])
    return out.select("doc.*")
