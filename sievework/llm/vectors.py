"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, and cosines of the original vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import buckets, component_ids, dealt, discard, grouped, hook, materialize, tiled, tiles

#: Coordinates that a sketch keeps, in steps of 1 / _STEPS.
_KEPT, _STEPS = 8, 63
#: Vectors compared with others at once.
_BLOCK = 1024


@dataclass
class Quantiser:
    """64-bit codes, the signs of (unit vector - mean) @ turn for each of the turns, and a sketch: the first principal
    coordinates as bytes, whose distance is at most that of the vectors but for rounding."""

    mean: np.ndarray
    axes: np.ndarray
    turns: list[np.ndarray]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        out = []
        for turn in self.turns:
            bits = ((unit - self.mean) @ turn > 0).astype(np.uint8)
            out.append(np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8")[:, 0])
        return np.column_stack(out)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        parts = np.zeros((len(unit), _KEPT), np.int8)
        own = (unit - self.mean) @ self.axes[:, :_KEPT]
        parts[:, : own.shape[1]] = np.clip(np.rint(own * _STEPS), -127, 127)
        return parts.view("<i8")[:, 0]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def learn(sample: np.ndarray, rotations: int, rounds: int = 30, seed: int = 3) -> Quantiser:
    """Rotate the principal axes so that signs lose least (alternating signs and an orthogonal Procrustes step). With fewer
    than 64 axes, several rotations' bits make up a code."""
    mean = sample.mean(axis=0)
    x, rng = sample - mean, np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :64]
    turns = []
    for _ in range(rotations):
        parts = []
        while sum(p.shape[1] for p in parts) < 64:
            v = x @ axes
            r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            parts.append(axes @ r)
        turns.append(np.hstack(parts)[:, :64])
    return Quantiser(mean, axes, turns)


def _made_pairs(units: np.ndarray, least: float, most: int = 1000, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of the sample and made ones whose cosine with them is `least`: moved at random, along differences of the sample's
    vectors, and along both such that they are as far from its mean as before, which is where fewest bits agree."""
    rng = np.random.default_rng(seed)
    u = units[rng.permutation(len(units))[:most]]
    mean, s = units.mean(axis=0), (1 - least**2) ** 0.5
    out = []
    for move in (rng.normal(size=u.shape), units[rng.integers(len(units), size=len(u))] - units[rng.integers(len(units), size=len(u))]):
        for stay in (False, True):
            d = move - (move * u).sum(axis=1, keepdims=True) * u
            fine = np.ones(len(u), bool)
            if stay:
                m = mean - (u @ mean)[:, None] * u
                length = np.linalg.norm(m, axis=1)
                share = (u @ mean) * (1 - least) / np.maximum(s * length, 1e-300)
                fine = (np.abs(share) < 1) & (length > 1e-9)
                m = m / np.maximum(length, 1e-300)[:, None]
                d = d - (d * m).sum(axis=1, keepdims=True) * m
            size = np.linalg.norm(d, axis=1)
            fine &= size > 1e-9
            d = d / np.maximum(size, 1e-300)[:, None]
            if stay:
                d = np.clip(share, -1, 1)[:, None] * m + np.sqrt(np.maximum(0, 1 - share**2))[:, None] * d
            if fine.any():
                out.append((u[fine], least * u[fine] + s * d[fine]))
    return out


def _fields(codes: np.ndarray, bits: int) -> np.ndarray:
    """The keys of each code's tables."""
    codes = np.ascontiguousarray(codes)
    return codes.view(np.uint16 if bits == 16 else np.uint8).reshape(len(codes), -1)


def fitted(units: np.ndarray, least: float, rotations: int, reach: float) -> tuple[Quantiser, int]:
    """A quantiser and the bits of its tables' keys: the first of `rotations`, twice and four times as many with keys of 16 bits,
    and `rotations` with keys of 8, at which at least `reach` of each kind of made pairs at the threshold meet. 0 bits if none
    does: then one table holds all, and whatever is near is found."""
    pairs = _made_pairs(units, least)
    for turns, bits in ((rotations, 16), (2 * rotations, 16), (4 * rotations, 16), (rotations, 8)):
        quantiser = learn(units, turns)
        met = [(_fields(quantiser.codes(a), bits) == _fields(quantiser.codes(b), bits)).any(axis=1).mean() for a, b in pairs]
        if min(met, default=1.0) >= reach:
            return quantiser, bits
    return learn(units, 1, rounds=0), 0


def _valid(v: Column) -> Column:
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _near_sketch(batches: Iterator[pa.RecordBatch], most: float, small: int = 32) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket whose sketch is within `most` of another's: all rows that have a near vector there, and a few more."""
    names, limit = ["key", "lo", "hi", "own", "node"], (most * _STEPS) ** 2
    for table in grouped(batches, "key"):
        s = np.ascontiguousarray(table.column("sketch").to_numpy()).view(np.int8).reshape(-1, _KEPT).astype(np.float32)
        first, size, sides = buckets(table)
        some = (size <= small) & np.array([left is right for left, right in sides], bool)
        member, bucket = np.repeat(some, size), np.repeat(np.arange(len(size)), size)
        near = np.zeros(len(s), bool)
        # Small buckets all at once: each row against the one o rows on.
        for o in range(1, int(size[some].max(initial=1))):
            i = np.flatnonzero(member[:-o] & (bucket[o:] == bucket[:-o]))
            i = i[((s[i] - s[i + o]) ** 2).sum(axis=1) <= limit]
            near[i] = near[i + o] = True
        length = (s * s).sum(axis=1)
        for b in np.flatnonzero(~some):
            left, right = (first[b] + side for side in sides[b])
            for at in range(0, len(left), _BLOCK):
                i = left[at : at + _BLOCK]
                close = length[i, None] + length[right] - 2 * (s[i] @ s[right].T) <= limit
                close &= i[:, None] != right
                near[i] |= close.any(axis=1)
                near[right] |= close.any(axis=0)
        if near.any():
            yield from table.select(names).filter(pa.array(near)).combine_chunks().to_batches()


def _near(batches: Iterator[pa.RecordBatch], least: float, bits: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """node, links, root of each vector that a bucket links: how many vectors it finds there that no earlier table's bucket holds
    too, and one that it is connected with."""
    for table, left, right in tiles(batches, 1 << 13):
        v, codes = unit(_matrix(table.column("_v"))), _matrix(table.column("codes"))
        keys = _fields(codes, bits[v.shape[1]])
        node, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        earlier = (int(table.column("key")[0].as_py()) >> 32) & 0xFFFF
        links, root = np.zeros(len(v), np.int64), np.arange(len(v))
        for at in range(0, len(left), _BLOCK):
            i = left[at : at + _BLOCK]
            a, b = np.nonzero(v[i] @ v[right].T >= least)
            a, b = i[a], right[b]
            if left is right:
                a, b = a[a < b], b[a < b]
            for lo in range(0, len(a), 1 << 17):
                x, y = a[lo : lo + (1 << 17)], b[lo : lo + (1 << 17)]
                new = ~(keys[x, :earlier] == keys[y, :earlier]).any(axis=1)
                x, y = x[new], y[new]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                hook(root, x, y)
        got = np.flatnonzero(links)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got]), pa.array(node[root[got]])], ["node", "links", "root"])


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, rotations: int = 6, reach: float = 0.95, tile: int = 20_000, sample: int = 4096, most_lengths: int = 64) -> DataFrame:
    """id_col (long), n_links, component_id, kept for every row.

    Rows whose vector is null, zero, or has null or non-finite components link with nothing; vectors of different lengths don't
    link. Equal vectors are one class, with its number of copies. Rows of null or repeated ids are vectors like others; a
    component's id is its smallest id, null if it has none. kept: the id is the component's, and where it has none, all rows.
    An empty table gives an empty result; further columns are not read.

    For each length, codes are fitted on about `sample` vectors of least hash, and every vector is indexed: two meet if 16 bits
    that stand together in a code are equal, in 4 tables for each rotation. Where vectors are in a narrow cone, pairs at the
    threshold differ in many bits: then there are more rotations, or keys of 8 bits in 8 tables for each, as many as `reach` of
    pairs made at the threshold meet in; and if none of that reaches it, all vectors are compared, tile by tile. Tables are shuffled without vectors, with a sketch
    of 8 bytes, whose distance is a bound of the true one, so that what it leaves out is never a link. Only vectors with a
    near sketch in a bucket are fetched there, and their cosines taken in double precision. A bucket returns a row for each
    linked vector (how many it found first, and one that it is connected with), not the pairs; one of over `tile` vectors is
    dealt to pairs of tiles. More than most_lengths lengths are an error.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(_valid(v), v).alias("_v"))
    rows = rows.withColumn("_a", F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(1), "_v"))).withColumn("_b", F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(2), "_v")))
    good = rows.where(F.col("_v").isNotNull())
    lengths = {r["n"]: r["m"] for r in good.groupBy(F.size("_v").alias("n")).agg(F.count(F.lit(1)).alias("m")).limit(most_lengths + 1).collect()}
    if len(lengths) > most_lengths:
        raise ValueError(f"vectors of over {most_lengths} lengths")
    if not lengths:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    # Of each length, so many by hash that about 4 x sample are left to be ranked.
    share = F.lit(0)
    for n, m in lengths.items():
        share = F.when(F.size("_v") == n, min(1 << 20, 4 * sample * (1 << 20) // m + 1)).otherwise(share)
    some = good.withColumn("_h", F.xxhash64("_a", "_id")).where(F.pmod("_h", F.lit(1 << 20)) < share)
    drawn = some.withColumn("_r", F.row_number().over(Window.partitionBy(F.size("_v")).orderBy("_h", "_a"))).where(F.col("_r") <= sample).select("_v").toArrow()["_v"].to_pylist()
    fits = {n: fitted(unit(np.array([x for x in drawn if len(x) == n])), least, rotations, reach) for n in lengths}
    quantisers, bits = {n: q for n, (q, _) in fits.items()}, {n: b for n, (_, b) in fits.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.diff(batch.column("_v").offsets.to_numpy())
            for n in np.unique(own):
                part = batch.filter(pa.array(own == n))
                u = unit(_matrix(part.column("_v")))
                codes = pa.array(list(quantisers[int(n)].codes(u)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, codes, pa.array(quantisers[int(n)].sketch(u))], [*part.schema.names, "codes", "sketch"])

    merged = good.groupBy("_a", "_b").agg(F.min("_id").alias("real"), F.count(F.lit(1)).alias("copies"), F.first("_v").alias("_v")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(merged.mapInArrow(encode, f"_a long, _b long, real long, copies long, _v array<{kind}>, node long, codes array<long>, sketch long"), "vectors")
    length, keys = F.size("_v").cast("long") * F.lit(1 << 48), F.array(F.lit(0).cast("long"))
    for width, turns in {(b, len(q.turns)) for q, b in fits.values() if b}:
        per = 64 // width
        own = [F.expr(f"{t}L * {1 << 32}L + (shiftrightunsigned(codes[{t // per}], {width * (t % per)}) & {(1 << width) - 1}L)") for t in range(per * turns)]
        keys = F.when(F.size("_v").isin([n for n, (q, b) in fits.items() if (b, len(q.turns)) == (width, turns)]), F.array(*own)).otherwise(keys)
    spread = classes.select("node", "sketch", length.alias("_l"), F.explode(keys).alias("key")).select("node", "sketch", (F.col("key") + F.col("_l")).alias("key"))
    # The rounding of two sketches adds at most sqrt(8) steps.
    bound = (2 - 2 * least) ** 0.5 + _KEPT**0.5 / _STEPS + 1e-9
    flagged = tiled(spread, tile).mapInArrow(lambda b: _near_sketch(b, bound), "key long, lo int, hi int, own int, node long")
    flagged = materialize(flagged, "flagged", few_files=True)
    fetched = flagged.join(classes.select("node", "copies", "codes", "_v"), "node").select("key", "lo", "hi", "own", "node", "copies", "codes", "_v")
    found = materialize(dealt(fetched).mapInArrow(lambda b: _near(b, least, bits), "node long, links long, root long"), "links", few_files=True)
    discard(flagged)
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_ids(classes, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("_a", "_b", "node", "copies").join(totals, "node", "left").join(labels, "node")
    known = known.select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.lit(True).alias("_known"), "component_id")
    out = rows.drop("_v").join(known, (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d")), "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("_id"))
    kept = F.coalesce(component == F.col("_id"), component.isNull())
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
