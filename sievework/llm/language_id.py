"""Language identification: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pieces


@dataclass
class Network:
    """Two minimal gated units (one gate each), one reading forwards and one backwards, and a softmax over their joint state.

    Weights have the direction first. x: a row for each byte and one for padding, gate columns then candidate columns.
    """

    langs: list[str]
    x: np.ndarray  # 2, 257, 2h
    u: np.ndarray  # 2, 2, h, h: gate, candidate
    out: np.ndarray  # 2h + 1, classes; the last row is the bias

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out]


def new_network(langs: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(langs, draw(2, 257, 2 * hidden, scale=0.3), draw(2, 2, hidden, hidden, scale=hidden**-0.5), draw(2 * hidden + 1, len(langs), scale=0.2))


def _direction(net: Network, d: int, seq: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each step of seq (steps, rows), and what the backward pass needs."""
    h = net.u.shape[-1]
    state = np.zeros((seq.shape[1], h), np.float32)
    states, tape = np.empty((len(seq), seq.shape[1], h), np.float32), []
    for t in range(len(seq)):
        fed = net.x[d][seq[t]]
        gate = 0.5 + 0.5 * np.tanh(0.5 * (fed[:, :h] + state @ net.u[d, 0]))
        held = gate * state
        cand = np.tanh(fed[:, h:] + held @ net.u[d, 1])
        tape.append((state, gate, held, cand))
        state = state + gate * (cand - state)
        states[t] = state
    return states, tape


def _gradients(net: Network, seq: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions that aren't padding, and its gradients by backpropagation through time."""
    h, (steps, rows) = net.u.shape[-1], seq.shape
    fwd, tape_f = _direction(net, 0, seq)
    bwd, tape_b = _direction(net, 1, seq[::-1])
    joint = np.concatenate((fwd, bwd[::-1]), axis=2)
    logits = joint @ net.out[:-1] + net.out[-1]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    real = (seq != 256).astype(np.float32)[..., None]
    loss = float(-(np.log(p[:, np.arange(rows), target] + 1e-9) * real[..., 0]).sum() / real.sum())
    d_logits = p.copy()
    d_logits[:, np.arange(rows), target] -= 1
    d_logits *= real / real.sum()
    flat = d_logits.reshape(-1, d_logits.shape[2])
    g_out = np.vstack((joint.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)))
    d_joint = d_logits @ net.out[:-1].T
    g_x, g_u = np.zeros_like(net.x), np.zeros_like(net.u)
    for d, tape, fed, d_states in ((0, tape_f, seq, d_joint[..., :h]), (1, tape_b, seq[::-1], d_joint[::-1, :, h:])):
        back = np.zeros((rows, h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, gate, held, cand = tape[t]
            back = back + d_states[t]
            d_cand = back * gate * (1 - cand * cand)
            d_held = d_cand @ net.u[d, 1].T
            d_gate = (back * (cand - state) + d_held * state) * gate * (1 - gate)
            g_u[d, 0] += state.T @ d_gate
            g_u[d, 1] += held.T @ d_cand
            np.add.at(g_x[d], fed[t], np.concatenate((d_gate, d_cand), axis=1))
            back = back * (1 - gate) + d_held * gate + d_gate @ net.u[d, 0].T
    return loss, [g_x, g_u, g_out.astype(np.float32)]


def train(samples: list[tuple[str, bytes]], hidden: int = 8, steps: int = 240, rows: int = 128, width: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over random windows of the samples, each language as often as any other."""
    langs = sorted({lang for lang, _ in samples})
    net, rng = new_network(langs, hidden, seed), np.random.default_rng(seed)
    own = [[np.frombuffer(t, np.uint8).astype(np.int64) for lang, t in samples if lang == name and t] for name in langs]
    m = [np.zeros_like(w) for w in net.parts]
    v = [np.zeros_like(w) for w in net.parts]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(langs), rows)
        seq = np.full((width, rows), 256, np.int64)
        for i, lang in enumerate(target):
            text = own[lang][rng.integers(0, len(own[lang]))]
            at = rng.integers(0, max(1, len(text) - width + 1))
            cut = text[at : at + width]
            seq[: len(cut), i] = cut
        _, grads = _gradients(net, seq, target)
        lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, a, b in zip(net.parts, grads, m, v, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def position_probabilities(net: Network, seq: np.ndarray) -> np.ndarray:
    """(steps, rows, classes): the probabilities of each language at each position of seq (steps, rows)."""
    h, (steps, rows) = net.u.shape[-1], seq.shape
    half = np.concatenate((np.full(h, 0.5, np.float32), np.ones(h, np.float32)))
    tables, gates = net.x * half, net.u[:, 0] * np.float32(0.5)  # the sigmoid as a tanh of half its argument
    joint = np.empty((steps, rows, 2 * h), np.float32)
    for d in (0, 1):
        state, span = np.zeros((rows, h), np.float32), slice(d * h, d * h + h)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            fed = tables[d].take(seq[t], axis=0)
            gate = state @ gates[d]
            gate += fed[:, :h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            cand = (gate * state) @ net.u[d, 1]
            cand += fed[:, h:]
            np.tanh(cand, out=cand)
            cand -= state
            cand *= gate
            state += cand
            joint[t, :, span] = state
    logits = joint.reshape(-1, 2 * h) @ net.out[:-1]
    logits += net.out[-1]
    np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(steps, rows, -1)


def document_probabilities(net: Network, texts: list[bytes], width: int = 256) -> np.ndarray:
    """(texts, classes): the mean over all positions of each whole text, read in windows of width bytes."""
    counts = np.array([-(-len(t) // width) for t in texts])
    total = int(counts.sum())
    sums = np.zeros((len(texts), len(net.langs)))
    if not total:
        return sums
    block = np.full((total, width), 256, np.int16)
    doc = np.repeat(np.arange(len(texts)), counts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        block[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += n
    for lo in range(0, total, 2048):
        seq = np.ascontiguousarray(block[lo : lo + 2048].T)
        p = position_probabilities(net, seq)
        pooled = (p * (seq != 256)[..., None]).sum(axis=0, dtype=np.float64)
        np.add.at(sums, doc[lo : lo + 2048], pooled)
    return sums / np.maximum(1, [[len(t)] for t in texts])


def windows_of(text: bytes, n: int, width: int, seed: int) -> list[bytes]:
    """n windows of width bytes, one from each n-th of the whole text at a place that the seed picks; a shorter text itself."""
    if len(text) <= width:
        return [text]
    room = len(text) - width + 1
    places = np.random.default_rng(seed).random(min(n, room))
    return [text[at : at + width] for at in ((np.arange(len(places)) + places) * room / len(places)).astype(np.int64).tolist()]


def learn(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 160, windows: int = 24, width: int = 128, **options) -> Network | None:
    """Train on per_lang rows for each language, those of least hash among the ones allowed, the labelled rows' number being all
    that is bounded: each gives `windows` windows of width bytes, drawn over its whole text where it lies, so no more than these
    come to the driver. Of rows equal in id and text one is learned from. None if no row is labelled."""
    keys = [F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.xxhash64(F.lit(1), id_col, text_col).alias("_t")]
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("_lang"), *keys, F.col(text_col).alias("_text"))
    first = rows.select("_lang", "_h", "_t").withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_t"))).where(F.col("_n") <= per_lang)
    picked = docs.sparkSession.createDataFrame(first.select("_lang", "_h", "_t").distinct().collect(), "_lang string, _h long, _t long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows_of(t.encode(), windows, width, h & 0xFFFFFFFF) for t, h in zip(batch.column("_text").to_pylist(), batch.column("_t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_t"), pa.array(found, pa.list_(pa.binary()))], ["_lang", "_t", "cuts"])

    # The rows picked are few (a row limit for each language), so they are broadcast and texts don't move.
    cuts = rows.join(F.broadcast(picked), ["_lang", "_h", "_t"]).select("_lang", "_t", "_text").mapInArrow(cut, "_lang string, _t long, cuts array<binary>")
    got = cuts.dropDuplicates(["_lang", "_t"]).orderBy("_lang", "_t").collect()
    samples = [(r["_lang"], bytes(c)) for r in got for c in r["cuts"]]
    return train(samples, **options) if any(t for _, t in samples) else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every row, repeated rows alike: `und` and 0.0 where the text is null or has no letter, or
    nothing was learned. Whole texts, however long, are read in windows; of other columns none is read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            texts = pc.fill_null(batch.column("_text"), "").cast(pa.binary()).to_pylist()
            lettered = batch.column("_letters").to_numpy(zero_copy_only=False)
            texts = [t if ok else b"" for t, ok in zip(texts, lettered, strict=True)]
            if net is None:
                best, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                p = document_probabilities(net, texts)
                best = [net.langs[i] if t else "und" for i, t in zip(p.argmax(axis=1), texts, strict=True)]
                score = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(best, pa.string()), pa.array(score)], ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return rows.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score. Learns from the labelled rows that aren't held out; crc32 of the id, mod 4, is 2 for
    those that are. Null ids count as not held out; nulls, blanks and an empty table are covered by predict()."""
    out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    net = learn(docs, ~out(id_col), id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col).select(id_col, out(id_col).alias("held_out"), "lang_pred", "score")
