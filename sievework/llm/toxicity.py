"""Toxicity: cumulative-link ordinal regression over words, trained here on labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, pieces

_TOKEN = re.compile(r"[^\W_]+")
#: Letters of beginnings.
_STEMS = (4, 5)


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(weights of the text's words - thresholds[k]): the same weights at each threshold."""

    weights: dict[str, float]
    thresholds: list[float]


def tokens(text: str) -> set[str]:
    """A text's distinct words, and the beginnings that longer ones share with their other forms."""
    words = set(_TOKEN.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in _STEMS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l2: float = 5e-5, steps: int = 400, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rising thresholds) of least mean negative log-likelihood plus l2 |w|^2, by Adam. x: rows by features, 0 or 1."""
    w = np.zeros(x.shape[1])
    # theta: the first threshold, then logs of the steps to the next ones, so that they stay in order.
    theta = np.concatenate(([1.0], np.zeros(grades - 2)))
    n = np.arange(len(grade))
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for step in range(1, steps + 1):
        cut = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        above = np.column_stack((np.ones(len(grade)), _sigmoid((x @ w.astype(np.float32)).astype(float)[:, None] - cut), np.zeros(len(grade))))
        p = np.maximum(above[n, grade] - above[n, grade + 1], 1e-9)
        slope = above * (1 - above)
        d_lower, d_upper = slope[n, grade] / p, slope[n, grade + 1] / p
        g_score = -(d_lower - d_upper) / len(grade)
        g_cut = np.array([(d_lower[grade == k + 1].sum() - d_upper[grade == k].sum()) / len(grade) for k in range(grades - 1)])
        g_theta = np.concatenate(([g_cut.sum()], [g_cut[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1)]))
        g = np.concatenate((x.T @ g_score.astype(np.float32) + 2 * l2 * w, g_theta))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return w, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))


#: Deviations by which a word's log-odds must differ from none: what most words of no meaning here stay under.
_STANDS_OUT = 2.0


def _marks(code: np.ndarray, row: np.ndarray, toxic: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """(z, rows) of each word: how far its log-odds between toxic and clean rows stand out, and in how many rows it is."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    a = np.bincount(code[toxic[row]], minlength=names)
    c = np.bincount(code[~toxic[row]], minlength=names)
    odds = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((c + 0.5) / (n_clean - c + 0.5))
    return odds / np.sqrt(1 / (a + 0.5) + 1 / (n_toxic - a + 0.5) + 1 / (c + 0.5) + 1 / (n_clean - c + 0.5)), a + c


def severities(code: np.ndarray, row: np.ndarray, toxic: np.ndarray, fold: np.ndarray, names: int) -> np.ndarray:
    """Grades for rows that are only labelled toxic or not: 0 for clean ones; for toxic ones 2 if they hold more marking words than
    the median toxic row, else 1. Which words mark a row is learned from the rows of the other fold."""
    found = np.zeros(len(toxic), np.int64)
    for f in (0, 1):
        other = fold != f
        own = ~other[row]
        if toxic[other].any() and not toxic[other].all():
            kept = np.flatnonzero(other)
            place = np.full(len(toxic), -1, np.int32)
            place[kept] = np.arange(len(kept))
            z, _ = _marks(code[~own], place[row[~own]], toxic[kept], names)
            own &= (z > _STANDS_OUT + 0.5)[code]
            found += np.bincount(row[own], minlength=len(toxic))
    return np.where(toxic, 1 + (found > np.median(found[toxic])), 0)


def train(words: pa.ListArray, labels: np.ndarray, features: int = 2000, least: int = 3) -> Ordinal | None:
    """From each row's distinct words and its label. Labels over 1 are grades as they stand; labels of 0 and 1 only are graded by
    severities(). Features: of the words in `least` rows or more whose log-odds between toxic and clean stand out by _STANDS_OUT
    deviations, the `features` ones that do so most; a bound of the model's size, as the sample's is."""
    toxic = labels > 0
    if toxic.all() or not toxic.any():
        return None
    coded = pc.dictionary_encode(words.flatten())
    code, names = coded.indices.to_numpy(), coded.dictionary
    row = np.repeat(np.arange(len(words), dtype=np.int32), pc.list_value_length(words).to_numpy())
    grade = severities(code, row, toxic, np.arange(len(words)) % 2, len(names)) if labels.max() == 1 else labels
    z, rows = _marks(code, row, toxic, len(names))
    often = np.flatnonzero((rows >= least) & (np.abs(z) >= _STANDS_OUT))
    most = np.sort(np.abs(z[often]))[-features:][:1]
    chosen = sorted((-abs(float(z[i])), names[int(i)].as_py(), int(i)) for i in often[np.abs(z[often]) >= most])[:features]
    place = np.full(len(names), -1, np.int32)
    place[[i for _, _, i in chosen]] = np.arange(len(chosen))
    known = np.flatnonzero(place[code] >= 0)
    at = row[known], place[code[known]]
    del row, known
    x = np.zeros((len(words), len(chosen)), np.float32)
    x[at] = 1
    # Grades that no row has don't get a threshold.
    grade = np.unique(grade, return_inverse=True)[1]
    w, cut = fit_ordinal(x, grade, int(grade.max()) + 1)
    return Ordinal({word: float(w[k]) for k, (_, word, _) in enumerate(chosen)}, cut.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 2500) -> Ordinal | None:
    """Train on at most `most` toxic and twice as many clean labelled rows, those of least id hash; labels are whole numbers of 0
    (clean) or more, null or negative ones are none, and an id labelled twice has its highest. Only chosen ids are broadcast
    (their number is bounded by `most`), only the words of chosen rows come to the driver; of an id that docs repeat, one text."""
    label = F.col(label_col).cast("int")
    own = labels.where((label >= 0) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    own = own.withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    pick = [own.where(which).orderBy("_h", "_id").limit(n) for which, n in (("_y > 0", most), ("_y = 0", 2 * most))]
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(pick[0].union(pick[1])), "_id").where(F.col("_text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            words = [sorted(tokens(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), pa.array(words, pa.list_(pa.string())), batch.column("_y").cast(pa.int32()), batch.column("_t")], ["id", "words", "y", "t"])

    found = chosen.select("_id", "_text", "_y", F.xxhash64("_text").alias("_t")).mapInArrow(run, "id string, words array<string>, y int, t long")
    got = found.groupBy("id", "y").agg(F.min_by("words", "t").alias("words")).toArrow()
    if not got.num_rows:
        return None
    order = pc.sort_indices(got, [("id", "ascending"), ("y", "ascending")])
    y = got["y"].take(order).to_numpy().astype(np.int64)
    # The driver lives on and has little memory: words become numbers before rows are put in order, and what is freed goes back.
    coded = pc.dictionary_encode(pc.list_flatten(got["words"])).unify_dictionaries().combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(got["words"]).to_numpy()))).astype(np.int32)
    del got
    give_back()
    words = pa.ListArray.from_arrays(ends, coded).take(order)
    del coded
    model = train(words, y)
    del words
    give_back()
    return model


def predict(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (the expected grade), p_toxic (of any grade over 0), for every row, of null and repeated ids too. Null and
    blank texts, and all texts where nothing was learned, get 0 for both. Whole texts are read, and no other column."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights if model else {}
        known = weights.keys()
        cut = np.array(model.thresholds if model else [0.0])
        for batch in pieces(batches, "_text"):
            found = [tokens(t) for t in pc.fill_null(batch.column("_text"), "").to_pylist()]
            score = np.array([sum(weights[w] for w in sorted(known & t)) for t in found])
            above = _sigmoid(score[:, None] - cut) * np.array([[bool(t) and model is not None] for t in found])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy())], ["_id", "severity", "p_toxic"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, severity double, p_toxic double").withColumnRenamed("_id", id_col)


def clean_only(docs: DataFrame, model: Ordinal | None, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose p_toxic is at most limit, as predict() has it: a map over the
    rows, no shuffle. Null and blank texts stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            found = [tokens(t) for t in pc.fill_null(batch.column(names.index(text_col)), "").to_pylist()]
            score = np.array([sum(model.weights[w] for w in sorted(model.weights.keys() & t)) for t in found])
            yield batch.filter(pa.array((_sigmoid(score - model.thresholds[0]) <= limit) | np.array([not t for t in found])))

    return docs.mapInArrow(run, docs.schema) if model else docs
