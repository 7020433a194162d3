"""Quality rules: counts of each document, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, mixed, pieces, rows_of, word_arrays, word_hashes

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def normal_line(line: bytes) -> bytes:
    """A line's words, A-Z lower-cased, ends of sentences and digits levelled: what counts as the same line across documents."""
    return b" ".join(line.lower().translate(_LEVEL).split())


_LEVEL = bytes.maketrans(b"0123456789", b"0000000000")


def line_hash(host: str, line: bytes) -> int:
    """What stands for a normal line of a host."""
    return xxhash.xxh64_intdigest(host.encode() + b"\n" + normal_line(line)) - (1 << 63)


def _repeats(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row, how many of its words are in a 3-word window that it has twice or more."""
    n, rows = len(hashes), rows_of(starts)
    covered = np.zeros(n, bool)
    if n >= 3:
        inside = np.flatnonzero(rows[2:] == rows[:-2])
        a, b, c = hashes[:-2][inside], hashes[1:-1][inside], hashes[2:][inside]
        tri = mixed(mixed(mixed(a) * np.uint64(3) + b) * np.uint64(5) + c + mixed(rows[inside].astype(np.uint64)))
        order = np.argsort(tri, kind="stable")
        ranked = tri[order]
        same = np.zeros(len(tri), bool)
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        at = inside[order[same]]
        for o in range(3):
            covered[at + o] = True
    return np.bincount(rows[covered], minlength=len(starts) - 1)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and lines: the document's distinct normal
    lines, each a hash of host and line with the words it has in the document; _host too. A null text counts 0 throughout."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            text = pc.fill_null(batch.column("_text"), "")
            starts, codes, words = word_arrays(text)
            lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            chars = np.concatenate(([0], np.cumsum(lengths[codes], dtype=np.int64)))
            hosts = pc.fill_null(batch.column("_host"), "\0").to_pylist()
            out: dict[str, list] = {"n_symbols": [], "n_dup_lines": [], "hashes": [], "sizes": []}
            for t, h in zip(text.to_pylist(), hosts, strict=True):
                out["n_symbols"].append(len(t) - len(t.translate(_SYMBOLS)))
                seen, sizes, dup = set(), {}, 0
                for line in t.encode().split(b"\n"):
                    n = len(line.split())
                    if n:
                        dup += line in seen
                        seen.add(line)
                        same = line_hash(h, line)
                        sizes[same] = sizes.get(same, 0) + n
                out["n_dup_lines"].append(dup)
                out["hashes"].append(list(sizes))
                out["sizes"].append(list(sizes.values()))
            counts = [np.diff(starts), np.diff(chars[starts]), np.array(out["n_symbols"]), np.array(out["n_dup_lines"]), _repeats(starts, word_hashes(words, 1)[codes])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(out["hashes"], pa.list_(pa.int64())), pa.array(out["sizes"], pa.list_(pa.int64())), pa.array(hosts, pa.string())],
                ["_id", *names, "hashes", "sizes", "_host"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.lit("") if host is None else host).cast("string").alias("_host"))
    return rows.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", hashes array<long>, sizes array<long>, _host string").withColumnRenamed("_id", id_col)


def base_failed(least_words: int = 50, most_repeat: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))


def cut(rows: DataFrame) -> DataFrame:
    """rows with _text rewritten without the lines whose hashes are in _cut, and n_removed, the words in them. Other lines, blank
    ones too, stay as they are; _cut goes."""
    kept = [f for f in rows.schema.fields if f.name != "_cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            columns = {f.name: batch.column(f.name) for f in kept}
            removed = np.zeros(batch.num_rows, np.int64)
            todo = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(batch.column("_cut")), 0), False).to_numpy(zero_copy_only=False))
            if len(todo):
                texts, some = batch.column("_text").to_pylist(), pa.array(todo)
                hosts, cuts = (batch.column(c).take(some).to_pylist() for c in ("_host", "_cut"))
                for i, host, above in zip(todo.tolist(), hosts, map(set, cuts), strict=True):
                    lines = []
                    for line in texts[i].encode().split(b"\n"):
                        n = len(line.split())
                        if n and line_hash(host, line) in above:
                            removed[i] += n
                        else:
                            lines.append(line)
                    texts[i] = b"\n".join(lines).decode()
                columns["_text"] = pa.array(texts, columns["_text"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(removed)], [*columns, "n_removed"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_removed long")


def cleaned(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 20, share: float = 0.002, most_removed: float = 0.5) -> DataFrame:
    """id_col, text_col without the lines above the limit, the counts of measures() (of the whole text), base_failed, n_removed
    (words in the lines cut out) and kept; a row for each of docs.

    A normal line is above the limit if more than least_docs documents of a host hold it and more than `share` of the host's.
    A document is rejected if it fails the base rules or if lines above the limit hold more than most_removed of its words.
    Rows that repeat an id count each as a document; null hosts are one host. Lines of all documents are counted: partial sums
    before the shuffle make a line that a third of all documents hold one row from each task. Texts move once, to meet the
    hashes of their own lines above the limit by a key of id, host and text.
    """
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(host_col).isNull(), F.col(host_col), F.col(text_col)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).cast("string").alias("_host"), F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")).alias("_key"))
    found = measures(rows, "_key", "_text", F.col("_host")).withColumn("_row", F.monotonically_increasing_id())
    found = materialize(found.select(F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"), *(c for c in found.columns if c != "_key")), "measures")
    lines = found.select("_row", "_host", F.explode("hashes").alias("line"))
    hosts = found.groupBy("_host").agg(F.count(F.lit(1)).alias("docs"))
    counted = lines.groupBy("line", "_host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    above = counted.join(hosts, "_host").where(F.col("n") > share * F.col("docs")).select("line")
    cuts = lines.join(above, "line").groupBy("_row").agg(F.collect_list("line").alias("_cut"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # Equal keys are equal rows, so any of them serves.
    known = found.select("_row", "_a", "_b", *names).join(cuts, "_row", "left").drop("_row").dropDuplicates(["_a", "_b"])
    texts = rows.select("_id", "_text", F.coalesce("_host", F.lit("\0")).alias("_host"), F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"))
    out = cut(texts.join(known, ["_a", "_b"], "left")).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("n_removed") <= most_removed * F.col("n_words"))
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), *names, "base_failed", kept.alias("kept"), "n_removed")


def judged(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 20, share: float = 0.002, most_removed: float = 0.5) -> DataFrame:
    """cleaned() without the texts."""
    return cleaned(docs, host_col, id_col, text_col, least_docs, share, most_removed).drop(text_col)
