"""Files of many kinds to DataFrames: by Spark's readers, and where these know no format, a task for each file."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate, chain
from pathlib import Path
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import dealt


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, columns: Sequence[str] | None = None, null: str = "", file_column: str | None = None, **options) -> DataFrame:
    """Quoted CSV, plain or gzip, one file or a glob, by a declared schema. Only `null` is null: a literal NA survives. file_column:
    where each row came from. A gzip file is one task's; convert large ones to Parquet once."""
    df = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, nullValue=null, emptyValue="", **options).csv(path)
    if file_column:
        df = df.withColumn(file_column, F.col("_metadata.file_path"))
    return df.select(*columns, *([file_column] if file_column else [])) if columns else df


def without_nulls(df: DataFrame) -> DataFrame:
    """Every null text empty."""
    return df.fillna("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """A row for each element of row_tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType | str, outer: str, inner: str) -> DataFrame:
    """A row for each element of the array `inner` in each of the array `outer`, with the outer element's other fields; fields of
    the inner one have its name before them."""
    o = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(outer).alias("o")).select("o.*")
    i = o.withColumn("_i", F.explode(inner)).drop(inner)
    fields = i.schema["_i"].dataType.names
    return i.select(*(c for c in i.columns if c != "_i"), *(F.col(f"_i.{f}").alias(f"{inner}_{f}") for f in fields))


def read_stanzas(spark: SparkSession, path: str, stanza: str = "[Term]", many: Sequence[str] = ("is_a", "synonym", "xref", "relationship"), single: Sequence[str] = ("id", "name", "def")) -> DataFrame:
    """An OBO-like text: a row for each stanza, single fields as text and repeated ones as arrays; comments after ! go."""
    rows = spark.read.text(path, lineSep=f"\n{stanza}\n").select(F.regexp_replace(F.regexp_extract("value", r"(?s)^(.*?)(?:\n\[[A-Z]|\z)", 1), r"(?m)\s+!.*$", "").alias("v"))
    all_of = lambda k: F.transform(F.regexp_extract_all(F.col("v"), F.lit(rf"(?m)^{k}: (.*)$"), F.lit(1)), lambda x: F.trim(x))
    return rows.select(*(F.get(all_of(k), 0).alias(k) for k in single), *(all_of(k).alias(k) for k in many)).where(F.col(single[0]).isNotNull())


def read_classes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """OWL classes: id, label and the parents whose id has the prefix."""
    schema = "`_rdf:about` string, `rdfs:label` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>"
    df = read_xml(spark, path, "owl:Class", schema)
    parents = F.filter(F.transform("`rdfs:subClassOf`", lambda x: x["_rdf:resource"]), lambda x: x.contains(prefix))
    return df.select(F.col("`_rdf:about`").alias("id"), F.get(F.col("`rdfs:label`"), 0).alias("label"), F.coalesce(parents, F.array().cast("array<string>")).alias("parents"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """tag, description of a Latin-1 list `<TAG> text`; lines without a tag continue the one before, and a tag's first text wins."""
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "ISO-8859-1").alias("v"))
    parts = text.select(F.posexplode(F.regexp_extract_all(F.col("v"), F.lit(r"(?s)<([A-Z0-9_-]+)>(.*?)(?=<[A-Z0-9_-]+>|\z)"), F.lit(0))).alias("i", "p"))
    rows = parts.select("i", F.regexp_extract("p", r"<([A-Z0-9_-]+)>", 1).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace("p", r"^<[^>]*>", ""), r"\s+", " ")).alias("description"))
    return rows.groupBy("tag").agg(F.min_by("description", "i").alias("description"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_CELL, _VALUE, _TEXT = (_SHEET[1:] + x for x in ("c", "v", "t"))
#: Cells that go to Spark at once.
_BATCH = 8192


def _column(letters: str, known: dict[str, int]) -> int:
    """A column's number from 0, of letters A to Z."""
    if letters not in known:
        if not re.fullmatch("[A-Z]+", letters):
            raise ValueError(f"no column of a sheet: {letters!r}")
        known[letters] = reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1
    return known[letters]


class _SheetParser:
    """Rows (row, columns, texts) of a sheet as its XML goes by: of its cells, a row's are held at a time, and no elements."""

    def __init__(self, shared: list[str]) -> None:
        self.shared, self.known, self.rows = shared, {}, []
        self.at, self.columns, self.texts = None, [], []
        self.reference, self.kind, self.parts, self.told = None, None, [], False
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end

    def _start(self, name: str, own: dict[str, str]) -> None:
        if name == _CELL:
            self.reference, self.kind, self.parts, self.told = own["r"], own.get("t"), [], False
        elif name == (_TEXT if self.kind == "inlineStr" else _VALUE) and not self.told:
            self.parser.CharacterDataHandler = self.parts.append

    def _end(self, name: str) -> None:
        if name == _CELL:
            found = "".join(self.parts)
            if found and self.kind == "s":
                found = self.shared[int(found)]
            if found:
                letters = self.reference.rstrip("0123456789")
                row = int(self.reference[len(letters) :]) - 1
                if row != self.at:
                    self._row()
                    self.at = row
                self.columns.append(_column(letters, self.known))
                self.texts.append(found)
        elif name in (_TEXT, _VALUE):
            self.parser.CharacterDataHandler = None
            self.told = self.kind != "inlineStr"

    def _row(self) -> None:
        if self.columns:
            self.rows.append((self.at, self.columns, self.texts))
            self.columns, self.texts = [], []

    def read(self, stream) -> Iterator[tuple[int, list[int], list[str]]]:
        while chunk := stream.read(1 << 16):
            self.parser.Parse(chunk)
            yield from self.rows
            self.rows = []
        self.parser.Parse(b"", True)
        self._row()
        yield from self.rows


def _sheet_rows(content: bytes, sheet: str | None) -> Iterator[tuple[str, int, list[int], list[str]]]:
    """(sheet, row, columns, texts) of a workbook's rows whose cells hold something; rows and columns from 0. One sheet, or all."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text(e) for e in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {e.get("Id"): e.get("Target") for e in read("xl/_rels/workbook.xml.rels")}
        for entry in read("xl/workbook.xml").iter(f"{_SHEET}sheet"):
            name = entry.get("name")
            if sheet not in (None, name):
                continue
            target = targets[entry.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                yield from ((name, *row) for row in _SheetParser(shared).read(f))


def _read_books(batches: Iterator[pa.RecordBatch], sheet: str | None) -> Iterator[pa.RecordBatch]:
    """path, sheet, row, cols, texts, some thousand cells at a time, however many a book has."""

    def made(path: str, rows: list[tuple[str, int, list[int], list[str]]]) -> pa.RecordBatch:
        names, at, columns, texts = zip(*rows, strict=True)
        ends = pa.array([0, *accumulate(map(len, columns))], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(x)), t)) for x, t in ((columns, pa.int32()), (texts, pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(at, pa.int32()), *lists], ["path", "sheet", "row", "cols", "texts"])

    for batch in batches:
        for p, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, n = [], 0
            for row in _sheet_rows(content.as_py(), sheet):
                rows.append(row)
                n += len(row[2])
                if n >= _BATCH:
                    yield made(p.as_py(), rows)
                    rows, n = [], 0
            if rows:
                yield made(p.as_py(), rows)


def sheet_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, sheet, row, col, text of the cells of all workbooks at path: a task for each file, none on the driver. What a layout
    means is told from these by joins: see layouts.read(), sheet_rows(), unstacked_headers() and component_names()."""
    return cells_of(spark.read.format("binaryFile").load(path), sheet)


def rows_of(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, sheet, row, cols, texts: the rows of workbooks (path, content) that are in a table already, each with the columns and
    texts of its cells that hold something."""
    return dealt(books.select("path", "content"), "path").mapInArrow(lambda b: _read_books(b, sheet), "path string, sheet string, row int, cols array<int>, texts array<string>")


def cells_of(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """sheet_cells() of workbooks (path, content) that are in a table already."""
    cell = F.explode(F.arrays_zip(F.col("cols").alias("col"), F.col("texts").alias("text")))
    return rows_of(books, sheet).select("path", "sheet", "row", cell.alias("_c")).select("path", "sheet", "row", "_c.col", "_c.text")


def sheet_rows(cells: DataFrame, header: int = 0) -> DataFrame:
    """path, sheet, row and a column for each text of the header row, as text. Names must be the same in all files and once each."""
    names = cells.where(F.col("row") == header).select("col", "text").distinct().orderBy("col").collect()
    if len({r["col"] for r in names}) < len(names) or len({r["text"] for r in names}) < len(names):
        raise ValueError("headers that differ between files, or one that is there twice")
    wide = cells.where(F.col("row") > header).groupBy("path", "sheet", "row").pivot("col", [r["col"] for r in names]).agg(F.first("text"))
    return wide.withColumnsRenamed({str(r["col"]): r["text"] for r in names})


def unstacked_headers(cells: DataFrame, header_rows: int, ids: int) -> DataFrame:
    """path, sheet, row, ids (array), heads (array), text: a wide table whose first header_rows rows are headers, long; blank cells go."""
    place = ["path", "sheet"]
    heads = cells.where((F.col("row") < header_rows) & (F.col("col") >= ids)).groupBy(*place, "col").agg(F.map_from_entries(F.collect_list(F.struct("row", "text"))).alias("_h"))
    names = cells.where((F.col("row") >= header_rows) & (F.col("col") < ids)).groupBy(*place, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_n"))
    values = cells.where((F.col("row") >= header_rows) & (F.col("col") >= ids)).join(heads, [*place, "col"], "left").join(names, [*place, "row"], "left")
    in_turn = lambda m, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col(m), i))
    return values.select(*place, "row", in_turn("_n", ids).alias("ids"), in_turn("_h", header_rows).alias("heads"), "text")


def component_names(cells: DataFrame, marker: str = "Component") -> DataFrame:
    """code, name of a dictionary sheet: its first two columns below the row that begins with the marker. A code of two names is an
    error, and so is a sheet without the marker."""
    place = ["path", "sheet"]
    begin = cells.where((F.col("col") == 0) & (F.trim("text") == marker)).groupBy(*place).agg(F.min("row").alias("_at"))
    rows = cells.where("col < 2").join(begin, place, "left")
    told = F.raise_error(F.concat(F.lit(f"no row begins with {marker}: "), F.col("path"))).cast("boolean")
    below = rows.where(F.when(F.col("_at").isNull(), told).otherwise(F.col("row") > F.col("_at"))).groupBy(*place, "row").pivot("col", [0, 1]).agg(F.first(F.trim("text")))
    named = below.where("`0` IS NOT NULL").groupBy(F.col("0").alias("code")).agg(F.min("1").alias("name"), F.max("1").alias("_last"))
    twice = F.raise_error(F.concat(F.lit("a code of two names: "), F.col("code"))).cast("boolean")
    return named.where(F.when(F.col("name") != F.col("_last"), twice).otherwise(F.lit(True))).drop("_last")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, member, content (text) of the archives' members that match a regular expression: a task for each archive."""

    def open_zip(batches):
        for batch in batches:
            rows = {"path": [], "member": [], "content": []}
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(pattern, name):
                            rows["path"].append(p)
                            rows["member"].append(name)
                            rows["content"].append(z.read(name).decode())
            yield pa.RecordBatch.from_pydict(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(open_zip, "path string, member string, content string")


def cached_json(cache: Path, key: str, fetch: Callable[[], dict] | None = None) -> dict:
    """A response from the cache; else fetched, by the driver alone, and kept. Without fetch (offline) a missing one raises."""
    file = Path(cache) / f"{key}.json"
    if not file.exists():
        if fetch is None:
            raise FileNotFoundError(f"{key} isn't cached, and this is offline")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(fetch(), sort_keys=True))
    return json.loads(file.read_text())


def artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of every file below path."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def array_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, i, j, value of the numbers in saved matrices of that name: missing ones are absent. A task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    a = z[name].astype(float)
                for at in range(0, len(a), 4096):
                    i, j = np.nonzero(~np.isnan(a[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(i)), pa.array(i + at), pa.array(j), pa.array(a[i + at, j])], ["path", "i", "j", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, i long, j long, value double")


def links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """id_col, href, label of each link in a page, in the JVM."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0)))
    rows = pages.select(id_col, found.alias("_a"))
    return rows.select(id_col, F.regexp_extract("_a", r"(?i)href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace("_a", r"(?s)<[^>]*>", "")).alias("label"))
