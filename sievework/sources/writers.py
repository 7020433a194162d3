"""Results out: never over what is there, with counts and hashes beside them."""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import dealt, materialize
from .readers import artifacts


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("errorifexists").csv(path, header=True, compression="gzip" if gzip else "none")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [_plain(v) for v in (sorted(x, key=str) if isinstance(x, set) else x)]
    return x.item() if hasattr(x, "item") else x


def write_manifest(values: dict, path: str) -> None:
    """Counts and hashes as JSON: keys sorted, NaN and infinities null."""
    file = Path(path)
    if file.exists():
        raise FileExistsError(path)
    file.write_text(json.dumps(_plain(values), indent=1, sort_keys=True, allow_nan=False))


def write_sharded(df: DataFrame, path: str, shard: Column, parts: int = 4) -> DataFrame:
    """JSON lines in a folder for each shard; returns the counts by shard. Rows of a shard are dealt together first, so that it is
    a file for each of `parts` tasks, however hot it is."""
    rows = df.withColumn("shard", shard)
    rows.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts))).repartition("shard", "_part").drop("_part").write.mode("errorifexists").partitionBy("shard").json(path, compression="gzip")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def numbered_shards(df: DataFrame, order: Column, size: int = 1500) -> DataFrame:
    """df with shard: `size` rows in a row of the order each. Global places come from counts by range partition, not from one
    sorted task."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    rows = materialize(rows, "ranged")
    before = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    place = F.col("_i") - F.col("_first") + F.col("_before")
    return rows.join(before.drop("_n"), "_p").withColumn("shard", F.floor(place / size).cast("long")).drop("_p", "_i", "_first", "_before")


def snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """What protected inputs are now, as a table of its own, to be held against later by changed()."""
    return materialize(artifacts(spark, path, pattern), "snapshot", few_files=True)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or different since."""
    b, a = before.select("path", F.col("sha256").alias("_b")), after.select("path", F.col("sha256").alias("_a"))
    out = b.join(a, "path", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return out.select("path", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("different").alias("change"))


def package(folder: str, out: str) -> dict:
    """A zip of a release folder with a manifest of sizes and hashes inside; an existing one raises."""
    if Path(out).exists():
        raise FileExistsError(out)
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    manifest = {str(p.relative_to(folder)): {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in files}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(folder)))
        z.writestr("MANIFEST.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def append_record(spark: SparkSession, path: str, row: dict, key: str) -> None:
    """A row more in a ledger of JSON lines; a key that is there already raises."""
    df = spark.createDataFrame([row])
    if _exists(spark, path) and not spark.read.json(path).where(F.col(key) == row[key]).isEmpty():
        raise ValueError(f"{row[key]} is in the ledger already")
    df.coalesce(1).write.mode("append").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; one of over `most` rows is an error, as a report doesn't end unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} rows")
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines)


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PART = "application/vnd.openxmlformats-officedocument.spreadsheetml"


#: A text that is written as a number.
_NUMBER = re.compile(r"-?(0|[1-9]\d{0,14})(\.\d+)?").fullmatch


@cache
def _letters(col: int) -> str:
    letters = ""
    col += 1
    while col:
        col, at = divmod(col - 1, 26)
        letters = chr(65 + at) + letters
    return letters


class _Book:
    """A workbook's bytes, made of rows in order of sheet and row: numbers as numbers, and all else as text of its own. What is held
    is packed already, but for some rows."""

    def __init__(self) -> None:
        self.out, self.names, self.stream, self.waiting, self.size = io.BytesIO(), [], None, [], 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)

    def _flush(self) -> None:
        self.stream.write("".join(self.waiting).encode())
        self.waiting, self.size = [], 0

    def _close_sheet(self) -> None:
        if self.stream:
            self.waiting.append("</sheetData></worksheet>")
            self._flush()
            self.stream.close()

    def add(self, sheet: str, row: int, cells: list[tuple[int, str]]) -> None:
        if not self.names or self.names[-1] != sheet:
            self._close_sheet()
            self.names.append(sheet)
            self.stream = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
            self.waiting.append(f'<worksheet xmlns="{_SHEET}"><sheetData>')
        n = row + 1
        self.waiting.append(f'<row r="{n}">')
        for col, text in cells:
            if _NUMBER(text):
                self.waiting.append(f'<c r="{_letters(col)}{n}"><v>{text}</v></c>')
            else:
                self.waiting.append(f'<c r="{_letters(col)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        self.waiting.append("</row>")
        self.size += len(cells)
        if self.size > 2000:
            self._flush()

    def content(self) -> bytes:
        self._close_sheet()
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_PART}.worksheet+xml"/>' for i in range(1, len(self.names) + 1))
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(self.names, 1))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self.names) + 1))
        with self.zip as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_PART}.sheet.main+xml"/>{kinds}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEET}" xmlns:r="{_LINK}"><sheets>{names}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        return self.out.getvalue()


def _books(rows: Iterator[tuple[str, str, int, list[tuple[int, str]]]]) -> Iterator[pa.RecordBatch]:
    """A batch for each path of rows (path, sheet, row, cells) that are in order."""
    path, book = None, None
    for p, sheet, row, cells in rows:
        if p != path:
            if book:
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [book.content()]})
            path, book = p, _Book()
        book.add(sheet, row, cells)
    if book:
        yield pa.RecordBatch.from_pydict({"path": [path], "content": [book.content()]})


def workbooks(cells: DataFrame) -> DataFrame:
    """path, content: an .xlsx file for each path of cells (path, sheet, row, col, text), rows and columns from 0; blank cells are
    absent, sheets in order of name. A book is made by one task, as it goes through its rows: its format bounds it, and a table too
    large for one goes into several. readers.cells_of() reads these back; save_files() makes them files."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, list[tuple[int, str]]]]:
        at, cells = None, []
        for batch in batches:
            for p, sheet, row, col, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, sheet, p) != at:
                    if cells:
                        yield at[2], at[1], at[0], cells
                    at, cells = (row, sheet, p), []
                cells.append((col, text))
        if cells:
            yield at[2], at[1], at[0], cells

    rows = cells.where(F.col("text").isNotNull()).select("path", "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("text").cast("string").alias("text"))
    return dealt(rows, "path").sortWithinPartitions("path", "sheet", "row", "col").mapInArrow(lambda b: _books(rows_of(b)), "path string, content binary")


def row_workbooks(rows: DataFrame) -> DataFrame:
    """workbooks() of whole rows (path, sheet, row, texts), whose texts stand in columns from 0 on; of a row number once in a sheet.
    Rows move in place of cells, of which there are many more."""

    def cells_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, list[tuple[int, str]]]]:
        for batch in batches:
            for p, sheet, row, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield p, sheet, row, [(col, text) for col, text in enumerate(texts) if text is not None]

    rows = rows.select("path", "sheet", F.col("row").cast("int").alias("row"), F.col("texts").cast("array<string>").alias("texts")).where(F.exists("texts", lambda x: x.isNotNull()))
    return dealt(rows, "path").sortWithinPartitions("path", "sheet", "row").mapInArrow(lambda b: _books(cells_in(b)), "path string, content binary")


def save_files(files: DataFrame, folder: str) -> int:
    """Each row (path, content) as a file of that name in folder, wherever Spark can write; one that is there is an error. Files go
    through the driver one at a time: for reports, not for data."""
    spark, n = files.sparkSession, 0
    for r in files.toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['path']}")
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        try:
            stream.write(r["content"])
        finally:
            stream.close()
        n += 1
    return n


def review_queue(items: DataFrame, decided: DataFrame, key: str, path: str) -> DataFrame:
    """Items without a decision, as CSV with empty columns for one, and a table of the files' sizes and hashes beside them, which
    is returned. An existing queue raises."""
    open_ = items.join(decided.select(key), key, "left_anti").select("*", *(F.lit("").alias(c) for c in ("decision", "reviewer", "note")))
    write_csv(open_, f"{path}/queue")
    written = artifacts(items.sparkSession, f"{path}/queue", "part-*").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
    written.coalesce(1).write.mode("errorifexists").json(f"{path}/hashes")
    return items.sparkSession.read.schema("file string, bytes long, sha256 string").json(f"{path}/hashes")


def freeze(panel: DataFrame, key: str, path: str) -> DataFrame:
    """The frozen copy of a panel at path: made on the first call, and on later ones the same or an error. What counts is the
    panel's content, sums of its rows' hashes; a folder with only one of panel and manifest is an error."""
    from ..operators.relational import require_unique

    spark = panel.sparkSession
    require_unique(panel, [key], "the panel")
    columns = sorted(panel.columns)
    # Sums of hashes don't depend on the order of rows, so they are partial sums of all tasks and nothing is gathered.
    hashed = F.sha2(F.to_json(F.struct(*columns)), 256)
    sums = [F.sum(F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31)]
    digest = lambda df: df.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)).first()[0]
    there = [_exists(spark, f"{path}/{part}") for part in ("panel", "manifest")]
    if any(there) and not all(there):
        raise FileExistsError(f"half of a frozen panel: {path}")
    own = digest(panel)
    if not all(there):
        panel.write.parquet(f"{path}/panel")
        spark.createDataFrame([(own, panel.count())], "sha256 string, n long").coalesce(1).write.json(f"{path}/manifest")
    frozen = spark.read.parquet(f"{path}/panel")
    if spark.read.json(f"{path}/manifest").first()["sha256"] != own or digest(frozen.select(*panel.columns)) != own:
        raise ValueError("the frozen panel is another one")
    return frozen


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
