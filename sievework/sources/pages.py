"""Spark data sources for numbered JSON files: a writer of shards that commits them together with a manifest of their digests, and a
reader of cached pages, a partition for each."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .writers import numbered_shards

MANIFEST = "manifest.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, which all tasks must reach, and its place there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(files: fs.FileSystem, path: str, content: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(content)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]


class _ShardWriter(DataSourceWriter):
    """Rows (shard, record) in order of shard. A task writes each shard under a name of its own try; the driver gives the shards of
    the tries that Spark commits their names, and writes the manifest last: a shard whose task failed, or ran twice, is never seen."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        files, folder = _open(self.path)
        files.create_dir(f"{folder}/_trying", recursive=True)
        done = []
        for shard, rows in groupby(iterator, key=lambda r: r[0]):
            out, n = io.BytesIO(), 0
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
                for _, record in rows:
                    f.write(b"," if n else b"[")
                    f.write(record.encode())
                    n += 1
                f.write(b"]")
            name = f"_trying/{uuid.uuid4().hex}"
            _put(files, f"{folder}/{name}", out.getvalue())
            done.append((name, f"{shard:05d}.json.gz", n, hashlib.sha256(out.getvalue()).hexdigest()))
        return _Written(done)

    def commit(self, messages) -> None:
        files, folder = _open(self.path)
        found = sorted((name, n, digest, temporary) for m in messages if m for temporary, name, n, digest in m.files)
        for name, _, _, temporary in found:
            files.move(f"{folder}/{temporary}", f"{folder}/{name}")
        shards = [{"path": name, "records": n, "sha256": digest} for name, n, digest, _ in found]
        _put(files, f"{folder}/{MANIFEST}", json.dumps({"format": "gzip_json_array", "records": sum(s["records"] for s in shards), "shards": shards}, indent=1).encode())
        if files.get_file_info(f"{folder}/_trying").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/_trying")

    def abort(self, messages) -> None:
        files, folder = _open(self.path)
        if files.get_file_info(f"{folder}/_trying").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/_trying")


@dataclass
class _Page(InputPartition):
    name: str


class _PageReader(DataSourceReader):
    """A partition for each file `<number>.json` or `.json.gz` of a folder, or `<key>_<number>`; a number that is missing between
    others is an error, as pages follow each other. field: where a page's records are, empty if a page is their array."""

    def __init__(self, path: str, key: str, field: str):
        self.path, self.key, self.field = path, key, field

    def partitions(self) -> list[_Page]:
        files, folder = _open(self.path)
        pattern = re.compile(rf"{re.escape(self.key + '_') if self.key else ''}(\d+)\.json(\.gz)?")
        found = {int(m[1]): name for name in (posixpath.basename(i.path) for i in files.get_file_info(fs.FileSelector(folder))) if (m := pattern.fullmatch(name))}
        if not found:
            raise FileNotFoundError(f"no page of {self.key or 'any key'} is cached in {self.path}, and this is offline")
        missing = sorted(set(range(min(found), max(found) + 1)) - set(found))
        if missing:
            raise FileNotFoundError(f"pages {missing[:5]} of {self.key or 'any key'} aren't cached")
        return [_Page(found[n]) for n in sorted(found)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        files, folder = _open(self.path)
        with files.open_input_stream(f"{folder}/{partition.name}", compression=None) as f:
            data = f.read()
        page = json.loads(gzip.decompress(data) if partition.name.endswith(".gz") else data)
        at = int(re.search(r"(\d+)\.json", partition.name)[1])
        expected = page.get("meta", {}).get("count") if isinstance(page, dict) else None
        for i, record in enumerate(page[self.field] if self.field else page):
            yield at, i, json.dumps(record, ensure_ascii=False), expected


class JsonShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_shards"

    def schema(self) -> str:
        return "page int, place int, record string, expected long"

    def writer(self, schema, overwrite: bool) -> _ShardWriter:
        files, folder = _open(self.options["path"])
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            raise FileExistsError(self.options["path"])
        return _ShardWriter(self.options["path"])

    def reader(self, schema) -> _PageReader:
        return _PageReader(self.options["path"], self.options.get("key", ""), self.options.get("field", ""))


def write_shards(df: DataFrame, path: str, order: Column, size: int = 1500) -> DataFrame:
    """df as gzipped JSON arrays of `size` rows in order, 00000.json.gz and on, with a manifest of their rows and SHA-256, which is
    returned as path, records, sha256. A folder that is there is an error. path must be one that all tasks can write to."""
    spark = df.sparkSession
    spark.dataSource.register(JsonShards)
    columns = df.columns
    rows = numbered_shards(df.withColumn("_order", order), F.col("_order"), size).select("shard", "_order", F.to_json(F.struct(*columns)).alias("record"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "_order").select(F.col("shard").cast("int").alias("shard"), "record")
    dealt.write.format("json_shards").mode("append").save(path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.json(f"{path}/{MANIFEST}", multiLine=True, schema="records long, shards array<struct<path: string, records: long, sha256: string>>")
    return shards.select(F.inline("shards"))


def read_pages(spark: SparkSession, path: str, key: str = "", field: str = "") -> DataFrame:
    """page, place, record (JSON), expected (the count that the page's meta gives, if it does) of the cached pages of key."""
    spark.dataSource.register(JsonShards)
    options = {"path": path} | ({"key": key} if key else {}) | ({"field": field} if field else {})
    return spark.read.format("json_shards").options(**options).load()
