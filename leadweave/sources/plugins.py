"""Captured cards, model judgments and place catalogs as data sources of the session.

What a user plugs in is a ``LineSource``: a folder of JSON lines, a schema and a rule from one line
to rows. ``register_sources`` makes the three built-in ones known by name, a user's own is given to
``spark.dataSource.register`` in the same way. Each reads in batch (``spark.read.format(name)``) and as
a stream (``spark.readStream.format(name)``).

* Files become byte ranges of at most ``partition_bytes``, small files share a partition, and a range
  starts at its first whole line, so no task depends on how large a file is.
* Folders named ``key=value`` give key columns; equality and ``IN`` filters on them choose the files.
* A line that is no JSON object, and a value that doesn't fit its column, comes out as NULL; the first
  kind keeps its text in ``capture_error`` where the schema has that column. Blank lines give no row.
* A stream's offset is the modification time and path of the last file, so a batch lists the folder
  but reads new files only. Files must be written under another name (or a leading ``_`` or ``.``) and
  then renamed, as Spark's own writers do.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from leadweave.functions.text import fold_accents
from leadweave.schemas import PLACE_CARDS

PARTITION_BYTES = 64 << 20
BATCH_LINES = 4096
FILTER_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}


class Ranges(InputPartition):
    """Byte ranges ``(path, start, end)`` that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(None)
        self.pieces = pieces


def folder_keys(path: str) -> dict[str, str | None]:
    """Values of the ``key=value`` folders above a file."""
    pairs = [part.split("=", 1) for part in path.split("/")[:-1] if "=" in part]
    return {key: None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value) for key, value in pairs}


def _open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[int, str, int]]:
    """Modification time, path and size of the files below a folder; hidden ones are left out."""
    system, inside = _open_folder(path)
    found = system.get_file_info(fs.FileSelector(inside, recursive=True))
    below = len(inside.rstrip("/")) + 1
    return sorted(
        (info.mtime_ns or 0, info.path, info.size) for info in found
        if info.type == fs.FileType.File and info.size and not any(part[:1] in "._" for part in info.path[below:].split("/")))


def pack_ranges(files: Iterable[tuple[str, int]], most: int) -> list[Ranges]:
    """Partitions of at most ``most`` bytes: long files are cut, short ones put together."""
    partitions: list[Ranges] = []
    pieces: list[tuple[str, int, int]] = []
    held = 0
    for path, size in files:
        for start in range(0, size, most):
            length = min(most, size - start)
            if pieces and held + length > most:
                partitions.append(Ranges(pieces))
                pieces, held = [], 0
            pieces.append((path, start, start + length))
            held += length
    return partitions + ([Ranges(pieces)] if pieces else [])


def range_lines(system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[str]:
    """The lines that begin inside ``[start, end)``."""
    with io.BufferedReader(system.open_input_file(path), 1 << 20) as file:
        if start:  # the line that runs into the range belongs to the range before
            file.seek(start - 1)
            file.readline()
        while file.tell() < end and (line := file.readline()):
            yield line.decode("utf-8", "replace").lstrip("﻿")


def fitting(value: Any, kind: T.DataType) -> Any:
    """The value in the type of its column, NULL where it doesn't fit."""
    if value is None or isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool):
        return None
    try:
        if isinstance(kind, T.DoubleType):
            return float(value)
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    bits = 31 if isinstance(kind, T.IntegerType) else 63
    whole = isinstance(value, str) or number == value
    return number if whole and -(2**bits) <= number < 2**bits else None


class _Lines:
    """What the batch and the stream reader share: files to partitions, and partitions to rows."""

    def __init__(self, source: LineSource, columns: T.StructType):
        self.source, self.columns = source, columns
        self.path = source.options["path"]
        self.most = max(1, int(source.options.get("partition_bytes", PARTITION_BYTES)))
        self.chosen: dict[str, set[str]] = {}

    def wanted(self, path: str) -> bool:
        keys = folder_keys(path)
        return all(keys.get(name) in values for name, values in self.chosen.items())

    def pack(self, files: Iterable[tuple[int, str, int]]) -> list[Ranges]:
        return pack_ranges([(path, size) for _, path, size in files if self.wanted(path)], self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in self.columns])
        system, _ = _open_folder(self.path)
        held: list[dict] = []
        for path, start, end in partition.pieces:
            keys = folder_keys(path)
            for line in range_lines(system, path, start, end):
                if line.strip():
                    held.extend(self.source.rows(line, keys))
                if len(held) >= BATCH_LINES:
                    yield self._batch(held, schema)
                    held = []
        if held:
            yield self._batch(held, schema)

    def _batch(self, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        arrays = [pa.array([fitting(row.get(f.name), f.dataType) for row in rows], schema.field(f.name).type) for f in self.columns]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


class LineReader(_Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and IN on key columns choose files; Spark still tests every filter on the rows."""
        for wanted in filters:
            if isinstance(wanted, (EqualTo, In)) and wanted.attribute[0] in self.source.keys and len(wanted.attribute) == 1:
                values = [wanted.value] if isinstance(wanted, EqualTo) else wanted.value
                texts = {str(value) for value in values if value is not None}
                name = wanted.attribute[0]
                self.chosen[name] = self.chosen[name] & texts if name in self.chosen else texts
            yield wanted

    def partitions(self) -> list[Ranges]:
        return self.pack(list_files(self.path)) or [Ranges([])]


class LineStreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return self.pack(f for f in list_files(self.path) if after < f[:2] <= until)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay where they are."""


class LineSource(DataSource):
    """A folder of JSON lines. A subclass names itself, its columns, its key columns and its rows."""

    columns: str
    keys: tuple[str, ...] = ()

    def schema(self) -> str:
        return self.columns

    def rows(self, line: str, keys: dict[str, str | None]) -> Iterable[dict]:
        """Rows of one line; values are brought into the column types afterwards."""
        try:
            found = json.loads(line)
        except ValueError:
            found = None
        if not isinstance(found, dict):
            found = {"capture_error": line.rstrip("\r\n")}
        return [found | {key: keys[key] for key in self.keys if key in keys}]

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(self, schema)

    def streamReader(self, schema: T.StructType) -> LineStreamReader:
        return LineStreamReader(self, schema)


class CapturedCards(LineSource):
    """Listing cards of search runs, one folder ``run_id=...`` for each run."""

    columns = PLACE_CARDS + ", capture_error string"
    keys = ("run_id",)

    @classmethod
    def name(cls) -> str:
        return "captured_cards"


class CapturedJudgments(LineSource):
    """Answers of any model, one folder ``provider=...`` for each provider."""

    columns = "site_id long, provider string, stop_reason string, response string, capture_error string"
    keys = ("provider",)

    @classmethod
    def name(cls) -> str:
        return "captured_judgments"


class RegionCatalogs(LineSource):
    """E5: place names by region, one catalog document on each line, one folder ``country=...`` for each country."""

    columns = "country string, region string, name string, ambiguous boolean"
    keys = ("country",)

    @classmethod
    def name(cls) -> str:
        return "region_catalogs"

    def rows(self, line: str, keys: dict[str, str | None]) -> Iterator[dict]:
        document = next(iter(super().rows(line, keys)))
        regions, unclear = document.get("regiones"), document.get("ambiguas")
        unclear = set(filter(lambda x: isinstance(x, str), unclear)) if isinstance(unclear, list) else set()
        for region, names in regions.items() if isinstance(regions, dict) else ():
            for name in names if isinstance(names, list) else ():
                if isinstance(name, str):
                    yield {"country": document.get("country"), "region": region, "name": name, "ambiguous": name in unclear}


def register_sources(spark: SparkSession) -> None:
    """Make the three sources known to the session and let Python sources see filters."""
    spark.conf.set(FILTER_PUSHDOWN, "true")
    for source in (CapturedCards, CapturedJudgments, RegionCatalogs):
        spark.dataSource.register(source)


def catalog_names(rows: DataFrame) -> DataFrame:
    """Catalog rows of any source as the catalog of the place operators: distinct names, folded, ambiguous if any row says so."""
    once = rows.groupBy("name").agg(F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))
    return once.select("name", fold_accents("name").alias("folded"), "ambiguous")
