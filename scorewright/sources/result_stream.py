"""Result files of any size: a Spark data source that reads them piece by piece.

A result file is one JSON object whose samples are an array in it. The reader goes through its fields and
through the array's elements one by one, so a task holds one sample's text and a buffer, however many
samples there are. The rows are runs without their samples, or samples; of either only the columns that
the schema asks for are built.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from .runs import OLD_FIELDS, SAMPLE_FIELDS, SCHEMA, SKIPPED, normal_sample, unified

NAME = "scorewright_results"
#: What may stand after a value.
AFTER = (",", "]", "}", ":", " ", "\t", "\r", "\n")
#: Bytes that are read at once.
BUFFER = 1 << 20
SAMPLES = "per_sample"
#: Columns of runs and of samples (fixed values); ``samples`` is the number of elements.
RUN_ROWS = "file string, " + SCHEMA.split("per_sample array")[0].rstrip(", ") + ", samples bigint"
SAMPLE_ROWS = "file string, ordinal bigint, " + ", ".join(f"`{name}` {kind}" for name, kind in re.findall(r"(\w+):((?:\w+(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?))(?:,|$)", f"{SAMPLE_FIELDS},{OLD_FIELDS}"))


class Pieces:
    """The JSON values of a file, one after the other, from a buffer that is as long as one of them needs."""

    def __init__(self, file: BinaryIO, size: int = BUFFER) -> None:
        self.file, self.size = file, size
        self.decode = codecs.getincrementaldecoder("utf-8")().decode
        self.scan = json.JSONDecoder().raw_decode
        self.text, self.at, self.over = "", 0, False

    def more(self, n: int) -> bool:
        """Reads on by at least so many bytes, if there are any; what was gone through is forgotten."""
        raw = self.file.read(max(n, self.size))
        self.over = not raw
        self.text, self.at = self.text[self.at :] + self.decode(raw, final=self.over), 0
        return not self.over

    def next_sign(self) -> str:
        """The next character that isn't white space, which stays; an empty one at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more(1):
                return ""

    def take(self, sign: str) -> None:
        if self.next_sign() != sign:
            raise ValueError(f"{sign!r} expected")
        self.at += 1

    def value(self) -> object:
        """The next JSON value. A buffer that ends within it is doubled, so that none is read more than twice its length."""
        self.next_sign()
        while True:
            try:
                found, end = self.scan(self.text, self.at)
                # a number may go on unless something follows that ends it
                if self.over or self.text[end : end + 1] in AFTER and end < len(self.text):
                    self.at = end
                    return found
            except json.JSONDecodeError as failure:
                # only an error where the buffer ends, or a string without end, may come from the cut
                if self.over or failure.pos < len(self.text) - 8 and not failure.msg.startswith("Unterminated"):
                    raise
            if not self.more(len(self.text) - self.at) and self.at >= len(self.text):
                raise ValueError("a value is missing")

    def elements(self) -> Iterator[object]:
        """The elements of the array that comes next."""
        self.take("[")
        if self.next_sign() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            sign = self.next_sign()
            self.at += 1
            if sign == "]":
                return
            if sign != ",":
                raise ValueError("',' or ']' expected")

    def fields(self) -> Iterator[str]:
        """The names of the object that comes next; the caller takes the value of each before it asks for the next."""
        self.take("{")
        if self.next_sign() == "}":
            self.at += 1
            return
        while True:
            name = self.value()
            if not isinstance(name, str):
                raise ValueError("a name expected")
            self.take(":")
            yield name
            sign = self.next_sign()
            self.at += 1
            if sign == "}":
                return
            if sign != ",":
                raise ValueError("',' or '}' expected")


def typed(value: object, kind: DataType) -> object:
    """A JSON value as a Spark type, null where it is none; what isn't text becomes JSON where text is asked for."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
    if isinstance(kind, LongType | IntegerType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [typed(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {k: typed(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StructType):
        return tuple(typed(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    raise TypeError(f"no such column: {kind}")


def run_rows(file: BinaryIO, name: str, schema: StructType, size: int = BUFFER) -> Iterator[tuple]:
    """The run of one file; none if the file isn't a run or is broken anywhere. Samples are gone through one by one and forgotten."""
    asked, found, count = set(schema.names), {"file": name}, 0
    try:
        pieces = Pieces(file, size)
        for field in pieces.fields():
            if field == SAMPLES and pieces.next_sign() == "[":
                count = sum(1 for _ in pieces.elements())
            elif (value := pieces.value()) is not None and field in asked - {"file", "samples"}:
                found[field] = value
    except (ValueError, RecursionError):
        return
    yield tuple(typed((found | {"samples": count}).get(f.name), f.dataType) for f in schema)


def sample_rows(file: BinaryIO, name: str, schema: StructType, size: int = BUFFER) -> Iterator[tuple]:
    """The samples of one file in their order; of a broken file those before the break."""
    try:
        pieces = Pieces(file, size)
        for field in pieces.fields():
            if field != SAMPLES or pieces.next_sign() != "[":
                pieces.value()
                continue
            for k, sample in enumerate(pieces.elements()):
                if isinstance(sample, dict):
                    own = sample | {"file": name, "ordinal": k}
                    yield tuple(typed(own.get(f.name), f.dataType) for f in schema)
    except (ValueError, RecursionError):
        return


class OneFile(InputPartition):
    def __init__(self, place: str) -> None:
        super().__init__(place)


class ResultReader(DataSourceReader):
    """Reads each file in a task of its own; ``root`` is any place that pyarrow opens."""

    def __init__(self, schema: StructType, root: str, samples: bool) -> None:
        self.schema, self.root, self.samples = schema, root, samples

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        system, root = self._store()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        names = sorted((x.base_name, x.path) for x in found if x.type == fs.FileType.File)
        return [OneFile(path) for name, path in names if fnmatch(name, "*.json") and not name.startswith(".") and name not in SKIPPED] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        place = partition.value
        if place:
            system, _ = self._store()
            with system.open_input_stream(place) as file:
                yield from (sample_rows if self.samples else run_rows)(file, place.rpartition("/")[2], self.schema)


class ResultSource(DataSource):
    """``spark.read.format("scorewright_results")``: option ``rows`` is runs or samples; a schema of one's own picks columns of them."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SAMPLE_ROWS if self.options.get("rows") == "samples" else RUN_ROWS

    def reader(self, schema: StructType) -> ResultReader:
        return ResultReader(schema, self.options["path"], self.options.get("rows") == "samples")


def _rows(spark: SparkSession, folder: str, rows: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    spark.dataSource.register(ResultSource)
    reader = spark.read.format(NAME).option("rows", rows)
    if columns is not None:
        all_ = StructType.fromDDL(SAMPLE_ROWS if rows == "samples" else RUN_ROWS)
        reader = reader.schema(StructType([all_[c] for c in columns]))
    return reader.load(folder)


def runs_of_any_size(spark: SparkSession, folder: str) -> DataFrame:
    """What ``read_runs`` gives but for the samples, whose number is in ``samples``."""
    raw = _rows(spark, folder, "runs")
    none = F.array().cast(f"array<struct<{SAMPLE_FIELDS},{OLD_FIELDS}>>")
    counted = raw.select("file", "samples")
    return unified(raw.withColumns({"per_sample": none, "_corrupt_record": F.lit(None).cast("string")})).drop("per_sample").join(counted, "file")


def samples_of_any_size(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ordinal, sample) of the runs in a folder: each sample in the newer files' shape, whatever its file's version."""
    runs = _rows(spark, folder, "runs", ("file", "schema_version", "model", "results")).where("results is not null and model is not null")
    raw = _rows(spark, folder, "samples")
    fields = F.struct(*(c for c in raw.columns if c not in ("file", "ordinal")))
    rows = raw.select("file", "ordinal", fields.alias("s")).join(runs.select("file", (F.coalesce("schema_version", F.lit(1)) < 2).alias("old")), "file")
    return rows.select("file", "ordinal", F.when(F.col("old"), normal_sample(F.col("s"), True)).otherwise(normal_sample(F.col("s"), False)).alias("sample"))


def sample_columns(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Just the named columns of all samples as they stand in the files, with their file; nothing else of a sample is kept."""
    return _rows(spark, folder, "samples", ("file", *columns))
