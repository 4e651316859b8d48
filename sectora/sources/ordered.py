"""Text read with the place of every line, and tables that keep the order of the files they came from, however Spark parts them.

A line's place is its file and byte offset, which the task that reads it knows by itself: files are parted by ranges of bytes, and no other pass numbers them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..deploy import ship
from ..model import Model, label_id
from ..plans.kernels import stored
from ..schema import WrongInput
from .flat import from_flat, to_flat

LINE = "file string, offset long, value string"
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
#: Where a line stands.
PLACE = ("file", "offset")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in a range of bytes."""

    path: str
    name: str
    start: int
    end: int


class OrderedLines(DataSource):
    """Lines of a file or of all files of a folder, hidden ones left out. Options: path, and split_bytes, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        system, at = located(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(self.path, name, start, min(start + self.split, size)) for name, size in files for start in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = located(partition.path)
        with system.open_input_file(partition.name) as f:
            for places, lines in lines_of(f, partition.start, partition.end):
                columns = [pa.array([partition.name] * len(lines)), pa.array(places, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines])]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "value"])


def lines_of(f, start: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and bytes of the lines that begin at start or later and before end, without their ends (LF or CR LF)."""
    at = max(start - 1, 0)  # a line begins at start where the byte before ends another
    f.seek(at)
    rest, mine, size = b"", start == 0, CHUNK
    while at < end:
        chunk = f.read(size)
        pieces = (rest + chunk).split(b"\n")
        rest = pieces.pop() if chunk else b""
        size = CHUNK if pieces else 2 * size  # a line longer than what is read at once
        places, lines = [], []
        for piece in pieces:
            if mine and at < end and (chunk or piece):
                places.append(at)
                lines.append(piece.removesuffix(b"\r"))
            mine = True
            at += len(piece) + 1
        if lines:
            yield places, lines
        if not chunk:
            return


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """LINE of every line, read in parallel."""
    ship(spark)
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").option("split_bytes", split_bytes).load(path)


def numbered(rows: DataFrame, *by: str, name: str = "position") -> DataFrame:
    """rows with their number, from 0, in the order of `by`: sorted ranges number their own rows and add the sizes of those before. Ties get any order."""
    ranges = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return ranges.join(starts, "_range").withColumn(name, F.col("_start") + own).drop("_range", "_start")


def first_seen(rows: DataFrame, *keys: str, by: tuple[str, ...] = PLACE) -> DataFrame:
    """keys, position: distinct keys, numbered from 0 by where each stands first."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*by)).alias("_first"))
    return numbered(first.select(*keys, *[F.col(f"_first.{c}").alias(f"_{c}") for c in by]), *[f"_{c}" for c in by]).select(*keys, "position")


def read_flat_in_order(spark: SparkSession, path: str, kind: str, sep: str = ",", units: DataFrame | None = None, tech: str = "industry", split_bytes: int = SPLIT_BYTES) -> tuple[Model, DataFrame]:
    """A model of flat delimited files and the order (id, position) in which its labels stand first, rows' labels before columns'. Every file has the same
    header; a line is a row, so quoted line ends aren't read."""
    rows = lines(spark, path, split_bytes)
    headers = [r["value"] for r in rows.filter("offset = 0").select("value").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise WrongInput("flat files need one header, the same in all")
    columns = next(csv.reader([headers[0].lstrip("\ufeff")], delimiter=sep))
    parsed = rows.filter("offset > 0").select(*PLACE, F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"sep": sep}).alias("row")).select(*PLACE, "row.*")
    cells = stored(from_flat(parsed, PLACE))
    label = lambda s: label_id(*[F.col(f"{c}_{s}") for c in ("region", "level", "item")])
    sides = cells.select(*PLACE, F.explode(F.array(*[F.struct(F.lit(k).alias("side"), label(s).alias("id")) for k, s in enumerate(("from", "to"))])).alias("x")).select(*PLACE, "x.*")
    return Model.from_labelled(cells.drop(*PLACE), kind, units, tech), first_seen(sides, "id", by=(*PLACE, "side"))


def write_flat_in_order(model: Model, order: DataFrame, path: str, sep: str = ",") -> None:
    """All stored cells as delimited text, sorted by scenario, matrix and the order of rows and columns; labels without a place come last, by name. The
    files' names sort as their rows do."""
    place = lambda s: order.select(F.col("id").alias(f"_id_{s}"), F.col("position").alias(f"_at_{s}"))
    cells = model.labelled_cells()
    for s in ("from", "to"):
        cells = cells.withColumn(f"_id_{s}", label_id(*[F.col(f"{c}_{s}") for c in ("region", "level", "item")])).join(place(s), f"_id_{s}", "left")
    names = [f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")]
    keys = ["scenario", "matrix", F.asc_nulls_last("_at_from"), *names[:3], F.asc_nulls_last("_at_to"), *names[3:]]
    ranked = cells.orderBy(*keys)
    to_flat(ranked, trim=False, goods=model.levels[0]).write.option("header", True).option("sep", sep).csv(path)
