"""Readers by name: a reader is a function (spark, path, **options) -> Model; one's own stand beside those built in."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import SparkSession

from .. import schema
from ..model import Model
from ..schema import WrongInput
from . import archives, flat, matrices, records

Reader = Callable[..., Model]


def _matrix_folder(spark: SparkSession, path: str, kind: str, matrices_: dict[str, dict] | None = None, sep: str = ",", units=None) -> Model:
    """A folder of one text file a matrix: Z.csv and the like, three label rows and columns (factors and accounts one column). What is left out of EY, VY
    and units.csv (level, item, unit) isn't there."""
    at = lambda name: posixpath.join(path, name)
    if units is None and archives.exists(spark, at("units.csv")):
        units = spark.read.option("header", True).option("sep", sep).schema(schema.UNITS).csv(at("units.csv"))
    if matrices_ is None:
        wide = dict(header_rows=3, index_columns=3)
        narrow = lambda level: dict(header_rows=3, index_columns=1, level=level)
        matrices_ = {"Z": wide, "Y": wide, "V": narrow("Factor of production"), "E": narrow("Satellite account"), "EY": narrow("Satellite account"), "VY": narrow("Factor of production")}
        matrices_ = {k: v for k, v in matrices_.items() if k not in ("EY", "VY") or archives.exists(spark, at(f"{k}.csv"))}
    out = None
    for name, options in matrices_.items():
        cells = matrices.read_matrix(spark, at(options.get("file", f"{name}.csv")), name, sep=sep, **{k: v for k, v in options.items() if k != "file"})
        out = cells if out is None else out.unionByName(cells)
    return Model.from_labelled(out, kind, units)


def _records(spark: SparkSession, path: str, kind: str, keys: dict, value: str = "value", format: str = "csv", units=None) -> Model:
    rows = spark.read.parquet(path) if format == "parquet" else spark.read.option("header", True).csv(path)
    return Model.from_labelled(records.scatter(rows, keys, value), kind, units)


READERS: dict[str, Reader] = {"flat": flat.read_flat, "matrices": _matrix_folder, "records": _records}


def register_reader(name: str, reader: Reader, replace: bool = False) -> None:
    if name in READERS and not replace:
        raise WrongInput(f"a reader called {name!r} stands already")
    READERS[name] = reader


def read(name: str, spark: SparkSession, path: str, **options) -> Model:
    """A model by the reader of this name; a zip archive is unpacked first."""
    if name not in READERS:
        raise WrongInput(f"no reader is called {name!r}; there are {sorted(READERS)}")
    return READERS[name](spark, archives.unpacked(spark, path) if path.lower().endswith(".zip") else path, **options)
