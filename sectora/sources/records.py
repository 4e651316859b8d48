"""Tables that come as records or long statistics: codes are joined to their labels, records of one cell add up, cells take the labelled form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..schema import WrongInput


def scatter(records: DataFrame, keys: Mapping[str, Column | str], value: Column | str = "value") -> DataFrame:
    """Labelled cells of records: keys gives the expression of each label column (those left out are null); duplicates add up in one aggregation."""
    wanted = ["scenario", "matrix", *[f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")]]
    if unknown := set(keys) - set(wanted):
        raise WrongInput(f"unknown label columns: {sorted(unknown)}")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    null = F.lit(None).cast("string")
    columns = [(as_column(keys[c]).cast("string") if c in keys else F.lit(schema.BASELINE) if c == "scenario" else null).alias(c) for c in wanted]
    return records.select(*columns, as_column(value).cast("double").alias("value")).groupBy(*wanted).agg(F.sum("value").alias("value"))


def decoded(records: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """records with coded columns replaced by their labels (code, label); unknown codes are refused."""
    for column, table in codes.items():
        known = table.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
        if not records.filter(F.col(column).isNotNull()).join(known, records[column] == known["_code"], "left_anti").isEmpty():
            raise WrongInput(f"{column} has codes without a label")
        records = records.join(known, records[column] == known["_code"], "left").withColumn(column, F.col("_label")).drop("_code", "_label")
    return records


def read_long(spark: SparkSession, path: str, columns: Mapping[str, str], filters: Mapping[str, str] | None = None, sep: str = ",", missing: tuple[str, ...] = (":", "", "NA")) -> DataFrame:
    """Long statistics in delimited text: columns renamed (file column -> name), rows filtered by equality, values that are marked missing left out.

    A value may carry flags after its number ("12.3 e", "5.1bp") or spaces between thousands; what has no number at all is refused."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    for column, value in (filters or {}).items():
        rows = rows.filter(F.col(f"`{column}`") == value)
    out = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    if "value" in out.columns:
        text = F.trim("value")
        plain = F.regexp_replace(text, r"(?<=\d)[ \u00A0\u202F](?=\d{3}(\D|$))", "")
        number = F.regexp_extract(plain, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
        marked = F.regexp_extract(text, r"^(:|)\s*[A-Za-z]*$", 0) == text  # a mark of missing, with flags or alone
        out = out.filter(text.isNotNull() & ~text.isin(*missing) & ~(marked & text.startswith(":"))).withColumn("_number", number)
        wrong = out.filter("_number = ''").select("value").first()
        if wrong is not None:
            raise WrongInput(f"{wrong[0]!r} is no number")
        out = out.withColumn("value", F.col("_number").cast("double")).drop("_number")
    return out
