"""Shared pieces of the training-data operators: row access, hashing folds, shared tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes 0x20 and 0x09-0x0D part words; bytes.split() without an argument splits at exactly these.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z become a-z; 0-9, a-z and every byte of a non-ASCII character stay; the rest becomes a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, as doc_id and text; other columns, whatever their names, are left behind. Null text is ''."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def with_id(rows: DataFrame, columns: str) -> StructType:
    """The schema of rows' doc_id, whatever its type, and further columns."""
    return StructType([rows.schema["doc_id"], *StructType.fromDDL(columns)])


def modest_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of a few MB for a session that has Spark's default of 64: texts are long, and several Python workers share an executor's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder, set here only if the session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sectora-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sectora-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: A key is hot if it has more than one in HOT of all rows; fewer than HOT keys can be.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of `table` by `key`, null like any other key; rows whose key `table` lacks get nulls. A key stands once in `table`, and its
    column `weight` tells how many of the `total` rows have it.

    Hot keys, fewer than HOT, are broadcast and meet their rows where these are. All others meet by an ordinary join, in which none has more than one in HOT
    of the rows, whether or not Spark broadcasts that side too. Both are read from stored tables."""
    named = table.withColumnRenamed(key, "_key").withColumn("_hot", F.col(weight) * HOT > total).drop(weight)
    on = F.col(key).eqNullSafe(F.col("_key"))
    hot = F.broadcast(named.filter("_hot"))
    near = rows.join(hot, on).drop("_key", "_hot")
    far = rows.join(hot, on, "left_anti").join(named.filter("not _hot"), on, "left").drop("_key", "_hot")
    return near.unionByName(far)


def discard(table: DataFrame) -> None:
    """Deletes a table made by `stored` that nothing will read again."""
    files = table.inputFiles()
    if files and "/sectora-tables/" in files[0]:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def parts(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of about most_bytes, so that what Python holds at once doesn't follow the rows' length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = max(1, min(batch.num_rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null as b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
