"""Files in any store that Spark reads: whether they are there, and zip archives unpacked to the shared folder."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import SparkSession

from ..plans.kernels import shared_dir
from ..schema import WrongInput


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _opened(spark, path)
    return store.exists(at)


def unpacked(spark: SparkSession, path: str) -> str:
    """The folder with what a zip archive holds; below it where all stands in one folder. The bytes stream through the driver's JVM by small buffers."""
    jvm = spark._jvm
    at, store = _opened(spark, path)
    root = f"{shared_dir(spark)}/sectora-files/{uuid.uuid4().hex}"
    archive, tops = jvm.java.util.zip.ZipInputStream(store.open(at)), set()
    try:
        while (entry := archive.getNextEntry()) is not None:
            name = posixpath.normpath(entry.getName().replace("\\", "/"))
            if name.startswith(("/", "..")):
                raise WrongInput(f"{entry.getName()!r} leads out of the archive")
            if entry.isDirectory():
                continue
            tops.add(name.split("/")[0] if "/" in name else None)
            file, there = _opened(spark, posixpath.join(root, name))
            out = there.create(file)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, out, 1 << 16, False)
            finally:
                out.close()
    finally:
        archive.close()
    if not tops:
        raise WrongInput(f"{path} holds no files")
    top = tops.pop()
    return root if tops or top is None else posixpath.join(root, top)
