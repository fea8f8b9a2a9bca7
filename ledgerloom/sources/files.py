"""Small file operations on whatever file system a path names."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _locate(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    fs, target = _locate(spark, path)
    return fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, target = _locate(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file if the name is free; False if it is taken.

    The text goes to a hidden name first and is renamed without overwriting, so the file
    appears whole or not at all and the first of several writers wins. That rename is atomic
    on HDFS; a store without such a rename needs one writer at a time.
    """
    fs, target = _locate(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(options, 1)
    how[0] = options.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(target), how)
        return True
    except Py4JJavaError as problem:
        fs.delete(hidden, False)
        if "FileAlreadyExistsException" in str(problem.java_exception):
            return False
        raise
