"""Folders of any file system that Spark knows: listing, deleting."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one of that name; of several that try at once, one does.

    On a local disk the finished file is linked to its name, which fails if the name is taken. Other file systems refuse to
    create a file twice; theirs may be seen before it is whole, so readers must tell whole texts.
    """
    fs, p = _open(spark, path)
    if fs.getUri().getScheme() == "file":
        place = p.toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(place), prefix=".new-", delete=False) as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f.name, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(f.name)
        return True
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
