"""Folders and files on any file system that Spark reads: local, HDFS, object stores."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from peptrail.checks import DataError


@dataclass(frozen=True)
class Found:
    """A file: where it is, its name below the place that was asked for, its bytes and when it changed."""

    uri: str
    name: str
    size: int
    changed_ms: int


def _standard(uri: str) -> str:
    """A URI with an empty authority written out, as other readers want it."""
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _place(spark: SparkSession, uri: str):
    """Hadoop's path and file system of a URI; a bare path belongs to the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(path)


def find(spark: SparkSession, pattern: str) -> list[Found]:
    """Files of one file, a folder (with all below it) or a pattern, by name; names that Spark would not read are left out."""
    store, path = _place(spark, pattern)
    out: list[Found] = []
    waiting = [(s, s.getPath().getName()) for s in store.globStatus(path) or []]
    while waiting:
        status, name = waiting.pop()
        if status.isDirectory():
            waiting += [(s, f"{name}/{s.getPath().getName()}") for s in store.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        else:
            out.append(Found(_standard(status.getPath().toString()), name, status.getLen(), status.getModificationTime()))
    return sorted(out, key=lambda f: f.name)


def read_at(spark: SparkSession, uri: str, at: int, n: int) -> bytes:
    """Bytes of a file from a place on, fewer at its end."""
    store, path = _place(spark, uri)
    stream = store.open(path)
    try:
        stream.seek(at)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def first_character(spark: SparkSession, uri: str, step: int = 4096) -> str:
    """The first character of a text file, unpacked if its name says that it is packed, that is not white space."""
    jvm = spark.sparkContext._jvm
    store, path = _place(spark, uri)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(path)
    stream = store.open(path)
    try:
        plain = codec.createInputStream(stream) if codec is not None else stream
        while data := bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(plain, step))):
            text = data.decode("utf-8", "replace").strip()
            if text:
                return text[0]
        return ""
    finally:
        stream.close()


class Folder:
    """A folder of a run: tables (folders of Parquet files) and small JSON files."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark = spark
        self.store, self.root = _place(spark, str(uri))
        self.store.mkdirs(self.root)

    def uri(self, name: str) -> str:
        return f"{self.root.toString().rstrip('/')}/{name}"

    def has(self, name: str) -> bool:
        return self.store.exists(_place(self.spark, self.uri(name))[1])

    def drop(self, name: str) -> None:
        self.store.delete(_place(self.spark, self.uri(name))[1], True)

    def write_json(self, name: str, value: object) -> None:
        """JSON under a name of its own first, then renamed, so that no reader meets half a file."""
        held, path = _place(self.spark, self.uri(f".{uuid.uuid4().hex}"))[1], _place(self.spark, self.uri(name))[1]
        stream = self.store.create(held)
        try:
            stream.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
        finally:
            stream.close()
        self.store.delete(path, False)
        if not self.store.rename(held, path):
            raise DataError(f"{name} could not be written")

    def read_json(self, name: str) -> object:
        found = find(self.spark, self.uri(name))
        if not found:
            raise DataError(f"there is no {name}")
        return json.loads(read_at(self.spark, found[0].uri, 0, found[0].size))
