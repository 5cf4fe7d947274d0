"""Sinks: members as files, names as a log, and tables that are replaced as a whole."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import paths

#: Members whose bytes are written by one task at a time.
ROWS = 64


def extract(members: DataFrame, root: str) -> DataFrame:
    """Write ``ord, target, payload`` below a folder that all executors share; ``ord, name, size, outcome``.

    Each file is written beside its place and moved there whole, so that a task that
    runs again, or a reader, never meets half of one.  Unsafe names are ``refused``, names
    that had to be cleaned ``corrected``, a null payload is ``failed``.  The result is
    lazy: the files are written when it is evaluated.
    """
    safe = paths.sanitize(F.col("target"))
    rows = members.select("ord", F.col("target").alias("name"), safe.alias("path"), F.col("payload").cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, outcomes = [], []
            for name, path, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                sizes.append(len(payload or b""))
                if path is None:
                    outcomes.append("refused")
                    continue
                if payload is None:
                    outcomes.append("failed")
                    continue
                place = os.path.join(root, path)
                staged = f"{place}.{uuid.uuid4().hex}.part"
                try:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(staged, "wb") as out:
                        out.write(payload)
                    os.replace(staged, place)
                    outcomes.append("written" if path == name else "corrected")
                except OSError:
                    if os.path.exists(staged):
                        os.remove(staged)
                    outcomes.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(outcomes, pa.string())], ["ord", "name", "size", "outcome"])

    return rows.mapInArrow(run, "ord long, name string, size long, outcome string")


def printed(members: DataFrame) -> Iterator[bytes]:
    """The payloads of ``ord, payload`` in archive order; the driver holds one partition at a time."""
    for row in members.select("ord", "payload").orderBy("ord").toLocalIterator():
        yield bytes(row["payload"] or b"")


def log_names(members: DataFrame, path: str, utf16: bool = False, append: bool = True) -> None:
    """Append the names of ``ord, name`` to a folder of text files, in archive order."""
    writer = members.orderBy("ord").select(F.col("name").alias("value")).write.mode("append" if append else "overwrite")
    (writer.option("encoding", "UTF-16LE").option("header", "false").option("quote", "").csv(path) if utf16 else writer.text(path))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, place, place.getFileSystem(conf), conf


def commit(df: DataFrame, root: str) -> str:
    """Replace the table at ``root`` by ``df``, as a whole or not at all; the folder of its data.

    The rows go to a folder of their own first; then a pointer is moved over the
    old one.  Readers see the old table until that, the new one from then on.  What a
    failed write has left is removed; the replaced data stay until ``clean``.
    """
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    jvm, place, fs, conf = _files(spark, root)
    whole = jvm.org.apache.hadoop.fs.Path(place, data)
    try:
        df.write.parquet(whole.toString())
        staged = jvm.org.apache.hadoop.fs.Path(place, f"CURRENT.{data}")
        out = fs.create(staged, True)
        out.write(bytearray(data.encode()))
        out.close()
        rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = fs.makeQualified(place).toUri()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified, conf).rename(fs.makeQualified(staged), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(place, "CURRENT")), rename)
    except Exception:
        fs.delete(whole, True)
        raise
    return data


def _pointer(spark: SparkSession, root: str) -> str | None:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "CURRENT").load(root).select("content").first()
    return bytes(found["content"]).decode() if found else None


def current(spark: SparkSession, root: str) -> DataFrame:
    """The committed table."""
    data = _pointer(spark, root)
    if not data:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root.rstrip('/')}/{data}")


def clean(spark: SparkSession, root: str) -> None:
    """Remove data that the pointer doesn't name: what was replaced, and what a crash has left."""
    data = _pointer(spark, root)
    _, place, fs, _ = _files(spark, root)
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(("data-", "CURRENT.")) and name != data:
            fs.delete(status.getPath(), True)


def append(df: DataFrame, root: str) -> str:
    """Commit the table with more rows, numbered behind its last in the order of their own numbers."""
    old = current(df.sparkSession, root)
    last = old.agg(F.max("ord").alias("_last"))
    low = df.agg(F.min("ord").alias("_low"))
    moved = df.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(low)).withColumn("ord", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("ord") - F.col("_low"))
    return commit(old.unionByName(moved.select(df.columns), allowMissingColumns=True), root)
