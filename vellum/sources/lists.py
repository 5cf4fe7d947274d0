"""List files, mask files, order lists and directories as tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(data: Column) -> Column:
    """Text of unknown encoding: by its byte order mark, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring(data, 1, 3))
    after = lambda k: F.substring(data, k, 1 << 30)
    return (
        F.when(head == "EFBBBF", F.decode(after(4), "UTF-8")).when(head.startswith("FFFE"), F.decode(after(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(after(3), "UTF-16BE")).when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8"))
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def _lines(files: DataFrame, clean) -> DataFrame:
    """``path, line_no, line`` of ``path, content``; lines that are empty once cleaned go."""
    split = files.select("path", F.posexplode(F.split(decoded(F.col("content")), "\r?\n")).alias("line_no", "raw"))
    return split.select("path", "line_no", clean(F.col("raw")).alias("line")).where("line <> ''")


def list_lines(files: DataFrame) -> DataFrame:
    """Names of list files: ``//`` starts a comment, blanks at the end don't count."""
    return _lines(files, lambda c: F.regexp_replace(F.split(c, "//", 2)[0], r"\s+$", ""))


def mask_lines(files: DataFrame) -> DataFrame:
    """Masks, one to a line, without blanks around them."""
    return _lines(files, F.trim)


def order_lines(files: DataFrame) -> DataFrame:
    """Masks of an order list, ``;`` starts a comment; ``is_default`` marks the place of what no mask matches."""
    return _lines(files, lambda c: F.trim(F.split(c, ";", 2)[0])).withColumn("is_default", F.col("line") == "$default")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``name, size, mtime_s`` of the files below a directory; their bytes aren't read.

    The file scan leaves out files without bytes; they are found in its listing, and asked for one by one.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = [unquote(p) for p in found.inputFiles()]
    # Whatever the scheme and authority, names begin behind the root's path.
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    full = found.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_s"))
    names = spark.createDataFrame([(p,) for p in listed], "_path string")
    empty = [r["_path"] for r in names.join(full.select(bare("path").alias("_full")), bare(F.col("_path")) == F.col("_full"), "left_anti").collect()]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    status = lambda p: (place := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).getFileStatus(place)
    rows = [(p, s.getLen(), s.getModificationTime() // 1000) for p in empty for s in [status(p)]]
    both = full.unionByName(spark.createDataFrame(rows, "path string, size long, mtime_s long"))
    return both.select(F.regexp_replace("path", f"^.*?\\Q{base}\\E", "").alias("name"), "size", "mtime_s")
