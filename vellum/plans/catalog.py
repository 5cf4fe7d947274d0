"""The tables that the operators work on, derived from the test tables.

``members`` is one archive's catalog, a row per member in archive order;
``snapshot`` is a later state of the directory it was made from; ``chunks`` are
the members' packed bytes cut into volumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.ranges import running_total

#: Bytes of a volume.
VOLUME = 65536

#: The same tables for the SQL twins.
MEMBERS_SQL = """members AS (
  SELECT doc_id AS ord,
    source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.LOG' ELSE '' END AS name,
    CAST(octet_length(encode(text)) AS BIGINT) AS size,
    CAST(octet_length(encode(text)) * (37 + doc_id % 50) // 100 AS BIGINT) AS packed_size,
    CAST(doc_id % 6 AS INTEGER) AS method, 1700000000 + doc_id * 61 AS mtime_s, doc_id % 3 AS version,
    md5(text) AS md5, source, lang, text
  FROM documents)"""
SNAPSHOT_SQL = MEMBERS_SQL + """, snapshot AS (
  SELECT name, size, mtime_s + size % 3 - 1 AS mtime_s FROM members WHERE lang <> 'fr'
  UNION ALL SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html', CAST(octet_length(encode(html)) AS BIGINT), 1700000000 + page_id FROM pages)"""
CHUNKS_SQL = MEMBERS_SQL + f""", placed AS (
  SELECT ord, name, size, packed_size, CAST(sum(packed_size) OVER (ORDER BY ord) - packed_size AS BIGINT) AS first FROM members), chunks AS (
  SELECT ord, name, v AS volume, CAST(greatest(first, v * {VOLUME}) AS BIGINT) AS lo, CAST(least(first + packed_size, (v + 1) * {VOLUME}) AS BIGINT) AS hi, first, packed_size, size
  FROM placed, unnest(range(first // {VOLUME}, greatest(first, first + packed_size - 1) // {VOLUME} + 1)) AS t(v))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".LOG", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    size = F.octet_length("text").cast("long")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), ext)).alias("name"),
        size.alias("size"),
        F.floor(size * (F.col("doc_id") % 50 + 37) / 100).cast("long").alias("packed_size"),
        (F.col("doc_id") % 6).cast("int").alias("method"),
        (F.col("doc_id") * 61 + 1700000000).alias("mtime_s"),
        (F.col("doc_id") % 3).alias("version"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        "source",
        "lang",
        "text",
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = members(spark, sf_dir).where("lang <> 'fr'").select("name", "size", (F.col("mtime_s") + F.col("size") % 3 - 1).alias("mtime_s"))
    new = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.octet_length("html").cast("long").alias("size"), (F.col("page_id") + 1700000000).alias("mtime_s"))
    return old.unionByName(new)


def chunks(spark: SparkSession, sf_dir: str, volume: int = VOLUME) -> DataFrame:
    """A row for each member and volume with the packed bytes ``lo`` to ``hi``; offsets run through all volumes."""
    placed = running_total(members(spark, sf_dir).select("ord", "name", "size", "packed_size"), "ord", "packed_size", "first")
    div = lambda c: F.floor(c / volume).cast("long")
    last = F.greatest(F.col("first"), F.col("first") + F.col("packed_size") - 1)
    cut = placed.withColumn("volume", F.explode(F.sequence(div(F.col("first")), div(last))))
    return cut.select(
        "ord", "name", "volume",
        F.greatest("first", F.col("volume") * volume).alias("lo"),
        F.least(F.col("first") + F.col("packed_size"), (F.col("volume") + 1) * volume).alias("hi"),
        "first", "packed_size", "size",
    )
