"""Listings: projections of the catalog with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import cells, paths


def info(members: DataFrame) -> DataFrame:
    """Counts and sums of the whole catalog, with the ratio in percent to one decimal."""
    total = members.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum("packed_size"), F.lit(0)).cast("long").alias("packed_size"))
    return total.withColumn("ratio", F.when(F.col("size") > 0, F.round(F.col("packed_size") * 100.0 / F.col("size"), 1)).otherwise(0.0))


def listing(members: DataFrame) -> DataFrame:
    return members.select(
        "ord", paths.display_name(F.col("name"), F.col("version")).alias("name"), "size", "packed_size",
        cells.ratio(F.col("packed_size"), F.col("size")).alias("ratio"), cells.time_cell(F.col("mtime_s")).alias("time"), cells.method_name(F.col("method")).alias("method"),
    )


def table(members: DataFrame) -> DataFrame:
    """The long listing of members with its row of totals, whose ``ord`` is null."""
    rows = members.select(
        "ord", cells.attributes_cell(F.lit(cells.NEWEST), F.col("host"), F.col("attributes")).alias("attributes"), "size", "packed_size", cells.ratio(F.col("packed_size"), F.col("size")).alias("ratio"),
        cells.time_cell(F.col("mtime_s")).alias("time"), F.col("md5").alias("checksum"), paths.display_name(F.col("name"), F.col("version")).alias("name"),
    )
    none, total = F.lit(None).cast("string"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = members.agg(total("size").alias("size"), total("packed_size").alias("packed_size"), F.count(F.lit(1)).cast("string").alias("name"))
    last = sums.select(F.lit(None).cast("long").alias("ord"), none.alias("attributes"), "size", "packed_size", cells.ratio(F.col("packed_size"), F.col("size")).alias("ratio"), none.alias("time"), none.alias("checksum"), "name")
    return rows.unionByName(last)


def bare(members: DataFrame) -> DataFrame:
    """Names alone."""
    return members.select("ord", paths.display_name(F.col("name"), F.col("version")).alias("name"))


def with_streams(members: DataFrame, streams: DataFrame) -> DataFrame:
    """Members, each followed by its streams; one without streams has a single row."""
    of = streams.select(F.col("owner").alias("_owner"), "stream", "stream_size")
    return members.join(of, F.col("ord") == F.col("_owner"), "left").select("ord", "name", "stream", "stream_size")


def totals(members: DataFrame) -> DataFrame:
    """Detail sums per source and language, per source, and overall, in one pass."""
    return members.rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("size"), F.sum("packed_size").cast("long").alias("packed_size"))


def technical(members: DataFrame) -> DataFrame:
    """A labelled row for each field of each member."""
    fields = {"Name": F.col("name"), "Type": F.lit("File"), "Size": F.col("size").cast("string"), "Packed size": F.col("packed_size").cast("string"), "Compression": cells.compression_cell(F.col("method"), F.col("method")), "MD5": F.col("md5")}
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])
    return members.select("ord", F.explode(pairs).alias("p")).select("ord", "p.field", "p.value")


def volume_listing(chunks: DataFrame) -> DataFrame:
    """For each volume and fragment: its bytes and the arrow of its place in the member."""
    starts, ends = F.col("lo") == F.col("first"), F.col("hi") == F.col("first") + F.col("packed_size")
    arrow = F.when(starts & ends, "").when(starts, "-->").when(ends, "<--").otherwise("<->")
    return chunks.select("volume", "ord", "name", (F.col("hi") - F.col("lo")).alias("bytes"), arrow.alias("arrow"))


def volume_totals(chunks: DataFrame) -> DataFrame:
    """Members count, and their sizes, where they start; packed bytes count everywhere."""
    starts = F.col("lo") == F.col("first")
    size = F.coalesce(F.sum(F.when(starts, F.col("size"))), F.lit(0)).cast("long")
    return chunks.groupBy("volume").agg(F.count_if(starts).alias("files"), size.alias("size"), F.count(F.lit(1)).alias("fragments"), F.sum(F.col("hi") - F.col("lo")).cast("long").alias("bytes"))


def find_text(members: DataFrame, needle: str, case: bool = False) -> DataFrame:
    """Members with the text, ASCII case ignored unless ``case``, and their lines that have it."""
    fold = (lambda c: c) if case else paths.ascii_lower
    wanted = needle if case else needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hit = members.where(fold(F.col("text")).contains(wanted))
    lines = hit.select("ord", "name", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(fold(F.col("line")).contains(wanted)).select("ord", "name", F.col("line_no").cast("long").alias("line_no"), "line")


def find_hex(members: DataFrame, hex_bytes: str) -> DataFrame:
    """Members whose bytes have the given ones; ASCII case is ignored here too."""
    wanted = F.lit(bytes.fromhex(hex_bytes).lower())
    return members.where(F.contains(paths.ascii_lower(F.col("text")).cast("binary"), wanted)).select("ord", "name")
