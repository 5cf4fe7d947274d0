"""Runs of neighbouring rows: solid chains and groups, merged ranges, sets of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import paths
from vellum.operators.ranges import running_total


def chain_ranges(members: DataFrame, for_replace: bool = False) -> DataFrame:
    """For each member that can't go alone the first and last of the solid chain around it.

    Directories are transparent: a chain runs across them, and that of a directory
    is the next file's.  The last of a chain can go alone, but when it is replaced.
    """
    counted = running_total(members.select("ord", "is_dir", "solid"), "ord", F.when(F.col("is_dir"), 0).otherwise(1), "files")
    placed = counted.withColumn("k", F.col("files") + 1)
    files = running_total(placed.where(~F.col("is_dir")).select("ord", "solid", "k"), "ord", F.when(F.col("solid"), 0).otherwise(1), "starts")
    files = files.withColumn("chain", F.col("starts") + F.when(F.col("solid"), 0).otherwise(1))
    chains = files.groupBy("chain").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max_by("solid", "ord").alias("ends_solid"))
    rows = placed.select("ord", "k").join(files.select("k", "chain"), "k").join(chains, "chain")
    needed = F.col("ord") < F.col("last_ord")
    return rows.where(needed | F.col("ends_solid") if for_replace else needed).select("ord", "first_ord", "last_ord")


def solid_runs(members: DataFrame, reset: str = "extension") -> DataFrame:
    """``ord, run``: a new run at each change of extension, or of volume, between neighbours; one run if ``continuous``.

    The extension is what follows the name's last dot, the whole name without one.
    """
    key = {"extension": F.substring_index(F.rtrim("name", F.lit("/")), ".", -1), "volume": F.col("volume") if "volume" in members.columns else F.lit(0), "continuous": F.lit(0)}[reset]
    counted = running_total(members.select("ord", key.alias("key")), "ord", F.lit(1), "k")
    before = counted.select((F.col("k") + 1).alias("k"), F.col("key").alias("_key"))
    changed = counted.join(before, "k", "left").select("ord", F.when(F.col("_key").eqNullSafe(F.col("key")) & (F.col("k") > 0), 0).otherwise(1).alias("new"))
    return running_total(changed, "ord", "new", "before").select("ord", (F.col("before") + F.col("new")).alias("run"))


def merge_ranges(ranges: DataFrame, key: str = "key") -> DataFrame:
    """Ranges ``lo`` to ``hi`` (exclusive) of each key, those that overlap or touch as one."""
    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.withColumn("_new", F.when(F.col("lo") <= F.max("hi").over(before), 0).otherwise(1))
    run = F.sum("_new").over(Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opened.withColumn("_run", run).groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _part(path: Column, k: int) -> Column:
    return F.regexp_extract(path, r"(?is)^(.*)\.part([0-9]+)\.(rar|exe)$", k)


def volume_sets(files: DataFrame) -> DataFrame:
    """``volume_set, volume, path`` of all sets of volumes among paths, each up to its first gap.

    Names are ``base.partN.rar``, the first also ``base.part1.exe``, padded to one
    width or not, and ``base.rar, base.r00 .. base.z99``.  Letter case doesn't
    count; of two names for a place the ``.rar``, then the smaller, is taken.
    """
    digits, base = _part(F.col("path"), 2), F.lower(_part(F.col("path"), 1))
    number = F.expr("try_cast(_n as long)")
    numbered = files.select("path", base.alias("base"), digits.alias("_n"), F.lower(_part(F.col("path"), 3)).alias("kind")).where("_n <> ''")
    # A number without zeros before it is written so at every width up to its own.
    widths = F.when(F.col("_n").startswith("0"), F.array(F.length("_n"))).otherwise(F.sequence(F.lit(1), F.length("_n")))
    numbered = numbered.withColumn("width", F.explode(widths)).select("path", F.concat_ws("*", "base", F.col("width").cast("string")).alias("key"), "base", number.alias("volume"), "kind")
    numbered = numbered.where((F.col("kind") == "rar") | (F.col("volume") == 1))
    tail = F.regexp_extract(F.lower("path"), r"(?s)^(.*)\.([r-z])([0-9][0-9])$", 0) != ""
    at = (F.ascii(F.substring(F.lower("path"), -3, 1)) - ord("r")) * 100 + F.substring("path", -2, 2).cast("int") + 2
    whole = F.lower("path").endswith(".rar") & (_part(F.col("path"), 2) == "")
    old = files.where(tail | whole).select("path", F.expr("lower(left(path, length(path) - 4))").alias("base"), F.when(whole, 1).otherwise(at).cast("long").alias("volume"))
    old = old.select("path", F.col("base").alias("key"), "base", "volume", F.lit("rar").alias("kind"))
    rows = numbered.unionByName(old).groupBy("key", "base", "volume").agg(F.min(F.struct((F.col("kind") != "rar").alias("last"), "path")).alias("best"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("volume")))
    kept = placed.where("place = volume")
    # A file is of the set of more volumes: only one width has a second one.
    sized = kept.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key")))
    best = sized.groupBy("base", F.col("best.path").alias("path")).agg(F.max(F.struct("size", -F.length("key"), "key")).alias("own"))
    out = sized.select("key", "base", "volume", F.col("best.path").alias("path")).join(best.select("path", F.col("own.key").alias("key")), ["path", "key"])
    return out.select(F.col("base").alias("volume_set"), "volume", "path")
