"""Orders and groups of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import paths
from vellum.operators.ranges import running_total


def solid_key() -> list[Column]:
    """Extension, base, size, full name, each lower-cased by Unicode rules."""
    name = F.col("name")
    ext = F.lower(paths.extension(name))
    return [ext, F.lower(paths.basename(name)), F.col("size"), F.lower(name), F.col("ord")]


def solid_order(members: DataFrame) -> DataFrame:
    """Members in the order of solid compression, as a rank.

    Ranks come from ranges of the order, not from one sorted partition.
    """
    keyed = members.select("ord", "name", "size", *[k.alias(f"_k{i}") for i, k in enumerate(solid_key())])
    ranked = running_total(keyed, [f"_k{i}" for i in range(5)], F.lit(1), "before")
    return ranked.select("ord", "name", (F.col("before") + 1).alias("position"))


def solid_groups(members: DataFrame) -> DataFrame:
    """Size and extent of each solid group, a new one at each extension."""
    return members.groupBy(F.lower(paths.extension(F.col("name"))).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("size"), F.min("ord").alias("first_ord"))


def deepest_first(directories: DataFrame) -> DataFrame:
    """Directories after their contents: by descending depth, ties in given order."""
    return directories.withColumn("depth", paths.depth(F.col("name")).cast("long")).orderBy(F.desc("depth"), "name")


def files_then_directories(entries: DataFrame) -> DataFrame:
    """Files in their order, then directories, the deepest first and those of one depth in their order; as a rank."""
    down = F.when(F.col("is_dir"), -paths.depth(F.rtrim("name", F.lit("/")))).otherwise(0).cast("long")
    keyed = entries.select("ord", "name", F.col("is_dir").cast("int").alias("_dir"), down.alias("_down"))
    ranked = running_total(keyed, ["_dir", "_down", "ord"], F.lit(1), "before")
    return ranked.select("ord", "name", (F.col("before") + 1).alias("position"))


def listed_order(members: DataFrame, masks: list[str]) -> DataFrame:
    """Members by their place in an order list, those of one place in the order of solid compression; as a rank."""
    placed = mask_order(members, masks).select(F.col("ord").alias("_ord"), "place")
    keyed = members.join(placed, F.col("ord") == F.col("_ord")).select("ord", "name", "place", *[k.alias(f"_k{i}") for i, k in enumerate(solid_key())])
    ranked = running_total(keyed, ["place", *[f"_k{i}" for i in range(5)]], F.lit(1), "before")
    return ranked.select("ord", "name", (F.col("before") + 1).alias("position"))


def mask_order(members: DataFrame, masks: list[str]) -> DataFrame:
    """The place of each member in an order list of masks on the basename.

    A mask whose matches are among another's wins over it, else the earlier one;
    ``$default`` is the place of what no mask matches, the end without it.
    """
    real = [(k, m) for k, m in enumerate(masks) if m != "$default"]
    base = paths.basename(F.col("name"))
    hits = members.select("ord", "name", F.array_compact(F.array(*[F.when(paths.mask_match(base, m), F.lit(k)) for k, m in real])).alias("hits"))
    if not real:
        return hits.select("ord", "name", F.lit(0).cast("long").alias("place"))
    # How many members match each mask, and each pair of masks: a subset has as many as the pair.
    pairs = [(a, b) for a, _ in real for b, _ in real if a != b]
    counted = hits.agg(*[F.count_if(F.array_contains("hits", k)).alias(f"n{k}") for k, _ in real], *[F.count_if(F.array_contains("hits", a) & F.array_contains("hits", b)).alias(f"n{a}_{b}") for a, b in pairs]).first()
    inside = {(a, b) for a, b in pairs if counted[f"n{a}"] and counted[f"n{a}_{b}"] == counted[f"n{a}"] < counted[f"n{b}"]}
    # A mask is beaten in a row if a mask inside it matches too.
    beaten = lambda k: F.arrays_overlap("hits", F.array(*[F.lit(a) for a, b in inside if b == k])) if any(b == k for _, b in inside) else F.lit(False)
    best = F.least(*[F.when(F.array_contains("hits", k) & ~beaten(k), F.lit(k)) for k, _ in real], F.lit(None).cast("int"))
    default = masks.index("$default") if "$default" in masks else len(masks)
    return hits.select("ord", "name", F.coalesce(best, F.lit(default)).cast("long").alias("place"))


def budget_prefix(members: DataFrame, budget: int) -> DataFrame:
    """How many of the largest members fit a budget, taken from the largest on.

    Only sizes are summed by value; members of one size are one row.
    """
    sizes = members.groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("size"))
    total = F.col("n") * F.col("size")
    placed = running_total(sizes.withColumn("bytes", total), "down", "bytes", "before")
    room = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    fit = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(room / F.greatest(F.col("size"), F.lit(1)))))
    stops = placed.withColumn("fit", fit.cast("long"))
    first_short = stops.where("fit < n").agg(F.max("size").alias("stop"))
    return stops.crossJoin(F.broadcast(first_short)).where(F.col("stop").isNull() | (F.col("size") >= F.col("stop"))).agg(F.coalesce(F.sum("fit"), F.lit(0)).cast("long").alias("members"))


def extraction_limits(members: DataFrame, most: int, most_total: int) -> DataFrame:
    """What an extraction with ceilings says of each member, taken in archive order."""
    upto = running_total(members.select("ord", "name", "size"), "ord", "size", "before")
    state = F.when(F.col("size") > most, "member too large").when(F.col("before") + F.col("size") > most_total, "total too large").otherwise("ok")
    return upto.select("ord", "name", "size", state.alias("state"))
