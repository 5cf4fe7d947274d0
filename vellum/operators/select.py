"""Which members and files an operation takes: sizes, times, versions, directories, destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import parse, paths
from vellum.operators.diff import auto_rename

NANO = 1_000_000_000


def by_size(files: DataFrame, less: int | None = None, more: int | None = None) -> DataFrame:
    """Files under ``less`` and over ``more`` bytes; directories pass."""
    fits = F.lit(True)
    if less is not None:
        fits = fits & (F.col("size") < less)
    if more is not None:
        fits = fits & (F.col("size") > more)
    return files.where(F.col("is_dir") | fits)


def time_bound(at: Column, kind: str, value: int, now_ns: int = 0) -> Column:
    """A time in nanoseconds against a bound.

    ``after``: from the given second on; ``before``: until it; ``newer`` and
    ``older``: within, or longer ago than, the given seconds.
    """
    since = max(0, now_ns - value * NANO)
    return {"after": at >= value * NANO, "before": at < value * NANO, "newer": at >= since, "older": at < since}[kind]


def by_time(files: DataFrame, switches: list[tuple[str, str]], now_ns: int) -> DataFrame:
    """Files that pass the switches ``(kind, text)``, such as ``("newer", "mc30d")``; directories pass.

    There is one bound for each kind of time, the last that names it.  Plain
    bounds must all hold; of those marked ``o`` one must.  Times are the columns
    ``mtime_ns``, ``ctime_ns`` and ``atime_ns``; an unknown one is 0.
    """
    order = ("after", "before", "newer", "older")
    slots: dict[str, tuple[bool, Column]] = {}
    for kind, text in sorted(switches, key=lambda s: order.index(s[0])):
        times, either, rest = parse.time_filter(text)
        value = parse.date(rest) if kind in ("after", "before") else parse.period(rest)
        for t in times:
            slots[t] = either, time_bound(F.coalesce(F.col(f"{t}time_ns"), F.lit(0)), kind, value, now_ns)
    plain, group = F.lit(True), [c for either, c in slots.values() if either]
    for either, c in slots.values():
        plain = plain if either else plain & c
    some = F.lit(not group)
    for c in group:
        some = some | c
    return files.where(F.col("is_dir") | (plain & some))


def without_directories(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_dir"))


def without_empty_directories(files: DataFrame) -> DataFrame:
    """Directories below which there is no file go: a semi join with the directories above all files."""
    parts = F.split("name", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    full = files.where(~F.col("is_dir") & F.col("name").contains("/")).select(F.explode(above).alias("_full")).distinct()
    kept = files.where("is_dir").join(full, F.col("name") == F.col("_full"), "left_semi")
    return files.where(~F.col("is_dir")).unionByName(kept)


def by_version(members: DataFrame, version: int | str = "current") -> DataFrame:
    """The current members, ``all``, or those of one version; without a record a member is current."""
    own = F.coalesce("version", F.lit(0))
    return members if version == "all" else members.where(own == (0 if version == "current" else version))


def split_version(name: str) -> tuple[str, int | None]:
    """``name;N`` as name and version."""
    base, mark, version = name.rpartition(";")
    return (base, int(version)) if mark and version.isascii() and version.isdigit() else (name, None)


def by_masks(files: DataFrame, include: list[str], exclude: list[str], flat: bool = False) -> DataFrame:
    """Files and directories that are stored: nothing below an excluded directory, directories only without include masks."""
    name = F.col("name")
    kept = F.when(F.col("is_dir"), paths.directory_kept(name, include, exclude, flat)).otherwise(paths.file_kept(name, include, exclude))
    return files.where(kept & ~paths.below_excluded(name, exclude))


def destinations(members: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """What an extraction does with each member: ``ord, name, action, target``.

    ``existing``: name, mtime_ns.  Policies: ``overwrite``; ``skip`` what exists;
    ``freshen`` only what exists and is older; ``update`` that, and what is
    missing; ``rename`` to a free name.  A time that isn't known is never newer.
    """
    there = existing.select(F.col("name").alias("_name"), F.col("mtime_ns").alias("_mtime"))
    both = members.join(there, F.col("name") == F.col("_name"), "left")
    exists, newer = F.col("_name").isNotNull(), F.coalesce(F.col("mtime_ns") > F.col("_mtime"), F.lit(False))
    skip = {
        "overwrite": F.lit(False), "rename": F.lit(False), "skip": exists,
        "freshen": ~F.col("is_dir") & ~(exists & newer), "update": ~F.col("is_dir") & exists & ~newer,
    }[policy]
    out = both.select("ord", "name", "is_dir", F.when(skip, "skip").when(F.col("is_dir"), "directory").otherwise("extract").alias("action"))
    if policy != "rename":
        return out.select("ord", "name", "action", F.when(F.col("action") != "skip", F.col("name")).alias("target"))
    free = auto_rename(out.where("action = 'extract'"), existing).select(F.col("ord").alias("_ord"), "free_name")
    return out.join(free, F.col("ord") == F.col("_ord"), "left").select("ord", "name", "action", F.coalesce("free_name", "name").alias("target"))


# Exit codes of the states of a member; others are 2.
EXIT_CODES = {"ok": 0, "checksum": 3, "damaged": 3, "password": 11, "write": 5, "memory": 8}


def exit_code(state: Column) -> Column:
    out = F.lit(2)
    for name, code in EXIT_CODES.items():
        out = F.when(state == name, code).otherwise(out)
    return out


def verification_report(members: DataFrame) -> DataFrame:
    """Of ``ord, name, state``: how many were checked, passed and failed, and the first failure with its exit code."""
    bad = F.col("state") != "ok"
    first = F.min(F.when(bad, F.struct("ord", "name", exit_code(F.col("state")).alias("code"))))
    out = members.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), first.alias("first"))
    return out.select("checked", "passed", "failed", F.col("first.ord").alias("first_failure"), F.col("first.name").alias("first_name"), F.coalesce("first.code", F.lit(0)).cast("int").alias("exit_code"))


def extraction_report(outcomes: DataFrame) -> DataFrame:
    """Of ``ord, name, size, outcome`` (written, skipped, refused, corrected, failed): count, bytes and first of each."""
    found = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("members"), F.sum("size").cast("long").alias("bytes"), F.min(F.struct("ord", "name")).alias("first"))
    return found.select("outcome", "members", "bytes", F.col("first.ord").alias("first_ord"), F.col("first.name").alias("first_name"))


def checked_total(members: DataFrame, most: int = (1 << 63) - 1) -> DataFrame:
    """The sum of all sizes, and whether a number of that range holds it; summed as a decimal, so nothing wraps."""
    total = members.agg(F.coalesce(F.sum(F.col("size").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("total"))
    return total.select(F.when(F.col("total") <= most, F.col("total").cast("long")).alias("size"), F.when(F.col("total") <= most, "ok").otherwise("overflow").alias("state"))
