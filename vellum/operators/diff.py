"""Two-relation operations on catalogs: update, freshen, sync, dedup, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_name(members: DataFrame) -> DataFrame:
    """Of members of one name the first in archive order: the only one that is compared."""
    return members.groupBy("name").agg(F.min_by("mtime_s", "ord").alias("member_mtime"), F.min("ord").alias("member_ord"))


def update(members: DataFrame, sources: DataFrame, add_missing: bool = True) -> DataFrame:
    """``add`` what is missing, ``replace`` what is older than its source; the rest is left alone."""
    joined = sources.join(first_of_name(members), "name", "left")
    action = F.when(F.col("member_ord").isNull(), "add").when(F.col("mtime_s") > F.col("member_mtime"), "replace")
    out = joined.withColumn("action", action).where(F.col("action").isNotNull())
    out = out if add_missing else out.where("action = 'replace'")
    return out.select("name", "size", "mtime_s", "action")


def stale(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Members whose name isn't among the sources; a sync deletes them."""
    return members.join(sources.select("name"), "name", "left_anti").select("ord", "name")


def merge(members: DataFrame, sources: DataFrame) -> DataFrame:
    """The catalog after adding all sources: those of an equal name are replaced in their place."""
    kept = members.join(sources.select("name"), "name", "left_anti").select("name", "size", "mtime_s", F.lit("kept").alias("origin"))
    return kept.unionByName(sources.select("name", "size", "mtime_s", F.lit("source").alias("origin")))


def replace_in_place(members: DataFrame, sources: DataFrame) -> DataFrame:
    """The catalog with the first member of each source's name replaced where it stands; its repeats go."""
    first = first_of_name(members).select(F.col("name").alias("_name"), "member_ord")
    new = sources.select(F.col("name").alias("_src"), F.col("size").alias("_size"), F.col("mtime_s").alias("_mtime"))
    both = members.join(first, F.col("name") == F.col("_name")).join(new, F.col("name") == F.col("_src"), "left")
    kept = both.where(F.col("_src").isNull() | (F.col("ord") == F.col("member_ord")))
    return kept.select("ord", "name", F.coalesce("_size", "size").alias("size"), F.coalesce("_mtime", "mtime_s").alias("mtime_s"), F.when(F.col("_src").isNull(), "kept").otherwise("replaced").alias("origin"))


def hard_links(files: DataFrame) -> DataFrame:
    """Files of one identity (``device, inode``): the first is stored, the others are redirects to it."""
    first = files.where("inode is not null").groupBy("device", "inode").agg(F.min(F.struct("ord", "name")).alias("first"))
    first = first.select(F.col("device").alias("_device"), F.col("inode").alias("_inode"), "first")
    same = (F.col("device") == F.col("_device")) & (F.col("inode") == F.col("_inode"))
    target = F.when(F.col("ord") != F.col("first.ord"), F.col("first.name"))
    return files.join(first, same, "left").select("ord", "name", "size", target.alias("target"))


def lookup(members: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted name the number of its members, the first of them, and whether it is the only one."""
    found = members.groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.min("ord").alias("first_ord"))
    n = F.coalesce("matches", F.lit(0))
    return names.join(found, "name", "left").select("name", n.alias("matches"), "first_ord", F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous").alias("state"))


def unique(members: DataFrame, name: str) -> int:
    """The place of the only member of a name; no member, or several, are errors."""
    r = members.where(F.col("name") == name).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).first()
    if r["n"] != 1:
        raise LookupError(f"no member {name!r}" if not r["n"] else f"{r['n']} members {name!r}")
    return r["ord"]


def first_of_path(inputs: DataFrame) -> DataFrame:
    """Inputs that name one source path count once, as the first."""
    rest = F.struct(*[F.col(c) for c in inputs.columns])
    return inputs.groupBy(F.col("path").alias("_path")).agg(F.min_by(rest, "ord").alias("r")).select("r.*")


def identical(members: DataFrame, content: str = "text", least: int = 0) -> DataFrame:
    """Each member with the first of equal content; ``redirect`` is true for the others.

    Contents meet by size and a strong hash, so no bytes are shuffled.  The group's
    first comes from an aggregate that is joined back: a group of any size is
    summed before it is shuffled.
    """
    keyed = members.where(F.col("size") >= least).select("ord", "name", "size", F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    first = keyed.groupBy("size", "digest").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(first, ["size", "digest"]).select("ord", "name", "size", "first_ord", "copies", (F.col("ord") != F.col("first_ord")).alias("redirect"))


def dedup_summary(members: DataFrame, content: str = "text") -> DataFrame:
    groups = members.groupBy("size", F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).cast("long").alias("redirects"), F.sum((F.col("n") - 1) * F.col("size")).cast("long").alias("saved_bytes"))


def _nth(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(order)))


def unmatched_deletes(members: DataFrame, names: DataFrame) -> DataFrame:
    """The lines of a delete plan that no member is left for."""
    return _nth(names, "line").join(_nth(members, "ord").select("name", "k"), ["name", "k"], "left_anti").select("line", "name")


def delete_nth(members: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """The catalog without the named members; the k-th repeat of a name takes its k-th duplicate.

    A name without a member fails the plan before anything is deleted, unless it isn't ``strict``.
    """
    if strict and (missing := unmatched_deletes(members, names).orderBy("line").first()):
        raise LookupError(f"no member to delete: {missing['name']!r}")
    return _nth(members, "ord").join(_nth(names, "line").select("name", "k"), ["name", "k"], "left_anti").drop("k")


def rename(members: DataFrame, plan: list[tuple[str, str]]) -> DataFrame:
    """New names by a plan of (old, new): exact names first, then the longest directory above.

    The plan is a small table: a member meets it by its own name and by those of the directories above.
    """
    spark = members.sparkSession
    table = F.broadcast(spark.createDataFrame([(old, new) for old, new in dict(plan).items()], "_old string, _new string"))
    parts = F.split("name", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = members.select("ord", "name", F.explode(above).alias("_at")).join(table, F.col("_at") == F.col("_old"))
    best = hits.groupBy("ord").agg(F.max_by(F.struct("_old", "_new"), F.length("_old")).alias("_b")).select(F.col("ord").alias("_ord"), "_b")
    moved = F.concat(F.col("_b._new"), F.substring(F.col("name"), F.length("_b._old") + 1, F.lit(1 << 30)))
    return members.join(best, F.col("ord") == F.col("_ord"), "left").withColumn("new_name", F.coalesce(moved, "name")).drop("_ord", "_b")


def resolve_chain(plan: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A plan whose steps see the names that earlier steps gave; it is tiny, so it is folded on the driver."""
    done: dict[str, str] = {}
    for old, new in plan:
        source = next((k for k, v in done.items() if v == old), old)
        done[source] = new
    return list(done.items())


def change_case(members: DataFrame, upper: bool = False) -> DataFrame:
    folded = F.upper("name") if upper else F.lower("name")
    return members.select("ord", "name", folded.alias("new_name")).where("name <> new_name")


def shift_versions(members: DataFrame, keep: int) -> DataFrame:
    """Every version goes up by one; those beyond ``keep`` go."""
    return members.select("ord", "name", (F.coalesce("version", F.lit(0)) + 1).alias("version")).where(F.col("version") <= keep)


def validate_edits(edits: DataFrame) -> DataFrame:
    """Members with edits that can't go together, such as a rename and a deletion."""
    kinds = edits.groupBy("ord").agg(F.collect_set("kind").alias("kinds"))
    return kinds.where((F.size("kinds") > 1) & F.array_contains("kinds", "delete")).select("ord", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


def apply_edits(members: DataFrame, edits: DataFrame) -> DataFrame:
    """The catalog after a plan of ``ord, kind, value``: deletions, new names and new comments.

    Edits that can't go together, and two comments of the archive (``ord`` null), are refused before any is applied.
    """
    clash = validate_edits(edits.where("ord is not null")).select("ord", "kinds").orderBy("ord").first()
    if clash:
        raise ValueError(f"edits of member {clash['ord']} can't go together: {clash['kinds']}")
    if edits.where("ord is null and kind = 'comment'").limit(2).count() > 1:
        raise ValueError("the archive can have one comment")
    one = edits.where("ord is not null").groupBy(F.col("ord").alias("_ord")).agg(
        F.bool_or(F.col("kind") == "delete").alias("_gone"), F.max(F.when(F.col("kind") == "rename", F.col("value"))).alias("_name"), F.max(F.when(F.col("kind") == "comment", F.col("value"))).alias("_comment")
    )
    left = members.join(one, F.col("ord") == F.col("_ord"), "left").where(~F.coalesce("_gone", F.lit(False)))
    return left.withColumn("name", F.coalesce("_name", "name")).withColumn("comment", F.col("_comment")).drop("_ord", "_gone", "_name", "_comment")


def auto_rename(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Free names: a taken one becomes ``name(n).ext`` with the next ``n`` whose name is neither taken nor wanted.

    The first wanted of a free name keeps it.  The k-th collision of a name gets its
    k-th number that isn't in use: ``k`` plus the numbers in use below that.
    """
    # A dot that the last part begins with starts no extension.
    stem, ext = (F.regexp_extract("name", r"(?s)^(.*?)((?<=[^/])\.[^./]*)?$", k) for k in (1, 2))
    named = lambda n: F.concat(stem, F.lit("("), n.cast("string"), F.lit(")"), ext)
    dup = wanted.select("ord", "name").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("ord")) - 1)
    dup = dup.join(taken.select("name").distinct().withColumn("is_taken", F.lit(1)), "name", "left").withColumn("k", (F.col("k") + F.coalesce("is_taken", F.lit(0))).cast("long"))
    # Numbers in use, with the name that would be given them.
    numbered = r"(?s)^(.*)\(([1-9][0-9]{0,17})\)((?<=[^/])\.[^./]*)?$"
    part = lambda k: F.regexp_extract("whole", numbered, k)
    used = taken.select("name").unionByName(wanted.select("name")).distinct().withColumnRenamed("name", "whole").where(F.col("whole").rlike(numbered))
    used = used.select("whole", F.concat(part(1), part(3)).alias("name"), part(2).cast("long").alias("n")).where(named(F.col("n")) == F.col("whole"))
    # The j-th number in use, from 0, is passed by the collisions from n - j on.
    used = used.select("name", (F.col("n") - F.row_number().over(Window.partitionBy("name").orderBy("n")) + 1).alias("k"), F.lit(1).alias("in_use"))
    both = dup.select("ord", "name", "k", F.lit(0).alias("in_use")).unionByName(used, allowMissingColumns=True)
    before = Window.partitionBy("name").orderBy("k", F.desc("in_use")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = both.withColumn("n", F.col("k") + F.sum("in_use").over(before)).where("in_use = 0")
    return given.select("ord", "name", F.when(F.col("k") == 0, F.col("name")).otherwise(named(F.col("n"))).alias("free_name"))
