"""Names, masks and paths as column expressions.

Three mask dialects exist and are kept apart: ``mask_match`` (case-sensitive,
``*`` crosses slashes), ``store_match`` (basename, ASCII-insensitive, or a bare
extension that is case-sensitive) and ``order_mask_match`` (basename only).
Searches fold ASCII letters, names fold Unicode letters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def mask_regex(mask: str) -> str:
    """``*`` is any run, slashes included, ``?`` one character, the rest literal."""
    part = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(part.get(ch) or re.sub(r"([^\w])", r"\\\1", ch) for ch in mask) + "$"


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """After the last dot of the basename; empty without one."""
    return F.regexp_extract(basename(c), r"(?s)\.([^.]*)$", 1)


def depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def mask_match(c: Column, mask: str) -> Column:
    return c.rlike(mask_regex(mask))


def has_mask(text: str) -> bool:
    return "*" in text or "?" in text


def selector(c: Column, wanted: str) -> Column:
    """An exact path, a directory's subtree, or a mask on the path or, without a slash, on the basename."""
    wanted = wanted.replace("\\", "/").rstrip("/")
    name = slashes(c)
    if not has_mask(wanted):
        return (name == wanted) | name.startswith(wanted + "/")
    hit = mask_match(name, wanted)
    return hit if "/" in wanted else hit | mask_match(basename(name), wanted)


def any_selector(c: Column, wanted: list[str]) -> Column:
    """Of any of the selectors; an empty list selects all."""
    out = F.lit(not wanted)
    for w in wanted:
        out = out | selector(c, w)
    return out


def include_exclude(c: Column, include: list[str], exclude: list[str]) -> Column:
    kept = any_selector(c, include)
    return kept & ~any_selector(c, exclude) if exclude else kept


def store_match(c: Column, patterns: list[str]) -> Column:
    """Members that are stored: by extension, or by a mask on the basename that ignores ASCII case."""
    out = F.lit(False)
    for p in patterns:
        out = out | (mask_match(ascii_lower(basename(c)), p.translate(str.maketrans(_UPPER, _LOWER))) if has_mask(p) else c.endswith("." + p.lstrip(".")))
    return out


def sanitize(c: Column) -> Column:
    """The safe relative path, or null: no NUL, no root, no ``..``; dots and empty parts go."""
    name = slashes(c)
    parts = F.split(name, "/", -1)
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    bad = name.contains("\0") | name.startswith("/") | name.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..") | (F.size(kept) == 0)
    return F.when(~bad, F.array_join(kept, "/"))


def link_stays_inside(name: Column, target: Column) -> Column:
    """Whether a link's target, walked from the link's directory, never leaves the root."""
    start = F.size(F.split(name, "/", -1)) - 1
    end = F.aggregate(
        F.split(slashes(target), "/", -1),
        start,
        lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).when(p.isin("", "."), d).otherwise(d + 1),
    )
    return ~slashes(target).startswith("/") & ~target.rlike("^[A-Za-z]:") & (end >= 0)


def stored_name(c: Column, strip_base: bool = False, flat: bool = False, drop_prefix: str = "", case: str = "", prefix: str = "") -> Column:
    """The stored name's steps in their order: first folder off, all folders off, a path prefix off, case, prefix on."""
    out = slashes(c)
    if strip_base:
        rest = F.regexp_extract(out, "(?s)^[^/]*/(.*)$", 1)
        out = F.when(rest != "", rest).otherwise(out)
    if flat:
        out = basename(out)
    if drop_prefix:
        # A name that is the prefix itself stays.
        path = drop_prefix.rstrip("/") + "/"
        out = F.when(out.startswith(path), F.substring(out, len(path) + 1, 1 << 30)).otherwise(out)
    out = {"lower": F.lower, "upper": F.upper}.get(case, lambda x: x)(out)
    return F.concat(F.lit(prefix + "/"), out) if prefix else out


def file_kept(c: Column, include: list[str], exclude: list[str]) -> Column:
    """Masks of additions: on the whole relative name or its last part."""
    hit = lambda masks: any_selector(c, masks) if masks else F.lit(False)
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def directory_kept(c: Column, include: list[str], exclude: list[str], flat: bool = False) -> Column:
    """Directories are stored only without include masks and with their paths."""
    return file_kept(c, [], exclude) if not include and not flat else F.lit(False)


def below_excluded(c: Column, exclude: list[str]) -> Column:
    """Whether a directory above, or the name itself, is excluded: nothing below one is walked."""
    parts = F.split(c, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(above, lambda p: any_selector(p, exclude)) if exclude else F.lit(False)


def display_name(name: Column, version: Column) -> Column:
    return F.when(version > 0, F.concat(name, F.lit(";"), version.cast("string"))).otherwise(name)
