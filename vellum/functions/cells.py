"""Cells of listings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of methods 0 to 5, and of the five kinds of links.
METHODS = ("Store", "Fastest", "Fast", "Normal", "Good", "Best")
LINKS = ("Unix symbolic link", "Windows symbolic link", "NTFS junction point", "Hard link", "File reference")


def _bit(c: Column, mask: int) -> Column:
    return c.cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0


def ratio(packed: Column, size: Column) -> Column:
    """Whole percent, cut, in integer arithmetic; 0 for an empty member."""
    whole = F.when(size == 0, 1).otherwise(size)
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(((packed * 100 - (packed * 100) % whole) / whole).cast("long"))


def byte_count(size: Column) -> Column:
    """The largest unit that divides the size, 0 too; plain bytes otherwise."""
    out = size.cast("string")
    for power, unit in ((10, "k"), (20, "m"), (30, "g")):
        out = F.when(size % (1 << power) == 0, F.concat((size / (1 << power)).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def method_name(method: Column) -> Column:
    out = F.lit("Unknown")
    for k, label in enumerate(METHODS):
        out = F.when(method == k, label).otherwise(out)
    return out


# The letters of the file types in the mode's upper bits.
MODE_TYPES = ((0o040000, "d"), (0o120000, "l"), (0o010000, "p"), (0o020000, "c"), (0o060000, "b"))


def unix_mode(attributes: Column) -> Column:
    """``ls`` style: type, three triplets, set-id and sticky bits; without a type the mode is in the high word."""
    whole = attributes.cast("long")
    typed = whole.bitwiseAND(F.lit(0o170000).cast("long")) != 0
    mode = F.when(typed, whole).otherwise(F.shiftright(whole, 16))
    kind, letter = mode.bitwiseAND(F.lit(0o170000).cast("long")), F.lit("-")
    for bits, shown in MODE_TYPES:
        letter = F.when(kind == bits, shown).otherwise(letter)
    out = [letter]
    for shift, special, on in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        out += [F.when(_bit(mode, 4 << shift), "r").otherwise("-"), F.when(_bit(mode, 2 << shift), "w").otherwise("-")]
        x = _bit(mode, 1 << shift)
        out.append(F.when(_bit(mode, special), F.when(x, on).otherwise(on.upper())).otherwise(F.when(x, "x").otherwise("-")))
    return F.concat(*out)


# The attribute bits and letters in their order; the second place is never used.
DOS_BITS = ((0x2000, "I"), (0, "."), (0x20, "A"), (0x10, "D"), (4, "S"), (2, "H"), (1, "R"))


def dos_attributes(bits: Column) -> Column:
    return F.concat(*[F.when(_bit(bits, b), letter).otherwise(".") for b, letter in DOS_BITS])


# Hosts of the middle formats by their code, others are Mac; of unpackers' numbers the formats.
HOSTS = ("DOS", "OS/2", "Windows", "Unix")
UNPACKERS = {2: "v14", 15: "v15", 20: "v20", 26: "v26", 29: "v29", 36: "v36"}
# The formats' numbers: 3 is the oldest, 4 the middle ones, 5 the newest.
OLDEST, MIDDLE, NEWEST = 3, 4, 5


def host_name(format_version: Column, host: Column) -> Column:
    """The host's label; null in the oldest format, which has none."""
    middle = F.lit("Mac")
    for code, label in enumerate(HOSTS):
        middle = F.when(host == code, label).otherwise(middle)
    return F.when(format_version == OLDEST, F.lit(None).cast("string")).when(format_version == MIDDLE, middle).otherwise(F.when(host == 1, "Unix").otherwise("Windows"))


def host_code(format_version: Column, host: Column) -> Column:
    """0 for Windows and its kin, 1 for Unix and its kin, whatever the format."""
    return F.when(format_version.isin(OLDEST, MIDDLE), F.when(host.isin(0, 2), 0).otherwise(1)).otherwise(host).cast("long")


def version_label(format_version: Column, unpacker: Column, extended: Column) -> Column:
    """The format of a member, ``v14`` to ``v70``; an unknown unpacker counts as ``v29``."""
    middle = F.lit("v29")
    for number, label in UNPACKERS.items():
        middle = F.when(unpacker == number, label).otherwise(middle)
    return F.when(format_version == OLDEST, "v14").when(format_version == MIDDLE, middle).otherwise(F.when(extended, "v70").otherwise("v50"))


def attributes_cell(format_version: Column, host: Column, attributes: Column) -> Column:
    unix = F.when(format_version == OLDEST, False).when(format_version == MIDDLE, host.isin(3, 4)).otherwise(host == 1)
    return F.when(unix, unix_mode(attributes)).otherwise(dos_attributes(attributes))


def dictionary_bytes(log: Column, base_kib: int = 128) -> Column:
    return F.lit(base_kib * 1024).cast("long") * F.pow(F.lit(2.0), log).cast("long")


def dictionary_cell(format_version: Column, is_dir: Column, log: Column, explicit: Column) -> Column:
    """The dictionary's size by the rule of the format; null for directories."""
    middle = F.when(log <= 6, byte_count(dictionary_bytes(log, 64)))
    size = F.when(format_version == OLDEST, "64k").when(format_version == MIDDLE, middle).otherwise(byte_count(F.coalesce(explicit, dictionary_bytes(log))))
    return F.when(~is_dir, size)


def compression_label(format_version: Column, version: Column, method: Column, dictionary: Column, explicit: Column) -> Column:
    """Family, format, method and dictionary of a member."""
    large = (version == "v70") & (F.coalesce(explicit, F.lit(0)) > 4 << 30)
    family = F.when(format_version == OLDEST, "RAR 5.0(v13)").when(format_version == MIDDLE, F.concat(F.lit("RAR 1.5("), version, F.lit(")"))).when(large, "RAR 7.0(v70)").otherwise("RAR 5.0(v50)")
    return F.concat(family, F.lit(" -m"), method.cast("string"), F.coalesce(F.concat(F.lit(" -md="), dictionary), F.lit("")))


def details_label(format_version: Column, version: Column, explicit: Column, solid: Column, volumes: Column, volume: Column) -> Column:
    """What a container is, by its first member: family, whether solid, which volume."""
    large = (version == "v70") & (F.coalesce(explicit, F.lit(0)) > 4 << 30)
    family = F.when(format_version == OLDEST, "RAR 1.4").when(format_version == MIDDLE, "RAR 1.5").when(large, "RAR 7").otherwise("RAR 5")
    part = F.when(volumes <= 1, "").when(F.coalesce(format_version == NEWEST, F.lit(True)), F.concat(F.lit(", volume "), (volume + 1).cast("string"))).otherwise(", volume")
    return F.concat(family, F.when(solid, ", solid").otherwise(""), part)


def compression_cell(method: Column, log: Column) -> Column:
    """That of a member of the newest format."""
    return compression_label(F.lit(NEWEST), F.lit("v50"), method, byte_count(dictionary_bytes(log)), F.lit(None).cast("long"))


def member_type(link: Column, is_dir: Column) -> Column:
    out = F.when(is_dir, "Directory").otherwise("File")
    for k, label in enumerate(LINKS, 1):
        out = F.when(link == k, label).otherwise(out)
    return out


def time_cell(seconds: Column) -> Column:
    text = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    return F.coalesce(text, F.lit("????-??-?? ??:??"))


def dos_time(t: Column) -> Column:
    """A time from 1980 to 2107 in 32 bits, to two seconds; null outside those years."""
    part = lambda v, bits: F.shiftleft(v.cast("long"), bits)
    packed = (
        part(F.year(t) - 1980, 25) + part(F.month(t), 21) + part(F.dayofmonth(t), 16)
        + part(F.hour(t), 11) + part(F.minute(t), 5) + F.floor(F.second(t) / 2).cast("long")
    )
    return F.when(F.year(t).between(1980, 2107), packed)


def from_dos_time(n: Column) -> Column:
    """The time without zone of a packed one; null where it is no date."""
    part = lambda bits, width: F.shiftright(n, bits).bitwiseAND((1 << width) - 1)
    cell = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(25, 7) + 1980, part(21, 4), part(16, 5), part(11, 5), part(5, 6), part(0, 5) * 2)
    return F.try_to_timestamp(cell, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def civil(seconds: Column, offset: int = 0) -> Column:
    """Year, month, day, hour, minute and second of an epoch time at an offset of seconds from UTC; no zone counts."""
    days = F.floor((seconds + offset) / 86400).cast("int")
    rest = (seconds + offset) - days.cast("long") * 86400
    day = F.date_from_unix_date(days)
    fields = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "hour": F.floor(rest / 3600), "minute": F.floor(rest % 3600 / 60), "second": rest % 60}
    return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])


def from_civil(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, offset: int = 0) -> Column:
    """Epoch seconds of civil fields at an offset; days beyond the month's end run on into the next."""
    first = F.unix_date(F.make_date(year, month, F.lit(1))).cast("long")
    return (first + day - 1) * 86400 + hour * 3600 + minute * 60 + second - offset


# The least dictionary, the one that is taken without a request, the largest by its logarithm, and where explicit sizes begin.
LEAST_DICTIONARY, USUAL_DICTIONARY, MOST_LOG, EXPLICIT_FROM = 128 << 10, 32 << 20, 15, 4 << 30


def dictionary_fields(size: Column, log: Column, requested: Column, always: bool = False) -> Column:
    """``log, explicit`` of a member of ``size`` bytes: no dictionary is larger than twice the largest power of two in the size.

    ``log`` is a requested logarithm, ``requested`` a requested number of bytes; either may be null.  An
    explicit size is kept only beyond 4 GiB, or ``always``.
    """
    bits = F.length(F.bin(F.greatest(size, F.lit(1))))  # the power of two is 1 << bits - 1
    cap = F.greatest(F.when(bits < 62, F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long")).otherwise(F.lit((1 << 63) - 1)), F.lit(LEAST_DICTIONARY))
    fit = lambda target: F.least(F.greatest(F.ceil(F.log2(target / LEAST_DICTIONARY)), F.lit(0)), F.lit(MOST_LOG)).cast("int")
    by_log = fit(F.least(cap, F.coalesce(dictionary_bytes(log), F.lit(USUAL_DICTIONARY))))
    capped = F.least(requested, cap)
    declared = F.greatest(capped, F.lit(LEAST_DICTIONARY))
    window = F.least(by_log, F.floor(F.log2(declared / LEAST_DICTIONARY)).cast("int"))
    explicit = F.lit(always) | (capped > EXPLICIT_FROM)
    return F.struct(
        F.when(requested.isNull(), by_log).when(explicit, window).otherwise(fit(capped)).alias("log"),
        F.when(requested.isNotNull() & explicit, declared).alias("explicit"),
    )
