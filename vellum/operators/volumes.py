"""Volumes: merging of fragments, plans of recovery data, parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ranges import running_total


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Fold ``ord, volume, lo, hi, is_first, is_final`` into one row per member with its error.

    Errors: ``no start``, ``no end``, ``gap`` (a volume is missing), ``overlap``.
    Counts and extremes decide, so nothing needs the fragments in order.
    """
    folded = fragments.groupBy("ord").agg(
        F.count(F.lit(1)).alias("fragments"), F.min("volume").alias("first_volume"), F.max("volume").alias("last_volume"),
        F.sum(F.col("hi") - F.col("lo")).cast("long").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.col("is_first").cast("int")).alias("has_first"), F.max(F.col("is_final").cast("int")).alias("has_final"),
    )
    error = (
        F.when(F.col("has_first") == 0, "no start").when(F.col("has_final") == 0, "no end")
        .when(F.col("last_volume") - F.col("first_volume") + 1 > F.col("fragments"), "gap")
        .when(F.col("bytes") > F.col("hi") - F.col("lo"), "overlap").when(F.col("bytes") < F.col("hi") - F.col("lo"), "gap")
    )
    return folded.select("ord", "fragments", "first_volume", "last_volume", "bytes", F.coalesce(error, F.lit("ok")).alias("state"))


# Fragments of one member at most.
MOST_FRAGMENTS = 65_536


def merged_members(fragments: DataFrame, most: int = MOST_FRAGMENTS) -> DataFrame:
    """Members of ``seq, name, attributes, crc, size, packed_size, from_before, goes_on``, headers in their order.

    A member begins at each header that isn't continued and takes the continuations
    behind it.  The first gives name and attributes, the last checksum and size; packed
    sizes are added.  States: ``ok``; ``no start`` (a continuation of nothing);
    ``interrupted`` and ``overlapping`` (another whole, or split, member begins before
    the last fragment); ``no end``; ``too many fragments``; ``overflow``.
    """
    # A continuation belongs to the last beginning; numbers of beginnings are dealt by ranges.
    begins = F.when(F.col("from_before"), 0).otherwise(1)
    numbered = running_total(fragments, "seq", begins, "begun")
    numbered = numbered.withColumn("_member", F.col("begun") + F.when(F.col("from_before"), 0).otherwise(1))
    head = F.struct("seq", "name", "attributes", "from_before", "goes_on")
    ends = F.min(F.when(~F.col("goes_on"), F.col("seq")))
    folded = numbered.groupBy("_member").agg(
        F.min(head).alias("first"), F.max_by(F.struct("crc", "size", "goes_on"), "seq").alias("last"), F.count(F.lit(1)).alias("fragments"),
        F.sum(F.col("packed_size").cast("decimal(20,0)")).alias("packed"), ends.alias("end"), F.max("seq").alias("last_seq"),
    )
    after = folded.select((F.col("_member") - 1).alias("_of"), F.col("first.goes_on").alias("next_split"))
    both = folded.join(after, F.col("_member") == F.col("_of"), "left")
    state = (
        F.when(F.col("first.from_before") | (F.col("end") < F.col("last_seq")), "no start")
        .when(F.col("fragments") > most, "too many fragments").when(F.col("packed") > (1 << 63) - 1, "overflow")
        .when(F.col("last.goes_on") & F.col("next_split").isNull(), "no end").when(F.col("last.goes_on") & F.col("next_split"), "overlapping").when(F.col("last.goes_on"), "interrupted").otherwise("ok")
    )
    good = state == "ok"
    return both.select(
        F.col("first.seq").alias("seq"), F.col("first.name").alias("name"), F.col("first.attributes").alias("attributes"), "fragments",
        F.when(good, F.col("last.crc")).alias("crc"), F.when(good, F.col("last.size")).alias("size"), F.when(good, F.col("packed").cast("long")).alias("packed_size"), state.alias("state"),
    )


def recovery_volume_count(volumes: Column, percent: int) -> Column:
    """``max(1, ceil(percent of volumes))``, at most as many as the volumes."""
    return F.least(F.greatest(F.ceil(volumes * percent / 100).cast("long"), F.lit(1).cast("long")), volumes.cast("long"))


def parity_slots(size: Column, percent: int) -> Column:
    """Slots of a legacy record: ``max(2, ceil(size * percent / 51200))``."""
    return F.greatest(F.ceil(size * percent / 51200).cast("long"), F.lit(2).cast("long"))


def xor_parity(rows: DataFrame, slots: int, sector: int = 512) -> DataFrame:
    """``slot, at, parity``: bytes of sectors ``k, k + slots, ...`` xor-ed; short ends count as zeros.

    ``rows`` are ``pos, b`` of one byte stream.  Partial aggregates run before the shuffle.
    """
    slot = F.floor(F.col("pos") / sector).cast("long") % slots
    return rows.groupBy(slot.alias("slot"), (F.col("pos") % sector).alias("at")).agg(F.bit_xor("b").cast("int").alias("parity"))


def sector_tags(data: Column, sector: int = 512) -> Column:
    """The tag of each sector: the low half of its inverted CRC-32, the end filled with zeros."""
    n = F.ceil(F.octet_length(data) / sector).cast("int")
    cut = lambda k: F.rpad(F.substring(data, k * sector + 1, sector), sector, F.lit(b"\0"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lit(65535) - F.crc32(cut(k)) % 65536)).otherwise(F.expr("cast(array() as array<bigint>)"))


class Field:
    """GF(2^16) by logarithm tables; its polynomial is a parameter."""

    def __init__(self, polynomial: int = 0x1100B):
        self.log, self.exp = np.zeros(65536, np.int64), np.zeros(131070, np.int64)
        x = 1
        for k in range(65535):
            self.exp[k] = self.exp[k + 65535] = x
            self.log[x] = k
            x <<= 1
            if x & 65536:
                x ^= polynomial

    def mul(self, a, b):
        a, b = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64))
        return np.where((a == 0) | (b == 0), 0, self.exp[self.log[a] + self.log[b]])

    def inv(self, a):
        return self.exp[65535 - self.log[np.asarray(a, np.int64)]]

    def cauchy(self, parity: int, data: int) -> np.ndarray:
        """Every square part of the matrix ``1 / (x_i ^ y_j)`` has an inverse."""
        return self.inv((np.arange(parity)[:, None] + data) ^ np.arange(data)[None, :])

    def product(self, m: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), rows.shape[1]), np.int64)
        for j in range(m.shape[1]):
            out ^= self.mul(m[:, j][:, None], rows[j][None, :])
        return out

    def solve(self, m: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Gauss-Jordan elimination of ``m x = rows``."""
        a, b = m.copy(), rows.copy()
        for k in range(len(a)):
            pivot = k + int(np.flatnonzero(a[k:, k])[0])
            a[[k, pivot]], b[[k, pivot]] = a[[pivot, k]], b[[pivot, k]]
            scale = self.inv(a[k, k])
            a[k], b[k] = self.mul(a[k], scale), self.mul(b[k], scale)
            for i in range(len(a)):
                if i != k and a[i, k]:
                    f = a[i, k]
                    a[i] ^= self.mul(a[k], f)
                    b[i] ^= self.mul(b[k], f)
        return b


_field: Field | None = None


def field() -> Field:
    global _field
    _field = _field or Field()
    return _field


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").astype(np.int64)


def encode_parity(shards: list[bytes], parity: int) -> list[bytes]:
    """Parity shards of equal-length data shards of an even number of bytes."""
    f = field()
    rows = f.product(f.cauchy(parity, len(shards)), np.stack([_words(s) for s in shards]))
    return [r.astype("<u2").tobytes() for r in rows]


def repair(shards: list[bytes | None], parities: dict[int, bytes]) -> list[bytes]:
    """The data shards, the missing ones rebuilt from as many parity shards."""
    f, lost = field(), [k for k, s in enumerate(shards) if s is None]
    if len(lost) > len(parities):
        raise ValueError("more shards are lost than there are parity shards")
    if not lost:
        return list(shards)
    use = sorted(parities)[: len(lost)]
    m = f.cauchy(max(use) + 1, len(shards))[use]
    known = [k for k, s in enumerate(shards) if s is not None]
    rest = np.stack([_words(parities[k]) for k in use])
    if known:
        rest = rest ^ f.product(m[:, known], np.stack([_words(shards[k]) for k in known]))
    out = list(shards)
    for k, row in zip(lost, f.solve(m[:, lost], rest)):
        out[k] = row.astype("<u2").tobytes()
    return out


def stripe_parity(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """Parity rows for ``stripe, shard, bytes``: one stripe, ``data`` shards of bounded size, in a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, group["bytes"]))
        width += width % 2
        have = {int(k): bytes(b).ljust(width, b"\0") for k, b in zip(group["shard"], group["bytes"])}
        rows = encode_parity([have.get(k, bytes(width)) for k in range(data)], parity)
        return pd.DataFrame({"stripe": group["stripe"].iloc[0], "shard": range(parity), "bytes": rows})

    return shards.groupBy("stripe").applyInPandas(run, "stripe long, shard int, bytes binary")
