"""Checksums, variable-length integers and byte filters.

What Spark has is used as it is; the rest are folds over byte arrays in the JVM,
or, where the work is byte-bound, Arrow functions over whole batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def byte_array(c: Column) -> Column:
    """The bytes of a binary column as an array of integers."""
    hexed = F.hex(c)
    at = F.sequence(F.lit(0), F.octet_length(c) - 1)
    found = F.transform(at, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(c) > 0, found).otherwise(F.expr("cast(array() as array<int>)"))


def crc16(c: Column) -> Column:
    """The low half of CRC-32, as in headers."""
    return F.crc32(c) % 65536


def rolling_sum(data: Column) -> Column:
    """Per byte: add, then rotate left by one, in 16 bits."""
    return F.aggregate(data, F.lit(0), lambda a, b: ((a + b) % 65536 * 2 % 65536) + F.floor((a + b) % 65536 / 32768).cast("int"))


def vint(n: Column) -> Column:
    """Upper-case hex of a number in groups of 7 bits, the lowest first; the high bit says that more follow."""
    groups = F.greatest(F.ceil(F.length(F.bin(n)) / 7).cast("int"), F.lit(1))
    byte = lambda k: F.floor(n / F.pow(F.lit(128.0), k)).cast("long") % 128
    digit = lambda k: F.lpad(F.hex(byte(k) + F.when(k < groups - 1, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), digit), "")


def vint_size(n: Column) -> Column:
    return F.greatest(F.ceil(F.length(F.bin(n)) / 7).cast("int"), F.lit(1))


def delta(data: Column, channels: int = 1) -> Column:
    """Planar differences: all of channel 0, then channel 1, each ``previous - current`` modulo 256."""
    n = F.size(data)
    plane = lambda ch: F.when(n > ch, F.transform(F.sequence(F.lit(ch), n - 1, F.lit(channels)), lambda i: F.pmod(F.when(i >= channels, F.get(data, i - channels)).otherwise(0) - F.get(data, i), F.lit(256)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.concat(*[plane(ch) for ch in range(channels)])


def undelta(data: np.ndarray, channels: int) -> np.ndarray:
    """The inverse of ``delta``, for whole arrays."""
    out, at = np.empty(len(data), np.uint8), 0
    for ch in range(channels):
        n = len(range(ch, len(data), channels))
        out[ch::channels] = (-np.cumsum(data[at : at + n].astype(np.int64))) % 256
        at += n
    return out


_POLY64 = 0xC96C5795D7870F42


def _table64() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (_POLY64 if b & 1 else 0)
        out.append(b)
    return out


_TABLE64 = _table64()


def crc64_bytes(data: bytes, state: int = 0) -> int:
    crc = state ^ 0xFFFFFFFFFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _TABLE64[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFFFFFFFFFF


_ROW = 256


def _advance(crc: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The states after ``_ROW`` bytes of zeros; ``steps`` has them for each value of each byte."""
    out = np.zeros_like(crc)
    for k in range(8):
        out ^= steps[k][(crc >> np.uint64(8 * k) & np.uint64(255)).astype(np.intp)]
    return out


def _steps(table: np.ndarray) -> np.ndarray:
    crc = (np.arange(256, dtype=np.uint64)[None, :] << (8 * np.arange(8, dtype=np.uint64))[:, None]).ravel()
    for _ in range(_ROW):
        crc = crc >> np.uint64(8) ^ table[(crc & np.uint64(255)).astype(np.intp)]
    return crc.reshape(8, 256)


def crc64_many(data: list[bytes]) -> list[int]:
    """The checksums of several texts: all their rows of ``_ROW`` bytes take each step together, then each text's rows are joined.

    The initial state is folded into the first eight bytes; zeros before them change nothing.
    """
    table = np.array(_TABLE64, np.uint64)
    steps = _steps(table)
    out = [0 if len(d) >= 8 else crc64_bytes(d) for d in data]
    long = [k for k, d in enumerate(data) if len(d) >= 8]
    counts = [-(-len(data[k]) // _ROW) for k in long]
    if not long:
        return out
    rows = np.zeros((sum(counts), _ROW), np.uint8)
    flat, at = rows.reshape(-1), 0
    for k, n in zip(long, counts):
        at += n * _ROW
        own = flat[at - len(data[k]) : at]
        own[:] = np.frombuffer(data[k], np.uint8)
        own[:8] ^= 255
    crc = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(rows.T):
        crc = crc >> np.uint64(8) ^ table[((crc ^ column) & np.uint64(255)).astype(np.intp)]
    first, number = np.cumsum([0, *counts[:-1]]), np.array(counts)
    state = np.zeros(len(long), np.uint64)
    order = np.argsort(-number, kind="stable")
    for step in range(max(counts)):
        live = order[: int(np.searchsorted(-number[order], -step))]  # texts with a row more
        state[live] = _advance(state[live], steps) ^ crc[first[live] + step]
    for k, value in zip(long, (state ^ np.uint64(0xFFFFFFFFFFFFFFFF)).tolist()):
        out[k] = value
    return out


@F.pandas_udf(StringType())
def crc64(data: pd.Series) -> pd.Series:
    """CRC-64 of the xz format, as 16 hex digits."""
    found, values, size = [], [], 0
    raw = [None if b is None else bytes(b) for b in data]
    for k, b in enumerate(raw):
        values.append(b or b"")
        size += len(b or b"")
        if size > 4 << 20 or k == len(raw) - 1:
            found += crc64_many(values)
            values, size = [], 0
    return pd.Series([None if b is None else f"{c:016x}" for b, c in zip(raw, found)], dtype=object)


def blake2sp_bytes(data: bytes) -> bytes:
    """BLAKE2sp: 8 leaves take 64-byte blocks in turn, a root joins their hashes."""
    leaves = [hashlib.blake2s(fanout=8, depth=2, node_offset=k, inner_size=32, last_node=k == 7) for k in range(8)]
    whole = len(data) // 512 * 512
    turns = np.frombuffer(data, np.uint8, whole).reshape(-1, 8, 64)
    for k in range(8):
        leaves[k].update(np.ascontiguousarray(turns[:, k]))
        leaves[k].update(data[whole + 64 * k : whole + 64 * k + 64])
    root = hashlib.blake2s(fanout=8, depth=2, node_depth=1, inner_size=32, last_node=True)
    for leaf in leaves:
        root.update(leaf.digest())
    return root.digest()


@F.pandas_udf(StringType())
def blake2sp(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else blake2sp_bytes(bytes(b)).hex())


def comment_text(payload: Column, unicode: Column) -> Column:
    """The text of a stored comment: UTF-16 if it says so, or if it isn't UTF-8 and its pairs of bytes hold no surrogate."""
    pairs = F.regexp_extract_all(F.hex(payload), F.lit("..(..)"), F.lit(1))
    surrogate = F.exists(pairs, lambda high: high.rlike("^D[89A-F]$"))
    wide = F.decode(F.substring(payload, F.lit(1), F.octet_length(payload) - F.octet_length(payload) % 2), "UTF-16LE")
    plain = F.is_valid_utf8(payload.cast("string")) | (F.octet_length(payload) % 2 == 1) | surrogate
    return F.when(unicode, wide.cast("binary")).when(plain, payload).otherwise(wide.cast("binary"))


# Characters of a password that count.
PASSWORD_CHARS = 127


def clamp_password(password: bytes) -> bytes:
    """The first characters of a password in UTF-8; of one in another encoding as many bytes."""
    try:
        return password.decode()[:PASSWORD_CHARS].encode()
    except UnicodeDecodeError:
        return password[:PASSWORD_CHARS]


def mac_crc32(hash_key: bytes, crc: int) -> int:
    """The checksum that an encrypted member shows: the words of an HMAC of the real one, folded."""
    import hmac

    digest = hmac.digest(hash_key, crc.to_bytes(4, "little"), "sha256")
    return int(np.bitwise_xor.reduce(np.frombuffer(digest, "<u4")))


def mac_hash(hash_key: bytes, digest: bytes) -> bytes:
    """The hash that an encrypted member shows."""
    import hmac

    return hmac.digest(hash_key, digest, "sha256")


def kdf(password: bytes, salt: bytes, strength: int) -> tuple[bytes, bytes, bytes]:
    """Key, hash key and password check of an HMAC-SHA256 chain, tapped at n, n + 16 and n + 32 rounds."""
    import hmac

    if strength > 24:
        raise ValueError("key strength is over 24")
    password = clamp_password(password)
    block = hmac.digest(password, salt + b"\0\0\0\1", "sha256")
    total, taps = int.from_bytes(block, "big"), []
    for rounds in ((1 << strength) - 1, 16, 16):
        for _ in range(rounds):
            block = hmac.digest(password, block, "sha256")
            total ^= int.from_bytes(block, "big")
        taps.append(total.to_bytes(32, "big"))
    return taps[0], taps[1], taps[2]


def password_check(tap: bytes) -> bytes:
    """Eight bytes folded from the last tap, and four of their SHA-256."""
    folded = bytes(tap[k] ^ tap[k + 8] ^ tap[k + 16] ^ tap[k + 24] for k in range(8))
    return folded + hashlib.sha256(folded).digest()[:4]
