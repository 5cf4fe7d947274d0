"""Containers of members: finding their start, writing and reading them.

A container is a signature and blocks.  A block is the CRC-32 of its header, the
header's length, a type, flags and fields in variable-length integers, and its
data.  Members are stored as they are.  Containers are rows (``archive`` or
``path`` and ``content``), so that any source of binary rows can be read; one is
built or read by one task, and ``write`` bounds its size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.binary import blake2sp_bytes
from vellum.operators.ranges import running_total

# Fixed values of the format: signatures, block types and flags.
SIGNATURE = b"Rar!\x1a\x07\x01\x00"
SIGNATURE_OLD = b"Rar!\x1a\x07\x00"
SIGNATURE_OLDEST = b"RE~^"
MAIN, FILE, SERVICE, CRYPT, END = 1, 2, 3, 4, 5
HAS_EXTRA, HAS_DATA, FROM_BEFORE, GOES_ON = 1, 2, 8, 16
IS_DIR, HAS_TIME, HAS_CRC = 1, 2, 4
EXTRA_HASH, EXTRA_VERSION = 2, 4

#: Bytes that are searched for a signature.
SCAN = 8 << 20

_FIELDS = "name string, is_dir boolean, size long, packed_size long, method int, version long, mtime_s long, crc32 long, blake2sp string, continued boolean, goes_on boolean, payload binary, state string"
SCHEMA = f"path string, block long, offset long, {_FIELDS}"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])


def start(content: Column) -> Column:
    """``family, offset`` of the container in a file that may begin with a stub, else null.

    The earliest of the two long signatures counts; the short one only where neither is.
    """
    text = F.decode(F.substring(content, 1, SCAN + len(SIGNATURE)), "ISO-8859-1")
    at = lambda s: F.nullif(F.instr(text, s.decode("latin-1")), F.lit(0)) - 1
    new, old, oldest = at(SIGNATURE), at(SIGNATURE_OLD), at(SIGNATURE_OLDEST)
    found = lambda family, offset: F.struct(F.lit(family).alias("family"), offset.alias("offset"))
    # Nulls fail every comparison, so a missing signature never wins.
    best = F.when(new.isNotNull() & (old.isNull() | (new < old)), found("v50", new)).when(old.isNotNull(), found("v15", old)).when(oldest.isNotNull(), found("v13", oldest))
    return F.when(best["offset"] <= SCAN, best)


def vint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """A number and the place behind it; a ``ValueError`` if it doesn't end in ten bytes or in the data."""
    n = 0
    for k in range(10):
        if at + k >= len(data):
            raise ValueError("truncated")
        n |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return n, at + k + 1
    raise ValueError("long number")


def block(kind: int, fields: bytes, data: bytes = b"", extra: bytes = b"", flags: int = 0) -> bytes:
    flags |= (HAS_EXTRA if extra else 0) | (HAS_DATA if data else 0)
    body = vint(kind) + vint(flags) + (vint(len(extra)) if extra else b"") + (vint(len(data)) if data else b"") + fields + extra
    head = vint(len(body)) + body
    return zlib.crc32(head).to_bytes(4, "little") + head + data


def member_block(name: str, data: bytes, mtime_s: int, version: int = 0, is_dir: bool = False) -> bytes:
    """A stored member with its time, CRC-32 and hash, and its version if it has one."""
    record = lambda kind, value: vint(len(vint(kind) + value)) + vint(kind) + value
    extra = b"" if is_dir else record(EXTRA_HASH, vint(0) + blake2sp_bytes(data))
    if version:
        extra += record(EXTRA_VERSION, vint(0) + vint(version))
    raw = name.encode()
    fields = vint(HAS_TIME | (IS_DIR if is_dir else HAS_CRC)) + vint(len(data)) + vint(0o40755 if is_dir else 0o100644) + mtime_s.to_bytes(4, "little")
    fields += (b"" if is_dir else zlib.crc32(data).to_bytes(4, "little")) + vint(0) + vint(1) + vint(len(raw)) + raw
    return block(FILE, fields, data, extra)


def write(members: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``archive, content`` from ``ord, name, data, mtime_s, version``, in archive order.

    A container ends with the member that reaches ``limit`` bytes of data: none is
    larger than that and its last member.  A null time or version is 0, null data empty.
    """
    cells = members.select("ord", "name", F.coalesce("data", F.lit(b"")).alias("data"), F.coalesce("mtime_s", F.lit(0)).alias("mtime_s"), F.coalesce("version", F.lit(0)).alias("version"))
    # Only lengths are dealt by ranges; the data join their places.
    sized = running_total(cells.select("ord", F.octet_length("data").alias("_length")), "ord", "_length", "before").select(F.col("ord").alias("_ord"), "before")
    placed = cells.join(sized, F.col("ord") == F.col("_ord")).drop("_ord")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ord")
        parts = [SIGNATURE, block(MAIN, vint(0))]
        parts += [member_block(r.name_, bytes(r.data), int(r.mtime_s), int(r.version)) for r in rows.rename(columns={"name": "name_"}).itertuples()]
        return pd.DataFrame({"archive": [rows["archive"].iloc[0]], "content": [b"".join([*parts, block(END, vint(0))])]})

    numbered = placed.withColumn("archive", F.floor(F.col("before") / limit).cast("long")).drop("before")
    return numbered.groupBy("archive").applyInPandas(run, "archive long, content binary")


def _header(data: bytes, at: int) -> tuple[int, dict, int, int]:
    """Type, fields, place of the data and its length of the block at ``at``."""
    size, body = read_vint(data, at + 4)
    end = body + size
    if end > len(data):
        raise ValueError("truncated")
    if not size or zlib.crc32(data[at + 4 : end]) != int.from_bytes(data[at : at + 4], "little"):
        raise ValueError("bad header")
    head = data[:end] if end < 1 << 16 else data
    kind, p = read_vint(head, body)
    flags, p = read_vint(head, p)
    extra, p = read_vint(head, p) if flags & HAS_EXTRA else (0, p)
    packed, p = read_vint(head, p) if flags & HAS_DATA else (0, p)
    got: dict = {"continued": bool(flags & FROM_BEFORE), "goes_on": bool(flags & GOES_ON), "packed_size": packed}
    if kind == FILE:
        what, p = read_vint(head, p)
        got["size"], p = read_vint(head, p)
        _, p = read_vint(head, p)
        got["is_dir"] = bool(what & IS_DIR)
        if what & HAS_TIME:
            got["mtime_s"], p = int.from_bytes(data[p : p + 4], "little"), p + 4
        if what & HAS_CRC:
            got["crc32"], p = int.from_bytes(data[p : p + 4], "little"), p + 4
        method, p = read_vint(head, p)
        got["method"] = method >> 7 & 7
        _, p = read_vint(head, p)
        length, p = read_vint(head, p)
        got["name"] = data[p : p + length].decode("utf-8", "replace")
        p = end - extra
        while p < end:
            record, p = read_vint(head, p)
            stop = p + record
            what, p = read_vint(head, p)
            if what == EXTRA_HASH and data[p] == 0:
                got["blake2sp"] = data[p + 1 : p + 33].hex()
            elif what == EXTRA_VERSION:
                got["version"] = read_vint(head, read_vint(head, p)[1])[0]
            p = stop
    return kind, got, end, packed


def blocks(data: bytes, salvage: bool = False) -> Iterator[dict]:
    """Members in order, with a ``state``: ``ok``, ``crc``, ``hash``, ``size``, ``packed`` (not stored) or the damage that stopped the scan.

    ``salvage`` goes on after a damaged header with the next bytes that are a block.
    """
    at = data.find(SIGNATURE)
    if at < 0:
        yield {"state": "no signature", "offset": 0}
        return
    at += len(SIGNATURE)
    damaged = False
    while at < len(data):
        try:
            kind, got, body, packed = _header(data, at)
        except (ValueError, IndexError) as e:
            if not damaged:
                yield {"state": str(e) if isinstance(e, ValueError) else "truncated", "offset": at}
            if not salvage:
                return
            damaged = True
            at += 1
            continue
        damaged = False
        if kind == FILE:
            payload = data[body : body + packed]
            got |= {"payload": payload, "offset": at, "state": verify(got, payload)}
            yield got
        elif kind == END:
            return
        at = body + packed


def verify(got: dict, payload: bytes) -> str:
    if len(payload) < got["packed_size"]:
        return "truncated"
    if got["continued"] or got["goes_on"]:
        return "fragment"
    if got["method"]:
        return "packed"
    if len(payload) != got["size"]:
        return "size"
    if "crc32" in got and zlib.crc32(payload) != got["crc32"]:
        return "crc"
    return "hash" if "blake2sp" in got and blake2sp_bytes(payload).hex() != got["blake2sp"] else "ok"


def scan(files: DataFrame, salvage: bool = False, path: str = "path") -> DataFrame:
    """The members of containers, with their payload and what is wrong with them.

    A null file has no members; damage is a row with a state and no name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [] if not raw.is_valid else [r | {"path": where, "block": k} for k, r in enumerate(blocks(raw.as_py(), salvage))]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(F.col(path).cast("string"), "content").mapInArrow(run, SCHEMA)


#: Bytes that are read at once for a header; a longer one is read again.
WINDOW = 1 << 14


def _listed(path: str) -> Iterator[dict]:
    """The members of one file by their headers; payloads are passed by, not read."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path) else f"file://{path}")
    with system.open_input_file(name) as f:
        size = f.size()
        at = f.read_at(min(size, SCAN), 0).find(SIGNATURE)
        if at < 0:
            yield {"state": "no signature", "offset": 0}
            return
        at += len(SIGNATURE)
        while at < size:
            for window in (WINDOW, 1 << 22):
                data = f.read_at(min(window, size - at), at)
                try:
                    kind, got, body, packed = _header(data, 0)
                    break
                except (ValueError, IndexError) as e:
                    kind, fault = None, str(e) if isinstance(e, ValueError) else "truncated"
            if kind is None:
                yield {"state": fault, "offset": at}
                return
            if kind == FILE:
                whole = at + body + packed <= size
                yield got | {"offset": at, "state": "truncated" if not whole else "fragment" if got["continued"] or got["goes_on"] else "listed"}
            elif kind == END:
                return
            at += body + packed


def catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """The members of the files named by ``path``, from their headers alone: no payload is read or checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column(0).to_pylist():
                rows = [] if where is None else [r | {"path": where, "block": k} for k, r in enumerate(_listed(where))]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return paths.select(F.col(path).cast("string")).mapInArrow(run, SCHEMA).drop("payload")
