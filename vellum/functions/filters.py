"""Reversible filters of machine code, and the screen for data that won't pack."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

# Opcodes of near calls and jumps, the last byte of a linked branch, the size of the address space.
CALL, JUMP, BRANCH, SPACE = 0xE8, 0xE9, 0xEB, 1 << 24
# Bytes between two windows, bytes of a window, and the fewest windows that can be judged.
STRIDE, WINDOW, LEAST_WINDOWS = 16, 4, 4096
# Channel counts that are tried, the fewest bytes they are tried on, the bytes of the head that is looked at, and the largest small difference.
CHANNELS, LEAST_BYTES, HEAD, SMALL = (1, 2, 3, 4, 6, 8, 9, 12, 16), 256, 64 << 10, 8


def _opcodes(data: np.ndarray, jumps: bool) -> np.ndarray:
    """Where opcodes stand; one inside the operand of an earlier one isn't counted."""
    head = data[: max(len(data) - 4, 0)]
    found, free = [], 0
    for at in np.flatnonzero((head == CALL) | ((head == JUMP) & jumps)).tolist():
        if at >= free:
            found.append(at)
            free = at + 5
    return np.array(found, np.int64)


def x86(raw: bytes, offset: int = 0, jumps: bool = True, inverse: bool = False) -> bytes:
    """Targets of calls (and jumps) from relative to absolute, within 16 MiB; ``inverse`` takes them back.

    Fewer than five bytes stay as they are.
    """
    data = np.frombuffer(raw, np.uint8).copy()
    at = _opcodes(data, jumps)
    if not len(at):
        return raw
    cells = at[:, None] + np.arange(1, 5)
    target = data[cells].astype(np.int64) @ (1 << np.arange(0, 32, 8))
    here, modulus = (at + 1 + offset) % SPACE, 1 << 32
    # A number is negative as the hardware reads it when it is 2**31 or more.
    negative = lambda x: x % modulus >= modulus // 2
    if inverse:
        wraps = negative(target) & ~negative(target + here)
        out = np.where(target < SPACE, target - here, np.where(wraps, target + SPACE, target))
    else:
        moved, lowered = (target + here) % modulus, target - SPACE
        wraps = negative(lowered) & ~negative(lowered + here)
        out = np.where(moved < SPACE, moved, np.where(wraps, lowered, target))
    data[cells] = (out % modulus)[:, None] >> np.arange(0, 32, 8) & 255
    return data.tobytes()


def arm(raw: bytes, offset: int = 0, inverse: bool = False) -> bytes:
    """Targets of linked branches, counted in words, from relative to absolute; a rest under four bytes stays."""
    words = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4").astype(np.int64)
    here = (np.arange(len(words)) * 4 + offset) >> 2
    moved = (words + (-here if inverse else here)) % SPACE | BRANCH << 24
    return np.where(words >> 24 == BRANCH, moved, words).astype("<u4").tobytes() + raw[len(words) * 4 :]


def _column(f, **options):
    """``f`` over columns; null data stays null, a null offset is 0."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else f(bytes(b), int(o), **options) for b, o in zip(data, offset)], dtype=object)

    return lambda data, offset: run(data, F.coalesce(offset, F.lit(0)).cast("long"))


def x86_filter(data: Column, offset: Column, jumps: bool = True, inverse: bool = False) -> Column:
    return _column(x86, jumps=jumps, inverse=inverse)(data, offset)


def arm_filter(data: Column, offset: Column, inverse: bool = False) -> Column:
    return _column(arm, inverse=inverse)(data, offset)


def window_count(data: Column) -> Column:
    return F.when(F.octet_length(data) >= WINDOW, F.floor((F.octet_length(data) - WINDOW) / STRIDE).cast("int") + 1).otherwise(0)


def distinct_window_percent(data: Column, least: int = LEAST_WINDOWS) -> Column:
    """The whole percentage of different windows among those at a fixed stride; null where too few can be read."""
    n = window_count(data)
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.hex(F.substring(data, k * STRIDE + 1, F.lit(WINDOW))))
    return F.when(n >= max(least, 1), F.floor(F.size(F.array_distinct(windows)) * 100 / n).cast("int"))


def delta_sums(raw: bytes, channels: int) -> tuple[int, int]:
    """The sum of the differences that ``channels`` interleaved channels leave, as bytes, and how many are small."""
    data = np.frombuffer(raw, np.uint8)
    before = np.concatenate([np.zeros(channels, np.uint8), data])[: len(data)]
    left = before - data  # modulo 256
    return int(left.sum(dtype=np.int64)), int((left <= SMALL).sum())


def best_channels(raw: bytes) -> int | None:
    """The channel count whose differences have the smallest sum, the lower of equals.

    None where a filter isn't worth it: too few bytes, one byte all along, or
    half of the head's differences aren't small with any count.  A head without
    a single small difference isn't refused.
    """
    if len(raw) < LEAST_BYTES or raw.count(raw[0]) == len(raw):
        return None
    head = raw[:HEAD]
    sums, small = zip(*(delta_sums(head, c) for c in CHANNELS))
    if 0 < 2 * max(small) < len(head):
        return None
    return CHANNELS[sums.index(min(sums))]


def delta_statistics(data: Column, channels: int) -> Column:
    """``magnitude`` and ``near_zero`` of the differences of a member's bytes; null data gives nulls."""

    @F.pandas_udf("magnitude long, near_zero long")
    def run(data: pd.Series) -> pd.DataFrame:
        found = [(None, None) if b is None else delta_sums(bytes(b), channels) for b in data]
        return pd.DataFrame(found, columns=["magnitude", "near_zero"], dtype="Int64")

    return run(data)


@F.pandas_udf(IntegerType())
def delta_channels(data: pd.Series) -> pd.Series:
    """``best_channels`` of a column; null data gives null."""
    return pd.Series([None if b is None else best_channels(bytes(b)) for b in data], dtype="Int32")
