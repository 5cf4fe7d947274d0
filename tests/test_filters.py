"""Filters of machine code against plain loops, and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import filters


def code(seed, n):
    rng = random.Random(seed)
    return bytes(rng.choice([0xE8, 0xE9, 0xEB, 0, 0, 0xFF, rng.randrange(256)]) for _ in range(n))


@pytest.mark.parametrize("n", [0, 3, 4, 5, 9, 64, 5000])
@pytest.mark.parametrize("offset", [0, 7, (1 << 24) - 3, 1 << 33])
def test_filters_come_back(n, offset):
    raw = code(n + offset, n)
    for jumps in (True, False):
        assert filters.x86(filters.x86(raw, offset, jumps), offset, jumps, inverse=True) == raw
    assert filters.arm(filters.arm(raw, offset), offset, inverse=True) == raw


def test_known_values():
    assert filters.x86(bytes.fromhex("90E810000000"), 0) == bytes.fromhex("90E812000000")
    assert filters.x86(bytes.fromhex("E910000000"), 0, jumps=False) == bytes.fromhex("E910000000")
    # A call backwards: -16 from an address of 32 and more becomes a small absolute number.
    assert filters.x86(bytes.fromhex("E8F0FFFFFF"), 31) == bytes.fromhex("E810000000")
    assert filters.arm(bytes.fromhex("00000000010000EBFF"), 8) == bytes.fromhex("00000000040000EBFF")


def test_window_screen(spark):
    rows = [(0, None), (1, b""), (2, b"abc"), (3, b"abcd"), (4, b"x" * 1000), (5, bytes(range(256)))]
    data = spark.createDataFrame(rows, "k int, data binary")
    got = {r.k: (r.n, r.p) for r in data.select("k", filters.window_count(F.col("data")).alias("n"), filters.distinct_window_percent(F.col("data"), 1).alias("p")).collect()}
    assert got == {0: (0, None), 1: (0, None), 2: (0, None), 3: (1, 100), 4: (63, 1), 5: (16, 100)}


def test_columns_keep_nulls(spark):
    data = spark.createDataFrame([(None, 9), (b"\xe8\x00\x00\x00\x00", 9), (b"\xe9\x00\x00\x00\x00", None)], "data binary, at long")
    got = [r.x and bytes(r.x) for r in data.select(filters.x86_filter(F.col("data"), F.col("at")).alias("x")).collect()]
    assert got == [None, b"\xe8\x0a\x00\x00\x00", b"\xe9\x01\x00\x00\x00"]
    assert data.limit(0).select(filters.arm_filter(F.col("data"), F.lit(9))).count() == 0


def plain_sums(raw, channels):
    before, total, small = [0] * channels, 0, 0
    for at, byte in enumerate(raw):
        left = (before[at % channels] - byte) % 256
        total, small = total + left, small + (left <= 8)
        before[at % channels] = byte
    return total, small


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 700])
def test_differences_against_a_plain_loop(n):
    raw = random.Random(n).randbytes(n)
    for channels in filters.CHANNELS:
        assert filters.delta_sums(raw, channels) == plain_sums(raw, channels)


def test_channels(spark):
    falling = bytes(b for k in range(400) for b in (255 - k // 2 % 200, 40 + 3 * (k % 2 == 0), 9))
    rows = [(0, None), (1, b""), (2, b"x" * 5000), (3, random.Random(1).randbytes(9000)), (4, falling), (5, falling[:255]), (6, b"ab" * 200), (7, falling + random.Random(2).randbytes(200_000))]
    # Only the head counts: noise after it changes nothing, noise within it does.
    rows.append((8, falling * 60 + random.Random(2).randbytes(200_000)))
    data = spark.createDataFrame(rows, "k int, data binary")
    got = {r.k: r.c for r in data.select("k", filters.delta_channels(F.col("data")).alias("c")).collect()}
    assert {k: got[k] for k in (0, 1, 2, 3, 5, 7)} == dict.fromkeys((0, 1, 2, 3, 5, 7))
    for k in (4, 6, 8):
        head = rows[k][1][:65536]
        assert got[k] == min(filters.CHANNELS, key=lambda c: plain_sums(head, c)[0])
    sums = data.where("k < 2").select("k", filters.delta_statistics(F.col("data"), 3).alias("s")).select("k", "s.*").collect()
    assert {tuple(r) for r in sums} == {(0, None, None), (1, 0, 0)}
