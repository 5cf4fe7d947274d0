import hashlib
import re
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import binary, cells, parse, paths
from vellum.operators import volumes


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_masks(spark):
    names = ["a/b/c.txt", "c.txt", "a[1].txt", "a1.txt", "A/B.TXT", "a%b_c.txt", "a/c.txtx"]
    assert values(spark, names, paths.mask_match(F.col("x"), "*.txt")) == [True, True, True, True, False, True, False]
    assert values(spark, names, paths.mask_match(F.col("x"), "a[1].txt")) == [False, False, True, False, False, False, False]
    assert values(spark, names, paths.mask_match(F.col("x"), "a%b_?.txt")) == [False] * 5 + [True, False]


def test_selectors(spark):
    names = ["dir/a.txt", "dir", "dirx/a.txt", "a.txt", "x/dir/a.txt"]
    assert values(spark, names, paths.selector(F.col("x"), "dir")) == [True, True, False, False, False]
    assert values(spark, names, paths.selector(F.col("x"), "dir\\a.txt")) == [True, False, False, False, False]
    assert values(spark, names, paths.selector(F.col("x"), "a.*")) == [True, False, True, True, True]
    assert values(spark, names, paths.selector(F.col("x"), "*/a.*")) == [True, False, True, False, True]
    assert values(spark, names, paths.any_selector(F.col("x"), [])) == [True] * 5


def test_sanitize(spark):
    names = ["a/./b", "a//b", "../a", "/a", "C:/a", "a\\b", "", "a\0b", ".", "a/..b"]
    assert values(spark, names, paths.sanitize(F.col("x"))) == ["a/b", "a/b", None, None, None, "a/b", None, None, None, "a/..b"]


def test_links_stay_inside(spark):
    targets = ["../x", "../../x", "x/../../y", "/x", "b/../../../x"]
    assert values(spark, targets, paths.link_stays_inside(F.lit("d/link"), F.col("x"))) == [True, False, True, False, False]


def test_extension(spark):
    assert values(spark, ["a.b/c", "a.txt", "a.", ".rc", "x"], paths.extension(F.col("x"))) == ["", "txt", "", "rc", ""]


def test_cells(spark):
    sizes = [0, 1, 1023, 1024, 1025, 1 << 20, 3 << 30]
    assert values(spark, sizes, cells.byte_count(F.col("x")), "x long") == ["0g", "1", "1023", "1k", "1025", "1m", "3g"]
    assert values(spark, [0o100644, 0o040755, 0o104755, 0o101666], cells.unix_mode(F.col("x")), "x int") == ["-rw-r--r--", "drwxr-xr-x", "-rwsr-xr-x", "-rw-rw-rwT"]
    assert values(spark, [0o010644, 0o020600, 0o060777, 0o100644 << 16, 0o644 << 16], cells.unix_mode(F.col("x")), "x long") == ["prw-r--r--", "crw-------", "brwxrwxrwx", "-rw-r--r--", "-rw-r--r--"]
    assert values(spark, [0x3FFF, 0x800, 0], cells.dos_attributes(F.col("x")), "x int") == ["I.ADSHR", ".......", "......."]
    assert values(spark, [0, 3, 7], cells.ratio(F.lit(5).cast("long"), F.col("x")), "x long") == [0, 166, 71]
    assert values(spark, [None, 0], cells.time_cell(F.col("x")), "x long") == ["????-??-?? ??:??", "1970-01-01 00:00"]


def test_parsers():
    assert parse.size("10") == 10 and parse.size("2k") == 2048 and parse.size("1", "g") == 1 << 30
    assert parse.dedup_size("64k") == 65536 and parse.dedup_size("64K") == 64000
    assert parse.dictionary("32m") == (8, 32 << 20) and parse.dictionary("128k") == (0, 128 << 10) and parse.dictionary("5g") == (None, 5 << 30)
    for bad in ("33m", "127g", "64k", "x"):
        with pytest.raises(ValueError):
            parse.dictionary(bad)
    assert parse.period("1d2h3m4s") == 93784 and parse.period("5x") == 0 and parse.period("") == 0
    assert parse.period("30D") == 0 and parse.period("1d5") == 0 and parse.period("5") == 0 and parse.period("d2h") == 7200 and parse.period("1h1h") == 7200
    assert parse.time_filter("oc1d") == ("c", True, "1d") and parse.time_filter("5h") == ("m", False, "5h") and parse.time_filter("mc30d") == ("mc", False, "30d")
    assert [parse.volume_name("a", k, 12) for k in (1, 12)] == ["a.part01.rar", "a.part12.rar"]
    assert [parse.volume_name("a", k, 200, True) for k in (1, 2, 101, 102)] == ["a.rar", "a.r00", "a.r99", "a.s00"]


def test_dates_are_local(monkeypatch):
    import time

    for zone, shift in (("UTC", 0), ("Etc/GMT-3", 3 * 3600)):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        assert parse.date("2024") == 1704067200 - shift and parse.date("2024-01-02 03:04:05") == 1704164645 - shift
        assert parse.date("2024/02/31") == parse.date("2024/03/02") and parse.date("1969") == 0
    monkeypatch.undo()
    time.tzset()
    for bad in ("2024010203040506", "202", "20241", "20241301", "20240132", "2024010124", "21070101", "", "x"):
        with pytest.raises(ValueError):
            parse.date(bad)
    assert parse.auto_name("", datetime(2024, 1, 2, 3, 4, 5)) == "20240102030405" and parse.auto_name("a-YYYY.MM-mm", datetime(2024, 1, 2, 3, 4, 5)) == "a-2024.01-04"


def test_checksums_have_known_answers():
    assert binary.blake2sp_bytes(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"
    assert binary.crc64_bytes(b"123456789") == 0x995DC9BBDF1939FA
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 7, 8, 9, 255, 256, 257, 511, 512, 5000, 70_000)] + [bytes(600), b"123456789"]
    assert binary.crc64_many(texts) == [binary.crc64_bytes(t) for t in texts] and binary.crc64_many([]) == []
    for n in (0, 63, 64, 511, 512, 513, 5000):
        data = bytes(rng.integers(0, 256, n, np.uint8))
        leaves = [hashlib.blake2s(b"".join(data[a : a + 64] for a in range(64 * k, n, 512)), fanout=8, depth=2, node_offset=k, inner_size=32, last_node=k == 7) for k in range(8)]
        root = hashlib.blake2s(b"".join(x.digest() for x in leaves), fanout=8, depth=2, node_depth=1, inner_size=32, last_node=True)
        assert binary.blake2sp_bytes(data) == root.digest()


def test_passwords_and_macs():
    import hmac

    assert binary.clamp_password(("é" * 200).encode()) == ("é" * 127).encode() and binary.clamp_password(b"\xff" * 200) == b"\xff" * 127 and binary.clamp_password(b"ab") == b"ab"
    digest = hmac.digest(b"k", (77).to_bytes(4, "little"), "sha256")
    want = 0
    for k in range(0, 32, 4):
        want ^= int.from_bytes(digest[k : k + 4], "little")
    assert binary.mac_crc32(b"k", 77) == want and binary.mac_hash(b"k", b"h" * 32) == hmac.digest(b"k", b"h" * 32, "sha256")


def test_stored_names(spark):
    name = lambda **k: values(spark, ["a/b/c.TXT", "a", "a/", "x\\y"], paths.stored_name(F.col("x"), **k))
    assert name(strip_base=True) == ["b/c.TXT", "a", "a/", "y"] and name(flat=True) == ["c.TXT", "a", "", "y"]
    assert name(drop_prefix="a/") == ["b/c.TXT", "a", "", "x/y"] and name(strip_base=True, drop_prefix="b", case="lower", prefix="p") == ["p/c.txt", "p/a", "p/a/", "p/y"]


def test_byte_folds(spark):
    rng = np.random.default_rng(1)
    data = [b"", b"a", b"hello world", rng.bytes(700)]
    df = spark.createDataFrame([(d,) for d in data], "x binary")
    got = df.select(binary.byte_array(F.col("x")).alias("b"), F.col("x")).select(
        "b", binary.rolling_sum(F.col("b")), F.crc32("x"), volumes.sector_tags(F.col("x")), binary.delta(F.col("b"), 3), binary.blake2sp("x"), binary.crc64("x")
    ).collect()
    for d, r in zip(data, got):
        s = 0
        for b in d:
            s = (s + b) & 65535
            s = (s << 1 | s >> 15) & 65535
        assert r[0] == list(d) and r[1] == s and r[2] == zlib.crc32(d)
        sectors = [d[k : k + 512].ljust(512, b"\0") for k in range(0, len(d), 512)]
        assert r[3] == [~zlib.crc32(x) & 65535 for x in sectors]
        assert binary.undelta(np.array(r[4], np.uint8), 3).tobytes() == d
        assert len(r[5]) == 64
    assert binary.crc64_bytes(b"123456789") == 0x995DC9BBDF1939FA
    assert binary.blake2sp_bytes(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


def test_vint(spark):
    n = [0, 1, 127, 128, 300, 16383, 16384, 1 << 40]

    def encode(x):
        out = bytearray()
        while True:
            x, low = x >> 7, x & 127
            out.append(low | (128 if x else 0))
            if not x:
                return out.hex().upper()

    assert values(spark, n, binary.vint(F.col("x")), "x long") == [encode(x) for x in n]
    assert values(spark, n, binary.vint_size(F.col("x")), "x long") == [len(encode(x)) // 2 for x in n]


def test_parity_repairs_what_is_lost():
    rng = np.random.default_rng(2)
    shards = [rng.bytes(64) for _ in range(6)]
    parity = volumes.encode_parity(shards, 3)
    for lost in ([0], [5, 2], [1, 3, 4]):
        held = [None if k in lost else s for k, s in enumerate(shards)]
        assert volumes.repair(held, {k: parity[k] for k in range(3 - len(lost), 3)}) == shards
    with pytest.raises(ValueError):
        volumes.repair([None] * 4 + shards[4:], dict(enumerate(parity)))


def test_kdf_matches_pbkdf2():
    key, _, tap = binary.kdf(b"secret", b"salt" * 4, 10)
    assert key == hashlib.pbkdf2_hmac("sha256", b"secret", b"salt" * 4, 1 << 10)
    check = binary.password_check(tap)
    assert check[8:] == hashlib.sha256(check[:8]).digest()[:4]
    with pytest.raises(ValueError):
        binary.kdf(b"", b"", 25)
    assert re.fullmatch("[0-9a-f]{64}", key.hex())
