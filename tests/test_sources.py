import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import volumes
from vellum.sources import container, lists, sinks
from vellum.streaming import assemble


def archive(*members, end=b""):
    return container.SIGNATURE + container.block(container.MAIN, container.vint(0)) + b"".join(container.member_block(*m) for m in members) + container.block(container.END, container.vint(0)) + end


@given(st.integers(0, 1 << 62))
def test_numbers_round_trip(n):
    raw = container.vint(n)
    assert container.read_vint(raw, 0) == (n, len(raw))


@given(st.lists(st.tuples(st.text(max_size=20), st.binary(max_size=300), st.integers(0, 1 << 31), st.integers(0, 300)), max_size=5), st.binary(max_size=40))
def test_members_round_trip(members, tail):
    found = list(container.blocks(archive(*members, end=tail)))
    assert [(r["name"], r["payload"], r["mtime_s"], r.get("version", 0), r["state"]) for r in found] == [(n, d, t, v, "ok") for n, d, t, v in members]


def test_damage():
    data = archive(("a", b"1" * 50, 1), ("b", b"2" * 50, 2), ("c", b"3" * 50, 3))
    rows = list(container.blocks(data))
    bad = bytearray(data)
    bad[rows[1]["offset"] + 6] ^= 1  # header of b
    assert [(r.get("name"), r["state"]) for r in container.blocks(bytes(bad))] == [("a", "ok"), (None, "bad header")]
    assert [r.get("name") for r in container.blocks(bytes(bad), salvage=True)] == ["a", None, "c"]
    bad = bytearray(data)
    bad[rows[2]["offset"] - 1] ^= 1  # last byte of b
    assert [r["state"] for r in container.blocks(bytes(bad))] == ["ok", "crc", "ok"]
    cut = data[: rows[2]["offset"] + 60]
    assert [r["state"] for r in container.blocks(cut)][-1] == "truncated"
    assert [r["state"] for r in container.blocks(b"")] == ["no signature"]


def test_write_bounds_containers_and_keeps_the_order(spark):
    rows = [(k, f"m{k}", None if k == 3 else b"x" * (k * 10), k, None if k % 2 else 2) for k in range(20)]
    made = container.write(spark.createDataFrame(rows, "ord long, name string, data binary, mtime_s long, version long"), 300)
    found = container.scan(made, path="archive").collect()
    assert {r.state for r in found} == {"ok"}
    assert len({r.path for r in found}) > 3
    names = [r.name for r in sorted(found, key=lambda r: (int(r.path), r.block))]
    assert names == [f"m{k}" for k in range(20)]
    empty = container.write(made.limit(0).select(F.lit(1).alias("ord"), F.lit("").alias("name"), F.lit(b"").alias("data"), F.lit(1).alias("mtime_s"), F.lit(1).alias("version")))
    assert container.scan(empty, path="archive").count() == 0


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"a stub" + archive(("x/y", b"data", 5, 7)))
    (tmp_path / "two.bin").write_bytes(b"nothing")
    rows = container.scan(lists.read_files(spark, str(tmp_path))).orderBy("path").collect()
    assert [(os.path.basename(r.path), r.name, r.version, r.state) for r in rows] == [("one.bin", "x/y", 7, "ok"), ("two.bin", None, None, "no signature")]


@pytest.mark.parametrize(
    ("data", "found"),
    [(b"", None), (b"..RE~^", ("v13", 2)), (b"RE~^" + container.SIGNATURE_OLD, ("v15", 4)), (container.SIGNATURE_OLD + container.SIGNATURE, ("v15", 0)), (b"\xff\xe9" + container.SIGNATURE + container.SIGNATURE_OLD, ("v50", 2))],
)
def test_start(spark, data, found):
    got = spark.createDataFrame([(data,)], "c binary").select(container.start(F.col("c")).alias("s")).first().s
    assert (tuple(got) if got else None) == found


def test_lines(spark):
    files = [("1", "a b // note\r\n\r\n  // all\nc".encode("utf-16")), ("2", "é ".encode("latin-1")), ("3", None), ("4", b"")]
    df = spark.createDataFrame(files, "path string, content binary")
    assert sorted((r.path, r.line_no, r.line) for r in lists.list_lines(df).collect()) == [("1", 0, "a b"), ("1", 3, "c"), ("2", 0, "é")]
    masks = spark.createDataFrame([("m", b" *.txt \n$default ; rest\n;x\n")], "path string, content binary")
    assert [(r.line, r.is_default) for r in lists.order_lines(masks).orderBy("line_no").collect()] == [("*.txt", False), ("$default", True)]
    assert [r.line for r in lists.mask_lines(masks).orderBy("line_no").collect()] == ["*.txt", "$default ; rest", ";x"]


def test_walk_lists_all_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("12345")
    (tmp_path / "c").write_text("1")
    (tmp_path / "a" / "empty é 1").write_text("")
    found = lists.walk(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.size) for r in found) == [("a/b.txt", 5), ("a/empty é 1", 0), ("c", 1)] and all(r.mtime_s > 1 << 30 for r in found)


def test_assembly_of_a_stream_is_that_of_the_table(spark, tmp_path):
    rows = [(1, 0, 0, 10, True, False), (1, 1, 10, 30, False, True), (2, 1, 30, 40, True, False), (3, 2, 50, 60, False, True), (4, 2, 60, 70, True, False), (4, 4, 80, 90, False, True)]
    df = spark.createDataFrame(rows, "ord long, volume long, lo long, hi long, is_first boolean, is_final boolean")
    path = str(tmp_path / "fragments")
    df.repartition(6).write.parquet(path)
    stream = lambda p: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(p)
    want = sorted(tuple(r) for r in volumes.merge_fragments(df).collect())
    assert sorted(tuple(r) for r in assemble.assemble(stream(path)).collect()) == want
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert assemble.assemble(stream(str(tmp_path / "none"))).count() == 0


def test_catalog_passes_payloads_by(spark, tmp_path):
    members = [("a", b"x" * 100_000, 5), ("d", b"", 6, 0, True), ("é" * 9000, b"yz", 7, 2)]
    whole = archive(*members)
    (tmp_path / "whole").write_bytes(b"stub" + whole)
    (tmp_path / "cut").write_bytes(whole[:50_000])
    (tmp_path / "none").write_bytes(b"text")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("whole", "cut", "none")] + [(None,)], "path string")
    got = sorted((r.path.rsplit("/", 1)[1], r.block, (r.name or "")[:2], r.size, r.mtime_s, r.version, r.state) for r in container.catalog(files).collect())
    assert got == [("cut", 0, "a", 100_000, 5, None, "truncated"), ("none", 0, "", None, None, None, "no signature"), ("whole", 0, "a", 100_000, 5, None, "listed"), ("whole", 1, "d", 0, 6, None, "listed"), ("whole", 2, "éé", 2, 7, 2, "listed")]


def test_members_become_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b", b"12"), (2, "./c", b""), (3, "../x", b"no"), (4, "n", None), (5, "a", b"a folder is there")], "ord long, target string, payload binary")
    (tmp_path / "a").mkdir()
    got = sorted(tuple(r) for r in sinks.extract(rows, str(tmp_path)).collect())
    assert got == [(1, "a/b", 2, "written"), (2, "./c", 0, "corrected"), (3, "../x", 2, "refused"), (4, "n", 0, "failed"), (5, "a", 17, "failed")]
    assert (tmp_path / "a" / "b").read_bytes() == b"12" and sorted(os.listdir(tmp_path)) == ["a", "c"]
    assert list(sinks.printed(rows.where("payload is not null"))) == [b"12", b"", b"no", b"a folder is there"]
    sinks.log_names(rows.withColumn("name", F.col("target")), str(tmp_path / "log"))
    sinks.log_names(rows.where("ord = 4").withColumn("name", F.col("target")), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == sorted(["a/b", "./c", "../x", "n", "a", "n"])
    sinks.log_names(rows.where("ord = 4").withColumn("name", F.lit("é")), str(tmp_path / "log16"), utf16=True)
    assert "é" in b"".join(f.read_bytes() for f in (tmp_path / "log16").glob("part-*")).decode("utf-16-le")


def test_tables_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "table")
    first = spark.range(5).withColumnRenamed("id", "ord")
    sinks.commit(first, root)
    broken = first.select(F.when(F.col("ord") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("ord")).alias("ord"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit(broken, root)
    assert sorted(r.ord for r in sinks.current(spark, root).collect()) == list(range(5))
    old = sinks.current(spark, root)
    sinks.append(spark.createDataFrame([(7,), (9,)], "ord long"), root)
    assert sorted(r.ord for r in sinks.current(spark, root).collect()) == [0, 1, 2, 3, 4, 5, 7] and old.count() == 5
    sinks.clean(spark, root)
    assert len([n for n in os.listdir(root) if n.startswith("data-")]) == 1 and sinks.current(spark, root).count() == 7
    with pytest.raises(Exception):
        sinks.current(spark, str(tmp_path / "nothing"))
