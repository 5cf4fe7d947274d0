import itertools

import pytest
from pyspark.sql import functions as F

from vellum.operators import chains, diff, listing, order, select, volumes
from vellum.plans import control, registry
from vellum.plans.catalog import running_total


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_info_of_empty_catalog(spark):
    empty = spark.createDataFrame([], "size long, packed_size long")
    assert rows(listing.info(empty)) == [(0, 0, 0, 0.0)]


def test_update_compares_the_first_of_a_name(spark):
    members = spark.createDataFrame([(1, "a", 10), (2, "a", 30), (3, "b", 10)], "ord long, name string, mtime_s long")
    sources = spark.createDataFrame([("a", 1, 20), ("b", 1, 10), ("c", 1, 1)], "name string, size long, mtime_s long")
    assert rows(diff.update(members, sources)) == [("a", 1, 20, "replace"), ("c", 1, 1, "add")]
    assert rows(diff.update(members, sources, add_missing=False)) == [("a", 1, 20, "replace")]
    assert rows(diff.stale(members, sources.where("name <> 'b'"))) == [(3, "b")]


def test_dedup_and_edits(spark):
    members = spark.createDataFrame([(1, "a", 2, "xy"), (2, "b", 2, "xy"), (3, "c", 2, "xz"), (4, "a", 2, "xy")], "ord long, name string, size long, text string")
    assert [(r.ord, r.first_ord, r.redirect) for r in diff.identical(members).orderBy("ord").collect()] == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 1, True)]
    names = spark.createDataFrame([(1, "a"), (2, "b")], "line long, name string")
    assert [r.ord for r in diff.delete_nth(members, names).orderBy("ord").collect()] == [3, 4]
    assert diff.resolve_chain([("a", "b"), ("b", "c")]) == [("a", "c")]
    again = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "zz")], "line long, name string")
    with pytest.raises(LookupError, match="'a'"):
        diff.delete_nth(members, again)
    assert rows(diff.unmatched_deletes(members, again)) == [(3, "a"), (4, "zz")]
    assert diff.unique(members, "b") == 2
    for name in ("a", "none"):
        with pytest.raises(LookupError):
            diff.unique(members, name)
    edits = spark.createDataFrame([(1, "delete", None), (1, "rename", "x")], "ord long, kind string, value string")
    with pytest.raises(ValueError, match="delete,rename"):
        diff.apply_edits(members, edits)
    with pytest.raises(ValueError, match="comment"):
        diff.apply_edits(members, spark.createDataFrame([(None, "comment", "x"), (None, "comment", "x")], "ord long, kind string, value string"))
    assert diff.apply_edits(members, spark.createDataFrame([(k, "delete", None) for k in (1, 2, 3, 4)], "ord long, kind string, value string")).count() == 0


def test_free_names_of_hidden_files(spark):
    wanted = spark.createDataFrame([(1, "d/.rc"), (2, "a.b/c"), (3, "x.")], "ord long, name string")
    got = diff.auto_rename(wanted, wanted.select("name"))
    assert [r.free_name for r in got.orderBy("ord").collect()] == ["d/.rc(1)", "a.b/c(1)", "x(1)."]


def test_rename_plans_of_any_size(spark):
    members = spark.createDataFrame([(k, f"d{k % 7}/e/{k}") for k in range(50)], "ord long, name string")
    plan = [(f"d{k % 7}/e/{k}", f"n{k}") for k in range(0, 4000, 2)] + [("d1", "one"), ("d1/e", "deep")]
    got = {r.ord: r.new_name for r in diff.rename(members, plan).collect()}
    assert got == {k: f"n{k}" if k % 2 == 0 else f"deep/{k}" if k % 7 == 1 else f"d{k % 7}/e/{k}" for k in range(50)}


def test_extraction_policies(spark):
    members = spark.createDataFrame([(1, "a", False, 20), (2, "b", False, 10), (3, "c", False, None), (4, "d", False, 5), (5, "e", True, 1)], "ord long, name string, is_dir boolean, mtime_ns long")
    there = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), ("e", 9)], "name string, mtime_ns long")
    acts = lambda p: [r.action for r in select.destinations(members, there, p).orderBy("ord").collect()]
    assert acts("overwrite") == ["extract"] * 4 + ["directory"] and acts("skip") == ["skip"] * 3 + ["extract", "skip"]
    assert acts("freshen") == ["extract", "skip", "skip", "skip", "directory"] and acts("update") == ["extract", "skip", "skip", "extract", "directory"]
    assert [r.target for r in select.destinations(members, there, "rename").orderBy("ord").collect()] == ["a(1)", "b(1)", "c(1)", "d", "e"]


def test_merged_ranges(spark):
    import random

    rng = random.Random(3)
    got = [(rng.randrange(4), a, a + rng.randrange(1, 6)) for a in (rng.randrange(120) for _ in range(90))]
    cells_ = {(k, x) for k, a, b in got for x in range(a, b)}
    merged = chains.merge_ranges(spark.createDataFrame(got, "key long, lo long, hi long")).collect()
    assert sum(r.hi - r.lo for r in merged) == len(cells_) and {(r.key, x) for r in merged for x in range(r.lo, r.hi)} == cells_
    assert not any(a.key == b.key and a.hi == b.lo for a in merged for b in merged)


def test_chains_equal_a_walk(spark):
    import random

    rng = random.Random(6)
    rows_ = [(k, rng.random() < 0.3, rng.random() < 0.6) for k in range(80)]

    def walk(i, for_replace):
        p = next((k for k in range(i, 80) if not rows_[k][1]), None)
        if p is None:
            return None
        first = last = p
        while rows_[first][2]:
            before = next((k for k in range(first - 1, -1, -1) if not rows_[k][1]), None)
            if before is None:
                break
            first = before
        while (after := next((k for k in range(last + 1, 80) if not rows_[k][1]), None)) is not None and rows_[after][2]:
            last = after
        return (i, first, last) if i < last or (for_replace and rows_[last][2]) else None

    members = spark.createDataFrame(rows_, "ord long, is_dir boolean, solid boolean")
    for for_replace in (False, True):
        assert rows(chains.chain_ranges(members, for_replace)) == [w for w in (walk(i, for_replace) for i in range(80)) if w]


def test_volume_sets(spark):
    names = ["a.part1.rar", "a.part2.rar", "a.part10.rar", "b.part01.rar", "B.PART02.RAR", "b.part3.rar", "c.rar", "c.r00", "c.r02", "d.part2.rar", "e.part1.exe", "e.part1.rar", "f.r00", "g.txt"]
    got = rows(chains.volume_sets(spark.createDataFrame([(n,) for n in names], "path string")))
    assert got == sorted([("a", 1, "a.part1.rar"), ("a", 2, "a.part2.rar"), ("b", 1, "b.part01.rar"), ("b", 2, "B.PART02.RAR"), ("c", 1, "c.rar"), ("c", 2, "c.r00"), ("e", 1, "e.part1.rar")])


def test_controls(spark):
    import time

    assert control.threads(None, 0, 8) == 8 and control.threads(2, 4, 8) == 2 and control.threads(None, 4, 8) == 4
    with control.partitions(spark, 3) as n:
        assert n == 3 and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    seen = []
    c = control.Control(spark)
    slow = spark.range(0, 64, 1, 64).select(F.expr("java_method('java.lang.Thread', 'sleep', 40L)"))
    control.wait(c, lambda: slow.write.format("noop").mode("overwrite").save(), 0.05, lambda a, b: seen.append((a, b)))
    assert seen == sorted(seen) and seen[-1][1] >= 1
    began = time.time()
    with pytest.raises(control.Cancelled):
        control.wait(control.Control(spark, seconds=1.0), lambda: spark.range(0, 4000, 1, 400).select(F.expr("java_method('java.lang.Thread', 'sleep', 100L)")).write.format("noop").mode("overwrite").save())
    assert time.time() - began < 30
    states = spark.createDataFrame([(1, "ok"), (2, "checksum")], "ord long, state string")
    assert control.by_policy(states, "collect").count() == 2
    with pytest.raises(Exception, match="member failed: checksum"):
        control.by_policy(states, "abort").collect()


def test_auto_rename(spark):
    wanted = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b"), (4, ".rc")], "ord long, name string")
    taken = spark.createDataFrame([("b",)], "name string")
    assert [r.free_name for r in diff.auto_rename(wanted, taken).orderBy("ord").collect()] == ["a.txt", "a(1).txt", "b(1)", ".rc"]


def test_auto_rename_skips_numbers_in_use(spark):
    names = ["a.txt", "a.txt", "a(1).txt", "a.txt", "a(1).txt", "c.d", "c.d", "a.txt", "e"]
    held = ["a(3).txt", "c.d(1)", "e", "e(1)", "e(02)", "e(2).x"]
    wanted = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    got = [r.free_name for r in diff.auto_rename(wanted, spark.createDataFrame([(t,) for t in held], "name string")).orderBy("ord").collect()]
    assert got == ["a.txt", "a(2).txt", "a(1).txt", "a(4).txt", "a(1)(1).txt", "c.d", "c(1).d", "a(5).txt", "e(2)"]
    assert len(set(got)) == len(got) and not set(got) & set(held)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_running_total_for_any_number_of_partitions(spark, parts):
    df = spark.createDataFrame([(k, k * k % 7) for k in range(50)], "ord long, v long")
    got = {r.ord: r.at for r in running_total(df.repartition(parts), "ord", "v", "at", parts).collect()}
    sums = [0, *itertools.accumulate(k * k % 7 for k in range(50))]
    assert got == {k: sums[k] for k in range(50)}


def test_merge_reports_each_fault(spark):
    good = [(1, 0, 0, 10, True, False), (1, 1, 10, 20, False, True)]
    faults = [(2, 1, 5, 9, False, True), (3, 0, 0, 5, True, False), (4, 0, 0, 5, True, False), (4, 2, 9, 12, False, True), (5, 0, 0, 5, True, False), (5, 1, 4, 9, False, True), (6, 0, 0, 0, True, True)]
    df = spark.createDataFrame(good + faults, "ord long, volume long, lo long, hi long, is_first boolean, is_final boolean")
    assert {r.ord: r.state for r in volumes.merge_fragments(df).collect()} == {1: "ok", 2: "no start", 3: "no end", 4: "gap", 5: "overlap", 6: "ok"}


def test_mask_order_prefers_the_narrower_mask(spark):
    df = spark.createDataFrame([(1, "d/a.md"), (2, "d/1.md"), (3, "x.txt"), (4, "y.LOG")], "ord long, name string")
    got = {r.ord: r.place for r in order.mask_order(df, ["*.md", "$default", "*.LOG", "*1.md"]).collect()}
    assert got == {1: 0, 2: 3, 3: 1, 4: 2}
    assert {r.place for r in order.mask_order(df, ["*.md"]).where("ord > 2").collect()} == {1}


def test_budget(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate([5, 5, 5, 3, 1])], "ord long, size long")
    assert [order.budget_prefix(df, b).first()[0] for b in (4, 5, 11, 15, 18, 100)] == [0, 1, 2, 3, 4, 5]


def test_find(spark):
    df = spark.createDataFrame([(1, "a", "One\nTWO é\nthree"), (2, "b", ""), (3, "c", "É two")], "ord long, name string, text string")
    assert rows(listing.find_text(df, "two")) == [(1, "a", 1, "TWO é"), (3, "c", 0, "É two")]
    assert rows(listing.find_text(df, "two", case=True)) == [(3, "c", 0, "É two")]
    assert rows(listing.find_text(df, "é", case=False)) == [(1, "a", 1, "TWO é")]
    assert rows(listing.find_hex(df, "54776f")) == [(1, "a"), (3, "c")]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_twin(spark, small, name):
    import duckdb

    df = registry.QUERIES[name](spark, small)
    got = sorted(([r[c] for c in sorted(df.columns)] for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got, name
        return
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    result = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    order_ = [columns.index(c) for c in sorted(columns)]
    want = sorted(([r[k] for k in order_] for r in result.fetchall()), key=repr)
    assert sorted(columns) == sorted(df.columns) and repr(got) == repr(want)


def test_entry(spark):
    assert registry.entry(spark).count() == 1
    assert F is not None
