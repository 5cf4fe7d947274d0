"""The registered queries of the catalog operators, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import binary, cells, filters, parse, paths
from vellum.operators import chains, diff, listing, order, ranges, select, volumes
from vellum.plans.catalog import CHUNKS_SQL, MEMBERS_SQL, SNAPSHOT_SQL, chunks, members, snapshot, table
from vellum.sources import container, lists, sinks
from vellum.streaming import assemble

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


M = f"WITH {MEMBERS_SQL} "
S = f"WITH {SNAPSHOT_SQL} "
C = f"WITH {CHUNKS_SQL} "
_EXT = "regexp_extract(split_part(name, '/', -1), '\\.([^.]*)$', 1)"


# Listings

@query(M + "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(packed_size) AS BIGINT) AS packed_size, round(CAST(sum(packed_size) AS BIGINT) * 100.0::DOUBLE / CAST(sum(size) AS BIGINT), 1) AS ratio FROM members")
def catalog_info(s, d):
    return listing.info(members(s, d))


@query(M + "SELECT source, lang, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(packed_size) AS BIGINT) AS packed_size FROM members GROUP BY ROLLUP (source, lang)")
def list_rollup(s, d):
    return listing.totals(members(s, d))


_METHOD = "CASE method WHEN 0 THEN 'Store' WHEN 1 THEN 'Fastest' WHEN 2 THEN 'Fast' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Good' WHEN 5 THEN 'Best' ELSE 'Unknown' END"


@query(M + f"SELECT ord, CASE WHEN version > 0 THEN name || ';' || version ELSE name END AS name, size, packed_size, CASE WHEN size = 0 THEN 0 ELSE packed_size * 100 // size END AS ratio, strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') AS time, {_METHOD} AS method FROM members")
def list_cells(s, d):
    return listing.listing(members(s, d))


_BYTES = "CASE WHEN {0} % 1073741824 = 0 THEN ({0} // 1073741824) || 'g' WHEN {0} % 1048576 = 0 THEN ({0} // 1048576) || 'm' WHEN {0} % 1024 = 0 THEN ({0} // 1024) || 'k' ELSE CAST({0} AS VARCHAR) END"
_DICT = _BYTES.format("(131072 * CAST(pow(2, method) AS BIGINT))")


@query(
    M + f"""SELECT ord, unnest(['Name','Type','Size','Packed size','Compression','MD5']) AS field,
    unnest([name, 'File', CAST(size AS VARCHAR), CAST(packed_size AS VARCHAR), 'RAR 5.0(v50) -m' || method || ' -md=' || {_DICT}, md5]) AS value FROM members"""
)
def unpivot_technical(s, d):
    return listing.technical(members(s, d))


@query(C + "SELECT volume, ord, name, hi - lo AS bytes, CASE WHEN lo = first AND hi = first + packed_size THEN '' WHEN lo = first THEN '-->' WHEN hi = first + packed_size THEN '<--' ELSE '<->' END AS arrow FROM chunks")
def volume_split(s, d):
    return listing.volume_listing(chunks(s, d))


@query(C + "SELECT volume, count(*) FILTER (lo = first) AS files, coalesce(CAST(sum(size) FILTER (lo = first) AS BIGINT), 0) AS size, count(*) AS fragments, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM chunks GROUP BY volume")
def volume_totals(s, d):
    return listing.volume_totals(chunks(s, d))


# Written out by hand: nothing is taken from the expressions they are compared with.
_MODE_SQL = """SELECT p_partkey,
  CASE m // 4096 WHEN 4 THEN 'd' WHEN 10 THEN 'l' WHEN 1 THEN 'p' WHEN 2 THEN 'c' WHEN 6 THEN 'b' ELSE '-' END
  || CASE WHEN m & 256 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 128 > 0 THEN 'w' ELSE '-' END || CASE m & 2112 WHEN 2112 THEN 's' WHEN 2048 THEN 'S' WHEN 64 THEN 'x' ELSE '-' END
  || CASE WHEN m & 32 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 16 > 0 THEN 'w' ELSE '-' END || CASE m & 1032 WHEN 1032 THEN 's' WHEN 1024 THEN 'S' WHEN 8 THEN 'x' ELSE '-' END
  || CASE WHEN m & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN m & 2 > 0 THEN 'w' ELSE '-' END || CASE m & 513 WHEN 513 THEN 't' WHEN 512 THEN 'T' WHEN 1 THEN 'x' ELSE '-' END AS mode
FROM (SELECT p_partkey, [32768, 16384, 40960, 4096, 8192, 24576, 49152][p_size % 7 + 1] + p_partkey * 37 % 4096 AS m FROM part)"""


@query(_MODE_SQL)
def mode_string(s, d):
    kind = F.element_at(F.array(*map(F.lit, (32768, 16384, 40960, 4096, 8192, 24576, 49152))), (F.col("p_size") % 7 + 1).cast("int"))
    mode = kind + F.col("p_partkey") * 37 % 4096
    # Every second one as the middle formats have it, in the high word.
    return table(s, d, "part").select("p_partkey", cells.unix_mode(F.when(F.col("p_partkey") % 2 == 0, mode * 65536).otherwise(mode)).alias("mode"))


@query("""SELECT p_partkey, CASE WHEN a & 8192 > 0 THEN 'I' ELSE '.' END || '.' || CASE WHEN a & 32 > 0 THEN 'A' ELSE '.' END || CASE WHEN a & 16 > 0 THEN 'D' ELSE '.' END
  || CASE WHEN a & 4 > 0 THEN 'S' ELSE '.' END || CASE WHEN a & 2 > 0 THEN 'H' ELSE '.' END || CASE WHEN a & 1 > 0 THEN 'R' ELSE '.' END AS attributes FROM (SELECT p_partkey, p_partkey * 131 % 16384 AS a FROM part)""")
def dos_string(s, d):
    return table(s, d, "part").select("p_partkey", cells.dos_attributes(F.col("p_partkey") * 131 % 16384).alias("attributes"))


@query(f"SELECT o_orderkey, {_BYTES.format('n')} AS cell FROM (SELECT o_orderkey, o_orderkey % 5000 * 256 AS n FROM orders)")
def byte_count_cell(s, d):
    return table(s, d, "orders").select("o_orderkey", cells.byte_count(F.col("o_orderkey") % 5000 * 256).alias("cell"))


@query("SELECT p_partkey, CASE p_size % 7 WHEN 1 THEN 'Unix symbolic link' WHEN 2 THEN 'Windows symbolic link' WHEN 3 THEN 'NTFS junction point' WHEN 4 THEN 'Hard link' WHEN 5 THEN 'File reference' ELSE CASE WHEN p_size % 2 = 0 THEN 'Directory' ELSE 'File' END END AS type FROM part")
def member_type(s, d):
    return table(s, d, "part").select("p_partkey", cells.member_type(F.col("p_size") % 7, F.col("p_size") % 2 == 0).alias("type"))


@query(M + "SELECT m.ord, m.name, s.turn AS stream, CAST(octet_length(encode(s.text)) AS BIGINT) AS stream_size FROM members m LEFT JOIN conversations s ON s.conv_id = m.ord")
def streams_join(s, d):
    streams = table(s, d, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("stream"), F.octet_length("text").cast("long").alias("stream_size"))
    return listing.with_streams(members(s, d).select("ord", "name"), streams)


# Selection

@query(M + r"SELECT ord, name FROM members WHERE regexp_matches(name, '^src1.*\.md$') OR regexp_matches(split_part(name, '/', -1), '^src1.*\.md$')")
def select_mask(s, d):
    return members(s, d).where(paths.selector(F.col("name"), "src1*.md")).select("ord", "name")


@query(M + "SELECT ord, name FROM members WHERE name = 'src3/fr' OR starts_with(name, 'src3/fr/') OR name = 'src1/en/00000001.md' OR starts_with(name, 'src1/en/00000001.md/')")
def select_path(s, d):
    return members(s, d).where(paths.any_selector(F.col("name"), ["src3\\fr\\", "src1/en/00000001.md"])).select("ord", "name")


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/en/.*$') AND NOT (regexp_matches(url, '^.*\.html$') OR regexp_matches(split_part(url, '/', -1), '^.*\.html$')) AND NOT regexp_matches(url, '^.*/7..$') AND NOT regexp_matches(split_part(url, '/', -1), '^7..$')")
def include_exclude(s, d):
    return table(s, d, "pages").where(paths.include_exclude(F.col("url"), ["*/en/*"], ["*.html", "7??"])).select("page_id", "url")


@query(M + "SELECT ord, name, ends_with(name, '.txt') OR regexp_matches(lower(split_part(name, '/', -1)), '^.*\\.log$') AS stored FROM members")
def store_types(s, d):
    return members(s, d).select("ord", "name", paths.store_match(F.col("name"), ["txt", "*.log"]).alias("stored"))


@query(M + "SELECT ord, name, size FROM members WHERE ord % 9 = 0 OR (size < 5000 AND size > 1000)")
def size_filter(s, d):
    files = members(s, d).withColumn("is_dir", F.col("ord") % 9 == 0)
    return select.by_size(files, less=parse.size("5000"), more=parse.size("1000")).select("ord", "name", "size")


def _micros(ts):
    """Microseconds of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _timed(s, d):
    """Events as files: three times in nanoseconds, each eleventh a directory."""
    us = _micros(F.col("ts"))
    return table(s, d, "events").select(
        F.col("event_id").alias("ord"), (F.col("event_id") % 11 == 0).alias("is_dir"),
        (us * 1000 + F.col("event_id") % 1000).alias("mtime_ns"), (us * 1000 - F.col("user_id") * 86_400_000_000_000).alias("ctime_ns"), F.when(F.col("event_id") % 5 > 0, us * 1000).alias("atime_ns"),
    )


_TIMED = "WITH e AS (SELECT event_id AS ord, event_id % 11 = 0 AS is_dir, epoch_us(ts) * 1000 + event_id % 1000 AS m, epoch_us(ts) * 1000 - user_id * 86400000000000 AS c, CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) * 1000 ELSE 0 END AS a, (SELECT max(epoch_us(ts)) * 1000 FROM events) AS now FROM events)"


def _now(s, d):
    return table(s, d, "events").agg(F.max(_micros(F.col("ts")))).first()[0] * 1000


@query(_TIMED + " SELECT ord FROM e WHERE is_dir OR (m >= now - 864000000000000 AND c < now - 5184000000000000)")
def time_newer_older(s, d):
    return select.by_time(_timed(s, d), [("newer", "10d"), ("older", "c60d")], _now(s, d)).select("ord")


@query(_TIMED + " SELECT ord FROM e WHERE is_dir OR (m < now - 3600000000000 AND (c >= now - 2592000000000000 OR a >= now - 86400000000000))")
def time_or_group(s, d):
    # The later switch of a kind replaces the earlier one.
    return select.by_time(_timed(s, d), [("newer", "m1d"), ("newer", "oc30d"), ("newer", "oa24h"), ("older", "m1h")], _now(s, d)).select("ord")


@query("WITH e AS (SELECT event_id AS ord, ts FROM events), b AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS t FROM events) SELECT ord FROM e, b WHERE ord % 11 = 0 OR (ts >= t AND ts < t + INTERVAL 9 DAY)")
def time_after_before(s, d):
    start = table(s, d, "events").agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    at = lambda days: (start + timedelta(days=days)).replace(tzinfo=timezone.utc).astimezone().strftime("%Y-%m-%d %H:%M:%S")
    files = _timed(s, d).withColumn("ctime_ns", F.col("mtime_ns"))
    return select.by_time(files, [("before", at(10)), ("after", "c" + at(1))], 0).select("ord")


_TREE = "WITH f AS (SELECT p_partkey AS ord, 'd' || p_partkey % 7 || '/e' || p_partkey % 5 || '/' || p_name AS name, false AS is_dir FROM part WHERE p_partkey % 7 <> 3 AND (p_partkey % 7 <> 4 OR p_partkey % 5 = 1)), t AS (SELECT 'd' || i AS name FROM range(8) r(i) UNION ALL SELECT 'd' || i || '/e' || j FROM range(8) r(i), range(5) q(j))"


def _tree(s, d):
    p = F.col("p_partkey")
    files = table(s, d, "part").where((p % 7 != 3) & ((p % 7 != 4) | (p % 5 == 1))).select(p.alias("ord"), F.concat(F.lit("d"), (p % 7).cast("string"), F.lit("/e"), (p % 5).cast("string"), F.lit("/"), F.col("p_name")).alias("name"), F.lit(False).alias("is_dir"))
    deep = s.range(8).crossJoin(F.broadcast(s.range(5).withColumnRenamed("id", "j"))).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/e"), F.col("j").cast("string")).alias("name"))
    dirs = s.range(8).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("name")).union(deep).select(F.lit(None).cast("long").alias("ord"), "name", F.lit(True).alias("is_dir"))
    return files.unionByName(dirs)


@query(_TREE + " SELECT ord, name, is_dir FROM f UNION ALL SELECT NULL, name, true FROM t WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(f.name, t.name || '/'))")
def empty_dirs(s, d):
    return select.without_empty_directories(_tree(s, d))


@query(_TREE + " SELECT ord, name, is_dir FROM f WHERE NOT starts_with(name, 'd1/') AND name NOT LIKE '%/e2/%' UNION ALL SELECT NULL, name, true FROM t WHERE name <> 'd1' AND NOT starts_with(name, 'd1/') AND name NOT LIKE '%/e2'")
def directory_rules(s, d):
    return select.by_masks(_tree(s, d), [], ["d1", "*/e2"])


@query(_TREE + " SELECT ord, name, is_dir FROM f WHERE name LIKE '%/e0/%' AND NOT starts_with(name, 'd1/')")
def directory_rules_include(s, d):
    return select.by_masks(_tree(s, d), ["*/e0/*"], ["d1"])


@query(M + "SELECT ord, name FROM members WHERE version = 2")
def version_selection(s, d):
    return select.by_version(members(s, d), 2).select("ord", "name")


@query(M + "SELECT ord, name FROM members WHERE version = 0")
def version_current(s, d):
    # The current member has no record.
    return select.by_version(members(s, d).withColumn("version", F.nullif(F.col("version"), F.lit(0)))).select("ord", "name")


@query("SELECT page_id, CASE WHEN len(list_filter(string_split(replace(u, '\\', '/'), '/'), lambda p: p = '..')) = 0 AND NOT starts_with(u, '/') THEN array_to_string(list_filter(string_split(replace(u, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.'), '/') END AS path FROM (SELECT page_id, replace(replace(substr(url, strpos(url, '//') + CAST(page_id % 2 AS INTEGER) + 1), '/en/', '/../'), '/fr/', '/./') AS u FROM pages)")
def path_sanitise(s, d):
    u = F.expr("substring(url, locate('//', url) + cast(page_id % 2 as int) + 1)")
    u = F.replace(F.replace(u, F.lit("/en/"), F.lit("/../")), F.lit("/fr/"), F.lit("/./"))
    return table(s, d, "pages").select("page_id", paths.sanitize(u).alias("path"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(M + f"SELECT ord, name, CAST(k - 1 AS BIGINT) AS line_no, lines[k] AS line FROM (SELECT ord, name, string_split(text, chr(10)) AS lines FROM members) t, unnest(range(1, len(lines) + 1)) AS r(k) WHERE contains(translate(lines[k], {_AZ}), 'licensed')")
def find_ci(s, d):
    return listing.find_text(members(s, d), "LICENSED")


@query(M + "SELECT ord, name, CAST(k - 1 AS BIGINT) AS line_no, lines[k] AS line FROM (SELECT ord, name, string_split(text, chr(10)) AS lines FROM members) t, unnest(range(1, len(lines) + 1)) AS r(k) WHERE contains(lines[k], 'The ')")
def find_cs(s, d):
    return listing.find_text(members(s, d), "The ", case=True)


@query(M + f"SELECT ord, name FROM members WHERE contains(translate(text, {_AZ}), 'license')")
def find_hex(s, d):
    return listing.find_hex(members(s, d), "4c6963656e7365")


# Two relations

@query(S + "SELECT s.name, s.size, s.mtime_s, CASE WHEN m.name IS NULL THEN 'add' ELSE 'replace' END AS action FROM snapshot s LEFT JOIN (SELECT name, arg_min(mtime_s, ord) AS t FROM members GROUP BY name) m USING (name) WHERE m.name IS NULL OR s.mtime_s > m.t")
def update_diff(s, d):
    return diff.update(members(s, d), snapshot(s, d))


@query(S + "SELECT s.name, s.size, s.mtime_s, 'replace' AS action FROM snapshot s JOIN (SELECT name, arg_min(mtime_s, ord) AS t FROM members GROUP BY name) m USING (name) WHERE s.mtime_s > m.t")
def freshen_diff(s, d):
    return diff.update(members(s, d), snapshot(s, d), add_missing=False)


@query(S + "SELECT ord, name FROM members WHERE name NOT IN (SELECT name FROM snapshot)")
def sync_stale(s, d):
    return diff.stale(members(s, d), snapshot(s, d))


@query(S + "SELECT name, size, mtime_s, 'kept' AS origin FROM members WHERE name NOT IN (SELECT name FROM snapshot) UNION ALL SELECT name, size, mtime_s, 'source' FROM snapshot")
def create_over(s, d):
    return diff.merge(members(s, d), snapshot(s, d))


@query(M + "SELECT ord, name, size, min(ord) OVER w AS first_ord, count(*) OVER w AS copies, ord <> min(ord) OVER w AS redirect FROM members WINDOW w AS (PARTITION BY size, text)")
def dedup_groups(s, d):
    return diff.identical(members(s, d))


@query(M + "SELECT count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS redirects, CAST(sum((n - 1) * size) AS BIGINT) AS saved_bytes FROM (SELECT size, text, count(*) AS n FROM members GROUP BY size, text)")
def dedup_summary(s, d):
    return diff.dedup_summary(members(s, d))


@query("WITH m AS (SELECT event_id, event_type || '-' || user_id AS name, row_number() OVER (PARTITION BY event_type || '-' || user_id ORDER BY event_id) AS k FROM events), n AS (SELECT 'click-' || c_custkey AS name, row_number() OVER (PARTITION BY c_custkey ORDER BY c_custkey) AS k FROM customer) SELECT event_id AS ord, name FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = m.name AND n.k = m.k)")
def delete_nth_duplicate(s, d):
    m = table(s, d, "events").select(F.col("event_id").alias("ord"), F.concat_ws("-", "event_type", "user_id").alias("name"))
    n = table(s, d, "customer").select(F.col("c_custkey").alias("line"), F.concat(F.lit("click-"), F.col("c_custkey").cast("string")).alias("name"))
    # Customers without a click have no member to delete.
    return diff.delete_nth(m, n, strict=False).select("ord", "name")


@query(M + "SELECT ord, name, CASE WHEN name = 'src1/en/00000001.md' THEN 'first.md' WHEN starts_with(name, 'src1/en/') THEN 'one/english' || substr(name, 8) WHEN starts_with(name, 'src1/') THEN 'one' || substr(name, 5) ELSE name END AS new_name FROM members")
def rename_prefix(s, d):
    plan = diff.resolve_chain([("src1", "uno"), ("src1/en", "one/english"), ("src1/en/00000001.md", "first.md"), ("uno", "one")])
    return diff.rename(members(s, d), plan).select("ord", "name", "new_name")


@query(M + "SELECT ord, name, lower(name) AS new_name FROM members WHERE name <> lower(name)")
def case_change(s, d):
    return diff.change_case(members(s, d))


@query(M + "SELECT ord, name, version + 1 AS version FROM members WHERE version + 1 <= 2")
def version_shift(s, d):
    return diff.shift_versions(members(s, d), 2)


@query(M + "SELECT ord, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT ord, kind FROM (SELECT ord, 'delete' AS kind FROM members WHERE size < 500 UNION ALL SELECT ord, 'rename' FROM members WHERE lang = 'en' UNION ALL SELECT ord, 'replace' FROM members WHERE version = 1)) GROUP BY ord HAVING count(*) > 1 AND bool_or(kind = 'delete')")
def edit_conflicts(s, d):
    m = members(s, d)
    kind = lambda where, k: m.where(where).select("ord", F.lit(k).alias("kind"))
    return diff.validate_edits(kind("size < 500", "delete").union(kind("lang = 'en'", "rename")).union(kind("version = 1", "replace")))


@query(r"WITH w AS (SELECT page_id AS ord, 'p' || page_id % 40 || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.htm' END AS name FROM pages), t AS (SELECT DISTINCT 'p' || n_nationkey || '.htm' AS name FROM nation), k AS (SELECT ord, w.name, row_number() OVER (PARTITION BY w.name ORDER BY ord) - 1 + CASE WHEN t.name IS NULL THEN 0 ELSE 1 END AS k FROM w LEFT JOIN t ON w.name = t.name) SELECT ord, name, CASE WHEN k = 0 THEN name WHEN ends_with(name, '.htm') THEN substr(name, 1, length(name) - 4) || '(' || k || ').htm' ELSE name || '(' || k || ')' END AS free_name FROM k")
def auto_rename(s, d):
    ext = F.when(F.col("page_id") % 3 == 0, "").otherwise(".htm")
    w = table(s, d, "pages").select(F.col("page_id").alias("ord"), F.concat(F.lit("p"), (F.col("page_id") % 40).cast("string"), ext).alias("name"))
    t = table(s, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit(".htm")).alias("name"))
    return diff.auto_rename(w, t)


# Checks and statistics

@query("SELECT count(*) AS checked, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, min(doc_id) FILTER (bad) AS first_failure, 'm' || min(doc_id) FILTER (bad) AS first_name, CASE WHEN bool_or(bad) THEN 3 ELSE 0 END AS exit_code FROM (SELECT doc_id, md5(text) <> md5(CASE WHEN n_chars % 97 = 0 THEN text || '!' ELSE text END) AS bad FROM documents)")
def verify_report(s, d):
    docs = table(s, d, "documents")
    stored = F.md5(F.when(F.col("n_chars") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"))
    state = F.when(F.md5(F.col("text").cast("binary")) == stored, "ok").otherwise("checksum")
    return select.verification_report(docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), state.alias("state")))


@query(M + "SELECT ord, name, row_number() OVER (ORDER BY lower(" + _EXT + "), lower(split_part(name, '/', -1)), size, lower(name), ord) AS position FROM members")
def solid_order(s, d):
    return order.solid_order(members(s, d))


@query(M + "SELECT lower(" + _EXT + ") AS extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, min(ord) AS first_ord FROM members GROUP BY 1")
def solid_groups(s, d):
    return order.solid_groups(members(s, d))


@query(M + "SELECT DISTINCT name, CAST(length(name) - length(replace(name, '/', '')) AS BIGINT) AS depth FROM (SELECT source AS name FROM members UNION SELECT source || '/' || lang FROM members)")
def dirs_deepest(s, d):
    m = members(s, d)
    dirs = m.select(F.col("source").alias("name")).union(m.select(F.concat_ws("/", "source", "lang"))).distinct()
    return order.deepest_first(dirs)


@query(M + r"SELECT ord, name, CASE WHEN regexp_matches(b, '^.*1\.md$') THEN 3 WHEN regexp_matches(b, '^.*\.md$') THEN 0 WHEN regexp_matches(b, '^.*\.LOG$') THEN 2 ELSE 1 END::BIGINT AS place FROM (SELECT ord, name, split_part(name, '/', -1) AS b FROM members)")
def mask_order(s, d):
    return order.mask_order(members(s, d), ["*.md", "$default", "*.LOG", "*1.md"])


@query(M + "SELECT count(*) AS members FROM (SELECT sum(size) OVER (ORDER BY size DESC, ord) AS upto FROM members) WHERE upto <= 1000000")
def budget_prefix(s, d):
    return order.budget_prefix(members(s, d), 1_000_000)


@query(C + "SELECT ord, count(*) AS fragments, min(volume) AS first_volume, max(volume) AS last_volume, CAST(sum(hi - lo) AS BIGINT) AS bytes, CASE WHEN max(CAST(lo = first AS INT)) = 0 THEN 'no start' WHEN max(CAST(hi = first + packed_size AS INT)) = 0 THEN 'no end' WHEN max(volume) - min(volume) + 1 > count(*) THEN 'gap' WHEN sum(hi - lo) > max(hi) - min(lo) THEN 'overlap' WHEN sum(hi - lo) < max(hi) - min(lo) THEN 'gap' ELSE 'ok' END AS state FROM chunks WHERE volume NOT IN (1, 3) GROUP BY ord")
def volume_merge(s, d):
    c = chunks(s, d).where(~F.col("volume").isin(1, 3))
    return volumes.merge_fragments(c.select("ord", "volume", "lo", "hi", (F.col("lo") == F.col("first")).alias("is_first"), (F.col("hi") == F.col("first") + F.col("packed_size")).alias("is_final")))


@query(M + "SELECT ord, least(greatest((size * 7 + 99) // 100, 1), size) AS volumes, greatest((size * 3 + 51199) // 51200, 2) AS slots FROM members")
def recovery_plan(s, d):
    return members(s, d).select("ord", volumes.recovery_volume_count(F.col("size"), 7).alias("volumes"), volumes.parity_slots(F.col("size"), 3).alias("slots"))


_STREAM_SQL = "(SELECT o_orderkey * 8 + k AS pos, CAST((o_custkey >> (8 * k)) & 255 AS INTEGER) AS b FROM orders, range(8) AS t(k))"


def _order_bytes(s, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", k)
    byte = F.floor(F.col("o_custkey") / F.pow(F.lit(256.0), F.col("k"))).cast("long") % 256
    return o.select((F.col("o_orderkey") * 8 + F.col("k")).alias("pos"), byte.cast("int").alias("b"))


@query(f"SELECT pos // 512 % 16 AS slot, pos % 512 AS at, CAST(bit_xor(b) AS INTEGER) AS parity FROM {_STREAM_SQL} GROUP BY 1, 2")
def xor_parity(s, d):
    return volumes.xor_parity(_order_bytes(s, d), 16)


@query("SELECT b, count(*) AS n FROM (SELECT unnest(list_transform(range(0, octet_length(encode(name))), lambda i: get_bit(encode(name)::BIT, (8 * i)::INT) * 128 + get_bit(encode(name)::BIT, (8 * i + 1)::INT) * 64 + get_bit(encode(name)::BIT, (8 * i + 2)::INT) * 32 + get_bit(encode(name)::BIT, (8 * i + 3)::INT) * 16 + get_bit(encode(name)::BIT, (8 * i + 4)::INT) * 8 + get_bit(encode(name)::BIT, (8 * i + 5)::INT) * 4 + get_bit(encode(name)::BIT, (8 * i + 6)::INT) * 2 + get_bit(encode(name)::BIT, (8 * i + 7)::INT))) AS b FROM (SELECT p_name || p_brand || p_type AS name FROM part)) GROUP BY b")
def byte_histogram(s, d):
    data = table(s, d, "part").select(F.concat("p_name", "p_brand", "p_type").cast("binary").alias("data"))
    return data.select(F.explode(binary.byte_array(F.col("data"))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, [(256 - x[1]) % 256, (256 + x[1] - x[3]) % 256, (256 + x[3] - x[5]) % 256, (256 - x[2]) % 256, (256 + x[2] - x[4]) % 256]::INTEGER[] AS delta FROM (SELECT o_orderkey, [o_custkey % 251, o_orderkey % 253, o_custkey % 241, o_orderkey % 239, o_custkey % 233] AS x FROM orders)")
def delta_encode(s, d):
    x = F.array(*[(F.col(c) % m).cast("int") for c, m in (("o_custkey", 251), ("o_orderkey", 253), ("o_custkey", 241), ("o_orderkey", 239), ("o_custkey", 233))])
    return table(s, d, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", binary.delta(F.col("x"), 2).alias("delta"))


@query("SELECT p_partkey, list_reduce(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: ascii(c))), lambda a, b: (((a + b) % 65536) * 2) % 65536 + ((a + b) % 65536) // 32768)::INTEGER AS sum16 FROM part")
def rolling_sum(s, d):
    return table(s, d, "part").select("p_partkey", binary.rolling_sum(binary.byte_array(F.col("p_name").cast("binary"))).alias("sum16"))


@query("SELECT o_orderkey, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X%02X', n % 128 + 128, n // 128) WHEN n < 2097152 THEN printf('%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384) ELSE printf('%02X%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384 % 128 + 128, n // 2097152) END AS vint FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)")
def vint_encode(s, d):
    return table(s, d, "orders").select("o_orderkey", binary.vint(F.col("o_orderkey") * 37).alias("vint"))


@query()
def crc32_members(s, d):
    text = F.col("text").cast("binary")
    return members(s, d).select("ord", F.crc32(text).alias("crc32"), binary.crc16(text).alias("crc16"), volumes.sector_tags(text).alias("tags"))


@query()
def hash_members(s, d):
    return members(s, d).select("ord", F.col("text").cast("binary").alias("data")).select("ord", binary.blake2sp("data").alias("blake2sp"), binary.crc64("data").alias("crc64"))


@query()
def stripe_parity(s, d):
    shards = members(s, d).select(F.floor(F.col("ord") / 8).cast("long").alias("stripe"), (F.col("ord") % 8).cast("int").alias("shard"), F.col("text").cast("binary").alias("bytes"))
    return volumes.stripe_parity(shards, 8, 3)


def _little_endian(n):
    """Four bytes of a number, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))


def _operand(data, at, size):
    """The number that the bytes of ``data`` from ``at`` on make, the lowest first."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + k, 1)) for k in reversed(range(size))]), 16, 10).cast("long")


@query("SELECT o_orderkey, CASE WHEN o_custkey + here < 16777216 THEN o_custkey + here ELSE o_custkey + 4278190080 END AS target, o_custkey AS back FROM (SELECT o_orderkey, o_custkey, (o_orderkey * 1117 + 1) % 16777216 AS here FROM orders)")
def x86_calls(s, d):
    at = F.col("o_orderkey") * 1117
    code = F.concat(F.unhex(F.lit("E8")), _little_endian(F.col("o_custkey")))
    moved = table(s, d, "orders").select("o_orderkey", filters.x86_filter(code, at).alias("code"))
    back = moved.select("o_orderkey", "code", filters.x86_filter(F.col("code"), at, inverse=True).alias("back"))
    return back.select("o_orderkey", _operand(F.col("code"), 2, 4).alias("target"), _operand(F.col("back"), 2, 4).alias("back"))


@query("SELECT o_orderkey, (o_custkey + (o_orderkey * 1117 // 4)) % 16777216 AS target, o_custkey AS back FROM orders")
def arm_branches(s, d):
    at = F.col("o_orderkey") * 1117
    code = F.concat(F.substring(_little_endian(F.col("o_custkey")), 1, 3), F.unhex(F.lit("EB")))
    moved = table(s, d, "orders").select("o_orderkey", filters.arm_filter(code, at).alias("code"))
    back = moved.select("o_orderkey", "code", filters.arm_filter(F.col("code"), at, inverse=True).alias("back"))
    return back.select("o_orderkey", _operand(F.col("code"), 1, 3).alias("target"), _operand(F.col("back"), 1, 3).alias("back"))


@query("SELECT doc_id, CAST(len(w) AS INTEGER) AS windows, CASE WHEN len(w) >= 64 THEN CAST(len(list_distinct(w)) * 100 // len(w) AS INTEGER) END AS percent FROM (SELECT doc_id, list_transform(range(0, octet_length(encode(coalesce(text, ''))) - 3, 16), lambda i: substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 8)) AS w FROM documents)")
def window_screen(s, d):
    data = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return data.select("doc_id", filters.window_count(F.col("data")).alias("windows"), filters.distinct_window_percent(F.col("data"), 64).alias("percent"))


@query("""WITH b AS (SELECT l_suppkey, list_transform(string_split(left(string_agg(l_returnflag || l_linestatus, '' ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus), 65536), ''), lambda c: ascii(c)) AS x FROM lineitem GROUP BY l_suppkey),
d AS (SELECT l_suppkey, len(x) AS n, len(list_distinct(x)) AS kinds, ch, list_transform(range(1, len(x) + 1), lambda i: ((CASE WHEN i > ch THEN x[i - ch] ELSE 0 END) - x[i] + 256) % 256) AS y FROM b, (SELECT unnest([1, 2, 3, 4, 6, 8, 9, 12, 16]) AS ch)),
t AS (SELECT l_suppkey, n, kinds, ch, CAST(list_sum(y) AS BIGINT) AS m, len(list_filter(y, lambda v: v <= 8)) AS z FROM d)
SELECT l_suppkey, CAST(max(m) FILTER (ch = 2) AS BIGINT) AS magnitude, CAST(max(z) FILTER (ch = 2) AS BIGINT) AS near_zero,
CASE WHEN max(n) >= 256 AND max(kinds) > 1 AND (max(z) = 0 OR 2 * max(z) >= max(n)) THEN CAST(min(m * 100 + ch) % 100 AS INTEGER) END AS channels FROM t GROUP BY l_suppkey""")
def delta_statistics(s, d):
    flags = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")))
    text = F.array_join(F.transform(flags, lambda x: F.concat(x["l_returnflag"], x["l_linestatus"])), "")
    data = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.substring(text, 1, filters.HEAD).cast("binary").alias("data"))
    found = data.select("l_suppkey", filters.delta_statistics(F.col("data"), 2).alias("sums"), filters.delta_channels(F.col("data")).alias("channels"))
    return found.select("l_suppkey", "sums.magnitude", "sums.near_zero", "channels")


# Sources, containers, streams

@query(M + "SELECT name, size, mtime_s, version, md5, 'ok' AS state FROM members")
def container_roundtrip(s, d):
    data = members(s, d).select("ord", "name", F.col("text").cast("binary").alias("data"), "mtime_s", "version")
    found = container.scan(container.write(data, 1 << 20), path="archive")
    return found.select("name", "size", "mtime_s", F.coalesce("version", F.lit(0).cast("long")).alias("version"), F.md5("payload").alias("md5"), "state")


@query(M + "SELECT name, size, mtime_s, version, 'listed' AS state FROM members")
def container_catalog(s, d):
    data = members(s, d).select("ord", "name", F.col("text").cast("binary").alias("data"), "mtime_s", "version")
    files = container.write(data, 1 << 20).select((F.col("archive")).alias("ord"), F.concat(F.col("archive").cast("string"), F.lit(".rar")).alias("target"), F.col("content").alias("payload"))
    root = ranges.shared_dir(s).removeprefix("file://") + "/archives-" + uuid.uuid4().hex
    written = ranges.written(sinks.extract(files, root), "written").select(F.concat(F.lit(root + "/"), "name").alias("path"))
    return container.catalog(written).select("name", "size", "mtime_s", F.coalesce("version", F.lit(0).cast("long")).alias("version"), "state")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'v15' ELSE 'v50' END AS family, CAST(CASE page_id % 4 WHEN 0 THEN NULL WHEN 3 THEN octet_length(encode(url)) + 6 ELSE octet_length(encode(url)) END AS BIGINT) AS at FROM pages")
def signature_start(s, d):
    long, old, weak = (F.lit(x) for x in (container.SIGNATURE, container.SIGNATURE_OLD, container.SIGNATURE_OLDEST))
    k, stub = F.col("page_id") % 4, F.col("url").cast("binary")
    data = F.when(k == 0, stub).when(k == 1, F.concat(stub, long)).when(k == 2, F.concat(stub, old)).otherwise(F.concat(stub, weak, F.lit(b"xx"), long))
    found = table(s, d, "pages").select("page_id", container.start(data).alias("start"))
    return found.select("page_id", "start.family", F.col("start.offset").cast("long").alias("at"))


@query("SELECT CAST(page_id AS VARCHAR) AS path, 0 AS line_no, 'docs/é' || page_id || '.txt' AS line FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 2, regexp_replace(split_part(url, '//', 1), '\\s+$', '') FROM pages WHERE regexp_replace(split_part(url, '//', 1), '\\s+$', '') <> ''")
def list_file_lines(s, d):
    text = F.concat(F.lit("docs/é"), F.col("page_id").cast("string"), F.lit(".txt // note\r\n  \n"), F.col("url"))
    k = F.col("page_id") % 4
    data = F.when(k == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))).when(k == 1, F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE")))
    data = data.when(k == 2, F.concat(F.lit(b"\xfe\xff"), F.encode(text, "UTF-16BE"))).otherwise(F.encode(text, "ISO-8859-1"))
    return lists.list_lines(table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), data.alias("content")))


@query(ORACLE_SQL["volume_merge"])
def stream_assemble(s, d):
    c = chunks(s, d).where(~F.col("volume").isin(1, 3))
    c = c.select("ord", "volume", "lo", "hi", (F.col("lo") == F.col("first")).alias("is_first"), (F.col("hi") == F.col("first") + F.col("packed_size")).alias("is_final"))
    path = ranges.written(c, "fragments").inputFiles()[0].rsplit("/", 1)[0]
    return assemble.assemble(s.readStream.schema(c.schema).option("maxFilesPerTrigger", "4").parquet(path))


@query(M + "SELECT ord, name, size, CASE WHEN size > 20000 THEN 'member too large' WHEN sum(size) OVER (ORDER BY ord) > 1000000 THEN 'total too large' ELSE 'ok' END AS state FROM members")
def extraction_limits(s, d):
    return order.extraction_limits(members(s, d), 20_000, 1_000_000)


@query("SELECT event_id, CAST((year(ts) - 1980) * 33554432 + month(ts) * 2097152 + day(ts) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 AS BIGINT) AS packed, date_trunc('minute', ts) + to_seconds(second(ts) // 2 * 2) AS unpacked FROM events")
def dos_time(s, d):
    packed = table(s, d, "events").select("event_id", cells.dos_time(F.col("ts")).alias("packed"))
    return packed.select("event_id", "packed", cells.from_dos_time(F.col("packed")).alias("unpacked"))


# Cells of all formats

_FORMATS = """WITH f AS (SELECT p_partkey, p_partkey % 3 + 3 AS format, p_partkey % 6 AS host, [2, 15, 20, 26, 29, 36, 99][p_partkey % 7 + 1] AS unpacker, p_partkey % 2 = 0 AS extended, p_partkey % 10 AS log,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) * 1073741824 END AS explicit, p_partkey % 13 = 0 AS is_dir, p_partkey % 6 AS method, 33188 + p_partkey % 512 AS attributes, p_partkey % 5 AS volume, p_size % 3 AS volumes FROM part),
v AS (SELECT *, CASE format WHEN 3 THEN 'v14' WHEN 4 THEN CASE unpacker WHEN 2 THEN 'v14' WHEN 15 THEN 'v15' WHEN 20 THEN 'v20' WHEN 26 THEN 'v26' WHEN 36 THEN 'v36' ELSE 'v29' END ELSE CASE WHEN extended THEN 'v70' ELSE 'v50' END END AS version,
  coalesce(explicit, 0) > 4294967296 AND format = 5 AND extended AS large FROM f) """


def _formats(s, d):
    k = F.col("p_partkey")
    f = table(s, d, "part").select(
        k, (k % 3 + 3).alias("format"), (k % 6).alias("host"), F.element_at(F.array(*map(F.lit, (2, 15, 20, 26, 29, 36, 99))), (k % 7 + 1).cast("int")).alias("unpacker"), (k % 2 == 0).alias("extended"), (k % 10).alias("log"),
        F.when(k % 4 == 0, F.col("p_size") * F.lit(1 << 30).cast("long")).alias("explicit"), (k % 13 == 0).alias("is_dir"), (k % 6).alias("method"), (k % 512 + 33188).alias("attributes"), (k % 5).alias("volume"), (F.col("p_size") % 3).alias("volumes"),
    )
    return f.withColumn("version", cells.version_label(F.col("format"), F.col("unpacker"), F.col("extended")))


@query(_FORMATS + "SELECT p_partkey, version, CASE format WHEN 3 THEN NULL WHEN 4 THEN CASE host WHEN 0 THEN 'DOS' WHEN 1 THEN 'OS/2' WHEN 2 THEN 'Windows' WHEN 3 THEN 'Unix' ELSE 'Mac' END ELSE CASE host WHEN 1 THEN 'Unix' ELSE 'Windows' END END AS host, CASE WHEN format < 5 THEN CASE WHEN host IN (0, 2) THEN 0 ELSE 1 END ELSE host END AS code FROM v")
def host_and_version(s, d):
    return _formats(s, d).select("p_partkey", "version", cells.host_name(F.col("format"), F.col("host")).alias("host"), cells.host_code(F.col("format"), F.col("host")).alias("code"))


_SIZED = "CASE WHEN is_dir THEN NULL WHEN format = 3 THEN '64k' WHEN format = 4 THEN CASE WHEN log < 4 THEN (64 << CAST(log AS INT)) || 'k' WHEN log <= 6 THEN (1 << (CAST(log AS INT) - 4)) || 'm' END WHEN explicit IS NOT NULL THEN (explicit // 1073741824) || 'g' WHEN log < 3 THEN (128 << CAST(log AS INT)) || 'k' ELSE (1 << (CAST(log AS INT) - 3)) || 'm' END"


@query(_FORMATS + f"SELECT p_partkey, CASE WHEN format = 3 THEN 'RAR 5.0(v13)' WHEN format = 4 THEN 'RAR 1.5(' || version || ')' WHEN large THEN 'RAR 7.0(v70)' ELSE 'RAR 5.0(v50)' END || ' -m' || method || coalesce(' -md=' || {_SIZED}, '') AS compression FROM v")
def compression_cells(s, d):
    size = cells.dictionary_cell(F.col("format"), F.col("is_dir"), F.col("log"), F.col("explicit"))
    return _formats(s, d).select("p_partkey", cells.compression_label(F.col("format"), F.col("version"), F.col("method"), size, F.col("explicit")).alias("compression"))


@query(_FORMATS + "SELECT p_partkey, CASE WHEN format = 3 THEN 'RAR 1.4' WHEN format = 4 THEN 'RAR 1.5' WHEN large THEN 'RAR 7' ELSE 'RAR 5' END || CASE WHEN extended THEN ', solid' ELSE '' END || CASE WHEN volumes <= 1 THEN '' WHEN format = 5 THEN ', volume ' || (volume + 1) ELSE ', volume' END AS details FROM v")
def archive_details(s, d):
    label = cells.details_label(F.col("format"), F.col("version"), F.col("explicit"), F.col("extended"), F.col("volumes"), F.col("volume"))
    return _formats(s, d).select("p_partkey", label.alias("details"))


@query(M + """, r AS (SELECT ord, CASE WHEN ord % 2 = 1 THEN '-r' || CASE WHEN ord % 3 = 0 THEN 'w' ELSE '-' END || '-r--r--' ELSE '..' || CASE WHEN ord % 3 = 0 THEN 'A' ELSE '.' END || '...R' END AS attributes, size, packed_size,
  CASE WHEN size = 0 THEN 0 ELSE packed_size * 100 // size END AS ratio, strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') AS time, md5 AS checksum, CASE WHEN version > 0 THEN name || ';' || version ELSE name END AS name FROM members)
SELECT * FROM r UNION ALL SELECT NULL, NULL, CAST(sum(size) AS BIGINT), CAST(sum(packed_size) AS BIGINT), CAST(sum(packed_size) AS BIGINT) * 100 // CAST(sum(size) AS BIGINT), NULL, NULL, CAST(count(*) AS VARCHAR) FROM members""")
def list_table(s, d):
    third, host = F.col("ord") % 3 == 0, F.col("ord") % 2
    attributes = F.when(host == 1, F.when(third, 0o100644).otherwise(0o100444)).otherwise(F.when(third, 0x21).otherwise(0x1))
    return listing.table(members(s, d).withColumns({"host": host, "attributes": attributes}))


@query(M + "SELECT ord, CASE WHEN version > 0 THEN name || ';' || version ELSE name END AS name FROM members")
def list_bare(s, d):
    return listing.bare(members(s, d))


@query(M + ", n AS (SELECT ord, name, substr(name, strpos(name, '/') + 1) AS rest FROM members) SELECT ord, 'in/' || upper(CASE WHEN starts_with(rest, 'en/') THEN substr(rest, 4) ELSE rest END) AS stored, split_part(name, '/', -1) AS base FROM n")
def stored_names(s, d):
    name = F.col("name")
    return members(s, d).select("ord", paths.stored_name(name, strip_base=True, drop_prefix="en/", case="upper", prefix="in").alias("stored"), paths.stored_name(name, flat=True).alias("base"))


# More two-relation operations

@query(S + ", f AS (SELECT name, min(ord) AS first FROM members GROUP BY name) SELECT m.ord, m.name, coalesce(s.size, m.size) AS size, coalesce(s.mtime_s, m.mtime_s) AS mtime_s, CASE WHEN s.name IS NULL THEN 'kept' ELSE 'replaced' END AS origin FROM members m JOIN f ON f.name = m.name LEFT JOIN snapshot s ON s.name = m.name WHERE s.name IS NULL OR m.ord = f.first")
def replace_in_place(s, d):
    return diff.replace_in_place(members(s, d), snapshot(s, d))


@query("SELECT o_orderkey AS ord, 'f' || o_orderkey AS name, CAST(o_custkey AS BIGINT) AS size, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey <> min(o_orderkey) OVER w THEN 'f' || min(o_orderkey) OVER w END AS target FROM orders WINDOW w AS (PARTITION BY o_orderkey % 10 = 0, o_custkey % 2, o_custkey)")
def hard_links(s, d):
    k = F.col("o_orderkey")
    files = table(s, d, "orders").select(k.alias("ord"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.col("o_custkey").cast("long").alias("size"), (F.col("o_custkey") % 2).alias("device"), F.when(k % 10 > 0, F.col("o_custkey")).alias("inode"))
    return diff.hard_links(files)


@query("WITH m AS (SELECT event_type || '-' || user_id AS name, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) SELECT w.name, coalesce(n, 0) AS matches, first AS first_ord, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM (SELECT 'click-' || c_custkey AS name FROM customer) w LEFT JOIN m ON m.name = w.name")
def name_lookup(s, d):
    m = table(s, d, "events").select(F.col("event_id").alias("ord"), F.concat_ws("-", "event_type", "user_id").alias("name"))
    return diff.lookup(m, table(s, d, "customer").select(F.concat(F.lit("click-"), F.col("c_custkey").cast("string")).alias("name")))


@query("SELECT min(o_orderkey) AS ord, 'src/' || o_custkey AS path, 'n' || min(o_orderkey) AS name FROM orders GROUP BY o_custkey")
def input_dedup(s, d):
    k = F.col("o_orderkey")
    return diff.first_of_path(table(s, d, "orders").select(k.alias("ord"), F.concat(F.lit("src/"), F.col("o_custkey").cast("string")).alias("path"), F.concat(F.lit("n"), k.cast("string")).alias("name")))


_STATES = "(SELECT name, arg_max(mtime_s, mtime_s) AS t FROM snapshot GROUP BY name)"


@query(S + f", x AS {_STATES} SELECT m.ord, m.name, CASE WHEN t IS NOT NULL AND NOT m.mtime_s > t THEN 'skip' ELSE 'extract' END AS action, CASE WHEN t IS NOT NULL AND NOT m.mtime_s > t THEN NULL ELSE m.name END AS target FROM members m LEFT JOIN x ON x.name = m.name")
def extract_update(s, d):
    return select.destinations(_extracted(s, d), _existing(s, d), "update")


@query(S + f", x AS {_STATES} SELECT m.ord, m.name, CASE WHEN m.mtime_s > t THEN 'extract' ELSE 'skip' END AS action, CASE WHEN m.mtime_s > t THEN m.name END AS target FROM members m LEFT JOIN x ON x.name = m.name")
def extract_freshen(s, d):
    return select.destinations(_extracted(s, d), _existing(s, d), "freshen")


@query(S + f", x AS {_STATES} SELECT m.ord, m.name, 'extract' AS action, CASE WHEN t IS NULL THEN m.name WHEN strpos(split_part(m.name, '/', -1), '.') > 0 THEN regexp_replace(m.name, '\\.([^.]*)$', '(1).\\1') ELSE m.name || '(1)' END AS target FROM members m LEFT JOIN x ON x.name = m.name")
def extract_rename(s, d):
    return select.destinations(_extracted(s, d), _existing(s, d), "rename")


def _extracted(s, d):
    return members(s, d).select("ord", "name", F.lit(False).alias("is_dir"), (F.col("mtime_s") * 1_000_000_000).alias("mtime_ns"))


def _existing(s, d):
    return snapshot(s, d).select("name", (F.col("mtime_s") * 1_000_000_000).alias("mtime_ns"))


@query(M + "SELECT CASE WHEN starts_with(name, 'src1/') THEN 'refused' WHEN ord % 7 = 0 THEN 'failed' WHEN ord % 5 = 0 THEN 'corrected' ELSE 'written' END AS outcome, count(*) AS members, CAST(sum(CASE WHEN ord % 7 = 0 THEN 0 ELSE size END) AS BIGINT) AS bytes, min(ord) AS first_ord, arg_min(CASE WHEN starts_with(name, 'src1/') THEN '/' || name WHEN ord % 5 = 0 THEN './' || name ELSE name END, ord) AS first_name FROM members GROUP BY 1")
def extract_files(s, d):
    name = F.when(F.col("name").startswith("src1/"), F.concat(F.lit("/"), "name")).when(F.col("ord") % 5 == 0, F.concat(F.lit("./"), "name")).otherwise(F.col("name"))
    rows = members(s, d).select("ord", name.alias("target"), F.when(F.col("ord") % 7 > 0, F.col("text").cast("binary")).alias("payload"))
    root = ranges.shared_dir(s).removeprefix("file://") + "/extract-" + uuid.uuid4().hex
    return select.extraction_report(sinks.extract(rows, root))


@query(M + "SELECT ord, name, size FROM members WHERE ord % 3 = 0 UNION ALL SELECT (SELECT max(ord) FROM members WHERE ord % 3 = 0) + 1 + ord - (SELECT min(ord) FROM members WHERE ord % 3 = 1), name, size FROM members WHERE ord % 3 = 1")
def append_members(s, d):
    m, root = members(s, d).select("ord", "name", "size"), ranges.shared_dir(s) + "/table-" + uuid.uuid4().hex
    sinks.commit(m.where("ord % 3 = 0"), root)
    sinks.append(m.where("ord % 3 = 1"), root)
    return sinks.current(s, root)


@query(M + "SELECT ord, CASE WHEN ord % 4 = 1 THEN 'new/' || ord ELSE name END AS name, size, CASE WHEN ord % 6 = 1 THEN 'c' || ord END AS comment FROM members WHERE ord % 4 <> 0")
def edit_apply(s, d):
    m = members(s, d).select("ord", "name", "size")
    edit = lambda where, kind, value: m.where(where).select("ord", F.lit(kind).alias("kind"), value.alias("value"))
    text = lambda head: F.concat(F.lit(head), F.col("ord").cast("string"))
    edits = edit("ord % 4 = 0", "delete", F.lit(None).cast("string")).union(edit("ord % 4 = 1", "rename", text("new/"))).union(edit("ord % 6 = 1", "comment", text("c")))
    return diff.apply_edits(m, edits)


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS size, 'ok' AS state FROM orders")
def checked_total(s, d):
    return select.checked_total(table(s, d, "orders").select(F.col("o_custkey").alias("size")))


@query("SELECT CAST(NULL AS BIGINT) AS size, 'overflow' AS state")
def checked_total_overflow(s, d):
    return select.checked_total(table(s, d, "orders").select(F.lit((1 << 63) - 1).alias("size")))


@query(M + ", e AS (SELECT ord, name, ord % 5 = 0 AS is_dir, CASE WHEN ord % 5 = 0 THEN -(length(name) - length(replace(name, '/', ''))) ELSE 0 END AS down FROM (SELECT ord, CASE WHEN ord % 2 = 0 THEN source ELSE name END AS name FROM members)) SELECT ord, name, row_number() OVER (ORDER BY is_dir, down, ord) AS position FROM e")
def files_then_directories(s, d):
    name = F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(F.col("name"))
    return order.files_then_directories(members(s, d).select("ord", name.alias("name"), (F.col("ord") % 5 == 0).alias("is_dir")))


@query(M + ", p AS (SELECT ord, name, size, CASE WHEN ends_with(name, '1.md') THEN 3 WHEN ends_with(name, '.md') THEN 0 WHEN ends_with(name, '.LOG') THEN 2 ELSE 1 END AS place FROM members) SELECT ord, name, row_number() OVER (ORDER BY place, lower(" + _EXT + "), lower(split_part(name, '/', -1)), size, lower(name), ord) AS position FROM p")
def listed_order(s, d):
    return order.listed_order(members(s, d).select("ord", "name", "size"), ["*.md", "$default", "*.LOG", "*1.md"])


# Headers of a set: each order is a member of up to five fragments; the first or third of some is lost.
_HEADERS = "h AS (SELECT o_orderkey * 10 + line AS seq, o_orderkey AS k, line > 1 AS from_before, line < o_custkey % 5 + 1 AS goes_on, o_custkey * line AS packed_size FROM orders, range(1, 6) AS r(line) WHERE line <= o_custkey % 5 + 1 AND NOT (o_orderkey % 5 = 1 AND line = 1) AND NOT (o_orderkey % 7 = 1 AND line = 3))"


def _headers(s, d):
    line, k, n = F.col("line"), F.col("o_orderkey"), F.col("o_custkey") % 5 + 1
    h = table(s, d, "orders").withColumn("line", F.explode(F.sequence(F.lit(1).cast("long"), n))).where(~((k % 5 == 1) & (line == 1)) & ~((k % 7 == 1) & (line == 3)))
    return h.select((k * 10 + line).alias("seq"), k.alias("k"), (line > 1).alias("from_before"), (line < n).alias("goes_on"), (F.col("o_custkey") * line).alias("packed_size"))


@query("WITH " + _HEADERS + """, m AS (SELECT *, sum(CASE WHEN from_before THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS member FROM h),
g AS (SELECT member, min(seq) AS seq, arg_min(k, seq) AS k, arg_min(from_before, seq) AS headless, arg_min(goes_on, seq) AS split, arg_max(goes_on, seq) AS open, count(*) AS fragments, CAST(sum(packed_size) AS BIGINT) AS packed, min(seq) FILTER (NOT goes_on) AS fin, max(seq) AS last, arg_max(packed_size, seq) AS size FROM m GROUP BY member),
s AS (SELECT *, CASE WHEN headless OR fin < last THEN 'no start' WHEN open THEN CASE WHEN lead(split) OVER (ORDER BY member) IS NULL THEN 'no end' WHEN lead(split) OVER (ORDER BY member) THEN 'overlapping' ELSE 'interrupted' END ELSE 'ok' END AS state FROM g)
SELECT seq, 'm' || k AS name, k % 512 AS attributes, fragments, CASE WHEN state = 'ok' THEN last END AS crc, CASE WHEN state = 'ok' THEN size END AS size, CASE WHEN state = 'ok' THEN packed END AS packed_size, state FROM s""")
def merged_headers(s, d):
    h = _headers(s, d).select("seq", F.concat(F.lit("m"), F.col("k").cast("string")).alias("name"), (F.col("k") % 512).alias("attributes"), F.col("seq").alias("crc"), F.col("packed_size").alias("size"), "packed_size", "from_before", "goes_on")
    return volumes.merged_members(h)


@query("SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, epoch_us(ts) // 1000000 AS back FROM (SELECT event_id, ts - to_seconds(event_id * 100000) AS ts FROM events)")
def civil_time(s, d):
    seconds = F.floor(_micros(F.col("ts")) / 1_000_000).cast("long") - F.col("event_id") * 100_000
    c = table(s, d, "events").select("event_id", cells.civil(seconds + 3600, -3600).alias("c"))
    fields = [F.col(f"c.{x}") for x in ("year", "month", "day", "hour", "minute", "second")]
    return c.select("event_id", "c.*", cells.from_civil(*fields).cast("long").alias("back"))


_POWERS = "list_min(list_transform(list_filter(range(0, 16), lambda i: (131072::HUGEINT << i) >= {0} OR i = 15), lambda i: i))"


@query(f"""WITH p AS (SELECT o_orderkey, o_orderkey * o_custkey * 977 AS size, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 END AS log, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 20 + 1) * 500000000 END AS requested FROM orders),
c AS (SELECT *, greatest(2 * list_max(list_filter(list_transform(range(0, 50), lambda i: 1::BIGINT << i), lambda x: x <= greatest(size, 1))), 131072) AS cap FROM p),
b AS (SELECT *, {_POWERS.format("least(cap, CASE WHEN log IS NULL THEN 33554432 ELSE 131072 << CAST(log AS INT) END)")} AS by_log, CASE WHEN requested IS NOT NULL THEN least(requested, cap) END AS capped FROM c)
SELECT o_orderkey, CAST(CASE WHEN requested IS NULL THEN by_log WHEN capped > 4294967296 THEN least(by_log, CAST(floor(log2(capped / 131072)) AS BIGINT)) ELSE {_POWERS.format("capped")} END AS INTEGER) AS log, CASE WHEN capped > 4294967296 THEN capped END AS explicit FROM b""")
def dictionary_policy(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(k, (k * F.col("o_custkey") * 977).alias("size"), F.when(k % 3 == 0, k % 12).alias("log"), F.when(k % 2 == 0, (F.col("o_custkey") % 20 + 1) * 500_000_000).alias("requested"))
    return rows.select("o_orderkey", cells.dictionary_fields(F.col("size"), F.col("log"), F.col("requested")).alias("f")).select("o_orderkey", "f.*")


@query("SELECT page_id, page_id % 3 AS kind, 'é' || url AS text FROM pages")
def comment_codec(s, d):
    text = F.concat(F.lit("é"), F.col("url"))
    kind = F.col("page_id") % 3
    # A comment that isn't UTF-8 and isn't marked is told by its bytes.
    payload = F.when(kind == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "UTF-16LE"))
    return table(s, d, "pages").select("page_id", kind.alias("kind"), binary.comment_text(payload, kind == 1).cast("string").alias("text"))


# Runs of neighbours

_SOLID = "WITH m AS (SELECT o_orderkey AS ord, o_orderkey % 11 = 0 AS is_dir, o_custkey % 4 > 0 AS solid FROM orders), f AS (SELECT ord, solid, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (ORDER BY ord) AS chain, row_number() OVER (ORDER BY ord) AS k FROM m WHERE NOT is_dir), c AS (SELECT chain, min(ord) AS first_ord, max(ord) AS last_ord, arg_max(solid, ord) AS ends FROM f GROUP BY chain), p AS (SELECT ord, coalesce(count(*) FILTER (NOT is_dir) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS k FROM m) SELECT p.ord, first_ord, last_ord FROM p JOIN f USING (k) JOIN c USING (chain)"


def _solid(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 11 == 0).alias("is_dir"), (F.col("o_custkey") % 4 > 0).alias("solid"))


@query(_SOLID + " WHERE p.ord < last_ord")
def chain_range(s, d):
    return chains.chain_ranges(_solid(s, d))


@query(_SOLID + " WHERE p.ord < last_ord OR ends")
def chain_range_replace(s, d):
    return chains.chain_ranges(_solid(s, d), for_replace=True)


@query(M + ", e AS (SELECT ord, regexp_extract(name, '[^.]*$') AS ext FROM members WHERE ord % 8 > 1), c AS (SELECT ord, CASE WHEN ext = lag(ext) OVER (ORDER BY ord) THEN 0 ELSE 1 END AS new FROM e) SELECT ord, CAST(sum(new) OVER (ORDER BY ord) AS BIGINT) AS run FROM c")
def solid_runs(s, d):
    return chains.solid_runs(members(s, d).where("ord % 8 > 1").select("ord", "name"))


_RANGES = "SELECT l_partkey % 50 AS key, l_orderkey * 3 AS lo, l_orderkey * 3 + CAST(l_quantity AS BIGINT) * 20 AS hi FROM lineitem"


@query(f"WITH r AS ({_RANGES}), o AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r), n AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT key, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY key, run")
def interval_merge(s, d):
    lo = F.col("l_orderkey") * 3
    return chains.merge_ranges(table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("key"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") * 20).alias("hi")))


# Each supplier's set has up to 13 volumes, and every third set lacks its fourth.
@query("""WITH v AS (SELECT s_suppkey AS k, n, s_suppkey % 3 = 0 AS broken, s_suppkey % 4 AS style FROM supplier, range(1, 14) AS r(n) WHERE n <= s_suppkey % 13 + 1)
SELECT 'set' || k AS volume_set, n AS volume, CASE style WHEN 0 THEN 'set' || k || '.part' || n || '.rar' WHEN 1 THEN 'Set' || k || '.PART' || lpad(CAST(n AS VARCHAR), 2, '0') || CASE WHEN n = 1 THEN '.exe' ELSE '.rar' END
  WHEN 2 THEN 'set' || k || CASE WHEN n = 1 THEN '.rar' ELSE '.r' || lpad(CAST(n - 2 AS VARCHAR), 2, '0') END ELSE 'set' || k || '.part' || lpad(CAST(n AS VARCHAR), 3, '0') || '.rar' END AS path FROM v WHERE NOT broken OR n < 4""")
def volume_discovery(s, d):
    k, n = F.col("s_suppkey"), F.col("n")
    pad = lambda w, c=n: F.lpad(c.cast("string"), w, "0")
    base = lambda head: F.concat(F.lit(head), k.cast("string"))
    rows = table(s, d, "supplier").select(k, F.explode(F.sequence(F.lit(1).cast("long"), k % 13 + 1)).alias("n")).where((k % 3 > 0) | (n != 4))
    path = (
        F.when(k % 4 == 0, F.concat(base("set"), F.lit(".part"), n.cast("string"), F.lit(".rar"))).when(k % 4 == 1, F.concat(base("Set"), F.lit(".PART"), pad(2), F.when(n == 1, ".exe").otherwise(".rar")))
        .when(k % 4 == 2, F.concat(base("set"), F.when(n == 1, ".rar").otherwise(F.concat(F.lit(".r"), pad(2, n - 2))))).otherwise(F.concat(base("set"), F.lit(".part"), pad(3), F.lit(".rar")))
    )
    return chains.volume_sets(rows.select(path.alias("path")).union(table(s, d, "supplier").select(F.concat(F.lit("note"), k.cast("string"), F.lit(".txt")))))


# Checksums, bit by bit in the twin

_BITS = "list_transform(string_split(p_name, ''), lambda c: ascii(c))"


@query(f"SELECT p_partkey, crc AS crc32, CAST(crc & 65535 AS INTEGER) AS crc16 FROM (SELECT p_partkey, xor(4294967295, list_reduce(list_prepend(4294967295, CAST({_BITS} AS BIGINT[])), lambda a, b: list_reduce(CAST([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) AS crc FROM part)")
def crc32_names(s, d):
    data = F.col("p_name").cast("binary")
    return table(s, d, "part").select("p_partkey", F.crc32(data).alias("crc32"), binary.crc16(data).cast("int").alias("crc16"))


@query(f"SELECT p_partkey, printf('%016x', xor(18446744073709551615::UBIGINT, list_reduce(list_prepend(18446744073709551615::UBIGINT, CAST({_BITS} AS UBIGINT[])), lambda a, b: list_reduce(CAST([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[]), lambda c, z: xor(c >> 1, (c & 1::UBIGINT) * 14514072000185962306::UBIGINT))))) AS crc64 FROM part")
def crc64_names(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data")).select("p_partkey", binary.crc64("data").alias("crc64"))


# Category coverage; no operator of its own

@query("SELECT n_name, r_name, count(*) AS orders, CAST(round(sum(CAST(o_totalprice * 100 AS BIGINT))) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def star_join(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("long").alias("cents"))


def entry(spark: SparkSession) -> DataFrame:
    return catalog_info(spark, "/root/testdata/sf0.001")

