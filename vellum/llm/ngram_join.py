"""Similarity join on word shingles with several global token orders.

A document's set has its distinct 5-word shingles as 64-bit hashes.  Two sets
of Jaccard similarity of at least ``t`` share at least ``ceil(t * n)`` elements
of each, so under *any* order of all shingles their prefixes of
``n - ceil(t * n) + 1`` elements share an element.  That holds for every order
at once: a pair whose prefixes are disjoint under one of them is no pair.

* Order 0 puts common shingles last, so that its prefixes are rare; equal
  prefix elements propose pairs (a join on the element).
* Orders 1 and 2 are independent hash orders; their prefixes are intersected
  before a pair's whole sets are.
* Parity bitmaps, a thirty-second of the size of a set, come before both: bits
  that differ are elements that differ, so too many of them rule a pair out.

Any order is correct; the shingles that order 0 knows as common only steer the cost.

Groups are never expanded into all pairs.  Equal sets are one class and only
its smallest id goes on.  In each group of a prefix element every member is
compared with the leader: the one whose own prefix is the most common, which
the text that others vary is.  Members linked with the leader are connected by
it.  Members that no chain of links joins to the leader choose a second leader
among them in the same way, and what is apart even then is compared
with all of the group of a similar size that it isn't joined to.  Every pair of
classes that can be similar and isn't connected anyway is thus compared; no
component is lost.

No key is gathered in one task.  The leader of a common element, of which there
are ``COMMON`` at most, is an aggregate that is broadcast back, and its rows are
dealt by id as well; minima of graph nodes are aggregates that are written and
joined back, so that the adaptive join splits a hub.  Comparisons are streamed:
the set of one side stands first in its partition's rows, the other sides
follow, and a hub with many partners is dealt to many partitions.  Components
come from iterated large-star and small-star steps on the links, as tables in
the shared folder.

Cases: a null or empty text, or one of white space alone, has an empty set, is
linked with nothing and is its own component; with fewer words than a shingle
the whole sequence is one shingle; rows that repeat an id are one node of the
graph, whatever their texts: each text's links are the id's; a null id has no
component; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util

#: Shingles that order 0 knows as common: the most frequent, this many at most.
COMMON = 200_000
#: Shingles that are counted together before their common ones are passed on, and the count from which they are.
BLOCK, OFTEN = 1_000_000, 3
#: Texts with a common shingle that are led by one of them before the leaders meet.
HOT = 1000
#: Partners of one hub that are compared in one run of rows.
FAN = 100
#: Pairs that are broadcast to the sets at most; more are joined by a shuffle.
BROADCAST_PAIRS = 250_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TOP = np.uint64(1) << np.uint64(63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words, in order; only A-Z and ASCII white space are special."""
    return _util.hash_words(_util.segments(text.lower()))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def prefix_length(n: int, threshold: int) -> int:
    """Elements of which similar sets share one: ``n - ceil(threshold % of n) + 1``."""
    return n - (threshold * n + 99) // 100 + 1


def order_key(tokens: np.ndarray, order: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The rank of each shingle under a global order."""
    key = mix(tokens ^ np.uint64((order + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) >> np.uint64(1)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
        hit = common[0][at] == tokens
        key[hit] = _TOP + common[1][at[hit]]
    return key


def prefix(tokens: np.ndarray, order: int, threshold: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first elements of a set under an order, in that order."""
    p = prefix_length(len(tokens), threshold)
    key = order_key(tokens, order, common)
    low = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[low[np.argsort(key[low])]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    import xxhash

    key = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def summarize(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its set's size and 128-bit key, and rows of locally common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: pa.Array, n: list, k1: list, k2: list, tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            mine, extra = len(n), len(tokens)
            cells = [pa.concat_arrays([ids, pa.nulls(extra, pa.int64())])]
            cells += [pa.array(x + [None] * extra, pa.int64()) for x in (n, k1, k2)]
            cells += [pa.concat_arrays([pa.nulls(mine, pa.int64()), pa.array(x, pa.int64())]) for x in (tokens, counts)]
            return pa.RecordBatch.from_arrays(cells, ["id", "n", "k1", "k2", "token", "count"])

        block: list[np.ndarray] = []
        held = 0

        def common() -> tuple[np.ndarray, np.ndarray]:
            nonlocal block, held
            found, count = np.unique(np.concatenate(block), return_counts=True)
            block, held = [], 0
            return found[count >= OFTEN].view(np.int64), count[count >= OFTEN]

        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            n, k1, k2 = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                key = class_key(s)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                block.append(s)
                held += len(s)
            yield rows(batch.column(0), n, k1, k2, *(common() if held >= BLOCK else none))
        if held:
            yield rows(pa.nulls(0, pa.int64()), [], [], [], *common())

    return _util.id_text(docs, id_col, text_col).mapInArrow(_util.releasing(run), "id long, n long, k1 long, k2 long, token long, count long")


def common_shingles(summary: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, their ranks from rare to common, and among how many their rows are dealt.

    ``COMMON`` rows at most come to the driver.  Ranks are unique: an order has no ties.
    """
    rows = summary.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(COMMON).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(tokens), 0, -1).astype(np.uint64)  # the rows come from the most frequent on
    salts = (rows["count"].to_numpy(np.int64) // HOT).astype(np.int32)
    order = np.argsort(tokens)
    return tokens[order], ranks[order], salts[order]


def prefix_rows(firsts: DataFrame, size: int, threshold: int, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each element of the prefix under order 0 of each of ``_id, _text``.

    ``common`` is the share of the prefix, in thousandths, that is common;
    ``pos`` is the element's place in the order, from 1; ``salt`` is 0 but for
    elements that ``HOT`` texts or more have.
    """

    def salts(p: np.ndarray, doc: int) -> np.ndarray:
        if not len(common[0]):
            return np.zeros(len(p), np.int32)
        at = np.minimum(np.searchsorted(common[0], p), len(common[0]) - 1)
        n = np.where(common[0][at] == p, common[2][at], 0)
        spread = int(mix(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(33))
        return np.where(n > 0, 1 + spread % np.maximum(n, 1), 0).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, lens, sizes, shares_, dealt = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, size)
                if not len(s):
                    continue
                p = prefix(s, 0, threshold, common[:2])
                ids.append(doc)
                tokens.append(p)
                lens.append(len(p))
                sizes.append(len(s))
                shares_.append(1000 * overlap(np.sort(p), common[0]) // len(p) if len(common[0]) else 0)
                dealt.append(salts(p, doc))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lens)),
                        *[pa.array(np.repeat(np.array(x, np.int32), lens)) for x in (sizes, shares_)],
                        pa.array(np.concatenate([np.arange(1, m + 1, dtype=np.int32) for m in lens])), pa.array(np.concatenate(dealt)),
                    ],
                    ["token", "id", "n", "common", "pos", "salt"],
                )

    return firsts.select("_id", "_text").mapInArrow(_util.releasing(run), "token long, id long, n int, common int, pos int, salt int")


def led_members(elements: DataFrame) -> DataFrame:
    """``token, id, n, common, pos, leader`` of the members of each element's group but its leader.

    The leader has the largest ``common``, then the smallest id.
    """
    by_token = Window.partitionBy("token", "salt")
    grouped = elements.withColumn("leader", F.first("id").over(by_token.orderBy(F.desc("common"), "id")))
    # A leader alone in its group has no partner; the leaders of others are found again by their partners.
    rows = _util.materialize(grouped.where("salt > 0 or id != leader"), "members")
    hot = rows.where("salt > 0").drop("leader")
    # One row at most for each common element: a bounded table.
    lead = _util.materialize(hot.groupBy(F.col("token").alias("_token")).agg(F.min(F.struct(-F.col("common"), F.col("id"))).alias("_lead")), "leaders")
    hot = hot.join(F.broadcast(lead), F.col("token") == F.col("_token")).withColumn("leader", F.col("_lead.id")).where("id != leader")
    columns = ["token", "id", "n", "common", "pos", "leader"]
    return rows.where("salt = 0").select(columns).unionByName(hot.select(columns))


def signature(tokens: np.ndarray) -> bytes:
    """The parity of the elements of each of ``2n`` to ``4n`` classes, as bits."""
    bits = max(8, 1 << (2 * len(tokens) - 1).bit_length())
    classes = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(classes & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that two sets don't share, from their signatures."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size_x, size_y = 8 * len(a), 8 * len(b)
    while size_x > size_y:  # halves of a parity bitmap fold into the next smaller one
        size_x //= 2
        x = (x >> size_x) ^ (x & ((1 << size_x) - 1))
    while size_y > size_x:
        size_y //= 2
        y = (y >> size_y) ^ (y & ((1 << size_y) - 1))
    return (x ^ y).bit_count()


def plausible(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that their sizes and signatures don't rule out."""
    of = lambda side: sets.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("sig").alias(f"{side}_sig"))
    hub, member = of("hub"), of("member")
    sized = pairs.join(hub, pairs["hub"] == hub["hub_id"]).join(member, F.col("member") == F.col("member_id"))
    sized = sized.where(100 * F.least("hub_n", "member_n") >= threshold * F.greatest("hub_n", "member_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, member, m, n, a, b = (batch.column(k).to_pylist() for k in range(6))
            fits = [(100 + threshold) * differing(p, q) <= (100 - threshold) * (i + j) for i, j, p, q in zip(m, n, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), batch.column(1).filter(pa.array(fits))], ["hub", "member"])

    return sized.select("hub", "member", "hub_n", "member_n", "hub_sig", "member_sig").mapInArrow(run, "hub long, member long")


def sets_of(firsts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, n, sig, set`` of the wanted ids; a set is the bytes of its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            cells = [pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["id", "n", "sig", "set"])

    asked = firsts.select("_id", "_text").join(_util.few(wanted), F.col("_id") == F.col("id"), "left_semi")
    return asked.mapInArrow(_util.releasing(run), "id long, n int, sig binary, set binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: int, orders: tuple[int, ...]) -> DataFrame:
    """The pairs ``hub, member`` whose sets are similar.

    A hub's set comes first in each run of its rows; its members follow.
    """
    salts = F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("salts")
    heavy = _util.materialize(pairs.groupBy(F.col("hub").alias("_hub")).agg(salts).where("salts > 1"), "heavy")
    dealt = lambda df: df.join(_util.few(heavy), F.col("hub") == F.col("_hub"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    hubs = dealt(pairs.select("hub").distinct()).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
    members = dealt(pairs).select("hub", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member")
    # Whole sets are read, but only those that are compared are dealt.
    asked = _util.materialize(hubs.unionByName(members).withColumn("id", F.coalesce("member", "hub")), "asked")
    needed = sets.select("id", "set").join(_util.few(asked.select(F.col("id").alias("_id")).distinct()), F.col("id") == F.col("_id"), "left_semi")
    rows = _util.few(asked, BROADCAST_PAIRS).join(needed, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, prefixes = None, None, []
        for batch in batches:
            found = []
            for hub, salt, member, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                s = np.frombuffer(raw, np.uint64)
                if (hub, salt) != at:
                    at, h = (hub, salt), s.copy()
                    prefixes = [prefix(h, k, threshold) for k in orders]
                if member is None or 100 * min(len(s), len(h)) < threshold * max(len(s), len(h)):
                    continue
                if all(shares(p, prefix(s, k, threshold)) for k, p in zip(orders, prefixes)):
                    both = overlap(s, h)
                    if 100 * both >= threshold * (len(s) + len(h) - both):
                        found.append((hub, member))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["hub", "member"])

    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return rows.select("hub", "salt", "member", "set").mapInArrow(_util.releasing(run), "hub long, member long")


def shares(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets in any order have a common element."""
    b = np.sort(b)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return bool((b[at] == a).any())


def stars(links: DataFrame) -> DataFrame:
    """``u, v``: each node of the graph of ``hub, member`` but the smallest of its component, with that smallest."""
    edges = _util.materialize(links.select(F.greatest("hub", "member").alias("u"), F.least("hub", "member").alias("v")).where("u != v").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        # Three sums of hashes of the edges tell whether a round has changed them.
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    def least(df: DataFrame) -> DataFrame:
        # Partial minima before the shuffle; written, so that the join back can split a hub.
        low = df.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        return _util.materialize(low, "least")

    before = state(edges)
    while before[0]:
        # Large star: each node gives its larger neighbours to its smallest.
        low = least(edges.union(edges.select("v", "u")))
        large = edges.join(low, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()
        large = _util.materialize(large, "links")
        # Small star: each node gives its smaller neighbours and itself to the smallest.
        low = least(large)
        given = large.join(low, F.col("u") == F.col("w"))
        small = given.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("w", "m")).where("u != v").distinct()
        edges = _util.materialize(small, "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def _with_components(members: DataFrame, star: DataFrame) -> DataFrame:
    """The members with their own and their leader's component, as a table."""
    columns = ["token", "id", "n", "common", "pos"]
    own = members.join(star, F.col("id") == F.col("u"), "left").select(*columns, "leader", F.coalesce("v", "id").alias("cid"))
    led = own.join(star, F.col("leader") == F.col("u"), "left").select(*columns, "leader", "cid", F.coalesce("v", "leader").alias("leader_cid"))
    return _util.materialize(led, "state")


def _band(n: str, threshold: int) -> Column:
    """Sizes of similar sets are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(max(100 / threshold, 1 + 1e-6))) * (1 - 1e-9)).cast("int")


def similar_pairs(firsts: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: int, size: int, orders: tuple[int, ...]) -> DataFrame:
    """``hub, member``: links of the texts ``_id, _text`` that connect every two similar ones."""
    members = led_members(prefix_rows(firsts, size, threshold, common))
    near = members.select(F.col("leader").alias("hub"), F.col("id").alias("member")).distinct()
    pairs = _util.materialize(near, "pairs")
    wanted = pairs.select(F.col("hub").alias("id")).union(pairs.select("member")).distinct()
    sets = _util.materialize(sets_of(firsts, wanted, size), "sets")
    compared = lambda rows: verify(_util.materialize(plausible(rows, sets, threshold), "plausible"), sets, threshold, orders)
    links = _util.materialize(compared(pairs), "linked")

    # Members that no chain of links joins to their leader get a second leader among themselves.
    star = stars(links)
    state = _with_components(members, star)
    second = state.where("cid != leader_cid").groupBy("token").agg(F.min(F.struct(-F.col("common"), F.col("id"), F.col("cid"))).alias("s"))
    second = _util.materialize(second.select(F.col("token").alias("_token"), F.col("s.id").alias("hub"), F.col("s.cid").alias("hub_cid")), "second")
    near = state.join(second, F.col("token") == F.col("_token")).where("cid != hub_cid").select("hub", F.col("id").alias("member")).distinct()
    more = _util.materialize(compared(near), "linked")

    # What is still apart is compared with all that it isn't joined to.
    star = stars(star.select(F.col("u").alias("hub"), F.col("v").alias("member")).union(more))
    state = _with_components(members, star)
    apart = state.where("cid != leader_cid").select(F.col("token").alias("_token"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("cid").alias("hub_cid"))
    apart = apart.withColumn("_band", F.explode(F.array(*[_band("hub_n", threshold) + k for k in (-1, 0, 1)])))
    others = state.select("token", F.col("id").alias("member"), "n", "pos", "cid", _band("n", threshold).alias("band"))
    similar_size = 100 * F.least("hub_n", "n") >= threshold * F.greatest("hub_n", "n")
    # At the first element that two sets share, what follows it must be enough for the overlap.
    enough = (100 + threshold) * (F.least(F.col("hub_n") - F.col("hub_pos"), F.col("n") - F.col("pos")) + 1) >= threshold * (F.col("hub_n") + F.col("n"))
    met = (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_band"))
    rest = apart.join(others, met).where(similar_size & enough & (F.col("hub_cid") != F.col("cid")))
    # A pair of two members apart from the leader comes twice: once is enough.
    rest = rest.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")).distinct()
    return star.select(F.col("u").alias("hub"), F.col("v").alias("member")).union(compared(rest))


def _names(classes: DataFrame, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``k1, k2, rep, cand``: a number for each class whose smallest id is repeated, that no row has as its id."""
    held = classes.join(_util.few(repeated), F.col("rep") == F.col("_rid"), "left_semi").select("k1", "k2", "rep")
    salt = 0
    while True:
        named = _util.materialize(held.withColumn("cand", F.xxhash64("k1", "k2", F.lit(salt))), "names")
        taken = named.join(rows.select(F.col("id").alias("_taken")), F.col("cand") == F.col("_taken"), "left_semi").count()
        if not taken and named.select("cand").distinct().count() == named.count():
            return named
        salt += 1


def link(
    docs: DataFrame, threshold: int = 80, size: int = 5, orders: tuple[int, ...] = (1, 2), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of similar documents: ``doc_id, n_shingles, component_id``, one row per input row."""
    _util.tune(docs.sparkSession)
    summary = _util.materialize(summarize(docs, size, id_col, text_col), "summary")
    rows = summary.where("token is null").select("id", "n", "k1", "k2")
    common = common_shingles(summary)
    known = rows.where("n > 0 and id is not null")
    # Written, so that the joins by class can split a large one.
    classes = _util.materialize(known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    # Copies of a smaller id go no further; they are few columns and join by their class.
    copies = known.join(classes.where("copies > 1"), ["k1", "k2"]).where("id != rep").select(F.col("id").alias("_rid"))
    repeated = _util.materialize(rows.where("id is not null").groupBy(F.col("id").alias("_rid")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_rid"), "repeated")
    apart = _util.materialize(copies.union(repeated).distinct(), "copies")
    texts = _util.id_text(docs, id_col, text_col).where("_id is not null")
    firsts = texts.join(_util.few(apart), F.col("_id") == F.col("_rid"), "left_anti")
    if repeated.isEmpty():
        star = stars(similar_pairs(firsts, common, threshold, size, orders))
        labels = classes.join(star, F.col("rep") == F.col("u"), "left").select("k1", "k2", F.coalesce("v", "rep").alias("component"))
        out = rows.join(_util.materialize(labels, "labels"), ["k1", "k2"], "left")
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))

    # A repeated id is a node, and so is each class; a class is named by its smallest id, or by a number if that is repeated.
    names = _names(classes, rows, repeated)
    named = classes.join(names.select("k1", "k2", "cand"), ["k1", "k2"], "left").select("k1", "k2", "rep", F.coalesce("cand", "rep").alias("cand"))
    named = _util.materialize(named, "named")
    own = names.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "cand")
    held = _keyed(texts.join(_util.few(repeated), F.col("_id") == F.col("_rid"), "left_semi"), size)
    held = held.join(own, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).groupBy(F.col("cand").alias("_id")).agg(F.min("_text").alias("_text"))
    firsts = firsts.unionByName(_util.materialize(held, "held"))
    links = similar_pairs(firsts, common, threshold, size, orders)
    tied = known.join(_util.few(repeated), F.col("id") == F.col("_rid"), "left_semi").join(named, ["k1", "k2"]).select(F.col("cand").alias("hub"), F.col("id").alias("member")).distinct()
    star = stars(links.union(tied))
    # The smallest number of a component may be a name: its smallest id stands for it.
    smallest = named.join(star, F.col("cand") == F.col("u"), "left").groupBy(F.coalesce("v", "cand").alias("_root")).agg(F.min("rep").alias("component"))
    smallest = _util.materialize(smallest, "smallest")
    placed = named.join(star, F.col("cand") == F.col("u"), "left").withColumn("_at", F.coalesce("v", "cand"))
    labels = placed.join(smallest, F.col("_at") == F.col("_root")).select("k1", "k2", "component")
    labels = _util.materialize(labels, "labels")
    out = rows.join(labels, ["k1", "k2"], "left")
    # Without words a repeated id has no class, but it may have one by its other rows.
    nodes = repeated.join(star, F.col("_rid") == F.col("u")).join(smallest, F.col("v") == F.col("_root")).select("_rid", F.col("component").alias("_by_id"))
    nodes = nodes.unionByName(repeated.join(smallest, F.col("_rid") == F.col("_root")).select("_rid", F.col("component").alias("_by_id")))
    out = out.join(_util.few(_util.materialize(nodes, "nodes")), F.col("id") == F.col("_rid"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "_by_id", "id")).alias("component_id"))


def _keyed(texts: DataFrame, size: int) -> DataFrame:
    """``_id, _text`` with the key of the text's set, for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            keys = [class_key(s) for s in sets]
            full = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]], ["_id", "_text", "k1", "k2"])
            yield full.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return texts.select("_id", "_text").mapInArrow(_util.releasing(run), "_id long, _text binary, k1 long, k2 long")


def keep_one(docs: DataFrame, threshold: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component; of those that repeat an id and a text, one.

    An id that is kept keeps each of its different texts.  Rows without an id are kept: nothing can stand for them.
    """
    found = _util.materialize(link(docs, threshold, size, id_col=id_col, text_col=text_col).where("doc_id is not null").groupBy(F.col("doc_id").alias("_vellum_id")).agg(F.min("component_id").alias("_c"), F.count(F.lit(1)).alias("_n")), "found")
    gone, repeated = found.where("_vellum_id != _c").select("_vellum_id"), found.where("_vellum_id = _c and _n > 1").select("_vellum_id")
    same = docs[id_col].cast("long") == F.col("_vellum_id")
    if repeated.isEmpty():
        return docs.join(_util.few(gone), same, "left_anti")
    once = docs.join(_util.few(gone.union(repeated)), same, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Of equal ids and texts the row whose columns come first, written as JSON: the same on every run.
    kept = docs.join(_util.few(repeated), same, "left_semi").groupBy(id_col, text_col).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.unionByName(kept.select("_row.*"))
