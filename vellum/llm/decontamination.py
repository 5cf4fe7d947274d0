"""Benchmark decontamination by spaced-seed hashing.

An overlap of a benchmark item and a document is a window of words that stand
opposite each other; a document is contaminated when one of at least
``min_overlap`` words, or of all words of a shorter item, has ``identity``
percent equal words.  On the alignment with most equal words the longest such
window is reported.

Seeds propose the alignments: masks of a few words, one of which is ignored.
Test and training hashes of the words under each mask are joined, and the
overlap around each hit is verified word by word.  No overlap is missed.  With
one substitution in ``b`` words at most, ``b = 100 / (100 - identity)``, a
window of ``n`` words has no more substitutions than whole blocks of ``b``
words, so one block has at most one; the mask that ignores its place hits.

Words are case-folded by Unicode's rules.  ASCII punctuation is deleted from
them, inside them too, in items and documents alike: ``3.14`` is ``314``.

The benchmark's items are the stated query set: they go to the tasks in blocks
of at most ``BLOCK_BYTES`` of text, one pass over the documents for each block,
so what is broadcast is bounded whatever the benchmark's size.  Hits are looked
up ``HITS`` at a time, whatever the number of equal words in a document.

Cases: null and empty texts match nothing, and so do items without words; an
item of fewer words than a block must be there with all of them; null document
ids are reported as null; items without an id are used, with a null id;
repeated rows give repeated matches; with an empty table on either side there
are none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

# A mask covers at most so many words.
MAX_SPAN = 8
#: Text of the benchmark that is broadcast at once; an item that is larger makes a block alone.
BLOCK_BYTES = 4 << 20
#: Equal seeds that are looked up at once.
HITS = 500_000
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def words(text: bytes) -> bytes:
    """The folded text, whose words white space parts."""
    folded = text.lower() if text.isascii() else text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return folded.translate(None, _PUNCTUATION)


def hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words end."""
    found = [_util.hash_words(map(words, _util.segments(t))) for t in texts]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum([len(f) for f in found], dtype=np.int64)


def masks(n_words: int, min_overlap: int, identity: int) -> list[tuple[int, ...]]:
    """The word offsets of the seeds of an item, of which every overlap that counts has one."""
    span = min(min_overlap, n_words, MAX_SPAN)
    if n_words * (100 - identity) < 100:
        return [tuple(range(span))]
    span = min(span, 100 // (100 - identity))
    if span <= 2:
        return [(0,)]
    # To ignore the first word or the last is the same mask.
    return [tuple(k for k in range(span) if k != ignored) for ignored in range(1, span)]


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the words under a mask that starts at each position."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k in mask:
        out = (out ^ h[k : k + n]) * _MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], min_overlap: int, identity: int):
        self.min_overlap, self.identity = min_overlap, identity
        self.tokens, ends = hashes(t for _, t in items)
        self.ids = [i for i, _ in items]
        self.starts = np.concatenate([[0], ends]).astype(np.int64)
        lens = np.diff(self.starts)
        self.owner = owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        of_length = {n: masks(n, min_overlap, identity) for n in set(lens.tolist()) if n}
        self.tables = []
        for mask in sorted({m for found in of_length.values() for m in found}):
            uses = np.array([mask in of_length.get(n, ()) for n in lens.tolist()], bool)
            found = seed_hashes(self.tokens, mask)
            at = np.arange(len(found), dtype=np.int32)
            at = at[(owner[at] == owner[at + mask[-1]]) & uses[owner[at]]]
            found = found[at]
            order = np.argsort(found, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, found[order], at[order], np.packbits(seen, bitorder="little")))

    def hits(self, h: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
        """``doc, item, shift`` of equal seeds, ``HITS`` at most at a time, each once in its part."""
        for mask, sorted_hashes, positions, seen in self.tables:
            found = seed_hashes(h, mask)
            top = (found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
            at = np.flatnonzero(seen[top >> 3] >> (top & 7).astype(np.uint8) & 1)
            at = at[doc[at] == doc[at + mask[-1]]]
            low = np.searchsorted(sorted_hashes, found[at])
            count = np.searchsorted(sorted_hashes, found[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            total = np.cumsum(count)
            for base in range(0, int(total[-1]) if len(total) else 0, HITS):
                flat = np.arange(base, min(base + HITS, int(total[-1])))
                of = np.searchsorted(total, flat, "right")
                place = positions[low[of] + flat - (total[of] - count[of])]
                item = self.owner[place]
                yield _distinct(np.stack([doc[at[of]], item, at[of] - (place - self.starts[item])], 1))

    def alignments(self, h: np.ndarray, doc: np.ndarray) -> Iterator[list[int]]:
        """``doc, item, shift``: position ``p`` of the item stands at ``p + shift`` of ``h``; an alignment may come again."""
        held, size = [], 0
        for part in self.hits(h, doc):
            held.append(part)
            size += len(part)
            if size > HITS:
                yield from _distinct(np.concatenate(held)).tolist()
                held, size = [], 0
        if held:
            yield from _distinct(np.concatenate(held)).tolist()

    def overlap(self, h: np.ndarray, low: int, high: int, item: int, shift: int) -> tuple[int, int, int]:
        """The longest window with enough equal words on one alignment within ``h[low:high]``: its start in ``h``, length and equal words."""
        first, last = self.starts[item], self.starts[item + 1]
        a, b = max(low, shift), min(high, shift + int(last - first))
        same = self.tokens[first + a - shift : first + b - shift] == h[a:b]
        # A window has enough equal words when the score doesn't fall over it.
        score = np.concatenate([[0], np.cumsum(np.where(same, 100 - self.identity, -self.identity))])
        starts = np.searchsorted(-np.minimum.accumulate(score), -score)
        end = int((np.arange(len(score)) - starts).argmax())
        start = int(starts[end])
        return a + start, end - start, int(same[start:end].sum())

    def words_of(self, item: int) -> int:
        return int(self.starts[item + 1] - self.starts[item])

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """``text, item, start, length, equal`` of the best overlap of each text with each item it holds."""
        h, ends = hashes(texts)
        starts = np.concatenate([[0], ends]).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, item, shift in self.alignments(h, doc):
            known = best.get((d, item), (0, 0, 0))
            if known[0] == self.words_of(item) and -known[1] <= shift:
                continue  # nothing has more equal words, or as many sooner
            start, n, equal = self.overlap(h, int(starts[d]), int(ends[d]), item, shift)
            if n >= min(self.min_overlap, self.words_of(item)) and (equal, -start) > known[:2]:
                best[d, item] = (equal, -start, n)
        return [(d, item, -start - int(starts[d]), n, equal) for (d, item), (equal, start, n) in sorted(best.items())]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct rows, sorted."""
    keys = keys[np.lexsort(keys.T[::-1])]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])] if len(keys) else keys


SCHEMA = "doc_id long, item_id long, start_word long, overlap_words long, equal_words long, item_words long"


def scan(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], index.ids[item], start, n, equal, index.words_of(item)) for d, item, start, n, equal in index.matches(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], [c.split()[0] for c in SCHEMA.split(", ")])

    return _util.id_text(docs, id_col, text_col).mapInArrow(_util.releasing(run), SCHEMA)


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    block, size = [], 0
    for row in _util.id_text(benchmark, item_col, text_col).toLocalIterator():
        if block and size + len(row["_text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["_id"], bytes(row["_text"])))
        size += len(row["_text"])
    if block:
        yield block


def find(
    docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, identity: int = 80,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Each contaminated document with each item it holds and its longest verified overlap."""
    spark = docs.sparkSession
    _util.tune(spark)
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        found = _util.materialize(scan(docs, Index(block, min_overlap, identity), id_col, text_col), "matches")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def remove(
    docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, identity: int = 80,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows whose text holds no benchmark passage, and those without an id."""
    _util.tune(docs.sparkSession)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, min_overlap, identity))

        def clean(texts: list[bytes], shared=shared) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[m[0] for m in shared.value.matches(texts)]] = False
            return out

        docs = _util.keep_rows(docs, clean, id_col, text_col)
    return docs
