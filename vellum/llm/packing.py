"""Cost-balanced packing of tokenized documents into sequences.

The cost of a piece of ``n`` tokens is ``linear * n + quadratic * n * n``: the
matrix products and the attention within the piece.  Pieces are taken in
descending length; each goes to the sequence of the lowest cost so far that has
room for it.  Pieces for which no sequence has room are cut to fill the room
that is left, the cheapest sequences first, so every sequence of a window but the rest is full.  The rest is
carried into the next window; at the end of a partition it is laid out in
sequences whose lengths are powers of two, which need no padding.

Each partition is packed on its own, window by window: no shuffle, and memory
for one window and one batch.  The input's order decides the windows, so a task
that runs again gives the same sequences.

Cases: a null or empty text is the end token alone; a null id is kept; repeated
rows are packed each; an empty table gives no pieces; other columns are not
read.  A text of any length is cut into pieces of at most one sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from operator import add
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _util

#: Entries that the word cache of one Python worker holds at most; of a full cache the words of the next texts stay.
CACHE = 600_000
#: Words that are encoded together.
JOINED = 500
#: Texts whose distinct words are looked up together.
TOGETHER = 100
#: Full sequences in one window.
WINDOW = 256


# The pattern that splits texts of such a vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Latin letters that lower-case one by one to letters of the same kind and are their own normal form, and ASCII marks
# after them.  U+0130 is left out, it becomes two characters; an apostrophe may belong to what follows it.
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def check_vocabulary(spec: dict) -> None:
    """Refuse a vocabulary whose tokens may depend on more than one word: its ids would be wrong."""
    flat = lambda section, inner: (section or {}).get(inner) or [section or {}]
    steps, splits, model = flat(spec.get("normalizer"), "normalizers"), flat(spec.get("pre_tokenizer"), "pretokenizers"), spec["model"]
    known = {
        "normalizer": [n.get("type") for n in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " "),
        "pre_tokenizer": [t.get("type") for t in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": SPLIT} and splits[0].get("behavior") == "Removed" and bool(splits[0].get("invert")) and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex"),
        "model": model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"]) and not any(LATIN(t["content"]) for t in spec.get("added_tokens", [])),
    }
    if bad := [name for name, fine in known.items() if not fine]:
        raise ValueError(f"not a vocabulary of words: {', '.join(bad)}")


class WordEncoder:
    """Token ids of texts for a vocabulary whose tokens never span white space.

    Each word is encoded by the library itself, once while it stays in the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        check_vocabulary(json.loads(self.library.to_str()))
        self.library.no_truncation()
        self.library.no_padding()
        # The same model, for words that are one piece and in normal form already.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {"": b""}
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, words: Iterable[str], latin: Iterable[str]) -> None:
        """Encode new words: those of letters many at a time, told apart by the ids that end a word; ``latin`` ones,
        in lower case, by the model alone, whose one piece each of them is."""
        cache, single, letters = self.cache, [], []
        for w in words:
            (letters if w.isalpha() else single).append(w)
        for library, group in ((self.plain, list(latin)), (self.library, letters)):
            encode = getattr(library, "encode_batch_fast", library.encode_batch)
            for at in range(0, len(group), JOINED):
                some = group[at : at + JOINED]
                ids = np.array(encode([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(some):  # a letter has become more than letters in lower case
                    single += some
                    continue
                raw, low = ids.tobytes(), 0
                for word, high in zip(some, (4 * ends).tolist()):
                    cache[word] = raw[low:high]
                    low = high
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        for word, found in zip(single, encode(single, add_special_tokens=False)):
            cache[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        return [ids for at in range(0, len(texts), TOGETHER) for ids in self._encode(texts[at : at + TOGETHER])]

    def _encode(self, texts: pa.StringArray) -> list[bytes]:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.values.dictionary_encode()
        seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE:  # only what these texts need stays
            self.cache = {w: self.cache[w] for w in ["", *seen] if w in self.cache}
        cache = self.cache
        known = list(map(cache.get, seen))
        places = [k for k, found in enumerate(known) if found is None]
        new = [seen[k] for k in places]
        # A word that is letters alone once normalized and the marks after it are separate for the library too,
        # and the library lower-cases: the shorter form is looked up in place of each variant.
        stems, tails, latin, other = [], [], set(), set()
        for w in new:
            if found := LATIN(w):
                stem, tail = found.groups()
                stem = stem.lower()
                latin.add(stem)
            else:
                stem, tail = (w[:-1], w[-1]) if w[-1] in ".,!?;:" and normalize("NFC", w[:-1]).lower().isalpha() else (w, "")
                other.add(stem)
            stems.append(stem)
            tails.append(tail)
        other.update(tails)
        self._learn(other.difference(cache, latin), latin.difference(cache))
        get = cache.__getitem__
        for k, w, found in zip(places, new, map(add, map(get, stems), map(get, tails))):
            known[k] = cache[w] = found
        # The ids of the distinct words in a row; each word of the texts takes its run of them.
        ids, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) >> 2
        word = coded.indices.to_numpy()
        runs = size[word]
        ends = np.concatenate([[0], np.cumsum(runs)])
        at = np.repeat((np.cumsum(size) - size)[word] - ends[:-1], runs)
        at += np.arange(len(at))
        raw, cuts = ids[at].tobytes(), (4 * ends[words.offsets.to_numpy()]).tolist()
        return [raw[low:high] for low, high in zip(cuts, cuts[1:])]


def _strings(texts: pa.BinaryArray) -> pa.StringArray:
    """Bytes as text; what isn't UTF-8 is replaced."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _util.kept[__name__] = _encoders
    return _encoders[path]


class Piece:
    """A run of one document's ids; a part of it shares its bytes."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: memoryview, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    @property
    def length(self) -> int:
        return len(self.ids) >> 2

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


def balance(pieces: list[Piece], n: int, size: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill ``n`` sequences of ``size`` tokens; returns them and what is left over.

    Needs at least ``n * size`` tokens in pieces of at most ``size``.
    """
    out: list[list[Piece]] = [[] for _ in range(n)]
    room, cost = np.full(n, size), np.zeros(n)
    late = []
    for p in sorted(pieces, key=lambda p: -p.length):
        k = int(np.where(room >= p.length, cost, np.inf).argmin())
        if room[k] < p.length:
            late.append(p)
            continue
        out[k].append(p)
        room[k] -= p.length
        cost[k] += linear * p.length + quadratic * p.length * p.length
    # Cut the rest into the room that is left, the cheapest sequences first.
    gaps = [int(k) for k in np.lexsort((-room, cost)) if room[k] > 0]
    late.reverse()  # the largest is last
    for k in gaps:
        while room[k] > 0 and late:
            p = late.pop()
            if p.length > room[k]:
                p, rest = p.cut(int(room[k]))
                late.append(rest)
            out[k].append(p)
            room[k] -= p.length
    return out, late


def powers(pieces: list[Piece], total: int) -> list[list[Piece]]:
    """Lay out fewer tokens than one sequence holds in lengths that are powers of two."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, row = 1 << bit, []
        while need:
            p = left.pop()
            if p.length > need:
                p, rest = p.cut(need)
                left.append(rest)
            row.append(p)
            need -= p.length
        out.append(row)
    return out


def pack(
    docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pack all documents; one row for each piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, with ``with_ids``, the piece's token ids.  A ``sequence_id``
    holds the partition in its upper 31 bits.
    """
    _util.tune(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            cells: list[list] = [[] for _ in names]
            ids = []
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    for cell, x in zip(cells, (p.doc, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, offset)):
                        cell.append(x)
                    offset += p.length
                    if with_ids:
                        ids.append(np.frombuffer(p.ids, "<u4").astype(np.int64))
                sequence += 1
            arrays = [pa.array(c, pa.int64()) for c in cells]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, [*names, *["ids"] * with_ids])

        open_pieces: list[Piece] = []
        tokens = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(_strings(batch.column(1)))):
                p = Piece(doc, 0, memoryview(ids + tail), (len(ids) >> 2) + 1)
                while p.length > size:
                    whole, p = p.cut(size)
                    open_pieces.append(whole)
                    tokens += size
                open_pieces.append(p)
                tokens += p.length
                if tokens >= WINDOW * size:
                    full, open_pieces = balance(open_pieces, tokens // size, size, linear, quadratic)
                    tokens %= size
                    yield rows(full)
        if tokens >= size:
            full, open_pieces = balance(open_pieces, tokens // size, size, linear, quadratic)
            tokens %= size
            yield rows(full)
        if tokens:
            yield rows(powers(open_pieces, tokens))

    return _util.id_text(docs, id_col, text_col).mapInArrow(run, schema)
