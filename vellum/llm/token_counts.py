"""Token counts of every prefix of a text, by dynamic programming.

For byte-level BPE the encoding of a prefix is fixed by its last token: the
tokens before it are the encoding of the shorter prefix, and two neighbouring
tokens are *compatible* when their joined bytes encode to just these two.  So

    count[i] = count[i - len(t)] + 1

for the one vocabulary token ``t`` that ends at ``i``, encodes to itself and is
compatible with the last token of the prefix before it.  One pass over a word
gives the exact count at every prefix, and a whole text's counts are those of
its words laid end to end, because the library's pre-tokenizer never joins
across a single space that stands between two visible characters.

Cases: a null or empty text has no prefixes and 0 tokens; a null id is kept;
repeated rows give repeated results; an empty table gives an empty one; other
columns of the input are not read.  Special strings inside a text count as one
token, as the library's default has it.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

#: Entries that the caches of one Python worker hold at most; a full cache is emptied.
CACHE = 400_000
#: Entries of the cache of prefixes, which share the lists of the words they came from.
PREFIXES = 400_000
#: Longest piece, in code points, whose counts are held in a cache as 16-bit numbers.
CACHED_PIECE = 256

# The pre-tokenizer pattern of byte-level BPE vocabularies.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The characters of the White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that are one pre-token where they stand after letters at the end of a piece.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The rank of a merge that never happens.
NEVER = 1 << 60
CONTRACTIONS = ("'re", "'ve", "'ll")
_CLOSE_SPACES = re.compile(r" \s|\s ")
_WORD_START = re.compile(r"(?<=\S)(?= \S)")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_vocabulary(spec: dict) -> None:
    """Refuse a vocabulary whose settings the dynamic program doesn't know: its counts would be wrong."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    known = {
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True),
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if bad := [name for name, fine in known.items() if not fine]:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(bad)}")


class PrefixCounter:
    """Exact token counts of the prefixes of texts, for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        #: A token's number; negative until its own encoding has been looked at.
        self.vocab = {t: -k - 1 for k, t in enumerate(sorted({raw(t) for t in spec["model"]["vocab"] if all(c in byte for c in t)}))}
        self.size = [len(t) for t in self.vocab]
        #: The length of the longest token that ends with three bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.vocab:
            if len(t) > self.reach.get(t[-3:], 2):
                self.reach[t[-3:]] = len(t)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._edges: dict[int, tuple[list, list]] = {}
        self._pairs: dict[int, bool] = {}
        self._prefix: dict[bytes, tuple[list[int], list[int]]] = {}
        self._piece: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._token: dict[str, tuple[int, ...]] = {}

    def _edge_chains(self, t: bytes) -> tuple | None:
        """How the first and the last part of a token grow while it is merged.

        Two lists of (part, rank of the merge that takes it in), the token
        itself last with an infinite rank; None if its bytes don't merge to it.
        """
        parts = [t[i : i + 1] for i in range(len(t))]
        left, right = [], []
        while len(parts) > 1:
            ranks = [self.rank.get(p, NEVER) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == NEVER:
                return None
            k = ranks.index(low)
            if k == 0:
                left.append((parts[0], low))
            if k == len(ranks) - 1:
                right.append((parts[-1], low))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [*left, (t, NEVER)], [*right, (t, NEVER)]

    def _number(self, t: bytes) -> int | None:
        """The number of a token that is its own encoding; other tokens leave the vocabulary."""
        chains, k = self._edge_chains(t), -self.vocab[t] - 1
        if chains is None:
            del self.vocab[t]
            return None
        self.vocab[t], self._edges[k] = k, chains
        return k

    def _meet(self, key: int, before: int, after: int) -> bool:
        """Whether two neighbouring tokens are compatible, held for the next time."""
        found = self._pairs[key] = self.compatible(self._edges[before][1], self._edges[after][0])
        return found

    def compatible(self, right: list, left: list) -> bool:
        """Whether no merge crosses between a token, by its right edge, and the next, by its left edge.

        Merges happen in the order of their ranks.  While two parts face each
        other, they merge if their rank comes before the merges that take them
        into their own tokens; of equal ranks the leftmost goes first.
        """
        i = j = 0
        rank = self.rank
        while True:
            (a, own), (b, other) = right[i], left[j]
            across = rank.get((a, b), NEVER)
            if across < own and across <= other and across != NEVER:
                return False
            if own == other == NEVER:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def byte_counts(self, word: bytes) -> list[int]:
        """Tokens of each byte prefix of one pre-token, from length 0 on.

        What is known of a prefix, the counts and the last tokens up to it,
        is shared by all words that start with it.
        """
        count, last, n = [0], [-1], len(word)
        vocab, reach, size, pairs, known = self.vocab, self.reach.get, self.size, self._pairs, self._prefix
        short = n <= CACHED_PIECE
        if len(pairs) >= CACHE:
            pairs.clear()
        if short:
            if len(known) >= PREFIXES:
                known.clear()
            for k in range(n, 0, -1):
                held = known.get(word[:k])
                if held is not None:
                    count, last = held[0][: k + 1], held[1][: k + 1]
                    break
        begun = len(count)
        for i in range(begun, n + 1):
            # Only one start fits, so the likely ones come first: the last token grows, or a byte stands alone.
            first = i - 1 - size[last[-1]] if i > 1 else 0
            low = i - reach(word[i - 3 : i], 2) if i > 3 else 0
            for s in (first, i - 1, *range(low if low > 0 else 0, i - 1)):
                t = vocab.get(word[s:i])
                if t is None or (t < 0 and (t := self._number(word[s:i])) is None):
                    continue
                if s:
                    key = last[s] << 32 | t
                    fits = pairs.get(key)
                    if not (self._meet(key, last[s], t) if fits is None else fits):
                        continue
                count.append(count[s] + 1)
                last.append(t)
                break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        if short:
            held = count, last
            for i in range(begun, n + 1):
                known[word[:i]] = held
        return count

    def _letters(self, word: str) -> list[int]:
        """Tokens of each code-point prefix of one pre-token of letters or of marks, from length 1 on."""
        raw = word.encode()
        count = self.byte_counts(raw)
        if len(raw) == len(word):
            return count[1:]
        return [*[count[i] for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80], count[-1]]

    def _token_counts(self, token: str) -> tuple[int, ...]:
        """Tokens of each code-point prefix of one pre-token, from length 1 on."""
        found = self._token.get(token)
        if found is None:
            found = tuple(self._letters(token))
            if token in CONTRACTIONS:  # its first two characters alone are two pre-tokens
                found = (found[0], 2, found[2])
            if len(token) <= CACHED_PIECE:
                if len(self._token) >= CACHE // 8:
                    self._token.clear()
                self._token[token] = found
        return found

    def _plain_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        base = run_base = run_start = 0
        in_run = False
        for m in SPLIT.finditer(piece):
            token = m[0]
            counts = self._token_counts(token)
            blank = not token.strip(SPACES)
            if blank or (in_run and token[0] == " "):
                # Seen alone, a prefix that ends in white space has the whole run as one pre-token.
                if not in_run:
                    run_base, run_start, in_run = base, m.start(), True
                    out.extend(base + c for c in counts)
                else:
                    upto = m.end() if blank else m.start() + 1
                    run = self._token_counts(piece[run_start:upto])
                    out.extend(run_base + c for c in run[m.start() - run_start :])
                    if not blank:
                        out.extend(base + c for c in counts[1:])
                        in_run = False
            else:
                in_run = False
                out.extend(base + c for c in counts)
            base += counts[-1]
        return out

    def _piece_bytes(self, piece: str) -> bytes:
        """A piece's counts as 16-bit numbers; of a full cache the last generation is kept.

        Words of letters, and marks after them, need no pattern to be split.
        """
        if len(self._piece) >= CACHE:
            self._older, self._piece = self._piece, {}
        found = self._older.get(piece)
        if found is None:
            word = piece[1:] if piece[0] == " " else piece
            stem = piece.rstrip(MARKS)
            if word.isalpha():
                found = array("H", self._letters(piece)).tobytes()
            elif len(stem) < len(piece) and (stem[1:] if stem[:1] == " " else stem).isalpha():
                head = self._piece.get(stem) or self._piece_bytes(stem)
                base = int.from_bytes(head[-2:], sys.byteorder)
                found = head + array("H", [base + c for c in self._token_counts(piece[len(stem) :])]).tobytes()
            else:
                found = array("H", self._plain_piece(piece)).tobytes()
        self._piece[piece] = found
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings."""
        if not text:
            return np.zeros(0, np.int64)
        if _CLOSE_SPACES.search(text):
            pieces = _WORD_START.split(text)
        else:
            pieces = []
            lines = text.split("\n")
            if any(not x or x[0] in SPACES or x[-1] in SPACES for x in lines):
                lines = [text]
            for line in lines:  # a single line end between visible characters is a pre-token of its own
                if pieces:
                    pieces.append("\n")
                first, *rest = line.split(" ")
                if first:
                    pieces.append(first)
                pieces += [" " + p for p in rest]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if lens.max() <= CACHED_PIECE:
            inner = np.frombuffer(b"".join([self._piece.get(p) or self._piece_bytes(p) for p in pieces]), np.uint16).astype(np.int64)
        else:
            inner = np.concatenate([np.array(self._plain_piece(p), np.int64) for p in pieces])
        ends = np.cumsum(lens)
        # A piece's own total is that of its settled split, which its last prefix has too.
        totals = inner[ends - 1]
        return inner + np.repeat(np.cumsum(totals) - totals, lens)

    def counts(self, text: str) -> np.ndarray:
        """``counts(text)[i - 1]`` is the number of tokens of ``text[:i]``."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, base, at = [], 0, 0
        for m in self._special.finditer(text):
            segment = self._plain(text[at : m.end() - 1])  # a cut special string is ordinary text
            before = self._plain(text[at : m.start()])
            total = int(before[-1]) if len(before) else 0
            out += [base + segment, np.array([base + total + 1])]
            base, at = base + total + 1, m.end()
        out.append(base + self._plain(text[at:]))
        return np.concatenate(out)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, from its counts alone."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text", store_prefixes: bool = False
) -> DataFrame:
    """Count tokens by the prefix table of each whole text.

    Returns ``doc_id, n_bytes, n_tokens, over_limit, fit_chars``: the last is
    the length in code points of the longest prefix within ``budget``.  With
    ``store_prefixes`` it also returns ``prefix_counts``, an array with the
    count at every prefix, to answer later budget questions.
    A narrow map: no shuffle, memory of one batch and the bounded caches.
    """
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens, fit, keys, stored = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                counts = table.counts(raw.decode("utf-8", "replace"))
                n_bytes.append(len(raw))
                keys.append(xxhash.xxh64_intdigest(raw, 42) - (1 << 63))
                total = int(counts[-1]) if len(counts) else 0
                n_tokens.append(total)
                fit.append(len(counts) if total <= budget else longest_prefix(counts, budget))
                if store_prefixes:
                    stored.append(counts.astype(np.int32))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64()), pa.array(keys, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "text_key"]
            if store_prefixes:
                columns.append(pa.array(stored, pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, text_key long"
    if store_prefixes:
        schema += ", prefix_counts array<int>"
    return _util.id_text(docs, id_col, text_col).mapInArrow(run, schema)


def truncate(counted: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every text to its budget with the stored answer, without encoding again; one row for each of ``docs``.

    Rows that repeat an id, or have none, are told apart by their texts.
    """
    fit = counted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "fit_chars").distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.xxhash64(text).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return docs.join(fit, docs[id_col].eqNullSafe(fit["_id"]) & (key == fit["_key"])).select(
        docs[id_col].alias("doc_id"), F.when(docs[text_col].isNotNull(), F.substring(text, F.lit(1), F.col("fit_chars").cast("int"))).alias("text")
    )
