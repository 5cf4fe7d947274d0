"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density and number of lexicon words, second-person
words near them and overall, capitals, punctuation, and words whose letters are
mixed with digits or signs, among them lexicon words so written.  Language,
source and id are no features.

The lexicon is a fixed list, and the words and word stems that the training
labels single out: those in at least ``MINED_DOCS`` toxic texts of the sample
and ``MINED_ODDS`` times likelier there, each weighted by the logarithm.  Model and lexicon are learned from at most ``max_rows``
labelled texts, those with the smallest hash of their id, never from rows held
out; the lexicon takes the ``MINED_UNITS`` likeliest of the sample's stems.  Both
bounds are parameters and keep the driver's memory fixed.  A third of
the sample isn't fitted on and calibrates the scores.

Cases: null and empty texts get the score of a text without words; null ids are
scored, neither held out nor learned from; of repeated labels of an id the
highest counts; without both labels the share of toxic rows is the score of
every text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

# Common insults of the four languages.
LEXICON = frozenset(
    b"idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns imbecile fool freak pig bastard jerk creep garbage filth vermin "
    b"dummkopf trottel arschloch abschaum versager idiota imbecil estupido basura asqueroso cabron imbecile connard salaud ordure debile".split()
)
# Words of address.
SECOND_PERSON = frozenset(b"you your yours yourself youre u ur du dich dir dein deine ihr euch tu te ti tus usted ustedes vous votre vos toi ton".split())
NEAR = 5
MAX_ROWS = 12_000
MINED_UNITS, MINED_DOCS, MINED_ODDS = 1000, 4, 5.0
#: Lengths, in bytes, of the word starts that count as stems.
STEMS = (5, 6, 7, 8)
#: Words whose kind one Python worker holds at most.
CACHE = 300_000
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIXED = re.compile(rb"(?<![^\s.,;:!?\"'()])[a-z]+[0-9@$*!|+_.-]+[a-z][a-z0-9@$*!|+_.-]*|(?<![^\s])[0-9@$]+[a-z][a-z0-9@$*]*")
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
NAMES = ("density", "hits", "near", "second", "capitals", "loud", "punctuation", "mixed", "mixed_hits", "loud_hits", "length", "stem_hits", "stem_density", "stem_weight")


def units(word: bytes) -> list[bytes]:
    """A word and its stems; a stem is marked by a trailing dash."""
    return [word, *[word[:k] + b"-" for k in STEMS if len(word) >= k]]


class Lexicon(dict):
    """The kind of a word: 0, or a bit for a lexicon word (1), for address (2), for a mined one (4)."""

    def __init__(self, mined: dict[bytes, float]):
        super().__init__()
        self.mined = mined
        self.words = LEXICON | {u for u in mined if not u.endswith(b"-")}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        kind = (word in self.words) + 2 * (word in SECOND_PERSON) + 4 * any(u in self.mined for u in units(word))
        self[word] = kind
        return kind

    def __reduce__(self):
        return Lexicon, (self.mined,)

    def weight(self, word: bytes) -> float:
        return max((self.mined.get(u, 0.0) for u in units(word)), default=0.0)


_SIGNS = re.compile(rb"[^a-z]")


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    words = low.translate(_KEEP).split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = bytes(map(lexicon.__getitem__, words))
    marked = [k for k, kind in enumerate(kinds) if kind] if kinds.strip(b"\0") else []
    hits = [k for k in marked if kinds[k] & 1]
    second = sum(1 for k in marked if kinds[k] & 2)
    stems = [lexicon.weight(words[k]) for k in marked if kinds[k] & 4]
    near = sum(1 for k in hits if any(x & 2 for x in kinds[max(0, k - NEAR) : k + NEAR + 1]))
    b = np.frombuffer(text, np.uint8)
    letters = max(1, int(np.count_nonzero((b | 32) - 97 < 26)))
    capitals = int(np.count_nonzero(b - 65 < 26))
    mixed = _MIXED.findall(low)
    mixed_hits = sum(1 for w in mixed if _SIGNS.sub(b"", w.translate(_LEET)) in lexicon.words or _masked(w, lexicon.words))
    loud_hits = sum(1 for w in {words[k] for k in hits} if w.upper() in text)
    return [
        len(hits) / n, float(len(hits)), near / n, second / n, capitals / letters, text.count(b"!") / n,
        sum(map(text.count, (b".", b",", b"?", b";", b":"))) / n, len(mixed) / n, float(mixed_hits), float(loud_hits), float(np.log1p(n)),
        float(len(stems)), len(stems) / n, sum(stems),
    ]


def _masked(word: bytes, lexicon: frozenset[bytes]) -> bool:
    """Whether a word with starred letters can be one of the lexicon."""
    if b"*" not in word or len(word) > 24:
        return False
    pattern = re.compile(re.escape(word).replace(rb"\*", b"[a-z]") + b"$")
    return any(len(w) == len(word) and pattern.match(w) for w in lexicon)


@dataclass
class Tree:
    """A binary tree as arrays; a leaf has the feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            go = np.where(x[rows, np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        return value[at]


class BoostedTrees:
    """Logistic boosting with histogram splits."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        cuts = [np.unique(np.concatenate([[c.min()], q]))[:-1] for c, q in zip(x.T, cuts)]
        binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = Tree()
            self._grow(tree, binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), 0)
            self.trees.append(tree)
            f += tree.predict(x)
        return self

    def _grow(self, tree: Tree, binned, cuts, g, h, rows, depth: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = tree.node(-self.rate * gs / (hs + self.ridge))
        if depth == self.depth:
            return me
        best = (1e-6, None, None)
        for k, q in enumerate(cuts):
            if not len(q):
                continue
            size = len(q) + 1
            gl = np.cumsum(np.bincount(binned[rows, k], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, k], h[rows], size))[:-1]
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(hl < self.least * 0.05) | (hs - hl < self.least * 0.05)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        if best[1] is None:
            return me
        _, k, at = best
        goes = binned[rows, k] <= at
        tree.feature[me], tree.cut[me] = k, float(cuts[k][at])
        tree.left[me] = self._grow(tree, binned, cuts, g, h, rows[goes], depth + 1)
        tree.right[me] = self._grow(tree, binned, cuts, g, h, rows[~goes], depth + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(t.predict(x) for t in self.trees))))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing step function, by pooling adjacent violators."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
    for a, b in zip(p[order], y[order]):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees | None
    points: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        p = self.trees.predict(x)
        # The calibrated step, joined by lines, with a trace of the raw score so that order is kept within a step.
        return np.clip(0.98 * np.interp(p, *self.points) + 0.02 * p, 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy(F.col("doc_id").cast("long").alias("_lid")).agg(F.max("toxic").cast("int").alias("_y")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows)
    # The sample has max_rows ids at most, so it can be broadcast.
    texts = _util.id_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("_id") == F.col("_lid"))
    # Of texts that repeat an id the least one counts.
    texts = texts.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y"))
    texts = _util.materialize(texts.select("_id", "_text", "_y", (F.pmod(F.xxhash64("_id"), F.lit(3)) != 2).alias("fit")), "sample")

    def distinct_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bytes, int], int] = {}
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for u in {u for w in set(text.lower().translate(_KEEP).split()) if 3 <= len(w) <= 40 for u in units(w)}:
                    found[u, y] = found.get((u, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.binary()), pa.array([c if k[1] else 0 for k, c in found.items()], pa.int64()), pa.array([c for c in found.values()], pa.int64())], ["unit", "toxic", "all"])

    total = texts.where("fit").agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    n, toxic = int(total[0]), int(total[1])
    share = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return Model(Lexicon({}), None, (np.zeros(1), np.zeros(1)), share)
    counted = texts.where("fit").select("_id", "_text", "_y").mapInArrow(distinct_units, "unit binary, toxic long, all long").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("all").alias("b"))
    odds = (F.col("a") / toxic) / ((F.col("b") - F.col("a") + 0.5) / (n - toxic + 1))
    mined = counted.where((F.col("a") >= MINED_DOCS) & (odds >= MINED_ODDS)).select("unit", "a", F.log(odds).alias("weight")).orderBy(F.desc("a"), "unit").limit(MINED_UNITS).collect()
    lexicon = Lexicon({bytes(r["unit"]): float(r["weight"]) for r in mined})

    rows = texts.select("_id", "_text", "_y", "fit").mapInArrow(_featurize(lexicon), "id long, y int, fit boolean, x array<double>").toPandas().sort_values("id")
    x, y, fit = np.array(rows["x"].tolist()), rows["y"].to_numpy(float), rows["fit"].to_numpy(bool)
    trees = BoostedTrees().fit(x[fit], y[fit])
    test = ~fit if min(y[~fit].sum(), (1 - y[~fit]).sum()) >= 1 else fit
    return Model(lexicon, trees, isotonic(trees.predict(x[test]), y[test]), share)


def _featurize(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t, lexicon) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), x], ["id", "y", "fit", "x"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model.score(np.array([features(t, model.lexicon) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float64)), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = _util.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    _util.tune(docs.sparkSession)
    return score(docs, train(docs, labels, **options))
