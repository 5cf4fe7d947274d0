"""URL filter: rules first, then the likelihood ratio of two character models.

Urls that a rule decides are the labelled ones: accepted and rejected.  One
variable-order Markov model of characters is trained for each; the probability
of a character after a context of ``k`` characters is smoothed with that after
``k - 1`` characters, down to a uniform one:

    p_k(c | context) = (count(context c) + STRENGTH * p_(k-1)) / (count(context) + STRENGTH).

What the rules look at would give the labels away, so the models never see it:
of each url, labelled or not, they read the host without its last label and
without the labels that any rule names, and the path after its first segment.

A url that no rule decides is blocked when the difference of its
log-likelihoods, accepted less rejected, divided by its length is under the
cut.  The cut is calibrated on labelled urls that the models haven't seen: at
most ``false_block`` of the accepted ones fall under it.

A context of five bytes and its character make one number, so the counts are
exact: a table with a row for each such gram of the labelled urls but the
calibration fifth, which grows with them.  Shorter grams are its sums by their
last bytes.  No more than the grams of two bytes, 65,536 at most, are broadcast;
all else is joined.  Urls are scored in blocks: a block's distinct grams meet the
table, and what they are worth comes back to the block.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed with a null score; without accepted urls to calibrate on the
cut is 0; null ids are kept; repeated rows give
repeated results; without both classes of labelled urls the undecided are
allowed; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

# The rules of the contract; host suffix, path start, verdict.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
ORDERS = 5
STRENGTH = 2.0
ALPHABET = 256
LEAST = 1e-12


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Of two fitting rules the longer one, as a string, wins: it is asked first.
    for suffix, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        shown = suffix + start
        out = F.when(fits, F.struct(F.lit(shown).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def unlabelled(host: Column, path: Column, rules=RULES) -> Column:
    """What is left of host and path without all that the rules look at."""
    named = sorted({label for suffix, _, _ in rules for label in suffix.split(".")})
    labels = F.split(host, r"\.")
    kept = F.filter(F.slice(labels, F.lit(1), F.size(labels) - 1), lambda x: ~x.isin(*named))
    return F.concat(F.array_join(kept, "."), F.regexp_replace(path, "^/[^/]*", ""))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character, or at the text's end, as a number, and the text it is of."""
    padded = [b"\x02" * ORDERS + t + b"\x03" for t in texts]
    b = np.frombuffer(b"".join(padded), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    n = max(len(b) - ORDERS, 0)
    keys = np.zeros(n, np.int64)
    for k in range(ORDERS + 1):
        keys = keys << 8 | b[k : k + n]
    inside = owner[:n] == owner[ORDERS:]
    return keys[inside], owner[:n][inside]


def _counts(urls: DataFrame) -> DataFrame:
    """``key, n0, n1``: how often each gram is in rejected and accepted urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = grams(batch.column(0).to_pylist())
            found, at = np.unique(keys, return_inverse=True)
            label = np.array(batch.column(1).to_pylist(), np.int64)[owner]
            n = np.bincount(2 * at + label, minlength=2 * len(found)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[:, 0]), pa.array(n[:, 1])], ["key", "n0", "n1"])

    return urls.mapInArrow(run, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _last(n: int) -> int:
    """The mask of a gram's last ``n`` bytes."""
    return (1 << 8 * n) - 1


@dataclass
class Model:
    counts: DataFrame

    @cached_property
    def tables(self) -> np.ndarray:
        """All counts, in one place: for single urls and small tables only."""
        return np.array(sorted(map(tuple, self.counts.collect())), np.int64).reshape(-1, 3)

    def score(self, text: bytes) -> float:
        """Mean log-likelihood difference for each character."""
        known, total = self.tables[:, 0], 0.0
        for key in grams([text])[0].tolist():
            p = np.full(2, 1 / ALPHABET)
            for k in range(ORDERS + 1):
                gram = self.tables[known & _last(k + 1) == key & _last(k + 1), 1:].sum(0)
                context = self.tables[known >> 8 & _last(k) == key >> 8 & _last(k), 1:].sum(0)
                p = (gram + STRENGTH * p) / (context + STRENGTH)
            rejected, accepted = np.log(np.clip(p, LEAST, None))
            total += float(accepted - rejected)
        return total / (len(text) + 1)

    def worth(self, asked: DataFrame) -> DataFrame:
        """``key, worth``: the log-likelihood difference of each gram that is counted or asked for."""
        both = self.counts.unionByName(asked.select("key", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1")))
        both = _util.materialize(both.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
        tail = lambda c, n: F.col(c).bitwiseAND(F.lit(_last(n)).cast("long"))
        known = None
        for k in range(ORDERS + 1):
            # Contexts of up to two bytes and grams of up to two are bounded tables.
            small = F.broadcast if k <= 2 else lambda df: df
            context = both.groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(_last(k)).cast("long")).alias("context")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
            level = both.groupBy(tail("key", k + 1).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            level = level.withColumn("context", F.shiftright("key", 8)).join(small(context), "context")
            if known is None:
                level = level.withColumns({"q0": F.lit(1 / ALPHABET), "q1": F.lit(1 / ALPHABET)})
            else:
                lower = known.select(F.col("key").alias("lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
                level = level.withColumn("lower", tail("key", k)).join(small(lower), "lower")
            known = level.select("key", *[((F.col(f"n{c}") + STRENGTH * F.col(f"q{c}")) / (F.col(f"c{c}") + STRENGTH)).alias(f"p{c}") for c in (0, 1)])
        return known.select("key", (F.log(F.greatest("p1", F.lit(LEAST))) - F.log(F.greatest("p0", F.lit(LEAST)))).alias("worth"))


def train(labelled: DataFrame) -> Model | None:
    """From ``text binary, label int`` (1: accepted); None without both classes."""
    counts = _util.materialize(_counts(labelled), "counts")
    sums = counts.agg(F.sum("n0"), F.sum("n1")).first()
    return Model(counts) if sums[0] and sums[1] else None


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _scored(df: DataFrame, model: Model, column: str) -> DataFrame:
    """All columns of ``df`` with the score of the bytes in ``column``, none of them null."""
    names = df.columns
    at = names.index(column)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, first + k))], [*names, "_block"])

    # Written, so that a row's block stays what it is.
    rows = _util.materialize(df.mapInArrow(block, _fields(df) + ", _block long"), "blocks")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = grams(batch.column(0).to_pylist())
            blocks = batch.column(1).to_numpy()
            for b in np.unique(blocks):
                found = np.unique(keys[blocks[owner] == b])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(found)], ["_block", "key"])

    asked = _util.materialize(rows.select(column, "_block").mapInArrow(distinct, "_block long, key long"), "asked")
    worth = asked.join(model.worth(asked.select("key")), "key").select("_block", "key", "worth")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, owner = grams(left.column(at).to_pylist())
        known, first = np.unique(right.column("key").to_numpy(), return_index=True)
        each = right.column("worth").to_numpy()[first][np.searchsorted(known, keys)]
        n = left.num_rows
        means = np.bincount(owner, each, n) / np.bincount(owner, minlength=n)
        return left.drop_columns("_block").append_column("score", pa.array(means))

    return rows.groupBy("_block").cogroup(worth.groupBy("_block")).applyInArrow(score, _fields(df) + ", score double")


def filter_urls(pages: DataFrame, rules=RULES, false_block: float = 0.01, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is of undecided urls only."""
    _util.tune(pages.sparkSession)
    host, path = parse(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.xxhash64(F.col(url_col)) % 5 == 0).alias("held"))
    base = base.withColumn("by_rule", decide(F.col("host"), F.col("path"), rules)).withColumn("text", F.when((F.col("host") != "") | (F.col("path") != ""), unlabelled(F.col("host"), F.col("path"), rules).cast("binary")))
    labelled = base.where("by_rule is not null").select("text", (F.col("by_rule.verdict") == "allow").cast("int").alias("label"), "held")
    model = train(labelled.where("not held").select("text", "label"))
    rule = F.col("by_rule.rule").alias("rule")
    if model is None:
        return base.select("page_id", "host", "path", rule, F.coalesce("by_rule.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    # What is scored: the undecided, and the accepted ones that calibrate the cut.
    asked = base.where("text is not null and (by_rule is null or (held and by_rule.verdict = 'allow'))")
    scored = _util.materialize(_scored(asked.select("page_id", "host", "path", "text", F.col("by_rule").isNull().alias("open")), model, "text"), "scores")
    cut = scored.where("not open").agg(F.percentile_approx("score", false_block, 10_000)).first()[0]
    cut = 0.0 if cut is None else cut
    shown = lambda df, rule, verdict, score: df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), score.alias("score"))
    rest = shown(base.where("by_rule is not null or text is null"), rule, F.coalesce("by_rule.verdict", F.lit("allow")), F.lit(None).cast("double"))
    return rest.unionByName(shown(scored.where("open"), F.lit(None).cast("string"), F.when(F.col("score") < cut, "block").otherwise("allow"), F.col("score")))
