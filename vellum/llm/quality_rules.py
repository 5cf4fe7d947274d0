"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

A rule rejects a text whose measure exceeds a cutoff.  The cutoffs are chosen on
labelled good texts that the base rule keeps, in two halves by the hash of the
id.  In each stratum the first half orders all pairs of a rule and a cutoff by
the good texts they reject; adding them one by one gives ever stricter settings.
The second half tests these in that order, each with the exact binomial tail

    P(Bin(n, limit) <= k) <= level / strata,

where ``n`` is the number of its good texts and ``k`` those that *any* rule of
the setting rejects.  The last setting before the first failure is used.  So
all rules together reject at most ``limit`` of a stratum's good texts, at that
confidence in all strata at once: Bonferroni's division corrects for the strata,
and along one order that the tested texts didn't shape, testing up to the first
failure needs no correction.  In a stratum without a passing setting the base
rule decides alone.

Cases: a null or empty text has no words and fails the base rule; null ids are
kept, unlabelled; a null or unlisted stratum is ``other``; repeated labels count
once each; with no labels no cutoff passes and the base rules alone decide; an
empty table gives an empty one; other columns are not read.  The repeated
windows of a text are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

# White space of the contract.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Candidate cutoffs of each rule, from the laxest; a measure above its cutoff rejects.
CUTOFFS = {
    "symbol_ratio": (0.30, 0.20, 0.10, 0.05, 0.02),
    "dup_line_ratio": (0.60, 0.45, 0.30, 0.20, 0.10),
    "repeat_ratio": (0.45, 0.35, 0.25, 0.15, 0.10),
    "upper_ratio": (0.60, 0.45, 0.30, 0.20, 0.12),
    "long_word": (30.0, 20.0, 15.0, 12.0, 10.0),
}
#: The strata; others are tested together.  Their number is fixed, and so is the size of the result.
STRATA = ("en", "de", "fr", "es", "other")


#: At most this share of a stratum's good texts may be rejected by all rules together, at this error level over all strata.
LIMIT, LEVEL = 0.02, 0.05


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts and measures of every whole text; a narrow plan.

    The words of repeated 3-word windows: a key is a window's hash and its
    position, so that one sort brings equal windows together.  The positions with an equal neighbour
    are sorted again, and each covers the words up to the next, three at most.
    """
    stratum = F.col(stratum_col).cast("string")
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(stratum.isin(*STRATA), stratum).otherwise("other").alias("stratum"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    out = out.withColumn("words", F.filter(F.split("text", f"{SPACE}+", -1), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"lines": lines, "windows": F.greatest(F.size("words") - 2, F.lit(0))})
    hashed = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    out = out.select(
        "doc_id",
        "stratum",
        "windows",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
        F.when(F.col("windows") >= 2, hashed).otherwise(F.expr("cast(array() as array<bigint>)")).alias("hashes"),
    )
    key = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), i.cast("long").alias("at")))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    out = out.withColumn("keys", F.when(repeats, F.sort_array(key)))
    equal = lambda k, i: F.coalesce(k["hash"] == F.get("keys", i)["hash"], F.lit(False))
    found = F.filter("keys", lambda k, i: equal(k, i - 1) | equal(k, i + 1))
    at = F.sort_array(F.transform(found, lambda k: k["at"]))
    covered = F.aggregate(
        at,
        F.expr("named_struct('last', -3L, 'n', 0L)"),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return out.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("n_upper", "word_chars").alias("upper_ratio"),
        share("word_chars", "n_words").alias("long_word"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)``, exact, summed from logarithms of its terms."""
    odds = F.log(F.lit(p / (1 - p)))
    zero = F.struct((n * F.log(F.lit(1 - p))).cast("double").alias("term"), F.exp(n * F.log(F.lit(1 - p))).cast("double").alias("sum"))
    step = lambda acc, i: acc["term"] + F.log((n - i + 1) / i) + odds
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(steps, zero, lambda acc, i: F.struct(step(acc, i).alias("term"), (acc["sum"] + F.exp(step(acc, i))).alias("sum")), lambda acc: acc["sum"])


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def select_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL, label_col: str = "quality") -> list[tuple[str, str, float]]:
    """The strictest cutoff of each stratum and rule in the stratum's last passing setting.

    ``(len(STRATA) + 1) * len(pairs)`` rows at most come to the driver, twice.
    """
    pairs = [(rule, step, cutoff) for rule, cutoffs in CUTOFFS.items() for step, cutoff in enumerate(cutoffs)]
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).alias("_good")).where("_good = 1")
    held = measured.join(good, measured["doc_id"] == good["_id"], "left_semi").where(~_base_failed())
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rejected = held.where(half == 0).groupBy("stratum").agg(*[F.count_if(F.col(rule) > cutoff).alias(f"k{i}") for i, (rule, _, cutoff) in enumerate(pairs)])
    # A stricter cutoff of a rule rejects no fewer texts, and of equal counts the laxer step comes first.
    paths = {r["stratum"]: sorted(pairs, key=lambda p, r=r: (r[f"k{pairs.index(p)}"], p[1], p[0])) for r in rejected.collect()}
    if not paths:
        return []
    first = F.lit(None).cast("int")
    for stratum, path in paths.items():
        # The first setting that rejects a text; the later ones reject it too.
        found = F.array_min(F.array(*[F.when(F.col(rule) > cutoff, i) for i, (rule, _, cutoff) in enumerate(path)]))
        first = F.when(F.col("stratum") == stratum, found).otherwise(first)
    tests = F.array(*[F.struct(F.lit(i).alias("setting"), F.count_if(F.col("_first") <= i).alias("k")) for i in range(len(pairs))])
    counted = held.where(half == 1).withColumn("_first", first).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), tests.alias("tests"))
    rows = counted.select("stratum", "n", F.explode("tests").alias("t")).select("stratum", "n", "t.*")
    # Beyond the mean of the distribution the tail is near a half or more, so nothing is summed there.
    passed = F.when(F.col("k") > F.col("n") * limit, False).otherwise(binomial_tail(F.col("k"), F.col("n"), limit) <= level / len(STRATA))
    ends = rows.withColumn("passed", passed).groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("setting"))), F.lit(len(pairs))).alias("end")).collect()
    chosen = {}
    for r in ends:
        for rule, _, cutoff in paths.get(r["stratum"], ())[: r["end"]]:
            chosen[r["stratum"], rule] = min(cutoff, chosen.get((r["stratum"], rule), cutoff))
    return sorted((stratum, rule, cutoff) for (stratum, rule), cutoff in chosen.items())


def judge(measured: DataFrame, cutoffs: list[tuple[str, str, float]]) -> DataFrame:
    """Add ``base_failed``, ``broken_rules`` and ``kept``."""
    broken = [F.when((F.col("stratum") == s) & (F.col(rule) > c), F.lit(rule)) for s, rule, c in sorted(cutoffs)]
    out = measured.withColumn("base_failed", _base_failed())
    out = out.withColumn("broken_rules", F.array_join(F.array(*broken), ",") if broken else F.lit(""))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def filter_by_rules(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """Measure every document once, choose cutoffs on the labelled ones, judge all."""
    measured = _util.materialize(measures(docs), "measures")
    return judge(measured, select_cutoffs(measured, labels, limit, level))
