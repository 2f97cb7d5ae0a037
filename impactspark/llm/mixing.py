"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised. Smaller exponents are flatter:
entropy falls and the largest repetition (budget times weight over tokens) rises as they flatten, each monotone in
a, so a bisection finds the exponent for a target entropy, or the flattest that repeats no source more than a limit.
All that the bisection needs of the sources is two sums for an exponent, S = sum p^a and L = sum p^a ln p, and the
least source, so sources may be as many as they like: their sums are taken in numpy where the sources are few and in
Spark where they aren't.
Each source's documents are dealt into blocks of about ``block_tokens`` words by a hash of the document; its blocks
are permuted anew for each epoch; a source of weight w gets blocks along its permutations until budget times w
words are reached. All but the last epoch are whole permutations; within the block where the budget ends, documents
are taken in hash order while they begin within it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.llm._shared import table, written

#: So many sources have their totals on the driver; of more, sums are taken in Spark.
FEW_SOURCES = 100_000
BLOCK_TOKENS, MOST_BLOCKS = 50_000, 200_000
#: Rows of blocks or sources (some 100 bytes each) are broadcast after a count, up to so many.
BROADCAST_ROWS = 500_000
#: Exponents tried at once where sums are taken in Spark: four halvings a round.
AT_ONCE = 15

Moments = Callable[[list[float]], list[tuple[float, float]]]


@dataclass(frozen=True)
class Mixture:
    exponent: float
    weights: dict[str, float]
    repeats: dict[str, float]
    entropy: float


@dataclass(frozen=True)
class Sources:
    """The sources with tokens: how many, their tokens in all, the least of them, and S and L by exponent."""

    n: int
    total: int
    least: int
    moments: Moments

    def entropy(self, s: float, part: float, a: float) -> float:
        return math.log(s) - a * part / s

    def most_repeats(self, s: float, a: float, budget: float) -> float:
        """Of the least source, as p^(a - 1) falls with p."""
        return budget * (self.least / self.total) ** a / s / self.least


def _numpy_moments(tokens: list[int]) -> Moments:
    p = np.sort(np.asarray(tokens, np.float64)) / float(sum(tokens))
    logs = np.log(p)

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        return [(float((q := np.exp(a * logs)).sum()), float((q * logs).sum())) for a in exponents]

    return moments


def _spark_moments(totals: DataFrame, total: int) -> Moments:
    p = F.col("t") / F.lit(float(total))

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        row = totals.agg(*(c for a in exponents for c in (F.sum(F.pow(p, F.lit(float(a)))), F.sum(F.pow(p, F.lit(float(a))) * F.log(p))))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]

    return moments


def exponent(sources: Sources, budget: float, target_entropy: float | None = None, max_repeats: float | None = None, at_once: int = 1) -> float:
    """The exponent for the limits; both may be given, and the repetition limit has the last word."""

    def least(fits: Callable[[float, float, float], bool]) -> float:
        """The smallest exponent for which fits holds, if it holds from there to 1."""
        low, high = 0.0, 1.0
        if fits(*sources.moments([0.0])[0], 0.0):
            return 0.0
        for _ in range(math.ceil(60 / math.log2(at_once + 1))):
            tried = [low + (high - low) * (i + 1) / (at_once + 1) for i in range(at_once)]
            good = [fits(*m, a) for m, a in zip(sources.moments(tried), tried, strict=True)]
            first = good.index(True) if True in good else at_once
            low, high = tried[first - 1] if first else low, tried[first] if first < at_once else high
        return high

    a = 0.0 if target_entropy is None and max_repeats is not None else 1.0
    if target_entropy is not None:
        natural, flat = sources.entropy(*sources.moments([1.0])[0], 1.0), math.log(sources.n)
        goal = natural + target_entropy * (flat - natural)
        a = least(lambda s, part, x: sources.entropy(s, part, x) <= goal)
    if max_repeats is not None:
        a = max(a, least(lambda s, _, x: sources.most_repeats(s, x, budget) <= max_repeats))
    return a


def solve(tokens: dict[str, int], budget: float, target_entropy: float | None = None, max_repeats: float | None = None) -> Mixture:
    """The exponent and weights for the source totals.

    target_entropy is a share (0 to 1) of the way from the natural entropy to the entropy of equal weights. Sources
    without tokens get no weight. If even natural weights repeat more than the limit (the budget is too large for
    the corpus), the exponent is 1.
    """
    tokens = {k: v for k, v in tokens.items() if v > 0}
    if not tokens:
        return Mixture(1.0, {}, {}, 0.0)
    sources = Sources(len(tokens), sum(tokens.values()), min(tokens.values()), _numpy_moments(list(tokens.values())))
    a = exponent(sources, budget, target_entropy, max_repeats)
    s, part = sources.moments([a])[0]
    w = {k: (v / sources.total) ** a / s for k, v in tokens.items()}
    return Mixture(a, w, {k: budget * v / tokens[k] for k, v in w.items()}, sources.entropy(s, part, a))


def targets_of(totals: DataFrame, budget_share: float, target_entropy: float | None, max_repeats: float | None, few: int = FEW_SOURCES) -> tuple[DataFrame, int]:
    """totals(mix_source, t) with mix_target, the words that each source gets; and all tokens."""
    n, total, least = totals.where("t > 0").agg(F.count(F.lit(1)), F.sum("t"), F.min("t")).first()
    if not n:
        return totals.withColumn("mix_target", F.lit(0.0)), 0
    live = totals.where("t > 0")
    moments = _numpy_moments([r[0] for r in live.select("t").collect()]) if n <= few else _spark_moments(live, total)
    sources, budget = Sources(n, total, least, moments), budget_share * total
    a = exponent(sources, budget, target_entropy, max_repeats, 1 if n <= few else AT_ONCE)
    share = F.pow(F.col("t") / F.lit(float(total)), F.lit(a)) / F.lit(sources.moments([a])[0][0])
    return totals.withColumn("mix_target", F.when(F.col("t") > 0, F.lit(float(budget)) * share).otherwise(0.0)), total


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


COLUMNS = ("mix_tokens", "mix_epoch", "mix_block", "mix_order")


def mixed(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.5, max_repeats: float | None = 4.0, block_tokens: int = BLOCK_TOKENS, most_blocks: int = MOST_BLOCKS, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ...) repeated to the mixture: its columns and mix_tokens, mix_epoch, mix_block, mix_order.

    The budget is budget_share of all words. mix_order orders a source's blocks over all epochs. Blocks hold about
    block_tokens words, or the corpus over most_blocks if that is more. A null source is a source of its own, named
    by the empty text. Wordless documents and nulls are kept with their block. Repeated rows share a block and enter
    or stay out together. An empty table stays empty. Columns of docs that bear one of the new names are replaced,
    all others, whatever their names, pass as they are.

    Texts are read twice (their words counted, then the rows placed) and never shuffled: rows meet their blocks and
    sources by broadcast up to BROADCAST_ROWS of these.
    """
    kept = [c for c in docs.columns if c not in COLUMNS]
    text = F.coalesce("text", F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text, F.lit(seed)).alias("mix_key")
    rows = written(docs.select(source, word_count(F.col("text")).alias("mix_tokens"), key), "mix_rows")
    totals = written(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("t")), "mix_totals")
    weighed, total = targets_of(totals, budget_share, target_entropy, max_repeats)
    of = max(block_tokens, total // most_blocks)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(of))).cast("long")
    targets = _small(weighed.select("mix_source", blocks.alias("mix_blocks"), "mix_target", F.col("t").alias("mix_total")))
    block = F.pmod(F.xxhash64("mix_key", F.lit(1)), F.col("mix_blocks"))
    dealt = rows.join(targets.select("mix_source", "mix_blocks"), "mix_source").withColumn("mix_block", block)
    sizes = dealt.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("size"))
    whole_epochs = F.when(F.col("mix_total") > 0, F.floor(F.col("mix_target") / F.col("mix_total"))).otherwise(0).cast("int")
    epochs = sizes.join(targets, "mix_source").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), whole_epochs)))
    line = Window.partitionBy("mix_source", "mix_epoch").orderBy(F.xxhash64("mix_source", "mix_epoch", "mix_block", F.lit(seed)), "mix_block")
    begin = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("mix_epoch") * F.col("mix_total")
    runs = epochs.withColumn("begin", begin).withColumn("place", F.row_number().over(line)).where("begin < mix_target or mix_total = 0")
    order = (F.col("mix_epoch") * F.col("mix_blocks") + F.col("place")).alias("mix_order")
    runs = written(runs.select("mix_source", "mix_block", "mix_epoch", order, (F.col("begin") + F.col("size") > F.col("mix_target")).alias("last"), (F.col("mix_target") - F.col("begin")).alias("room")), "mix_blocks")
    # Where the budget ends within a block: the greatest key that begins before it.
    inside = Window.partitionBy("mix_source", "mix_epoch", "mix_block").orderBy("mix_key")
    ends = dealt.groupBy("mix_source", "mix_block", "mix_key").agg(F.sum("mix_tokens").alias("t")).join(runs.where("last"), ["mix_source", "mix_block"])
    before = F.coalesce(F.sum("t").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("before", before).where("before < room").groupBy("mix_source", "mix_epoch", "mix_block").agg(F.max("mix_key").alias("until"))
    runs = runs.join(ends, ["mix_source", "mix_epoch", "mix_block"], "left").select("mix_source", "mix_block", "mix_epoch", "mix_order", "until")
    runs = _small(written(runs, "mix_runs"))
    full = docs.select(F.struct(*kept).alias("mix_row"), source, word_count(F.col("text")).alias("mix_tokens"), key)
    placed = full.join(targets.select("mix_source", "mix_blocks"), "mix_source").withColumn("mix_block", block)
    found = placed.join(runs, ["mix_source", "mix_block"]).where("until is null or mix_key <= until")
    return found.select(*(F.col("mix_row").getField(c).alias(c) for c in kept), *COLUMNS)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half way to equal weights, at most four repetitions, as many words as the corpus has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")
