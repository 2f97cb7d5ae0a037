"""Statistics over result lists: paired t-tests, correlations, ranks, histograms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from impactspark.operators.index import gaps


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def student_cdf(t: float, freedom: float) -> float:
    tail = 0.5 * _beta(freedom / 2, 0.5, freedom / (freedom + t * t))
    return 1 - tail if t > 0 else tail


def t_test(a: list[float], b: list[float], tails: int = 2) -> float:
    """The p-value of a paired t-test; 1 for fewer than two pairs, unequal lengths or no difference."""
    if len(a) != len(b) or len(a) <= 1:
        return 1.0
    d = [x - y for x, y in zip(a, b, strict=True)]
    n, mean = len(d), sum(d) / len(d)
    spread = math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1))
    return p_value(n, mean, spread, tails)


def p_value(n: int, mean: float, spread: float, tails: int = 1) -> float:
    """p of a paired t-test from the differences' count, mean and deviation; 1 for fewer than two pairs and without any
    difference, 0 where all differ alike."""
    if n <= 1 or not mean:
        return 1.0
    return tails * (1 - student_cdf(abs(mean) / (spread / math.sqrt(n)), n - 1)) if spread else 0.0


def p_values(n: Column, mean: Column, spread: Column, tails: int = 1) -> Column:
    """p_value() of each row; there is a row for each pair of runs."""

    @pandas_udf(DoubleType())
    def run(n: pd.Series, mean: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([p_value(int(a), 0.0 if pd.isna(b) else b, 0.0 if pd.isna(c) else c, tails) for a, b, c in zip(n, mean, spread, strict=True)], dtype="float64")

    return run(n, mean, spread)


#: Measures that runs are tested by.
TESTED = ("rr", "f1", "f1_at_30", "ap", "bp", "bp4", "sp", "cheapest_p", "pb_ndcg", "bp_ndcg")


def differences(per_query: DataFrame, measures: list[str] | tuple[str, ...]) -> DataFrame:
    """(measure, run_a, run_b, n, mean, spread) of each pair of runs over the queries both have: an equi-join on the query."""
    long = per_query.unpivot(["run_id", "query_id"], list(measures), "measure", "x")
    a, b = long.withColumnRenamed("run_id", "run_a"), long.withColumnsRenamed({"run_id": "run_b", "x": "y"})
    d = F.col("x") - F.col("y")
    return a.join(b, ["measure", "query_id"]).where("run_a < run_b").groupBy("measure", "run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("spread"))


def t_test_matrices(per_query: DataFrame, measures: list[str] | tuple[str, ...], tails: int = 1) -> DataFrame:
    """(measure, run_a, run_b, n, t, p) of each pair of runs; t is null where nothing varies. p is of |t|, so a pair stands
    for both its orders."""
    found = differences(per_query, [m for m in measures if m in per_query.columns])
    t = F.when((F.col("n") > 1) & (F.col("spread") > 0), F.col("mean") / (F.col("spread") / F.sqrt("n")))
    return found.select("measure", "run_a", "run_b", "n", t.alias("t"), p_values(F.col("n"), F.col("mean"), F.col("spread"), tails).alias("p"))


def t_matrix(per_query: DataFrame, measure: str) -> DataFrame:
    """(run_a, run_b, n, t) by one measure."""
    return t_test_matrices(per_query, [measure]).drop("measure", "p")


def t_test_matrix(per_query: DataFrame, measure: str, tails: int = 1) -> DataFrame:
    """(run_a, run_b, n, t, p) by one measure."""
    return t_test_matrices(per_query, [measure], tails).drop("measure")


def fractional_rank(value: str, *within: str) -> Column:
    """The mean rank of equals."""
    order, ties = Window.partitionBy(*within).orderBy(value), Window.partitionBy(*within, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient; null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(correlation(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    ranked = df.withColumn("__x", fractional_rank(x, *by)).withColumn("__y", fractional_rank(y, *by))
    return ranked.groupBy(*by).agg(correlation("__x", "__y").alias("spearman"))


def spearman_matrix(per_run: DataFrame, measures: list[str]) -> DataFrame:
    """(measure_a, measure_b, spearman) over the runs' averages: unpivoted, ranked, joined on the run."""
    long = per_run.unpivot("run_id", measures, "measure", "value").withColumn("place", fractional_rank("value", "measure"))
    a = long.select("run_id", F.col("measure").alias("measure_a"), F.col("place").alias("x"))
    b = long.select("run_id", F.col("measure").alias("measure_b"), F.col("place").alias("y"))
    return a.join(b, "run_id").where("measure_a < measure_b").groupBy("measure_a", "measure_b").agg(correlation("x", "y").alias("spearman"))


def gap_widths(postings: DataFrame) -> DataFrame:
    """(bits, n): how many gaps between a term's documents need so many bits; the first gap is the first id plus 1."""
    return gaps(postings).groupBy(F.length(F.bin("gap")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))


def gap_shapes(postings: DataFrame, percentile: float = 90.0) -> DataFrame:
    """(n, mean, mode, exception, lists): how many lists have so many gaps, a mean width (rounded up), a most frequent
    width (the least of them), and a width at which the percentile of their gaps is reached; widths are ceil(log2) of
    the gap, 1 for none."""
    width = F.greatest(F.lit(1), F.length(F.bin(F.col("gap") - 1))).alias("w")
    counts = gaps(postings).select("term", width).groupBy("term", "w").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("term").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy("term")))
    reached = F.min(F.when(F.col("upto") * 100.0 >= F.col("n") * F.lit(percentile), F.col("w")))
    mode = F.max_by("w", F.struct("c", -F.col("w")))
    lists = summed.groupBy("term").agg(F.first("n").alias("n"), F.ceil(F.sum(F.col("w") * F.col("c")) / F.first("n")).alias("mean"), mode.alias("mode"), reached.alias("exception"))
    return lists.groupBy("n", "mean", "mode", "exception").agg(F.count(F.lit(1)).alias("lists"))


def by_length(times: DataFrame, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(length, low, mean, median, high) of times(length, value). The median is a sketch's, merged map-side, unless exact:
    then the values of a length meet in one task."""
    median = F.median("value") if exact else F.percentile_approx("value", 0.5, accuracy)
    return times.groupBy("length").agg(F.min("value").alias("low"), F.avg("value").alias("mean"), median.alias("median"), F.max("value").alias("high"))
