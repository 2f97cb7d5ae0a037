"""Effectiveness of ranked lists, with and without prices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RBP_P, FIRST_K = 0.95, 4


def judged(runs: DataFrame, qrels: DataFrame, prices: DataFrame | None = None, file_order: bool = False) -> DataFrame:
    """Results in place, with their judgement and price and what is before them.

    runs(run_id, query_id, doc_id, rank), qrels(query_id, doc_id, score), prices(doc_id, price). Unjudged results
    score 0, unpriced ones cost 0. Adds pos, rel, nth (relevant up to here), graded (their sum), spent and relevant
    (judged so for the query, whether found or not). In file order results stand as their lines do (runs has 'at'),
    and of a query that comes again further on only the first lines count.
    """
    if file_order:
        lines = Window.partitionBy("run_id").orderBy("at")
        new = (F.col("query_id") != F.coalesce(F.lag("query_id").over(lines), F.lit("\u0000"))).cast("int")
        blocks = runs.withColumn("new", new).withColumn("block", F.sum("new").over(lines))
        runs = blocks.withColumn("least", F.min("block").over(Window.partitionBy("run_id", "query_id"))).where("block = least").drop("new", "block", "least")
    line = Window.partitionBy("run_id", "query_id").orderBy(*(["at"] if file_order else ["rank", "doc_id"]))
    total = qrels.groupBy("query_id").agg(F.sum((F.col("score") != 0).cast("int")).alias("relevant"))
    rows = runs.join(qrels.select("query_id", "doc_id", F.col("score").alias("judged")), ["query_id", "doc_id"], "left").join(total, "query_id", "left")
    rows = rows.join(prices, "doc_id", "left") if prices is not None else rows.withColumn("price", F.lit(0.0))
    rows = rows.withColumn("judged", F.coalesce("judged", F.lit(0.0)).cast("double")).withColumn("price", F.coalesce("price", F.lit(0.0)).cast("double")).withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    rel = (F.col("judged") != 0).cast("int")
    return rows.withColumn("rel", rel).withColumn("pos", F.row_number().over(line)).withColumn("nth", F.sum("rel").over(run)).withColumn("graded", F.sum("judged").over(run)).withColumn("spent", F.sum("price").over(run))


def _over(top: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(top, value)), F.lit(0))


def measures(rows: DataFrame, cuts: tuple[int, ...] = CUTS, first_k: int = FIRST_K, p: float = RBP_P) -> DataFrame:
    """One row for each run and query: counts, precision, recall and F1 plain and at the cuts, AP, RR, first-k, ESL, RBP.

    Recall without relevant documents is 0; AP is 1 there.
    """
    rel, pos, nth, relevant = F.col("rel"), F.col("pos"), F.col("nth"), F.first("relevant")
    returned = F.count(F.lit(1))
    found = F.sum("rel")
    out = [returned.alias("returned"), relevant.alias("relevant"), found.alias("relevant_returned"), F.sum("judged").alias("graded_returned")]

    def prf(name: str, precision: Column, recall: Column) -> list[Column]:
        f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
        return [precision.alias(f"p{name}"), recall.alias(f"r{name}"), f1.alias(f"f1{name}")]

    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out += prf("", F.sum("judged") / returned, share(found, relevant))
    for n in cuts:
        out += prf(f"_at_{n}", _over(pos <= n, F.col("judged")) / F.lit(n), share(_over(pos <= n, rel), F.least(relevant, F.lit(n))))
    first = F.min(F.when(rel == 1, pos))
    reach = F.when(_over(nth <= first_k, rel) >= first_k, _over((rel == 1) & (nth <= first_k), F.lit(1.0) / pos) / F.lit(first_k)).otherwise(0.0)
    out += [
        F.when(relevant == 0, 1.0).otherwise(_over(rel == 1, nth / pos) / relevant).alias("ap"),
        F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr"),
        reach.alias(f"rr{first_k}"),
        (F.coalesce(first - 1, returned)).cast("long").alias("esl"),
        (F.lit(1 - p) * _over(rel == 1, F.pow(F.lit(p), pos - 1))).alias("rbp"),
    ]
    return rows.groupBy("run_id", "query_id").agg(*out)


BINS = 5


def price_measures(rows: DataFrame, qrels: DataFrame, prices: DataFrame, k: int = FIRST_K, depth: int | None = None) -> DataFrame:
    """One row for each run and query: bp, bp{k}, sp, cheapest_p, pb_ndcg and bp_ndcg of rows from judged().

    All are 1 for a query without relevant documents. Selling power looks at as many results as there are relevant
    documents. Cheapest precision counts results among the n cheapest relevant ones, price ties of the n-th included,
    n being the depth or the results. Price-based nDCG has five price bins of exponentially growing width.
    """
    most = F.lit(depth if depth is not None else (1 << 31) - 1)
    ideal = qrels.where("score != 0").join(prices, "doc_id").select("query_id", "doc_id", F.col("price").cast("double").alias("price"))
    cheap, all_of = Window.partitionBy("query_id").orderBy("price", "doc_id"), Window.partitionBy("query_id")
    ranked = ideal.withColumn("j", F.row_number().over(cheap)).withColumn("low", F.min("price").over(all_of)).withColumn("high", F.max("price").over(all_of))

    def gain(price: Column) -> Column:
        edges = [F.col("low") + (F.col("high") - F.col("low")) * F.lit((1 - math.exp(i)) / (1 - math.exp(BINS))) for i in range(1, BINS)]
        return F.lit(float(BINS)) - reduce(lambda x, y: x + y, [F.when(price >= e, 1).otherwise(0) for e in edges])

    power = lambda price: F.when(price > 0, F.col("low") / price).otherwise(1.0)
    ranked = ranked.withColumn("gain", gain(F.col("price"))).withColumn("power", power(F.col("price")))
    top = F.col("j") <= most
    per_query = ranked.groupBy("query_id").agg(
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        F.sum(F.when(F.col("j") <= k, F.col("price"))).alias("cheap_k"),
        F.count(F.lit(1)).alias("n_ideal"),
        F.sum(F.when(top, F.col("gain") / F.log2(F.col("j") + 1.0))).alias("ideal_gain"),
        F.sum(F.when(top, F.col("power") / F.log2(F.col("j") + 1.0))).alias("ideal_power"),
    )
    at = ranked.select("query_id", F.col("j").alias("nth"), F.col("price").alias("ideal_price"))
    counted = rows.withColumn("returned", F.count(F.lit(1)).over(Window.partitionBy("run_id", "query_id"))).join(per_query, "query_id", "left").withColumn("cut", F.least(most, "returned", "n_ideal"))
    full = counted.join(at, ["query_id", "nth"], "left").join(at.select("query_id", F.col("nth").alias("cut"), F.col("ideal_price").alias("cut_price")), ["query_id", "cut"], "left")
    pos, hit, price = F.col("pos"), (F.col("rel") == 1) & (F.col("pos") <= most), F.col("price")
    discount = F.log2(pos + 1.0)
    none = F.first("n_ideal").isNull()
    one = lambda value: F.when(none, 1.0).otherwise(F.coalesce(value, F.lit(0.0)))
    slots = F.least(F.col("n_ideal"), most)
    return full.groupBy("run_id", "query_id").agg(
        one(F.first("low") / F.min(F.when(hit, F.col("spent")))).alias("bp"),
        one(F.first("cheap_k") / F.min(F.when(hit & (F.col("nth") == k), F.col("spent")))).alias(f"bp{k}"),
        one(_over(hit & (pos <= slots), F.col("ideal_price") / price) / F.first(slots)).alias("sp"),
        one(_over(hit & (price <= F.col("cut_price")), F.lit(1.0)) / (F.first("returned") if depth is None else F.lit(depth))).alias("cheapest_p"),
        one(_over(hit, gain(price) / discount) / F.first("ideal_gain")).alias("pb_ndcg"),
        one(_over(hit, power(price) / discount) / F.first("ideal_power")).alias("bp_ndcg"),
    )


def vector(rows: DataFrame, qrels: DataFrame, prices: DataFrame, depth: int | None = None) -> DataFrame:
    """All measures of each run and query, of the first ``depth`` results if given."""
    plain = measures(rows if depth is None else rows.where(F.col("pos") <= depth))
    return plain.join(price_measures(rows, qrels, prices, depth=depth), ["run_id", "query_id"])


def averages(per_query: DataFrame, columns: list[str], queries: int | Column | None = None) -> DataFrame:
    """Means by run over the run's queries, or over a given number of queries, and the geometric mean of AP."""
    n = F.lit(queries) if queries is not None else F.count(F.lit(1))
    means = [(F.sum(c) / n).alias(c) for c in columns]
    gmap = [F.exp(F.sum(F.when(F.col("ap") > 0, F.log("ap")).otherwise(0.0)) / n).alias("gmap")] if "ap" in columns else []
    return per_query.groupBy("run_id").agg(*means, *gmap)
