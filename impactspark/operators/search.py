"""Score-at-a-time search over impacts: exhaustive, under a postings budget, or up to a known bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.functions.text import cut, full_query_tokens, raw_query_tokens, tokens
from impactspark.operators.index import Index, bucket_of, stem_of

#: Query terms are broadcast up to so many rows, after a count.
BROADCAST_ROWS = 500_000
#: Up to so many different terms are named in the scan's filter, so files and row groups without them aren't read.
NAMED_TERMS = 1_000
MAX_RSV = 255


def query_terms(queries: DataFrame, parser: str = "query", mode: str = "plain", stemmer: str = "none") -> DataFrame:
    """(query_id, term, qf) of queries(query_id, query): words found and folded as the index's mode does, stemmed as the
    index is. The raw parser splits at white space and folds and stems nothing."""
    text = F.coalesce("query", F.lit(""))
    words = raw_query_tokens(text) if parser == "raw" else full_query_tokens(text) if mode == "full" else tokens(text)
    rows = queries.select("query_id", F.explode(words).alias("term"))
    if parser != "raw":
        rows = rows.select("query_id", cut(F.col("term")).alias("term"))
        rows = rows if stemmer == "none" else rows.select("query_id", stem_of(F.col("term"), stemmer).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("int").alias("qf"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hits(impacts: DataFrame | Index, terms: DataFrame) -> DataFrame:
    """(query_id, term, seg, doc_id): seg is the impact times the query frequency. Unknown terms fall away.

    Of a stored index only what the terms need is read: a few terms are named in the scan's filter with their
    buckets; of many, the buckets are pruned as the join runs.
    """
    index = impacts if isinstance(impacts, Index) else None
    rows, by = (index.impacts if index else impacts), ["term"]
    if index and index.buckets:
        terms = terms.withColumn("bucket", bucket_of(F.col("term"), index.buckets))
        by = ["bucket", "term"]
    named = terms.select(*by).distinct().limit(NAMED_TERMS + 1).collect()
    if len(named) <= NAMED_TERMS:
        rows = rows.where(F.col("term").isin([r.term for r in named]))
        if "bucket" in by:
            rows = rows.where(F.col("bucket").isin(sorted({r.bucket for r in named})))
    return rows.join(_small(terms), by).select("query_id", "term", (F.col("impact") * F.col("qf")).alias("seg"), "doc_id")


def plan(hits: DataFrame) -> DataFrame:
    """(query_id, term, seg, n, cum): segments in the order they are read - impact down, length up, term - and the
    postings read up to each. Segments are few: terms of a query times impact levels."""
    n = hits.groupBy("query_id", "term", "seg").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("seg"), "n", "term").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("cum", F.sum("n").over(order))


def scaled(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Segments with their value under the 8-bit accumulators, in 'value': scaled down where the best sum is over 255."""
    most = segments.groupBy("query_id", "term").agg(F.max("seg").alias("m")).groupBy("query_id").agg(F.sum("m").alias("best"))
    unique = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("q"))
    value = F.when(F.col("best") > MAX_RSV, F.floor(F.col("seg") / F.col("best") * (F.lit(float(MAX_RSV)) - F.col("q")) + 1.0)).otherwise(F.col("seg")).cast("int")
    return segments.join(_small(most.join(unique, "query_id")), "query_id").withColumn("value", value).drop("best", "q")


def budgets(segments: DataFrame, absolute: int | None = None, percent_of_documents: float | None = None, relative: float | None = None, documents: Column | int | None = None) -> DataFrame:
    """Segments within the budget: a longest prefix. The relative budget (a share of the query's postings) wins."""
    if relative is not None:
        total = F.sum("n").over(Window.partitionBy("query_id"))
        return segments.withColumn("__most", F.floor(total * F.lit(relative))).where("cum <= __most").drop("__most")
    if percent_of_documents is not None:
        return segments.where(F.col("cum") <= F.floor(F.lit(documents) * F.lit(percent_of_documents) / 100))
    return segments if absolute is None else segments.where(F.col("cum") <= absolute)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, rsv), ties to the higher document."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rsv"), F.desc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "rsv")


def search(impacts: DataFrame | Index, terms: DataFrame, k: int = 10, mode: str = "exact", documents: int | None = None, **budget) -> DataFrame:
    """(query_id, doc_id, rank, rsv). mode 'u8' scales to 255. Without a budget, segments aren't planned at all."""
    hits = _hits(impacts, terms)
    if mode == "exact" and not any(v is not None for v in budget.values()):
        return top_k(hits.groupBy("query_id", "doc_id").agg(F.sum("seg").cast("int").alias("rsv")), k)
    segments = plan(hits)
    segments = scaled(segments, terms) if mode == "u8" else segments.withColumn("value", F.col("seg"))
    kept = budgets(segments, documents=documents, **budget).select("query_id", "term", "seg", "value")
    read = hits.join(_small(kept), ["query_id", "term", "seg"])
    return top_k(read.groupBy("query_id", "doc_id").agg(F.sum("value").cast("int").alias("rsv")), k)


def processed(impacts: DataFrame | Index, terms: DataFrame, documents: int | None = None, **budget) -> DataFrame:
    """(query_id, postings_processed)."""
    return budgets(plan(_hits(impacts, terms)), documents=documents, **budget).groupBy("query_id").agg(F.max("cum").alias("postings_processed"))


def search_oracle(impacts: DataFrame | Index, terms: DataFrame, known: DataFrame, k: int = 10, minimum: int = 0) -> DataFrame:
    """Early stop by known(query_id, bound), the rsv at rank k: reading ends the moment k documents reach the bound and
    the minimum of postings is read.

    Postings are numbered in reading order; a document crosses with the posting that takes it to the bound. If k
    documents cross, the result is the best of those that had crossed when reading ended, with what they had then;
    else the best of all.
    """
    hits = _hits(impacts, terms)
    order = plan(hits).select("query_id", "term", "seg", "cum")
    place = hits.join(_small(order), ["query_id", "term", "seg"])
    within = Window.partitionBy("query_id", "term", "seg").orderBy("doc_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "term", "seg"))
    numbered = place.withColumn("p", F.col("cum") - n + F.row_number().over(within))
    so_far = F.sum("seg").over(Window.partitionBy("query_id", "doc_id").orderBy("p"))
    run = numbered.withColumn("so_far", so_far).join(_small(known), "query_id", "left")
    cross = run.where("bound > 1 and so_far >= bound").groupBy("query_id", "doc_id").agg(F.min("p").alias("crossed"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("crossed"))
    nth = cross.withColumn("i", first).where(F.col("i") == k).select("query_id", F.greatest("crossed", F.lit(minimum)).alias("stop"))
    kept = run.join(nth, "query_id", "left").join(cross, ["query_id", "doc_id"], "left").where("stop is null or (crossed <= stop and p <= stop)")
    return top_k(kept.groupBy("query_id", "doc_id").agg(F.sum("seg").cast("int").alias("rsv")), k)


def trec_run(results: DataFrame, keys: DataFrame | None = None, name: str = "impactspark") -> DataFrame:
    """(query_id, rank, line): 'qid Q0 key rank rsv run(ID:doc->rsv)'. keys has doc_id and primary_key."""
    named = results.join(keys, "doc_id", "left") if keys is not None else results.withColumn("primary_key", F.col("doc_id").cast("string"))
    line = F.concat_ws(" ", "query_id", F.lit("Q0"), "primary_key", "rank", "rsv", F.concat(F.lit(f"{name}(ID:"), F.col("doc_id"), F.lit("->"), F.col("rsv"), F.lit(")")))
    return named.select("query_id", "rank", line.alias("line"))
