"""Queries, topics, judgements, prices, runs and known scores, from text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.functions.text import query_tokens
from impactspark.sources.documents import binary_files


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): a line each, the id first; blank lines are passed over."""
    return queries(spark.read.text(path))


def queries(lines: DataFrame) -> DataFrame:
    line = F.rtrim("value")
    parts = lines.select(line.alias("line")).where("line != ''")
    return parts.select(F.regexp_extract("line", "^([^\" \\t:]*)", 1).alias("query_id"), F.regexp_extract("line", "^[^\" \\t:]*[\" \\t:]+(.*)$", 1).alias("query"))


_TAGS = {"t": "title", "d": "desc", "n": "narr", "q": "query"}


def topics_of(text: str, tags: str = "tq") -> list[tuple[str, str]]:
    """(id, words) of topics, news (<num>) or web (<topic number=...>) style; a field ends where the next tag begins."""
    out = []
    for part in re.split(r"(?i)(?=<topic\s|<top>)", text):
        number = re.search(r"(?i)<topic\s+number\s*=\s*[\"']?([^\"'\s>]+)", part) or re.search(r"(?i)<num>\s*(?:Number:)?\s*([^\s<]+)", part)
        if not number:
            continue
        words: list[str] = []
        for m in re.finditer(r"(?is)<(\w+)[^>]*>([^<]*)", part):
            if m[1].lower() in {_TAGS[t] for t in tags}:
                words += query_tokens(re.sub(r"(?i)^\s*(topic|description|narrative):", "", m[2]))
        out.append((number[1], " ".join(words)))
    return out


def topics(spark: SparkSession, path: str, tags: str = "tq") -> DataFrame:
    return topics_in(binary_files(spark, path), tags)


def topics_in(files: DataFrame, tags: str = "tq") -> DataFrame:
    """Of files(content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                yield pd.DataFrame(topics_of(content.decode(errors="replace"), tags), columns=["query_id", "query"])

    return files.mapInPandas(run, "query_id string, query string")


def _columns(lines: DataFrame, n: int) -> DataFrame:
    parts = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    return lines.select(parts.alias("c"), F.monotonically_increasing_id().alias("at")).where(F.size("c") >= n)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return qrels_in(spark.read.text(path))


def qrels_in(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): four columns, the second unused; short lines and prices are passed over."""
    rows = _columns(lines, 4).select(F.get("c", F.lit(0)).alias("query_id"), F.get("c", F.lit(2)).alias("doc_id"), F.get("c", F.lit(3)).cast("double").alias("score"))
    return rows.where("query_id != 'PRICE'")


def prices(spark: SparkSession, path: str) -> DataFrame:
    return prices_in(spark.read.text(path))


def prices_in(lines: DataFrame) -> DataFrame:
    """(doc_id, price) of the PRICE lines."""
    rows = _columns(lines, 4).where(F.get("c", F.lit(0)) == "PRICE")
    return rows.select(F.get("c", F.lit(2)).alias("doc_id"), F.get("c", F.lit(3)).cast("double").alias("price"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    return runs_in(spark.read.text(path))


def runs_in(lines: DataFrame) -> DataFrame:
    """(run_id, query_id, doc_id, rank, score, at) of six columns; at grows along the lines."""
    c = lambda i: F.get("c", F.lit(i))
    return _columns(lines, 6).select(c(5).alias("run_id"), c(0).alias("query_id"), c(2).alias("doc_id"), c(3).cast("double").alias("rank"), c(4).cast("double").alias("score"), "at")


def known_scores(spark: SparkSession, path: str) -> DataFrame:
    return known_in(spark.read.text(path))


def known_in(lines: DataFrame) -> DataFrame:
    """(query_id, bound)."""
    return _columns(lines, 2).select(F.get("c", F.lit(0)).alias("query_id"), F.get("c", F.lit(1)).cast("int").alias("bound"))


def price_run(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score) of rows(query_id, doc_id, price): by price, then document."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("price", "doc_id"))
    score = F.count(F.lit(1)).over(Window.partitionBy("query_id")) - rank + 1
    return rows.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), rank.cast("long").alias("rank"), score.alias("score"))


def matrix(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, query_id, value) of a wide table with a column for each query."""
    return rows.unpivot(key, [c for c in rows.columns if c != key], "query_id", "value")


def assessments(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Judgements from a wide table: 1 is relevant, any other value is not."""
    return matrix(rows, key).select("query_id", key, F.when(F.col("value") == 1, 1.0).otherwise(0.0).alias("score"))
