"""Command line: python -m impactspark.cli {index,search,evaluate,convert} ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from impactspark import sinks
from impactspark.engine import Engine
from impactspark.operators import evaluation, index, search, statistics
from impactspark.plans import store
from impactspark.sources import ciff, documents, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="impactspark")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="build an index")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--format", choices=[*documents.READERS, "sparse", "ciff"], default="trec")
    p.add_argument("--stem", action="store_true")
    p.add_argument("--full", action="store_true", help="fold all of Unicode")
    p.add_argument("--about", help="keep only the terms of this query file")
    p.add_argument("--passthrough", action="store_true", help="frequencies are impacts")
    p = sub.add_parser("search", help="run queries")
    p.add_argument("index")
    p.add_argument("queries", help="a query file, - for standard input")
    p.add_argument("out", help="a folder, - for standard output")
    p.add_argument("--statistics", help="write each query's postings and time here")
    p.add_argument("--minimum", type=int, default=0, help="postings read before known scores may end a query")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--topics", help="read topics, with these of the fields t d n q")
    p.add_argument("--postings", type=int)
    p.add_argument("--percent", type=float, help="of the documents")
    p.add_argument("--relative", type=float, help="share of a query's postings")
    p.add_argument("--u8", action="store_true")
    p.add_argument("--raw", action="store_true", help="split queries at white space only")
    p.add_argument("--oracle", help="known scores, 'qid rsv' a line")
    p = sub.add_parser("evaluate", help="measure runs")
    p.add_argument("qrels")
    p.add_argument("runs", nargs="+")
    p.add_argument("--t-test", action="store_true")
    p.add_argument("--spearman", action="store_true")
    p.add_argument("--per-query", action="store_true")
    p.add_argument("--depth", type=int, help="look at so many results of each query")
    p.add_argument("--file-order", action="store_true", help="results rank as they stand in the files, not by their ranks")
    p.add_argument("--run-queries", action="store_true", help="means are over the queries of a run, not over all judged ones")
    p = sub.add_parser("convert", help="dump an index")
    p.add_argument("index")
    p.add_argument("out")
    p.add_argument("--to", choices=["human", "dictionary", "forward", "binary"], default="human")
    return top


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.format == "ciff":
        rows = ciff.read(spark, a.path)
        posts, docs = ciff.postings(rows), ciff.documents(rows)
        lengths, keys = docs.select("doc_id", "length"), docs.select("doc_id", "primary_key")
    elif a.format == "sparse":
        rows = documents.sparse_json(spark, a.path)
        keys = index.dense_ids(rows.select("primary_key").distinct(), "primary_key")
        posts = rows.join(keys, "primary_key").groupBy("term", "doc_id").agg(F.least(F.sum("tf"), F.lit(1024)).cast("int").alias("tf"))
        lengths = posts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    else:
        docs = index.dense_ids(documents.read(spark, a.path, a.format), "primary_key").withColumnRenamed("contents", "text")
        docs.write.mode("overwrite").parquet(made := store.scratch(spark, "documents"))
        docs = spark.read.parquet(made)
        keys = docs.select("doc_id", "primary_key")
        found = store.store(docs, store.scratch(spark, "index") if a.about else a.out, stem=a.stem, mode="full" if a.full else "plain", markup=True, quantize=not a.passthrough)
        posts, lengths = found.postings, found.lengths
    stemmer, mode = "porter" if a.stem else "none", "full" if a.full else "plain"
    if a.format in ("ciff", "sparse"):
        impacts = index.passed_through(posts) if a.passthrough or a.format == "sparse" else index.quantized(index.scored(posts, lengths))
    else:
        impacts = found.impacts
    if a.about:
        terms = search.query_terms(tables.query_file(spark, a.about), "query", mode, stemmer)
        posts, impacts = index.about(posts, terms), index.about(impacts, terms)
    if a.about or a.format in ("ciff", "sparse"):
        index.Index(posts, lengths, impacts, None, mode, stemmer).write(a.out)
    keys.write.mode("overwrite").parquet(f"{a.out}/keys")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.queries == "-":
        lines = spark.createDataFrame([(line.rstrip("\n"),) for line in sys.stdin], "value string")
        queries = tables.queries(lines)
    else:
        queries = tables.topics(spark, a.queries, a.topics) if a.topics else tables.query_file(spark, a.queries)
    engine = Engine(spark, mode="u8" if a.u8 else "exact", parser="raw" if a.raw else "query").load(a.index).top(a.k).limit(a.postings, a.percent, a.relative)
    engine.keys = spark.read.parquet(f"{a.index}/keys")
    if a.oracle:
        engine.oracle(tables.known_scores(spark, a.oracle), a.minimum)
    if a.out == "-":
        for r in search.trec_run(engine.search_all(queries), engine.keys).orderBy("query_id", "rank").toLocalIterator():
            print(r.line)
    else:
        engine.run_to(queries, a.out, a.statistics)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    qrels, prices, runs = tables.qrels(spark, a.qrels), tables.prices(spark, a.qrels), tables.runs(spark, a.runs[0])
    for path in a.runs[1:]:
        runs = runs.unionByName(tables.runs(spark, path))
    rows = evaluation.judged(runs, qrels, prices, a.file_order)
    per = evaluation.vector(rows, qrels, prices, a.depth)
    names = [n for n in per.columns if n not in ("run_id", "query_id")]
    if a.per_query:
        per.orderBy("run_id", "query_id").show(1000, truncate=False)
    mean = evaluation.averages(per, names, None if a.run_queries else qrels.select("query_id").distinct().count())
    mean.show(truncate=False)
    if a.t_test:
        statistics.t_test_matrices(per, statistics.TESTED).orderBy("measure", "run_a", "run_b").show(10_000, truncate=False)
    if a.spearman:
        statistics.spearman_matrix(mean.select("run_id", *(F.col(n).cast("double").alias(n) for n in names)), names).orderBy("measure_a", "measure_b").show(2000, truncate=False)


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    found = index.Index.read(spark, a.index)
    if a.to == "forward":
        sinks.forward_file(found.impacts, a.out, spark.read.parquet(f"{a.index}/keys"))
    elif a.to == "binary":
        sinks.dumped(index.segments(found.impacts)).write.mode("overwrite").parquet(a.out)
    else:
        sinks.human_file(found.postings, a.out, a.to == "dictionary")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("impactspark").getOrCreate()
    began = time.monotonic()
    {"index": _index, "search": _search, "evaluate": _evaluate, "convert": _convert}[a.command](spark, a)
    print(f"{a.command}: {time.monotonic() - began:.1f} s")


if __name__ == "__main__":
    main()
