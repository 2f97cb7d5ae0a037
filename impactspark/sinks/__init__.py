"""Writers of runs, dumps and binary lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.operators import index, search


def run_file(results: DataFrame, path: str, keys: DataFrame | None = None, name: str = "impactspark") -> None:
    """A ranked run as text, by query and rank."""
    search.trec_run(results, keys, name).orderBy("query_id", "rank").select("line").write.mode("overwrite").text(path)


#: Writers of runs by name.
EXPORTERS = {"trec": run_file}


def statistics_file(processed: DataFrame, queries: DataFrame, path: str, nanoseconds: int | None = None) -> None:
    """A line for each query: id, text, postings read and, if known, the time (a batch's is shared by its queries)."""
    time = [] if nanoseconds is None else [F.lit(f"<time_ns>{nanoseconds}</time_ns>")]
    line = F.concat(F.lit("<id>"), "query_id", F.lit("</id><query>"), "query", F.lit("</query><postings>"), F.coalesce("postings_processed", F.lit(0)), F.lit("</postings>"), *time)
    queries.join(processed, "query_id", "left").orderBy("query_id").select(line).write.mode("overwrite").text(path)


def forward_file(impacts: DataFrame, path: str, keys: DataFrame | None = None) -> None:
    """A well-formed document for each document: its key and its term:impact pairs."""
    rows = index.forward(impacts)
    named = rows.join(keys, "doc_id", "left") if keys is not None else rows.withColumn("primary_key", F.col("doc_id").cast("string"))
    named.select(F.concat(F.lit("<DOC><DOCNO>"), "primary_key", F.lit("</DOCNO>"), "terms", F.lit("</DOC>"))).write.mode("overwrite").text(path)


def human_file(postings: DataFrame, path: str, dictionary_only: bool = False) -> None:
    """A line for each term and range of ids: 'term-><doc,tf>...'; the terms alone for a dictionary."""
    if dictionary_only:
        postings.select("term").distinct().orderBy("term").write.mode("overwrite").text(path)
    else:
        index.human(postings).orderBy("term", "chunk").select(F.concat("term", F.lit("->"), "listed")).write.mode("overwrite").text(path)


def dumped(segments: DataFrame) -> DataFrame:
    """(term, impact, chunk, data) of index.segments(): a 32-bit length and 0-based 32-bit ids. A term's lists, high
    impacts first, are its rows in that order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["term", "impact", "chunk"]].assign(data=[np.array([len(ids), *(np.asarray(ids, np.int64) - 1)], "<u4").tobytes() for ids in b.doc_ids])

    return segments.select("term", "impact", "chunk", "doc_ids").mapInPandas(run, "term string, impact int, chunk long, data binary")
