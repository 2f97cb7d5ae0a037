"""The engine as one object: build or load an index, set options, search."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark import sinks
from impactspark.functions.text import query_id, query_text
from impactspark.operators import search
from impactspark.operators.index import Index
from impactspark.plans import store

MAX_K = 1000


@dataclass
class Statistics:
    """Of a session; the mean of no queries is zero."""

    queries: int = 0
    seconds: float = 0.0
    postings: int = 0

    @property
    def mean_seconds(self) -> float:
        return self.seconds / self.queries if self.queries else 0.0


@dataclass
class Engine:
    spark: SparkSession
    index: Index | None = None
    keys: DataFrame | None = None
    k: int = 10
    mode: str = "exact"
    parser: str = "query"
    budget: dict = field(default_factory=dict)
    known: DataFrame | None = None
    minimum: int = 0
    statistics: Statistics = field(default_factory=Statistics)

    def build(self, docs: DataFrame, path: str | None = None, **options) -> Engine:
        """Index docs(doc_id, text) once, under path or in the session's scratch folder; a primary_key column names results."""
        self.index = store.store(docs, path or store.scratch(self.spark, "index"), **options)
        self.keys = docs.select("doc_id", "primary_key") if "primary_key" in docs.columns else None
        return self

    def load(self, path: str) -> Engine:
        self.index = Index.read(self.spark, path)
        return self

    def top(self, k: int) -> Engine:
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k is 1 to {MAX_K}")
        self.k = k
        return self

    def limit(self, absolute: int | None = None, percent_of_documents: float | None = None, relative: float | None = None) -> Engine:
        """A budget of postings; none of the three is no budget."""
        self.budget = {"absolute": absolute, "percent_of_documents": percent_of_documents, "relative": relative}
        return self

    def oracle(self, known: DataFrame, minimum: int = 0) -> Engine:
        """Known scores at rank k, as (query_id, bound); reading ends no sooner than after a minimum of postings."""
        self.known, self.minimum = known, minimum
        return self

    @property
    def documents(self) -> int:
        return self._index().lengths.count()

    def _index(self) -> Index:
        if self.index is None:
            raise RuntimeError("no index: build() or load() one first")
        return self.index

    def terms(self, queries: DataFrame) -> DataFrame:
        """Words found, folded and stemmed as the index's are."""
        return search.query_terms(queries, self.parser, self._index().mode, self._index().stemmer)

    def search_all(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, rank, rsv) of queries(query_id, query), all in one plan."""
        terms = self.terms(queries)
        if self.known is not None:
            return search.search_oracle(self._index(), terms, self.known, self.k, self.minimum)
        n = self.documents if self.budget.get("percent_of_documents") is not None else None
        return search.search(self._index(), terms, self.k, self.mode, documents=n, **self.budget)

    def search(self, text: str) -> list[tuple[str, int, int, int]]:
        """Rows (query id, document, rank, rsv) of one query, 'id words' or words alone."""
        one = self.spark.range(1).select(F.lit(text).alias("q")).select(query_id(F.col("q")).alias("query_id"), query_text(F.col("q")).alias("query"))
        began = time.monotonic()
        rows = [tuple(r) for r in self.search_all(one).orderBy("rank").collect()]
        self.statistics.queries += 1
        self.statistics.seconds += time.monotonic() - began
        return rows

    def processed(self, queries: DataFrame) -> DataFrame:
        """(query_id, postings_processed) under the budget; the session's statistics count them."""
        n = self.documents if self.budget.get("percent_of_documents") is not None else None
        found = search.processed(self._index(), self.terms(queries), documents=n, **self.budget)
        self.statistics.postings += found.agg(F.coalesce(F.sum("postings_processed"), F.lit(0))).first()[0]
        return found

    def run_to(self, queries: DataFrame, path: str, statistics: str | None = None, exporter: str = "trec") -> None:
        """Search queries(query_id, query) and write the run; with a second path, also each query's postings and the batch's
        time over its queries."""
        began = time.monotonic()
        sinks.EXPORTERS[exporter](self.search_all(queries), path, self.keys)
        seconds, n = time.monotonic() - began, queries.count()
        self.statistics.queries += n
        self.statistics.seconds += seconds
        if statistics:
            sinks.statistics_file(self.processed(queries), queries, statistics, round(seconds * 1e9 / max(1, n)))
