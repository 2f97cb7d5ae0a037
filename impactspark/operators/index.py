"""Inverted index as frames: postings, lengths, vocabulary, BM25, integer impacts, impact segments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.functions.text import PLAIN, cut, full_tokens, stemmed, tokens, without_markup

K1, B = 0.9, 0.4
MAX_TF, MAX_IMPACT = 1024, 1024


def token_rows(docs: DataFrame, mode: str = "plain", markup: bool = False, pattern: str = PLAIN) -> DataFrame:
    """(doc_id, term) of every token of docs(doc_id, text). mode 'plain' stays in the JVM, 'full' folds all of Unicode."""
    text = F.coalesce("text", F.lit(""))
    if mode == "full":
        ws = full_tokens(text)
    else:
        ws = tokens(without_markup(text) if markup else text, pattern)
    rows = docs.select("doc_id", F.explode(ws).alias("term"))
    return rows if mode == "full" else rows.select("doc_id", cut(F.col("term")).alias("term"))


def postings(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf): occurrences counted map-side first, frequencies end at MAX_TF."""
    return rows.groupBy("term", "doc_id").agg(F.least(F.count(F.lit(1)), F.lit(MAX_TF)).cast("int").alias("tf"))


def stem_postings(posts: DataFrame, stemmer: str = "porter") -> DataFrame:
    """Postings of stems. Distinct terms are stemmed once and joined back."""
    stems = posts.select("term").distinct().withColumn("stem", stem_of(F.col("term"), stemmer))
    return posts.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.least(F.sum("tf"), F.lit(MAX_TF)).cast("int").alias("tf"))


def stem_of(term: Column, stemmer: str = "porter") -> Column:
    """Terms of two characters or fewer stay."""
    return F.when(F.length(term) > 2, stemmed(term, stemmer)).otherwise(term)


def union_postings(*parts: DataFrame) -> DataFrame:
    """Bulk addition: frequencies of the same posting add up. Few postings are the same, so they are dealt as they are: a
    table of all those of a file, which is small for its postings, would only fill a task's memory."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition(tasks_for(out), "term", "doc_id").groupBy("term", "doc_id").agg(F.least(F.sum("tf"), F.lit(MAX_TF)).cast("int").alias("tf"))


#: Bytes of stored input for a task that deals with its rows or postings, some millions at most.
TASK_BYTES = 1 << 24


def tasks_for(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's, more if its stored input is large for so many."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 50)  # more stands for unknown
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def counted(docs: DataFrame, mode: str = "plain") -> DataFrame:
    """(term, doc_id, tf, length) of docs(doc_id, text) with ids that don't repeat: postings with their document's length;
    a row without a term for a document without one. Texts are dealt and not postings, and counted where they are."""
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select("doc_id", "text").repartition(tasks_for(docs), "doc_id")
    words = dealt.select("doc_id", (full_tokens(text) if mode == "full" else tokens(text)).alias("ws"))
    rows = words.select("doc_id", F.size("ws").cast("long").alias("length"), F.explode_outer("ws").alias("term"))
    rows = rows if mode == "full" else rows.withColumn("term", cut(F.col("term")))
    return rows.groupBy("doc_id", "length", "term").agg(F.least(F.count(F.lit(1)), F.lit(MAX_TF)).cast("int").alias("tf")).select("term", "doc_id", "tf", "length")


def doc_lengths(docs: DataFrame, rows: DataFrame | None = None, extra: int = 0) -> DataFrame:
    """(doc_id, length) of every document, empty ones too. No shuffle unless token rows are given."""
    if rows is None:
        return docs.select("doc_id", (F.size(tokens(F.coalesce("text", F.lit("")))) + extra).cast("long").alias("length"))
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) + extra).cast("long").alias("length"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean_length."""
    return lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.avg("length").alias("mean_length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25(tf: Column, df: Column, length: Column, documents: Column, mean: Column, k1: float = K1, b: float = B, compat: bool = False) -> Column:
    """BM25 with idf ln(N / df); compat keeps the length correction in single precision."""
    correction = F.lit(k1) * ((F.lit(1.0) - F.lit(b)) + F.lit(b) * length / mean)
    correction = correction.cast("float").cast("double") if compat else correction
    return F.log(documents / df) * (tf * F.lit(k1 + 1.0) / (tf + correction))


RANKERS = {"bm25": bm25, "none": lambda tf, *_, **__: tf.cast("double")}


#: Terms whose frequencies are broadcast at most: the most frequent ones, which nearly all postings have.
BROADCAST_TERMS = 200_000


def _least_frequent(frequencies: DataFrame, most: int) -> int:
    """The least power of 2 that no more than so many terms' frequencies reach."""
    rows = frequencies.groupBy((F.length(F.bin("df")) - 1).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 63 at most
    by, upto = {r.p: r.n for r in rows}, 0
    for p in range(62, -1, -1):
        upto += by.get(p, 0)
        if upto > most:
            return 1 << (p + 1)
    return 1


def _with_df(posts: DataFrame, frequencies: DataFrame | None, most: int = BROADCAST_TERMS) -> DataFrame:
    """posts with their term's df. Of stored frequencies(term, df) those of frequent terms are broadcast, so only the
    postings of rare terms are dealt by term."""
    if frequencies is None:
        return posts.join(document_frequency(posts).select("term", "df"), "term")
    least = _least_frequent(frequencies, most)
    frequent = F.broadcast(frequencies.where(F.col("df") >= least).select("term", "df"))
    known = posts.join(frequent, "term")
    if least == 1:
        return known
    return known.unionByName(posts.join(frequent.select("term"), "term", "left_anti").join(frequencies.where(F.col("df") < least).select("term", "df"), "term"))


def scored(posts: DataFrame, lengths: DataFrame, ranker: str = "bm25", frequencies: DataFrame | None = None, **options) -> DataFrame:
    """(term, doc_id, tf, score). Frequencies join on the postings' term, and lengths on the document where postings don't
    have them."""
    if ranker == "none":
        return posts.select("term", "doc_id", "tf").withColumn("score", RANKERS["none"](F.col("tf")))
    stats = collection_stats(lengths)
    joined = _with_df(posts, frequencies)
    joined = (joined if "length" in posts.columns else joined.join(lengths, "doc_id")).crossJoin(F.broadcast(stats))  # one row
    score = RANKERS[ranker](F.col("tf"), F.col("df"), F.col("length"), F.col("documents"), F.col("mean_length"), **options)
    return joined.select("term", "doc_id", "tf", score.alias("score"))


def bounds(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))


def impact_of(score: Column, low: Column, high: Column, largest: int = MAX_IMPACT) -> Column:
    """1 to largest; 1 where all scores are alike."""
    return F.when(high > low, F.floor((score - low) / (high - low) * F.lit(largest - 1.0)) + 1).otherwise(1).cast("int")


def quantized(scores: DataFrame, largest: int = MAX_IMPACT, limits: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, impact), by the least and the greatest score of all."""
    limits = bounds(scores) if limits is None else limits
    return scores.crossJoin(F.broadcast(limits)).select("term", "doc_id", impact_of(F.col("score"), F.col("low"), F.col("high"), largest).alias("impact"))  # one row


def passed_through(posts: DataFrame) -> DataFrame:
    """Frequencies as impacts, for weights that are impacts already."""
    return posts.select("term", "doc_id", "tf").withColumnRenamed("tf", "impact")


#: Documents of one chunk of a list: lists are stored and listed by ranges of ids, so no term meets in one row or task.
SPAN = 1 << 20


def chunk_of(doc_id: Column, span: int = SPAN) -> Column:
    return F.floor(doc_id / span)


def segments(impacts: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, impact, chunk, n, doc_ids): the documents of one impact, in order, by ranges of ids. For storage; search
    reads impacts."""
    return impacts.groupBy("term", "impact", chunk_of(F.col("doc_id"), span).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, term) of every document's terms, once a row of docs: repeated rows, and tokens that are cut alike, repeat."""
    rows = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    return rows.select("doc_id", cut(F.col("term")).alias("term"))


def one_range(docs: DataFrame, span: int = SPAN) -> bool:
    """Whether all ids are in one range, so that nothing is carried from range to range; reads the ids alone."""
    row = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    return row.a is None or row.a // span == row.b // span


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt once by term and range; what is done within a range needs no other exchange."""
    return rows.repartition(tasks_for(rows), "term", "chunk")


def lists(rows: DataFrame, span: int = SPAN, one: bool = False) -> DataFrame:
    """(term, chunk, gaps) of (doc_id, term), which may repeat: each term's gaps in order, a list for each range of ids."""
    dealt = _dealt(rows.select("term", "doc_id", chunk_of(F.col("doc_id"), span).alias("chunk")))
    ids = dealt.groupBy("term", "chunk").agg(F.sort_array(F.array_distinct(F.collect_list("doc_id"))).alias("ids"))
    if one:
        ids = ids.withColumn("carried", F.lit(-1).cast("long"))
    else:
        ids = ids.join(_carried(dealt), ["term", "chunk"], "left")
    before = F.concat(F.array(F.coalesce("carried", F.lit(-1)).cast("long")), F.slice("ids", 1, F.size("ids") - 1))
    return ids.select("term", "chunk", F.zip_with("ids", before, lambda x, y: x - y).alias("gaps"))


def _carried(dealt: DataFrame) -> DataFrame:
    """(term, chunk, carried): the last document of the ranges before, where there are any."""
    lasts = dealt.groupBy("term", "chunk").agg(F.max("doc_id").alias("last"))
    return lasts.select("term", "chunk", F.lag("last").over(Window.partitionBy("term").orderBy("chunk")).alias("carried")).where("carried is not null")


def gaps(posts: DataFrame, span: int = SPAN, one: bool = False) -> DataFrame:
    """posts and gap, the distance to the term's document before; the first is its id plus 1. A posting that comes again
    counts once. Ranges of ids are sorted apart; the first of a range is told the last of those before it by a second
    pass over one row a range, which is left out where all ids are known to be in one."""
    return ranged_gaps(posts, span, one).drop("chunk")


def ranged_gaps(posts: DataFrame, span: int = SPAN, one: bool = False) -> DataFrame:
    """gaps() with each row's range in 'chunk', by which and by term the rows are dealt and sorted."""
    dealt = _dealt(posts.withColumn("chunk", chunk_of(F.col("doc_id"), span)))
    near = dealt.withColumn("before", F.lag("doc_id").over(Window.partitionBy("term", "chunk").orderBy("doc_id"))).where("before is null or before <> doc_id")
    carried = F.lit(None).cast("long") if one else F.col("carried")
    rows = near if one else near.join(_carried(dealt), ["term", "chunk"], "left")
    return rows.select(*posts.columns, (F.col("doc_id") - F.coalesce("before", carried, F.lit(-1))).alias("gap"), "chunk")


def ungapped(rows: DataFrame, span: int = SPAN, one: bool = False) -> DataFrame:
    """(term, doc_id) of (term, place, gap), place ordering a term's gaps: running sums by ranges of places, and the
    sums of the ranges before. Rows that have their range in 'chunk' are taken as they are dealt."""
    rows = rows if "chunk" in rows.columns else _dealt(rows.withColumn("chunk", chunk_of(F.col("place"), span)))
    line = Window.partitionBy("term", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.sum("gap").over(line))
    if one:
        return near.select("term", (F.col("near") - 1).alias("doc_id"))
    sums = rows.groupBy("term", "chunk").agg(F.sum("gap").alias("total"))
    before = F.sum("total").over(Window.partitionBy("term").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select("term", "chunk", before.alias("carried")).where("carried is not null")
    return near.join(carried, ["term", "chunk"], "left").select("term", (F.col("near") + F.coalesce("carried", F.lit(0)) - 1).alias("doc_id"))


def vocabulary(posts: DataFrame, impacts: DataFrame) -> DataFrame:
    """(term, df, cf, n_segments, min_impact, max_impact)."""
    levels = impacts.groupBy("term", "impact").agg(F.count(F.lit(1)).alias("n"))
    shape = levels.groupBy("term").agg(F.count(F.lit(1)).alias("n_segments"), F.min("impact").alias("min_impact"), F.max("impact").alias("max_impact"))
    return document_frequency(posts).join(shape, "term")


def forward(impacts: DataFrame) -> DataFrame:
    """(doc_id, terms): each document's term:impact pairs, by term."""
    pair = F.struct("term", "impact")
    return impacts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat(p["term"], F.lit(":"), p["impact"])), " ").alias("terms"))


def human(posts: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, chunk, listed): <doc,tf> pairs by document, a row for each range of ids."""
    pair = F.struct("doc_id", "tf")
    return posts.groupBy("term", chunk_of(F.col("doc_id"), span).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat(F.lit("<"), p["doc_id"], F.lit(","), p["tf"], F.lit(">"))), "").alias("listed"))


def about(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Only the postings of the terms asked for (a topic file's, say): a smaller index that answers them alike."""
    return posts.join(terms.select("term").distinct(), "term", "left_semi")


def dense_ids(docs: DataFrame, key: str) -> DataFrame:
    """doc_id 1, 2, ... by key, for sources without ids: ranges are sorted apart and offset by what is before them."""
    spark = docs.sparkSession
    ordered = docs.orderBy(key).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    firsts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("a"))
    before = firsts.select("__part", "a", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("ahead"))  # a row a partition
    return ordered.join(F.broadcast(before), "__part").withColumn("doc_id", F.col("__at") - F.col("a") + F.col("ahead") + 1).drop("__part", "__at", "a", "ahead")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


@dataclass(frozen=True)
class Index:
    """An index's tables, as frames, and how its terms were made."""

    postings: DataFrame
    lengths: DataFrame
    impacts: DataFrame
    vocabulary: DataFrame | None = None
    mode: str = "plain"
    stemmer: str = "none"
    #: Impacts have their term's bucket of so many in 'bucket', by which they are filed; 0 if they haven't.
    buckets: int = 0

    def write(self, path: str, buckets: int | None = None) -> Index:
        """Parquet tables under path, each stored before the next reads it; the index that reads them.

        Impacts are filed by the bucket of their term and sorted by term within, so a query reads the folders of its
        terms and of these the row groups. A bucket too large for a task is split, whatever its terms.
        """
        spark = self.postings.sparkSession

        def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept(self.postings, "postings")
        kept(self.lengths, "doc_lengths")
        impacts = self.impacts.select("term", "doc_id", "impact").withColumn("bucket", bucket_of(F.col("term"), n))
        impacts = kept(impacts.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", F.desc("impact"), "doc_id"), "impacts", "bucket")
        kept(vocabulary(spark.read.parquet(f"{path}/postings"), impacts), "vocabulary")
        kept(spark.createDataFrame([(self.mode, self.stemmer, n)], "mode string, stemmer string, buckets int"), "about")
        return Index.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        row = spark.read.parquet(f"{path}/about").first()
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "doc_lengths", "impacts", "vocabulary")), row.mode, row.stemmer, row.buckets)


def build(docs: DataFrame, ranker: str = "bm25", quantize: bool = True, stem: bool | str = False, mode: str = "plain", markup: bool = False, store: Callable[[DataFrame, str], DataFrame] | None = None, **options) -> Index:
    """The index of docs(doc_id, text). Frames are lazy and recompute what is before them, unless ``store`` (a frame and a
    name to the stored frame) is given: then nothing is counted or scored twice."""
    store = store or (lambda df, _: df)
    stemmer = stem if isinstance(stem, str) else "porter" if stem else "none"
    rows = token_rows(docs, mode, markup)
    posts = postings(rows)
    posts = store(posts if stemmer == "none" else stem_postings(posts, stemmer), "postings")
    lengths = store(doc_lengths(docs, None if mode == "plain" and not markup else rows), "doc_lengths")
    if not quantize:
        return Index(posts, lengths, passed_through(posts), None, mode, stemmer)
    return Index(posts, lengths, quantized(store(scored(posts, lengths, ranker, **options), "scores")), None, mode, stemmer)
