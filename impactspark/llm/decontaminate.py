"""Benchmark decontamination: a distributed positional inverted index, intersected from the rarest terms.

DataFrame functions only. A phrase is a window of ``window`` consecutive item words (an item of fewer words, but not
none, is one phrase). One pass over the documents stores the postings (term, document, position, following term) of
every word that the items have, and a row for each document with its length. Each phrase is looked up by its rarest
two neighbouring terms, by their frequency in the documents: their lists, offset by one, are intersected already in
the posting's following term. A posting less the terms' offset in the item names a diagonal (document, item,
position of the item's first word). The lists of all other terms, adjusted by their own offsets, are intersected
with those diagonals; runs of consecutive item words on a diagonal that are at least as long as a phrase are its
occurrences. A phrase with two neighbours that no document has is never looked up.

Near matches come from the same postings: most of a phrase's words met close to a diagonal that any two neighbours
name. A phrase that may lack m words has one of its m + 1 rarest words met, so only diagonals close to such a word
are counted; that leaves out no near match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.llm._shared import row_key, table, written

WINDOW = 10
#: Document positions that meet the diagonals they are near to by one key.
SPAN = 64
#: Places of one cell, in which diagonals and rare words meet; what a place of zero is written as.
CELL, ZERO = 32, 1 << 30
#: A table is broadcast only after a count and only at this many rows of short words or fewer.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words while A-Z are still capitals.
APART = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Stands behind the last word of each document; no word can have a blank. Its term is 0.
STOP = " "


def folded(word: Column) -> Column:
    """A-Z lower-cased. Plain words take the quick way, which only agrees for them."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """The words of a text in their own case, and an empty piece where it begins or ends with a separator."""
    return F.split(F.coalesce(text, F.lit("")), APART, -1)


def word_count(ws: Column) -> Column:
    last = F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)
    return F.size(ws) - F.when(F.element_at(ws, 1) == "", 1).otherwise(0) - last


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_words(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, word) of all distinct words of items(item, text), terms above 0; (item, ipos, term, next, n_words).

    Null and wordless texts have no rows."""
    ws = F.filter(pieces(F.col("text")), lambda w: w != "")
    rows = items.select("item", ws.alias("ws")).where(F.size("ws") > 0).select("item", F.size("ws").alias("n_words"), F.posexplode("ws").alias("ipos", "word")).withColumn("word", folded(F.col("word")))
    terms = written(rows.select("word").distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term")), "terms")
    line = Window.partitionBy("item").orderBy("ipos")
    numbered = rows.join(small(terms), "word").select("item", "ipos", "term", F.lead("term").over(line).alias("next"), "n_words")
    return terms, written(numbered, "item_words")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc, pos, term, next) of docs(doc_id, doc, text); term 0 ends each row of docs, with doc_id and n_words."""
    known = small(terms.unionByName(docs.sparkSession.range(1).select(F.lit(STOP).alias("word"), F.lit(0).alias("term"))))
    ws = F.col("ws")
    after = F.concat(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), F.array(F.lit(STOP)))
    rows = docs.select("doc_id", "doc", pieces(F.col("text")).alias("ws")).select("doc_id", "doc", word_count(ws).alias("n"), F.posexplode(F.arrays_zip(F.concat(ws, F.array(F.lit(STOP))).alias("w"), after.alias("v"))).alias("pos", "p"))
    met = rows.select("doc_id", "doc", "n", "pos", folded(F.col("p.w")).alias("word"), F.col("p.v").alias("v")).join(known, "word").select("doc_id", "doc", "n", "pos", "term", folded(F.col("v")).alias("word"))
    both = met.join(known.withColumnRenamed("term", "next"), "word", "left")
    end = F.col("term") == 0
    return written(both.select("doc", "pos", "term", "next", F.when(end, F.col("doc_id")).alias("doc_id"), F.when(end, F.col("n")).alias("n_words")), "postings")


def diagonals(postings: DataFrame, words: DataFrame, window: int = WINDOW, near: bool = False) -> DataFrame:
    """The (doc, item, diag) that the rarest neighbours of some phrase name; for near matches, those that any do, repeated."""
    pairs = words.where("next is not null").select("term", "next").distinct()
    counts = written(postings.join(small(pairs), ["term", "next"], "left_semi").groupBy("term", "next").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    span = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, max(window - 2, 0))
    rated = words.join(small(counts), ["term", "next"], "left").withColumn("rate", F.when(F.col("next").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "ipos", "term", "next")))
    best = rated.withColumn("best", F.min("rate").over(span)).where((F.col("ipos") + window <= F.col("n_words")) | (F.col("ipos") == 0))
    item = ["item", "no"] if near else ["item"]
    pair = rated.where("rate.n > 0").select(*item, "ipos", "term", "next") if near else best.where("best.n > 0").select("item", "best.ipos", "best.term", "best.next").distinct()
    alone = words.where(F.col("n_words") == 1) if window > 1 else words
    pair, alone = small(written(pair, "anchors")), small(alone.select(*item, "ipos", "term"))
    diag = (F.col("pos") - F.col("ipos")).alias("diag")
    named = postings.join(pair, ["term", "next"]).select("doc", *item, diag).unionByName(postings.join(alone, "term").select("doc", *item, diag))
    return named if near else written(named.distinct(), "diagonals")


def matches(postings: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact occurrences as (doc, item, begin, until): maximal runs of document positions, until exclusive."""
    named = diagonals(postings, words, window)
    wanted = named.join(small(words), "item").select("doc", (F.col("diag") + F.col("ipos")).alias("pos"), "term", "item", "ipos", "n_words", "diag")
    lists = postings.select("doc", "pos", "term").join(small(named.select("doc").distinct()), "doc", "left_semi").distinct()
    met = lists.join(wanted, ["doc", "pos", "term"]).select("doc", "item", "diag", "ipos", "n_words")
    line = Window.partitionBy("doc", "item", "diag").orderBy("ipos")
    runs = met.withColumn("island", F.col("ipos") - F.row_number().over(line)).groupBy("doc", "item", "diag", "island").agg(F.min("ipos").alias("a"), F.max("ipos").alias("b"), F.first("n_words").alias("n_words"))
    return runs.where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n_words"))).select("doc", "item", (F.col("diag") + F.col("a")).alias("begin"), (F.col("diag") + F.col("b") + 1).alias("until"))


def rarest(postings: DataFrame, words: DataFrame, window: int, share: float) -> DataFrame:
    """The (item, ipos, term) of each phrase's rarest words, one more than a near match may lack."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    size = F.least(F.lit(window), F.col("n_words"))
    rated = words.join(small(written(counts, "term_counts")), "term", "left").select("item", "ipos", "term", F.coalesce("cf", F.lit(0)).alias("cf"), "n_words", size.alias("size"))
    begins = F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("size") + 1), F.least(F.col("ipos"), F.col("n_words") - F.col("size")))
    place = F.row_number().over(Window.partitionBy("item", "begin").orderBy("cf", "ipos"))
    ranked = rated.withColumn("begin", F.explode(begins)).withColumn("place", place)
    return ranked.where(F.col("place") <= F.col("size") - F.ceil(F.lit(share) * F.col("size")) + 1).select("item", "ipos", "term").distinct()


def item_numbers(words: DataFrame) -> DataFrame:
    """(item, no): items numbered from 0 without gaps, by the parts of a stored table and the rows before each part."""
    part, bits = F.shiftrightunsigned("at", 33), F.lit((1 << 33) - 1)
    stored = written(words.select("item").distinct().withColumn("at", F.monotonically_increasing_id()), "items")
    before, offsets = 0, []
    for r in stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a part
        offsets.append((r.part, before))
        before += r.n
    ahead = F.broadcast(words.sparkSession.createDataFrame(offsets, "part long, ahead long"))
    return stored.withColumn("part", part).join(ahead, "part").select("item", (F.col("ahead") + F.col("at").bitwiseAND(bits)).alias("no"))


def proximity(postings: DataFrame, words: DataFrame, window: int = WINDOW, slack: int = 5, share: float = 0.8) -> DataFrame:
    """Near matches as (doc, item, around, n_near): item words met within ``slack`` positions of a diagonal that two of
    them name, if they are at least ``share`` of a phrase. Exact occurrences are among them; an item word counts once.
    Documents and items without words are in no match; empty tables give no rows."""
    # A diagonal is two numbers: its document, and its item's number above its place. Both are small, so they pack well on
    # their way, and the cells in which diagonals meet the rare words' are reckoned from them, not carried.
    numbers = item_numbers(words)
    numbered = lambda df: df.join(small(numbers), "item")
    packed = lambda at: F.shiftleft(F.col("no"), 32).bitwiseOR((at + ZERO).cast("long"))
    place = lambda key: key.bitwiseAND(F.lit((1 << 32) - 1))
    cell = lambda key: F.shiftrightunsigned(key, 32) * (1 << 28) + F.floor(place(key) / CELL)
    at = F.col("pos") - F.col("ipos")
    anchors = small(numbered(written(rarest(postings, words, window, share), "rarest")))
    around = F.array_distinct(F.array(cell(packed(at - slack)), cell(packed(at + slack))))
    close = postings.join(anchors, "term").select("doc", F.explode(around).alias("cell"))
    named = diagonals(postings, numbered(words), window, near=True).select("doc", packed(F.col("diag")).alias("key"))
    met = named.join(close.withColumnRenamed("doc", "of"), (F.col("doc") == F.col("of")) & (cell(F.col("key")) == F.col("cell")), "left_semi").distinct()
    kept = met.withColumn("no", F.shiftrightunsigned("key", 32)).join(small(numbers), "no").select("doc", "item", (place(F.col("key")) - ZERO).cast("int").alias("diag"))
    lengths = small(words.select("item", "n_words").distinct())
    ends = kept.join(lengths, "item").withColumn("begin", F.greatest(F.lit(0), F.col("diag") - slack)).withColumn("until", F.col("diag") + F.col("n_words") + slack)
    wanted = small(written(ends.withColumn("span", F.explode(F.sequence(F.floor(F.col("begin") / SPAN), F.floor(F.col("until") / SPAN)))).drop("n_words"), "near_diagonals"))
    lists = postings.where("term > 0").select("doc", "pos", "term", F.floor(F.col("pos") / SPAN).alias("span"))
    around = lists.join(wanted, ["doc", "span"]).where((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("until"))).select("doc", "pos", "term", "item", "diag")
    met = around.join(small(words), ["item", "term"]).where(F.abs(F.col("pos") - F.col("diag") - F.col("ipos")) <= slack).select("doc", "item", "diag", "ipos", "n_words").distinct()
    some = Window.partitionBy("doc", "item", "diag").orderBy("ipos").rangeBetween(0, window - 1)
    counted = met.withColumn("n", F.count(F.lit(1)).over(some)).groupBy("doc", "item", "diag").agg(F.max("n").alias("n_near"), F.first("n_words").alias("n_words"))
    return counted.where(F.col("n_near") >= F.ceil(F.lit(share) * F.least(F.lit(window), F.col("n_words")))).select("doc", "item", F.col("diag").alias("around"), "n_near")


def _keyed(docs: DataFrame, doc_id: Column) -> DataFrame:
    """Each row is a document of its own, by its number; the postings are written in one go, so it stands for good."""
    return docs.select(doc_id.alias("doc_id"), "text", F.monotonically_increasing_id().alias("doc"))


def _listed(items: DataFrame) -> DataFrame:
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").withColumn("item", F.xxhash64("item_id", F.coalesce("text", F.lit("")))).dropDuplicates(["item"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: bool = True) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, item_ids, contaminated; with
    ``near`` also n_near_items, near_item_ids and n_near, the most words met of a phrase. Exact items are among the near.

    A null text has no words. Repeated rows each get a row. Items with a null id are named by the empty text; items
    of one id and other texts are one item. Other columns are not read. Without documents there are no rows, without
    items no hits.
    """
    listed = _listed(items)
    terms, words = item_words(listed.select("item", "text"))
    postings = index(_keyed(docs, F.col("doc_id")), terms)
    found = written(matches(postings, words, window), "matches")
    # Union of the ranges of a document by a running maximum of their ends, so that no hit word is a row.
    line = Window.partitionBy("doc").orderBy("begin", "until")
    before = F.max("until").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("until") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    hits = found.select("doc", "begin", "until").distinct().withColumn("fresh", fresh).groupBy("doc").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("doc", "item").distinct().join(small(listed.select("item", "item_id")), "item").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_doc = written(hits.join(named, "doc"), "contaminated")
    none = F.array().cast("array<string>")
    ids = F.coalesce("item_ids", none)
    exact = postings.where("term = 0").select("doc_id", "doc", "n_words").join(small(per_doc), "doc", "left").select(
        "doc",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ids.alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    if not near:
        return exact.drop("doc")
    close = proximity(postings, words, window).groupBy("doc", "item").agg(F.max("n_near").alias("n_near")).join(small(listed.select("item", "item_id")), "item")
    by_doc = written(close.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("near_item_ids"), F.max("n_near").alias("n_near")), "near")
    near_ids = F.coalesce("near_item_ids", none)
    return exact.join(small(by_doc), "doc", "left").withColumns({"n_near_items": F.size(near_ids).cast("long"), "near_item_ids": near_ids, "n_near": F.coalesce("n_near", F.lit(0)).cast("long")}).drop("doc")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs(doc_id, text, ...) in which no phrase of an item occurs, whole or nearly.

    Null and wordless texts stay; repeated rows stay or go together; other columns of any name pass as they are.
    Without items everything stays.
    """
    terms, words = item_words(_listed(items).select("item", "text"))
    key = row_key(F.col("doc_id"), F.col("text"))
    postings = index(_keyed(docs, key), terms)
    found = matches(postings, words, window).select("doc").unionByName(proximity(postings, words, window).select("doc"))
    hit = small(written(found.distinct(), "contaminated"))
    gone = written(postings.where("term = 0").join(hit, "doc", "left_semi").select(F.col("doc_id").alias("key")).distinct(), "gone")
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(small(gone), "key", "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=False)
    return found.drop("item_ids")


def op9_decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_decontaminate, which its SQL fixes, and those of the near matches."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
m AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.phrase = g.phrase),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
