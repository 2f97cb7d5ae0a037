"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints within two bits share at least six of them, so the
postings lists (position, byte) of both meet at least six times: the count filter. Lists of a single byte are long
(a 256th of all fingerprints each), so they are read four at a time: the six position sets below are a covering
design, the complements of which hold every pair of positions, so every six shared positions contain one of the
sets and each linked pair meets in at least one intersected list. Each pair met there has its shared bytes tallied,
is kept at six or more, and is verified by bits.

Equal fingerprints are one posting. An intersected list longer than ``LONG`` isn't expanded into pairs: each of its
fingerprints names the 65 values within one bit of itself; two fingerprints are within two bits exactly if they
name a common value, and each value (of 65 namers at most) links its namers in a star. That is exact, costs 65 rows
for each such fingerprint and replaces no links, only their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._shared import remove, row_key, sliced, table, written

WORDS, MAX_BITS, LONG = 3, 2, 32
#: Keys of rows that go are broadcast after a count, up to so many (some 100 bytes each).
BROADCAST_ROWS = 500_000
#: Six sets of four byte positions; their complements hold each of the 28 pairs of positions.
COVER = ((4, 5, 6, 7), (2, 3, 6, 7), (2, 3, 4, 5), (0, 1, 6, 7), (0, 1, 4, 5), (0, 1, 2, 3))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of one text, as a signed 64-bit number; null and wordless texts have zero."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        counts, n = np.unpackbits(np.frombuffer(digest(joined, 42), np.uint8)).astype(np.int64), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(found) - words + 1
        counts = np.zeros(64, np.int64)
        cuts = [*range(0, n, 1 << 15), n]
        for a, b in pairwise(cuts):
            raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist(), strict=True)])
            counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(b - a, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row_key (of id and text) and fp (signed 64-bit) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = batch.column(2).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())], ["doc_id", "row_key", "fp"])

    slim = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, row_key string, fp long")


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(255 << (56 - 8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(distinct: DataFrame, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """Edges (u, v), u > v, that join the same fingerprints as all pairs within max_bits (2 at most) do."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the covering design guarantees up to two differing bits")
    fp = F.col("fp")
    postings = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), fp.bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(COVER)))).alias("at")).select("fp", "at.cut", "at.key")
    lengths = postings.groupBy("cut", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(postings.join(lengths, ["cut", "key"]), "postings")
    short = met.where(F.col("n") <= long).groupBy("cut", "key").agg(F.collect_list("fp").alias("fps"))
    a, b = F.col("a"), F.col("b")
    shared = sum((F.when(byte_at(a, p) == byte_at(b, p), 1).otherwise(0) for p in range(8)), F.lit(0))
    pairs = short.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where(a > b).where(shared >= 8 - max_bits).where(F.bit_count(a.bitwiseXOR(b)) <= max_bits).select(a.alias("u"), b.alias("v"))
    if max_bits < 2:  # every list in pairs: namers of a value may be two bits apart
        ball = [0] if max_bits == 0 else []
    else:
        ball = [0, *(1 << i for i in range(63)), -(1 << 63)]
    crowded = met.where(F.col("n") > long).select("fp").distinct()
    if max_bits == 2:
        named = crowded.select("fp", F.explode(F.array(*(F.lit(x).cast("long") for x in ball))).alias("bit")).select("fp", fp.bitwiseXOR(F.col("bit")).alias("value"))
        stars = named.groupBy("value").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.explode("fps").alias("u"), "v").where("u > v")
    elif max_bits == 1:  # one bit apart: their values with that bit cleared meet
        bits = [*(1 << i for i in range(63)), -(1 << 63)]
        named = crowded.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).cast("long").alias("bit")) for i, x in enumerate(bits)))).alias("b")).select("fp", "b.i", fp.bitwiseAND(F.bitwise_not(F.col("b.bit"))).alias("value"))
        stars = named.groupBy("i", "value").agg(F.min("fp").alias("v"), F.max("fp").alias("u")).where("u > v").select("u", "v")
    else:
        return pairs.limit(0)
    return pairs.unionByName(stars)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the least node of each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and root, the least node of its component, for every linked node of edges(u, v) but the roots; large and small
    stars in turn. No edges give no rows; repeated edges, and edges either way round, change nothing; null ends are not
    allowed.

    Each round is written to the shared folder, so no lineage grows and a lost executor costs one round at most.
    """
    now = written(edges.select("u", "v").mapInArrow(_forest, "u long, v long"), "edges")
    size = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = size(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        was, seen = seen, size(after)
        remove(now)
        now = after
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, words: int, max_bits: int, long: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; (fp, first, root) of the distinct ones, first being their least (no id, id, row key)."""
    fps = written(fingerprints(docs, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    distinct = written(fps.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, long))
    return fps, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs(doc_id, text).

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows each get a row. Null ids
    link too but never name a component, unless all its ids are null (component_id is null then). Other columns are
    not read; an empty table has no rows.
    """
    fps, rooted = _grouped(docs, words, max_bits, long)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    labels = rooted.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_copies(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, long: int = LONG) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each component: that of the least id (nulls last, then of the least row key).

    Of repeated rows one stays, if any. Null and wordless texts are one component. Other columns of any name pass as
    they are; an empty table stays empty. What stays is found by aggregates alone, so no component meets in one task.
    """
    fps, rooted = _grouped(docs, words, max_bits, long)
    stays = written(rooted.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.row_key").alias("key")), "stays")
    keys = fps.groupBy(F.col("row_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    gone = written(keys.join(stays, "key", "left_anti").select("key"), "gone")
    again = written(keys.where("n > 1").join(stays, "key", "left_semi").select("key"), "again")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    kept = rows.join(gone, "key", "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    repeated = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(again, "key", "left_anti").unionByName(repeated).select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
