"""Document sources: frames of (primary_key, contents). Compressed files are opened by Hadoop's codecs by their names."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "primary_key string, contents string"
UNKNOWN, ANONYMOUS = "Unknown", "AnonymousDocument"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, a folder's files by name."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("primary_key"), F.col("value").alias("contents"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) with gzip undone."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in b.content])

    return raw.mapInPandas(run, "path string, content binary")


def in_memory(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(texts, SCHEMA)


def _tagged(text: Column, opening: str, closing: str, key: str) -> Column:
    """(primary_key, contents) of each element; contents keep the tags. An element without an end is no document."""
    element = f"(?s){opening}.*?{closing}"
    name = lambda d: F.trim(F.regexp_extract(d, f"(?s)<{key}>(.*?)</{key}>", 1))
    found = lambda d: F.regexp_like(d, F.lit(f"(?s)<{key}>.*?</{key}>"))
    return F.transform(F.regexp_extract_all(text, F.lit(element), F.lit(0)), lambda d: F.struct(F.when(found(d), name(d)).otherwise(UNKNOWN).alias("primary_key"), d.alias("contents")))


def tagged(text: DataFrame, doc_tag: str = "DOC", key_tag: str = "DOCNO", column: str = "value", prefix: bool = False) -> DataFrame:
    """Documents of a text column that holds whole elements; prefix lets the opening tag have attributes."""
    opening = f"<{re.escape(doc_tag)}{'[^>]*' if prefix else ''}>"
    return text.select(F.explode(_tagged(F.col(column), opening, f"</{re.escape(doc_tag)}>", re.escape(key_tag))).alias("d")).select("d.*")


def trec(spark: SparkSession, path: str, doc_tag: str = "DOC", key_tag: str = "DOCNO") -> DataFrame:
    """Files are split at opening tags, not read whole, so a large file is many tasks. What stands before a file's first
    opening tag, and a document whose closing tag is missing, are no documents."""
    return trec_parts(spark.read.text(path, lineSep=f"<{doc_tag}>"), doc_tag, key_tag)


def trec_parts(parts: DataFrame, doc_tag: str = "DOC", key_tag: str = "DOCNO") -> DataFrame:
    """Documents of what stands behind opening tags."""
    whole = F.regexp_extract("value", f"(?s)^.*?</{re.escape(doc_tag)}>", 0)
    return tagged(parts.select(F.concat(F.lit(f"<{doc_tag}>"), whole).alias("value")).where(F.length("value") > len(doc_tag) + 2), doc_tag, key_tag)


def html(spark: SparkSession, path: str, key_tag: str = "title") -> DataFrame:
    return tagged(spark.read.text(path, wholetext=True), "html", key_tag, prefix=True)


WARC_KEY = "WARC-TREC-ID:"


def warc(spark: SparkSession, path: str) -> DataFrame:
    """Records with a WARC-TREC-ID: the bytes that Content-Length counts behind its line.

    Files are split at lines that begin with the id's name and streamed, whatever their size; one that isn't
    compressed is many tasks. A line of a payload that begins with that name ends its record.
    """
    return warc_parts(spark.read.text(path, lineSep=f"\n{WARC_KEY}"))


def warc_parts(parts: DataFrame) -> DataFrame:
    """Records of what stands behind the id's name; other parts have no length or begin with a record's first line."""
    head = F.regexp_extract("value", "(?s)^.*?\\nContent-Length:[ \\t]*[0-9]+[^\\n]*\\n", 0)
    size = F.regexp_extract(head, "Content-Length:[ \\t]*([0-9]+)[^\\n]*\\n$", 1).cast("int")
    body = F.substring(F.col("value").cast("binary"), F.octet_length(head) + 1, size)
    key = F.trim(F.regexp_extract("value", "^[ \\t]*([^\\r\\n]*)", 1))
    return parts.where((head != "") & ~F.col("value").startswith("WARC/")).select(key.alias("primary_key"), F.make_valid_utf8(body.cast("string")).alias("contents"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records from '>' to the next line that begins with one; the key is the first line with its '>'. Files are split at
    such lines and streamed."""
    return fasta_parts(spark.read.text(path, lineSep="\n>"))


def fasta_parts(parts: DataFrame) -> DataFrame:
    """Records of what stands between lines' '>'; a file's first still has its own."""
    text = F.rtrim(F.concat(F.when(F.col("value").startswith(">"), "").otherwise(">"), "value"), F.lit("\n"))
    return parts.where(F.trim("value") != "").select(F.trim(F.substring_index(text, "\n", 1)).alias("primary_key"), text.alias("contents"))


def sparse_json(spark: SparkSession, path: str) -> DataFrame:
    """(primary_key, term, tf) of lines {"id": ..., "vector": {term: weight}}; weights end at 1024, zeros go."""
    return sparse_lines(spark.read.text(path))


def sparse_lines(lines: DataFrame) -> DataFrame:
    """Lines with a list in place of an object, or none, have no terms."""
    one = lines.select(F.from_json("value", "id string, vector map<string,int>").alias("d")).select("d.*")
    return one.select(F.coalesce("id", F.lit(ANONYMOUS)).alias("primary_key"), F.explode("vector").alias("term", "w")).where("w > 0").select("primary_key", "term", F.least("w", F.lit(1024)).alias("tf"))


def postings_dump(spark: SparkSession, path: str) -> DataFrame:
    """(list, ids) of binary dumps: a 32-bit length and as many 32-bit ids, again and again."""
    return dump_lists(binary_files(spark, path))


def dump_lists(files: DataFrame) -> DataFrame:
    """Of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                at, rows, n_rows = 0, [], 0
                while at + 4 <= len(content):
                    n = int.from_bytes(content[at : at + 4], "little")
                    rows.append((f"{name}#{n_rows}", np.frombuffer(content, "<u4", n, at + 4).astype(np.int64).tolist()))
                    at, n_rows = at + 4 + 4 * n, n_rows + 1
                    if len(rows) == 2048:
                        yield pd.DataFrame(rows, columns=["list", "ids"])
                        rows = []
                yield pd.DataFrame(rows, columns=["list", "ids"])

    return files.mapInPandas(run, "list string, ids array<long>")


#: Readers by format name.
READERS: dict[str, Callable[..., DataFrame]] = {"trec": trec, "html": html, "warc": warc, "fasta": fasta, "files": whole_files}


def read(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    if format not in READERS:
        raise ValueError(f"unknown document format {format!r}; known: {', '.join(READERS)}")
    return READERS[format](spark, path, **options)
