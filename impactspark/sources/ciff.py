"""The common index file format: delimited protocol-buffer messages - a header, postings lists, document records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.sources.documents import binary_files


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = data[at]
        at += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a message: varints, doubles and floats, and length-delimited bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def messages(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n, at = varint(data, at)
        yield data[at : at + n]
        at += n


#: The header's fields by number.
_HEADER = {1: "version", 2: "num_postings_lists", 3: "num_docs", 4: "total_postings_lists", 5: "total_docs", 6: "total_terms_in_collection", 7: "average_doclength", 8: "description"}


def header(data: bytes) -> dict:
    out = {_HEADER[k]: v for k, v in fields(next(messages(data))) if k in _HEADER}
    return out | ({"description": out["description"].decode()} if "description" in out else {})


def postings_list(message: bytes) -> tuple[str, int, int, list[tuple[int, int]]]:
    term, df, cf, posts = "", 0, 0, []
    for k, v in fields(message):
        if k == 1:
            term = v.decode(errors="replace")
        elif k == 2:
            df = v
        elif k == 3:
            cf = v
        elif k == 4:
            p = dict(fields(v))
            posts.append((p.get(1, 0), p.get(2, 0)))
    return term, df, cf, posts


def document(message: bytes) -> tuple[int, str, int]:
    d = dict(fields(message))
    return d.get(1, 0), d.get(2, b"").decode(errors="replace"), d.get(3, 0)


_ROW = "kind string, at long, term string, df long, cf long, postings array<struct<docid_gap:int,tf:int>>, docid int, collection_docid string, doclength int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of both kinds, 'list' and 'document', as they stand in the files. The messages have no marks between them, so
    a file is one task; writers of large indexes make many files."""
    return rows_in(binary_files(spark, path))


def rows_in(files: DataFrame) -> DataFrame:
    """Of files(content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                lists, rows = None, []
                for i, m in enumerate(messages(content)):
                    if lists is None:
                        lists = header(content)["num_postings_lists"]
                    elif i <= lists:
                        term, df, cf, posts = postings_list(m)
                        rows.append(("list", i, term, df, cf, [{"docid_gap": g, "tf": t} for g, t in posts], None, None, None))
                    else:
                        rows.append(("document", i, None, None, None, None, *document(m)))
                    if len(rows) == 2048:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return files.mapInPandas(run, _ROW)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in "kind,at,term,df,cf,postings,docid,collection_docid,doclength".split(",")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"df": "Int64", "cf": "Int64", "docid": "Int32", "doclength": "Int32"})


def postings(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf): gaps summed along each list, ids from 1, frequencies up to 1024."""
    at = rows.where("kind = 'list'").select("term", F.posexplode("postings").alias("i", "p"))
    line = Window.partitionBy("term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return at.select("term", (F.sum("p.docid_gap").over(line) + 1).alias("doc_id"), F.least("p.tf", F.lit(1024)).alias("tf"))


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, primary_key, length)."""
    return rows.where("kind = 'document'").select((F.col("docid") + 1).cast("long").alias("doc_id"), F.col("collection_docid").alias("primary_key"), F.col("doclength").cast("long").alias("length"))


def _put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | bytes | str | float) -> bytes:
    if isinstance(value, float):
        return _put(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return _put(number << 3) + _put(value)
    raw = value.encode() if isinstance(value, str) else value
    return _put(number << 3 | 2) + _put(len(raw)) + raw


def _framed(message: bytes) -> bytes:
    return _put(len(message)) + message


def encode(lists: list[tuple[str, list[tuple[int, int]]]], docs: list[tuple[str, int]], description: str = "") -> bytes:
    """A file of lists (term, [(0-based id, tf)]) and documents (key, length)."""
    total = sum(n for _, n in docs)
    head = b"".join(_field(k, v) for k, v in ((1, 1), (2, len(lists)), (3, len(docs)), (4, len(lists)), (5, len(docs)), (6, total), (7, total / max(1, len(docs))), (8, description)))
    out = [_framed(head)]
    for term, posts in lists:
        before, parts = 0, []
        for d, tf in posts:
            parts.append(_field(4, _field(1, d - before) + _field(2, tf)))
            before = d
        out.append(_framed(_field(1, term) + _field(2, len(posts)) + _field(3, sum(t for _, t in posts)) + b"".join(parts)))
    out += [_framed(_field(1, i) + _field(2, key) + _field(3, n)) for i, (key, n) in enumerate(docs)]
    return b"".join(out)
