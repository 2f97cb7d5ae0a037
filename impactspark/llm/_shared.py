"""What the operators share: scratch tables in the cluster's shared folder, stable columns, Arrow text blocks."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on one machine (tests), a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="impactspark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_marked: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if root not in _marked:
        _marked.add(root)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the scratch table behind a frame made by written()."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit exchange; follows the session's setting, which grows with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of those taken (case aside)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of id and text, as hex; nulls are told from empty texts. Repeated rows alone share a key."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(told(doc_id), F.lit("\u0000"), told(text)))


#: Bytes of text that one numpy block holds at most, beyond its first document.
BLOCK = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Some whole documents side by side in one byte buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def folded(self) -> np.ndarray:
        return FOLD[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word [^\\x20\\x09-\\x0D]+."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~SEPARATOR[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.repeat(np.arange(len(self)), np.diff(np.searchsorted(start, self.offsets)))
        return start, end, doc

def ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges, which go up and don't overlap, as a binary array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value, equal only for equal values, and the distinct values in order of appearance."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def released() -> None:
    """Give memory that is free back to the system: Arrow's pool and the C heap keep the most a fit ever held."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def digests(values: pa.Array) -> np.ndarray:
    """128-bit hashes of byte strings as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values.to_numpy(zero_copy_only=False))), ">u8").astype(np.uint64).reshape(-1, 2)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """The column as blocks of whole documents, each with the row it begins at."""
    data, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows in batches of so many bytes of text each, beyond their first row, so that little is held at once."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(column))
        at, n = 0, len(batch)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()
