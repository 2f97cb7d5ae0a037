"""Fitting on bounded samples: labelled rows, hashed linear features, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactspark.llm._shared import Block, blocks, digests, id_crc, mix, numbered, ranges

FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * np.asarray(x, np.float64)) + 0.5


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * margin + shift) a probability of y; Newton's method, smoothed targets."""
    margin, y = np.asarray(margin, np.float64), np.asarray(y, np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = margin.mean(), max(margin.std(), 1e-9)
    x = (margin - mean) / spread
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-3 * a * a

    now = loss(a, b)
    for _ in range(rounds):
        p = sigmoid(a * x + b)
        g = np.array([((p - target) * x).sum() + 2e-3 * a, (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(w * x * x).sum() + 2e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        by = 1.0
        while by > 1e-6 and loss(a - by * move[0], b - by * move[1]) > now:
            by /= 2
        a, b = a - by * move[0], b - by * move[1]
        was, now = now, loss(a, b)
        if was - now < 1e-9:
            break
    return float(a / spread), float(b - a * mean / spread)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, held_out: int = 0, seed: int = 11) -> tuple[list[bytes], np.ndarray]:
    """Up to ``rows`` texts of each class with their labels, none of them held out, in a fixed order.

    The rows are the first by a hash of their ids, of texts of ``chars`` characters at most. Several labels of one
    id count as the highest, several texts as the least; other labels than 0 and 1, and nulls, are no labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & (id_crc(F.col("doc_id")) % FOLDS != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(rows).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(rows))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").groupBy("doc_id", "y").agg(F.min("text").cast("binary").alias("text")).toArrow()
    found = sorted(zip(got["doc_id"].to_pylist(), got["text"].to_pylist(), got["y"].to_pylist(), strict=True))
    return [x[1] for x in found], np.array([x[2] for x in found], np.float32)


def label_share(labels: DataFrame, label: str, held_out: int = 0) -> float:
    """The share of label 1 among all rows that aren't held out; 0 without any."""
    known = labels.where(F.col(label).isin(0, 1) & (id_crc(F.col("doc_id")) % FOLDS != held_out))
    return float(known.agg(F.avg(label)).first()[0] or 0.0)


def sample_key(seed: int = 13) -> Column:
    """Orders the rows of unlabelled_sample; its lowest bit deals all rows into halves."""
    return F.xxhash64("doc_id", "text", F.lit(seed))


def unlabelled_sample(docs: DataFrame, rows: int, chars: int) -> tuple[np.ndarray, list[bytes]]:
    """Keys and texts of up to ``rows`` rows, the first by sample_key(), while all their texts together have ``chars``
    characters at most; single texts of an eighth of that and more are passed over. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(sample_key().alias("key"), F.length(text).alias("n")).where(F.col("n") < chars // 8)
    first = slim.orderBy("key").limit(rows).collect()  # keys alone are sorted, so no task reads many texts
    upto = int(np.searchsorted(np.cumsum([r.n for r in first]), chars, side="right")) if first else 0
    keys = sorted({r.key for r in first[:upto]})
    if not keys:
        return np.zeros(0, np.int64), []
    picked = docs.sparkSession.createDataFrame([(k,) for k in keys], "key long")
    got = docs.select(sample_key().alias("key"), text.alias("text")).join(F.broadcast(picked), "key").groupBy("key").agg(F.min("text").cast("binary").alias("text")).toArrow()
    found = sorted(zip(got["key"].to_pylist(), got["text"].to_pylist(), strict=True))
    return np.array([k for k, _ in found], np.int64), [t for _, t in found]


#: Tables of the linear model: words, word pairs, word shapes, and character n-grams of three and four.
GROUPS = ("one", "two", "shape", "three", "four")
BITS = {"one": 18, "two": 18, "shape": 12, "three": 16, "four": 18}
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[33, 44, 46, 58, 59, 63]] = 5
_CLASS[[35, 36, 37, 38, 42, 60, 62, 124]] = 6


@dataclass
class Features:
    """Buckets of each group's features, in document order, with the documents' offsets into them."""

    rows: dict[str, np.ndarray]
    offsets: dict[str, tuple[np.ndarray, np.ndarray]]
    n_words: np.ndarray


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of a block, its bytes in one word, and the documents' offsets into them."""
    data = block.data
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), block.offsets
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    out = data[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        out[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out, np.searchsorted(at, block.offsets)


def features(block: Block) -> Features:
    """Hashed word unigrams and pairs (A-Z folded), word shapes, and character n-grams as they stand."""
    start, end, doc = block.words()
    n = len(block)
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    at = np.concatenate(([0], np.cumsum(counts)))
    number, values = numbered(ranges(block.folded(), start, end))
    h = digests(values)[:, 0][number]
    bucket = lambda x, g: (x >> np.uint64(64 - BITS[g])).astype(np.int32)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = np.zeros(len(h), np.uint64)
    same[1:] = (number[1:] == number[:-1]) & (doc[1:] == doc[:-1])
    size = np.minimum(end - start, 15).astype(np.uint64)
    cut = block.data
    shape = same << np.uint64(10) | size << np.uint64(6) | _CLASS[cut[start]].astype(np.uint64) << np.uint64(3) | _CLASS[cut[end - 1]].astype(np.uint64) if len(h) else h
    wide, chars_at = characters(block)
    spread = wide * np.uint32(2654435761)
    three = (spread[:-2] ^ (spread[1:-1] << np.uint32(11) | spread[1:-1] >> np.uint32(21))) * np.uint32(2246822519) + spread[2:] if len(wide) > 2 else wide[:0]
    four = (three[:-1] ^ (three[:-1] >> np.uint32(15))) * np.uint32(3266489917) + spread[3:] if len(wide) > 3 else wide[:0]
    upto = lambda less, top: (np.minimum(chars_at[:-1], top), np.clip(np.maximum(chars_at[1:] - less, chars_at[:-1]), 0, top))
    return Features(
        {
            "one": bucket(h, "one"),
            "two": bucket(pair, "two") if len(h) > 1 else np.zeros(0, np.int32),
            "shape": shape.astype(np.uint16),
            "three": (((three ^ three >> np.uint32(15)) * np.uint32(668265263)) >> np.uint32(32 - BITS["three"])).astype(np.uint16),
            "four": (((four ^ four >> np.uint32(15)) * np.uint32(668265263)) >> np.uint32(32 - BITS["four"])).astype(np.int32),
        },
        {
            "one": (at[:-1], at[1:]),
            "two": (np.minimum(at[:-1], max(len(h) - 1, 0)), np.clip(np.maximum(at[1:] - 1, at[:-1]), 0, max(len(h) - 1, 0))),
            "shape": (at[:-1], at[1:]),
            "three": upto(2, len(three)),
            "four": upto(3, len(four)),
        },
        counts,
    )


@dataclass
class Linear:
    """A linear score of mean features, and its calibration to a probability."""

    tables: dict[str, np.ndarray]
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    empty: float = 0.0

    @staticmethod
    def new() -> Linear:
        return Linear({g: np.zeros(1 << BITS[g], np.float32) for g in GROUPS})

    def margins(self, f: Features) -> np.ndarray:
        out = np.full(len(f.n_words), self.bias)
        for g in GROUPS:
            sums = np.concatenate(([0.0], np.cumsum(self.tables[g][f.rows[g]], dtype=np.float64)))
            a, b = f.offsets[g]
            out += (sums[b] - sums[a]) / np.maximum(b - a, 1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for at, block in blocks(column):
            f = features(block)
            p = sigmoid(self.scale * self.margins(f) + self.shift)
            out[at : at + len(block)] = np.where(f.n_words > 0, p, self.empty)
        return out


class Trainer:
    """Full gradients of a linear model over documents in memory, with momentum."""

    def __init__(self, texts: list[bytes]):
        self.model = Linear.new()
        self.parts = [(at, features(b)) for at, b in blocks(pa.array(texts, pa.large_binary()))]
        self.n = len(texts)
        self.speed = {g: np.zeros_like(t, dtype=np.float64) for g, t in self.model.tables.items()}
        self.bias_speed = 0.0
        self.rate = {g: self._rate(g) for g in GROUPS}

    def _rate(self, g: str) -> float:
        """From the mean squared length of the group's feature vectors."""
        total = 0.0
        for _, f in self.parts:
            a, b = f.offsets[g]
            for x, y in list(zip(a.tolist(), b.tolist(), strict=True))[:64]:
                if y > x:
                    total = max(total, float((np.bincount(f.rows[g][x:y]) ** 2).sum()) / (y - x) ** 2)
        return 1.0 / max(total, 1e-4)

    def margins(self) -> np.ndarray:
        return np.concatenate([self.model.margins(f) for _, f in self.parts]) if self.parts else np.zeros(0)

    def step(self, g_doc: np.ndarray, rate: float, momentum: float = 0.9, decay: float = 1e-6) -> None:
        """Move against the gradient g_doc of the loss by each document's margin."""
        for g in GROUPS:
            grad = np.zeros(len(self.model.tables[g]))
            for at, f in self.parts:
                a, b = f.offsets[g]
                each = g_doc[at : at + len(a)] / np.maximum(b - a, 1)
                edge = np.zeros(len(f.rows[g]) + 1)
                np.add.at(edge, a, each)
                np.add.at(edge, b, -each)
                grad += np.bincount(f.rows[g], weights=np.cumsum(edge[:-1]), minlength=len(grad))
            self.speed[g] = momentum * self.speed[g] - rate * self.rate[g] * (grad + decay * self.model.tables[g])
            self.model.tables[g] += self.speed[g].astype(np.float32)
        self.bias_speed = momentum * self.bias_speed - rate * float(g_doc.sum())
        self.model.bias += self.bias_speed
