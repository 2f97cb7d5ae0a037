"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped levels.

The first level holds the vocabulary: 128-bit word hashes in shards by hash range, their upper halves as Elias-Fano
sequences and 32 more bits beside them for comparison, so a word's number is its place in the level, and exact counts.
Each further level holds the successors of the level before it: a context is the number of a gram there, found one
level up by its own context, so a gram is reached by descent, word by word. A level's shards have the contexts as an
Elias-Fano sequence, monotone pointers to their successor ranges, and the successors' word numbers made monotone by
adding each range to the last value of the one before it. A gram is found by its context's place, its range's base and
one successor search for base plus word. Beside it stands what its context adds to its probability, as a 16-bit code:

    p(w | h) = c(h w) / (c(h) + mu) + mu / (c(h) + mu) * p(w | shorter h),   p(w) = (c(w) + 1) / (tokens + types + 1)

The first quotient is the code; the weight of the shorter history follows from the context's count. A context lives in
one shard by its hash; one whose words are all more frequent than a share of a shard is spread by gram, so no context is
a shard. Grams of three words are counted in one pass with those of two and live beside their contexts: such a shard has
a range for every gram of the shard above, in place of a sequence of contexts; the spread ones have shards of their own.

Everything is counted over all training texts; no n-gram is cut off. Counts are gathered as compressed blocks of
(shard, keys, counts), merged and written by one task for each shard into the shared folder; the shards follow the
size of the input. Scoring tasks map the shards they need; on a store that can't be mapped, a shard is copied to a
temporary file of the worker first.
"""

from __future__ import annotations

import mmap
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import IO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._shared import Block, blocks, digests, id_crc, mix, numbered, ranges, scratch_path, table, tasks

START, END, FIRST, UNKNOWN = 0, 1, 2, -1
ORDER = 3
#: Weight of the shorter history, against two words of history and more, and against one.
MU_LONG, MU = 4.0, 16.0
#: Probability codes: steps of log10 from 0 down to -FLOOR.
FLOOR, CODES = 24.0, 65535
#: Bytes of text counted together before their counts go to the shards.
TOGETHER = 12 << 20
#: Bytes of the input's files for each shard of the vocabulary, tokens for each shard of the other levels, at most.
SHARD_BYTES, SHARD_TOKENS = 64 << 20, 4 << 20
HELD_OUT = 2
U = np.uint64


# -- Elias-Fano ---------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values as a bit string of fixed width, in 64-bit words with two spare."""
    out = np.zeros(-(-len(values) * width // 64) + 2, U)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, off = bit >> 6, (bit & 63).astype(U)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # a value begins in every word, as none is wider
        out[: len(first)] = np.bitwise_or.reduceat(values << off, first)
        over = np.flatnonzero(off + U(width) > U(64))
        out[word[over] + 1] |= values[over] >> (U(64) - off[over])
    return out


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U)
    bit = at.astype(U) * U(width)
    word, off = (bit >> U(6)).astype(np.int64), bit & U(63)
    high = (words[word + 1] << U(1)) << (U(63) - off)  # in two steps, as a shift by 64 is none
    return ((words[word] >> off) | high) & U((1 << width) - 1)


def _byte_places() -> np.ndarray:
    """The place of the k-th set bit of each byte."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    out = np.zeros((256, 8), np.uint8)
    byte, place = np.nonzero(bits)
    out[byte, (np.cumsum(bits, axis=1) - 1)[byte, place]] = place
    return out.ravel()


_PLACES, _ONES, _HIGH = _byte_places(), U(0x0101010101010101), U(0x8080808080808080)


def _select(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word, which has so many: sums by byte, then a table."""
    k = k.astype(U)
    sums = x - ((x >> U(1)) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + ((sums >> U(2)) & U(0x3333333333333333))
    sums = ((sums + (sums >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    at = np.bitwise_count(((k * _ONES | _HIGH) - sums) & _HIGH).astype(U) << U(3)
    rank = k - (((sums << U(8)) >> at) & U(255))
    return at.astype(np.int64) + _PLACES[((((x >> at) & U(255)) << U(3)) | rank).astype(np.int64)]


def _ones_below(x: np.ndarray) -> np.ndarray:
    """How many ones each word has before its lowest zero."""
    return np.bitwise_count(x & ~(x + U(1))).astype(np.int64)


class EliasFano:
    """An increasing sequence of numbers below 2^63, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> U(width)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view(U)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
        return EliasFano(n, width, _pack(values & U((1 << width) - 1), width), words, ones, np.arange(len(words)) * 64 - ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _one(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words and places of the i-th ones."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word, word * 64 + _select(self.high[word], i - self.ones[word])

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i).astype(U) << U(self.width)) | _unpack(self.low, i, self.width)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values; quickest in order."""
        return self._value(i, self._one(i)[1])

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those after them; the next one is mostly in the same word."""
        word, at = self._one(i)
        off = (at & 63).astype(U)
        rest = (self.high[word] >> off) >> U(1)
        following = at + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        following[far] = self._one(i[far] + 1)[1]
        return self._value(i, at), self._value(i + 1, following)

    def _zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of the k-th zeros, turned over, and the numbers and places of these words' zeros."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        x = ~self.high[word]
        return x, word, _select(x, k - self.zeros[word])

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the values of each bucket: behind the zero before it as many as there are ones."""
        x, word, at = self._zero(np.maximum(bucket - 1, 0))
        begin = word * 64 + at + 1 - bucket
        rest = (x >> at.astype(U)) >> U(1)  # turned over: the run ends at the lowest one
        end = begin + np.bitwise_count((rest & (~rest + U(1))) - U(1))
        far = np.flatnonzero((rest == 0) | (bucket == 0))  # the run goes on in the next word, or has no zero before it
        if len(far):
            _, word, at = self._zero(bucket[far])
            end[far] = word * 64 + at - bucket[far]
            begin[far[bucket[far] == 0]] = 0
        return begin, end

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value of at least x (n if there is none), and whether it is x."""
        bucket = (x >> U(self.width)).astype(np.int64)
        last = len(self.zeros) * 64 - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1])) - 1
        beyond = np.flatnonzero(bucket >= last)
        bucket[beyond] = last - 1
        begin, end = self._bucket(bucket)
        want = x & U((1 << self.width) - 1)
        # Most buckets have few values, so the first one settles most searches.
        first, some = _unpack(self.low, begin, self.width), begin < end
        there = (first == want) & some
        rest = np.flatnonzero((first < want) & some)
        lo, hi, low = begin[rest] + 1, end[rest], want[rest]
        # Halving within the others.
        open_ = np.flatnonzero(lo < hi)
        a, b, sought = lo[open_], hi[open_], low[open_]
        while len(open_):
            mid = (a + b) >> 1
            less = _unpack(self.low, mid, self.width) < sought
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            more = a < b
            lo[open_] = a
            open_, a, b, sought = open_[more], a[more], b[more], sought[more]
        begin[rest] = lo
        inside = np.flatnonzero(lo < hi)
        there[rest[inside]] = _unpack(self.low, lo[inside], self.width) == low[inside]
        begin[beyond] = self.n
        there[beyond] = False
        return begin, there

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value of at least x; n if there is none."""
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place of each x, -1 where it isn't there."""
        if not self.n:
            return np.full(len(x), -1)
        at, there = self._search(x)
        return np.where(there, at, -1)


# -- Levels in files ----------------------------------------------------------------------------------------------


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; Hadoop's names of stores are told by the names used here."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _save(folder: str, name: str, head: dict, arrays: list[np.ndarray]) -> str:
    """Arrays behind a head that says where they are; the file's path."""
    places, at = [], 0
    for a in arrays:
        places.append((at, a.dtype.str, len(a)))
        at += -(-a.nbytes // 64) * 64
    raw = pickle.dumps(head | {"places": places})
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    path = f"{path}/{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(path) as out:
        out.write(len(raw).to_bytes(8, "little") + raw + bytes(-(len(raw) + 8) % 64))
        for a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 64))
    return path


#: Files that a worker has mapped at a time; a level's shards are read one after another, so few are enough.
MAPPED = 8
_mapped: dict[str, tuple[dict, list[np.ndarray]]] = {}
_copies: dict[str, IO[bytes]] = {}


def _opened_file(folder: str, path: str) -> IO[bytes]:
    """The file, or the worker's copy of it, which is made once and gone with the worker."""
    store, _ = _store(folder)
    if isinstance(store, pafs.LocalFileSystem):
        return open(path, "rb")
    if path not in _copies:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        with store.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                file.write(part)
        file.flush()
        _copies[path] = file
    return os.fdopen(os.dup(_copies[path].fileno()), "rb")


def _load(folder: str, path: str) -> tuple[dict, list[np.ndarray]]:
    """The file's head and its arrays, mapped and not read; the file mapped longest ago gives way."""
    if path in _mapped:
        return _mapped[path]
    while len(_mapped) >= MAPPED:
        del _mapped[next(iter(_mapped))]
    with _opened_file(folder, path) as file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = pickle.loads(data[8 : 8 + size])
    base = -(-(size + 8) // 64) * 64
    _mapped[path] = head, [np.frombuffer(data, dtype, n, base + at) for at, dtype, n in head["places"]]
    return _mapped[path]


def _sequence(shape: tuple[int, int], arrays: list[np.ndarray]) -> EliasFano:
    return EliasFano(*shape, *arrays)


@dataclass
class Vocabulary:
    """The first level; files and first numbers by shard, in the order of their hash ranges."""

    folder: str
    paths: list[str]
    firsts: list[int]
    tokens: int
    types: int
    texts: int

    def numbers(self, digest: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes; UNKNOWN where there is none."""
        out = np.full(len(digest), UNKNOWN, np.int64)
        order = np.argsort(digest[:, 0], kind="stable")
        hashes, checks = digest[order, 0], (digest[order, 1] >> U(32)).astype(np.uint32)
        cuts = np.searchsorted(_shard(hashes, len(self.paths)), np.arange(len(self.paths) + 1))
        for s, path in enumerate(self.paths):
            a, b = cuts[s], cuts[s + 1]
            if a < b and path:
                head, arrays = _load(self.folder, path)
                level, check = _sequence(head["hashes"], arrays[:4]), arrays[6]
                x = hashes[a:b] - U(head["base"])
                at = np.where(hashes[a:b] < U(head["base"]), -1, level.find(x))
                # Words of one hash and other checks stand side by side.
                while len(other := np.flatnonzero((at >= 0) & (check[at] != checks[a:b]))):
                    at[other] += 1
                    at[other[at[other] >= level.n]] = -1
                    other = other[at[other] >= 0]
                    at[other[level.access(at[other]) != x[other]]] = -1
                out[order[a:b]] = np.where(at >= 0, at + self.firsts[s], UNKNOWN)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts by number; zero for unknown words."""
        out = _counts(self.folder, self.paths, self.firsts, numbers, 4)
        out[(numbers == START) | (numbers == END)] = self.texts
        return out

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))


def _counts(folder: str, paths: list[str], firsts: list[int], numbers: np.ndarray, at: int) -> np.ndarray:
    """Counts by number, coded in a level's arrays at and at + 1."""
    out = np.zeros(len(numbers), np.int64)
    mine = np.flatnonzero(numbers >= firsts[0]) if firsts else np.zeros(0, np.int64)
    shard = np.searchsorted(firsts, numbers[mine], side="right") - 1
    order = np.argsort(shard, kind="stable")
    mine, shard = mine[order], shard[order]
    for s, a, b in _runs(shard):
        _, arrays = _load(folder, paths[s])
        out[mine[a:b]] = arrays[at + 1][arrays[at][numbers[mine[a:b]] - firsts[s]]]
    return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
        yield from zip(values[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _shard(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash ranges of equal width."""
    return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.int64)


@dataclass
class Level:
    """The successors of the grams of the level before; files and first numbers by shard."""

    folder: str
    paths: list[str]
    firsts: list[int]
    #: Contexts that may occur more often are spread over the shards.
    hot: int
    #: If grams live beside their contexts: the first context of each shard. Spread grams have as many shards behind.
    homes: list[int] | None = None

    @property
    def dealt(self) -> tuple[int, int, bool]:
        return self.hot, len(self.paths) if self.homes is None else len(self.homes), self.homes is not None

    def find(self, g: Grams, above: Known, words: Known) -> tuple[Known, np.ndarray]:
        """The grams' numbers and codes, -1 where there is none, and counts unless the level has none."""
        number, code, count = np.full(len(g.word), -1, np.int64), np.full(len(g.word), -1, np.int64), None
        known = np.flatnonzero((above.number >= 0)[g.context] & (words.number >= 0)[g.word])
        for s, a, b in _runs(g.shard[known]):
            if not self.paths[s]:
                continue
            head, arrays = _load(self.folder, self.paths[s])
            held_contexts, pointers, successors = (_sequence(head[k], arrays[4 * i : 4 * i + 4]) for i, k in enumerate(("contexts", "pointers", "successors")))
            mine = known[a:b]
            context, word = above.number[g.context[mine]], words.number[g.word[mine]].astype(U)
            new = np.concatenate(([True], context[1:] != context[:-1]))
            own = np.cumsum(new) - 1
            if held_contexts.n:
                at, held = held_contexts._search(context[new].astype(U))
                if not held.all():
                    kept = held[own]
                    mine, word, own, at = mine[kept], word[kept], (np.cumsum(held) - 1)[own[kept]], at[held]
            else:  # every gram of the shard above has its range
                at = context[new] - self.homes[s]
            begin, end = (x.astype(np.int64) for x in pointers.pair(at))
            base = np.zeros(len(at), U)
            later = np.flatnonzero(begin > 0)
            base[later] = successors.access(begin[later] - 1)
            # Words are above 0, so what is found stands behind the range before; it may stand in a later one.
            found, there = successors._search(base[own] + word)
            good = np.flatnonzero(there & (found < end[own]))
            mine, found = mine[good], found[good]
            number[mine] = found + self.firsts[s]
            code[mine] = arrays[12][found]
            if len(arrays) > 13:
                count = np.zeros(len(number), np.int64) if count is None else count
                count[mine] = arrays[14][arrays[13][found]]
        return Known(number, np.arange(len(number)), count), code

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts by number; zero for none."""
        return _counts(self.folder, self.paths, self.firsts, numbers, 13)


@dataclass
class Known:
    """Numbers of some words or grams (-1 for unknown ones), ranks in which the known ones go by number, and counts;
    what deals their successors: hashes, the count of their rarest word, and their own shards."""

    number: np.ndarray
    rank: np.ndarray
    count: np.ndarray | None = None
    hash: np.ndarray | None = None
    most: np.ndarray | None = None
    shard: np.ndarray | None = None


@dataclass
class Trie:
    vocabulary: Vocabulary
    levels: list[Level] = field(default_factory=list)
    mu: float = MU
    mu_long: float = MU_LONG

    def weight(self, order: int) -> float:
        return self.mu if order == 2 else self.mu_long


# -- Counting -----------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Byte planes apart, as many as the greatest value needs, behind their number."""
    n = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([n]) + values.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _packed(shard: np.ndarray, upper: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Keys (upper, lower) and their counts, in order by shard and key, compressed; the upper parts go by gaps."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for s, a, b in _runs(shard):
        parts = (np.diff(upper[a:b].astype(U), prepend=U(0)), lower[a:b].astype(U), counts[a:b].astype(U))
        yield s, (b - a).to_bytes(8, "little") + squeeze.compress(b"".join(map(_planes, parts)))


def _opened(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    data, at, out = zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=24 * n + 3), 0, []
    for _ in range(3):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : data[at]] = np.frombuffer(data, np.uint8, n * data[at], at + 1).reshape(data[at], n).T
        out.append(wide.view(U).ravel())
        at += 1 + n * data[at]
    return [np.cumsum(out[0], dtype=U), out[1], out[2].astype(np.int64)]


def _summed(keyed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys (upper, lower) and counts, which are taken out of the list: the distinct keys in order and their counts;
    the order of all keys, and where in it a new one begins."""
    upper, lower, counts = keyed
    keyed.clear()
    wide = int(lower.max()) + 1
    # One number for both keys where they fit; it sorts many times as fast.
    order = np.argsort(upper * U(wide) + lower) if (int(upper.max()) + 1) * wide < 1 << 64 else np.lexsort((lower, upper))
    upper, lower, counts = upper[order], lower[order], counts[order]
    new = np.concatenate(([True], (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])))
    first = np.flatnonzero(new)
    return upper[first], lower[first], np.add.reduceat(counts, first), order, new


def _merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed([np.concatenate(x) for x in zip(*map(_opened, parts), strict=True)])[:3]


class Tokens:
    """The words of some documents by number into their distinct words, with the start and the end behind these."""

    def __init__(self, parts: list[Block]):
        words, per_doc = [], []
        for b in parts:
            start, end, doc = b.words()
            words.append(ranges(b.folded(), start, end))
            per_doc.append(np.bincount(doc, minlength=len(b)) if len(doc) else np.zeros(len(b), np.int64))
        self.per_doc = np.concatenate(per_doc)
        word, values = numbered(pa.concat_arrays(words))
        self.n, self.digest = len(values), digests(values)
        ends = np.cumsum(self.per_doc + 1) - 1
        self.begins = ends - self.per_doc
        self.current = np.full(len(word) + len(self.per_doc), self.n + 1, np.int64)
        inner = np.ones(len(self.current), bool)
        inner[ends] = False
        self.current[inner] = word

    def shifted(self, values: np.ndarray, first: int) -> np.ndarray:
        """For each token the value of the one before it; first where its text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.begins] = first
        return out


@dataclass
class Grams:
    """The distinct grams of one order among some tokens, by shard, context and word: so in the order of their numbers."""

    #: For each token its gram; -1 where its history is shorter.
    code: np.ndarray | None
    #: For each gram its context among the grams before, its last word among the words, and its shard.
    context: np.ndarray
    word: np.ndarray
    shard: np.ndarray


def grams(t: Tokens, before: np.ndarray, above: Known, words: Known, hot: int, shards: int, home: bool) -> Grams:
    """before: for each token its context, -1 for none. A gram's shard is dealt by its context (home: the context's own
    shard), or by the gram if the context may be hot (home: behind the others)."""
    has = np.flatnonzero(before >= 0)
    context, word = before[has], t.current[has]
    own = above.shard if home else _shard(above.hash, shards)
    spread = np.flatnonzero((above.most > hot)[context])
    dealt = _shard(_chained(above, words, context[spread], word[spread]), shards)
    if home:
        dealt, shards = dealt + shards, 2 * shards
    each = len(above.rank) * len(words.number)
    if shards * each < 1 << 62:
        key = ((own * len(above.rank) + above.rank) * len(words.number))[context] + words.rank[word]
        key[spread] += (dealt - own[context[spread]]) * each
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        shard = np.repeat(np.arange(shards), np.diff(np.searchsorted(key[new], np.arange(shards + 1) * each)))
    else:
        shard = own[context]
        shard[spread] = dealt
        order = np.lexsort((words.rank[word], above.rank[context], shard))
        new = np.ones(len(order), bool)
        new[1:] = (context[order[1:]] != context[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
        shard = shard[order[new]]
    code = np.full(len(before), -1, np.int64)
    code[has[order]] = np.cumsum(new) - 1
    first = order[new]
    return Grams(code, context[first], word[first], shard)


def _hashed(numbers: np.ndarray) -> np.ndarray:
    return mix(numbers.astype(U) ^ U(0x5851F42D4C957F2D))


def _chained(above: Known, words: Known, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of grams by those of their contexts and the numbers of their last words."""
    return mix(above.hash[context] ^ mix(words.number.astype(U))[word])


def _first(t: Tokens, vocabulary: Vocabulary) -> Known:
    """The words, the start and the end."""
    number = np.concatenate((vocabulary.numbers(t.digest), [START, END]))
    rank = np.empty(len(number), np.int64)
    rank[np.argsort(number)] = np.arange(len(number))
    count = vocabulary.counts(number)
    return Known(number, rank, count, _hashed(number), count)


def _dealing(found: Known, g: Grams, above: Known, words: Known, hot: int, home: bool) -> Known:
    """The grams as contexts of the next order, dealt by (hot, home); hashes where that order needs them."""
    found.most, found.shard = np.minimum(above.most[g.context], words.count[g.word]), g.shard
    if home:
        at = np.flatnonzero(found.most > hot)
        found.hash = np.zeros(len(g.word), U)
        found.hash[at] = _chained(above, words, g.context[at], g.word[at])
    else:
        found.hash = _hashed(found.number)
    return found


def descend(t: Tokens, model: Trie, dealt: list[tuple[int, int, bool]]) -> Iterator[tuple[Grams, Known, Known, np.ndarray | None]]:
    """For orders 2 and up, dealt by (hot, shards, home): the grams, their possible contexts, the words, and the grams'
    codes, none for an order that the trie does not have."""
    words = above = _first(t, model.vocabulary)
    before = t.shifted(t.current, t.n)
    for i, deal in enumerate(dealt):
        g = grams(t, before, above, words, *deal)
        found, codes = model.levels[i].find(g, above, words) if i < len(model.levels) else (None, None)
        yield g, above, words, codes
        if i + 1 < len(dealt):
            found.count = np.zeros(len(found.number), np.int64) if found.count is None else found.count
            above = _dealing(found, g, above, words, dealt[i + 1][0], dealt[i + 1][2])
            before = t.shifted(g.code, -1)


def _groups(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """The texts in groups of about equal bytes, so that none needs much more memory than the others."""
    found = list(blocks(column))
    ends = np.cumsum([len(block.data) for _, block in found])
    many = max(1, -(-int(ends[-1]) // TOGETHER)) if found else 1
    group = [int((end - len(block.data) / 2) * many / max(1, ends[-1])) for end, (_, block) in zip(ends, found, strict=True)]
    for _, a, b in _runs(np.array(group, np.int64)):
        yield found[a][0], Tokens([block for _, block in found[a:b]])


PARTS = "shard int, raw binary, texts long, tokens long"


def _rows(found: list[tuple[int, bytes]], texts: int = 0, tokens: int = 0) -> pa.RecordBatch:
    s, raw = [x[0] for x in found] or [0], [x[1] for x in found] or [None]
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(raw, pa.binary()), pa.array([texts, *[0] * (len(s) - 1)], pa.int64()), pa.array([tokens, *[0] * (len(s) - 1)], pa.int64())], ["shard", "raw", "texts", "tokens"])


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[bytes]], int, int]:
    parts: dict[int, list[bytes]] = {}
    texts = tokens = 0
    for batch in batches:
        for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if raw is not None:
                parts.setdefault(s, []).append(raw)
        texts += sum(batch.column(2).to_pylist())
        tokens += sum(batch.column(3).to_pylist())
    return parts, texts, tokens


BUILT = "shard int, path string, types long, texts long, tokens long"


def _built(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "path", "types", "texts", "tokens"])


def _coded(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as codes of their distinct values."""
    distinct, code = np.unique(counts, return_inverse=True)
    return [code.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32), distinct]


def _shards_built(texts: DataFrame, shards: int, count: Callable, build: Callable, kinds: int = 1) -> tuple[list[str], list[int], list]:
    """Paths and sizes by shard, and all rows of build, of which there are a few for each shard; one kind behind another."""
    rows = texts.select("text").mapInArrow(count, PARTS).repartition(shards, "shard").mapInArrow(build, BUILT).collect()
    paths, sizes = [""] * shards * kinds, [0] * shards * kinds
    for r in rows:
        if r.shard >= 0:
            paths[r.shard], sizes[r.shard] = r.path, r.types
    return paths, sizes, rows


def vocabulary(texts: DataFrame, folder: str, shards: int) -> Vocabulary:
    """Count the words of texts(text) and write the first level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in _groups(batch.column(0)):
                n = np.bincount(t.current, minlength=t.n + 2)[: t.n]
                order = np.lexsort((t.digest[:, 1], t.digest[:, 0]))
                hashes, checks = t.digest[order, 0], t.digest[order, 1] >> U(32)
                yield _rows(list(_packed(_shard(hashes, shards), hashes, checks, n[order])), len(t.per_doc), len(t.current))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_texts, n_tokens = _gather(batches)
        rows = [(-1, "", 0, n_texts, n_tokens)]
        for s in sorted(parts):
            hashes, checks, counts = _merged(parts.pop(s))
            base = int(hashes[0])
            ef = EliasFano.build(hashes - U(base))
            path = _save(folder, f"words-{s}", {"base": base, "hashes": (ef.n, ef.width)}, [*ef.arrays(), *_coded(counts), checks.astype(np.uint32)])
            rows.append((s, path, len(hashes), 0, 0))
        yield _built(rows)

    paths, types, rows = _shards_built(texts, shards, count, build)
    firsts = [FIRST + sum(types[:s]) for s in range(shards)]
    n_texts = sum(r.texts for r in rows)
    return Vocabulary(folder, paths, firsts, sum(r.tokens for r in rows), sum(types) + (n_texts > 0), n_texts)


def _level(folder: str, name: str, context: np.ndarray, word: np.ndarray, counts: np.ndarray, often: np.ndarray, mu: float, last: bool, homes: int = 0) -> str:
    """Write the grams (context, word), in order, with their counts and how often their contexts are there. With homes,
    the contexts are places among so many, each of which gets a range, and are not written."""
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    size = np.diff(np.append(first, len(context)))
    codes = np.clip(np.rint(-np.log10(counts / (often + mu)) * (CODES / FLOOR)), 0, CODES).astype(np.uint16)
    lasts = word[np.append(first[1:], len(word)) - 1]
    base = np.concatenate((np.zeros(1, U), np.cumsum(lasts, dtype=U)[:-1]))
    held = np.zeros(0, U) if homes else context[first]
    begins = np.searchsorted(context, np.arange(homes + 1, dtype=U)) if homes else np.append(first, len(word))
    levels = [EliasFano.build(held), EliasFano.build(begins), EliasFano.build(word + np.repeat(base, size))]
    head = {k: (e.n, e.width) for k, e in zip(("contexts", "pointers", "successors"), levels, strict=True)}
    return _save(folder, name, head, [*(a for e in levels for a in e.arrays()), codes, *([] if last else _coded(counts))])


def _hot(model: Trie, shards: int) -> int:
    return max(1, model.vocabulary.tokens // (8 * shards))


def deepened(texts: DataFrame, model: Trie, shards: int, last: bool = False) -> Trie:
    """Count the grams of texts(text) that are one word longer than the trie's longest and write their level."""
    order, folder, hot = len(model.levels) + 2, model.vocabulary.folder, _hot(model, shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in _groups(batch.column(0)):
                *_, (g, above, words, _) = descend(t, model, [*(v.dealt for v in model.levels), (hot, shards, False)])
                n = np.bincount(g.code[g.code >= 0], minlength=len(g.word))
                yield _rows(list(_packed(g.shard, above.number[g.context], words.number[g.word], n)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = _gather(batches)[0], []
        above = model.levels[-1] if model.levels else model.vocabulary
        for s in sorted(parts):
            context, word, counts = _merged(parts.pop(s))
            held, own = np.unique(context, return_inverse=True)
            often = above.counts(held.astype(np.int64))[own]
            rows.append((s, _level(folder, f"grams-{order}-{s}", context, word, counts, often, model.weight(order), last), len(word), 0, 0))
        if rows:
            yield _built(rows)

    paths, sizes, _ = _shards_built(texts, shards, count, build)
    firsts = [sum(sizes[:s]) for s in range(shards)]
    return Trie(model.vocabulary, [*model.levels, Level(folder, paths, firsts, hot)], model.mu, model.mu_long)


def deepened_twice(texts: DataFrame, model: Trie, shards: int, last: bool = False) -> Trie:
    """Count the grams of two and of three words of texts(text) at once and write both levels.

    Grams of three are carried beside those of two, by their contexts' places in the block, so nothing is looked up; those
    whose context may be hot are carried with its words, dealt by themselves, and get their contexts' numbers afterwards.
    """
    folder, hot, wide = model.vocabulary.folder, _hot(model, shards), FIRST + model.vocabulary.types

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in _groups(batch.column(0)):
                words = _first(t, model.vocabulary)
                two = grams(t, t.shifted(t.current, t.n), words, words, hot, shards, False)
                pairs = words.number[two.context], words.number[two.word]
                n, before = np.bincount(two.code, minlength=len(two.word)), t.shifted(two.code, -1)
                two.code = None
                above = _dealing(Known(pairs[0], np.arange(len(two.word))), two, words, words, hot, True)
                three = grams(t, before, above, words, hot, shards, True)
                m = np.bincount(three.code[three.code >= 0], minlength=len(three.word))
                three.code = before = above = None
                begin, cut = np.searchsorted(two.shard, np.arange(shards)), int(np.searchsorted(three.shard, shards))
                home, away, last_word = three.context[:cut], three.context[cut:], words.number[three.word]
                found: dict[int, list[bytes]] = {}
                for kind, some in enumerate((
                    _packed(two.shard, *pairs, n),
                    _packed(three.shard[:cut], home - begin[three.shard[:cut]], last_word[:cut], m[:cut]),
                    _packed(*_ordered(three.shard[cut:] - shards, pairs[0][away] * wide + pairs[1][away], last_word[cut:], m[cut:])),
                )):
                    for s, raw in some:
                        found.setdefault(s, [b"", b"", b""])[kind] = raw
                yield _rows([(s, b"".join(len(x).to_bytes(8, "little") + x for x in raws)) for s, raws in found.items()])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = _gather(batches)[0], []
        for s in sorted(parts):
            twos, threes, away = zip(*map(_split, parts.pop(s)), strict=True)
            if any(twos):
                opened = [_opened(x) for x in twos if x]
                ends = np.cumsum([len(x[0]) for x in opened])
                keyed = [np.concatenate(x) for x in zip(*opened, strict=True)]
                del opened
                context, word, counts, order, new = _summed(keyed)
                held, own = np.unique(context, return_inverse=True)
                often = model.vocabulary.counts(held.astype(np.int64))[own]
                rows.append((s, _level(folder, f"grams-2-{s}", context, word, counts, often, model.weight(2), False), len(word), 0, 0))
                place = np.empty(len(order), U)
                place[order] = np.cumsum(new) - 1
                del order, new, context, word, held, own, often
                inner = [(place[end - size : end], _opened(x)) for end, size, x in zip(ends, np.diff(ends, prepend=0), (y for x, y in zip(twos, threes, strict=True) if x), strict=True) if x]
                if inner:
                    homes = len(counts)
                    keyed = [np.concatenate([at[x[0].view(np.int64)] for at, x in inner]), *(np.concatenate([x[i] for _, x in inner]) for i in (1, 2))]
                    del inner, place
                    context, word, n = _summed(keyed)[:3]
                    rows.append((shards + s, _level(folder, f"grams-3-{s}", context, word, n, counts[context.astype(np.int64)], model.weight(3), last, homes), len(word), 0, 0))
            if any(away):
                rows.append((2 * shards + s, _save(folder, f"away-{s}", {}, list(_merged([x for x in away if x]))), 0, 0, 0))
        if rows:
            yield _built(rows)

    paths, sizes, _ = _shards_built(texts, shards, count, build, 3)
    level = Level(folder, paths[:shards], [sum(sizes[:s]) for s in range(shards)], hot)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, word, counts = _load(folder, path)[1]
                held, own = np.unique(key, return_inverse=True)
                # Their first words are hot as well, so the pairs are spread.
                ends = [Known(x.astype(np.int64), np.arange(len(x)), hash=_hashed(x)) for x in (held // U(wide), held % U(wide))]
                at = np.arange(len(held))
                shard = _shard(_chained(*ends, at, at), shards)
                at = np.argsort(shard, kind="stable")
                found, _ = level.find(Grams(at, at, at, shard[at]), *ends)
                number, often = np.empty(len(held), np.int64), np.empty(len(held), np.int64)
                number[at], often[at] = found.number, found.count
                if len(number) and number.min() < 0:
                    raise RuntimeError("a context that was counted is not in its level")
                order = np.lexsort((word, number[own]))
                yield _built([(s, _level(folder, f"grams-3-{shards + s}", number[own][order].astype(U), word[order], counts[order], often[own][order], model.weight(3), last), len(word), 0, 0)])

    spread, more, away = [""] * shards, [0] * shards, [(s, x) for s, x in enumerate(paths[2 * shards :]) if x]
    if away:
        for r in texts.sparkSession.createDataFrame(away, "shard int, path string").repartition(shards, "shard").mapInArrow(named, BUILT).collect():
            spread[r.shard], more[r.shard] = r.path, r.types
        for _, path in away:
            _store(folder)[0].delete_file(path)
    sizes = sizes[shards : 2 * shards] + more
    deeper = Level(folder, paths[shards : 2 * shards] + spread, [sum(sizes[:s]) for s in range(2 * shards)], hot, level.firsts)
    return Trie(model.vocabulary, [level, deeper], model.mu, model.mu_long)


def _ordered(shard: np.ndarray, upper: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lower, upper, shard))
    return shard[order], upper[order], lower[order], counts[order]


def _split(raw: bytes) -> list[bytes]:
    """The parts, each behind its length."""
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


# -- Scoring ------------------------------------------------------------------------------------------------------


#: The shares that codes stand for; the last is that of -1, of grams that aren't there.
_SHARES = np.append(10.0 ** (np.arange(CODES + 1) * (-FLOOR / CODES)), 0.0)
SCORES = (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))


def score_column(model: Trie, column: pa.Array) -> list[pa.Array]:
    """n_tokens, n_known, base_score and score of each text."""
    out = [[], [], [], []]
    for _, t in _groups(column):
        p = None
        for order, (g, above, words, codes) in enumerate(descend(t, model, [v.dealt for v in model.levels]), 2):
            if p is None:
                counts = words.count
                unigram = model.vocabulary.log_unigram(counts)
                p = (10.0**unigram)[t.current]
            mu = model.weight(order)
            share = _SHARES[codes]
            rest = mu / (above.count[g.context] + mu)
            if len(share):
                short = np.flatnonzero(g.code < 0)
                shorter = p[short]
                p = share[g.code] + rest[g.code] * p
                p[short] = shorter
        out[0].append(t.per_doc + 1)
        out[1].append(np.add.reduceat((counts > 0)[t.current].astype(np.int64), t.begins))
        out[2].append(np.add.reduceat(unigram[t.current], t.begins))
        out[3].append(np.add.reduceat(np.log10(np.minimum(p, 1.0)), t.begins))
    return [pa.array(np.concatenate(x) if x else [], kind) for x, (_, kind) in zip(out, SCORES, strict=True)]


def score(docs: DataFrame, model: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Null and wordless texts have the end token alone. If nothing was learnt from, every token is unknown. Repeated
    rows each get a row; other columns are not read; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *score_column(model, batch.column(1))], ["doc_id", *(n for n, _ in SCORES)])

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def learn(texts: DataFrame, shards: int | None = None, order: int = ORDER) -> Trie:
    """The trie of texts(text), of grams up to the order (2 at least). Null texts are empty; no texts give an empty trie."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    folder = scratch_path(spark, "lm")
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
    model = Trie(vocabulary(texts, folder, shards or max(tasks(spark), min(size // SHARD_BYTES, 1 << 16))))
    shards = shards or max(tasks(spark), model.vocabulary.tokens // SHARD_TOKENS)
    if order > 2:
        model = deepened_twice(texts, model, shards, order == 3)
    for k in range(len(model.levels) + 2, order + 1):
        model = deepened(texts, model, shards, k == order)
    return model


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = id_crc(F.col("doc_id")) % 7
    found = score(docs, learn(docs.where(rest != HELD_OUT)))
    return found.select("doc_id", (rest == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_lm_score: all but the model's score, by the same operator."""
    return op6_lm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"

OP6_BASE_SQL = rf"""
WITH d AS (SELECT doc_id, xor({_CRC}, 4294967295::BIGINT) % 7 = 2 AS held_out,
             list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score
FROM t LEFT JOIN c USING (w), s GROUP BY doc_id
"""
