"""Integer codecs: arrays of integers to bytes and back, and their sizes as expressions.

Storage is Parquet's work; these serve interchange and measurement. Values are 0 to 2^32 - 1 unless a codec says
otherwise. Each takes the count from outside, as an index does.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# -- Sizes as expressions -----------------------------------------------------------------------------------------


def bit_width(x: Column) -> Column:
    return F.length(F.bin(x))


def vbyte_bytes(x: Column) -> Column:
    return F.floor((bit_width(x) + 6) / 7)


def gamma_bits(x: Column) -> Column:
    """x from 1."""
    return 2 * bit_width(x) - 1


def delta_bits(x: Column) -> Column:
    """x from 1."""
    w = bit_width(x)
    return w - 1 + 2 * bit_width(w) - 1


# -- Gaps ---------------------------------------------------------------------------------------------------------


def gaps(values: np.ndarray, n: int = 1) -> np.ndarray:
    """Differences to the n-th value before; the first n stay."""
    out = np.asarray(values, np.int64).copy()
    out[n:] -= np.asarray(values, np.int64)[:-n]
    return out


def ungaps(values: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.asarray(values, np.int64).copy()
    for i in range(min(n, len(out))):
        out[i::n] = np.cumsum(out[i::n])
    return out


# -- Bits ---------------------------------------------------------------------------------------------------------


def _widths(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _bits(v: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The values' low bits one after another, lowest bit first."""
    at = np.repeat(np.cumsum(widths) - widths, widths)
    return ((np.repeat(v, widths) >> (np.arange(len(at)) - at)) & 1).astype(np.uint8)


def _bytes(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def _unbits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


# -- Byte codecs --------------------------------------------------------------------------------------------------


def none_encode(v: np.ndarray) -> bytes:
    return v.astype("<u4").tobytes()


def none_decode(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4", n).astype(np.int64)


def vbyte_encode(v: np.ndarray) -> bytes:
    """Seven bits a byte, low first; the high bit ends a value."""
    size = np.maximum(1, (_widths(v) + 6) // 7)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = (np.repeat(v, size) >> (7 * at)) & 127
    out[np.cumsum(size) - 1] |= 128
    return out.astype(np.uint8).tobytes()


def vbyte_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b & 128)[:n]
    starts = np.concatenate(([0], ends[:-1] + 1))
    b = b[: ends[-1] + 1]
    at = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127) << (7 * at), starts)


def stream_vbyte_encode(v: np.ndarray) -> bytes:
    """Two-bit lengths of four values a byte, then the values' bytes."""
    size = np.maximum(1, (_widths(v) + 7) // 8)
    control = np.zeros(-(-len(v) // 4) * 4, np.int64)
    control[: len(v)] = size - 1
    keys = (control.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return keys.tobytes() + ((np.repeat(v, size) >> (8 * at)) & 255).astype(np.uint8).tobytes()


def stream_vbyte_decode(data: bytes, n: int) -> np.ndarray:
    k = -(-n // 4)
    size = ((np.frombuffer(data, np.uint8, k)[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[:n].astype(np.int64) + 1
    if not n:
        return np.zeros(0, np.int64)
    starts = np.cumsum(size) - size
    b = np.frombuffer(data, np.uint8, int(size.sum()), k).astype(np.int64)
    return np.add.reduceat(b << (8 * (np.arange(len(b)) - np.repeat(starts, size))), starts)


def nybble_encode(v: np.ndarray) -> bytes:
    """Three bits a nybble, low first; the nybble's high bit ends a value."""
    size = np.maximum(1, (_widths(v) + 2) // 3)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = (np.repeat(v, size) >> (3 * at)) & 7
    out[np.cumsum(size) - 1] |= 8
    return _bytes(_bits(out, np.full(len(out), 4)))


def nybble_decode(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    out = np.stack((b & 15, b >> 4), axis=1).ravel().astype(np.int64)
    ends = np.flatnonzero(out & 8)[:n]
    if not n:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = out[: ends[-1] + 1]
    return np.add.reduceat((out & 7) << (3 * (np.arange(len(out)) - np.repeat(starts, ends - starts + 1))), starts)


# -- Elias codes, of value + 1 so that zero has one ---------------------------------------------------------------


def gamma_encode(v: np.ndarray) -> bytes:
    """Width in unary, then the bits below the highest."""
    v = v + 1
    w = _widths(v)
    both = np.stack((np.left_shift(1, w - 1), v & (np.left_shift(1, w - 1) - 1)), axis=1).ravel()
    return _bytes(_bits(both, np.stack((w, w - 1), axis=1).ravel()))


def gamma_decode(data: bytes, n: int) -> np.ndarray:
    bits, at, out = _unbits(data), 0, []
    ones = np.flatnonzero(bits)
    for _ in range(n):
        w = int(ones[np.searchsorted(ones, at)]) - at + 1
        out.append((1 << (w - 1)) + _number(bits[at + w : at + 2 * w - 1]) - 1)
        at += 2 * w - 1
    return np.array(out, np.int64)


def delta_encode(v: np.ndarray) -> bytes:
    """Width in gamma, then the bits below the highest."""
    v = v + 1
    w = _widths(v)
    ww = _widths(w)
    both = np.stack((np.left_shift(1, ww - 1), w & (np.left_shift(1, ww - 1) - 1), v & (np.left_shift(1, w - 1) - 1)), axis=1).ravel()
    return _bytes(_bits(both, np.stack((ww, ww - 1, w - 1), axis=1).ravel()))


def delta_decode(data: bytes, n: int) -> np.ndarray:
    bits, at, out = _unbits(data), 0, []
    ones = np.flatnonzero(bits)
    for _ in range(n):
        ww = int(ones[np.searchsorted(ones, at)]) - at + 1
        w = (1 << (ww - 1)) + _number(bits[at + ww : at + 2 * ww - 1])
        at += 2 * ww - 1
        out.append((1 << (w - 1)) + _number(bits[at : at + w - 1]) - 1)
        at += w - 1
    return np.array(out, np.int64)


# -- Word-aligned codecs: a selector says how many values of which widths a word holds ---------------------------


@dataclass(frozen=True)
class Words:
    """Selectors of a word of ``size`` bits; each is a tuple of field widths that fit behind the selector's bits."""

    size: int
    head: int
    selectors: tuple[tuple[int, ...], ...]
    optimal: bool = False

    def _fits(self, widths: list[int], at: int, s: tuple[int, ...]) -> bool:
        part = widths[at : at + len(s)]
        return all(a <= b for a, b in zip(part, s, strict=False)) and (len(part) == len(s) or at + len(part) == len(widths))

    def _choose(self, widths: list[int]) -> list[int]:
        """Greedily the most values each time, or the fewest words over the whole list."""
        n, out, at = len(widths), [], 0
        if self.optimal:
            best, take = [0] * (n + 1), [0] * n
            for i in range(n - 1, -1, -1):
                best[i], take[i] = min((best[min(n, i + len(s))] + 1, k) for k, s in enumerate(self.selectors) if self._fits(widths, i, s))
        while at < n:
            k = take[at] if self.optimal else next((k for k, s in enumerate(self.selectors) if self._fits(widths, at, s)), -1)
            if k < 0:
                raise ValueError("a value is too wide for the codec")
            out.append(k)
            at += len(self.selectors[k])
        return out

    def encode(self, v: np.ndarray) -> bytes:
        out, at, values = bytearray(), 0, v.tolist()
        for k in self._choose([x.bit_length() for x in values]):
            word, shift = k, self.head
            for width, x in zip(self.selectors[k], values[at : at + len(self.selectors[k])], strict=False):
                word |= x << shift
                shift += width
            out += word.to_bytes(self.size // 8, "little")
            at += len(self.selectors[k])
        return bytes(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out, step = [], self.size // 8
        for at in range(0, len(data), step):
            word = int.from_bytes(data[at : at + step], "little")
            fields = self.selectors[word & ((1 << self.head) - 1)]
            word >>= self.head
            for width in fields:
                out.append(word & ((1 << width) - 1))
                word >>= width
        return np.array(out[:n], np.int64)


@dataclass(frozen=True)
class Relative:
    """Words whose selector is two bits, relative to the word before: a row narrower, the same, a row wider, or the widest.

    Each row is a width of fields; a word holds as many of them as fit. With ``carry``, a word that leaves two bits or
    more unused has the next word's selector there, and the next word is fields alone; the relative and carried
    selectors follow V. N. Anh and A. Moffat, Inverted Index Compression Using Word-Aligned Binary Codes, 2005.
    """

    size: int
    widths: tuple[int, ...]
    carry: bool = False

    def _rows(self, row: int) -> tuple[int, ...]:
        """What the four selectors mean behind a row; at either end the window moves inwards."""
        last = len(self.widths) - 1
        low = min(max(row - 1, 0), max(last - 3, 0))
        return tuple(min(low + i, last) for i in range(3)) + (last,)

    def encode(self, v: np.ndarray) -> bytes:
        values, at, out = v.tolist(), 0, bytearray()
        need = [x.bit_length() for x in values]
        if need and max(need) > self.widths[-1]:
            raise ValueError("a value is too wide for the codec")
        row, held, room = 0, None, 0  # the last word not written yet, and where its unused bits begin
        while at < len(values):
            payload = self.size if held is not None else self.size - 2
            for selector, r in enumerate(self._rows(row)):
                count = payload // self.widths[r]
                if all(n <= self.widths[r] for n in need[at : at + count]):
                    break
            shift = 0
            if held is not None:
                out += (held | selector << room).to_bytes(self.size // 8, "little")
                word = 0
            else:
                word, shift = selector, 2
            for x in values[at : at + count]:
                word |= x << shift
                shift += self.widths[r]
            at, row = at + count, r
            room = (0 if held is not None else 2) + count * self.widths[r]
            if self.carry and self.size - room >= 2:
                held = word
            else:
                out += word.to_bytes(self.size // 8, "little")
                held = None
        return bytes(out + held.to_bytes(self.size // 8, "little")) if held is not None else bytes(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out: list[int] = []
        row, selector, step = 0, None, self.size // 8
        for at in range(0, len(data), step):
            if len(out) >= n:
                break
            word, begin = int.from_bytes(data[at : at + step], "little"), 0
            if selector is None:
                selector, begin = word & 3, 2
            row = self._rows(row)[selector]
            width = self.widths[row]
            count = (self.size - begin) // width
            out += [word >> (begin + i * width) & ((1 << width) - 1) for i in range(count)]
            room = begin + count * width
            selector = word >> room & 3 if self.carry and self.size - room >= 2 else None
        return np.array(out[:n], np.int64)


def lyck_encode(v: np.ndarray) -> bytes:
    """A selector byte and a 16-bit word of eight pairs of bits, or fours, or eights, or one value, the first highest."""
    out, at, values = bytearray(), 0, v.tolist()
    while at < len(values):
        selector = next(s for s in range(4) if all(x < 1 << (2 << s) for x in values[at : at + (8 >> s)]))
        width, word = 2 << selector, 0
        for i, x in enumerate(values[at : at + (8 >> selector)]):
            word |= x << (16 - width * (i + 1))
        out += bytes([selector]) + word.to_bytes(2, "little")
        at += 8 >> selector
    return bytes(out)


def lyck_decode(data: bytes, n: int) -> np.ndarray:
    out: list[int] = []
    for at in range(0, len(data), 3):
        width, word = 2 << data[at], int.from_bytes(data[at + 1 : at + 3], "little")
        out += [word >> (16 - width * (i + 1)) & ((1 << width) - 1) for i in range(16 // width)]
    return np.array(out[:n], np.int64)


def _bitwise(delta: bool) -> tuple[Callable, Callable]:
    """Elias codes bit by bit, the highest first: zeros, then the number from its highest bit; for delta its width so."""

    def gamma(x: int) -> str:
        return "0" * (x.bit_length() - 1) + format(x, "b")

    def encode(v: np.ndarray) -> bytes:
        said = "".join(gamma(x.bit_length()) + format(x, "b")[1:] if delta else gamma(x) for x in (v + 1).tolist())
        return np.packbits(np.frombuffer(said.encode(), np.uint8) - 48).tobytes()

    def decode(data: bytes, n: int) -> np.ndarray:
        said = "".join(format(b, "08b") for b in data)
        at, out = 0, []
        for _ in range(n):
            one = said.index("1", at)
            x, at = int(said[one : 2 * one - at + 1], 2), 2 * one - at + 1
            if delta:
                x, at = int("1" + said[at : at + x - 1], 2), at + x - 1
            out.append(x - 1)
        return np.array(out, np.int64)

    return encode, decode


#: Selectors of the published word-aligned codecs, as (count x width) in order.
_SIMPLE_9 = tuple((w,) * n for n, w in ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28)))
_SIMPLE_16 = (
    (1,) * 28, (2,) * 7 + (1,) * 14, (1,) * 7 + (2,) * 7 + (1,) * 7, (1,) * 14 + (2,) * 7, (2,) * 14, (4,) + (3,) * 8, (3,) + (4,) * 4 + (3,) * 3, (4,) * 7,
    (5,) * 4 + (4,) * 2, (4,) * 2 + (5,) * 4, (6,) * 3 + (5,) * 2, (5,) * 2 + (6,) * 3, (7,) * 4, (10,) + (9,) * 2, (14,) * 2, (28,),
)
_SIMPLE_8B = ((0,) * 240, (0,) * 120, *((w,) * (60 // w) for w in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)))
#: Field widths of the rows of the relative and carried codecs, for 30 and 32 bits, and for 62 and 64.
_RELATIVE_10 = (1, 2, 3, 4, 5, 6, 7, 10, 15, 30)
_CARRYOVER_12 = (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 16, 28)
_CARRY_8B = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20, 31, 62)


def _escaping(codec: tuple[Callable, Callable], width: int) -> tuple[Callable, Callable]:
    """A codec of narrow words over the values' low bits, with wide values' upper bits behind it in variable bytes."""
    mask = (1 << width) - 1

    def encode(v: np.ndarray) -> bytes:
        wide = np.flatnonzero(v > mask)
        low = codec[0](v & mask)
        tail = vbyte_encode(np.stack((np.diff(wide, prepend=0), v[wide] >> width), axis=1).ravel()) if len(wide) else b""
        return len(low).to_bytes(4, "little") + len(wide).to_bytes(4, "little") + low + tail

    def decode(data: bytes, n: int) -> np.ndarray:
        size, wide = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        out = codec[1](data[8 : 8 + size], n)
        if wide:
            pairs = vbyte_decode(data[8 + size :], 2 * wide).reshape(-1, 2)
            out[np.cumsum(pairs[:, 0])] |= pairs[:, 1] << width
        return out

    return encode, decode


# -- Frames: groups of values of one width ------------------------------------------------------------------------


def frames(group: int, by: int = 1) -> tuple[Callable, Callable]:
    """Bit-packed frames of ``group`` values at their greatest width, rounded up to a multiple of ``by``."""

    def encode(v: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(v), group):
            part = v[a : a + group]
            width = -(-int(_widths(part).max()) // by) * by
            out.append(bytes([width]) + _bytes(_bits(part, np.full(len(part), width))))
        return b"".join(out)

    def decode(data: bytes, n: int) -> np.ndarray:
        out, at = [], 0
        for a in range(0, n, group):
            count, width = min(group, n - a), data[at]
            size = -(-count * width // 8)
            bits = _unbits(data[at + 1 : at + 1 + size])[: count * width].reshape(count, width).astype(np.int64)
            out.append((bits << np.arange(width)).sum(axis=1))
            at += 1 + size
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    return encode, decode


#: Bits of a quantity and how many of them a block has; those of four widths take two 128-bit words.
_QMX = ((0, 256), (1, 128), (2, 64), (3, 40), (4, 32), (5, 24), (6, 20), (7, 36), (8, 16), (9, 28), (10, 12), (12, 20), (16, 8), (21, 12), (32, 4))
_TWO_WORDS = (7, 9, 12, 21)


def qmx(length: bool) -> tuple[Callable, Callable]:
    """Blocks of 128 or 256 bits first, then selectors (width above, run length less one below), read from the back in the
    order of the blocks. The published form ends with the selectors' place in variable bytes; the improved one leaves
    it out, as selectors read from the back need none.
    """

    def encode(v: np.ndarray) -> bytes:
        blocks, selectors, at, widths = [], [], 0, _widths(v)
        while at < len(v):
            for k, (width, count) in enumerate(_QMX):
                if widths[at : at + count].max() <= width:
                    break
            part = v[at : at + count]
            blocks.append(_bytes(_bits(part, np.full(len(part), width))).ljust(32 if width in _TWO_WORDS else 16, b"\0") if width else b"")
            if selectors and selectors[-1] >> 4 == k and selectors[-1] & 15 < 15:
                selectors[-1] += 1
            else:
                selectors.append(k << 4)
            at += count
        data = b"".join(blocks)
        if not length:
            return data + bytes(reversed(selectors))
        return data + bytes(selectors) + vbyte_encode(np.array([len(data)]))[::-1]

    def decode(data: bytes, n: int) -> np.ndarray:
        if length and n:
            place, at, shift = 0, len(data) - 1, 0
            while True:  # the lowest byte is the last, the highest is marked
                place |= (data[at] & 127) << shift
                if data[at] & 128:
                    break
                at, shift = at - 1, shift + 7
            selectors = data[place:at]
        else:
            selectors = data[::-1]
        out, at, done = [], 0, 0
        for s in selectors:
            width, count = _QMX[s >> 4]
            size = 0 if not width else 32 if width in _TWO_WORDS else 16
            for _ in range((s & 15) + 1):
                m = min(count, n - done)
                out.append((_unbits(data[at : at + size])[: m * width].reshape(m, width).astype(np.int64) << np.arange(width)).sum(axis=1) if width else np.zeros(m, np.int64))
                at, done = at + size, done + m
            if done >= n:
                break
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    return encode, decode


def over_gaps(codec: tuple[Callable, Callable], n: int) -> tuple[Callable, Callable]:
    """A codec over differences to the n-th value before, for rising values."""
    return lambda v: codec[0](gaps(v, n)), lambda data, count: ungaps(codec[1](data, count), n)


def grouped_elias(of_width: tuple[Callable, Callable], group: int = 4) -> tuple[Callable, Callable]:
    """Groups share one width, itself coded by ``of_width``; then all values' bits."""

    def encode(v: np.ndarray) -> bytes:
        full = np.concatenate((v, np.zeros(-len(v) % group, np.int64))).reshape(-1, group)
        width = _widths(full.max(axis=1)) if len(v) else np.zeros(0, np.int64)
        head = of_width[0](width)
        return len(head).to_bytes(4, "little") + head + _bytes(_bits(full.ravel(), np.repeat(width, group)))

    def decode(data: bytes, n: int) -> np.ndarray:
        size, k = int.from_bytes(data[:4], "little"), -(-n // group)
        width = np.repeat(of_width[1](data[4 : 4 + size], k), group)
        bits = _unbits(data[4 + size :])[: width.sum()].astype(np.int64)
        starts = np.cumsum(width) - width
        sums = np.concatenate(([0], np.cumsum(bits << (np.arange(len(bits)) - np.repeat(starts, width)))))
        return (sums[starts + width] - sums[starts])[:n]

    return encode, decode


def _pair(w: Words | Relative) -> tuple[Callable, Callable]:
    return w.encode, w.decode


_GAMMA, _DELTA = (gamma_encode, gamma_decode), (delta_encode, delta_decode)

#: Codecs by name: (encode, decode).
CODECS: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes, int], np.ndarray]]] = {
    "none": (none_encode, none_decode),
    "variable_byte": (vbyte_encode, vbyte_decode),
    "stream_vbyte": (stream_vbyte_encode, stream_vbyte_decode),
    "nybble_8": (nybble_encode, nybble_decode),
    "lyck_16": _escaping((lyck_encode, lyck_decode), 16),
    "elias_gamma": _GAMMA,
    "elias_delta": _DELTA,
    "elias_gamma_bitwise": _bitwise(False),
    "elias_delta_bitwise": _bitwise(True),
    "group_elias_gamma": grouped_elias(_GAMMA),
    "group_elias_gamma_vb": grouped_elias((vbyte_encode, vbyte_decode)),
    "group_elias_delta": grouped_elias(_DELTA),
    "simple_9": _escaping(_pair(Words(32, 4, _SIMPLE_9)), 28),
    "simple_9_packed": _escaping(_pair(Words(32, 4, _SIMPLE_9, True)), 28),
    "simple_16": _escaping(_pair(Words(32, 4, _SIMPLE_16)), 28),
    "simple_16_packed": _escaping(_pair(Words(32, 4, _SIMPLE_16, True)), 28),
    "simple_8b": _pair(Words(64, 4, _SIMPLE_8B)),
    "simple_8b_packed": _pair(Words(64, 4, _SIMPLE_8B, True)),
    "relative_10": _escaping(_pair(Relative(32, _RELATIVE_10)), 30),
    "carryover_12": _escaping(_pair(Relative(32, _CARRYOVER_12, True)), 28),
    "carry_8b": _pair(Relative(64, _CARRY_8B, True)),
    "bitpack_32": frames(32),
    "bitpack_64": frames(64),
    "bitpack_128": frames(128),
    "bitpack_256": frames(256),
    "qmx": qmx(True),
    "qmx_improved": qmx(False),
    "zlib": (lambda v: zlib.compress(none_encode(v)), lambda d, n: none_decode(zlib.decompress(d), n)),
    "zstd": (lambda v: zstandard.ZstdCompressor(level=3).compress(none_encode(v)), lambda d, n: none_decode(zstandard.ZstdDecompressor().decompress(d, max_output_size=4 * n + 1), n)),
}

#: Codecs of rising values, over their gaps to the value before or, in fours, to the one above.
RISING = {"variable_byte_d1": over_gaps(CODECS["variable_byte"], 1), "simple_8b_d1": over_gaps(CODECS["simple_8b"], 1), "qmx_d1": over_gaps(CODECS["qmx"], 1), "qmx_d4": over_gaps(CODECS["qmx_improved"], 4)}


def encode(name: str, values: Column) -> Column:
    """Bytes of an array column."""
    f = (CODECS | RISING)[name][0]

    @pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else f(np.asarray(x, np.int64)))

    return run(values)


def decode(name: str, data: Column, count: Column) -> Column:
    f = (CODECS | RISING)[name][1]

    @pandas_udf("array<long>")
    def run(raw: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else f(bytes(r), int(k)) for r, k in zip(raw, n, strict=True)])

    return run(data, count)


def roundtrips(lists: DataFrame, column: str) -> DataFrame:
    """(codec, lists, bytes, failures) over all lists; every codec in one pass over batches of lists, equal lists coded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from impactspark.functions.codec_batches import tallies

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1)
            counts = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for name, *found in tallies(values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, batch.column(0).to_numpy()):
                totals[name] = totals.get(name, 0) + np.array(found, np.int64)
        if totals:
            sums = np.stack(list(totals.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), *(pa.array(x) for x in sums)], ["codec", "lists", "bytes", "failures"])

    # Coding costs far more than the lists' bytes tell, so tasks are kept from being merged by size.
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = lists.select(column).repartition(n, column).groupBy(column).agg(F.count(F.lit(1)).alias("times"))
    rows = distinct.select("times", column).mapInArrow(run, "codec string, lists long, bytes long, failures long")
    return rows.groupBy("codec").agg(*(F.sum(c).alias(c) for c in ("lists", "bytes", "failures")))
