"""The codecs over many lists at once: the bytes that codecs.py gives list by list, from a few array operations a batch.

A batch is all lists' values one after another and how many each list has, one at least; encoded, it is all lists'
bytes one after another and their sizes. Only steps that depend on the step before them are loops: one a word, a group
or a value.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import zstandard

from impactspark.functions import codecs as one
from impactspark.functions.codecs import _QMX, _TWO_WORDS, Relative, Words, _widths

Coded = tuple[np.ndarray, np.ndarray]
Batch = tuple[Callable[[np.ndarray, np.ndarray], Coded], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... in each list."""
    return np.arange(int(n.sum())) - np.repeat(_before(n), n)


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, _before(n))


def _slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts, sizes) + _within(sizes)]


def _joined(*parts: Coded) -> Coded:
    """Each list's parts behind one another."""
    sizes = sum(s for _, s in parts)
    out, at = np.empty(int(sizes.sum()), np.uint8), _before(sizes)
    for data, s in parts:
        out[np.repeat(at, s) + _within(s)] = data
        at = at + s
    return out, sizes


def _numbers(x: np.ndarray) -> Coded:
    return x.astype("<u4").view(np.uint8), np.full(len(x), 4)


def _number_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _slices(data, at, np.full(len(at), 4)).view("<u4").astype(np.int64)


# -- Fields of bits -----------------------------------------------------------------------------------------------


def _put(at: np.ndarray, width: np.ndarray, v: np.ndarray, size: int, high: bool = False) -> np.ndarray:
    """Bytes with the values at their rising bit places, lowest bit first or highest."""
    words, v = np.zeros(size // 8 + 2, np.uint64), v.astype(np.uint64)
    i, off = at >> 6, at & 63
    over = np.flatnonzero(off + width > 64)
    if high:
        shift = 64 - off - width
        near = v << np.maximum(shift, 0).astype(np.uint64)
        near[over] = v[over] >> (-shift[over]).astype(np.uint64)
        far = v[over] << (64 + shift[over]).astype(np.uint64)
    else:
        near = v << off.astype(np.uint64)
        far = v[over] >> (64 - off[over]).astype(np.uint64)
    firsts = np.flatnonzero(np.diff(i, prepend=-1))
    words[i[firsts]] = np.bitwise_or.reduceat(near, firsts)
    words[i[over] + 1] |= far
    return (words.astype(">u8") if high else words).view(np.uint8)[:size]


def _get(data: np.ndarray, at: np.ndarray, width: np.ndarray, high: bool = False) -> np.ndarray:
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view(">u8" if high else "<u8").astype(np.uint64)
    i, off = np.minimum(at >> 6, len(words) - 2), at & 63
    over = np.flatnonzero(off + width > 64)
    if high:
        shift = 64 - off - width
        out = words[i] >> np.clip(shift, 0, 63).astype(np.uint64)
        out[over] = words[i[over]] << (-shift[over]).astype(np.uint64) | words[i[over] + 1] >> (64 + shift[over]).astype(np.uint64)
    else:
        out = words[i] >> off.astype(np.uint64)
        out[over] |= words[i[over] + 1] << (64 - off[over]).astype(np.uint64)
    return (out & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _walked(after: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each list's values begin, if behind the place p the next value is at after[p]."""
    after, out = memoryview(np.ascontiguousarray(after, np.int32)), []
    add = out.append
    for p, k in zip(starts.tolist(), n.tolist(), strict=True):
        add(p)
        for _ in range(k - 1):
            p = after[p]
            add(p)
    return np.array(out, np.int64)


# -- Byte codecs --------------------------------------------------------------------------------------------------


def _none() -> Batch:
    return lambda v, n: (np.frombuffer(one.none_encode(v), np.uint8), 4 * n), lambda data, sizes, n: data.view("<u4").astype(np.int64)


def _vbyte() -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        return np.frombuffer(one.vbyte_encode(v), np.uint8), _sums(np.maximum(1, (_widths(v) + 6) // 7), n)

    return encode, lambda data, sizes, n: one.vbyte_decode(data.tobytes(), int(n.sum()))


def _stream_vbyte() -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        size, place = np.maximum(1, (_widths(v) + 7) // 8), _within(n)
        keys = np.bitwise_or.reduceat((size - 1) << 2 * (place & 3), np.flatnonzero(place & 3 == 0)).astype(np.uint8)
        at = _within(size)
        body = ((np.repeat(v, size) >> (8 * at)) & 255).astype(np.uint8)
        return _joined((keys, -(-n // 4)), (body, _sums(size, n)))

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        k, begin, place = -(-n // 4), _before(sizes), _within(n)
        size = ((data[np.repeat(begin, n) + (place >> 2)].astype(np.int64) >> 2 * (place & 3)) & 3) + 1
        b = _slices(data, begin + k, _sums(size, n)).astype(np.int64)
        return np.add.reduceat(b << 8 * _within(size), _before(size))

    return encode, decode


def _nybble() -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        size = np.maximum(1, (_widths(v) + 2) // 3)
        out = (np.repeat(v, size) >> (3 * _within(size))) & 7
        out[np.cumsum(size) - 1] |= 8
        count = _sums(size, n)
        sizes = (count + 1) // 2
        half = np.zeros(2 * int(sizes.sum()), np.uint8)
        half[np.repeat(2 * _before(sizes), count) + _within(count)] = out
        return half[::2] | half[1::2] << 4, sizes

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        half = np.stack((data & 15, data >> 4), axis=1).ravel().astype(np.int64)
        ends = np.flatnonzero(half & 8)
        starts = np.concatenate(([0], ends[:-1] + 1))
        starts[_before(n)] = 2 * _before(sizes)  # not the half that fills up the byte before
        at = np.arange(len(half)) - np.repeat(starts, np.diff(starts, append=len(half)))
        return np.add.reduceat((half & 7) << 3 * at, starts)

    return encode, decode


def _packer(there: Callable[[bytes], bytes], back: Callable[[bytes, int], bytes]) -> Batch:
    """General compression of each list's plain numbers."""

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        raw, ends = one.none_encode(v), np.concatenate(([0], np.cumsum(4 * n))).tolist()
        out = [there(raw[a:b]) for a, b in pairwise(ends)]
        return np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out])

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        raw, ends = data.tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist()
        return np.frombuffer(b"".join(back(raw[a:b], k) for (a, b), k in zip(pairwise(ends), (4 * n).tolist(), strict=True)), "<u4").astype(np.int64)

    return encode, decode


def _zstd() -> Batch:
    there, back = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    return _packer(there.compress, lambda d, k: back.decompress(d, max_output_size=k + 1))


# -- Elias codes --------------------------------------------------------------------------------------------------


def _next_one(bits: np.ndarray) -> np.ndarray:
    """The place of the next 1 from each bit on."""
    seen = np.cumsum(bits, dtype=np.int32)
    return np.concatenate((np.flatnonzero(bits), [len(bits)])).astype(np.int32)[seen - bits]


def _gamma(high: bool) -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        v = v + 1
        w = _widths(v)
        bits = _sums(2 * w - 1, n)
        sizes = (bits + 7) // 8
        at = _before(2 * w - 1) + np.repeat(8 * _before(sizes) - _before(bits), n)
        field = v if high else (v - (1 << (w - 1))) << 1 | 1
        return _put(at + w - 1, w, field, int(sizes.sum()), high), sizes

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        ones = _next_one(np.unpackbits(data, bitorder="big" if high else "little"))
        at = _walked(2 * ones - np.arange(len(ones), dtype=np.int32) + 1, 8 * _before(sizes), n)
        w = ones[at] - at + 1
        return (_get(data, at + w - 1, w, True) if high else _get(data, at + w, w - 1) + (1 << (w - 1))) - 1

    return encode, decode


#: The widest width code of a delta code has 11 bits: of 6 bits for widths up to 33.
_HEAD = 11


def _heads(high: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each 11 bits at the beginning of a delta code, the bits of its width code and the width; 1 and 1 where there is none."""
    length, width = np.ones(1 << _HEAD, np.int32), np.ones(1 << _HEAD, np.int32)
    for w in range(1, 64):
        ww = w.bit_length()
        k = 2 * ww - 1
        code = w if high else ((w - (1 << (ww - 1))) << 1 | 1) << (ww - 1)
        rest = np.arange(1 << (_HEAD - k))
        places = code << (_HEAD - k) | rest if high else rest << k | code
        length[places], width[places] = k, w
    return length, width


def _delta(high: bool) -> Batch:
    length, width = _heads(high)

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        v = v + 1
        w = _widths(v)
        ww = _widths(w)
        full = 2 * ww + w - 2
        bits = _sums(full, n)
        sizes = (bits + 7) // 8
        at = _before(full) + np.repeat(8 * _before(sizes) - _before(bits), n)
        rest = v - (1 << (w - 1))
        field = w << (w - 1) | rest if high else rest << ww | (w - (1 << (ww - 1))) << 1 | 1
        return _put(at + ww - 1, ww + w - 1, field, int(sizes.sum()), high), sizes

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        b = np.concatenate((data, np.zeros(2, np.uint8))).astype(np.int32)
        three = b[:-2] << 16 | b[1:-1] << 8 | b[2:] if high else b[:-2] | b[1:-1] << 8 | b[2:] << 16
        heads = np.stack([three >> (24 - _HEAD - s if high else s) & ((1 << _HEAD) - 1) for s in range(8)], axis=1).ravel()
        at = _walked(length[heads] + width[heads] - 1 + np.arange(len(heads), dtype=np.int32), 8 * _before(sizes), n)
        w = width[heads[at]].astype(np.int64)
        return _get(data, at + length[heads[at]], w - 1, high) + (1 << (w - 1)) - 1

    return encode, decode


def _grouped(of_width: Batch, group: int = 4) -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        k, place = -(-n // group), _within(n)
        width = np.maximum.reduceat(_widths(v), np.flatnonzero(place % group == 0))
        head, head_sizes = of_width[0](width, k)
        bits = group * _sums(width, k)
        sizes = (bits + 7) // 8
        start = group * _before(width) + np.repeat(8 * _before(sizes) - _before(bits), k)
        of = np.repeat(_before(k), n) + place // group
        body = _put(start[of] + place % group * width[of], width[of], v, int(sizes.sum()))
        return _joined(_numbers(head_sizes), (head, head_sizes), (body, sizes))

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        k, place, begin = -(-n // group), _within(n), _before(sizes)
        head_sizes = _number_at(data, begin)
        width = of_width[1](_slices(data, begin + 4, head_sizes), head_sizes, k)
        start = group * _before(width) - np.repeat(group * _before(_sums(width, k)) - 8 * (begin + 4 + head_sizes), k)
        of = np.repeat(_before(k), n) + place // group
        return _get(data, start[of] + place % group * width[of], width[of])

    return encode, decode


# -- Words and blocks by selectors --------------------------------------------------------------------------------

#: More than any selector's values.
_PAD = 512


def _wider(widths: np.ndarray, limits: set[int]) -> dict[int, np.ndarray]:
    """For each width, the place of the next wider value from each place on."""
    n, out = len(widths), {}
    places = np.arange(n, dtype=np.int32)
    for w in limits:
        found = np.full(n + _PAD, n + _PAD, np.int32)
        found[:n][widths > w] = places[widths > w]
        out[w] = np.minimum.accumulate(found[::-1])[::-1]
    return out


def _runs(selector: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(width, from, to) of a selector's runs of one width."""
    cuts = [0, *(i for i in range(1, len(selector)) if selector[i] != selector[i - 1]), len(selector)]
    return [(selector[a], a, b) for a, b in pairwise(cuts)]


def _fitting(v: np.ndarray, n: np.ndarray, selectors: tuple[tuple[int, ...], ...]):
    """For each selector, whether the values from each place to the list's end or the word's fit."""
    size, ends = len(v), np.repeat(np.cumsum(n), n).astype(np.int32)
    wider, places = _wider(_widths(v), {w for s in selectors for w in s}), np.arange(size, dtype=np.int32)
    for s in selectors:
        fits = np.ones(size, bool)
        for w, a, b in _runs(s):
            fits &= wider[w][a : a + size] >= np.minimum(places + b, ends)
        yield fits


def _greedy(v: np.ndarray, n: np.ndarray, selectors: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """The first selector that fits at each place, -1 if none does."""
    out = np.full(len(v), -1, np.int16)
    for k, fits in enumerate(_fitting(v, n, selectors)):
        out[fits & (out < 0)] = k
    return out


def _fewest(v: np.ndarray, n: np.ndarray, selectors: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """At each place the selector that begins the fewest words to the list's end, of equals the first."""
    masks = np.zeros(len(v), np.int32)
    for k, fits in enumerate(_fitting(v, n, selectors)):
        masks |= fits.astype(np.int32) << k
    some = {}
    for m in np.unique(masks).tolist():
        lengths: dict[int, int] = {}
        for k, s in enumerate(selectors):
            if m >> k & 1:
                lengths.setdefault(len(s), k)
        some[m] = tuple((k, size) for size, k in lengths.items())
    masks, pad, take = masks.tolist(), [0] * max(map(len, selectors)), []
    for a, b in pairwise([0, *np.cumsum(n).tolist()]):
        best, taken = [0] * (b - a) + pad, [0] * (b - a)
        for i in range(b - a - 1, -1, -1):
            least, which = sys.maxsize, -1
            for k, size in some[masks[a + i]]:
                if (x := best[i + size]) < least:
                    least, which = x, k
            best[i], taken[i] = least + 1, which
        take += taken
    return np.array(take, np.int16)


def _begun(chosen: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places where words begin."""
    ends = np.repeat(np.cumsum(n), n)
    after = np.minimum(np.arange(len(chosen)) + np.where(chosen < 0, 1, lengths[chosen]), ends).tolist()
    out, at = [], 0
    while at < len(after):
        out.append(at)
        at = after[at]
    begun = np.array(out)
    if (chosen[begun] < 0).any():
        raise ValueError("a value is too wide for the codec")
    return begun


def _per_list(begun: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(begun, np.concatenate(([0], np.cumsum(n)))))


def _words(w: Words, bytes_: int = 0, highest: bool = False) -> Batch:
    """Words of fields; lyck's stand in so many bytes, selector first, and have their first field highest."""
    most = max(map(len, w.selectors))
    lengths = np.array([len(s) for s in w.selectors])
    width, shift = np.zeros((len(w.selectors), most), np.int64), np.zeros((len(w.selectors), most), np.int64)
    for k, s in enumerate(w.selectors):
        width[k, : len(s)] = s
        upto = np.cumsum(s)
        shift[k, : len(s)] = 24 - upto if highest else w.head + upto - s
    form = "<u4" if w.size <= 32 else "<u8"

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        chosen = (_fewest if w.optimal else _greedy)(v, n, w.selectors)
        begun = _begun(chosen, n, lengths)
        k, count = chosen[begun].astype(np.int64), np.diff(begun, append=len(v))
        fields = v.astype(np.uint64) << shift[np.repeat(k, count), _within(count)].astype(np.uint64)
        words = (np.bitwise_or.reduceat(fields, begun) | k.astype(np.uint64)).astype(form)
        raw = words.view(np.uint8).reshape(len(words), -1)
        size = bytes_ or raw.shape[1]
        return raw[:, :size].ravel(), size * _per_list(begun, n)

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = bytes_ or w.size // 8
        raw = np.zeros((len(data) // size, np.dtype(form).itemsize), np.uint8)
        raw[:, :size] = data.reshape(-1, size)
        words, per = raw.view(form).ravel().astype(np.uint64), sizes // size
        k = (words & np.uint64(255 if highest else (1 << w.head) - 1)).astype(np.int64)
        count, last = lengths[k], np.cumsum(per) - 1
        count[last] -= _sums(count, per) - n
        place = _within(count)
        of = np.repeat(np.arange(len(words)), count)
        mask = (np.uint64(1) << width[k[of], place].astype(np.uint64)) - np.uint64(1)
        return (words[of] >> shift[k[of], place].astype(np.uint64) & mask).astype(np.int64)

    return encode, decode


def _relative(c: Relative) -> Batch:
    widths, size = np.array(c.widths), c.size
    #: By row and whether the selector is carried: of each selector the row and how many fields, and whether the word carries the next.
    steps = [[[(r, (size - begin) // c.widths[r], c.carry and size - begin - (size - begin) // c.widths[r] * c.widths[r] >= 2) for r in c._rows(row)] for begin in (2, 0)] for row in range(len(c.widths))]
    form = f"<u{size // 8}"

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        if int(_widths(v).max()) > c.widths[-1]:
            raise ValueError("a value is too wide for the codec")
        found = _wider(_widths(v), set(c.widths))
        wider = [memoryview(np.ascontiguousarray(found[w])) for w in c.widths]
        at, begun, rows, chosen, carried = 0, [], [], [], []
        for end in np.cumsum(n).tolist():
            row, held = 0, False
            while at < end:
                for selector, (r, count, carries) in enumerate(steps[row][held]):  # noqa: B007
                    stop = at + count if at + count < end else end
                    if wider[r][at] >= stop:
                        break
                begun.append(at)
                rows.append(r)
                chosen.append(selector)
                carried.append(held)
                at, row, held = stop, r, carries
        begun, rows, chosen, carried = np.array(begun), np.array(rows), np.array(chosen, np.uint64), np.array(carried)
        begin, count = np.where(carried, 0, 2), np.diff(begun, append=len(v))
        fields = v.astype(np.uint64) << (np.repeat(begin, count) + _within(count) * np.repeat(widths[rows], count)).astype(np.uint64)
        words = np.bitwise_or.reduceat(fields, begun)
        words[~carried] |= chosen[~carried]
        told = np.flatnonzero(carried)
        full = (size - begin[told - 1]) // widths[rows[told - 1]]
        words[told - 1] |= chosen[told] << (begin[told - 1] + full * widths[rows[told - 1]]).astype(np.uint64)
        return words.astype(form).view(np.uint8), size // 8 * _per_list(begun, n)

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(data).view(form)
        said, w, rows, begins, counts = words.tolist(), 0, [], [], []
        for left in n.tolist():
            row, selector = 0, None
            while left > 0:
                word = said[w]
                begin = 0 if selector is not None else 2
                row, count, carries = steps[row][begin == 0][word & 3 if selector is None else selector]
                selector = word >> begin + count * c.widths[row] & 3 if carries else None
                rows.append(row)
                begins.append(begin)
                counts.append(count if count < left else left)
                left -= count
                w += 1
        counts = np.array(counts)
        of, width = np.repeat(np.arange(len(counts)), counts), widths[np.array(rows)]
        shift = np.array(begins)[of] + _within(counts) * width[of]
        return (words.astype(np.uint64)[of] >> shift.astype(np.uint64) & ((np.uint64(1) << width[of].astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    return encode, decode


def _escaping(codec: Batch, width: int) -> Batch:
    mask, tail_of = (1 << width) - 1, _vbyte()

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        low, low_sizes = codec[0](v & mask, n)
        wide, place = v > mask, _within(n)
        count = _sums(wide.astype(np.int64), n)
        tail, tail_sizes = np.zeros(0, np.uint8), np.zeros(len(n), np.int64)
        if count.any():
            some = count > 0
            step = np.diff(place[wide], prepend=0)
            firsts = _before(count[some])
            step[firsts] = place[wide][firsts]
            tail, tail_sizes[some] = tail_of[0](np.stack((step, v[wide] >> width), axis=1).ravel(), 2 * count[some])
        return _joined(_numbers(low_sizes), _numbers(count), (low, low_sizes), (tail, tail_sizes))

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin = _before(sizes)
        low_sizes, count = _number_at(data, begin), _number_at(data, begin + 4)
        out = codec[1](_slices(data, begin + 8, low_sizes), low_sizes, n)
        if count.any():
            some = count > 0
            size = (sizes - 8 - low_sizes)[some]
            pairs = tail_of[1](_slices(data, (begin + 8 + low_sizes)[some], size), size, 2 * count[some]).reshape(-1, 2)
            upto, firsts = np.cumsum(pairs[:, 0]), _before(count[some])
            place = upto - np.repeat((upto - pairs[:, 0])[firsts], count[some])
            out[np.repeat(_before(n)[some], count[some]) + place] |= pairs[:, 1] << width
        return out

    return encode, decode


def _frames(group: int) -> Batch:
    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        place, k = _within(n), -(-n // group)
        firsts = np.flatnonzero(place % group == 0)
        width, count = np.maximum.reduceat(_widths(v), firsts), np.diff(firsts, append=len(v))
        size = 1 + (count * width + 7) // 8
        start, of = _before(size), np.repeat(np.arange(len(firsts)), count)
        out = _put(8 * (start[of] + 1) + place % group * width[of], width[of], v, int(size.sum()))
        out[start] = width
        return out, _sums(size, k)

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        said, at, starts = data.tobytes(), 0, []
        for left in n.tolist():
            while left > 0:
                starts.append(at)
                at += 1 + (min(group, left) * said[at] + 7) // 8
                left -= group
        place, starts = _within(n), np.array(starts)
        of = np.cumsum(place % group == 0) - 1
        width = data[starts[of]].astype(np.int64)
        return _get(data, 8 * (starts[of] + 1) + place % group * width, width)

    return encode, decode


_QMX_SELECTORS = tuple((w,) * k for w, k in _QMX)
_QMX_WIDTH, _QMX_COUNT = np.array(_QMX).T
_QMX_SIZE = np.array([0 if not w else 32 if w in _TWO_WORDS else 16 for w, _ in _QMX])


def _qmx(length: bool) -> Batch:
    place_of = _vbyte()

    def turned(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each list's bytes from the back."""
        return data[np.repeat(np.cumsum(sizes) - 1, sizes) - _within(sizes)]

    def encode(v: np.ndarray, n: np.ndarray) -> Coded:
        chosen = _greedy(v, n, _QMX_SELECTORS)
        begun = _begun(chosen, n, _QMX_COUNT)
        k, count, per = chosen[begun].astype(np.int64), np.diff(begun, append=len(v)), _per_list(begun, n)
        start, width, place = _before(_QMX_SIZE[k]), _QMX_WIDTH[k], _within(count)
        body = _put(np.repeat(8 * start, count) + place * np.repeat(width, count), np.repeat(width, count), v, int(_QMX_SIZE[k].sum()))
        body_sizes = _sums(_QMX_SIZE[k], per)
        new = np.diff(k, prepend=-1) != 0
        new[_before(per)] = True
        at = np.arange(len(k))
        run = at - np.maximum.accumulate(np.where(new, at, 0))
        firsts = np.flatnonzero(run % 16 == 0)
        selectors = (k[firsts] << 4 | np.diff(firsts, append=len(k)) - 1).astype(np.uint8)
        selector_sizes = np.diff(np.searchsorted(firsts, np.concatenate(([0], np.cumsum(per)))))
        if not length:
            return _joined((body, body_sizes), (turned(selectors, selector_sizes), selector_sizes))
        place, place_sizes = place_of[0](body_sizes, np.ones(len(n), np.int64))
        return _joined((body, body_sizes), (selectors, selector_sizes), (turned(place, place_sizes), place_sizes))

    def decode(data: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin, said = _before(sizes), data.tobytes()
        starts, found, counts = [], [], []
        for a, size, left in zip(begin.tolist(), sizes.tolist(), n.tolist(), strict=True):
            at, step = a + size - 1, -1
            if length:
                place, shift = 0, 0
                while True:
                    place |= (said[at] & 127) << shift
                    if said[at] & 128:
                        break
                    at, shift = at - 1, shift + 7
                at, step = a + place, 1
            while left > 0:
                s = said[at]
                for _ in range((s & 15) + 1):
                    width, count = _QMX[s >> 4]
                    starts.append(a)
                    found.append(width)
                    counts.append(count if count < left else left)
                    a += 0 if not width else 32 if width in _TWO_WORDS else 16
                    left -= count
                at += step
        counts, found, starts = np.array(counts), np.array(found), np.array(starts)
        of = np.repeat(np.arange(len(counts)), counts)
        return _get(data, 8 * starts[of] + _within(counts) * found[of], found[of])

    return encode, decode


_LYCK = Words(24, 8, ((2,) * 8, (4,) * 4, (8,) * 2, (16,)))

#: Codecs by name, as in codecs.py.
BATCHES: dict[str, Batch] = {
    "none": _none(),
    "variable_byte": _vbyte(),
    "stream_vbyte": _stream_vbyte(),
    "nybble_8": _nybble(),
    "lyck_16": _escaping(_words(_LYCK, 3, True), 16),
    "elias_gamma": _gamma(False),
    "elias_delta": _delta(False),
    "elias_gamma_bitwise": _gamma(True),
    "elias_delta_bitwise": _delta(True),
    "group_elias_gamma": _grouped(_gamma(False)),
    "group_elias_gamma_vb": _grouped(_vbyte()),
    "group_elias_delta": _grouped(_delta(False)),
    "simple_9": _escaping(_words(Words(32, 4, one._SIMPLE_9)), 28),
    "simple_9_packed": _escaping(_words(Words(32, 4, one._SIMPLE_9, True)), 28),
    "simple_16": _escaping(_words(Words(32, 4, one._SIMPLE_16)), 28),
    "simple_16_packed": _escaping(_words(Words(32, 4, one._SIMPLE_16, True)), 28),
    "simple_8b": _words(Words(64, 4, one._SIMPLE_8B)),
    "simple_8b_packed": _words(Words(64, 4, one._SIMPLE_8B, True)),
    "relative_10": _escaping(_relative(Relative(32, one._RELATIVE_10)), 30),
    "carryover_12": _escaping(_relative(Relative(32, one._CARRYOVER_12, True)), 28),
    "carry_8b": _relative(Relative(64, one._CARRY_8B, True)),
    "bitpack_32": _frames(32),
    "bitpack_64": _frames(64),
    "bitpack_128": _frames(128),
    "bitpack_256": _frames(256),
    "qmx": _qmx(True),
    "qmx_improved": _qmx(False),
    "zlib": _packer(zlib.compress, lambda d, _: zlib.decompress(d)),
    "zstd": _zstd(),
}

#: Values coded together: few enough for the caches.
TOGETHER = 1 << 16


def tallies(v: np.ndarray, n: np.ndarray, times: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(codec, lists, bytes, failures) of lists that each stand for so many."""
    empty = n == 0
    cuts, ends = [0], np.cumsum(n)
    while cuts[-1] < len(n):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + TOGETHER, "right"))))
    out = []
    for name, (there, back) in BATCHES.items():
        size = failures = 0
        if empty.any():
            nothing = np.zeros(0, np.int64)
            data = one.CODECS[name][0](nothing)
            size += len(data) * int(times[empty].sum())
            failures += 0 if len(one.CODECS[name][1](data, 0)) == 0 else int(times[empty].sum())
        for a, b in pairwise(cuts):
            some = slice(a, b)
            kept, weight = n[some][~empty[some]], times[some][~empty[some]]
            if not len(kept):
                continue
            values = v[ends[a] - n[a] : ends[b - 1]]
            data, sizes = there(values, kept)
            again = back(data, sizes, kept)
            wrong = _sums((again != values).astype(np.int64), kept) > 0 if len(again) == len(values) else np.ones(len(kept), bool)
            size += int((sizes * weight).sum())
            failures += int(weight[wrong].sum())
        out.append((name, int(times.sum()), size, failures))
    return out
