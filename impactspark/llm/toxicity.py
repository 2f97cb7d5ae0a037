"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and scored in numpy.

A word's input is the sum of a hashed word embedding and the mean of its hashed character n-gram embeddings (three
and four bytes, with word marks), so unseen forms of a stem are read by their characters; word embeddings begin at
zero, so an unseen word adds nothing of its own, and in training each word of a batch is read as if unseen half the
times, so that its characters alone must do. Two gated recurrent chains
read each window of words, one in either direction; attention pools their states into one value. A document's score
is its highest window, calibrated to a probability. Windows of ``WINDOW`` words begin at every ``STRIDE``-th word of the
whole text, and the last ends with it: a passage of up to WINDOW - STRIDE + 1 words (21) is whole in one of them
wherever it stands; a longer one may be split.

Labels are of documents, so training is by multiple instances: each document is represented by its highest window
under the current weights (at first by a random one). The fit reads a bounded sample of labelled rows (``FIT_ROWS``
for each class, of texts of ``FIT_CHARS`` characters at most); scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._fit import label_share, labelled_sample, platt, sigmoid
from impactspark.llm._shared import Block, blocks, digests, id_crc, numbered, ranges, table

HIDDEN, WORD_BITS, CHAR_BITS = 8, 15, 14
WINDOW, STRIDE = 32, 12
FIT_ROWS, FIT_CHARS, EPOCHS, BATCH = 1500, 20_000, 10, 256
#: Small samples are gone through more often, for so many steps in all, but so many times at most.
LEAST_STEPS, MOST_EPOCHS = 120, 60
THRESHOLD = 0.5
_AT_ONCE = 2048


def word_inputs(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row of the word embedding, and (row of the character embedding, word) pairs."""
    n, size = len(start), end - start + 2
    offsets = np.concatenate(([0], np.cumsum(size)))
    marked = np.full(offsets[-1] + 3, 62, np.uint8)
    marked[offsets[:-1]] = 60
    of = np.repeat(np.arange(n), size)
    at = np.arange(offsets[-1]) - offsets[of]
    inner = (at > 0) & (at < size[of] - 1)
    marked[: offsets[-1]][inner] = data[(start[of] + at - 1)[inner]]
    wide = marked.astype(np.uint32)
    three = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16)
    four = three | wide[3:] << np.uint32(24)
    left = size[of] - at
    shift = np.uint32(32 - CHAR_BITS)
    a, b = left >= 3, left >= 4
    rows = np.concatenate(((three[a] * np.uint32(2654435761)) >> shift, ((four[b] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift))
    words = np.concatenate((of[a], of[b]))
    order = np.argsort(words, kind="stable")
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), rows[order].astype(np.int64), words[order]


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    empty: float = 0.0

    @staticmethod
    def new(seed: int = 1, hidden: int = HIDDEN, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(dtype)
        p = {"word": np.zeros((1 << WORD_BITS, hidden), dtype), "char": draw(1 << CHAR_BITS, hidden, by=0.1), "att": draw(2 * hidden, hidden), "pick": draw(hidden), "out": draw(2 * hidden), "bias": np.zeros(1, dtype)}
        for d in "fb":
            for g in "zrh":
                p |= {f"x{g}{d}": draw(hidden, hidden), f"u{g}{d}": draw(hidden, hidden), f"b{g}{d}": np.full(hidden, 1.0 if g == "z" else 0.0, dtype)}
        return Network(p)

    def vectors(self, word: np.ndarray, rows: np.ndarray, of: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """The words' inputs; those not seen are read by their characters alone."""
        p, n = self.p, len(word)
        v = p["word"][word]
        if seen is not None:
            v = v * seen[:, None].astype(v.dtype)
        if len(rows):
            begin = np.searchsorted(of, np.arange(n))
            count = np.diff(np.append(begin, len(of)))
            chars = np.add.reduceat(p["char"][rows], np.minimum(begin, len(rows) - 1), axis=0)
            chars[count == 0] = 0
            v = v + chars / np.maximum(count, 1)[:, None].astype(v.dtype)
        return v

    def gates(self, v: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates; one more row of zeros for places without a word."""
        v = np.concatenate((v, np.zeros((1, v.shape[1]), v.dtype)))
        return {g + d: v @ self.p[f"x{g}{d}"] + self.p[f"b{g}{d}"] for d in "fb" for g in "zrh"}

    def _chain(self, x: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None) -> np.ndarray:
        p, (steps, n) = self.p, at.shape
        uz, ur, uh = p[f"uz{d}"], p[f"ur{d}"], p[f"uh{d}"]
        h = np.zeros((n, uz.shape[0]), uz.dtype)
        out = np.empty((steps, n, uz.shape[0]), uz.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            i = at[t]
            z = h @ uz
            z += x["z" + d][i]
            z *= 0.5
            np.tanh(z, out=z)
            z *= 0.5
            z += 0.5
            r = h @ ur
            r += x["r" + d][i]
            r *= 0.5
            np.tanh(r, out=r)
            r *= 0.5
            r += 0.5
            s = h @ uh
            q = r * s
            q += x["h" + d][i]
            np.tanh(q, out=q)
            new = h - q
            new *= z
            new += q
            if mask is not None:
                new *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, s, q))
            h = out[t] = new
        return out

    def forward(self, x: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; at: (steps, windows) rows of x, mask: 1 where there is a word."""
        p, logs = self.p, {"f": [], "b": []}
        h = np.concatenate([self._chain(x, at, mask, d, logs[d] if keep is not None else None) for d in "fb"], axis=2)
        a = np.tanh(h.reshape(-1, h.shape[2]) @ p["att"]).reshape(*at.shape, -1)
        e = a @ p["pick"]
        if mask is not None:
            e = np.where(mask > 0, e, -1e9).astype(h.dtype)
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        c = np.einsum("tn,tnh->nh", w, h)
        logit = c @ p["out"] + p["bias"][0]
        if keep is not None:
            keep.update(h=h, a=a, w=w, c=c, logs=logs)
        return logit

    def backward(self, v: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: dict, g: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights and of the word vectors v for the gradient g of the logits."""
        p, h, a, w, c = self.p, keep["h"], keep["a"], keep["w"], keep["c"]
        hid = p["pick"].shape[0]
        grad = {"out": c.T @ g, "bias": np.array([g.sum()], c.dtype)}
        dc = g[:, None] * p["out"]
        dh = w[:, :, None] * dc
        dw = np.einsum("tnh,nh->tn", h, dc)
        de = w * (dw - (w * dw).sum(axis=0))
        grad["pick"] = np.einsum("tn,tnk->k", de, a)
        da = de[:, :, None] * p["pick"] * (1 - a * a)
        grad["att"] = h.reshape(-1, 2 * hid).T @ da.reshape(-1, hid)
        dh += da @ p["att"].T
        dv = np.zeros((len(v) + 1, hid), v.dtype)
        padded = np.concatenate((v, np.zeros((1, hid), v.dtype)))
        for k, d in enumerate("fb"):
            back = np.zeros((at.shape[1], hid), v.dtype)
            for name in "zrh":
                grad[f"x{name}{d}"], grad[f"u{name}{d}"], grad[f"b{name}{d}"] = np.zeros((hid, hid), v.dtype), np.zeros((hid, hid), v.dtype), np.zeros(hid, v.dtype)
            for t, prev, z, r, s, q in reversed(keep["logs"][d]):
                total = back + dh[t][:, k * hid : (k + 1) * hid]
                if mask is not None:
                    total = total * mask[t][:, None]
                dz, dq = total * (prev - q) * z * (1 - z), total * (1 - z) * (1 - q * q)
                dr, ds = dq * s * r * (1 - r), dq * r
                word = padded[at[t]]
                into = np.zeros_like(word)
                back = total * z
                for name, dx, du in (("z", dz, dz), ("r", dr, dr), ("h", dq, ds)):
                    grad[f"x{name}{d}"] += word.T @ dx
                    grad[f"b{name}{d}"] += dx.sum(axis=0)
                    grad[f"u{name}{d}"] += prev.T @ du
                    back = back + du @ p[f"u{name}{d}"].T
                    into += dx @ p[f"x{name}{d}"].T
                np.add.at(dv, at[t], into)
        return grad, dv[:-1]


def windows(counts: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word (within its document) of every window; each word is in one at least, wordless
    documents have none. The last window of a document ends with it."""
    each = np.where(counts == 0, 0, np.where(counts <= window, 1, 1 + -(-(counts - window) // stride)))
    doc = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return doc, np.maximum(0, np.minimum(nth * stride, counts[doc] - window))


class Reader:
    """Words of a block, once each, and its windows."""

    def __init__(self, block: Block):
        folded = block.folded()
        start, end, doc = block.words()
        self.id, values = numbered(ranges(folded, start, end))
        first = np.zeros(len(values), np.int64)
        first[self.id[::-1]] = np.arange(len(start))[::-1]
        self.inputs = word_inputs(folded, start[first], end[first], digests(values)[:, 0])
        self.n_words = len(first)
        self.counts = np.bincount(doc, minlength=len(block)) if len(doc) else np.zeros(len(block), np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.doc, self.begin = windows(self.counts)

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(steps, windows) word numbers, and a mask if some window is short."""
        doc, step = self.doc[which], np.arange(WINDOW)[:, None]
        at = self.begin[which] + step
        real = at < self.counts[doc]
        at = np.where(real, self.id[np.minimum(self.offsets[doc] + at, len(self.id) - 1)], self.n_words)
        return at, None if real.all() else real.astype(np.float32)

    def logits(self, net: Network) -> np.ndarray:
        """Of all windows."""
        out = np.zeros(len(self.doc), np.float32)
        x = net.gates(net.vectors(*self.inputs))
        short = self.counts[self.doc] < WINDOW
        for some in (np.flatnonzero(~short), np.flatnonzero(short)):
            for a in range(0, len(some), _AT_ONCE):
                which = some[a : a + _AT_ONCE]
                out[which] = net.forward(x, *self.places(which))
        return out


def highest(reader: Reader, logits: np.ndarray, without: float = -np.inf) -> np.ndarray:
    """The highest window of each document."""
    out = np.full(len(reader.counts), without)
    if len(logits):
        has = np.flatnonzero(reader.counts)
        out[has] = np.maximum.reduceat(logits, np.searchsorted(reader.doc, has))
    return out


def train(texts: list[bytes], labels: np.ndarray, share: float | None = None, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Fit on whole documents and their labels, of which a share is 1 outside the sample. Without both labels among
    texts with words, a constant score."""
    labels = np.asarray(labels, np.float32)
    net = Network.new(seed)
    share = (float(labels.mean()) if len(labels) else 0.0) if share is None else share
    net.empty = share
    column = pa.array(texts, pa.large_binary())
    readers, at_doc = [], []
    for at, block in blocks(column):
        readers.append(Reader(block))
        at_doc.append(at)
    pool = [(r, w) for r, x in enumerate(readers) for w in range(len(x.counts)) if x.counts[w]]
    y = np.array([labels[at_doc[r] + d] for r, d in pool], np.float32)
    if not len(pool) or y.min() == y.max():
        net.scale, net.shift = 0.0, float(np.log((net.empty + 1e-6) / (1 - net.empty + 1e-6)))
        return net
    rng = np.random.default_rng(seed)
    bounds = [np.concatenate((np.searchsorted(x.doc, np.arange(len(x.counts))), [len(x.doc)])) for x in readers]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("word", "char")}
    squares = {k: np.full(len(net.p[k]), 1e-10, np.float32) for k in ("word", "char")}
    positive = np.flatnonzero(y == 1)
    negative = np.flatnonzero(y == 0)
    step, n = 0, max(len(positive), len(negative))
    epochs = max(epochs, min(MOST_EPOCHS, LEAST_STEPS * BATCH // (2 * n)))
    for epoch in range(epochs):
        held = [x.logits(net) for x in readers] if epoch >= 2 else None
        chosen = np.empty(len(pool), np.int64)
        for i, (r, d) in enumerate(pool):
            a, b = bounds[r][d], bounds[r][d + 1]
            chosen[i] = a + int(np.argmax(held[r][a:b])) if held else rng.integers(a, b)
        dealt = np.stack([rng.permutation(np.resize(rng.permutation(x), n)) for x in (positive, negative)], axis=1).ravel()
        for a in range(0, len(dealt), BATCH):
            batch = dealt[a : a + BATCH]
            for r in np.unique([pool[i][0] for i in batch]):
                mine = np.array([i for i in batch if pool[i][0] == r])
                step += 1
                _learn(net, readers[r], chosen[mine], y[mine], len(batch), moments, squares, step, rng)
    top = np.concatenate([highest(x, x.logits(net)) for x in readers])
    known = np.isfinite(top)
    net.scale, net.shift = platt(top[known], labels[known])
    odds = lambda p: np.log(p / (1 - p))  # noqa: E731  the sample has more of the rarer label than there is
    net.shift += float(odds(min(max(share, 1e-3), 1 - 1e-3)) - odds(float(labels[known].mean())))
    return net


def _learn(net: Network, reader: Reader, which: np.ndarray, y: np.ndarray, of: int, moments: dict, squares: dict, step: int, rng: np.random.Generator) -> None:
    at, mask = reader.places(which)
    used, at = np.unique(at, return_inverse=True)
    pad = len(used) - 1 if used[-1] == reader.n_words else len(used)
    real = used[:pad]
    word, rows, owner = reader.inputs
    lo, hi = np.searchsorted(owner, real), np.searchsorted(owner, real, side="right")
    size = hi - lo
    pick = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    local = (word[real], rows[pick], np.repeat(np.arange(len(real)), size))
    seen = rng.random(len(real)) < 0.5
    v = net.vectors(*local, seen)
    keep: dict = {}
    at = at.reshape(WINDOW, -1)
    logit = net.forward(net.gates(v), at, mask, keep)
    grad, dv = net.backward(v, at, mask, keep, ((sigmoid(logit) - y) / of).astype(np.float32))
    rate = 0.01
    for k, g in grad.items():
        m, s = moments[k]
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    chars = dv[local[2]] / np.maximum(size, 1)[local[2], None].astype(np.float32)
    for k, i, g in (("word", local[0][seen], dv[seen]), ("char", local[1], chars)):
        row, inverse = np.unique(i, return_inverse=True)
        total = np.zeros((len(row), g.shape[1]), np.float32)
        np.add.at(total, inverse, g)
        squares[k][row] += (total * total).mean(axis=1)
        net.p[k][row] -= 0.05 * total / np.sqrt(squares[k][row])[:, None]


def score_column(net: Network, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for at, block in blocks(column):
        reader = Reader(block)
        top = highest(reader, reader.logits(net))
        out[at : at + len(block)] = np.where(np.isfinite(top), sigmoid(net.scale * np.where(np.isfinite(top), top, 0.0) + net.shift), net.empty)
    return out


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text). Null and wordless texts get the share of label 1 in the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_column(net, batch.column(1)))], ["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Network:
    """Learn labels(doc_id, toxic) from the rows that aren't held out."""
    texts, y = labelled_sample(docs, labels, "toxic", rows, chars)
    return train(texts, y, label_share(labels, "toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
