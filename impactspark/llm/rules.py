"""Quality rules: counts of a text against fixed limits, then hashed n-gram logistic regression against a fixed threshold.

The regression (word and character n-grams) is trained on labelled quality rows, calibrated to a probability on rows that
the fit has not seen, and scored in Arrow batches. The fit reads a bounded sample (``FIT_ROWS`` of each class, of
texts of ``FIT_CHARS`` characters at most, none of them held out); rules and scores read whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from impactspark.llm._fit import Linear, Trainer, labelled_sample, platt, sigmoid
from impactspark.llm._shared import Block, blocks, numbered, ranges, table

FIT_ROWS, FIT_CHARS, ROUNDS = 1500, 8_000, 60
#: SPAN is a power of two.
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN, THRESHOLD = 20, 30, 8, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _codes(first: np.ndarray, second: np.ndarray, base: int) -> np.ndarray:
    """A number for each pair of numbers, the second below base; equal only for equal pairs."""
    return numbered(pa.array(first * base + second))[0]


def _seen_again(codes: np.ndarray) -> np.ndarray:
    """For each number whether it is there more than once."""
    return (np.bincount(codes) > 1)[codes] if len(codes) else np.zeros(0, bool)


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """The five counts of each document of a block."""
    data, n = block.data, len(block)
    start, end, doc = block.words()
    words = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    # Lines: from a document's begin or behind a line feed up to the next line feed or the document's end.
    feed = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate((block.offsets[:-1][np.diff(block.offsets) > 0], feed + 1)))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, begins)], block.offsets[np.searchsorted(block.offsets, begins, side="right")])
    worded = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    full = worded[ends] > worded[begins]
    begins, ends = begins[full], ends[full]
    line_doc = np.searchsorted(block.offsets, begins, side="right") - 1
    line = _codes(line_doc, numbered(ranges(data, begins, ends))[0], len(line_doc) + 1)
    _, first = np.unique(line, return_index=True)
    n_lines, n_distinct = np.bincount(line_doc, minlength=n), np.bincount(line_doc[first], minlength=n)
    # Words under a span that its document has more than once.
    hit = np.zeros(len(start) + 1, np.int64)
    if len(start) >= SPAN:
        # Spans are numbered by halves: words, then pairs of them, then pairs of pairs; equal numbers are equal words.
        code, width = numbered(ranges(data, start, end))[0], 1
        while width < SPAN:
            code = _codes(code[:-width], code[width:], len(start))
            width *= 2
        m = len(code)
        whole = np.flatnonzero(doc[:m] == doc[SPAN - 1 :])
        again = whole[_seen_again(_codes(doc[whole], code[whole], len(start)))]
        np.add.at(hit, again, 1)
        np.add.at(hit, again + SPAN, -1)
    repeated = np.cumsum(hit[:-1]) > 0
    return {
        "n_words": words,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), block.offsets),
        "n_symbols": _sums(SYMBOLS[data], block.offsets),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": np.bincount(doc[repeated], minlength=n) if len(doc) else np.zeros(n, np.int64),
    }


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_counts(b) for _, b in blocks(column)]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in COUNTS}


def train(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS) -> Linear:
    """Fit on four of five rows, calibrate on the fifth. Without both labels, their share as a constant score."""
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        model = Linear.new()
        model.scale, model.shift, model.empty = 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), share
        return model
    apart = np.arange(len(y)) % 5 == 4
    fit = Trainer([t for t, a in zip(texts, apart, strict=True) if not a])
    mine = y[~apart]
    weight = np.where(mine > 0, 0.5 / max(1, mine.sum()), 0.5 / max(1, (1 - mine).sum()))
    for _ in range(rounds):
        fit.step(weight * (sigmoid(fit.margins()) - mine), rate=1.0)
    model = fit.model
    p = Linear(model.tables, model.bias, 1.0, 0.0, 0.5).scores(pa.array([t for t, a in zip(texts, apart, strict=True) if a], pa.large_binary()))
    model.scale, model.shift = platt(np.log(np.maximum(p, 1e-300) / np.maximum(1 - p, 1e-300)), y[apart])
    model.empty = float(sigmoid(model.scale * model.bias + model.shift))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Linear:
    return train(*labelled_sample(docs, labels, "quality", rows, chars))


def judge(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept of every row of docs(doc_id, text).

    Null and wordless texts have no words and so fail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, p = counts_of(batch.column(1)), model.scores(batch.column(1))
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            arrays = [batch.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, score double, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels))


def op8_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8_quality_rules: the counts and base_failed, by the same operator."""
    return op8_quality_rules(spark, sf_dir).drop("score", "kept")


OP8_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS span FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, span) > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM n
"""
