"""Quality by positive-unlabelled learning: the non-negative unbiased risk of a hashed linear model.

Trusted positives are labelled good; the unlabelled are any rows of the corpus. The share of positives among the
unlabelled (the class prior) is estimated from first models that tell the two apart: of the score bins from the top,
the least ratio of unlabelled to positive mass bounds the prior from above, and with a term for the bins' sampling
error its minimum is taken as the estimate. There are two first models, each fitted on a half of the positives and of
the sampled unlabelled rows; each scores the other half, and of the corpus every row that isn't held out is scored by
the model that has not seen its half, so the estimate rests on all texts. The second model then minimises prior *
E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the sigmoid loss; where the bracket turns negative its
gradient is undone. Margins are calibrated to probabilities on labelled rows of both classes that no fit has seen.

The fits read bounded samples: ``FIT_ROWS`` labelled rows of each class, of texts of ``FIT_CHARS`` characters at most
(one in ``APART`` for calibration), and twice as many unlabelled rows, of ``FIT_TOTAL`` characters together. None of
them is held out. The prior and the scores read everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._fit import FOLDS, Linear, Trainer, labelled_sample, platt, sample_key, sigmoid, unlabelled_sample
from impactspark.llm._shared import id_crc, released, sliced, table

FIT_ROWS, FIT_CHARS, FIT_TOTAL, ROUNDS, APART = 1200, 8_000, 6_000_000, 60, 4
THRESHOLD = 0.3
#: Score bins of the prior's estimate.
BINS = 1000


def binned(scores: np.ndarray) -> np.ndarray:
    """How many scores each bin has."""
    return np.bincount(np.minimum((np.asarray(scores) * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, error: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the binned scores of models that have seen neither."""
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    above_p, above_u = np.cumsum(positive[::-1])[::-1] / n, np.cumsum(unlabelled[::-1])[::-1] / m
    slack = np.sqrt(np.log(4 / error) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    some = above_p > 0
    best = int(np.argmin((above_u[some] + slack) / above_p[some]))
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.01, 0.99))


def first_models(positive: list[bytes], unlabelled: list[list[bytes]], rounds: int = 25) -> list[Linear]:
    """For each half of the unlabelled rows a model that tells it from the positives of the same half."""
    out = []
    for half in (0, 1):
        good, rest = positive[half::2], unlabelled[half]
        fit = Trainer([*good, *rest])
        y = np.concatenate((np.ones(len(good)), np.zeros(len(rest))))
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
        for _ in range(rounds):
            fit.step(weight * (sigmoid(fit.margins()) - y), rate=0.5)
        out.append(Linear(fit.model.tables, fit.model.bias))
    return out


def unseen(models: list[Linear], positive: list[bytes]) -> np.ndarray:
    """The binned scores of the positives, each by the model of the other half."""
    return sum(binned(models[half].scores(pa.array(positive[1 - half :: 2], pa.large_binary()))) for half in (0, 1))


def corpus_bins(docs: DataFrame, models: list[Linear]) -> np.ndarray:
    """The binned scores of all rows of docs(doc_id, text), each by the model of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in sliced(batches, 1):
            half = batch.column(0).to_numpy(zero_copy_only=False)
            for i in (0, 1):
                counts += binned(models[1 - i].scores(batch.column(1).filter(pa.array(half == i))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(counts)], ["bin", "n"])

    rows = docs.select(sample_key().bitwiseAND(F.lit(1).cast("long")).alias("half"), "text").mapInArrow(run, "bin long, n long")
    out = np.zeros(BINS, np.int64)
    for r in rows.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def fit_pu(positive: list[bytes], unlabelled: list[bytes], prior: float, rounds: int = ROUNDS) -> Linear:
    """The non-negative risk's minimiser by gradient steps over both whole samples."""
    fit = Trainer([*positive, *unlabelled])
    p, u = len(positive), len(unlabelled)
    fit.model.bias = 0.0
    for _ in range(rounds):
        s = sigmoid(fit.margins())
        slope = s * (1 - s)
        bracket = s[p:].mean() - prior * s[:p].mean()
        good, rest = -prior * slope[:p] / p, slope[p:] / u
        bad = -prior * slope[:p] / p  # of -prior * E_p[l(-g)]
        g = np.concatenate((good + bad, rest)) if bracket >= 0 else -np.concatenate((bad, rest))
        fit.step(4 * g, rate=0.5)
    return fit.model


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, known: list[bytes], labels: np.ndarray) -> Linear:
    """The model, calibrated on known texts with their labels, none of them among the positives. Without positives or
    unlabelled rows, the labels' share as a constant score."""
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.5
    if not positive or not unlabelled:
        model = Linear.new()
        model.scale, model.shift, model.empty = 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), share
        return model
    model = fit_pu(positive, unlabelled, prior)
    margins = Linear(model.tables, model.bias, 1.0, 0.0, 0.5).scores(pa.array(known, pa.large_binary()))
    margins = np.log(np.maximum(margins, 1e-300) / np.maximum(1 - margins, 1e-300))
    model.scale, model.shift = platt(margins, labels)
    model.empty = float(sigmoid(model.scale * model.bias + model.shift))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, total: int = FIT_TOTAL) -> Linear:
    """Learn labels(doc_id, quality) from the rows that aren't held out."""
    known, y = labelled_sample(docs, labels, "quality", rows, chars)
    place = np.zeros(len(y), np.int64)
    for c in (0, 1):
        place[y == c] = np.arange((y == c).sum())
    apart = place % APART == APART - 1
    positive = [t for t, v, a in zip(known, y, apart, strict=True) if v == 1 and not a]
    free = docs.where(id_crc(F.col("doc_id")) % FOLDS != 0)
    keys, texts = unlabelled_sample(free, 2 * rows, total)
    prior = 0.5
    if positive and texts:
        models = first_models(positive, [[t for t, k in zip(texts, keys, strict=True) if k & 1 == half] for half in (0, 1)])
        seen = unseen(models, positive)
        released()  # before the pass over the corpus, and after the second fit
        prior = class_prior(seen, corpus_bins(free, models))
    model = train(positive, texts, prior, [t for t, a in zip(known, apart, strict=True) if a], y[apart])
    del known, positive, texts
    released()
    return model


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text). Null and wordless texts get the score of the bias alone.
    Repeated rows each get a row; other columns are not read; an empty table has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that score at least the threshold, all columns, whatever their names, as they are.

    Null and wordless texts score as the bias alone, so they stay or go together; repeated rows too. An empty table
    stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= threshold))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (id_crc(F.col("doc_id")) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
