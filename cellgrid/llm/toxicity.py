"""Toxicity by class-conditional Kneser-Ney models of the bytes in words.

Both classes have a model of order ``ORDER`` over the bytes of a word, with word edges.
The highest order uses each class's own counts; below it both share one interpolated
Kneser-Ney model of continuation counts, so what neither class has seen often has nearly
equal likelihoods and rare compounds are judged by the parts they share with known ones.

A word's evidence is its log-likelihood ratio.  A document's features are the mean ratio
per word, and the mean of what exceeds ``MARGIN``; both are normalised by length.  A logistic
curve, fitted on labelled documents that the counts have not seen, turns them into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map, write_table
from cellgrid.llm.words import Lexer, Words, find_words, slices

ORDER, DISCOUNT, MARGIN, THRESHOLD = 5, 0.75, 2.0, 0.3
SAMPLE = 20_000  # bound of labelled documents that the model is fitted on: those of smallest hash
SAMPLE_BYTES = 1 << 16  # longer documents are scored but not fitted on
WORDS = Lexer("alnum", lower=True)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_EIGHT = np.uint64(8)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's kind, first place of each kind)."""
    code, kinds = pd.factorize(words.hash)
    first = np.zeros(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def word_grams(words: Words, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``at``, bytes of the n-gram as one number) for each byte of the words ``at`` and for their ends."""
    sizes = words.end[at] - words.start[at] + 1
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(len(owner)) - (ends - sizes)[owner]
    source = words.start[at][owner] + place
    last = place == sizes[owner] - 1
    symbols = np.where(last, 0, _FOLD[words.data[np.minimum(source, len(words.data) - 1)]] if len(words.data) else 0).astype(np.uint64)
    grams = np.zeros(len(owner), np.uint64)
    for k in range(order - 1, -1, -1):  # before a word stands symbol 1
        grams = (grams << _EIGHT) | np.where(place >= k, symbols[np.maximum(np.arange(len(owner)) - k, 0)], np.uint64(1))
    return owner, grams


@dataclass
class Ratios:
    """Log-likelihood ratios: of n-grams seen in either class, and of known contexts before anything else."""

    grams: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams))
        contexts = grams >> _EIGHT
        a = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        b = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.grams[a] == grams, self.values[a], np.where(self.contexts[b] == contexts, self.backoff[b], 0.0))

    def features(self, words: Words, rows: int, margin: float = MARGIN) -> np.ndarray:
        """(rows, 2): mean ratio per word, mean excess over the margin; zeros without words."""
        if not len(words):
            return np.zeros((rows, 2))
        code, first = distinct(words)
        owner, grams = word_grams(words, first)
        ratio = np.bincount(owner, self.of(grams), len(first))[code]
        n = np.maximum(np.diff(words.first), 1)
        return np.stack([np.bincount(words.doc, x, rows) / n for x in (ratio, np.maximum(ratio - margin, 0))], 1)


def fit(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> Ratios:
    """Ratios from the counts of each class; ``grams`` are distinct and sorted."""
    if not len(grams):
        return Ratios(grams, np.zeros(0), grams, np.zeros(0))
    low_bytes = lambda n: np.uint64((1 << (8 * n)) - 1)
    continuation, longer = {}, grams
    for n in range(order - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        continuation[n] = np.unique(longer & low_bytes(n), return_counts=True)
        longer = continuation[n][0]
    lower = None
    for n in range(1, order):
        keys, counts = continuation[n]
        _, context = np.unique(keys >> _EIGHT, return_inverse=True)
        total, kinds = np.bincount(context, counts), np.bincount(context)
        below = np.full(len(keys), 1 / 257) if lower is None else lower[1][np.searchsorted(lower[0], keys & low_bytes(n - 1))]
        lower = keys, (np.maximum(counts - discount, 0) + discount * kinds[context] * below) / total[context]
    shared = lower[1][np.searchsorted(lower[0], grams & low_bytes(order - 1))]
    contexts, context = np.unique(grams >> _EIGHT, return_inverse=True)
    logs = []
    for counts in (toxic, ordinary):
        total, kinds = np.bincount(context, counts), np.bincount(context, counts > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)  # a context the class lacks is all backoff
        logs.append((np.log(np.maximum(counts - discount, 0) / np.maximum(total, 1)[context] + weight[context] * shared), np.log(weight)))
    return Ratios(grams, logs[0][0] - logs[1][0], contexts, logs[0][1] - logs[1][1])


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (intercept first) by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.diag([1e-6, *[1e-3] * (len(w) - 1)])
        step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge * len(x) * np.array([0, *[1e-3] * (len(w) - 1)]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def shaped(features: np.ndarray) -> np.ndarray:
    return np.column_stack([features[:, 0], np.sqrt(features[:, 1])])


@dataclass
class Model:
    ratios: Ratios
    weights: np.ndarray

    def scores(self, words: Words, rows: int) -> np.ndarray:
        z = self.weights[0] + shaped(self.ratios.features(words, rows)) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents (null labels and ids are none, of several labels the largest counts).

    Three quarters of them give the counts, the rest the logistic curve.  If either part
    lacks a class, every score is the share of toxic documents in the sample.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    fitted_on = write_table(picked.select("toxic", "text", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0).alias("curve")), "labelled")

    def count(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            words = find_words(piece.column("text"), WORDS)
            if not len(words):
                continue
            code, first = distinct(words)
            owner, grams = word_grams(words, first)
            toxic = np.asarray(piece.column("toxic"), np.int64)[words.doc]
            weight = [np.bincount(code, toxic == c, len(first)).astype(np.int64)[owner] for c in (1, 0)]
            sums = pd.DataFrame({"gram": grams.view(np.int64), "toxic": weight[0], "ordinary": weight[1]}).groupby("gram", as_index=False).sum()
            yield pa.RecordBatch.from_pandas(sums, preserve_index=False)

    counted = arrow_map(fitted_on.filter("not curve").select("toxic", "text"), count, "gram long, toxic long, ordinary long")
    table = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas().sort_values("gram")  # bounded by the sample
    ratios = fit(table["gram"].to_numpy(np.int64).view(np.uint64), table["toxic"].to_numpy(np.int64), table["ordinary"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def measure(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            found = shared.value.features(find_words(piece.column("text"), WORDS), piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("toxic").cast(pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["toxic", "mean", "excess"])

    points = arrow_map(fitted_on.filter("curve").select("toxic", "text"), measure, "toxic long, mean double, excess double").orderBy("toxic", "mean", "excess").toPandas()
    if table[["toxic", "ordinary"]].sum().min() == 0 or points["toxic"].nunique() < 2:
        rate = float(points["toxic"].mean()) if len(points) else 0.0
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(ratios, np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    return Model(ratios, logistic(shaped(points[["mean", "excess"]].to_numpy()), points["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  A null or empty text has no evidence; its score is that of a document of neutral words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            found = shared.value.scores(find_words(piece.column("text"), WORDS), piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    scored = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
