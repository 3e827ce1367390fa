"""Quality classification from weak labels.

Heuristic labellers vote good, bad, or nothing on each text. Expectation-maximisation over the counts of
vote patterns estimates how each labeller votes on good and on bad texts, without any true label,
and so each pattern's probability of being good. These posteriors are the labels from which a
linear scorer over hashed features is learned; the scorer judges every text, also those on which the
labellers say little.

Features: character classes of four neighbouring bytes, hashed words, and words that equal the word
before. Counts are taken as shares of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.rows import column, schema
from tablewarden.llm.words import buffers, hashed_words

# Several look at the same fault from different sides; where a text only lacks the fault, most say nothing.
LABELLERS = ("symbols", "plain_words", "capitals", "exclamations", "bars", "top_word", "repeats", "distinct", "word_length", "digits", "lines")
# The scorer is fitted on so many texts at most, chosen by their hashes, in one task.
SAMPLE = 8_000
EPOCHS, RATE, L2 = 40, 2.0, 1e-5
GRAMS, WORDS = 1 << 12, 1 << 12
DIMENSIONS = GRAMS + WORDS + 1
ROUNDS = 200
_CHUNK = 256

_CLASS = np.full(256, 6, np.uint8)  # other symbols
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[ord("!")] = 7


def _words(texts: pa.Array) -> list[np.ndarray]:
    return [ids[a:b] for _, ids, bounds in hashed_words(texts) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _vote(value: float, good: float, bad: float) -> int:
    """1 up to `good`, -1 from `bad` on, else 0."""
    return 1 if value <= good else -1 if value >= bad else 0


def _votes(data: np.ndarray, words: np.ndarray) -> str:
    """A character per labeller: + good, - bad, 0 nothing, blank where a text is too short for it."""
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    kinds = _CLASS[data]
    counts = np.bincount(kinds, minlength=8)
    letters, chars = max(int(counts[0] + counts[1] + counts[3]), 1), max(len(data) - int(counts[4]), 1)
    kinds_of_words = np.unique(words, return_counts=True)[1]
    again = np.count_nonzero(words[1:] == words[:-1]) / n
    # words end before white space; those that end in a symbol are not plain
    ends = kinds[:-1][kinds[1:] == 4]
    odd = np.count_nonzero(ends >= 6) / n
    votes = (
        _vote(counts[6] / chars, -1, 0.05),
        _vote(odd, 0.02, 0.2),
        _vote(counts[1] / letters, -1, 0.5),
        _vote(counts[7] / n, -1, 0.3),
        _vote(np.count_nonzero(data == 124) / n, -1, 0.2),
        _vote(int(kinds_of_words.max()) / n, 0.2, 0.4) if n >= 20 else None,
        _vote(again, 0.02, 0.2) if n >= 10 else None,
        _vote(-len(kinds_of_words) / n**0.75, -1.2, -0.4) if n >= 20 else None,
        _vote(abs(chars / n - 6), 2.5, 8),
        _vote(counts[2] / chars, -1, 0.3),
        _vote(np.count_nonzero(data == 10) / n, -1, 0.7),
    )
    return "".join(" " if v is None else "-0+"[v + 1] for v in votes)


def votes(texts: DataFrame) -> DataFrame:
    """Adds `votes`, a string with a character per labeller, to columns `at` and `text` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            found = [_votes(data[a:b], w) for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), _words(batch.column(1)), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["at", "votes"])

    return texts.select("at", "text").mapInArrow(run, "at long, votes string")


def expectation_maximisation(patterns: dict[str, int]) -> tuple[dict[str, float], np.ndarray]:
    """The probability of good for each pattern, and each labeller's accuracy on good and on bad texts.

    Two classes; labellers are independent given the class, and a blank says nothing. Starts from bad for any bad vote. Beliefs
    about labellers (a bad vote is rare on good texts) weigh as much as 2% of the texts, so that a fault
    that a single labeller sees is not explained away as that labeller's error.
    """
    if not patterns:
        return {}, np.zeros((len(LABELLERS), 2))
    names = sorted(patterns)
    table = np.array([["-0+ ".index(c) for c in name] for name in names])
    hot = np.eye(4)[table][:, :, :3]
    weight = np.array([patterns[n] for n in names], dtype=float)
    belief = max(2.0, 0.02 * weight.sum())
    beliefs = belief * np.array([[0.01, 0.495, 0.495], [0.4, 0.4, 0.2]])
    posterior = np.where((table == 0).any(axis=1), 0.02, 0.98)
    for _ in range(ROUNDS):
        prior = np.clip((weight * posterior).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        rates = [np.einsum("p,plc->lc", weight * p, hot) + b for p, b in zip((posterior, 1 - posterior), beliefs, strict=True)]
        rates = [r / r.sum(axis=1, keepdims=True) for r in rates]
        odds = np.log(prior / (1 - prior)) + np.einsum("plc,lc->p", hot, np.log(rates[0]) - np.log(rates[1]))
        posterior = 1 / (1 + np.exp(-odds))
    return dict(zip(names, posterior.tolist(), strict=True)), np.stack([1 - rates[0][:, 0], rates[1][:, 0]], axis=1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of shares per text."""
    offsets, data = buffers(texts)
    table = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, (a, b, words) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), _words(texts), strict=True)):
        kinds = _CLASS[data[a:b]].astype(np.int32)
        if len(kinds) > 3:
            grams = (kinds[:-3] << 9) | (kinds[1:-2] << 6) | (kinds[2:-1] << 3) | kinds[3:]
            table[i, :GRAMS] = np.bincount(grams, minlength=GRAMS) / len(grams)
        if len(words):
            table[i, GRAMS:-1] = np.bincount((words % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(words)
            table[i, -1] = np.count_nonzero(words[1:] == words[:-1]) / len(words)
    return np.sqrt(table)


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic regression on soft labels, by plain gradient steps over the whole sample."""
    rows, labels = [], []
    for batch in batches:
        for begin in range(0, batch.num_rows, _CHUNK):
            rows.append(features(batch.column(0).slice(begin, _CHUNK)).astype(np.float16))
        labels.append(batch.column(1).to_numpy())
    if not rows:
        return
    y = np.concatenate(labels)
    # both classes weigh the same
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights, bias = np.zeros(DIMENSIONS), 0.0
    for epoch in range(EPOCHS):
        at, gradient, shift = 0, np.zeros(DIMENSIONS), 0.0
        for part in rows:
            x, t = part.astype(np.float32), y[at : at + len(part)]
            at += len(part)
            p = 1 / (1 + np.exp(-(x @ weights + bias)))
            error = (p - t) * np.where(t > 0.5, 0.5 / share, 0.5 / (1 - share))
            gradient += x.T @ error
            shift += error.sum()
        weights -= RATE * 10 * (gradient / len(y) + L2 * weights)
        bias -= RATE * shift / len(y)
    yield pa.record_batch([pa.array([[*weights.tolist(), bias]], pa.list_(pa.float64()))], names=["weights"])


def classified(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.25) -> DataFrame:
    """`row` (all columns of `docs` but the text as a struct), posterior, score, kept (score >= threshold).

    The threshold leans to keeping: a word or two alone say little. A null text is empty. A text without
    words is bad: its score is 0. An empty table gives no rows. Rows that repeat count each in the votes, and once in the
    sample. Where no text can be sampled, the score is the posterior.
    """
    spark = docs.sparkSession
    rest = F.struct(*[column(c) for c in docs.columns if c != text_col])
    rows = docs.select(F.monotonically_increasing_id().alias("at"), rest.alias("row"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    patterns = {r.votes: r["count"] for r in votes(rows).groupBy("votes").count().collect()}
    posteriors, _ = expectation_maximisation(patterns)

    # about as many distinct texts as asked pass the bound on hashes, wherever they are
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    bound = int((1 << 30) * min(1.0, sample / max(distinct, 1)))
    picked = rows.select(F.xxhash64("text").alias("hash"), "text").where(F.col("hash").bitwiseAND(F.lit((1 << 30) - 1)) < bound)
    picked = picked.groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash").limit(sample).select(F.lit(0).cast("long").alias("at"), "text")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            found = [posteriors[_votes(data[a:b], w)] for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), _words(batch.column(1)), strict=True)]
            yield pa.record_batch([batch.column(1), pa.array(found, pa.float64())], names=["text", "label"])

    fitted = picked.mapInArrow(labelled, "text string, label double").coalesce(1).mapInArrow(fit, "weights array<double>").collect()
    weights = np.array(fitted[0].weights) if fitted else None
    shared = spark.sparkContext.broadcast((weights, posteriors))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posteriors = shared.value
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            words = _words(batch.column(1))
            found = [posteriors[_votes(data[a:b], w)] for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), words, strict=True)]
            if weights is None:
                scores = np.array(found, float)
            else:
                parts = [features(batch.column(1).slice(i, _CHUNK)) @ weights[:-1] + weights[-1] for i in range(0, batch.num_rows, _CHUNK)]
                scores = 1 / (1 + np.exp(-np.concatenate([np.zeros(0), *parts])))
            scores = np.where([len(w) > 0 for w in words], scores, 0.0)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64()), pa.array(scores, pa.float64())], names=["row", "posterior", "score"])

    judged = rows.select("row", "text").mapInArrow(judge, schema(rows, "row", after="posterior double, score double"))
    return judged.select("*", (F.col("score") >= threshold).alias("kept"))
