"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary (never trained here).  A
word's probability is the sum over all its segmentations, by the forward algorithm; a text's is the
product over its words.  The piece probabilities are fitted by expectation maximisation: forward and
backward scores give each piece's expected count.

The classifier is fitted on a bounded sample of labelled rows: of each language those whose hash of id
and text falls under the share that gives ``rows_per_language`` rows, copies once, and of their words
the ``words_per_language`` most frequent; the ``languages`` labels with most rows are learnt, so that dirty labels
don't make it grow.  Scoring covers every row and every word of it; a run of letters of any length takes linear time and
holds the forward scores that a piece can reach back to.

Null texts and texts without a letter get ``und`` and score 0; with no labelled row at all, every text
does.  Rows that repeat are scored alike; extra columns are kept, but ``lang_pred`` and ``score`` (or the names chosen for them) are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vertexloom.llm.base import id_text, slices
from vertexloom.llm.pieces import MARK, MODEL, _appended, _with, common_prefix, vocabulary

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 150_000
#: Words longer than this are scored with the last few forward scores in hand instead of all.
LONG = 1000
#: Probability mass of a character that no piece covers, and the pieces' additive smoothing.
OUTSIDE, SMOOTHING = 1e-7, 0.01
#: Forward scores are scaled up, for all languages alike, where the largest falls below this.
RESCALE = 1e-120


def words_of(text: str | None) -> list[str]:
    """Marked lower-case runs of letters."""
    return [MARK + w for w in LETTERS.findall(text.lower())] if text else []


@dataclass
class Model:
    """``probability[piece]`` has one entry per language, in the order of ``languages``."""

    languages: list[str]
    probability: dict[str, tuple[float, ...]]
    longest: int


def expected_counts(words: Counter, probability: dict[str, float], longest: int) -> Counter:
    """Of each piece, over all segmentations of the counted words."""
    counts: Counter = Counter()
    for word, times in words.items():
        n = len(word)
        spans = [(i, j, p) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (p := probability.get(word[i:j], OUTSIDE if i == j - 1 else 0.0))]
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, p in spans:
            forward[j] += forward[i] * p
        for i, j, p in sorted(spans, key=lambda s: -s[0]):
            backward[i] += p * backward[j]
        if forward[n] > 0:
            for i, j, p in spans:
                counts[word[i:j]] += times * forward[i] * p * backward[j] / forward[n]
    return counts


def estimate(words: dict[str, Counter], path: str = MODEL, rounds: int = 2) -> Model:
    """Piece probabilities of each language from counts of its marked words."""
    vocab = vocabulary(path)
    languages = sorted(words)
    fitted = []
    for language in languages:
        probability = dict.fromkeys(vocab.table, 1 / len(vocab.table))
        for _ in range(rounds):
            counts = expected_counts(words[language], probability, vocab.longest)
            total = sum(counts[p] for p in vocab.table) + SMOOTHING * len(vocab.table)
            probability = {p: (counts[p] + SMOOTHING) / total for p in vocab.table}
        fitted.append(probability)
    return Model(languages, {p: tuple(f[p] for f in fitted) for p in vocab.table}, vocab.longest)


class Scorer:
    """Log-probabilities of words by language; words that share a prefix share its forward scores."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()
        #: Every ending of a piece, so that a search ends where no piece can go on.
        self.endings: dict[str, tuple[float, ...]] = {p[i:]: () for p in model.probability for i in range(1, len(p))} | model.probability

    def forget(self) -> None:
        """Row of each known word, and the matrix of (words x languages) log-probabilities."""
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        """Score the sorted, distinct ``words`` that aren't known yet."""
        new: list[list[float]] = []
        ending, n = self.endings.get, len(self.model.languages)
        outside = (OUTSIDE,) * n
        forward: list | dict = [(1.0,) * n]
        log_scale: list | dict = [0.0]
        before = ""
        for word in words:
            if long := len(word) > LONG:  # kept as far back as a piece reaches, and shared with no other word
                forward, log_scale, shared = {0: (1.0,) * n}, {0: 0.0}, 0
            else:
                shared = common_prefix(before, word)
                del forward[shared + 1 :], log_scale[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                total, last = [0.0] * n, log_scale[j - 1]
                for i in range(j - 1, -1, -1):
                    p = ending(word[i:j])
                    if not p and i == j - 1:
                        total = [a * b for a, b in zip(forward[i], outside)]  # noqa: B905
                    elif p is None:
                        break
                    elif p:
                        if log_scale[i] == last:
                            total = [t + a * b for t, a, b in zip(total, forward[i], p)]  # noqa: B905
                        else:
                            back = exp(log_scale[i] - last)
                            total = [t + a * b * back for t, a, b in zip(total, forward[i], p)]  # noqa: B905
                if (most := max(total)) < RESCALE:
                    scale = most or 1e-300
                    total, last = [max(t / scale, 1e-300) for t in total], last + log(scale)
                if long:
                    forward[j], log_scale[j] = total, last
                    forward.pop(j - self.model.longest - 1, None)
                    log_scale.pop(j - self.model.longest - 1, None)
                else:
                    forward.append(total)
                    log_scale.append(last)
            self.rows[word] = len(self.scores) + len(new)
            new.append([log(f or 1e-300) + log_scale[len(word)] for f in forward[len(word)]] if any(map(str.isalpha, word)) else [0.0] * n)
            before = word
            if long:
                forward, log_scale, before = [(1.0,) * n], [0.0], ""
        if new:
            self.scores = np.concatenate((self.scores, np.array(new)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) log-probabilities, and whether a text has a letter."""
        if len(self.rows) > REMEMBERED:
            self.forget()
        split = [words_of(t) for t in texts]
        self.learn(sorted({w for words in split for w in words}.difference(self.rows)))
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        at = np.fromiter((self.rows[w] for words in split for w in words), np.int64, int(sizes.sum()))
        scores = self.scores[at]
        sums = np.zeros((len(texts), len(self.model.languages)))
        if len(at):
            some = np.flatnonzero(sizes)
            sums[some] = np.add.reduceat(scores, (np.cumsum(sizes) - sizes)[some])
        return sums, sums.any(axis=1)


def fit(docs: DataFrame, label: str = "lang", usable: Column | None = None, rows_per_language: int = 1000, words_per_language: int = 5000, languages: int = 200, path: str = MODEL) -> Model | None:
    """The model of the labelled rows of ``docs`` (doc_id, text and ``label``) where ``usable`` holds.

    The ``languages`` labels with most rows are learnt, ties to the smaller label.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    share = rows.groupBy(label).agg(F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.count("*")).alias("share"), F.count("*").alias("n"))
    share = share.orderBy(F.desc("n"), F.col(label).cast("string")).limit(languages).drop("n")
    key = F.xxhash64(id_text(F.col("doc_id")), "text")
    drawn = rows.select(label, "text", key.alias("key")).join(F.broadcast(share), label)
    sample = drawn.where(F.pmod("key", F.lit(1 << 31)) < F.col("share") * (1 << 31)).dropDuplicates([label, "key"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            by: dict[str, Counter] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(language, Counter()).update(w for w in words_of(text))
            flat = [(k, w, c) for k, words in by.items() for w, c in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat, strict=True) if flat else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counted = sample.select(F.col(label).cast("string"), "text").mapInArrow(count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= words_per_language)
    words: dict[str, Counter] = {}
    for r in top.select("lang", "word", "n").collect():
        words.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return estimate(words, path) if words else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: str = "lang_pred", score_into: str = "score") -> DataFrame:
    """``docs`` with ``into`` and ``score_into``, the posterior of that language under equal priors; columns of these names are replaced."""
    schema = _appended(docs, {into: T.StringType(), score_into: T.DoubleType()})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model) if model else None
        for batch in slices(batches, 1000):
            texts = batch.column(text).to_pylist()
            if scorer is None:
                named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                sums, letters = scorer(texts)
                best = sums.argmax(axis=1)
                score = np.where(letters, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                named = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            yield _with(batch, schema, {into: pa.array(named, pa.string()), score_into: pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema)
