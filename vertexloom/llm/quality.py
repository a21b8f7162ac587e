"""Quality classifier: random-indexing word vectors, pooled, into a calibrated two-layer network.

Random indexing: each token has a sparse ternary index vector drawn from its hash, so no token is unknown; a word's
context vector is the sum of the index vectors of its neighbours in the sample.  A document is the mean of its
tokens' vectors: the index vector, and for the words of the vocabulary their context vector (both of unit length).
Beside words, the tokens are runs of digits and of other signs, and markers for capitals and repeats,
since quality shows in form as much as in words.  A two-layer numpy network gives a logit, divided by a
temperature that is fitted on rows the network didn't see.

The network's first layer is linear, and so is the mean: when documents are scored, each token's vector is taken through
that layer once, and the products are pooled.

Fitted on a bounded sample: the ``sample_rows`` labelled rows with the smallest hash of their id, and
context vectors for their ``vocabulary`` most frequent tokens.  Of rows that share an id the text with the smallest
hash is learnt.  Scoring covers every row and every token of it, in very long texts too.  The text is the only input of a score.

Null and empty texts are pooled to a zero vector and scored like any other.  With no labelled row, as in an empty table, the
score is 0.5, with one class alone its share.  Repeated rows and ties are scored alike.  Extra columns are kept; ``score`` (or the
name chosen for it) is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.llm.base import arrow_batches, id_text, slices, stage
from vertexloom.llm.pieces import _appended, _with

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
DIMENSIONS, NONZERO, REACH = 256, 8, 2
CAPITALS, REPEAT = "<capitals>", "<repeat>"
#: Rows in a batch that is sent to Python.
BATCH = 500
#: Tasks of the fit, over the bounded sample; blocks that the sums of context vectors are added up in.
FIT_TASKS, BLOCKS = 12, 8
#: Tokens whose products a worker remembers beside the vocabulary, and the longest among them; tokens pooled at once.
REMEMBERED, LONGEST, POOLED = 200_000, 64, 1 << 18


def tokens_of(text: str | None) -> list[str]:
    """Lower-case tokens; a marker follows a word in capitals and a word that repeats the last."""
    out, last = [], None
    for token in TOKENS.findall(text) if text else ():
        low = token.lower()
        out.append(low)
        if low == last:
            out.append(REPEAT)
        if token is not low and len(token) > 1 and token.isupper():
            out.append(CAPITALS)
        last = low
    return out


def index_entries(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word's index vector the NONZERO dimensions and signs, from two hashes of the word alone."""
    at = np.array([xxhash.xxh64_intdigest(w.encode(), seed=17) for w in words], dtype="<u8").view(np.uint8).reshape(-1, NONZERO)
    bits = np.array([xxhash.xxh64_intdigest(w.encode(), seed=18) & 255 for w in words], dtype=np.uint8)
    signs = 1 - 2 * ((bits[:, None] >> np.arange(NONZERO, dtype=np.uint8)) & 1).astype(np.float32)
    return at.astype(np.int64), signs


def index_vectors(words: list[str]) -> np.ndarray:
    """NONZERO entries of +1 or -1 for each word, scaled to unit length (where no two fall on one place)."""
    out = np.zeros((len(words), DIMENSIONS), dtype=np.float32)
    at, signs = index_entries(words)
    np.add.at(out, (np.arange(len(words))[:, None], at), signs / np.float32(NONZERO**0.5))
    return out


class Pooler:
    """Means of the tokens' vectors, taken through a linear ``layer`` (none: as they are)."""

    def __init__(self, words: list[str], vectors: np.ndarray, layer: np.ndarray | None = None) -> None:
        self.layer = np.eye(DIMENSIONS, dtype=np.float32) if layer is None else layer.astype(np.float32)
        self.words, self.known = words, vectors @ self.layer
        self.forget()

    def forget(self) -> None:
        self.at, self.products = {w: i for i, w in enumerate(self.words)}, self.known

    def learn(self, tokens: set[str]) -> None:
        """Products of tokens that aren't known yet."""
        new = sorted(tokens.difference(self.at))
        start = len(self.products)
        self.at.update((w, start + i) for i, w in enumerate(new))
        self.products = np.concatenate([self.products] + [index_vectors(new[i : i + 4096]) @ self.layer for i in range(0, len(new), 4096)])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.at) - len(self.words) > REMEMBERED:
            self.forget()
        out = np.zeros((len(texts), self.layer.shape[1]), dtype=np.float64)
        split = [tokens_of(t) for t in texts]
        everyone = set().union(*split)
        if long := {w: shortened(w) for w in everyone if len(w) > LONGEST}:
            split = [[long.get(w, w) for w in words] for words in split]
            everyone = everyone.difference(long).union(long.values())
        self.learn(everyone)
        for i, words in enumerate(split):
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            for start in range(0, len(at), POOLED):
                out[i] += self.products[at[start : start + POOLED]].sum(axis=0, dtype=np.float64)
            if len(at):
                out[i] /= len(at)
        return out


def shortened(word: str) -> str:
    """A name of fixed length for a very long token."""
    return f"<{xxhash.xxh64_hexdigest(word.encode())}>"


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Probabilities of texts; the linear layer is applied to tokens instead of documents."""

    def __init__(self, model: Model) -> None:
        self.model = model
        if model.constant is None:
            w1, b1 = model.weights[:2]
            layer = w1 / model.spread[:, None]
            self.pooler, self.bias = Pooler(model.words, model.vectors, layer), b1 - model.mean @ layer

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        w2, b2 = self.model.weights[2:]
        z = (np.maximum(self.pooler(texts) + self.bias, 0) @ w2 + b2)[:, 0]
        return 1 / (1 + np.exp(-np.clip(z / self.model.temperature, -500, 500)))


def logits(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0].astype(np.float64)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> list[np.ndarray]:
    """Two layers, by Adam on the whole sample's log loss."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        inner = x @ weights[0] + weights[1]
        active = np.maximum(inner, 0)
        z = (active @ weights[2] + weights[3])[:, 0]
        error = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y))[:, None]
        back = (error @ weights[2].T) * (inner > 0)
        for i, g in enumerate((x.T @ back + decay * weights[0], back.sum(axis=0), active.T @ error + decay * weights[2], error.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Of a fixed grid, the one with the least log loss on unseen rows."""
    grid = np.geomspace(0.25, 8, 41)
    return float(min(grid, key=lambda t: float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)))))


def context_sums(texts: list[str], row: dict[str, int], size: int) -> np.ndarray:
    """For each word of ``row`` the sum of the index vectors of its neighbours in the texts, as ``size`` rows."""
    total = np.zeros(size * DIMENSIONS)
    split = [tokens_of(t) for t in texts]
    everyone = sorted({w for words in split for w in words})
    place = {w: i for i, w in enumerate(everyone)}
    dims, signs = index_entries(everyone)
    rows = np.array([row.get(w, -1) for w in everyone], dtype=np.int64)
    tokens = np.array([place[w] for words in split for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
    for offset in range(1, REACH + 1):
        left, right = tokens[:-offset], tokens[offset:]
        same = owner[offset:] == owner[:-offset]
        for word, near in ((left[same], right[same]), (right[same], left[same])):
            word, near = rows[word], near
            near, word = near[word >= 0], word[word >= 0]
            at = word[:, None] * DIMENSIONS + dims[near]
            total += np.bincount(at.ravel(), weights=signs[near].ravel(), minlength=len(total))
    return total.reshape(size, DIMENSIONS).astype(np.float32)


def _context_vectors(sample: DataFrame, words: list[str]) -> np.ndarray:
    """Context vectors of ``words``, of unit length: every task adds up its texts, and blocks of words are added up over the tasks."""
    row = {w: i for i, w in enumerate(words)}
    each = max(1, -(-len(words) // BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(words), DIMENSIONS), np.float32)
        for batch in slices(batches, 100):
            total += context_sums(batch.column(0).to_pylist(), row, len(words))
        parts = [(i, total[i * each : (i + 1) * each].tobytes()) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["block", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in sorted(frame["sums"]))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    added = sample.select("text").repartition(FIT_TASKS).mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect()
    sums = np.concatenate([np.empty(0, np.float32)] + [np.frombuffer(r["sums"], dtype=np.float32) for r in sorted(added, key=lambda r: r["block"])]).reshape(-1, DIMENSIONS)
    sums = sums if len(sums) else np.zeros((len(words), DIMENSIONS), np.float32)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 6000, vocabulary: int = 20000) -> Model:
    """Fitted on rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, ``label`` 0 or 1) marks."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    texts = docs.where("text is not null").select("doc_id", "text")
    chosen = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(id_text(F.col("doc_id"))), "doc_id").limit(sample_rows)
    # Of a repeated id one text, whatever the order of the rows; partial sums come before the shuffle.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sample = stage(one.select("doc_id", "label", F.col("t.text").alias("text")), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            words = Counter(w for t in batch.column("text").to_pylist() for w in tokens_of(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    counted = sample.select("text").mapInArrow(count, "word string, n long").where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    with arrow_batches(spark, BATCH):
        words = [r["word"] for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    vectors = _context_vectors(sample, words) + index_vectors(words)
    sent = spark.sparkContext.broadcast((words, vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(*sent.value)
        for batch in slices(batches, 250):
            x = pooler(batch.column("text").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = sample.select(F.col("doc_id").cast("string"), F.col("label").cast("int"), "text").repartition(FIT_TASKS).mapInArrow(pool, "doc_id string, label int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(words, vectors, np.zeros(DIMENSIONS), np.ones(DIMENSIONS), [], 1.0, float(y[0]) if len(y) else 0.5)
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    unseen = np.array([xxhash.xxh32_intdigest(r["doc_id"]) % 5 == 0 for r in rows])
    if len(set(y[~unseen])) < 2 or len(set(y[unseen])) < 2:
        unseen[:] = False
    weights = train(x[~unseen], y[~unseen])
    temperature = best_temperature(logits(x[unseen], weights), y[unseen]) if unseen.any() else 1.0
    return Model(words, vectors, mean, spread, weights, temperature)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the probability that a text's label is 1."""
    schema = _appended(docs, {into: T.DoubleType()})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in slices(batches, 500):
            yield _with(batch, schema, {into: pa.array(scorer(batch.column(text).to_pylist()), pa.float64())})

    return docs.mapInArrow(run, schema)
