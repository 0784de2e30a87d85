"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Every term has a sparse random index vector. Over the words of the learning sample, a term's context vector sums the
index vectors of its left and right neighbours, each side under its own permutation; the term's word vector is its
index vector plus its scaled context vector. Two streams of terms are pooled by their mean: the words themselves,
and their shapes (runs of lower-case, upper-case, digits, and each punctuation mark; a word equal to the one before
has a shape of its own), which also describe words never seen. Terms share a table by their hash. A network of one
hidden layer reads the pooled vectors; a temperature fitted on rows kept aside calibrates its probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm import labelled
from spendloom.llm.stored import cut, shipped
from spendloom.llm.textblocks import Polynomial, map_batches, mix, words

SAMPLE_ROWS = 8000
SAMPLE_TASKS = 8
WIDTH = 64
WORD_SLOTS = 4096
SHAPE_SLOTS = 2048
HIDDEN = 32
THRESHOLD = 0.3
_REPEATED = 7

# Kind of each byte in a shape: 1 lower, 2 upper, 3 digit, others themselves; bytes above ASCII count as lower.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 1


def _index_vectors(slots: int, width: int = WIDTH, ones: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each slot's sparse index vector."""
    h = mix(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    shift = np.arange(ones, dtype=np.uint64) * np.uint64(12)
    part = h[:, None] >> shift[None, :]
    return (part % np.uint64(width)).astype(np.int64), 1.0 - 2.0 * ((part >> np.uint64(11)) & np.uint64(1)).astype(np.float64)


class Terms:
    """Slots of the words and shapes of texts."""

    def __init__(self) -> None:
        self.hashes = Polynomial()

    def __getstate__(self) -> dict:
        return {"hashes": Polynomial()}

    def streams(self, column: pa.Array):
        """(row, word slot, shape slot) of each block."""
        for b in words(column):
            if not len(b.row):
                continue
            h = self.hashes.spans(b.data, b.start, b.end)
            kind = _KIND[b.data]
            kept = np.ones(len(kind) + 1, dtype=bool)
            kept[1:-1] = kind[1:] != kind[:-1]
            kept[b.start] = True
            at = np.concatenate([[0], np.cumsum(kept[:-1])])
            shape = self.hashes.spans(kind[kept[:-1]], at[b.start], at[b.end])
            same = np.zeros(len(h), dtype=bool)
            same[1:] = (h[1:] == h[:-1]) & (b.row[1:] == b.row[:-1])
            shape[same] = _REPEATED
            yield b.row, (h % np.uint64(WORD_SLOTS)).astype(np.int64), (shape % np.uint64(SHAPE_SLOTS)).astype(np.int64)


def _contexts(row: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    position, sign = _index_vectors(slots)
    out = np.zeros(slots * WIDTH)
    joined = row[1:] == row[:-1]
    for turn, term, near in ((1, slot[1:][joined], slot[:-1][joined]), (2, slot[:-1][joined], slot[1:][joined])):
        for k in range(position.shape[1]):
            out += np.bincount(term * WIDTH + (position[near, k] + turn) % WIDTH, sign[near, k], slots * WIDTH)
    return out


def _vectors(contexts: np.ndarray, slots: int) -> np.ndarray:
    position, sign = _index_vectors(slots)
    own = np.zeros((slots, WIDTH))
    for k in range(position.shape[1]):
        np.add.at(own, (np.arange(slots), position[:, k]), sign[:, k])
    c = contexts.reshape(slots, WIDTH)
    return (own + c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1)).astype(np.float32)


class Model:
    """Word vectors and network; ``score`` gives the probability of label 1 for each text of a column."""

    def __init__(self, contexts: np.ndarray | None) -> None:
        if contexts is None:
            contexts = np.zeros((WORD_SLOTS + SHAPE_SLOTS) * WIDTH)
        self.terms = Terms()
        self.word = _vectors(contexts[: WORD_SLOTS * WIDTH], WORD_SLOTS)
        self.shape = _vectors(contexts[WORD_SLOTS * WIDTH :], SHAPE_SLOTS)
        self.layers: list[np.ndarray] | None = None
        self.constant, self.temperature = 0.5, 1.0

    def pooled(self, column: pa.Array) -> np.ndarray:
        """One vector per text: mean word vector, mean shape vector, log of the number of words."""
        n = len(column)
        out, count = np.zeros((n, 2 * WIDTH + 1)), np.zeros(n)
        for row, word, shape in self.terms.streams(column):
            first, rows = row[0], row[-1] - row[0] + 1
            for at, slot, table in ((0, word, self.word), (WIDTH, shape, self.shape)):
                times = np.bincount((row - first) * len(table) + slot, minlength=rows * len(table))
                out[first : first + rows, at : at + WIDTH] += times.reshape(rows, -1).astype(np.float32) @ table
            count += np.bincount(row, minlength=n)
        out[:, :-1] /= np.maximum(count, 1)[:, None]
        out[:, -1] = np.log1p(count)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> None:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        draw = np.random.default_rng(0)
        aside = draw.random(len(y)) < 0.2
        if len(np.unique(y[~aside])) < 2 or not aside.any():
            aside[:] = False
        self.middle, self.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
        z, t = self._standard(x[~aside]), y[~aside]
        layers = [
            draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
            draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
        ]
        first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        for step in range(1, rounds + 1):
            hidden = np.tanh(z @ layers[0] + layers[1])
            error = (_sigmoid(hidden @ layers[2] + layers[3]) - t) / len(t)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            steps = [z.T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            for k, g in enumerate(steps):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = layers
        if aside.any():
            logit = self._logit(x[aside])
            loss = {t: -np.mean(np.log(np.where(y[aside] == 1, p := _sigmoid(logit / t), 1 - p) + 1e-12)) for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(loss, key=loss.get))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, column: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(column), self.constant)
        return _sigmoid(self._logit(self.pooled(column)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels(doc_id, quality)``, learned from at most ``size`` rows whose crc32 remainder mod 5 isn't 0.

    Null labels don't count; a document once marked 0 is 0. Without labels every score is 0.5, with one class its
    share.
    """
    marks = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (labelled.remainder("doc_id", 5) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("mark"))
    )
    rows = cut(labelled.sample(docs, marks, size).repartition(SAMPLE_TASKS))

    def contexts(batches):
        total, terms = np.zeros((WORD_SLOTS + SHAPE_SLOTS) * WIDTH), Terms()
        for batch in batches:
            for row, word, shape in terms.streams(batch.column(0)):
                total[: WORD_SLOTS * WIDTH] += _contexts(row, word, WORD_SLOTS)
                total[WORD_SLOTS * WIDTH :] += _contexts(row, shape, SHAPE_SLOTS)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    # One array of fixed size from each of SAMPLE_TASKS tasks.
    sums = [np.frombuffer(r["sums"]) for r in rows.select("text").mapInArrow(contexts, "sums binary").collect()]
    model = Model(np.sum(sums, axis=0) if sums else None)
    held = shipped(docs.sparkSession, model)

    def pooled(batch: pa.RecordBatch):
        x = held.value.pooled(batch.column(1))
        vectors = pa.array([r.tobytes() for r in x], pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(2), vectors], names=["doc_id", "mark", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    learned = rows.selectExpr("doc_id", "text", "cast(mark as int) as mark").mapInArrow(
        map_batches(pooled), f"doc_id {kind}, mark int, x binary"
    )
    got = sorted(learned.collect(), key=lambda r: str(r["doc_id"]))  # at most ``size`` short vectors
    model.fit(
        np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), 2 * WIDTH + 1),
        np.array([r["mark"] for r in got], dtype=float),
    )
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality; null text counts as empty, and every row gets a score.

    Repeated rows get the same score; an empty table stays empty; a column named like the score is replaced.
    """
    held = shipped(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [held.value.score(texts.slice(at, 1024)) for at in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score_col, score(F.col(text_col)))


def scored(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    found = with_scores(docs.select("doc_id", "text"), train(docs, labels, size))
    return found.select(
        "doc_id",
        (labelled.remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
