"""Language of texts by hyperdimensional profiles.

Every letter has a random hypervector of +1 and -1; an n-gram's vector binds its letters' vectors, each rotated by
its place, by multiplication; a language's prototype bundles the n-gram vectors of its learning texts, less the mean
of all languages. A document's profile is the bundle of its own n-gram vectors. Its cosine with a prototype needs no
bundle per document: the inner product with a prototype is the sum of the n-grams' inner products, which each
worker computes once per n-gram, and the norm of a bundle of nearly orthogonal vectors is the root of the summed
squared counts times the dimension.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendloom.llm import labelled
from spendloom.llm.stored import cut, shipped, written

SAMPLE_ROWS = 3000  # for each language
SAMPLE_TASKS = 8
SALTS = 64
DIMENSION = 2048
LETTERS = 3
UNKNOWN = "und"
_SHARP = 25.0
_BLOCK = 1 << 20
_BITS = 17  # of a letter's number in an n-gram


class Space:
    """Letters' hypervectors and n-grams of texts; 0 stands for a run of characters that are no letters."""

    def __init__(self) -> None:
        self.number = np.full(0x110000, -1, dtype=np.int64)
        self.letters: list[int] = [0]
        self.vectors = self._draw(0)[None, :]

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()

    @staticmethod
    def _draw(code: int) -> np.ndarray:
        return np.random.default_rng(code + 1).integers(0, 2, DIMENSION, dtype=np.int8) * 2 - 1

    def _learn(self, codes: np.ndarray) -> None:
        new = []
        for code in np.unique(codes).tolist():
            if chr(code).isalpha():
                self.number[code] = len(self.letters)
                self.letters.append(code)
                new.append(self._draw(code))
            else:
                self.number[code] = 0
        if new:
            self.vectors = np.vstack([self.vectors, *new])

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, n-gram, count) of distinct n-grams in ascending order, and which rows have a letter."""
        low = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
        codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        if (unseen := self.number[codes] < 0).any():
            self._learn(codes[unseen])
        number = self.number[codes]
        row = np.repeat(np.arange(len(low)), sizes)
        has = np.bincount(row[number > 0], minlength=len(low)) > 0
        keep = number > 0
        keep[1:] |= number[:-1] > 0
        number, row = number[keep], row[keep]
        n = len(number) - LETTERS + 1
        if n <= 0:
            return *(np.zeros(0, np.int64) for _ in range(3)), has
        gram = np.zeros(n, np.int64)
        for k in range(LETTERS):
            gram = (gram << _BITS) | number[k : n + k]
        whole = row[:n] == row[LETTERS - 1 :]
        key, count = np.unique((row[:n][whole] << (_BITS * LETTERS)) | gram[whole], return_counts=True)
        return key >> (_BITS * LETTERS), key & ((1 << (_BITS * LETTERS)) - 1), count, has

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Hypervectors of n-grams."""
        out = np.ones((len(grams), DIMENSION), dtype=np.int8)
        for k in range(LETTERS):
            number = (grams >> (_BITS * (LETTERS - 1 - k))) & ((1 << _BITS) - 1)
            out *= np.roll(self.vectors[number], k, axis=1)
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """Sum of the n-gram vectors of all texts."""
        total = np.zeros(DIMENSION)
        for group in _groups(texts):
            _, gram, count, _ = self.grams(group)
            distinct, at = np.unique(gram, return_inverse=True)
            weight = np.bincount(at, weights=count, minlength=len(distinct))
            for start in range(0, len(distinct), 4096):
                total += weight[start : start + 4096] @ self.bind(distinct[start : start + 4096])
        return total


def _groups(texts: list[str]):
    """Runs of texts of about equal length together; at most 2,048 rows each, which an n-gram's key has room for."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= _BLOCK or len(group) == 2048:
            yield group
            group, held = [], 0
    if group:
        yield group


class Model:
    """Prototypes of the learned languages."""

    def __init__(self, bundles: dict[str, np.ndarray]) -> None:
        self.names = sorted(bundles)
        self.space = Space()
        raw = np.array([bundles[n] / max(np.linalg.norm(bundles[n]), 1e-9) for n in self.names]).reshape(-1, DIMENSION)
        if len(raw) > 1:
            raw = raw - raw.mean(axis=0)
        self.prototypes = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        self._start()

    def _start(self) -> None:
        self.known, self.inner = np.zeros(0, np.int64), np.zeros((0, len(self.names)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "inner")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _products(self, gram: np.ndarray) -> np.ndarray:
        """Inner product of each n-gram's vector with each prototype."""
        new = np.setdiff1d(gram, self.known)
        if len(new):
            if len(self.known) > 2_000_000:
                self._start()
                new = np.unique(gram)
            parts = [self.space.bind(new[s : s + 4096]) @ self.prototypes.T for s in range(0, len(new), 4096)]
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.inner = known[order], np.concatenate([self.inner, *parts])[order]
        return self.inner[np.searchsorted(self.known, gram)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for group in _groups(texts):
            row, gram, count, has = self.space.grams(group)
            if not self.names:
                names += [UNKNOWN] * len(group)
                scores += [0.0] * len(group)
                continue
            inner = self._products(gram)
            dot = np.array([np.bincount(row, inner[:, k] * count, len(group)) for k in range(len(self.names))]).T
            norm = np.sqrt(DIMENSION * np.bincount(row, count.astype(float) ** 2, len(group)))
            cosine = dot / np.maximum(norm, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            odds = np.exp(_SHARP * (cosine - cosine.max(axis=1, keepdims=True)))
            share = 1 / odds.sum(axis=1)
            names += [self.names[b] if h else UNKNOWN for b, h in zip(best, has)]
            scores += [float(s) if h else 0.0 for s, h in zip(share, has)]
        return names, scores


def train(docs: DataFrame, size: int = SAMPLE_ROWS) -> Model:
    """Prototypes from at most ``size`` texts of each language whose crc32 remainder mod 4 isn't 2."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (labelled.remainder("doc_id", 4) != 2)
    )
    ids = rows.select("doc_id", "lang").distinct()
    # First by language and salt, so that the ids of a language with most rows are cut in many tasks.
    for part in (("lang", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS))), ("lang",)):
        order = W.partitionBy(*part).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).drop("n")
    chosen = ids
    texts = cut(rows.join(written(chosen, "languages"), ["doc_id", "lang"], "left_semi").select("lang", "text").repartition(SAMPLE_TASKS))

    def bundles(batches):
        space, total = Space(), defaultdict(lambda: np.zeros(DIMENSION))
        for batch in batches:
            by_name = defaultdict(list)
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_name[name].append(text)
            for name, group in by_name.items():
                total[name] += space.bundle(group)
        names = list(total)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([total[n].tobytes() for n in names], pa.binary())], names=["lang", "sums"])

    # One vector of fixed size per language from each of SAMPLE_TASKS tasks.
    out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSION))
    for r in texts.mapInArrow(bundles, "lang string, sums binary").collect():
        out[r["lang"]] = out[r["lang"]] + np.frombuffer(r["sums"])
    return Model(dict(out))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs(doc_id, text, lang)``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. A text with letters but no
    n-gram gets the first language in order with equal shares. Repeated rows get equal results; null ids are kept
    and never held out; an empty table gives an empty result.
    """
    held = shipped(docs.sparkSession, model or train(docs))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, scores = held.value.predict([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (labelled.remainder("doc_id", 4) == 2).alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
