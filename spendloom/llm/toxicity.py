"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and word beginnings of a few lengths, restricted to those whose presence tells the labels
of the learning sample apart (likelihood-ratio test) and points to toxic ones. Their document frequencies are counted over the whole corpus.
The examples' unit vectors, ordered by their heaviest terms, form an inverted index in blocks of consecutive examples
that keeps, per term and block, the largest weight. A query visits blocks by descending bound and stops where no unseen example can enter its list,
so the neighbours are exact. Votes weighted by similarity give a share that a logistic curve, fitted on the examples
with each left out of its own list, turns into a probability; the neighbours are the evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm import labelled
from spendloom.llm.stored import cut, shipped
from spendloom.llm.textblocks import PUNCTUATION, Polynomial, map_batches, mix, words

SAMPLE_ROWS = 12_000
SAMPLE_TASKS = 8
TERMS = 4096
EVIDENCE = 20.0  # least likelihood ratio of a term
POINTED = 0.5  # least share of toxic examples among those with a term
BEGINNINGS = (4, 5, 6)
COPY_HASHES = 4
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.7


class Terms:
    """Terms of texts as 64-bit hashes: words, and their beginnings under a mark of their own."""

    def __init__(self) -> None:
        self.hashes = Polynomial()

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()

    def of(self, column: pa.Array):
        """(row, hash) of all terms, block by block."""
        for b in words(column, lower=True, gap=PUNCTUATION):
            if not len(b.row):
                continue
            yield b.row, self.hashes.spans(b.data, b.start, b.end).view(np.int64)
            for n in BEGINNINGS:
                long = b.end - b.start >= n
                h = self.hashes.spans(b.data, b.start[long], b.start[long] + n)
                yield b.row[long], (h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) with counts."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def without_copies(sample: DataFrame) -> DataFrame:
    """``sample(doc_id, text, mark)`` with one row of each group of near copies, so that copies don't count as evidence.

    Rows with an equal least hash over three-word runs, under any of COPY_HASHES hashes in turn, are copies; the least id
    stays. Texts without words go.
    """

    def least(batch: pa.RecordBatch):
        found = np.full((COPY_HASHES, batch.num_rows), np.iinfo(np.uint64).max, np.uint64)
        terms = Terms()
        for b in words(batch.column(1), lower=True, gap=PUNCTUATION):
            if len(b.row):
                h = terms.hashes.spans(b.data, b.start, b.end)
                run = h.copy()
                for k in (1, 2):
                    inside = np.flatnonzero(b.row[k:] == b.row[:-k])
                    run[inside] += h[inside + k] * np.uint64(2 * k + 1)
                for k in range(COPY_HASHES):
                    np.minimum.at(found[k], b.row, mix(run + np.uint64(k)))
        some = pa.array(found[0] < np.iinfo(np.uint64).max)
        columns = [*batch.columns, *(pa.array(f.view(np.int64)) for f in found)]
        yield pa.record_batch(columns, names=[*batch.schema.names, *copies]).filter(some)

    copies = [f"copy{k}" for k in range(COPY_HASHES)]
    kind = sample.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, text string, mark int, " + ", ".join(f"{c} bigint" for c in copies)
    rows = sample.selectExpr("doc_id", "text", "cast(mark as int) as mark").mapInArrow(map_batches(least), kinds)
    for c in copies:
        kept = rows.groupBy(c).agg(F.min("doc_id").alias("doc_id"))
        rows = rows.join(kept.select("doc_id"), "doc_id", "left_semi")
    return rows.select("doc_id", "text", "mark")


def telling_terms(sample: DataFrame, terms: int = TERMS, evidence: float = EVIDENCE) -> np.ndarray:
    """Sorted hashes of at most ``terms`` terms of ``sample(text, mark)`` with the largest likelihood ratio, of those that point to mark 1."""

    def present(batch: pa.RecordBatch):
        mark = np.asarray(batch.column(1).cast(pa.int64()))
        found = list(Terms().of(batch.column(0)))
        if found:
            row, value, _ = _distinct(*(np.concatenate(x) for x in zip(*found)))
            yield pa.record_batch([pa.array(value), pa.array(mark[row])], names=["term", "mark"])

    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    if not 0 < toxic < total:
        return np.zeros(0, np.int64)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = toxic / total
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    ratio = 2 * (
        part(t, n * share) + part(n - t, n * (1 - share))
        + part(toxic - t, (total - n) * share) + part(total - toxic - n + t, (total - n) * (1 - share))
    )
    counted = sample.select("text", "mark").mapInArrow(map_batches(present), "term bigint, mark bigint")
    best = (
        counted.groupBy("term").agg(F.count("*").alias("n"), F.sum("mark").alias("t"))
        .where((F.col("n") > 1) & (t >= POINTED * n)).withColumn("ratio", ratio).where(F.col("ratio") >= evidence)
        .orderBy(F.desc("ratio"), "term").limit(terms)
    )
    return np.sort(np.array([r["term"] for r in best.collect()], dtype=np.int64))


def term_counts(docs: DataFrame, telling: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns plus (terms, times): places in ``telling`` and counts; null text has none."""
    held = shipped(docs.sparkSession, (telling, Terms()))

    def count(batch: pa.RecordBatch):
        telling, terms = held.value
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, value in terms.of(batch.column(0)):
            if len(telling):
                at = np.minimum(np.searchsorted(telling, value), len(telling) - 1)
                hit = telling[at] == value
                rows.append(row[hit])
                places.append(at[hit])
        row, place, times = _distinct(np.concatenate(rows), np.concatenate(places))
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, times)]
        yield pa.record_batch([*batch.columns[1:], *lists], names=[*batch.schema.names[1:], "terms", "times"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(map_batches(count), f"{kinds}, terms array<int>, times array<int>")


class Index:
    """Examples' unit TF-IDF vectors in an inverted index with a largest weight per term and block."""

    def __init__(self, ids: list, marks: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> None:
        self.idf = idf
        weights = [self.weigh(p, t) for p, t in vectors]
        full = [k for k, w in enumerate(weights) if len(w)]
        full.sort(key=lambda k: (vectors[k][0][np.argsort(-weights[k], kind="stable")[:3]].tolist(), k))
        bare = marks[[k for k, w in enumerate(weights) if not len(w)]]
        self.bare = (float(bare.sum()) + 0.5) / (len(bare) + 1) if len(marks) else 0.5
        self.ids, self.marks = [ids[k] for k in full], marks[full].astype(float)
        n_blocks = -(-len(full) // BLOCK)
        self.most = np.zeros((len(idf), n_blocks))
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(len(idf))]
        lists: dict[tuple[int, int], list] = {}
        for example, k in enumerate(full):
            for p, w in zip(vectors[k][0].tolist(), weights[k].tolist()):
                lists.setdefault((p, example // BLOCK), []).append((example % BLOCK, w))
        for (p, b), got in lists.items():
            at, w = np.array([x[0] for x in got]), np.array([x[1] for x in got])
            self.postings[p][b], self.most[p, b] = (at, w), w.max()
        self.slope, self.offset = 1.0, 0.0
        self.seen: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def weigh(self, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[places] if len(places) else np.zeros(0)
        return w / np.linalg.norm(w) if len(w) else w

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine above 0, ties to the earlier example."""
        if not len(places):
            return []
        bound = weights @ self.most[places]
        scores, ids, floor = np.zeros(0), np.zeros(0, np.int64), 0.0
        for b in np.lexsort((np.arange(len(bound)), -bound)).tolist():
            if bound[b] < floor or bound[b] <= 0:
                break
            score = np.zeros(BLOCK)
            for p, w in zip(places.tolist(), weights.tolist()):
                if (post := self.postings[p].get(b)) is not None:
                    score[post[0]] += w * post[1]
            at = np.flatnonzero((score > 0) & (score >= floor))
            if not len(at):
                continue
            scores, ids = np.concatenate([scores, score[at].round(12)]), np.concatenate([ids, b * BLOCK + at])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                floor = scores[-1] - 1e-11
        return list(zip(scores.tolist(), ids.tolist()))

    def share(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return sum(s * self.marks[e] for s, e in near) / total

    def calibrate(self) -> None:
        """A logistic curve over the vote shares of the examples, each left out of its own neighbours."""
        own: list[tuple[list[int], list[float]]] = [([], []) for _ in self.ids]
        for p, blocks in enumerate(self.postings):
            for b, (at, w) in blocks.items():
                for a, x in zip(at.tolist(), w.tolist()):
                    own[b * BLOCK + a][0].append(p)
                    own[b * BLOCK + a][1].append(x)
        shares = np.full(len(own), self.bare)
        for e, (p, w) in enumerate(own):
            near = [x for x in self.nearest(np.array(p), np.array(w), NEIGHBOURS + 1) if x[1] != e][:NEIGHBOURS]
            if near:
                shares[e] = self.share(near)
        if len(own) == 0 or self.marks.min() == self.marks.max():
            self.slope, self.offset = 6.0, -3.0
            return
        slope, offset = 6.0, -3.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-(slope * shares + offset)))
            slope -= 2.0 * (np.mean((p - self.marks) * shares) + 1e-3 * (slope - 6))
            offset -= 2.0 * np.mean(p - self.marks)
        self.slope, self.offset = float(slope), float(offset)

    def judge(self, places: list[int], times: list[int]) -> tuple[float, list[tuple[float, int]]]:
        key = (tuple(places), tuple(times))
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            p = np.array(places, dtype=np.int64)
            near = self.nearest(p, self.weigh(p, np.array(times, dtype=float)), NEIGHBOURS)
            score = 1 / (1 + np.exp(-(self.slope * self.share(near) + self.offset))) if near else self.bare
            self.seen[key] = (float(score), near)
        return self.seen[key]


def scored(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs(doc_id, text)``.

    Learned from at most ``size`` rows of ``labels(doc_id, toxic)`` whose crc32 remainder mod 3 isn't 1; null labels
    don't count, and a document once marked 1 is 1. ``evidence`` lists the nearest examples with their similarity,
    nearest first, ties to the earlier place in the index. Texts without a telling term, empty and null ones among
    them, have no evidence and get the share of toxic examples without one (0.5 if nothing was learned). Repeated
    rows get equal results; an empty table gives an empty result.
    """
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (labelled.remainder("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("mark"))
    )
    sample = cut(without_copies(labelled.sample(docs, marks, size).repartition(SAMPLE_TASKS)))
    telling = telling_terms(sample)
    counted = cut(term_counts(docs.select("doc_id", "text"), telling, ["doc_id"]))
    # At most TERMS counts, and ``size`` short vectors.
    frequency = np.zeros(len(telling))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[r["t"]] = r["count"]
    idf = np.log((1 + counted.count()) / (1 + frequency)) + 1
    got = sorted(term_counts(sample, telling, ["doc_id", "mark"]).collect(), key=lambda r: (str(r["doc_id"]).zfill(20)))
    index = Index(
        [r["doc_id"] for r in got],
        np.array([r["mark"] for r in got], dtype=float),
        [(np.array(r["terms"], dtype=np.int64), np.array(r["times"], dtype=float)) for r in got],
        idf,
    )
    index.calibrate()
    held = shipped(docs.sparkSession, index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def vote(batches):
        for batch in batches:
            own = held.value
            judged = [own.judge(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            near = [[{"doc_id": own.ids[e], "similarity": s} for s, e in n[:3]] for _, n in judged]
            listed = pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("similarity", pa.float64())]))
            yield pa.record_batch(
                [batch.column(0), pa.array([s for s, _ in judged], pa.float64()), pa.array(near, listed)],
                names=["doc_id", "score", "evidence"],
            )

    voted = counted.mapInArrow(vote, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, similarity: double>>")
    return voted.select(
        "doc_id",
        (labelled.remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )
