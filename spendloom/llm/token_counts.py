"""Token counts of whole texts with public tokenizers, lengths only.

Rows are taken in batches of about equal bytes. A text is cut only where no token can cross: for SentencePiece
models before a run of spaces (checked against the vocabulary), for the others, and only above ``LONG`` characters,
at a single space between two ASCII letters. Pieces of SentencePiece texts repeat a lot, so each worker remembers
the lengths of up to ``REMEMBERED`` pieces and encodes the unknown ones of a batch in one call.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.stored import shipped

BATCH_BYTES = 1 << 20
LONG = 1 << 18
REMEMBERED = 400_000
LIMIT = 4096

_BEFORE_SPACES = re.compile(r"(?<=[^ ]) ")
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Counter:
    """Counts tokens of texts; loads its vocabulary on first use in each worker."""

    def __init__(self, path: str, remembered: int = REMEMBERED, long: int = LONG) -> None:
        self.path, self.remembered, self.long = path, remembered, long
        self.ready = False

    def __getstate__(self) -> dict:
        return {"path": self.path, "remembered": self.remembered, "long": self.long, "ready": False}

    def _load(self) -> None:
        if self.path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
            self.by_piece = not any(re.search("[^▁]▁", x) for x in names) and (
                self.model.encode("a  b", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode(" b", out_type=str)
            )
            self.known: dict[str, int] = {}
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
            self.model.no_truncation()
            self.model.no_padding()
            self.by_piece = False
        self.ready = True

    def _lengths(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return list(map(len, self.model.encode(texts, num_threads=1)))
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def _by_piece(self, texts: list[str]) -> list[int]:
        # The model reads its own mark as a space.
        parts = [_BEFORE_SPACES.split(t.replace("▁", " ")) for t in texts]
        known = self.known
        unknown = list(set(chain.from_iterable(parts)).difference(known))
        if len(known) + len(unknown) > self.remembered:
            known.clear()
            unknown = list(set(chain.from_iterable(parts)))
        for at in range(0, len(unknown), 1 << 15):
            some = unknown[at : at + (1 << 15)]
            known.update(zip(some, self._lengths(some)))
        known[""] = 0
        get = known.__getitem__
        # A last piece without characters is the lone space that ends a text.
        lone = self._lengths(["a ", "a"])
        return [sum(map(get, p)) + (len(p) > 1 and not p[-1]) * (lone[0] - lone[1]) for p in parts]

    def _whole(self, texts: list[str]) -> list[int]:
        parts = [[t] if len(t) <= self.long else self._cut(t) for t in texts]
        lengths = self._lengths([p for group in parts for p in group])
        ends = np.cumsum([len(p) for p in parts])
        return [sum(lengths[e - len(p) : e]) for p, e in zip(parts, ends)]

    def _cut(self, text: str) -> list[str]:
        out, start = [], 0
        while len(text) - start > self.long and (m := _BETWEEN_WORDS.search(text, start + self.long)):
            out.append(text[start : m.start()])
            # SentencePiece puts back the space before a piece; the other libraries need it in the text.
            start = m.end() if self.path.endswith(".model") else m.start()
        return [*out, text[start:]]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, exactly as the library counts the whole text."""
        if not self.ready:
            self._load()
        return self._by_piece(texts) if self.by_piece else self._whole(texts)


def _batches(texts: list[str], size: int):
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; null text counts as empty, with no bytes and tokens.

    Repeated rows are counted each; an empty table gives an empty result; other columns are not read. ``path`` must
    be readable on the executors.
    """
    counter = shipped(docs.sparkSession, Counter(path))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = pa.array([n for group in _batches(texts, BATCH_BYTES) for n in counter.value.count(group)], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), tokens], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")
    ).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
