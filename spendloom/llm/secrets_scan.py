"""Secrets in whole texts: fixed patterns, and random strings that a vocabulary encodes badly.

A byte-level vocabulary learns words, names and code, so ordinary runs of characters take few tokens; keys and tokens
drawn at random take one token for every one or two characters. A run of key characters is opaque when it has at most
``CHARS_PER_TOKEN`` characters per token and is neither a known digest nor a known kind of identifier.

Positions are code points, ends exclusive. Patterns are searched from left to right without overlaps per kind, and
a match that is too short still uses up its characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.stored import shipped
from spendloom.llm.textblocks import map_batches

# The base patterns with their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Kinds in the order in which spans of one start are listed; the last is the one the vocabulary tells.
KINDS = ("assign", "access", "hex", "opaque")

LEAST_OPAQUE = 20
LEAST_PART = 12
CHARS_PER_TOKEN = 2.1
#: Letters in a row, on average, from which a run of key characters is a name made of words.
LETTERS_PER_WORD = 3.0
#: Characters encoded at once; longer runs are counted piece by piece.
_PIECE = 512

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_RUN = re.compile(r"[A-Za-z0-9+/_.~-]{%d,}={0,2}" % LEAST_OPAQUE)
_TRIM = "._-/~+"
_DIGEST = re.compile(r"(?:0[xX])?(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex digits of the common digests, from 128 to 512 bits.
_DIGEST_DIGITS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_.~T:Z-]+")
#: Words inside a name: capitalised, lower case, or capitals. Letters after a digit are none, capitals before one neither.
_WORD = re.compile(r"(?<![0-9])[A-Z][a-z]+|(?<![0-9A-Za-z])[a-z]+|(?<![0-9A-Z])[A-Z]++(?![a-z0-9])")
_LETTER = re.compile(r"[A-Za-z]")
_PARTS = re.compile(r"[+/_.~-]")

#: The span of one finding as a Spark type.
SPANS = "array<struct<kind: string, start: int, end: int, chars_per_token: double>>"


def known_shape(run: str) -> bool:
    """Whether a run of key characters is a digest, a UUID, a number or date, or a name made of words."""
    if _DIGEST.fullmatch(run) and len(run.removeprefix("0x").removeprefix("0X")) in _DIGEST_DIGITS:
        return True
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    if max(map(len, _PARTS.split(run.rstrip("=")))) < LEAST_PART:
        return True
    words, letters = _WORD.findall(run), len(_LETTER.findall(run))
    # A letter outside of words counts as a word of its own.
    return letters >= LETTERS_PER_WORD * (len(words) + letters - sum(map(len, words)))


class Scanner:
    """Finds the spans of a text; loads the tiktoken ranks at ``path`` on first use in each worker."""

    def __init__(self, path: str, pattern: str, chars_per_token: float = CHARS_PER_TOKEN) -> None:
        self.path, self.pattern, self.chars_per_token = path, pattern, chars_per_token
        self.encoding = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoding": None}

    def tokens(self, run: str) -> int:
        if self.encoding is None:
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return sum(len(self.encoding.encode_ordinary(run[at : at + _PIECE])) for at in range(0, len(run), _PIECE))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) of the fixed patterns, in order."""
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def opaque(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
        """Runs that the vocabulary encodes badly, without the characters of ``base`` spans."""
        at = 0
        for m in _RUN.finditer(text):
            if text[m.end() : m.end() + 1] == "@" or text[m.start() - 1 : m.start()] == "@":
                continue
            while at < len(base) and base[at][2] <= m.start():
                at += 1
            for start, end in _uncovered(m.start(), m.end(), base, at):
                while start < end and text[start] in _TRIM:
                    start += 1
                while start < end and text[end - 1] in _TRIM:
                    end -= 1
                run = text[start:end]
                if len(run) >= LEAST_OPAQUE and not known_shape(run):
                    ratio = len(run) / self.tokens(run)
                    if ratio <= self.chars_per_token:
                        yield start, 3, end, ratio

    def spans(self, text: str) -> list[dict]:
        base = self.base(text)
        found = sorted([(*b, None) for b in base] + list(self.opaque(text, base)), key=lambda s: s[:3])
        return [{"kind": KINDS[k], "start": s, "end": e, "chars_per_token": r} for s, k, e, r in found]


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]], at: int) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no span of ``base[at:]`` covers."""
    while at < len(base) and base[at][0] < end:
        if base[at][0] > start:
            yield start, base[at][0]
        start = max(start, base[at][2])
        at += 1
    if start < end:
        yield start, end


def vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the installed public byte-level vocabulary."""
    import os

    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def secrets(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """``keep`` columns (all by default) plus ``spans``, the findings of each row in order of start, then kind.

    ``chars_per_token`` of a span is null for the fixed patterns. Null and empty texts have no spans; repeated rows
    get equal results; an empty table gives an empty result; a column ``spans`` of ``docs`` is replaced. Spans of
    different fixed kinds may overlap; opaque spans leave out what these cover. Runs beside an ``@`` are addresses.
    ``path`` must be readable on the executors.
    """
    scanner = shipped(docs.sparkSession, Scanner(path, pattern, chars_per_token))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chars_per_token", pa.float64())]))

    def work(batch: pa.RecordBatch):
        own = scanner.value
        found = [own.spans(t.as_py() or "") for t in batch.column(0)]
        yield pa.record_batch([*batch.columns[1:], pa.array(found, kind)], names=[*keep, "spans"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    own_names = (F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep))
    return docs.select(F.col(text_col).alias("text"), *own_names).mapInArrow(
        map_batches(work), f"{kinds}spans {SPANS}"
    )


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, counts by kind, base_sha256, spans as text) of ``secrets``; spans are written ``kind:start:end``."""

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(id_col, *map(count, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
