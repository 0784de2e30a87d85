"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from a BPE vocabulary with byte fallback and composed with the input. The normaliser puts
a mark before the text and writes spaces as marks. The piece machine is a trie over the pieces' characters that emits
a piece at each accepting state; a character without a piece is read by its UTF-8 bytes' pieces instead. The merge
machine has the last piece as its state: following ``a`` with ``b`` weighs 0 if merging the joined string by rank
gives back exactly ``a, b``, and infinity otherwise. In the tropical semiring every prefix then has exactly one path
of finite weight, its BPE encoding, so the shortest path is found in one pass over the positions.

No piece of these vocabularies holds a mark after another character (checked when compiling), so a text's runs up to
the next mark are composed one by one; equal runs are composed once. Runs of up to ``SHORT`` known characters go
through the machines together, as arrays; others one at a time.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.stored import shipped
from spendloom.llm.textblocks import map_batches, mix

MARK = "▁"
SHORT = 48
REMEMBERED = 150_000
_BATCH_CHARS = 1 << 18
_PAIR_SLOTS = 1 << 21
_RUN = re.compile(r"(?<=[^ ]) ")


class Transducer:
    """The compiled machines; loads the vocabulary at ``path`` on first use in each worker."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.path, self.remembered, self.ready = path, remembered, False

    def __getstate__(self) -> dict:
        return {"path": self.path, "remembered": self.remembered, "ready": False}

    def compile(self) -> Transducer:
        if self.ready:
            return self
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        probe = " ﬁ  aⅧ "
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in range(size)]
        if model.decode(model.encode(probe)) != probe or any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
            raise ValueError("only vocabularies that keep texts as they are, without marks inside pieces, are compiled")
        self.size = size
        self.id_of = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        # What each piece reads; a byte piece below 128 reads its ASCII character, where that has no piece of its own.
        self.names = names
        for b in range(128):
            names[self.byte[b]] = chr(b)
        self.longest = max(map(len, self.id_of))
        # Pieces that merging can't build are in no encoding, so they emit nothing.
        reach = {n: i for n, i in self.id_of.items() if self.merged(n) == [n]}
        reach |= {chr(b): self.byte[b] for b in range(128) if chr(b) not in reach}
        self.arc = reach
        self.output = [b""] * size
        for i in plain:
            self.output[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.output[i] = bytes([b])
        self._compile_trie(reach)
        self.lengths = np.array([len(n) for n in names], dtype=np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.parts: dict[str, str] = {}
        self.slot_key = np.full(_PAIR_SLOTS, -1, dtype=np.int64)
        self.slot_fits = np.zeros(_PAIR_SLOTS, dtype=bool)
        self.known: dict[str, bytes] = {}
        self.ready = True
        return self

    def _compile_trie(self, reach: dict[str, int]) -> None:
        """States and transitions as a hash table: key = state and character, value = next state."""
        states, arcs, accepts = {"": 0}, {}, {}
        for name in sorted(reach):
            for k in range(1, len(name) + 1):
                if name[:k] not in states:
                    states[name[:k]] = len(states)
                    arcs[(states[name[: k - 1]] << 21) | ord(name[k - 1])] = states[name[:k]]
            accepts[states[name]] = reach[name]
        # A table with at least four slots an arc; arcs of one slot lie in the next free ones.
        bits = (4 * len(arcs)).bit_length()
        self.trie_shift = np.uint64(64 - bits)
        self.trie_key, self.trie_next = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        keys = np.array(list(arcs), dtype=np.int64)
        for key, slot in zip(keys.tolist(), self._arc_slots(keys).tolist()):
            while self.trie_key[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.trie_key[slot], self.trie_next[slot] = key, arcs[key]
        self.accept = np.full(len(states), -1, dtype=np.int64)
        self.accept[list(accepts)] = list(accepts.values())
        self.depth_one = {n for n in reach if len(n) == 1}

    def _arc_slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.trie_shift).astype(np.int64)

    def _follow(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are arcs, their next states)."""
        slot = self._arc_slots(keys)
        held = self.trie_key[slot]
        hit = held == keys
        open_ = np.flatnonzero(~hit & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.trie_key) - 1)
            held = self.trie_key[slot[open_]]
            hit[open_] = held == keys[open_]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return hit, self.trie_next[slot[hit]]

    # The merge machine.

    def merged(self, text: str) -> list[str]:
        """``text`` merged by rank: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge machine follows piece ``a`` with piece ``b`` at weight 0."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[(a, b)] = self._stay_apart(a, b)
        return found

    def _merges(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """A piece's own merges: the score of each, and the first and the last part before each and at the end."""
        if (found := self.steps.get(piece)) is None:
            parts, score, own = list(self.names[piece]), self.score, self.parts
            scores, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    s = score.get(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                joined = parts[at] + parts[at + 1]
                parts[at : at + 2] = [own.setdefault(joined, joined)]
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            found = self.steps[piece] = (scores, firsts, lasts)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging ``a`` and ``b`` side by side never joins across their border.

        Until it does, each side takes its own merges in their order, the better next one first and the left one of
        equals.
        """
        own, _, lasts = self._merges(a)
        other, firsts, _ = self._merges(b)
        i, j, n, m, score = 0, 0, len(own), len(other), self.score
        while True:
            left, right = own[i] if i < n else None, other[j] if j < m else None
            across = score.get(lasts[i] + firsts[j])
            if across is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left >= right):
                i += 1
            else:
                j += 1

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(_PAIR_SLOTS - 1)).astype(np.int64)
        out, missing = self.slot_fits[slot], np.flatnonzero(self.slot_key[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            value = np.array([self.fits(int(k) // self.size, int(k) % self.size) for k in new])
            out[missing] = value[back]
            self.slot_key[slot[missing]], self.slot_fits[slot[missing]] = key[missing], out[missing]
        return out

    # Shortest paths.

    def path_of(self, run: str) -> list[int]:
        """The shortest path of one run of any length: pieces, or bytes of characters that have none."""
        arc, longest, none = self.arc, self.longest, -1
        last, back = [none] * (len(run) + 1), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            if run[end - 1] not in self.depth_one:
                last[end], back[end] = none, end - 1  # read by bytes; merges with nothing
                continue
            for start in range(max(0, end - longest), end):
                piece = arc.get(run[start:end])
                if piece is not None and (start == 0 or last[start] == none or self.fits(last[start], piece)):
                    last[end], back[end] = piece, start
                    break
        out, end = [], len(run)
        while end:
            if last[end] == none:
                out += [self.byte[b] for b in reversed(run[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(last[end])
            end = back[end]
        return out[::-1]

    def paths_of(self, runs: list[str]) -> list[bytes]:
        """Shortest paths of short runs of known characters, as int32 bytes."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = np.repeat(base + size, size) - np.arange(len(codes))  # characters up to the run's end
        offset = np.arange(len(codes)) - np.repeat(base, size)
        # Composition with the trie, from every position at once.
        at, state, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for length in range(1, self.longest + 1):
            hit, state = self._follow((state << 21) | codes[at + length - 1])
            at = at[hit]
            emits = self.accept[state] >= 0
            found.append((at[emits], np.full(emits.sum(), length), self.accept[state[emits]]))
            more = left[at] > length
            at, state = at[more], state[more]
            if not len(at):
                break
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        end = offset[start] + length
        # By end, the longest first; numbers of 16 bits are sorted by counting.
        turn = end * (self.longest + 1) + self.longest - length
        order = np.argsort(turn.astype(np.min_scalar_type(int(turn.max()))), kind="stable")
        start, length, piece, end = start[order], length[order], piece[order], end[order]
        # Relaxation by end; an arc into a settled node is not tried, as a node has one finite path.
        node = start + np.repeat(np.arange(len(runs)), size)[start]
        last = np.full(len(codes) + len(runs), -1, dtype=np.int64)
        cuts = np.flatnonzero((np.diff(end) != 0) | (np.diff(length) != 0)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(end))):
            target = node[a:b] + length[a]
            free = np.flatnonzero(last[target] < 0)
            if not len(free):
                continue
            source, emitted = node[a:b][free], piece[a:b][free]
            if end[a] > length[a]:
                fit = self._fit(last[source], emitted)
                free, emitted = free[fit], emitted[fit]
            last[target[free]] = emitted
        word, now, steps = np.arange(len(runs)), base + np.arange(len(runs)) + size, []
        floor = base + np.arange(len(runs))
        while len(word):
            token = last[now]
            steps.append((word, token))
            now = now - self.lengths[token]
            more = now > floor[word]
            word, now = word[more], now[more]
        which = np.concatenate([w for w, _ in steps])
        token = np.concatenate([t for _, t in steps]).astype("<i4")
        turn = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
        ends = np.cumsum(np.bincount(which, minlength=len(runs)))
        placed = np.empty_like(token)
        placed[ends[which] - 1 - turn] = token
        flat, ends = placed.tobytes(), ends * 4
        return [flat[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    # Texts.

    def runs_of(self, text: str) -> list[str]:
        """The normalised text, cut before marks; spaces stand for marks, and the first mark is left out of each run."""
        return _RUN.split(text.replace(MARK, " ")) if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text, as int32 bytes."""
        self.compile()
        parts, known = [self.runs_of(t) for t in texts], self.known
        unknown = set(chain.from_iterable(parts)).difference(known)
        if len(known) + len(unknown) > self.remembered:
            known.clear()
            unknown = set(chain.from_iterable(parts))
        marked = {r: MARK + r.replace(" ", MARK) for r in unknown}
        single = self.depth_one
        short = [r for r, m in marked.items() if len(m) <= SHORT and single.issuperset(m)]
        for at in range(0, len(short), 1 << 14):
            some = short[at : at + (1 << 14)]
            known.update(zip(some, self.paths_of([marked[r] for r in some])))
        for r in unknown.difference(short):
            known[r] = np.array(self.path_of(marked[r]), dtype="<i4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: marks become spaces, byte pieces join to characters, the first space goes."""
        self.compile()
        raw = b"".join(map(self.output.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _groups(texts: list[str]):
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= _BATCH_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus token_ids array<int>, n_tokens and lossless.

    ``lossless``: decoding the ids gives back the text (not so where it holds the mark itself). Null text counts as
    empty: no ids, lossless. Repeated rows get equal results; an empty table gives an empty result; columns of
    ``docs`` named like the new ones are replaced. ``path`` must be readable on the executors.
    """
    machine = shipped(docs.sparkSession, Transducer(path))
    new = ("token_ids", "n_tokens", "lossless")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def work(batch: pa.RecordBatch):
        own = machine.value
        texts = [t or "" for t in batch.column(0).to_pylist()]
        ids, same = [], []
        for group in _groups(texts):
            found = own.encode_batch(group)
            ids += found
            same += [own.decode(np.frombuffer(f, "<i4").tolist()) == t for f, t in zip(found, group)]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
        yield pa.record_batch(
            [*batch.columns[1:], listed, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())],
            names=[*batch.schema.names[1:], *new],
        )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(text_col).alias("__text"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(
        map_batches(work, 512), f"{kinds}token_ids array<int>, n_tokens int, lossless boolean"
    )


def decoded(encodings: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``encodings`` with the text of its piece ids; null ids give null text."""
    machine = shipped(encodings.sparkSession, Transducer(path))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else machine.value.decode(x) for x in ids.to_pylist()], pa.string())

    return encodings.withColumn(text_col, text(F.col(ids_col)))
