"""Benchmark passages in documents by spaced-seed hashing, in DataFrame expressions only.

Words are runs between ASCII white space and punctuation, lower-cased. A mask is a set of token positions; tokens
between them are ignored, so a substituted word there doesn't break a match. Every window of every document and of
every benchmark item is hashed under each mask, and equal hashes are joined. A hit fixes an alignment of an item with
a document; the aligned words are then compared one by one, and the document holds a passage of the item if some
stretch of ``PASSAGE`` aligned words (the whole item, if shorter) agrees in at least ``AGREEING`` of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.stored import written

GAP = r"[\x09-\x0D -/:-@\[-`{-~]+"
# Wherever words of a passage of 8 to 13 words are substituted as AGREEING admits, one of these finds it.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6))
SPAN = 8
PASSAGE = 13
AGREEING = 0.8
BROADCAST_KEYS = 2_000_000


def word_hashes(text: str) -> Column:
    """Hashes of a text's words in order."""
    return F.transform(F.array_remove(F.split(F.lower(F.col(text)), GAP), ""), lambda w: F.xxhash64(w))


def _short_masks(size: int) -> list[tuple[int, ...]]:
    """Masks of an item under ``SPAN`` words: all of its words, or all but one where ``AGREEING`` admits that."""
    if size - 1 < AGREEING * size:
        return [tuple(range(size))]
    return [tuple(range(size - 1)), *(tuple(k for k in range(size) if k != gap) for gap in range(1, size - 1))]


def _keys(rows: DataFrame, id_col: str, place: str, masks) -> DataFrame:
    """(id, place, key): the hash of each window under each mask, which slides to its own span."""

    def windows(mask: tuple[int, ...]) -> str:
        key = f"xxhash64({', '.join(f'h[i + {o}]' if o else 'h[i]' for o in mask)}, '{'.'.join(map(str, mask))}')"
        return f"if(size(h) > {mask[-1]}, transform(sequence(0, greatest(size(h) - {mask[-1] + 1}, 0)), i -> struct(i as at, {key} as key)), array())"

    found = rows.select(id_col, F.explode(F.expr(f"concat({', '.join(map(windows, masks))})")).alias("w"))
    return found.select(id_col, F.col("w.at").cast("int").alias(place), F.col("w.key").alias("key"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, matched, words) of each document of ``docs(doc_id, text)`` with a passage of an item.

    ``start`` is the document's word under the item's first word (below 0 where that is cut off), ``matched`` the
    aligned words that agree, ``words`` those of the item; of several alignments the one with most agreeing words
    counts, then the first. Null or empty texts hold and match nothing. Repeated
    rows give one result, as do rows under one id; null ids are matched like any other; other columns aren't read.
    """
    items = benchmark.select("item_id", word_hashes("text").alias("h")).where(F.size("h") > 0).distinct()
    held = docs.select("doc_id", word_hashes("text").alias("h"))
    # Documents are hashed under the masks of short items only if there are such items.
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())
    item_keys = _keys(items.where(F.size("h") >= SPAN), "item_id", "q", MASKS)
    for size in short:
        item_keys = item_keys.unionByName(_keys(items.where(F.size("h") == size), "item_id", "q", _short_masks(size)))
    item_keys = item_keys.distinct()
    masks = [*MASKS, *sorted({m for size in short for m in _short_masks(size)})]
    if item_keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        item_keys = F.broadcast(item_keys)  # 24 bytes a row; a larger benchmark is joined by shuffle
    hits = _keys(held, "doc_id", "p", masks).join(item_keys, "key").select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("start"))
    hits = written(hits.distinct(), "leak-hits")
    near = hits.join(items.withColumnRenamed("h", "own").withColumnRenamed("item_id", "own_id"), F.col("item_id").eqNullSafe(F.col("own_id")))
    near = near.select(F.col("doc_id").alias("hit_id"), "item_id", "start", "own")
    agree = "transform(sequence(0, size(own) - 1), k -> if(start + k >= 0 and coalesce(get(h, start + k) = own[k], false), 1, 0))"
    width = f"least({PASSAGE}, size(agree))"
    stretch = f"transform(sequence(1, size(agree) - {width} + 1), s -> aggregate(slice(agree, s, {width}), 0, (a, x) -> a + x))"
    # Few documents have hits; those without go before their words are hashed again.
    hit = docs.join(hits.select(F.col("doc_id").alias("hit_id")), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    found = (
        hit.select("doc_id", word_hashes("text").alias("h"))
        .join(near, F.col("doc_id").eqNullSafe(F.col("hit_id")))
        .select("doc_id", "item_id", "start", F.expr(agree).alias("agree"))
        .where(F.expr(f"array_max({stretch}) >= {AGREEING} * {width}"))
        .select("doc_id", "item_id", F.expr("aggregate(agree, 0, (a, x) -> a + x)").alias("matched"), "start", F.size("agree").alias("words"))
    )
    best = found.groupBy("doc_id", "item_id", "words").agg(F.max(F.struct("matched", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.matched", "words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the rows whose text holds a benchmark passage; ids, null or repeated, decide nothing.

    Copies of a text are searched once. Null texts stay; an empty benchmark removes nothing.
    """
    name = F.md5(F.col("text").cast("binary"))
    texts = docs.where("text is not null").select(name.alias("doc_id"), "text")
    leaked = written(leaks(texts, benchmark).select(F.col("doc_id").alias("leaked_text")).distinct(), "leaked")
    return docs.join(leaked, F.md5(docs["text"].cast("binary")) == leaked["leaked_text"], "left_anti")
