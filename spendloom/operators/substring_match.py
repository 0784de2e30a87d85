"""Many search terms against many texts: one automaton over all terms of a lot, one pass over the texts of a block.

Terms and items are dealt into lots and blocks by a hash and meet by an equality join. A group builds an Aho-Corasick
automaton of its terms, runs each text through it once, and returns a row per matched term; the pairs themselves, of
which a short term has very many, never leave the group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendloom.operators.vector_search import _blocks_of

LOT_TERMS = 50_000
BLOCK_ITEMS = 50_000


def first_matches(items: DataFrame, terms: DataFrame, columns: Sequence[str], key: str = "item_id") -> DataFrame:
    """(term, item_id, matches): the least item that holds the term in one of ``columns``, and how many items do.

    Case is ignored. ``terms`` has a column term; equal terms, also those that differ in case, count once and come back
    in lower case. Terms that nothing holds, null terms and items without a key are left out; the empty term is in
    every text that isn't null.
    """
    wanted = terms.select(F.lower("term").alias("term")).where("term is not null").distinct()
    texts = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), *[F.lower(c).alias(f"t{k}") for k, c in enumerate(columns)])
    n_lots, n_blocks = _blocks_of(terms, LOT_TERMS), _blocks_of(items, BLOCK_ITEMS)
    group = ("lot", "block")
    left = texts.withColumn("block", F.pmod(F.xxhash64("item_id"), n_blocks).cast("int"))
    left = left.withColumn("lot", F.explode(F.sequence(F.lit(0), n_lots - 1)))
    right = wanted.withColumn("lot", F.pmod(F.xxhash64("term"), n_lots).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    # Terms may come from the items themselves; the aliases give them columns of their own.
    right = right.select(*[F.col(c).alias(c) for c in (*group, "term")])
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("item_id", items.schema[key].dataType), T.StructField("matches", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    n_columns = len(columns)

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        names = right["term"].to_pylist()
        automaton = ahocorasick.Automaton()
        for k, name in enumerate(names):
            if name:
                automaton.add_word(name, k)
        automaton.make_automaton()
        everywhere = [k for k, name in enumerate(names) if not name]
        # In order of the key the first item found is the least.
        left = left.take(pc.sort_indices(left, sort_keys=[("item_id", "ascending")]))
        first, count = [-1] * len(names), [0] * len(names)
        for row, own in enumerate(zip(*[left[f"t{k}"].to_pylist() for k in range(n_columns)])):
            found = set(everywhere) if any(t is not None for t in own) else set()
            for text in own:
                if text and len(automaton):
                    found.update(k for _, k in automaton.iter(text))
            for k in found:
                if not count[k]:
                    first[k] = row
                count[k] += 1
        hit = [k for k in range(len(names)) if count[k]]
        ids = left["item_id"].take(pa.array([first[k] for k in hit], pa.int64()))
        made = [pa.array([names[k] for k in hit], pa.string()), ids.cast(arrow.field("item_id").type), pa.array([count[k] for k in hit], pa.int64())]
        return pa.Table.from_arrays(made, schema=arrow)

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(matched, schema)
    return found.groupBy("term").agg(F.min("item_id").alias("item_id"), F.sum("matches").alias("matches"))
