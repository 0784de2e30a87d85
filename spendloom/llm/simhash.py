"""Near copies by SimHash: fingerprints at most two bits apart, found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so of two fingerprints that differ in at most two bits one
segment differs in at most one. Each segment is indexed under its 32 variants with one bit blanked; fingerprints
that share a variant are compared. A variant shared by more than ``PAIRED`` fingerprints isn't paired: its members
also blank a bit of the other segment (or two, where the first is equal), and members that share such a signature
are within two bits by construction, so a star around the least of them says the same with linear work.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.components import connected_components
from spendloom.llm.stored import cut
from spendloom.llm.textblocks import map_batches

SEED = 42
SHINGLE = 3
BITS = 2
PAIRED = 64
_AT_ONCE = 1 << 17


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 majority bits over the shingles' XXH64; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs, total = iter([b" ".join(words)]), 1
    else:
        runs, total = map(b" ".join, zip(*(words[k:] for k in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    while len(part := np.fromiter(map(xxhash.xxh64_intdigest, islice(runs, _AT_ONCE), repeat(seed)), dtype="<u8")):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every row; null text has no words."""

    def work(batch: pa.RecordBatch):
        values = np.array([fingerprint_of(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        map_batches(work, 256), f"id {kind}, fingerprint bigint"
    )


def _segments() -> list[tuple[str, str]]:
    """Each segment of a fingerprint, with the other one."""
    high, low = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
    return [(high, low), (low, high)]


def _variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): 64 signatures of each fingerprint; the key holds segment, blanked bit and the other 31 bits."""
    keys = [
        f"transform(sequence(0, 31), i -> shiftleft(cast({32 * s} + i as bigint), 32) | ({own} & ~shiftleft(1L, i)))"
        for s, (own, _) in enumerate(_segments())
    ]
    return nodes.select(F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key"), "fp")


def _close(a: str, b: str) -> F.Column:
    return F.expr(f"bit_count({a} ^ {b}) <= {BITS}")


def _stars(signed: DataFrame) -> DataFrame:
    """Links of every member of a signature to the least member; all are within two bits."""
    least = signed.groupBy("sign").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b != most")
    return signed.join(least, "sign").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def _dense_links(members: DataFrame) -> DataFrame:
    """Links among members of widely shared variants, by signatures that blank bits on both sides."""
    bits = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> struct(i, j))))"
    one = members.select(
        "fp",
        F.explode(
            F.expr(
                "transform(sequence(0, 31), j -> struct(key, cast(j as int) as j, "
                "(if(shiftrightunsigned(key, 37) = 0, fp & 4294967295L, shiftrightunsigned(fp, 32)) & ~shiftleft(1L, j)) as rest))"
            )
        ).alias("sign"),
    )
    apart = members.select("fp").distinct()
    two = [
        apart.select(
            "fp",
            F.explode(
                F.expr(
                    f"transform({bits}, x -> struct({own} as key, cast({1000 * (s + 1)} + 32 * x.i + x.j as int) as j, "
                    f"({other} & ~shiftleft(1L, x.i) & ~shiftleft(1L, x.j)) as rest))"
                )
            ).alias("sign"),
        )
        for s, (own, other) in enumerate(_segments())
    ]
    return _stars(one.union(two[0]).union(two[1]))


def fingerprint_links(nodes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) links that connect all of ``nodes(fp)``, distinct, that are at most two bits apart."""
    shared = cut(
        _variants(nodes)
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    twos = shared.where("n = 2").where(_close("a", "b")).select("a", "b")
    members = cut(_variants(nodes).join(shared.where("n > 2").select("key", "n"), "key"))
    few = members.where(F.col("n") <= paired)
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.fp < y.fp").where(_close("x.fp", "y.fp"))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return twos.union(pairs).union(_dense_links(members.where(F.col("n") > paired))).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """(id, fingerprint long, component): component is the least id reachable over links of at most two bits.

    Every row stays, repeated ids and rows included. Null and empty texts have fingerprint 0 and are linked like any
    other; a null id gets the least id of its component. An empty table gives an empty result; other columns of
    ``docs`` are not read, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least_id")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), paired))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    component = rooted.groupBy("root").agg(F.min("least_id").alias("component"))
    lookup = rooted.select("fp", "root").join(component, "root").select("fp", "component")
    return prints.join(lookup, F.col("fingerprint") == F.col("fp")).select("id", "fingerprint", "component")
