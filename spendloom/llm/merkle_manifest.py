"""A Merkle manifest of a dataset: digests of rows, a tree per group, one root, and a witness for every row.

A row's leaf is the digest of its columns. The leaves of a group, in order of id, form a tree in which every run of
``FAN`` nodes becomes their digest until one node, the subroot, is left; the subroots form a last tree of the same shape.

Trees are built by streaming appends. An ``Appender`` takes the digests of an aligned block in order and keeps, per
level, only the open run. Each leaf holds a partial witness: a chain of nodes up to its open subtree. When the last
sibling of a run arrives the run closes, and by that every witness below it is extended with the digests of the others.
A block holds ``BLOCK`` leaves, so a block is one task's bounded work however large its group is; the roots of blocks
are appended in turn, as leaves of the next tier, until a group has one node. Witnesses of the tiers above come down by
joins on blocks, so what moves grows with blocks and not with leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.llm.stored import written

FAN = 8
#: Levels inside a block, and its leaves.
LEVELS = 4
BLOCK = FAN**LEVELS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node:
    """A digest, and once its run has closed, its siblings in order, its place among them, and its parent."""

    __slots__ = ("digest", "run", "place", "parent")

    def __init__(self, value: str) -> None:
        self.digest, self.run, self.place, self.parent = value, None, 0, None

    def witness(self) -> Iterator[tuple[int, list[str]]]:
        """(place, digests of the whole run) level by level, as far as runs have closed."""
        node = self
        while node.parent is not None:
            yield node.place, node.run
            node = node.parent


class Appender:
    """Appends digests to a tree and extends the witnesses of all earlier ones as their siblings complete."""

    def __init__(self) -> None:
        self.open: list[list[Node]] = []

    def _add(self, level: int, node: Node) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [n.digest for n in run]
        parent = Node(digest(*digests))
        for place, node in enumerate(run):
            node.run, node.place, node.parent = digests, place, parent
        self._add(level + 1, parent)

    def append(self, value: str) -> Node:
        node = Node(value)
        self._add(0, node)
        return node

    def finish(self, levels: int | None = None) -> str | None:
        """Close the open runs and give the one node that is left, or the one at height ``levels``."""
        level = 0
        while level < len(self.open):
            above = any(self.open[level + 1 :])
            if self.open[level] and (above or len(self.open[level]) > 1 or (levels is not None and level < levels)):
                self._close(level)
            level += 1
        return next((run[-1].digest for run in reversed(self.open) if run), None)


def fold(leaf: str, witness: list[list[str]], places: list[int]) -> str:
    """The root that ``leaf`` gives with the siblings of a witness."""
    for place, siblings in zip(places, witness):
        leaf = digest(*siblings[:place], leaf, *siblings[place:])
    return leaf


def row_leaf(columns: list[Column]) -> Column:
    """Digest of a row: each column ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _key(group: Column) -> Column:
    """Group as a non-null text that sorts as the group does, null first, by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` with their 0-based ``pos`` in their ``tree`` and the tree's number of ``nodes``.

    Rows are dealt by ranges of (tree, order), so that a tree with most rows fills many ranges; a place is counted
    inside the range and moved by what earlier ranges hold of the tree.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("tree").asc(), *order]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id counts rows inside a partition in its lower 33 bits.
    placed = placed.withColumn("range", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = written(placed, label)
    # At most a row per range, and one more per tree.
    parts = placed.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    moved = written(
        parts.select("tree", "range", (before - F.col("first_at")).alias("move"), F.sum("n").over(tree).alias("nodes")),
        f"{label}-ranges",
    )
    found = placed.join(moved, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("move"))
    return found.drop("range", "at", "move")


def _blocked(nodes: DataFrame, members: list[str], label: str) -> DataFrame:
    """One row per block of a tree: (tree, nodes, block, members in order, root of the block, top).

    ``nodes``: tree, number of nodes, pos, and the columns ``members``, one of them ``digest``. ``top``: the block is
    the whole tree, and its root is the subroot. A block's list has at most ``BLOCK`` members.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")
    lists = nodes.groupBy("tree", "nodes", block).agg(F.array_sort(F.collect_list(F.struct("pos", *members))).alias("members"))
    kind = lists.schema["members"].dataType.simpleString()
    lists = lists.withColumn("top", F.col("nodes") <= BLOCK)

    def build(batches):
        for batch in batches:
            roots = []
            for digests, top in zip(batch.column("members"), batch.column("top").to_pylist()):
                grown = Appender()
                for one in digests.values.field("digest").to_pylist():
                    grown.append(one)
                # A tree of several blocks goes on above them, so a short last block is lifted to their height.
                roots.append(grown.finish(None if top else LEVELS))
            yield pa.record_batch([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "root"])

    made = lists.mapInArrow(build, f"tree string, nodes bigint, block bigint, members {kind}, top boolean, root string")
    return written(made, label)


def _grown(nodes: DataFrame, members: list[str], label: str) -> list[DataFrame]:
    """Blocks of all trees, tier by tier from the leaves up; the roots of blocks are the next tier's leaves."""
    tiers = [_blocked(nodes, members, f"{label}-0")]
    while tiers[-1].where("not top").limit(1).count():
        roots = tiers[-1].where("not top").select(
            "tree", F.ceil(F.col("nodes") / BLOCK).cast("bigint").alias("nodes"), F.col("block").alias("pos"), F.col("root").alias("digest")
        )
        tiers.append(_blocked(roots, ["digest"], f"{label}-{len(tiers)}"))
    return tiers


def _subroots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's one node."""
    found = [t.where("top").select("tree", F.col("root").alias("digest")) for t in tiers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# What a block knows of the tree above it: the group's subroot, the root, the runs and the places of the way up.
_ABOVE = "subroot string, root_of_all string, above array<array<string>>, above_at array<int>"
_ABOVE_COLUMNS = ["subroot", "root_of_all", "above", "above_at"]
_NESTED, _PLACES = pa.list_(pa.list_(pa.string())), pa.list_(pa.int32())


def _siblings(leaf: Node) -> tuple[list[list[str]], list[int]]:
    """The other digests of each run of a leaf's witness, and the leaf's place in each."""
    siblings, places = [], []
    for place, run in leaf.witness():
        siblings.append([*run[:place], *run[place + 1 :]])
        places.append(place)
    return siblings, places


def _descended(blocks: DataFrame, work, kind: str) -> DataFrame:
    """Rows of ``kind`` that ``work(block, its members, their nodes with closed witnesses)`` yields for every block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_struct_array()[0]
                members = block["members"].values
                grown = Appender()
                leaves = [grown.append(d) for d in members.field("digest").to_pylist()]
                grown.finish(None if block["top"].as_py() else LEVELS)
                yield from work({c: block[c].as_py() for c in ("tree", *_ABOVE_COLUMNS)}, members, leaves)

    return blocks.select("tree", "members", "top", *_ABOVE_COLUMNS).mapInArrow(run, kind)


def _handed_down(blocks: DataFrame) -> DataFrame:
    """(tree, block, what is above it) for the blocks of the tier below, from the members of this tier."""

    def work(block, members, leaves):
        found = [_siblings(leaf) for leaf in leaves]
        n = len(found)
        yield pa.record_batch(
            [
                pa.array([block["tree"]] * n, pa.string()),
                members.field("pos"),
                pa.array([block["subroot"]] * n, pa.string()),
                pa.array([block["root_of_all"]] * n, pa.string()),
                pa.array([s + block["above"] for s, _ in found], _NESTED),
                pa.array([p + block["above_at"] for _, p in found], _PLACES),
            ],
            names=["tree", "block", *_ABOVE_COLUMNS],
        )

    return _descended(blocks, work, f"tree string, block bigint, {_ABOVE}")


def _leaf_blocks(tiers: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """Blocks of the lowest tier with all that is above them; ``above`` has this for each tree's one node."""
    below = None
    for at in range(len(tiers) - 1, -1, -1):
        found = tiers[at].where("top").join(above, "tree")
        if below is not None:
            found = found.unionByName(tiers[at].where("not top").join(below, ["tree", "block"]))
        if at:
            below = written(_handed_down(found), f"{label}-above-{at}")
    return found


@dataclass
class Manifest:
    """Blocks of the groups' trees and of the tree over their subroots, tier by tier; and the one root."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: DataFrame


def build(
    docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", tampered: Column | None = None,
    changed: dict[str, Column] | None = None,
) -> Manifest:
    """The trees of all groups, and the tree over their subroots.

    ``columns`` are hashed in their order, each ``-`` if null; other columns are not read. With ``tampered`` a leaf also
    carries the digest of its row with the columns ``changed`` in place of its own, where the condition holds. Ids
    ascend with null first, equal ids by digest, so repeated rows are leaves each; groups ascend by their text's bytes,
    and null is a group of its own, the first. An empty table has no root.
    """
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered, row_leaf([(changed or {}).get(c, F.col(c)) for c in columns]))
    leaf = row_leaf([F.col(c) for c in columns])
    rows = docs.select(_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("other"))
    order = [F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("other").asc()]
    groups = _grown(_numbered(rows, order, "leaves"), ["id", "digest", "other"], "groups")
    subroots = _subroots(groups).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = _grown(_numbered(subroots, [F.col("group").asc()], "subroots"), ["group", "digest"], "top")
    return Manifest(groups, top, _subroots(top).select(F.col("digest").alias("root")))


def _above_groups(manifest: Manifest) -> DataFrame:
    """(tree, what is above its subroot) of every group."""
    nothing = F.expr("cast(array() as array<array<string>>)").alias("above"), F.expr("cast(array() as array<int>)").alias("above_at")
    no_digest = F.lit(None).cast("string")
    end = _subroots(manifest.top).select("tree", no_digest.alias("subroot"), no_digest.alias("root_of_all"), *nothing)

    def work(block, members, leaves):
        found = [_siblings(leaf) for leaf in leaves]
        siblings, places = [s + block["above"] for s, _ in found], [p + block["above_at"] for _, p in found]
        roots = [fold(leaf.digest, s, p) for leaf, s, p in zip(leaves, siblings, places)]
        yield pa.record_batch(
            [members.field("group"), members.field("digest"), pa.array(roots, pa.string()), pa.array(siblings, _NESTED), pa.array(places, _PLACES)],
            names=["tree", *_ABOVE_COLUMNS],
        )

    return written(_descended(_leaf_blocks(manifest.top, end, "top"), work, f"tree string, {_ABOVE}"), "above-groups")


def witnesses(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, siblings, places, folded_root) of every row.

    ``siblings`` are the other digests of each run from the leaf to the root, ``places`` the row's place in each run;
    ``folded_root`` is recomputed from them and the tampered digest, where there is one, or the leaf.
    """
    kind = manifest.groups[0].schema["members"].dataType.elementType["id"].dataType.simpleString()

    def work(block, members, leaves):
        siblings, places, folded = [], [], []
        for leaf, other in zip(leaves, members.field("other").to_pylist()):
            own, at = _siblings(leaf)
            siblings.append(own + block["above"])
            places.append(at + block["above_at"])
            folded.append(fold(other or leaf.digest, siblings[-1], places[-1]))
        subroot, root = (pa.array([block[c]] * len(leaves), pa.string()) for c in ("subroot", "root_of_all"))
        whole = pa.record_batch(
            [members.field("id"), members.field("digest"), subroot, root, pa.array(siblings, _NESTED), pa.array(places, _PLACES), pa.array(folded, pa.string())],
            names=["id", "leaf", "subroot", "root", "siblings", "places", "folded_root"],
        )
        yield from (whole.slice(k, 512) for k in range(0, len(leaves), 512))

    blocks = _leaf_blocks(manifest.groups, _above_groups(manifest), "groups")
    return _descended(
        blocks,
        work,
        f"id {kind}, leaf string, subroot string, root string, siblings array<array<string>>, places array<int>, folded_root string",
    )


def lowered(text: Column) -> Column:
    """``text`` with only A-Z in lower case; null stays."""
    return F.translate(text, _UPPER, _UPPER.lower())
