"""Near copies against brute force; components against a union-find."""

import random

import pytest
import xxhash

from spendloom.llm import components, simhash
from spendloom.llm.queries import op4_simhash

MASK = (1 << 64) - 1


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[k : k + 3] for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable over prints at most two bits apart; prints maps id to print."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(prints[x] ^ prints[y]).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, id string, component string")


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op4_simhash(spark, sf_dir).collect()}
    assert got == {i: (prints[i], roots[i]) for i in texts}


def test_odd_rows(spark):
    rows = [
        (3, None, "x", "x"), (1, "", "x", "x"), (2, " \t\n", "x", "x"), (7, "Ab c", "x", "x"), (5, "aB\nC", "x", "x"),
        (5, "aB\nC", "x", "x"), (None, "ab c", "x", "x"), (9, "é É", "x", "x"), (8, "w " * 50_000, "x", "x"),
    ]
    got = simhash.near_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.component for r in got if r.fingerprint == 0} == {1}
    assert [r.component for r in got if r.id in (5, 7)] == [5, 5, 5]
    assert [r.component for r in got if r.id is None] == [5]
    assert simhash.near_copies(frame(spark, [])).collect() == []


@pytest.mark.parametrize("paired", [64, 2])
def test_dense_prints_link_without_pairs(spark, paired):
    """Clusters of prints within few bits, paired or starred, have brute force's components."""
    draw = random.Random(paired)
    prints = set()
    for _ in range(4):
        center = draw.getrandbits(64)
        prints.add(center)
        for _ in range(60):
            near = center
            for _ in range(draw.choice([1, 2, 3, 4])):
                near ^= 1 << draw.choice([*range(12), *range(30, 40), 63])
            prints.add(near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), paired)
    found = {(r.a & MASK, r.b & MASK) for r in links.collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)
    roots = {r.node & MASK: r.root for r in components.connected_components(links).collect()}
    own = {p: (roots.get(p), p if p not in roots else None) for p in prints}
    brute = brute_components({p: p for p in prints})
    for x in prints:
        for y in prints:
            assert (own[x] == own[y]) == (brute[x] == brute[y])


def test_components_of_chains_loops_and_repeats(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 7), (7, 7), (9, 9), (None, 1), (200, 100)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 3, 3: 3, 9: 9, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
