"""Nearest vectors, leaks, repeated passages and pages against brute force."""

import os
import random
import time
from collections import defaultdict
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendloom.llm import ann_blocks, decontaminate, html_text, substring_dedup
from spendloom.llm.queries import op1_html_text, op6_substring_dedup, oracle_sql, queries
from spendloom.llm.stored import written
from tests.oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal_to_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, queries()[name], oracle_sql()[name]) == ""


def test_tile_bounds_lose_nothing():
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = np.concatenate([base, base, base * 1e-3, base + draw.normal(size=base.shape) * 1e-6, draw.normal(size=(100, 16)) * 50])
    ids = draw.permutation(len(rows)).astype(np.int64)
    q_ids, c_ids, scores = ann_blocks.tile(ids[:30], rows[:30], ids, rows, 7)
    for k in range(30):
        full = [(-s, i) for s, i in zip(ann_blocks.exact(np.repeat(rows[k : k + 1], len(rows), 0), rows), ids) if i != ids[k]]
        assert [(-s, i) for i, s in zip(c_ids[q_ids == ids[k]], scores[q_ids == ids[k]])] == sorted(full)[:7]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [2.0, 1.0, 1.0], 1), (8, [], 1), (9, [0.5, 0.5], 1), (9, [0.5, 0.5], 1), (None, [1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in ann_blocks.nearest(vectors, vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 0.5), (1, 1, 0, 1.0), (1, 2, 9, 0.5), (9, 1, 0, 0.5), (9, 2, 1, 0.5)]
    assert ann_blocks.nearest(vectors.limit(0), vectors).collect() == []


def test_leaks_tolerate_substitutions_only(spark):
    draw = random.Random(5)
    item = [f"w{k}" for k in range(40)]
    noise = [f"n{draw.randrange(5000)}" for _ in range(200)]
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    half = [w if k % 2 else "other" for k, w in enumerate(item)]
    texts = {
        1: noise[:50] + item + noise[50:60], 2: noise[:9] + changed, 3: noise + half, 4: noise, 5: item[:9] + noise,
        6: noise[:20] + item[10:24], 7: item[30:], 8: [], 9: ["W0,", *item[1:]],
    }
    rows = [(i, " ".join(t), "x") for i, t in texts.items()] + [(None, " ".join(item), "x"), (10, None, "x"), (1, " ".join(texts[1]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(item[::-1]))], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.start, r.matched, r.words) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {1: (1, 50, 40, 40), 2: (1, 9, 33, 40), 6: (1, 10, 14, 40), 9: (1, 0, 40, 40), None: (1, 0, 40, 40)}
    kept = decontaminate.without_leaks(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 8, 10] and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), benchmark).collect() == decontaminate.leaks(docs, benchmark.limit(0)).collect() == []


def test_every_admitted_substitution_leaves_a_hit(spark):
    items, rows, wanted = [], [], set()
    for size in (1, *range(4, 14)):
        item = [f"w{size}n{k}" for k in range(size)]
        items.append((size, " ".join(item)))
        lost = max(n for n in range(size) if size - n >= 0.8 * size)
        for n in range(lost + 2):
            for gone in combinations(range(size), n):
                text = " ".join(["x", *("y" if k in gone else w for k, w in enumerate(item)), "z"])
                if n <= lost:
                    wanted.add((len(rows), size, size - n))
                rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == wanted


def test_unequal_items_of_a_null_id_are_found(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item)], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched) for r in got] == [(1, None, 20)]


def brute_repeats(texts, least=50):
    """Words covered by a run of ``least`` words that a document of lesser id holds too."""
    first, covered = {}, defaultdict(set)
    for i in sorted(texts):
        ws = (texts[i] or "").lower().split()
        for k in range(len(ws) - least + 1):
            run = " ".join(ws[k : k + least])
            if first.setdefault(run, i) != i:
                covered[i].update(range(k, k + least))
    return covered


def test_exact_repeats_are_all_found(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    mine, brute = defaultdict(set), brute_repeats(texts)
    shared = {}
    for r in op6_substring_dedup(spark, sf_dir).collect():
        assert r.first_doc_id < r.doc_id
        mine[r.doc_id].update(range(r.start, r.end))
        a = texts[r.doc_id].lower().split()[r.start : r.end]
        b = texts[r.first_doc_id].lower().split()[r.first_start : r.first_end]
        runs = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
        shared[r] = len(runs[0] & runs[1]) / len(runs[0] | runs[1])
        assert len(a) >= 50 and len(b) >= 50
    assert min(shared.values()) >= 0.8
    assert brute and all(brute[i] <= mine[i] for i in brute)


def test_repeats_with_changes_and_odd_rows(spark):
    draw = random.Random(8)

    def noise(n):
        return [f"n{draw.randrange(10**6)}" for _ in range(n)]

    passage = [f"p{k}" for k in range(120)]
    near = [*passage[:60], "new", *passage[60:]]
    single = "again " * 400
    rows = [
        (1, noise(30) + passage + noise(30)), (2, noise(80) + passage), (3, near + noise(10)), (4, noise(300)),
        (5, passage[:49] + noise(20)), (6, passage), (7, passage), (8, single.split()), (9, single.split()),
    ]
    frame = [(i, " ".join(t), "x", len(" ".join(t))) for i, t in rows]
    frame += [(None, " ".join(passage), "x", 1), (10, None, "x", 0), (11, "", "x", 0), (4, frame[3][1], "x", frame[3][3])]
    docs = spark.createDataFrame(frame, "doc_id long, text string, version string, n_chars int")
    got = substring_dedup.repeated_passages(docs.selectExpr("doc_id as id", "text")).collect()
    assert {r.id for r in got} == {2, 3, 6, 7, 9}
    assert {(r.start, r.end, r.first_id) for r in got if r.id == 2} == {(80, 200, 1)}
    assert min(r.start for r in got if r.id == 3) == 0 and max(r.end for r in got if r.id == 3) == 121
    left = substring_dedup.without_repeats(docs)
    texts = defaultdict(list)
    for r in left.collect():
        texts[r.doc_id].append(r.text)
        if r.doc_id not in (None, 10):
            assert r.n_chars == len(r.text)
    assert left.columns == docs.columns and set(texts) == {1, 2, 3, 4, 5, 8, 10, 11, None}
    assert texts[2] == [" ".join(rows[1][1][:80]) + " "] and len(texts[4]) == 2 and texts[1] == [frame[0][1]]
    assert substring_dedup.without_repeats(docs.limit(0)).collect() == []
    clashing = docs.withColumns({c: F.lit(1) for c in ("cuts", "cut_id", "cut_version")})
    again = substring_dedup.without_repeats(clashing)
    assert again.columns == clashing.columns and sorted(map(str, again.select(*docs.columns).collect())) == sorted(map(str, left.collect()))


def test_common_passage_with_different_neighbours(spark):
    """Passages that share only their middle don't hide one another's copies."""
    draw = random.Random(9)
    middle = [f"m{k}" for k in range(30)]
    sides = [([f"a{s}.{k}" for k in range(40)], [f"b{s}.{k}" for k in range(40)]) for s in range(6)]
    texts = {}
    for copy in range(2):
        for s, (a, b) in enumerate(sides):
            texts[10 * copy + s] = " ".join([f"x{draw.randrange(10**6)}" for _ in range(20)] + a + middle + b)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    covered = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        covered[r.id].update(range(r.start, r.end))
    assert all(set(range(20, 130)) <= covered[10 + s] for s in range(6))


@pytest.mark.parametrize(("length", "fragment"), [(50, 20), (60, 20), (60, 45), (140, 30)])
def test_repeat_whose_begin_also_stands_earlier(spark, length, fragment):
    draw = random.Random(10)
    passage = [f"p{k}" for k in range(length)]

    def noise(n):
        return [f"n{draw.randrange(10**6)}" for _ in range(n)]

    first = noise(30) + passage[:fragment] + noise(8) + passage + noise(20)
    second = noise(25) + passage + noise(30)
    docs = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second))], "id long, text string")
    got = [(r.start, r.end, r.first_start, r.first_end) for r in substring_dedup.repeated_passages(docs).collect()]
    assert (25, 25 + length, 38 + fragment, 38 + fragment + length) in got
    covered = {k for s, e, _, _ in got for k in range(s, e)}
    assert covered == set(range(25, 25 + length))


def test_lesser_documents_do_not_hide_exact_copies(spark):
    """Earlier documents hold 40 to 49 words of each passage, from either end; all of it stands in two later ones."""
    draw = random.Random(11)

    def noise(n):
        return [f"n{draw.randrange(10**6)}" for _ in range(n)]

    texts, passages = {}, 40
    for p in range(passages):
        passage = [f"p{p}.{k}" for k in range(50)]
        for n in range(40, 50):
            texts[1000 + 100 * p + n] = noise(20) + (passage[:n] if (n + p) % 2 else passage[-n:]) + noise(20)
        for copy in (1, 2):
            texts[100_000 * copy + p] = noise(30) + passage + noise(30)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    covered = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        covered[r.id].update(range(r.start, r.end))
    brute = brute_repeats({i: " ".join(t) for i, t in texts.items()})
    assert set(brute) == {200_000 + p for p in range(passages)}
    assert [i for i in brute if not brute[i] <= covered[i]] == []


def test_texts_that_share_a_phrase_do_not_hide_near_copies(spark):
    """Many earlier texts share no more than a phrase with two near copies, which have no long part in common unchanged."""
    draw = random.Random(12)

    def noise(n):
        return [f"n{draw.randrange(10**6)}" for _ in range(n)]

    texts, passages = {}, 30
    for p in range(passages):
        passage = [f"p{p}.{k}" for k in range(50)]
        for at in range(0, 43, 3):
            texts[1000 * p + at] = noise(60) + passage[at : at + 8] + noise(60)
        changed = [*passage[:25], f"c{p}", *passage[26:]]
        texts[100_000 + p] = noise(40) + passage + noise(40)
        texts[200_000 + p] = noise(50) + changed + noise(50)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert all(r.first_id == r.id - 100_000 and (r.start, r.end) == (50, 100) for r in got)
    # Three functions let a pair at this similarity collide with a probability of 0.99.
    assert len({r.id for r in got}) >= passages - 1


def noted(monkeypatch):
    """The tables that substring_dedup writes from now on: label and rows."""
    tables = []

    def write(df, label):
        table = written(df, label)
        tables.append((label, table.count(), table))
        return table

    monkeypatch.setattr(substring_dedup, "written", write)
    return tables


def test_texts_that_share_a_phrase_are_not_paired(spark, monkeypatch):
    """A group of texts that share no more than a phrase gives no pairs, beside a near copy in the same group."""
    draw = random.Random(13)

    def noise(n):
        return [f"n{draw.randrange(10**6)}" for _ in range(n)]

    phrase = [f"p{k}" for k in range(20)]
    texts = {i: noise(60) + phrase + noise(60) for i in range(40)}
    texts[100] = [*texts[20][:75], "changed", *texts[20][76:]]
    tables = noted(monkeypatch)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {(r.id, r.first_id) for r in got} == {(100, 20)}
    # All pairs of the 41 texts were compared before.
    assert sum(n for label, n, _ in tables if label == "unsettled-pairs") <= 1


def test_windows_that_may_be_similar_are_found():
    """Runs with one change, an insertion or a lack pass; fewer common shingles, or a greater id, don't."""
    t, rows = 46, []
    base = list(range(1, 2 * t))
    other = [200 + k % 50 for k in range(2 * t - 1)]
    changed = [base[:60] + [99] + base[61:], base[:60] + [99] + base[60:-1], base[:60] + base[61:] + [99], base[:46] + other[46:55] + base[55:]]
    for i, near in enumerate([base, *changed, other[:40] + base[40:53] + other[53:]]):
        rows.append((7, i, i, i, 100, 0, 300, 0, bytes(near), [5], True))
    rows.append((8, 0, 0, 0, 100, 0, 300, 0, bytes(base), [5], True))
    names = ["key", "most", "id", "version", "place", "left", "right", "again", "nearby", "signs", "asks"]
    table = pa.table([pa.array(x) for x in zip(*rows)], names=names)
    own, first = substring_dedup.alike(table, t, 0.8)
    found = set(zip(own.tolist(), first.tolist()))
    assert {(1, 0), (2, 0), (3, 0), (4, 0)} <= found
    assert not [x for x in found if 5 in x or 6 in x or x[0] <= x[1]]


def test_scratch_tables_and_shuffles_go_when_they_are_read(spark, sf_dir, monkeypatch):
    tables = noted(monkeypatch)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as id", "text")
    found = substring_dedup.repeated_passages(docs)
    left = [label for label, n, table in tables if n and any(os.path.exists(f.removeprefix("file://")) for f in table.inputFiles())]
    # All of them were left before.
    assert set(left) <= {"repeated-passages", "repeated-rows", "crowded-values", "similar-windows", "unsettled-pairs"}
    assert found.count() and "repeated-segments" in [label for label, _, _ in tables]

    def shuffles():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(k).name()) for k in range(blocks.size()) if blocks.apply(k).name().startswith("shuffle_")}

    before = shuffles()
    # Collected and not counted, since counting shuffles too.
    assert len(written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "sums").collect()) == 100
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not [x for x in shuffles() - before if x.endswith(".data")]


class Visible(HTMLParser):
    """Words outside head, scripts and styles, the brute way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style") and tag != "meta"

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_pages_keep_all_visible_words(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op1_html_text(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        brute = Visible()
        brute.feed(page)
        brute.close()
        assert "".join(got[i].split()).replace("-", "") == "".join("".join(brute.words).split()).replace("-", ""), i


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("Hi <b>there</b>, <i>you</i>", "Hi there, you"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol><li>d</ul>", "- a\n- b\n  3. c\n- d"),
        ("<table><tr><td>a<td>long<tr><th>wider<td>x</table>", "a     | long\nwider | x"),
        ("<table><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<title>t</title><div hidden>x</div><p style='display: none'>y</p>z", "z"),
        ("<style>.ad, #b {display:none}</style><p class='ad c'>x</p><p id=b>y</p><p class=c>z", "z"),
        ("<details><summary>s</summary>x</details><details open>y</details>", "s\n\ny"),
        ("<select><option>1<option selected>2</select>", "2"),
        ("<script>if (a < b) '</p>'</script>x<!-- y -->z", "xz"),
        ("<div>a</div></span></p><div>b <unknown>c", "a\n\nb c"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("cut <a href='x", "cut"),
        ("a < b and <3", "a < b and <3"),
    ],
)
def test_layout(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>@media print{.c{display:none}} .d{display:none}</style><p class=c>x</p><p class=d>y</p>z", "x\n\nz"),
        ("<style>@media (max-width:9px){.c{display:none}}@media screen{.d{display:none}}</style><p class=c>x<p class=d>y", "x"),
        ("<style>@import 'a';/* {.c{} */@supports (x:y){.c{display:none}}.d{color:red;display:none}</style><p class=c>x<p class=d>y", "x"),
        ("<style>.tab{display:none}.tab.active{display:block}</style><p class=tab>x</p><p class='tab active'>y</p>", "y"),
        ("<style>.a{display:block}.a{display:none}.b{display:none}.b{display:block}</style><p class=a>x</p><p class=b>y</p>", "y"),
        ("<style>.m{display:none}.m:hover{display:block}.n .m{display:block}</style><p class=m>x</p>", "x"),
        ("<style>.m{display:none}.m:hover{display:block}</style><p class=m>x</p>y", "y"),
        ("<style>.m{display:none!important}#i{display:block}</style><p class=m id=i>x</p><p class=m style='display:block'>y</p>z", "z"),
        ("<style>.m{display:none}</style><p class=m style='display:block'>y</p>z", "y\n\nz"),
        ("a<xmp><b>&amp;\n c</xmp>d", "a\n\n<b>&amp;\n c\n\nd"),
        ("a<plaintext>b</plaintext> <p>c", "a\n\nb</plaintext> <p>c"),
        ("a <svg><title>t</title><defs><text>u</text></defs><style/><rect/><text>b</text><text>c</text></svg> d", "a\nb\nc\nd"),
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x=1 b"),
    ],
)
def test_nothing_visible_is_dropped(page, text):
    assert html_text.page_text(page) == text


def test_deep_and_repeated_pages(spark):
    deep = "<div>" * 30_000 + "<ul><li>" * 300 + "x"
    assert html_text.page_text(deep).strip().endswith("x")
    rows = [(1, deep, "t"), (1, deep, "t"), (None, None, "t"), (2, "<p>" + "w " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extracted(pages)
    assert got.columns == ["page_id", "html", "text"] and [len(r.text.split()) for r in got.collect()][-2:] == [0, 200_000]
    assert html_text.extracted(pages.limit(0)).collect() == []
