"""Token counts and the transducer against the libraries."""

import random

import pytest
import sentencepiece

from spendloom.llm import piece_fst, token_counts
from spendloom.llm.queries import op8_token_counts, op9_piece_fst

MODEL = token_counts.vocabulary("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", "a ", " a", "a  b", "\n", "a\tb\r\n", "<s> </s> <unk> <0x41>", "▁a ▁", "é🙂漢字ﬁ", "\u0000x", "x" * 300,
    "aaaa" * 50 + " " * 40 + "b", "word.\nNext", "😀" * 60,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return piece_fst.Transducer(MODEL, remembered=500).compile()


def random_texts(n):
    draw = random.Random(n)
    letters = " aaabbeethisthe  éß漢🙂\t\n\r0123-.,<s>ﬁ▁"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(n)]


def test_counts_of_odd_and_random_texts(library):
    texts = ODD + random_texts(500)
    assert token_counts.Counter(MODEL, remembered=200).count(texts) == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_other_vocabularies_with_cuts(name):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary(name)
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    texts = [*ODD, "some words, and more's the <|endoftext|> pity " * 40, "no-cuts" * 100]
    expected = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path, long=50).count(texts) == expected


def test_count_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts(spark, sf_dir).collect()}
    expected = {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
    assert got == expected


def test_encodings_of_odd_and_random_texts(machine, library):
    texts = ODD + random_texts(800)
    for text, ids in zip(texts, map(machine.encode, texts)):
        assert ids == library.encode(text)
        assert machine.decode(ids) == library.decode(ids)


def test_batches_equal_single_paths(machine):
    marked = ["▁" + w for w in "internationalisation the aaaaaa zzzzz x".split()]
    import numpy as np

    assert [np.frombuffer(p, "<i4").tolist() for p in machine.paths_of(marked)] == [machine.path_of(m) for m in marked]


def test_pairs_are_told_apart_without_merging_their_texts(monkeypatch):
    machine = piece_fst.Transducer(MODEL).compile()
    draw, ids = random.Random(5), list(machine.arc.values())
    alike = [i for i in ids if set(machine.names[i]) <= set("aehnrt▁")]
    pairs = [(draw.choice(some), draw.choice(some)) for some in (ids, alike) for _ in range(4000)]
    merged = [machine.merged(machine.names[a] + machine.names[b]) == [machine.names[a], machine.names[b]] for a, b in pairs]
    assert 0 < sum(merged) < len(pairs)
    monkeypatch.setattr(machine, "merged", None)
    assert [machine.fits(a, b) for a, b in pairs] == merged


def test_encoding_query_and_round_trip(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    encoded = op9_piece_fst(spark, sf_dir)
    got = {r.doc_id: r for r in piece_fst.decoded(encoded, MODEL, text_col="back").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i].token_ids == library.encode(text)
        assert (got[i].back, got[i].n_tokens, got[i].lossless) == (text, len(got[i].token_ids), True)


def test_odd_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "a▁b", 8), (2, "", 9), (3, "x " * 100_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = piece_fst.encoded(docs, MODEL).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and got[2].lossless is False and got[4].lossless
    assert got[0].asDict().keys() == {"doc_id", "text", "token_ids", "n_tokens", "lossless"}
    counted = token_counts.token_counts(docs, MODEL).collect()
    assert [(r.id, r.n_bytes, r.n_tokens) for r in counted][:2] == [(1, 0, 0), (1, 0, 0)]
    assert counted[4].over_limit and counted[4].n_tokens == got[4].n_tokens
    for result in (piece_fst.encoded(docs.limit(0), MODEL), token_counts.token_counts(docs.limit(0), MODEL)):
        assert result.collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert piece_fst.decoded(null, MODEL).first().text is None
