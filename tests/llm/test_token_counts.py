import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featurespark.llm.packing import encoder
from featurespark.llm.token_counts import LEAF, Tree, build, edit_trees, op4_token_counts, pre_tokens, token_trees, with_edits

SOME = [" ", "  ", "\n", "a", "I'll", "'", "'s", "re", "x1", "99", "!?", "é", "\t \n", " the", "😀"]


@settings(max_examples=250, deadline=None)
@given(st.randoms(use_true_random=False))
def test_edits_equal_full_encoding(rng: random.Random):
    text = "".join(rng.choices(SOME, k=rng.choice([0, 1, 5, 300])))
    _, chars, tokens = build(text)
    tree = Tree(chars, tokens)
    for _ in range(6):
        a, b = rng.randrange(-2, len(text) + 3), rng.randrange(-2, len(text) + 3)
        a, b = (a, min(b, a + 4)) if rng.random() < 0.7 else (a, b)
        new = "".join(rng.choices(SOME, k=rng.choice([0, 1, 3, 90])))
        s = max(0, min(a, len(text)))
        e = max(s, min(b, len(text)))
        want = text[:s] + new + text[e:]
        text, _ = tree.edit(text, a, b, new)
        assert text == want
        assert tree.total == (len(text), len(encoder()(text)))


def test_only_touched_leaves_are_encoded():
    text = "some words go here, " * 5000
    tree = Tree(*build(text)[1:])
    text, seen = tree.edit(text, 50000, 50001, "Z")
    assert tree.total[1] == len(encoder()(text)) and seen <= 3 * LEAF


def test_query_equals_full_encoding(spark, sf):
    rows = {r.doc_id: r for r in op4_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        text, n = d.text, len(d.text)
        assert rows[d.doc_id].n_tokens == len(encoder()(text))
        a, b, c = n // 4, n // 2, n * 3 // 4
        text = text[:c] + text[c : c + 12].upper() + text[c + 12 :]
        text = text[:b] + " 'tis an edit" + text[b:]
        text = text[:a] + text[a + 9 :]
        assert rows[d.doc_id].n_tokens_edited == len(encoder()(text))


def test_edit_table_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "left alone")], "doc_id long, text string").selectExpr("*", "7 as n_tokens", "8 as other")
    edits = spark.createDataFrame([(3, 2, 0, 3, "ONE"), (3, 1, 3, 3, " and"), (1, 1, 5, 9, "new"), (2, 1, 0, 0, None), (9, 1, 0, 0, "x")], "doc_id long, seq int, start int, end int, text string")
    out = edit_trees(with_edits(token_trees(docs), edits)).collect()
    texts = sorted((r.doc_id, r.text) for r in out if r.doc_id != 4)
    assert texts == [(1, "new"), (2, ""), (3, "ONE and two three"), (3, "ONE and two three")]
    assert all(r.n_tokens == len(encoder()(r.text or "")) and r.other == 8 for r in out)
    assert [r.n_reencoded for r in out if r.doc_id == 4] == [0]
    assert token_trees(docs.limit(0)).count() == 0


@settings(max_examples=250, deadline=None)
@given(st.randoms(use_true_random=False))
def test_edits_make_and_break_added_tokens(rng: random.Random):
    some = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "a", "endoftext", "!", "'s"]
    text = "".join(rng.choices(some, k=rng.choice([1, 5, 200])))
    tree = Tree(*build(text)[1:])
    assert tree.total == (len(text), len(encoder()(text)))
    for _ in range(8):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(3))
        new = "".join(rng.choices(some, k=rng.choice([0, 0, 1, 2])))
        want = text[:a] + new + text[b:]
        text, _ = tree.edit(text, a, b, new)
        assert text == want
        assert tree.total == (len(text), len(encoder()(text)))


def test_added_token_counts_once():
    assert build("a <|endoftext|> b")[0] == 4


def test_many_edits_in_one_place_stay_cheap():
    text = "some words go here, " * 2000
    tree, at, most = Tree(*build(text)[1:]), 20_000, 0
    for i in range(1000):
        text, seen = tree.edit(text, at, at, f" and {i} more")
        most = max(most, seen)
        at += 3
    assert most <= 6 * LEAF and tree.total == (len(text), len(encoder()(text)))
    for _ in range(500):
        text, seen = tree.edit(text, 15_000, 15_040, "")
        most = max(most, seen)
    assert most <= 6 * LEAF and tree.total == (len(text), len(encoder()(text)))


def test_pre_tokens_are_cut_as_the_vocabulary_file_says():
    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    for low in [*range(0, 0x40000, 0x4000), 0xE0000]:
        text = "".join(f"1'a{chr(c)}'s 1{chr(c)}\n" for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000)
        assert list(pre_tokens(text)) == [text[i:j] for _, (i, j) in split(text)]


def test_very_long_texts_and_runs(spark):
    rows = [(1, "word 12 " * 100_000), (2, " " * 1_500_000), (3, "^" * 300_000), (4, "\U0003da17's")]
    out = {r.doc_id: r for r in token_trees(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_tokens == len(encoder()(rows[0][1])) and out[4].n_tokens == 6
    assert all(sum(out[i].leaf_chars) == len(t) and sum(out[i].leaf_tokens) == out[i].n_tokens for i, t in rows)
