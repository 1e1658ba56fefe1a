import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featurespark.llm.packing import Tree, cut, encoder, op5_best_fit_packing, pack, plan


SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_best_fit(lengths, capacity):
    """Remaining capacities of best fit decreasing, one item at a time."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_runs_are_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs = plan(counts, capacity)
    used: dict = {}
    for length, n in counts.items():
        own = sorted(r for r in runs if r[0] == length)
        for rank in range(n):
            _, first, each, sequence, offset = [r for r in own if r[1] <= rank][-1]
            nth = rank - first
            used.setdefault(sequence + nth // each, []).append((offset + nth % each * length, length))
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    left = [capacity - sum(x for _, x in s) for s in used.values()]
    assert sorted(left) == plain_best_fit(lengths, capacity)


@given(st.sets(st.integers(0, 50)), st.integers(0, 50))
def test_tree_finds_tightest(opened, length):
    tree = Tree(50)
    for x in opened:
        tree.set(x, True)
    assert tree.tightest(length) == min((x for x in opened if x >= length), default=None)


def test_ids_equal_the_vocabulary_file(spark, sf):
    slow = SLOW
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text in [*texts, "", " \n\t  x", "é 　😀" * 9, "a" * 5000, "0 1  2\r\n"]:
        assert encoder()(text) == slow.encode(text, add_special_tokens=False).ids


def check_documents(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, own in by_doc.items():
        ids, at = np.array([*encoder()(texts[doc_id] or ""), 0], "<u4"), 0
        for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert i == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(own) == 1 or at > capacity)


def check_sequences(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_query_packs_all_documents(spark, sf):
    rows = op5_best_fit_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    check_documents(rows, texts, 2048)
    n = check_sequences(rows, 2048)
    assert n == len(plain_best_fit([r.length for r in rows], 2048))
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_null_empty_repeated_and_long(spark):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "a b c"), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as bucket")
    out = pack(df, 16).collect()
    assert sum(r.doc_id == 4 for r in out) == 2
    check_documents([r for r in out if r.doc_id != 4], dict(rows), 16)
    check_sequences(out, 16)
    assert pack(df.limit(0)).count() == 0


def test_added_tokens_have_their_own_ids():
    slow = SLOW
    end = "<|endoftext|>"
    assert encoder()(f"a {end} b") == [64, 220, 50256, 275]
    for text in [end, end * 3, f"{end} a", f"a  {end}", f"a\n\n  {end}  \nb", f"<|endoftext{end}|>", f"<{end[1:-1]}", f"it{end}'s"]:
        assert encoder()(text) == slow.encode(text, add_special_tokens=False).ids


def test_packed_ids_hold_added_tokens(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = pack(df, 16).first()
    assert (row.length, row.ids_crc32) == (5, zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes()))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "'s", "a", "é", "1"]), max_size=30).map("".join)))
def test_ids_equal_the_vocabulary_file_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder()(text) == SLOW.encode(text, add_special_tokens=False).ids


def test_very_long_runs(spark):
    rows = [(1, " " * 1_500_000), (2, "word " * 200_000)]
    found = cut(spark.createDataFrame(rows, "doc_id long, text string"), 2048).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in found} == {1, 2} and all(r[1] > 100_000 for r in found)
