"""Edit-aware token counts (operator 4).

A document's pre-tokens are gathered in leaves of ``LEAF`` (twice as many after edits at most); a segment tree over the leaves holds sums of characters and
tokens. The vocabulary's added tokens are pre-tokens of their own, and the text between them is split part by part. An
edit re-encodes the leaves it touches and no more: from the leaf that holds the character ``reach()`` before the edit (a
pre-token depends on at most two characters after its end, or on an added token that begins there) until, behind the
edit, a new pre-token ends where an old leaf ended. What is matched from there on depends on the text from there on
alone, so the rest can't change. The sums on the path to the root follow in logarithmic time. Leaves that outgrow twice
``LEAF`` are split and the tree is built anew over its leaves, once in ``LEAF`` inserted pre-tokens at most, so what an
edit re-encodes stays small however many edits have gone before.

Pre-tokens are cut by ``regex``, whose tables of letters and numbers are newer than those of the tokenizer. Characters
that are letters or numbers in them alone count as symbols (``unknown()``), so that both cut alike.

Trees are stored as two arrays, one entry a leaf, beside their documents; no shuffle is needed to build or edit them.
``edits`` is an array of (start, end, text) in characters, each on the text that the one before has left; offsets are
clipped to that text.

Defined results: null text is empty, with no pre-tokens and tokens, and stays null without edits; null edits are none;
rows are handled one by one, so repeated rows repeat;
texts of any length are encoded as a whole; an empty table gives no rows; other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns
from .packing import VOCABULARY, added_tokens, encoder, tokenizer

LEAF = 32
TREE = "n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
EDITED = "text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_reencoded long"


@cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@cache
def unknown() -> tuple[re.Pattern, re.Pattern]:
    """Letters and numbers of ``regex`` that the tokenizer's own tables take for symbols.

    They are looked for among what Python's older tables do not know: behind a symbol the tokenizer begins a new
    pre-token with a letter or number only. The first pattern finds what may be one of them, in less time.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    splits = tokenizer(public_tokenizers.path(VOCABULARY)).pre_tokenizer.pre_tokenize_str("".join(f"!{c}\n" for c in new))
    begun = {start for _, (start, _) in splits}
    ranges: list[list[int]] = []
    for c in (ord(c) for i, c in enumerate(new) if 3 * i + 1 not in begun):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    if not ranges:
        return re.compile("(?!)"), re.compile("(?!)")
    return re.compile(f"[{chr(ranges[0][0])}-\U0010ffff]"), re.compile(f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in ranges)}]")


@cache
def reach() -> int:
    """Characters before an edit on which it can have an effect."""
    return 2 + max(map(len, added_tokens()[1]), default=0)


def pre_tokens(text: str, pos: int = 0) -> Iterator[str]:
    """Pre-tokens from pos on, where one begins."""
    plain = text if text.isascii() or not unknown()[0].search(text) else unknown()[1].sub("\ue000", text)  # a symbol
    while pos < len(text):
        found = added_tokens()[0].search(text, pos)
        end = found.start() if found else len(text)
        for piece in pattern().finditer(plain, pos, end):
            yield text[piece.start() : piece.end()]
        if found:
            yield found[0]
        pos = found.end() if found else end


@lru_cache(200_000)
def n_tokens(piece: str) -> int:
    """Tokens of one pre-token."""
    return len(encoder()(piece))


class Tree:
    """Sums of characters and tokens over leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = max(1, len(chars))
        self.size = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if chars:
            self.sums[self.size : self.size + self.n] = np.stack([chars, tokens], axis=1)
        level = self.size
        while level > 1:
            level //= 2
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level : 2] + self.sums[2 * level + 1 : 4 * level : 2]

    @property
    def total(self) -> tuple[int, int]:
        """Characters and tokens of the text."""
        return int(self.sums[1, 0]), int(self.sums[1, 1])

    def leaves(self) -> tuple[list[int], list[int]]:
        own = self.sums[self.size : self.size + self.n]
        return own[:, 0].tolist(), own[:, 1].tolist()

    def chars(self, leaf: int) -> int:
        return int(self.sums[self.size + leaf, 0])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last leaf with characters if it is past the end."""
        at, node, start = max(0, min(at, self.total[0] - 1)), 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node = 2 * node
            if at - start >= left:
                node, start = node + 1, start + left
        return min(node - self.size, self.n - 1), start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node and change.any():
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """The text after an edit, and how many pre-tokens were encoded for it."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        text, shift, behind = text[:start] + new + text[end:], len(new) - (end - start), start + len(new)
        first, at = self.find(start - reach())
        leaf, old_end = first, at + self.chars(first)
        pos, new_leaves, pieces = at, [], pre_tokens(text, at)
        seen: list[tuple[int, int]] = []
        while True:
            while old_end < max(pos - shift, end) and leaf + 1 < self.n:
                leaf += 1
                old_end += self.chars(leaf)
            if pos >= behind and pos - shift == old_end:
                break
            piece = next(pieces)
            pos += len(piece)
            seen.append((len(piece), n_tokens(piece)))
        step = LEAF if len(seen) > 2 * LEAF else 2 * LEAF
        for i in range(0, len(seen), step):
            new_leaves.append([sum(column) for column in zip(*seen[i : i + step], strict=True)])
        if len(new_leaves) <= leaf - first + 1:
            for i in range(first, leaf + 1):
                self.set(i, *(new_leaves[i - first] if i - first < len(new_leaves) else (0, 0)))
        else:
            own = list(zip(*self.leaves(), strict=True))
            own[first : leaf + 1] = new_leaves
            self.__init__(*map(list, zip(*[x for x in own if x[0]], strict=True)))
        return text, len(seen)


def build(text: str | None) -> tuple[int, list[int], list[int]]:
    """Tokens of a text, and characters and tokens of its leaves."""
    pieces = list(pre_tokens(text or ""))
    chars, tokens = [], []
    for at in range(0, len(pieces), LEAF):
        part = pieces[at : at + LEAF]
        chars.append(sum(map(len, part)))
        tokens.append(sum(map(n_tokens, part)))
    return sum(tokens), chars, tokens


def token_trees(docs: DataFrame) -> DataFrame:
    """docs with the columns of TREE."""
    return add_columns(docs, [docs["text"]], lambda texts: [build(t) for t in texts], TREE)


def edit_trees(docs: DataFrame, edits: str = "edits") -> DataFrame:
    """Documents with trees and a column of edits: text, tree and n_tokens after the edits, and pre-tokens re-encoded."""

    def fn(texts, chars, tokens, todo) -> list[tuple]:
        out = []
        for text, c, t, own in zip(texts, chars, tokens, todo, strict=True):
            if not own:
                out.append((text, sum(t), c, t, 0))
                continue
            tree, text, seen = Tree(c, t), text or "", 0
            for x in own:
                text, n = tree.edit(text, x["start"], x["end"], x["text"] or "")
                seen += n
            out.append((text, tree.total[1], *tree.leaves(), seen))
        return out

    return add_columns(docs, [docs[c] for c in ("text", "leaf_chars", "leaf_tokens", edits)], fn, EDITED)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the rows of an edit table (doc_id, seq, start, end, text) as an array in order of seq."""
    one = F.sort_array(F.collect_list(F.struct("seq", "start", "end", "text")))
    listed = edits.groupBy("doc_id").agg(F.transform(one, lambda x: F.struct(x["start"], x["end"], x["text"])).alias("edits"))
    return docs.join(listed, "doc_id", "left")


def sample_edits(text: Column) -> Column:
    """Three edits of a text, last first: capitals at three quarters, an insertion in the middle, a cut at a quarter."""
    n = F.length(F.coalesce(text, F.lit("")))
    a, b, c = (F.floor(n * i / 4).cast("int") for i in (1, 2, 3))
    parts = [(c, c + 12, F.upper(F.substring(text, c + 1, F.lit(12)))), (b, b, F.lit(" 'tis an edit")), (a, a + 9, F.lit(""))]
    return F.array(*[F.struct(s.alias("start"), e.alias("end"), F.coalesce(t, F.lit("")).alias("text")) for s, e, t in parts])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after three edits derived from its text: doc_id, n_tokens, n_tokens_edited, ..."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = token_trees(docs).withColumn("edits", sample_edits(F.col("text"))).withColumn("n_before", F.col("n_tokens"))
    out = edit_trees(trees)
    return out.select(
        "doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        F.size("edits").cast("long").alias("n_edits"), F.size("leaf_chars").cast("long").alias("n_leaves"), "n_reencoded",
    )


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
