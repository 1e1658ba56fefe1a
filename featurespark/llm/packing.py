"""Best-fit decreasing packing of tokenised documents into sequences of bounded length (operator 5).

1. Tasks tokenise whole texts, append the end id, and cut only documents over ``capacity`` into pieces; the first piece
   takes what is over, all others are full. Only numbers go on: no text or id leaves the task.
2. Best fit depends on lengths alone, and there are at most ``capacity`` lengths. Spark counts pieces by length; the
   driver packs these counts in decreasing length. A segment tree over remaining capacities finds the tightest open
   sequences in logarithmic time; all pieces of one length that go to sequences of one remaining capacity move as a run.
   What passes the driver, these runs, is bounded by about the square of ``capacity``, not by the number of documents.
3. Each piece gets its rank among those of its length: row number within (length, bucket) plus the sizes of the buckets
   before it, so that a length that a third of all pieces share is spread over many tasks. The run that holds the rank
   gives sequence and offset. The runs, a few for each length, are broadcast.

Ids are those of the byte-level BPE vocabulary file of ``tokenizers``. As there, a text is split at the strings of the
file's added tokens, which have ids of their own, and the parts are encoded one by one. The same vocabulary as ranks is
about five times as fast in ``tiktoken`` and gives the same ids (a test compares them); a part that it refuses goes to
``tokenizers``.

Defined results: null text is empty and becomes one piece of the end id; repeated rows and ids are packed row for row;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, map_rows, written

RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@cache
def added_tokens(vocabulary_file: str | None = None) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern of the vocabulary's added tokens, the longest first, and their ids."""
    import public_tokenizers

    with open(vocabulary_file or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in found):
        raise ValueError("added tokens that take spaces or whole words alone are not supported")
    ids = {x["content"]: x["id"] for x in found}
    return re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True))) or "(?!)"), ids


@cache
def encoder(ranks_file: str | None = None, vocabulary_file: str | None = None):
    """A function from text to ids. Files default to the public tokenizer folder of this machine."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added, added_ids = added_tokens(vocabulary_file)

    def part(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # its pattern engine panics on very long runs, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return tokenizer(vocabulary_file or public_tokenizers.path(VOCABULARY)).encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for found in added.finditer(text):
            out += part(text[at : found.start()])
            out.append(added_ids[found[0]])
            at = found.end()
        return out + part(text[at:]) if at else part(text)

    return encode


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes the remainder, the others are full."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, len(ids), capacity)]


def cut(docs: DataFrame, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def fn(columns: list[list]) -> dict:
        encode = encoder()
        out: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(*columns, strict=True):
            ids = np.array([*encode(text or ""), end_id], "<u4")
            for i, (start, length) in enumerate(pieces(ids, capacity)):
                row = (doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return map_rows(docs.select("doc_id", "text"), fn, schema)


class Tree:
    """Segment tree over remaining capacities: which of them have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that has open sequences."""
        at = length + self.size
        while not self.open[at]:
            while at & 1:  # a right child: nothing further right below the same parent
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.size:
            at = 2 * at + (not self.open[2 * at])
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces per sequence, first sequence, offset) of best fit decreasing.

    Equal lengths are interchangeable: the next of them goes to the sequence just used while it still fits, since that
    has become the tightest, then to the next sequence of the same remaining capacity.
    """
    tree, groups, runs, n_sequences = Tree(capacity), {}, [], 0

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            groups.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = n_sequences, -(-todo // each)
                n_sequences += n
            else:
                each = left // length
                first, n = groups[left].pop()
                if not groups[left]:
                    tree.set(left, False)
            full, rest = divmod(min(todo, n * each), each)
            runs.append((length, rank, each, first, capacity - left))
            give(left - each * length, first, full)
            give(left - rest * length, first + full, min(1, rest))
            give(left, first + full + min(1, rest), n - full - min(1, rest))
            rank += full * each + rest
            todo -= full * each + rest
    return runs


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = written(cut(docs, capacity, end_id).withColumn("bucket", F.spark_partition_id()))
    sizes = cuts.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(runs[order])

    def place(lengths: list[int], ranks: list[int]) -> list[tuple]:
        table, lengths, ranks = shared.value, np.array(lengths, np.int64), np.array(ranks, np.int64)
        key = table[:, 0] << 44 | table[:, 1]
        _, first, each, sequence, offset = table[np.searchsorted(key, lengths << 44 | ranks, "right") - 1].T
        nth = ranks - first
        return list(zip((sequence + nth // each).tolist(), (offset + nth % each * lengths).tolist(), strict=True))

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cuts.withColumn("rank", rank).join(sizes.drop("count"), ["length", "bucket"])
    out = add_columns(
        ranked, [ranked["length"], ranked["rank"] - 1 + ranked["before"]], place, "sequence_id long, offset long", 4096
    )
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
