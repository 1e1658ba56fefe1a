"""Near-duplicate groups by min-max hashing (operator 3).

A document's set holds its distinct k-word shingles. Under each of ``values / 2`` permutations both the minimum and the
maximum are kept: two unbiased signature values for one evaluation. Signatures are banded; documents that share a band
are candidates. Rows per band are the most for which a pair at the threshold is missed with a chance of at most
``miss`` (with 120 values: 24 bands of 5 at 0.85, chance 8e-7; 30 of 4 at 0.8).

1. Documents with the same set are one class, represented by the smallest doc_id: copies never meet in pairs.
2. Each bucket has one hub, drawn by hash. Of all its hubs a representative is compared with the one of most like
   signature (a star, not all pairs), on full sets rebuilt from the texts, so links are exact. Components join the stars.
   Texts are dealt once to their ids' parts in the stars and once to hubs, of which large ones have copies.
3. In buckets that still hold more than one component, members outside the largest are compared with a hub of that.
4. What is still split is searched in blocks. Members get a longer signature (``LONG`` values) and are dealt, without
   texts, into cells of about ``BLOCK`` members on either side: those outside the largest component by all. A cell lists
   the pairs of different components that may reach the threshold, each pair in the first band it shares only. A pair at
   the threshold agrees in fewer values than are asked for with a chance of at most ``miss`` (at 0.85: 188 of 256).
5. Only members of listed pairs bring their texts to the cell, where pairs are confirmed on full sets unless their
   components have been linked meanwhile. Cells are cut finer where shingles weigh over ``HEAVY``, which bounds the texts
   that meet in one task. Pairs never leave a cell, only links do.

A pair at the threshold is lost with a chance of at most twice ``miss``: bands and long signatures together. The first
band that a pair shares is told by 64 bits of its key.

Sets of ids are met by Bloom filters of bounded size and an exact join of what they leave in doubt (``bloom``), at any size.

Defined results: null and wordless text has an empty set (n_shingles 0), is linked with nothing and is kept; rows of one
doc_id are one document, which is linked if one of its texts is; a null doc_id takes its class's component, or null, and
is not kept; texts of any length count as a whole; an empty table gives no rows. ``drop_near_duplicates`` keeps one row of
each group and all rows without words; where ids are null or repeat, it goes by rows instead of ids, so that no text is
lost; other input columns pass through it, clashing names included.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bloom import perhaps, rows_among, rows_not_among
from .common import map_rows, mix64, scratch, space_words, written
from .decontaminate import gram_hashes, word_hashes
from .graph import components

BLOCK = 1024
HEAVY = 1 << 21
LONG = 256
#: Members that are compared with one copy of their hub's set; a hub of more has copies.
FOLLOWERS = 256


def shape(threshold: float, values: int, miss: float) -> tuple[int, int]:
    """Bands and rows per band: the most rows that miss a pair at the threshold with at most that chance."""
    fits = [r for r in range(1, values + 1) if (1 - threshold**r) ** (values // r) <= miss]
    r = max(fits, default=1)
    return values // r, r


def least_agreeing(threshold: float, values: int, miss: float) -> int:
    """The most signature values of which a pair at the threshold agrees in fewer with a chance of at most ``miss``."""
    tail = 0.0
    for n in range(values + 1):
        tail += comb(values, n) * threshold**n * (1 - threshold) ** (values - n)
        if tail > miss:
            return n
    return values


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle, no words none."""
    words = space_words(text)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


class MinMax:
    """Signatures of ``values`` numbers from half as many permutations."""

    def __init__(self, values: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = values // 2
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low, high = [], []
        for at in range(0, len(hashes), 4096):  # bounded memory for long documents
            x = self.a * hashes[at : at + 4096] + self.b
            low.append(x.min(axis=1))
            high.append(x.max(axis=1))
        return np.stack([np.min(low, axis=0), np.max(high, axis=0)], axis=1).reshape(-1)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bucket keys of the bands, and a byte of each signature value."""
    minmax = MinMax(bands * rows + bands * rows % 2)

    def fn(columns: list[list]) -> dict:
        out: dict = {"doc_id": [], "n_shingles": [], "digest": [], "bands": [], "sketch": []}
        for doc_id, text in zip(*columns, strict=True):
            hashes = shingle_set(text, k)
            out["doc_id"].append(doc_id)
            out["n_shingles"].append(len(hashes))
            if len(hashes):
                values = mix64(minmax(hashes))[: bands * rows]
                keys = np.arange(1, bands + 1, dtype=np.uint64)
                for column in values.reshape(bands, rows).T:
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
                out["digest"].append(xxhash.xxh3_128_digest(hashes.tobytes()))
                out["bands"].append(keys.view(np.int64))
                out["sketch"].append((values >> np.uint64(56)).astype(np.uint8).tobytes())
            else:
                for c in ("digest", "bands", "sketch"):
                    out[c].append(None)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary"
    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), fn, schema)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), one for each a, those whose sets have 100 * intersection >= percent * union.

    Texts are read by a filter of the ids in pairs, joined with their parts in the comparison, and dealt once more by hub:
    a hub's text comes first, then up to about FOLLOWERS others, streamed past its set. So a hub of any number of followers
    is spread over tasks, and a task holds the set of one hub.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("copies"))
    parts = pairs.join(hubs, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "copies").cast("int").alias("copy"), F.lit(1).alias("follows"))
    copies = hubs.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("follows"))
    parts = written(parts.unionByName(copies))
    near = texts.filter(perhaps(parts.select("node").distinct())(F.col("node"))).join(parts, "node")
    dealt = near.select("hub", "copy", "follows", "node", "text").repartition("hub", "copy").sortWithinPartitions("hub", "copy", "follows")
    kind = pairs.schema["a"].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"a {kind}, b {kind}"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for batch in batches:
            out: dict = {"a": [], "b": []}
            for at in range(0, batch.num_rows, 64):
                for b, copy, follows, node, text in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    s = shingle_set(text, k)
                    if not follows:
                        hub, sets = (hub, [*sets, s]) if hub == (b, copy) else ((b, copy), [s])
                    elif any(100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and _alike(s, t, percent) for t in sets):
                        out["a"].append(node)
                        out["b"].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return dealt.mapInArrow(over, f"a {kind}, b {kind}").distinct()


def _best_hub(pairs: DataFrame, sketches: DataFrame, percent: int, least: int) -> DataFrame:
    """For each a of the pairs (a, b) the b of most like signature, if the pair may reach the threshold."""

    def fn(columns: list[list]) -> dict:
        out: dict = {"a": [], "b": [], "like": []}
        for a, b, x, y, n, m in zip(*columns, strict=True):
            like = int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum())
            if like >= least and 100 * min(n, m) >= percent * max(n, m):
                for c, v in zip(out, (a, b, float(like)), strict=True):
                    out[c].append(v)
        return out

    for c, n in (("a", "n"), ("b", "m")):
        pairs = pairs.join(sketches.withColumnsRenamed({"node": c, "sketch": f"s{c}", "n_shingles": n}), c)
    kind = pairs.schema["a"].dataType.simpleString()
    found = map_rows(pairs.select("a", "b", "sa", "sb", "n", "m"), fn, f"a {kind}, b {kind}, like double", rows=2048)
    return found.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b"))


def _split_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, node, n, component) of buckets with more than one component, with the bucket's largest component
    (main), its members and shingles (m, w), and those outside the largest (m_out, w_out)."""
    named = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    top = F.max_by(F.struct("component", "c", "w"), F.struct("c", "component")).alias("top")
    sizes = sizes.groupBy("key").agg(top, F.sum("c").alias("m"), F.sum("w").alias("w")).filter("top.c < m")
    sizes = sizes.select("key", F.col("top.component").alias("main"), "m", "w", F.expr("m - top.c as m_out"), F.expr("w - top.w as w_out"))
    return written(named.join(written(sizes), "key"))


def _to_main(split: DataFrame) -> DataFrame:
    """Pairs (a, b): members outside their bucket's largest component, and a hub drawn from that."""
    hub = F.min_by("node", F.xxhash64("node", "key", F.lit(2))).alias("b")
    hubs = written(split.filter("component = main").groupBy("key").agg(hub))
    return written(split.filter("component <> main").join(hubs, "key").select(F.col("node").alias("a"), "b")).distinct()


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two non-empty sets."""
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _long_sketches(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """node, a byte of each of LONG signature values (other permutations than those of the bands), and the bands' keys."""
    minmax = MinMax(LONG, seed=2)

    def fn(columns: list[list]) -> dict:
        nodes, texts, keys = columns
        values = [mix64(minmax(shingle_set(t, k))) >> np.uint64(56) for t in texts]
        return {"node": nodes, "long": [v.astype(np.uint8).tobytes() for v in values], "first": [np.array(x, np.int64).tobytes() for x in keys]}

    kind = texts.schema["node"].dataType.simpleString()
    return map_rows(texts.select("node", "text", "bands"), fn, f"node {kind}, long binary, first binary")


def _cells(split: DataFrame, long: DataFrame) -> DataFrame:
    """Members of split buckets with their signatures, once in each of their cells (i, j) of the bucket.

    Members outside the main component are dealt into nx parts and lie in all cells of one i; all members are dealt into
    ny parts and lie in all cells of one j.
    """
    parts = lambda m, w: F.ceil(F.greatest(F.col(m) / BLOCK, F.col(w) / HEAVY)).cast("int")
    dealt = split.join(long, "node").withColumns({"nx": parts("m_out", "w_out"), "ny": parts("m", "w")})
    hashed = F.xxhash64("node")
    dealt = dealt.withColumns({"px": F.when(F.col("component") != F.col("main"), F.pmod(hashed, "nx").cast("int")), "py": F.pmod(hashed, "ny").cast("int")})
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_y = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda i: cell(i, F.col("py")))
    as_x = F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda j: cell(F.col("px"), j))
    cells = F.when(F.col("px").isNull(), as_y).otherwise(F.array_union(as_y, as_x))
    return dealt.withColumn("cell", F.explode(cells)).select("key", "cell", "node", "component", "n", "long", "first", "px", "py")


def _listed(cells: DataFrame, percent: int, least: int) -> DataFrame:
    """key, cell, node, component, partners: members of pairs that may reach the threshold, the pair's other end at one."""

    def fn(columns: list[list]) -> dict:
        out: dict = {"key": [], "cell": [], "node": [], "component": [], "partners": []}
        for key, cell, group in zip(*columns, strict=True):
            ys = [g for g in group if g["py"] == cell["j"]]
            xs = [g for g in group if g["px"] == cell["i"]]
            if not xs or not ys:
                continue
            stacked = lambda name, kind: np.frombuffer(b"".join(g[name] for g in ys), kind).reshape(len(ys), -1)
            bits, first = stacked("long", np.uint8), stacked("first", np.int64)
            sizes, number = np.array([g["n"] for g in ys]), {g["component"]: i for i, g in enumerate(group)}
            comps = np.array([number[g["component"]] for g in ys])
            here = np.int64(key)
            met: dict = {}
            for g in xs:
                n = g["n"]
                fits = (comps != number[g["component"]]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                at = np.flatnonzero(fits)
                like = (bits[at] == np.frombuffer(g["long"], np.uint8)).sum(axis=1)
                at, like = at[like >= least], like[like >= least]
                own = np.frombuffer(g["first"], np.int64)
                at = at[np.argsort(-like, kind="stable")]
                at = at[(first[at] == own).argmax(axis=1) == (own == here).argmax()]
                # of two members outside the main component each would list the other
                partners = [ys[z]["node"] for z in at.tolist() if ys[z]["px"] is None or ys[z]["node"] > g["node"]]
                if partners:
                    met.setdefault(g["node"], []).extend(partners)
                    for z in partners:
                        met.setdefault(z, [])
            of = {g["node"]: g["component"] for g in group}
            for node, partners in met.items():
                for c, v in zip(out, (key, cell, node, of[node], partners), strict=True):
                    out[c].append(v)
        return out

    kind = cells.schema["node"].dataType.simpleString()
    member = F.struct("node", "component", "n", "long", "first", "px", "py")
    groups = cells.groupBy("key", "cell").agg(F.collect_list(member).alias("group"))
    schema = f"key long, cell struct<i: int, j: int>, node {kind}, component {kind}, partners array<{kind}>"
    return map_rows(groups, fn, schema, rows=16)


def _confirmed(listed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the listed pairs of each cell, as many as connect what is linked."""

    def fn(columns: list[list]) -> dict:
        out: dict = {"a": [], "b": []}
        for (group,) in zip(*columns, strict=True):
            up = {g["component"]: g["component"] for g in group}
            of: dict = {}
            for g in group:
                of.setdefault(g["node"], []).append(g)
            sets: dict = {}

            def root(c):
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            def sets_of(node):
                if node not in sets:
                    sets[node] = [shingle_set(g["text"], k) for g in of[node]]
                return sets[node]

            for node, rows in of.items():
                for z in dict.fromkeys(z for g in rows for z in g["partners"]):
                    c, d = root(rows[0]["component"]), root(of[z][0]["component"])
                    if c != d and any(_alike(s, t, percent) for s in sets_of(node) for t in sets_of(z)):
                        up[c] = d
                        out["a"].append(node)
                        out["b"].append(z)
        return out

    kind = listed.schema["node"].dataType.simpleString()
    member = F.struct("node", "component", "partners", "text")
    groups = listed.join(texts.select("node", "text"), "node").groupBy("key", "cell").agg(F.collect_list(member).alias("group"))
    return map_rows(groups.select("group"), fn, f"a {kind}, b {kind}", rows=4)


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, values: int = 120, miss: float = 1e-6
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    bands, rows = shape(percent / 100, values, miss)
    least, least_long = least_agreeing(percent / 100, bands * rows, miss), least_agreeing(percent / 100, LONG, miss)
    docs = docs.select("doc_id", "text")
    with scratch() as tables:
        marks = written(signatures(docs, k, bands, rows))
        same = [F.first(c).alias(c) for c in ("bands", "sketch", "n_shingles")]  # equal in a class
        classes = marks.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), *same)
        classes = written(classes)
        buckets = classes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
        hub = F.min_by("node", F.xxhash64("node", "key")).alias("hub")
        hubs = buckets.groupBy("key").agg(hub, F.min("node").alias("c"), F.max("node").alias("d")).filter("c < d")
        members = written(buckets.join(written(hubs.select("key", "hub")), "key"))
        wanted = written(members.select("node").distinct())
        chosen = written(rows_among(classes, wanted))
        sketches = chosen.select("node", "sketch", "n_shingles")
        texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
        verify = lambda pairs, texts: _verified(written(_best_hub(pairs, sketches, percent, least)), texts, k, percent)
        links = written(verify(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), texts))
        found = components(links)
        for last in (False, True):
            split = _split_buckets(members.select("key", "node", "n"), found)
            if not last:  # only what is still split needs texts from here on
                texts = written(rows_among(texts, split.select("node").distinct()))
            if last:
                own = texts.join(split.select("node").distinct(), "node", "left_semi")
                long = written(_long_sketches(own.join(chosen.select("node", "bands"), "node"), k, bands, rows))
                more = written(_confirmed(written(_listed(_cells(split, long), percent, least_long)), texts, k, percent))
            else:
                more = written(verify(_to_main(split), texts))
            if not more.isEmpty():
                links = links.unionByName(more)
                found = components(links)
            members = split
        named = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
        out = marks.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
        component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
        tables.keep(out)
    return out


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each group of near duplicates."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        found = near_duplicates(docs, **options)
        copies, rest = (found.filter(c).select("doc_id") for c in ("not kept", "kept"))
        return rows_not_among(docs, copies, rest).select(docs.columns)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **options)
    found = rows.select("_row", "doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = found.groupBy("component_id").agg(least.alias("r")).select("r._row")
    kept = written(kept)
    copies = written(found.select("_row").join(kept, "_row", "left_anti"))
    return rows_not_among(rows, copies, kept).select(docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets are alike to 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
ORACLES: dict[str, str] = {}
