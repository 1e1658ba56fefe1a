"""Membership of ids in bounded memory, so that long rows are shuffled only where a set of ids leaves a doubt.

A Bloom filter of 64-bit words, three bits of one word an id. Words are made by a map-side combined aggregate, and are
``MOST_WORDS`` (32 MiB) at most, whatever the number of ids: with more ids it says "perhaps" more often, and more rows go
through the exact join that follows, in the end all. No result hangs on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.ship import ship

MOST_WORDS = 1 << 22
_PER_ID = 4  # ids a word, while words are not at their most: 16 bits an id


def perhaps(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of values: false for what is surely not among ids (one column)."""
    (key,) = ids.columns
    ship(ids.sparkSession)
    n = ids.count()
    words = 1 << max(6, min(MOST_WORDS.bit_length() - 1, (n // _PER_ID).bit_length()))

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c, F.lit(11))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(3)]
        return h.bitwiseAND(F.lit(words - 1)).cast("int"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    at, mask = place(F.col(key))
    rows = ids.select(at.alias("at"), mask.alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(words, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("mask").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def known(at: pa.Array, mask: pa.Array) -> pa.Array:
        bits = mask.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at.to_numpy(zero_copy_only=False)] & bits) == bits)

    return lambda c: known(*place(c))


def rows_among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is among ids (one column, distinct)."""
    (key,) = ids.columns
    return df.filter(perhaps(ids)(F.col(key))).join(ids, key, "left_semi")


def rows_not_among(df: DataFrame, ids: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of df whose key is not among ids; all keys of df are among ids or others (one column each).

    Rows that are surely not among ids stay, rows that are surely not among the others go, both without a shuffle; the few
    in doubt are joined.
    """
    (key,) = ids.columns
    out, stay = perhaps(ids)(F.col(key)), perhaps(others)(F.col(key))
    return df.filter(~out).unionByName(df.filter(out & stay).join(ids, key, "left_anti"))
