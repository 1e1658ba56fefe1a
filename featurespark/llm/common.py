"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.ship import ship
from featurespark.sources.shared import drop_written, scratch, shared_path as shared_dir, written  # noqa: F401

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased stay, all others become a space.
_WORD_TABLE = bytes(
    (b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_M64 = (1 << 64) - 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text, A-Z lower-cased; none for null."""
    return text.translate(_WORD_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z lower-cased (``bytes.lower`` leaves others alone)."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Rows of an Arrow batch: texts may be long, and a batch is held on both sides.
BATCH_ROWS = 1000


def _bounded(df: DataFrame) -> None:
    ship(df.sparkSession)
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_rows(df: DataFrame, fn: Callable[[list[list]], dict], schema: str, rows: int = 256) -> DataFrame:
    """Maps lists of column values to lists of output columns, some rows at a time, on Arrow data.

    fn gets one list for each column of df and returns a dict of equally long lists or arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    _bounded(df)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(over, schema)


def names(ddl: str) -> list[str]:
    """Column names of a list such as ``a long, b string``."""
    return [x.split()[0] for x in ddl.split(", ")]


def add_columns(
    df: DataFrame,
    inputs: list[Column],
    fn: Callable[..., list[tuple]],
    result: str,
    rows: int = 256,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df, row for row, with the columns of ``result`` that fn computes from lists of the values of ``inputs``.

    A column of df with a name of the result gives way to it; all others pass as Arrow data, whatever their type, but
    for those to drop.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    _bounded(df)
    keep = [c for c in df.columns if c not in names(result) and c not in drop]
    kind = to_arrow_schema(StructType.fromDDL(result))
    n = len(keep)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*[c.to_pylist() for c in part.columns[n:]])
                made = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*keep, *kind.names])

    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(result).fields)
    return df.select(*[df[c] for c in keep], *[x.alias(f"_in{i}") for i, x in enumerate(inputs)]).mapInArrow(over, schema)
