"""Arrays to rows, and rows to Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[Column | str], array: Column | str, value: str, position: str | None = None) -> DataFrame:
    """One row per element, with its position from 0 if that is named.

    A plain explode lets the optimizer infer a filter on the size of the array and push it down to the scan, where
    the whole expression is worked out a second time. The outer form infers none; its rows without an element go.
    """
    at = position or "_position"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())
    return rows if position else rows.drop(at)


def arrow_struct(values: list, names: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    """Columns as one array of structs."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, (_, t) in zip(values, names, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, a.type) for (n, _), a in zip(names, arrays, strict=True)])


def arrow_lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    """Values cut into lists of these sizes."""
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def transposed(found: list, width: int) -> list:
    """Rows as columns, also where there is no row."""
    return list(zip(*found, strict=True)) if found else [()] * width
