"""Vectors as whole numbers, floor(scale * x) of each component, with exact inner products at any size of the components.

Vectors travel as given, in the component type of their column. A vector is tame if its scaled components are below 2^31 and its
squared length is below 2^62: products of tame vectors fit 64 bits. Others are multiplied as unbounded integers and their
products cut off at LEAST and MOST, which stand for what doesn't fit a long; whoever returns such a score raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAME_COMPONENT, TAME_SQUARE = 2.0**31, 2.0**62
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def component_type(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length in a list column. Null and empty vectors, and those with a null or non-finite component, are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        m = values[starts[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(m).all(1)
        if fine.any():
            yield rows[fine], m[fine]


def scaled(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, exact but where it passes their range."""
    with np.errstate(over="ignore"):
        return np.floor(m.astype(np.float64) * scale)


def squares(f: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (f * f).sum(1)


def tame(f: np.ndarray) -> np.ndarray:
    return (np.abs(f).max(1, initial=0) < TAME_COMPONENT) & (squares(f) < TAME_SQUARE)


def _unbounded(m: np.ndarray, scale: int) -> np.ndarray:
    out = np.empty(m.shape, object)
    for i, x in enumerate(m.astype(np.float64).ravel().tolist()):
        out.flat[i] = math.floor(x * scale) if abs(x) < 2.0**60 else int(x) * scale  # a double that large is whole
    return out


def products(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of the rows of two matrices as longs, cut off at LEAST and MOST."""
    fa, fb = scaled(a, scale), scaled(b, scale)
    if tame(fa).all() and tame(fb).all():
        return whole_products(fa, fb)
    exact = _unbounded(a, scale) @ _unbounded(b, scale).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def whole_products(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Exact inner products of tame vectors that are scaled already."""
    largest = float(np.abs(fa).max(initial=0)) * float(np.abs(fb).max(initial=0)) * fa.shape[1]
    if largest < 2.0**53:
        return (fa @ fb.T).astype(np.int64)
    return fa.astype(np.int64) @ fb.astype(np.int64).T


def fits(score: Column) -> Column:
    """score, or an error where it stands for a number that is no long."""
    text = F.lit("a score doesn't fit a long")
    return F.when((score == LEAST) | (score == MOST), F.raise_error(text).cast("long")).otherwise(score)
