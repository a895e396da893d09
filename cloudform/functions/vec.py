"""Vectors in array columns.

Products over components run in numpy on whole Arrow batches, linear in the dimension; Spark's own higher-order functions
visit one component at a time. Means of vectors are Spark's summarizer, summed by task before a shuffle.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12


def matrices(a: pa.Array):
    """(rows, matrix) for each length of list; null lists are left out, null components are NaN."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    size = np.asarray(a.value_lengths().fill_null(-1))
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        whole = len(rows) * n == len(flat)
        yield rows, flat.reshape(-1, n) if whole else flat[start[rows][:, None] + np.arange(n)]


def listed(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list column of n rows with the rows of a matrix at ascending places, null elsewhere."""
    size = np.zeros(n, np.int64)
    size[rows] = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    absent = np.ones(n, bool)
    absent[rows] = False
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(absent))


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _paired(a: pa.Array, b: pa.Array, f) -> pa.Array:
    """f of the matrices of both columns where the lengths agree, else NULL."""
    out = np.full(len(a), np.nan)
    other = {x.shape[1]: (rows, x) for rows, x in matrices(b)}
    for rows, x in matrices(a):
        if x.shape[1] in other:
            theirs, y = other[x.shape[1]]
            if len(rows) == len(theirs) and (rows == theirs).all():
                out[rows] = f(x, y)
            else:
                both, i, j = np.intersect1d(rows, theirs, assume_unique=True, return_indices=True)
                out[both] = f(x[i], y[j])
    return _numbers(out)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


@F.arrow_udf(returnType=T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    return _paired(a, b, lambda x, y: np.einsum("ij,ij->i", x, y))


@F.arrow_udf(returnType=T.DoubleType())
def _norm(a: pa.Array) -> pa.Array:
    out = np.full(len(a), np.nan)
    for rows, x in matrices(a):
        out[rows] = _norms(x)
    return _numbers(out)


@F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
def _unit(a: pa.Array) -> pa.Array:
    at, made = [np.zeros(0, np.int64)], []
    for rows, x in matrices(a):
        n = _norms(x)
        good = np.isfinite(n) & (n > EPS)
        at.append(rows[good])
        made.append(x[good] / n[good, None])
    if len(made) == 1:
        return listed(at[1], made[0], len(a))
    vectors: list = [None] * len(a)  # lengths differ
    for rows, x in zip(at[1:], made, strict=True):
        for i, v in zip(rows.tolist(), x.tolist(), strict=True):
            vectors[i] = v
    return pa.array(vectors, pa.list_(pa.float64()))


@F.arrow_udf(returnType=T.DoubleType())
def _cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    def distance(x, y):
        n, m = _norms(x), _norms(y)
        good = (n > EPS) & (m > EPS)
        return np.where(good, np.clip(1 - np.einsum("ij,ij->i", x, y) / np.where(good, n * m, 1), 0, 2), np.nan)

    return _paired(a, b, distance)


@F.arrow_udf(returnType=T.DoubleType())
def _euclid(a: pa.Array, b: pa.Array) -> pa.Array:
    return _paired(a, b, lambda x, y: _norms(x - y))


def _doubles(a) -> Column:
    return F.col(a) if isinstance(a, str) else a


def dot(a, b) -> Column:
    return _dot(_doubles(a), _doubles(b))


def norm(a) -> Column:
    return _norm(_doubles(a))


def unit(a) -> Column:
    """NULL for a zero vector and for one with null or non-finite components."""
    return _unit(_doubles(a))


def cosine_distance(a, b) -> Column:
    """1 - cosine within [0, 2]; NULL if a norm is nothing or the lengths differ."""
    return _cosine_distance(_doubles(a), _doubles(b))


def euclid(a, b) -> Column:
    return _euclid(_doubles(a), _doubles(b))


def centroids(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """The mean vector of each group, summed by task before the shuffle."""
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(name))
