"""Vendor-name similarity (Jaro-Winkler) as one Arrow UDF over distinct pairs of a batch."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the functions themselves: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two names denote one vendor from this similarity on.
SAME_VENDOR = 0.90


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    padded = "".join(t.ljust(width, "\0") for t in texts)
    grid = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.int32).reshape(len(texts), width)
    return grid, lengths


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of ``left[i]`` and ``right[i]``. Pairs of like length are compared together, so that one
    very long name costs its own pair only."""
    longest = np.fromiter((max(len(a), len(b), 1) for a, b in zip(left, right)), dtype=np.int64, count=len(left))
    size, out = np.ceil(np.log2(longest)).astype(int), np.zeros(len(left))
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        out[own] = _jaro_winkler([left[i] for i in own], [right[i] for i in own])
    return out


def _matches(a, b, la, lb, reach):
    """Which characters of either side have a partner: in order of the left side, the first free equal
    one in reach."""
    n, width = a.shape
    used_a, used_b = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    places = np.arange(b.shape[1])[None, :]
    for i in range(width):
        near = (places >= (i - reach)[:, None]) & (places <= np.minimum(i + reach, lb - 1)[:, None])
        free = near & ~used_b & (a[:, i, None] == b) & (i < la)[:, None]
        hit = free.any(axis=1)
        used_a[:, i] = hit
        used_b[hit, free[hit].argmax(axis=1)] = True
    return used_a, used_b


def _jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    n = len(left)
    a, la = _codes(left)
    b, lb = _codes(right)
    rows = np.arange(n)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a, used_b = _matches(a, b, la, lb, reach)
    m = used_a.sum(axis=1)
    # k-th matched character of either side, compared position by position
    seq_a = np.take_along_axis(a, np.argsort(~used_a, axis=1, kind="stable"), axis=1)
    seq_b = np.take_along_axis(b, np.argsort(~used_b, axis=1, kind="stable"), axis=1)
    width = min(seq_a.shape[1], seq_b.shape[1])
    within = np.arange(width)[None, :] < m[:, None]
    swaps = ((seq_a[:, :width] != seq_b[:, :width]) & within).sum(axis=1) // 2
    safe_m, safe_la, safe_lb = np.maximum(m, 1), np.maximum(la, 1), np.maximum(lb, 1)
    jaro = np.where(m > 0, (m / safe_la + m / safe_lb + (m - swaps) / safe_m) / 3.0, 0.0)
    prefix = np.zeros(n, dtype=np.int64)
    running = np.ones(n, dtype=bool)
    for i in range(min(4, a.shape[1], b.shape[1])):
        running &= (i < la) & (i < lb) & (a[rows, i] == b[rows, i])
        prefix += running
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1.0 - jaro), jaro)


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
    known = pairs.notna().all(axis=1)
    out = pd.Series(np.nan, index=pairs.index)
    if known.any():
        todo = pairs[known]
        once = todo.drop_duplicates()
        once = once.assign(s=jaro_winkler(once["a"].tolist(), once["b"].tolist()))
        out[known] = todo.merge(once, on=["a", "b"], how="left")["s"].to_numpy()
    return out


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two names, case-insensitive; null when either is null."""
    return _similarity(F.lower(a), F.lower(b))


def length_compatible(a: Column, b: Column) -> Column:
    """Necessary for similarity >= 0.90: Jaro <= (2 + short/long) / 3, so short/long >= 0.5."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b))


def keep_same_vendor(pairs, a: str, b: str):
    """Rows whose two names may denote one vendor. A missing name is compatible with every name.

    The length test runs in the JVM and spares the UDF most of the different names.
    """
    x, y = F.col(a), F.col(b)
    missing = x.isNull() | y.isNull()
    scored = pairs.filter(missing | length_compatible(x, y)).withColumn("_jw", name_similarity(x, y))
    return scored.filter(missing | (F.col("_jw") >= SAME_VENDOR)).drop("_jw")
