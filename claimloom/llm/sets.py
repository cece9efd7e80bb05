"""Sets of hashes: exact Jaccard similarity of pairs, and what it links within a block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def set_similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets, each as the bytes of its sorted 64-bit hashes; empty ones have none in common."""

    @F.pandas_udf("double")
    def udf(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both))
        return pd.Series(out, dtype=float)

    return udf(a, b)


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each two of the sets share, by products of their incidence matrix, some columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(ids[-1]) + 1 if len(ids) else 0, columns):
        a, b = np.searchsorted(ids, (c, c + columns))
        some = np.zeros((len(sets), columns), np.float32)
        some[rows[a:b], ids[a:b] - c] = 1
        out += some @ some.T
    return out


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The least number that each row of a symmetric matrix of links reaches."""
    linked = linked | np.eye(len(linked), dtype=bool)
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(linked)).min(1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def spanning_links(held: pd.DataFrame, similarity: float, name: str) -> pd.DataFrame:
    """Pairs (a, b) of the values in column `name` that connect what similarity links among the sets in column hashes; rows
    with one value are one."""
    names, number = np.unique(held[name].to_numpy(np.int64), return_inverse=True)
    if len(names) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    both = shared_counts([np.frombuffer(x, np.uint64) for x in held["hashes"]])
    sizes = np.diag(both)
    x, y = np.nonzero(both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-3)
    linked = np.zeros((len(names), len(names)), bool)
    linked[number[x], number[y]] = True
    root = roots_of(linked | linked.T)
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[root[moved]], "b": names[moved]})
