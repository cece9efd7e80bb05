"""Functions in Python that may fail on a row: it gets the error, the others their values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Function = Callable[[list], list]


def attempt(f: Function, rows: list) -> list[tuple]:
    """(value, error) of each row. All rows go to f at once; if that fails, or gives another number of values, each goes alone. An error is
    named by its kind only, for its message may quote the row."""
    try:
        values = list(f(rows))
        if len(values) != len(rows):
            raise ValueError(f"{len(values)} values for {len(rows)} rows")
        return [(v, None) for v in values]
    except Exception as failure:
        if len(rows) == 1:
            return [(None, type(failure).__name__)]
        return [attempt(f, [row])[0] for row in rows]


def isolated(column: Column, make: Callable[[], Function], returns: str) -> Column:
    """struct(value, error) of f over a column, f being made once a task; what cannot be made fails the task. Rows with null do not reach f and have neither."""

    @F.pandas_udf(f"value {returns}, error string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for batch in batches:
            rows = batch.tolist()
            known = [k for k, row in enumerate(rows) if row is not None]
            out: list[tuple] = [(None, None)] * len(rows)
            if known:
                for k, found in zip(known, attempt(f, [rows[k] for k in known]), strict=True):
                    out[k] = found
            yield pd.DataFrame({"value": pd.Series([x[0] for x in out], dtype=object), "error": pd.Series([x[1] for x in out], dtype=object)})

    return udf(column)
