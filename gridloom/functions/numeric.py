"""Distinct values within a tolerance, and functions of small matrices held in rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, value: str, order: str, atol: float = 1e-10, rtol: float = 1e-5) -> DataFrame:
    """(value, u, n): for each distinct value the first one it is close to, in the given order, and that one's number.

    A value a is close to u if |u - a| <= atol + rtol |a|; what is close to none becomes one itself. The scan needs its values in
    order, so it runs as one task, over distinct values only. Nulls are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty(0)
        for b in batches:
            us, ns = [], []
            for a in b.column(0).to_pylist():
                close = np.flatnonzero(np.abs(found - a) <= atol + rtol * abs(a))
                if not len(close):
                    found = np.append(found, a)
                n = int(close[0]) if len(close) else len(found) - 1
                us.append(float(found[n])), ns.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(us, pa.float64()), pa.array(ns, pa.int64())], ["value", "u", "n"])

    first = df.select(F.col(value).cast("double").alias("value"), F.col(order).alias("_o")).where("value is not null").groupBy("value").agg(F.min("_o").alias("_o"))
    return first.coalesce(1).sortWithinPartitions("_o", "value").select("value").mapInArrow(run, "value double, u double, n long")


def amend(found: list[float], a: float, atol: float = 1e-10, rtol: float = 1e-5) -> tuple[list[float], int]:
    """The list with a at its end unless it is close to one, and the number of that one."""
    for k, u in enumerate(found):
        if abs(u - a) <= atol + rtol * abs(a):
            return found, k
    return [*found, a], len(found)


def matrix_function(df: DataFrame, column: str, name: str) -> DataFrame:
    """The column's symmetric positive matrices (row-major arrays) with `sqrt`, `log`, `exp` or `inverse` of them. Nulls stay."""
    f = {"sqrt": np.sqrt, "log": np.log, "exp": np.exp, "inverse": lambda w: 1 / w}[name]
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(at).to_pylist():
                if x is None:
                    out.append(None)
                    continue
                n = round(len(x) ** 0.5)
                w, u = np.linalg.eigh(np.reshape(x, (n, n)))
                out.append(((u * f(w)) @ u.T).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if k == at else b.column(k) for k in range(b.num_columns)], names)

    return df.mapInArrow(run, df.schema)


def solve(df: DataFrame, matrix: str, right: str, out: str = "x") -> DataFrame:
    """Adds the solution of each row's system (row-major matrix, right side)."""
    names = [*df.columns, out]
    m, r = names.index(matrix), names.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if a is None or y is None else np.linalg.solve(np.reshape(a, (len(y), len(y))), y).tolist() for a, y in zip(b.column(m).to_pylist(), b.column(r).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{out}` array<double>")
