"""Harmonic transforms along one axis of bounded length, by Arrow kernels on whole rows, and spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, row: str, index: str, value: str = "v") -> DataFrame:
    """(row, values): one ordered array for each row."""
    return df.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("values"))


def _kernel(rows: DataFrame, row: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(np.asarray(x.as_py(), float)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.float64()))], [row, "values"])

    return rows.select(F.col(row).cast("long"), "values").mapInArrow(run, f"{row} long, values array<double>")


def hartley(rows: DataFrame, row: str) -> DataFrame:
    """Real plus imaginary part of the discrete Fourier transform."""
    return _kernel(rows, row, lambda x: (lambda z: z.real + z.imag)(np.fft.fft(x)))


def hartley_inverse(rows: DataFrame, row: str) -> DataFrame:
    return _kernel(rows, row, lambda x: (lambda z: z.real + z.imag)(np.fft.fft(x)) / len(x))


def smooth(rows: DataFrame, row: str, sigma: float, distance: float = 1.0) -> DataFrame:
    """Convolution with a Gaussian of deviation sigma along a periodic axis."""

    def f(x: np.ndarray) -> np.ndarray:
        k = np.fft.fftfreq(len(x), distance)
        return np.fft.ifft(np.fft.fft(x) * np.exp(-2 * np.pi**2 * sigma**2 * k**2)).real

    return _kernel(rows, row, f)


def power_spectrum(rows: DataFrame, row: str) -> DataFrame:
    """(row, k, power): mean squared modulus of the modes of each wave number."""

    def f(x: np.ndarray) -> np.ndarray:
        n = len(x)
        k = np.minimum(np.arange(n), n - np.arange(n))
        p = np.abs(np.fft.fft(x)) ** 2
        return np.bincount(k, p) / np.bincount(k)

    return _kernel(rows, row, f).select(row, F.posexplode("values").alias("k", "power"))
