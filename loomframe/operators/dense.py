"""Distributed dense matrices: one row per block, products by a join on the inner block and a sum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import soft_inverse
from ..sources.storage import stored

BLOCKS = "bi int, bj int, n int, m int, data array<double>"
#: Rows and columns of a matrix that one machine factorises; larger systems are solved without a factor.
LARGEST = 20_000


@dataclass(frozen=True)
class Dense:
    """Blocks of `size` x `size`, smaller at the ends."""

    df: DataFrame
    rows: int
    columns: int
    size: int

    @classmethod
    def of(cls, spark: SparkSession, a: np.ndarray, size: int) -> Dense:
        parts = []
        for i in range(0, a.shape[0], size):
            for j in range(0, a.shape[1], size):
                b = a[i : i + size, j : j + size]
                parts.append((i // size, j // size, *b.shape, b.ravel().astype(float).tolist()))
        return cls(spark.createDataFrame(parts, BLOCKS), *a.shape, size)

    @classmethod
    def from_elements(cls, elements: DataFrame, row: str, column: str, value: str, rows: int, columns: int, size: int) -> Dense:
        """From (row, column, value) rows; missing elements are zero, and so may whole blocks be."""

        def kernel(part: pd.DataFrame) -> pd.DataFrame:
            bi, bj = int(part["bi"].iloc[0]), int(part["bj"].iloc[0])
            a = np.zeros((min(size, rows - bi * size), min(size, columns - bj * size)))
            np.add.at(a, ((part["i"] - bi * size).to_numpy(), (part["j"] - bj * size).to_numpy()), part["v"].to_numpy())
            return pd.DataFrame([(bi, bj, *a.shape, a.ravel().tolist())], columns=["bi", "bj", "n", "m", "data"])

        cells = elements.select(F.col(row).cast("long").alias("i"), F.col(column).cast("long").alias("j"), F.col(value).cast("double").alias("v"))
        cells = cells.withColumns({"bi": F.floor(F.col("i") / size).cast("int"), "bj": F.floor(F.col("j") / size).cast("int")})
        return cls(cells.groupBy("bi", "bj").applyInPandas(kernel, BLOCKS), rows, columns, size)

    def transpose(self) -> Dense:
        def kernel(batches):
            for b in batches:
                data = [np.reshape(d, (n, m)).T.ravel().tolist() for d, n, m in zip(b["data"], b["n"], b["m"])]
                yield pd.DataFrame({"bi": b["bj"], "bj": b["bi"], "n": b["m"], "m": b["n"], "data": data})

        return Dense(self.df.mapInPandas(kernel, BLOCKS), self.columns, self.rows, self.size)

    def multiply(self, other: Dense) -> Dense:
        if self.columns != other.rows or self.size != other.size:
            raise ValueError("the matrices don't fit")

        def product(batches):
            for b in batches:
                data = [(np.reshape(x, (n, k)) @ np.reshape(y, (k, m))).ravel().tolist() for x, y, n, k, m in zip(b["x"], b["y"], b["n"], b["k"], b["m"])]
                yield pd.DataFrame({"bi": b["bi"], "bj": b["bj"], "n": b["n"], "m": b["m"], "data": data})

        left = self.df.select("bi", F.col("bj").alias("bk"), "n", F.col("m").alias("k"), F.col("data").alias("x"))
        right = other.df.select(F.col("bi").alias("bk"), "bj", "m", F.col("data").alias("y"))
        parts = left.join(right, "bk").mapInPandas(product, BLOCKS)
        cells = parts.select("bi", "bj", "n", "m", F.posexplode("data").alias("at", "v"))
        sums = cells.groupBy("bi", "bj", "n", "m", "at").agg(F.sum("v").alias("v"))  # adds up before the shuffle
        out = sums.groupBy("bi", "bj", "n", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("data"))
        return Dense(out, self.rows, other.columns, self.size)

    def multiply_vector(self, v: np.ndarray) -> np.ndarray:
        """The product with a vector on the driver, which also takes the result."""
        size = self.size

        def kernel(batches):
            for b in batches:
                out = [(np.reshape(d, (n, m)) @ v[j * size : j * size + m]).tolist() for d, n, m, j in zip(b["data"], b["n"], b["m"], b["bj"])]
                yield pd.DataFrame({"bi": b["bi"], "y": out})

        rows = self.df.mapInPandas(kernel, "bi int, y array<double>").select("bi", F.posexplode("y").alias("at", "y")).groupBy("bi", "at").agg(F.sum("y").alias("y"))
        out = np.zeros(self.rows)
        for r in rows.collect():
            out[r["bi"] * size + r["at"]] = r["y"]
        return out

    def elements(self) -> DataFrame:
        """(i, j, v) of all elements."""
        cells = self.df.select("bi", "bj", "m", F.posexplode("data").alias("at", "v"))
        i = F.col("bi") * self.size + F.floor(F.col("at") / F.col("m"))
        j = F.col("bj") * self.size + F.col("at") % F.col("m")
        return cells.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "v")

    def redistribute(self, size: int) -> Dense:
        """The same matrix in blocks of another size."""
        return Dense.from_elements(self.elements(), "i", "j", "v", self.rows, self.columns, size)

    def local(self) -> np.ndarray:
        if max(self.rows, self.columns) > LARGEST:
            raise ValueError(f"more than {LARGEST} rows or columns don't go to one machine")
        out = np.zeros((self.rows, self.columns))
        for r in self.df.collect():
            i, j = r["bi"] * self.size, r["bj"] * self.size
            out[i : i + r["n"], j : j + r["m"]] = np.reshape(r["data"], (r["n"], r["m"]))
        return out

    def eigh(self) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.eigh(self.local())


def solved(apply, b: np.ndarray, error: float = 1e-12) -> np.ndarray:
    """The least solution of a positive semi-definite system by conjugate gradients, from products alone."""
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), float(r @ r)
    first = rr
    for _ in range(2 * len(b)):
        if rr <= error * error * first:
            break
        q = apply(p)
        curve = float(p @ q)
        if curve <= 0:
            break  # nothing is left but what the matrix sends to zero
        x, r = x + rr / curve * p, r - rr / curve * q
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    return x


def pseudo_inverse_direction(delta: Dense, energies: np.ndarray, r: float = 1e-12, a: float = 0.0, largest: int = LARGEST) -> np.ndarray:
    """delta^T (delta delta^T)^+ energies for few samples and many parameters, with a soft inverse of eigenvalues; the
    matrix over samples is the only one that goes to the driver. With more than `largest` samples the system is solved by
    products with the distributed blocks, to which the relative cut `r` is the error, and vectors are on the driver."""
    if delta.rows > largest:
        kept = Dense(stored(delta.df, "delta"), delta.rows, delta.columns, delta.size)
        back = kept.transpose()
        return back.multiply_vector(solved(lambda v: kept.multiply_vector(back.multiply_vector(v)), energies, max(r, 1e-12)))
    kept = Dense(stored(delta.df, "delta"), delta.rows, delta.columns, delta.size)
    values, vectors = kept.multiply(kept.transpose()).eigh()
    cut = r * values.max() + a
    with np.errstate(divide="ignore", over="ignore"):
        inverse = np.where(values <= 0, 0.0, 1 / (values * (1 + (cut / np.where(values <= 0, 1, values)) ** 6)))
    return kept.transpose().multiply_vector(vectors @ (inverse * (vectors.T @ energies)))


__all__ = ["Dense", "pseudo_inverse_direction", "soft_inverse"]
