"""Factorisations by charge block: numpy kernels in grouped Arrow functions, with joins and windows around them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import columns as C
from ..functions import ranking
from ..functions.symmetry import Edge, Symmetry, merged
from ..sources.storage import stored
from .tensor import Tensor, col


def _as_matrix(t: Tensor, rows: list[str], cols: list[str]) -> tuple[DataFrame, Edge, Edge]:
    """(q, i, j, re, im) of the tensor in the order rows, cols, signs applied; q numbers the row edge's segments and i, j
    count inside blocks."""
    t = t.transpose([*rows, *cols])
    plain = Symmetry(t.schema.symmetry.kinds, (False,) * len(t.schema.symmetry.kinds))
    row, _ = merged([t.schema.edge(n) for n in rows], plain)
    column, _ = merged([t.schema.edge(n) for n in cols], plain)
    m = Tensor(t.df, replace(t.schema, symmetry=plain)).merge_edge({"__u": rows, "__v": cols})
    place = C.position(row, F.col("e___u"))
    other = [column.position_by_charge(plain.negative(q)) if plain.negative(q) in dict(column.segments) else -1 for q, _ in row.segments]
    first = [column.starts[p] if p >= 0 else 0 for p in other]
    df = m.df.select(place.cast("int").alias("q"), (F.col("e___u") - C.of_segment(row.starts, place)).alias("i"), (F.col("e___v") - C.of_segment(first, place)).alias("j"), "re", (F.col("im") if t.schema.is_complex else F.lit(0.0)).alias("im"))
    return df, row, column


def _block(rows: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
    a = np.zeros(shape, complex if (rows["im"] != 0).any() else float)
    np.add.at(a, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["re"].to_numpy() + 1j * rows["im"].to_numpy() if a.dtype == complex else rows["re"].to_numpy())
    return a


def _long(q: int, part: str, a: np.ndarray) -> pd.DataFrame:
    i, j = np.meshgrid(np.arange(a.shape[0]), np.arange(a.shape[1]), indexing="ij")
    return pd.DataFrame({"q": q, "part": part, "i": i.ravel(), "j": j.ravel(), "re": a.real.ravel().astype(float), "im": a.imag.ravel().astype(float)})


LONG = "q int, part string, i long, j long, re double, im double"


def _unpack(df: DataFrame, t: Tensor, names: list[str], side: Edge, place: dict[int, int], bond: str, bond_edge: Edge, bond_first: bool, bond_place: dict[int, int]) -> Tensor:
    """A factor's rows (q, i, k) as a tensor over `names` and the bond."""
    plain = Symmetry(t.schema.symmetry.kinds, (False,) * len(t.schema.symmetry.kinds))
    at = lambda starts, places: C.of_segment([starts[places[q]] if q in places else 0 for q in range(max(place) + 1)], F.col("q"))
    packed = df.select((F.col("i") + at(side.starts, place)).cast("long").alias("e___s"), (F.col("k") + at(bond_edge.starts, bond_place)).cast("long").alias(col(bond)), "re", "im")
    from ..functions.symmetry import Schema

    m = Tensor(packed, Schema(("__s", bond), (side, bond_edge), plain, True)).split_edge({"__s": [(n, t.schema.edge(n)) for n in names]})
    order = [bond, *names] if bond_first else [*names, bond]
    m = m.transpose(order)
    edges = tuple(bond_edge if n == bond else t.schema.edge(n) for n in order)
    out = Tensor(m.df, Schema(tuple(order), edges, t.schema.symmetry, True))
    return out if t.schema.is_complex else out.to_real()


def svd(t: Tensor, free_u: Iterable[str], common_u: str, common_v: str, singular_u: str, singular_v: str, cut: float = -1) -> tuple[Tensor, Tensor, Tensor]:
    """U, S, V with U S V = t; S is a diagonal matrix. `cut` as in ranking.parse_cut; exact zeros are never kept."""
    rows = [n for n in t.names if n in set(free_u)]
    cols = [n for n in t.names if n not in rows]
    matrix, row, column = _as_matrix(t, rows, cols)
    symmetry = t.schema.symmetry
    shapes = {q: (d, column.dimension_by_charge(symmetry.negative(c)) if symmetry.negative(c) in dict(column.segments) else 0) for q, (c, d) in enumerate(row.segments)}

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        q = int(part["q"].iloc[0])
        u, s, v = np.linalg.svd(_block(part, shapes[q]), full_matrices=False)
        return pd.concat([_long(q, "u", u), _long(q, "s", s[:, None]), _long(q, "v", v.T)])

    parts = stored(matrix.groupBy("q").applyInPandas(kernel, LONG), "svd")
    remain, relative = ranking.parse_cut(cut)
    values = parts.filter("part = 's'").select("q", F.col("i").alias("k"), F.col("re").alias("s"))
    kept = stored(ranking.truncated(values, "q", "s", ["q", "k"], remain, relative), "svd-kept")
    many = {r["q"]: r["n"] for r in kept.groupBy("q").agg(F.count("*").alias("n")).collect()}  # a row per segment
    order = sorted(many)
    bond_place = {q: p for p, q in enumerate(order)}
    u_edge = Edge(tuple((symmetry.negative(row.segments[q][0]), many[q]) for q in order), symmetry.is_fermi)
    v_edge = u_edge.conjugate(symmetry)
    keep = kept.select("q", "k")
    factor = lambda part: parts.filter(F.col("part") == part).select("q", "i", F.col("j").alias("k"), "re", "im").join(keep, ["q", "k"])
    places = {q: q for q in shapes}
    other = {q: column.position_by_charge(symmetry.negative(c)) for q, (c, _) in enumerate(row.segments) if symmetry.negative(c) in dict(column.segments)}
    other = {q: other.get(q, 0) for q in shapes}
    u = _unpack(factor("u"), t, rows, row, places, common_u, u_edge, False, bond_place)
    v = _unpack(factor("v"), t, cols, column, other, common_v, v_edge, True, bond_place)
    from ..functions.symmetry import Schema

    shift = C.of_segment([u_edge.starts[bond_place[q]] if q in bond_place else 0 for q in range(max([*order, 0]) + 1)], F.col("q"))
    index = (F.col("k") + shift).cast("long")
    s = Tensor(kept.select(index.alias(col(singular_u)), index.alias(col(singular_v)), F.col("s").alias("re")), Schema((singular_u, singular_v), (v_edge, u_edge), symmetry))
    return u, s, v


def qr(t: Tensor, free: Iterable[str], common_q: str, common_r: str, free_of: str = "q") -> tuple[Tensor, Tensor]:
    """Q, R with Q R = t, thin, by charge block; signs are LAPACK's. `free` names the edges of Q, or, with free_of "r", of R."""
    if free_of not in ("q", "r"):
        raise ValueError('free_of is "q" or "r"')
    free = set(free)
    free_q = free if free_of == "q" else set(t.names) - free
    rows = [n for n in t.names if n in set(free_q)]
    cols = [n for n in t.names if n not in rows]
    matrix, row, column = _as_matrix(t, rows, cols)
    symmetry = t.schema.symmetry
    shapes = {q: (d, dict(column.segments).get(symmetry.negative(c), 0)) for q, (c, d) in enumerate(row.segments)}

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        q = int(part["q"].iloc[0])
        a, b = np.linalg.qr(_block(part, shapes[q]))
        return pd.concat([_long(q, "q", a), _long(q, "r", b.T)])

    parts = stored(matrix.groupBy("q").applyInPandas(kernel, LONG), "qr")
    order = [q for q, s in shapes.items() if min(s) > 0]
    edge = Edge(tuple((symmetry.negative(row.segments[q][0]), min(shapes[q])) for q in order), symmetry.is_fermi)
    bond_place = {q: p for p, q in enumerate(order)}
    factor = lambda part: parts.filter(F.col("part") == part).select("q", "i", F.col("j").alias("k"), "re", "im")
    other = {q: column.position_by_charge(symmetry.negative(row.segments[q][0])) if q in bond_place else 0 for q in shapes}
    a = _unpack(factor("q"), t, rows, row, {q: q for q in shapes}, common_q, edge, False, bond_place)
    b = _unpack(factor("r"), t, cols, column, other, common_r, edge.conjugate(symmetry), True, bond_place)
    return a, b


def expm(a: np.ndarray, step: int = 8) -> np.ndarray:
    """Diagonal Pade approximant with scaling and squaring, the textbook recurrence (Golub and Van Loan, Matrix
    Computations, section on the matrix exponential)."""
    largest = np.abs(a).max(initial=0.0)
    j = max(0, 1 + int(math.log2(largest))) if largest > 0 else 0
    a = a / 2**j
    n, d, x, c = np.eye(len(a), dtype=a.dtype), np.eye(len(a), dtype=a.dtype), np.eye(len(a), dtype=a.dtype), 1.0
    for k in range(1, step + 1):
        c *= (step - k + 1) / (k * (2 * step - k + 1))
        x = a @ x
        n = n + c * x
        d = d + (-1) ** k * c * x
    out = np.linalg.solve(d, n)
    for _ in range(j):
        out = out @ out
    return out


def exponential(t: Tensor, pairs: Iterable[tuple[str, str]], step: int = 8) -> Tensor:
    """exp of the tensor as a matrix from the second to the first names of the pairs."""
    pairs = list(pairs)
    rows, cols = [a for a, _ in pairs], [b for _, b in pairs]
    t = t.transpose([*rows, *cols])
    fermi = t.schema.symmetry.is_fermi

    def signed(x: Tensor) -> Tensor:
        if not fermi:
            return x
        p = x.parities()
        exponent = C.folded([p[b] for b in cols]) + C.total([p[b] for a, b in pairs if t.schema.edge(a).arrow])
        return x.with_value(lambda v: C.signed(exponent, v))

    matrix, row, column = _as_matrix(signed(t), rows, cols)
    symmetry = t.schema.symmetry
    # Rows and columns number the states of a charge alike, as their edges are conjugate pair by pair.
    shapes = {q: d for q, (_, d) in enumerate(row.segments)}
    every = t.df.sparkSession.range(len(shapes)).select(F.col("id").cast("int").alias("q"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        q = int(part["q"].iloc[0])
        return _long(q, "e", expm(_block(part, (shapes[q], shapes[q])), step))

    out = matrix.unionAll(every).groupBy("q").applyInPandas(kernel, LONG)
    other = [column.position_by_charge(symmetry.negative(c)) for c, _ in row.segments]
    from ..functions.symmetry import Schema

    plain = Symmetry(symmetry.kinds, (False,) * len(symmetry.kinds))
    packed = out.select((F.col("i") + C.of_segment(row.starts, F.col("q"))).cast("long").alias("e___u"), (F.col("j") + C.of_segment([column.starts[p] for p in other], F.col("q"))).cast("long").alias("e___v"), "re", "im")
    m = Tensor(packed, Schema(("__u", "__v"), (row, column), plain, True)).split_edge({"__u": [(n, t.schema.edge(n)) for n in rows], "__v": [(n, t.schema.edge(n)) for n in cols]})
    back = signed(Tensor(m.df, replace(t.schema, is_complex=True)))
    return back if t.schema.is_complex else back.to_real()


def partial_factors(rows: DataFrame, by: str, row: str) -> DataFrame:
    """(by, r): an upper triangular R of each group's rows in each partition, R^T R being the rows' share of X^T X. A task
    holds one R a group and a few thousand rows, and never forms X^T X, so no digits are lost."""
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            number = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            every = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for n in np.unique(number).tolist():
                k, x = keys.dictionary[n].as_py() if n >= 0 else None, every[number == n]
                held[k] = np.linalg.qr(np.vstack([held[k], x]) if k in held else x, mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_kind), pa.array([r.ravel().tolist() for r in held.values()], pa.list_(pa.float64()))], names=[by, "r"])

    batch_kind = to_arrow_type(rows.schema[by].dataType)
    return rows.select(by, F.col(row).cast("array<double>")).mapInArrow(run, f"{by} {kind}, r array<double>")


def _stacked(part: pd.DataFrame, width: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([np.reshape(r, (-1, width)) for r in part["r"]]), mode="r")


def _width(rows: DataFrame, row: str) -> int:
    first = rows.select(F.size(row).alias("n")).first()
    return first["n"] if first else 0


def tall_singular_values(rows: DataFrame, by: str, row: str) -> DataFrame:
    """(by, k, s): singular values of each group's tall matrix, from factors of its parts stacked."""
    width = _width(rows, row)

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(_stacked(part, width), compute_uv=False)
        return pd.DataFrame({by: part[by].iloc[0], "k": np.arange(len(s)), "s": s})

    kind = rows.schema[by].dataType.simpleString()
    return partial_factors(rows, by, row).groupBy(by).applyInPandas(kernel, f"{by} {kind}, k long, s double")


def tall_qr(rows: DataFrame, by: str, row: str, width: int) -> DataFrame:
    """(by, r): the R factor, row-major with a non-negative diagonal, of each group's tall matrix. A group with fewer rows
    than columns, or dependent columns, has zero rows at the end or zeros on the diagonal."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        r = _stacked(part, width)
        r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({by: [part[by].iloc[0]], "r": [np.vstack([r, np.zeros((width - len(r), width))]).ravel()]})

    kind = rows.schema[by].dataType.simpleString()
    return partial_factors(rows, by, row).groupBy(by).applyInPandas(kernel, f"{by} {kind}, r array<double>")
