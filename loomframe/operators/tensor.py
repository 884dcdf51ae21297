"""Named-edge tensors as DataFrames: one row per element, a column `e_<name>` per edge, and `re` (and `im`).

A missing row is zero. For symmetric tensors an edge column holds the total index, from which charge and parity follow by
the schema; every operator is a lazy DataFrame plan, with fermion signs as column expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.symmetry import NO, Edge, Schema, Symmetry, merged


def col(name: str) -> str:
    return f"e_{name}"


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    schema: Schema

    # --- sources

    @classmethod
    def from_table(cls, df: DataFrame, keys: dict[str, Column | str], value: Column | str, imaginary: Column | str | None = None, sum_repeats: bool = True) -> Tensor:
        """A tensor without symmetry over the keys of a table; values of one key are added up."""
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        picked = [as_col(c).alias(col(n)) for n, c in keys.items()]
        values = [as_col(value).cast("double").alias("re")] + ([as_col(imaginary).cast("double").alias("im")] if imaginary is not None else [])
        out = df.select(*picked, *values)
        names = [v for v in ("re", "im") if v in out.columns]
        if sum_repeats:
            out = out.groupBy(*map(col, keys)).agg(*(F.sum(v).alias(v) for v in names))
        return cls(out, Schema(tuple(keys), (None,) * len(keys), NO, "im" in names))

    @classmethod
    def generate(cls, spark: SparkSession, names: Iterable[str], edges: Iterable[Edge | int], symmetry: Symmetry = NO, value: Callable[[Column], Column] | None = None, imaginary: Callable[[Column], Column] | None = None) -> Tensor:
        """All allowed elements with `value(ordinal)`; the ordinal counts blocks row-major and elements inside them."""
        edges = tuple(Edge.plain(e) if isinstance(e, int) else e for e in edges)
        schema = Schema(tuple(names), edges, symmetry, imaginary is not None)
        blocks, at = [], 0
        for own, dims in schema.blocks():
            n = 1
            for d in dims:
                n *= d
            blocks.append((own, dims, at, n))
            at += n
        parts = []
        for own, dims, first, n in blocks:
            i = F.col("id") - first
            radix, keys = n, []
            for e, p, d in zip(edges, own, dims):
                radix //= max(d, 1)
                keys.append((F.floor(i / radix) % d + e.starts[p]).cast("long"))
            parts.append((first, n, keys))
        ordinal = F.col("id")
        rows = spark.range(at)
        if len(parts) == 1 or not edges:
            keys = parts[0][2] if parts else [F.lit(0).cast("long") for _ in edges]
        else:
            keys = []
            for k in range(len(edges)):
                out = parts[0][2][k]
                for first, _, own_keys in parts[1:]:
                    out = F.when(ordinal >= first, own_keys[k]).otherwise(out)
                keys.append(out)
        values = [(value or (lambda _: F.lit(0.0)))(ordinal).cast("double").alias("re")] + ([imaginary(ordinal).cast("double").alias("im")] if imaginary else [])
        return cls(rows.select(*(k.alias(col(n)) for k, n in zip(keys, schema.names)), *values), schema)

    @classmethod
    def range_(cls, spark: SparkSession, names: Iterable[str], edges: Iterable[Edge | int], symmetry: Symmetry = NO, first: float = 0, step: float = 1) -> Tensor:
        return cls.generate(spark, names, edges, symmetry, lambda i: F.lit(float(first)) + i * float(step))

    @classmethod
    def zero(cls, spark: SparkSession, names: Iterable[str], edges: Iterable[Edge | int], symmetry: Symmetry = NO) -> Tensor:
        return cls.generate(spark, names, edges, symmetry)

    @classmethod
    def random(cls, spark: SparkSession, names: Iterable[str], edges: Iterable[Edge | int], symmetry: Symmetry = NO, seed: int = 0, normal: bool = True, low: float = 0, high: float = 1, mean: float = 0, deviation: float = 1, is_complex: bool = False) -> Tensor:
        """Reproducible by seed and ordinal, whatever the partitions; a complex draw has both parts drawn alike."""
        uniform = lambda i, k: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)

        def drawn(part: int) -> Callable[[Column], Column]:
            if normal:
                return lambda i: F.sqrt(-2 * F.log(uniform(i, 2 * part + 1))) * F.cos(uniform(i, 2 * part + 2) * 6.283185307179586) * float(deviation) + float(mean)
            return lambda i: uniform(i, 2 * part + 1) * (high - low) + low

        return cls.generate(spark, names, edges, symmetry, drawn(0), drawn(1) if is_complex else None)

    @classmethod
    def scalar(cls, spark: SparkSession, value: float = 1.0) -> Tensor:
        return cls(spark.range(1).select(F.lit(float(value)).alias("re")), Schema((), ()))

    @classmethod
    def one(cls, spark: SparkSession, value: float, names: Iterable[str], charges: Iterable[tuple[int, ...]] = (), symmetry: Symmetry = NO, arrows: Iterable[bool] = ()) -> Tensor:
        """One element with edges of dimension one."""
        names = tuple(names)
        charges = tuple(charges) or (symmetry.zero,) * len(names)
        arrows = tuple(arrows) or (False,) * len(names)
        return cls.generate(spark, names, [Edge(((q, 1),), a) for q, a in zip(charges, arrows)], symmetry, lambda _: F.lit(float(value)))

    @classmethod
    def identity(cls, spark: SparkSession, pairs: Iterable[tuple[str, str, Edge | int]], symmetry: Symmetry = NO) -> Tensor:
        """One where each pair (first, second, edge of the first) is diagonal; the second edge is the first's conjugate."""
        pairs = [(a, b, Edge.plain(e) if isinstance(e, int) else e) for a, b, e in pairs]
        base = spark.range(1).select()
        for a, _, e in pairs:
            base = base.crossJoin(spark.range(e.dimension).select(F.col("id").alias(col(a))))
        names = [n for a, b, _ in pairs for n in (a, b)]
        edges = [x for _, _, e in pairs for x in (e, e.conjugate(symmetry))]
        out = base.select(*(F.col(col(a)).alias(col(n)) for a, b, _ in pairs for n in (a, b)), F.lit(1.0).alias("re"))
        t = cls(out, Schema(tuple(names), tuple(edges), symmetry))
        if symmetry.is_fermi:
            # The element is one in the order (arrow false, arrow true) of each pair.
            want = [n for i in range(0, len(names), 2) for n in ((names[i], names[i + 1]) if not edges[i].arrow else (names[i + 1], names[i]))]
            t = t.with_value(lambda v: C.signed(C.permuted(want, names, t.parities()), v))
        return t

    # --- helpers

    @property
    def names(self) -> tuple[str, ...]:
        return self.schema.names

    @property
    def rank(self) -> int:
        return len(self.names)

    @property
    def keys(self) -> list[str]:
        return [col(n) for n in self.names]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.schema.is_complex else ["re"]

    def with_value(self, f: Callable[[Column], Column]) -> Tensor:
        return replace(self, df=self.df.select(*self.keys, *(f(F.col(v)).alias(v) for v in self.values)))

    def parities(self, prefix: str = "") -> dict[str, Column]:
        return {n: C.parity(e, self.schema.symmetry, F.col(prefix + col(n))) for n, e in zip(self.names, self.schema.edges)} if self.schema.symmetry.is_fermi else {n: F.lit(0) for n in self.names}

    def same_shape(self) -> Schema:
        return self.schema

    def to_complex(self) -> Tensor:
        return self if self.schema.is_complex else replace(self, df=self.df.withColumn("im", F.lit(0.0)), schema=replace(self.schema, is_complex=True))

    def to_real(self) -> Tensor:
        return replace(self, df=self.df.select(*self.keys, "re"), schema=replace(self.schema, is_complex=False))

    def to(self, kind: str) -> Tensor:
        """float32, float64 and complex kinds; a real kind keeps real parts."""
        t = self.to_complex() if "complex" in kind else self.to_real()
        single = kind in ("float32", "complex64")
        return t.with_value(lambda v: v.cast("float").cast("double") if single else v)

    # --- names and order

    def edge_rename(self, names: dict[str, str]) -> Tensor:
        if missing := set(names) - set(self.names):
            raise ValueError(f"no such edges: {sorted(missing)}")
        new = tuple(names.get(n, n) for n in self.names)
        out = self.df.select(*(F.col(col(a)).alias(col(b)) for a, b in zip(self.names, new)), *self.values)
        return Tensor(out, replace(self.schema, names=new))

    def transpose(self, names: Iterable[str]) -> Tensor:
        names = tuple(names)
        if sorted(names) != sorted(self.names):
            raise ValueError(f"{names} is no order of {self.names}")
        schema = replace(self.schema, names=names, edges=tuple(self.schema.edge(n) for n in names))
        t = self.with_value(lambda v: C.signed(C.permuted(self.names, names, self.parities()), v)) if self.schema.symmetry.is_fermi else self
        return Tensor(t.df.select(*map(col, names), *self.values), schema)

    @staticmethod
    def _marked(name: str, apply: bool, exclude: Iterable[str]) -> bool:
        return (name not in exclude) if apply else (name in exclude)

    def reverse_edge(self, names: Iterable[str], apply_parity: bool = False, exclude: Iterable[str] = ()) -> Tensor:
        names, exclude = set(names), set(exclude)
        edges = tuple(e.reversed() if n in names else e for n, e in zip(self.names, self.schema.edges))
        p = self.parities()
        marked = [p[n] for n in self.names if n in names and self._marked(n, apply_parity, exclude)]
        t = self.with_value(lambda v: C.signed(C.total(marked), v)) if marked and self.schema.symmetry.is_fermi else self
        return Tensor(t.df, replace(self.schema, edges=edges))

    def merge_edge(self, merge: dict[str, list[str]], apply_parity: bool = False, exclude: Iterable[str] = (), exclude_reverse: Iterable[str] = ()) -> Tensor:
        """Packs lists of edges into new ones, which stand where their last members stood; an empty list adds an edge of
        dimension one in front. Members with another arrow than the first are reversed before."""
        used = {n: new for new, parts in merge.items() for n in parts}
        order: list[str] = [n for new, parts in merge.items() if not parts for n in [new]]
        for i, n in enumerate(self.names):
            if n not in used:
                order.append(n)
            elif n == max(merge[used[n]], key=self.names.index):
                order.append(used[n])
        t = self
        if self.schema.symmetry.is_fermi:
            flip = [n for parts in merge.values() for n in parts if self.schema.edge(n).arrow != self.schema.edge(parts[0]).arrow]
            t = t.reverse_edge(flip, apply_parity, exclude_reverse) if flip else t
            t = t.transpose([n for o in order for n in (merge[o] if o in merge else [o])])
        p, symmetry = t.parities(), t.schema.symmetry
        keys, edges, exponent = [], [], []
        for o in order:
            if o not in merge:
                keys.append(F.col(col(o)).alias(col(o)))
                edges.append(t.schema.edge(o))
                continue
            parts = merge[o]
            own = [t.schema.edge(n) for n in parts]
            edge, base = merged(own, symmetry)
            places = [C.position(e, F.col(col(n))) for n, e in zip(parts, own)]
            combo, inner = F.lit(0), F.lit(0).cast("long")
            for n, e, at in zip(parts, own, places):
                combo = combo * len(e.segments) + at
                inner = inner * C.of_segment([d for _, d in e.segments], at) + (F.col(col(n)) - C.of_segment(e.starts, at))
            bases = [base[x] for x in itertools.product(*(range(len(e.segments)) for e in own))]
            keys.append((C.of_segment(bases, combo) + inner).cast("long").alias(col(o)))
            edges.append(edge)
            if symmetry.is_fermi and self._marked(o, apply_parity, set(exclude)):
                exponent.append(C.folded([p[n] for n in parts]))
        values = [C.signed(C.total(exponent), F.col(v)).alias(v) if exponent else F.col(v) for v in t.values]
        return Tensor(t.df.select(*keys, *values), replace(t.schema, names=tuple(order), edges=tuple(edges)))

    def split_edge(self, split: dict[str, list[tuple[str, Edge | int]]], apply_parity: bool = False, exclude: Iterable[str] = ()) -> Tensor:
        """The inverse of merge_edge: each edge into the given ones, whose arrow is the split edge's."""
        symmetry = self.schema.symmetry
        names, edges, keys, exponent = [], [], [], []
        for n, e in zip(self.names, self.schema.edges):
            if n not in split:
                names.append(n)
                edges.append(e)
                keys.append(F.col(col(n)))
                continue
            parts = [(m, replace(Edge.plain(x) if isinstance(x, int) else x, arrow=e.arrow if e is not None else False)) for m, x in split[n]]
            own = [x for _, x in parts]
            _, base = merged(own, symmetry)
            ordered = sorted(base.items(), key=lambda x: x[1])
            index = F.col(col(n))
            rank = C.position(Edge(tuple(((), b - a) for a, b in zip([x[1] for x in ordered], [x[1] for x in ordered[1:]] + [10**15]))), index)
            rest = index - C.of_segment([b for _, b in ordered], rank)
            p = []
            for k, (m, x) in enumerate(parts):
                tail = [1] * len(ordered)
                for i, (combo, _) in enumerate(ordered):
                    for y, at in list(zip(own, combo))[k + 1 :]:
                        tail[i] *= y.segments[at][1]
                radix = C.of_segment(tail, rank)
                offset = F.floor(rest / radix) % C.of_segment([x.segments[combo[k]][1] for combo, _ in ordered], rank)
                names.append(m)
                edges.append(x)
                keys.append((C.of_segment([x.starts[combo[k]] for combo, _ in ordered], rank) + offset).cast("long").alias(col(m)))
                p.append(C.of_segment([symmetry.parity(x.segments[combo[k]][0]) for combo, _ in ordered], rank).cast("int"))
            if symmetry.is_fermi and self._marked(n, apply_parity, set(exclude)):
                exponent.append(C.folded(p))
        values = [C.signed(C.total(exponent), F.col(v)).alias(v) if exponent else F.col(v) for v in self.values]
        return Tensor(self.df.select(*keys, *values), replace(self.schema, names=tuple(names), edges=tuple(edges)))

    def edge_operator(self, split: dict[str, list[tuple[str, Edge | int]]] | None = None, reverse: Iterable[str] = (), merge: dict[str, list[str]] | None = None, order: Iterable[str] | None = None, apply_parity: bool = False, exclude_split: Iterable[str] = (), exclude_reverse: Iterable[str] = (), exclude_reverse_before_merge: Iterable[str] = (), exclude_merge: Iterable[str] = ()) -> Tensor:
        """Splits, reverses, merges and orders edges. Each step only adds column expressions, which become one projection."""
        t = self.split_edge(split, apply_parity, exclude_split) if split else self
        t = t.reverse_edge(reverse, apply_parity, exclude_reverse) if reverse else t
        t = t.merge_edge(merge, apply_parity, exclude_merge, exclude_reverse_before_merge) if merge else t
        return t.transpose(order) if order is not None else t

    def clear_bose_symmetry(self) -> Tensor:
        return Tensor(self.df, replace(self.schema, symmetry=NO, edges=tuple(Edge.plain(e.dimension) for e in self.schema.edges)))

    def clear_fermi_symmetry(self) -> Tensor:
        """Fermionic charges become their parity: even segments first, in their order, then odd ones."""
        from ..functions.symmetry import FERMI_Z2

        if not all(self.schema.symmetry.fermi):
            raise ValueError("a bosonic charge can't become a parity")
        keys, edges = [], []
        for n, e in zip(self.names, self.schema.edges):
            sizes, base = [0, 0], []
            for q, d in e.segments:
                k = self.schema.symmetry.parity(q)
                base.append((k, sizes[k]))
                sizes[k] += d
            new = Edge(tuple(((k,), s) for k, s in enumerate(sizes) if s), e.arrow)
            at = C.position(e, F.col(col(n)))
            shift = [b + (sizes[0] if k else 0) - start for (k, b), start in zip(base, e.starts)]
            keys.append((F.col(col(n)) + C.of_segment(shift, at)).cast("long").alias(col(n)))
            edges.append(new)
        return Tensor(self.df.select(*keys, *self.values), replace(self.schema, edges=tuple(edges), symmetry=FERMI_Z2))

    def clear_symmetry(self) -> Tensor:
        return self.clear_fermi_symmetry() if self.schema.symmetry.is_fermi else self.clear_bose_symmetry()

    def conjugate(self, trivial_metric: bool = False) -> Tensor:
        p = self.parities()
        exponent = [C.folded(list(p.values()))] if self.schema.symmetry.is_fermi else []
        if trivial_metric and self.schema.symmetry.is_fermi:
            exponent.append(C.total([p[n] for n, e in zip(self.names, self.schema.edges) if e.arrow]))
        value = lambda v: C.signed(C.total(exponent), -F.col(v) if v == "im" else F.col(v)).alias(v) if exponent else (-F.col(v) if v == "im" else F.col(v)).alias(v)
        edges = tuple(e.conjugate(self.schema.symmetry) if e is not None else None for e in self.schema.edges)
        return Tensor(self.df.select(*self.keys, *(value(v) for v in self.values)), replace(self.schema, edges=edges))

    # --- slices

    def shrink(self, at: dict[str, int], new_name: str | None = None, arrow: bool = False) -> Tensor:
        """Keeps one index of some edges and drops them; `new_name` adds an edge of dimension one with their charge."""
        condition = F.lit(True)
        for n, i in at.items():
            condition &= F.col(col(n)) == i
        names = tuple(n for n in self.names if n not in at)
        edges = [self.schema.edge(n) for n in names]
        keys = [F.col(col(n)) for n in names]
        symmetry = self.schema.symmetry
        if self.schema.edge(next(iter(at))) is not None:
            q = symmetry.add(symmetry.zero, *(self.schema.edge(n).point_by_index(i)[0] for n, i in at.items()))
            if q != symmetry.zero and new_name is None:
                raise ValueError("the indices have a charge; give a name for the edge that carries it")
        else:
            q = symmetry.zero
        if new_name is not None:
            names, edges, keys = (*names, new_name), [*edges, Edge(((q, 1),), arrow)], [*keys, F.lit(0).cast("long").alias(col(new_name))]
        return Tensor(self.df.filter(condition).select(*keys, *self.values), replace(self.schema, names=names, edges=tuple(edges)))

    def expand(self, new: dict[str, tuple[int, Edge | int | None]], old_name: str | None = None) -> Tensor:
        """Adds edges at one index each; `old_name` is an edge of dimension one that goes."""
        keep = [n for n in self.names if n != old_name]
        names = tuple([*new, *keep])
        edges = tuple([*(Edge.plain(e) if isinstance(e, int) else e for _, e in new.values()), *(self.schema.edge(n) for n in keep)])
        keys = [F.lit(i).cast("long").alias(col(n)) for n, (i, _) in new.items()] + [F.col(col(n)) for n in keep]
        return Tensor(self.df.select(*keys, *self.values), replace(self.schema, names=names, edges=edges))

    def element(self, at: dict[str, int]) -> DataFrame:
        t = self.shrink(at, new_name=None) if self.schema.symmetry == NO else Tensor(self.df.filter(" AND ".join(f"{col(n)} = {int(i)}" for n, i in at.items())), self.schema)
        return t.df.agg(*(F.coalesce(F.first(v), F.lit(0.0)).alias(v) for v in self.values))

    def with_element(self, at: dict[str, int], value: complex | float) -> Tensor:
        """The tensor with another value of one element, which its charges must allow."""
        if sorted(at) != sorted(self.names):
            raise ValueError(f"an element needs an index of each of {self.names}")
        symmetry = self.schema.symmetry
        if symmetry != NO and symmetry.add(symmetry.zero, *(e.point_by_index(at[n])[0] for n, e in zip(self.names, self.schema.edges))) != symmetry.zero:
            raise ValueError("the charges don't add up to zero")
        if isinstance(value, complex) and not self.schema.is_complex:
            raise ValueError("a real tensor has no complex element")
        same = F.lit(True)
        for n, i in at.items():
            same &= F.col(col(n)) == i
        value = complex(value)
        row = self.df.sparkSession.range(1).select(*(F.lit(at[n]).cast("long").alias(col(n)) for n in self.names), *(F.lit(x).alias(v) for v, x in zip(self.values, (value.real, value.imag))))
        return replace(self, df=self.df.filter(~same).select(*self.keys, *self.values).unionAll(row))

    def _block(self, charges: dict[str, tuple[int, ...]]) -> tuple[Column, list[Edge], list[int]]:
        inside, edges, first = F.lit(True), [], []
        for n, e in zip(self.names, self.schema.edges):
            p = e.position_by_charge(charges[n])
            d = e.segments[p][1]
            inside &= F.col(col(n)).between(e.starts[p], e.starts[p] + d - 1)
            edges.append(Edge.plain(d))
            first.append(e.starts[p])
        return inside, edges, first

    def block(self, charges: dict[str, tuple[int, ...]]) -> Tensor:
        """The block of the given charges, by edge, as a tensor without symmetry."""
        inside, edges, first = self._block(charges)
        keys = [(F.col(col(n)) - a).alias(col(n)) for n, a in zip(self.names, first)]
        return Tensor(self.df.filter(inside).select(*keys, *self.values), Schema(self.names, tuple(edges), NO, self.schema.is_complex))

    def with_block(self, charges: dict[str, tuple[int, ...]], block: Tensor) -> Tensor:
        """The tensor with another block, whose edges are matched by name."""
        inside, edges, first = self._block(charges)
        own = block.transpose(self.names)
        if [e.dimension for e in own.schema.edges] != [e.dimension for e in edges]:
            raise ValueError("the block has other dimensions")
        own = own.to_complex() if self.schema.is_complex else own
        keys = [(F.col(col(n)) + a).alias(col(n)) for n, a in zip(self.names, first)]
        return replace(self, df=self.df.filter(~inside).select(*self.keys, *self.values).unionAll(own.df.select(*keys, *self.values)))

    def wrong_elements(self) -> DataFrame:
        """Rows that a tensor of this schema can't have: indices outside of their edges, charges that don't add up to zero,
        or one element twice."""
        known = [(n, e) for n, e in zip(self.names, self.schema.edges) if e is not None]
        ok = F.lit(True)
        for n, e in known:
            ok &= F.col(col(n)).between(0, e.dimension - 1)
        if self.schema.symmetry != NO:
            for k, kind in enumerate(self.schema.symmetry.kinds):
                q = C.total([C.charge(e, k, F.col(col(n))) for n, e in known])
                ok &= (q % 2 if kind == "z2" else q) == 0
        rows = self.df.groupBy(*self.keys).agg(F.count("*").alias("times"))
        return rows.filter(~ok | (F.col("times") > 1))

    def nonzero(self) -> Tensor:
        condition = F.col("re") != 0
        return replace(self, df=self.df.filter(condition | (F.col("im") != 0) if self.schema.is_complex else condition))

    def dense(self, spark: SparkSession) -> Tensor:
        """All allowed elements, with the missing ones as zeros; edges of open dimension can't be filled."""
        if any(e is None for e in self.schema.edges):
            raise ValueError(f"dimensions are open, so missing elements can't be told: {self.names}")
        if not self.names:
            return replace(self, df=self.df.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in self.values)))
        grid = Tensor.zero(spark, self.names, self.schema.edges, self.schema.symmetry).df.select(*self.keys)
        out = grid.join(self.df, self.keys, "left").select(*self.keys, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in self.values))
        return replace(self, df=out)

    # --- joins and aggregates

    def contract(self, other: Tensor, pairs: Iterable[tuple[str, str]], fuse: Iterable[str] = (), summed: bool = True) -> Tensor:
        """Sums products over the pairs of edges; `fuse` names stay as common edges. Order: fuse, own free, other's free.

        Without `summed` rows of one key stay apart, for a later contraction or trace, which is linear, to sum them.
        """
        pairs, fuse = list(pairs), list(fuse)
        self._check_pairs(other, pairs, fuse)
        own_common, other_common = [a for a, _ in pairs], [b for _, b in pairs]
        free1 = [n for n in self.names if n not in own_common and n not in fuse]
        free2 = [n for n in other.names if n not in other_common and n not in fuse]
        a, b = (self.to_complex(), other.to_complex()) if self.schema.is_complex or other.schema.is_complex else (self, other)
        left = a.df.select(*(F.col(c).alias(f"l_{c}") for c in a.df.columns))
        right = b.df.select(*(F.col(c).alias(f"r_{c}") for c in b.df.columns))
        condition = [F.col(f"l_{col(x)}") == F.col(f"r_{col(y)}") for x, y in pairs + [(f, f) for f in fuse]]
        joined = left.join(right, condition, "inner") if condition else left.crossJoin(right)
        exponent = F.lit(0)
        if self.schema.symmetry.is_fermi:
            p1, p2 = a.parities("l_"), b.parities("r_")
            common = [p1[x] for x in own_common]
            exponent = C.permuted(a.names, free1 + own_common, p1) + C.permuted(b.names, other_common + free2, p2) + C.folded(common)
            exponent += C.total([p1[x] for x in own_common if not self.schema.edge(x).arrow])
        x, y = (F.col("l_re"), F.col("l_im") if a.schema.is_complex else None), (F.col("r_re"), F.col("r_im") if a.schema.is_complex else None)
        product = list(C.cmul(x, y)) if a.schema.is_complex else [x[0] * y[0]]
        values = [C.signed(exponent, v) if self.schema.symmetry.is_fermi else v for v in product]
        keys = [F.col(f"l_{col(n)}").alias(col(n)) for n in fuse + free1] + [F.col(f"r_{col(n)}").alias(col(n)) for n in free2]
        rows = joined.select(*keys, *(v.alias(n) for v, n in zip(values, a.values)))
        names = fuse + free1 + free2
        edges = tuple(self.schema.edge(n) for n in fuse + free1) + tuple(other.schema.edge(n) for n in free2)
        out = rows.groupBy(*map(col, names)).agg(*(F.sum(v).alias(v) for v in a.values)) if pairs and summed else rows
        if not names:
            out = out.select(*(F.coalesce(v, F.lit(0.0)).alias(v) for v in a.values))
        return Tensor(out, Schema(tuple(names), edges, self.schema.symmetry, a.schema.is_complex))

    def _check_pairs(self, other: Tensor, pairs: list[tuple[str, str]], fuse: list[str]) -> None:
        if self.schema.symmetry != other.schema.symmetry:
            raise ValueError("the symmetries differ")
        if fuse and self.schema.symmetry != NO:
            raise ValueError("only tensors without symmetry can keep a common edge")
        for names, tensor in (([a for a, _ in pairs] + fuse, self), ([b for _, b in pairs] + fuse, other)):
            if len(set(names)) != len(names) or set(names) - set(tensor.names):
                raise ValueError(f"{names} repeat or aren't among {tensor.names}")
        rest = set(self.names) - {a for a, _ in pairs} - set(fuse)
        if clash := rest & (set(other.names) - {b for _, b in pairs} - set(fuse)):
            raise ValueError(f"edges of both tensors are left with one name: {sorted(clash)}")
        for a, b in pairs + [(f, f) for f in fuse]:
            x, y = self.schema.edge(a), other.schema.edge(b)
            if x is not None and y is not None and ((a, b) in pairs and x.conjugate(self.schema.symmetry) != y or x.dimension != y.dimension):
                raise ValueError(f"{a} and {b} don't fit: {x}, {y}")

    def trace(self, pairs: Iterable[tuple[str, str]], fuse: dict[str, tuple[str, str]] | None = None) -> Tensor:
        """Sums over the diagonal of each pair; `fuse` keeps a diagonal as a new edge. Order: fuse, free."""
        pairs, fuse = [tuple(sorted(p, key=self.names.index)) for p in pairs], dict(fuse or {})
        used = [n for p in pairs for n in p] + [n for p in fuse.values() for n in p]
        if len(set(used)) != len(used) or set(used) - set(self.names):
            raise ValueError(f"{used} repeat or aren't among {self.names}")
        if fuse and self.schema.symmetry != NO:
            raise ValueError("only tensors without symmetry can keep a diagonal")
        free = [n for n in self.names if n not in used]
        condition = F.lit(True)
        for x, y in pairs + list(fuse.values()):
            condition &= F.col(col(x)) == F.col(col(y))
        exponent = F.lit(0)
        if self.schema.symmetry.is_fermi:
            p = self.parities()
            first, second = [a for a, _ in pairs], [b for _, b in pairs]
            exponent = C.permuted(self.names, first + second + free, p) + C.folded([p[a] for a in first]) + C.total([p[b] for b in second if self.schema.edge(b).arrow])
        rows = self.df.filter(condition).select(
            *(F.col(col(a)).alias(col(n)) for n, (a, _) in fuse.items()), *(F.col(col(n)) for n in free),
            *((C.signed(exponent, F.col(v)) if self.schema.symmetry.is_fermi else F.col(v)).alias(v) for v in self.values),
        )
        names = (*fuse, *free)
        out = rows.groupBy(*map(col, names)).agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in self.values))
        return Tensor(out, replace(self.schema, names=names, edges=tuple([self.schema.edge(a) for a, _ in fuse.values()] + [self.schema.edge(n) for n in free])))

    # --- element-wise

    def zip(self, other: Tensor, f: Callable[[Column, Column], Column], how: str = "full", pairs: Callable | None = None) -> Tensor:
        """f over elements of equal keys, edges matched by name; a missing element is zero. Complex elements go through
        `pairs`, a function of two (re, im) pairs that gives one, or else through f component by component."""
        if sorted(self.names) != sorted(other.names):
            raise ValueError(f"edges differ: {self.names}, {other.names}")
        b = other.transpose(self.names)
        a, b = (self.to_complex(), b.to_complex()) if self.schema.is_complex or b.schema.is_complex else (self, b)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        right = b.df.select(*b.keys, *(F.col(v).alias(f"o_{v}") for v in b.values))
        joined = a.df.join(right, a.keys, how) if a.keys else a.df.crossJoin(right)
        if a.schema.is_complex and pairs is not None:
            out = pairs((zero("re"), zero("im")), (zero("o_re"), zero("o_im")))
        else:
            out = [f(zero(v), zero(f"o_{v}")) for v in a.values]
        return Tensor(joined.select(*a.keys, *(x.alias(v) for x, v in zip(out, a.values))), a.schema)

    def _for_scalar(self, value: complex | float) -> Tensor:
        return self.to_complex() if isinstance(value, complex) else self

    def __add__(self, other: Tensor | complex | float) -> Tensor:
        if isinstance(other, Tensor):
            return self.zip(other, lambda x, y: x + y)
        # Missing elements are zeros, to which the number is added too.
        t = self._for_scalar(other).dense(self.df.sparkSession)
        other = complex(other)
        return replace(t, df=t.df.select(*t.keys, *((F.col(v) + x).alias(v) for v, x in zip(t.values, (other.real, other.imag)))))

    def __sub__(self, other: Tensor | complex | float) -> Tensor:
        return self.zip(other, lambda x, y: x - y) if isinstance(other, Tensor) else self + (-other)

    def __neg__(self) -> Tensor:
        return self.with_value(lambda v: -v)

    def __rsub__(self, other: complex | float) -> Tensor:
        return -self + other

    def __mul__(self, other: Tensor | complex | float) -> Tensor:
        if isinstance(other, Tensor):
            return self.zip(other, lambda x, y: x * y, "inner", C.cmul)
        if isinstance(other, complex):
            return self.to_complex()._paired(lambda z: C.cmul(z, (F.lit(other.real), F.lit(other.imag))))
        return self.with_value(lambda v: v * other)

    def __truediv__(self, other: Tensor | complex | float) -> Tensor:
        """Over a tensor, an element that both lack is 0 / 0 and stays missing."""
        if isinstance(other, Tensor):
            return self.zip(other, C.quotient, "full", C.cdiv)
        return self * (1 / other)

    def __rtruediv__(self, other: complex | float) -> Tensor:
        t = self._for_scalar(other).dense(self.df.sparkSession)
        other = complex(other)
        if t.schema.is_complex:
            return t._paired(lambda z: C.cdiv((F.lit(other.real), F.lit(other.imag)), z))
        return t.with_value(lambda v: C.quotient(F.lit(other.real), v))

    __radd__, __rmul__ = __add__, __mul__

    def _paired(self, f: Callable[[tuple[Column, Column]], tuple[Column, Column]]) -> Tensor:
        re, im = f((F.col("re"), F.col("im")))
        return replace(self, df=self.df.select(*self.keys, re.alias("re"), im.alias("im")))

    def map(self, f: Callable) -> Tensor:
        """f over the stored elements: of a real tensor a function of the value, of a complex one a function of (re, im) that
        gives such a pair."""
        return self._paired(f) if self.schema.is_complex else self.with_value(f)

    def sqrt(self) -> Tensor:
        """The square root of the modulus."""
        if self.schema.is_complex:
            return self._paired(lambda z: (F.sqrt(F.hypot(*z)), F.lit(0.0)))
        return self.map(lambda v: F.sqrt(F.abs(v)))

    def reciprocal(self) -> Tensor:
        """1 / x, and 0 for 0."""
        if self.schema.is_complex:
            size = lambda z: z[0] * z[0] + z[1] * z[1]
            return self._paired(lambda z: tuple(F.coalesce(F.try_divide(x, size(z)), F.lit(0.0)) for x in (z[0], -z[1])))
        return self.map(C.safe_reciprocal)

    # --- numbers

    def modulus(self) -> Column:
        return F.hypot("re", "im") if self.schema.is_complex else F.abs("re")

    def norms(self) -> DataFrame:
        """One row: n_max, n_num (stored elements), n_sum, n_2."""
        m = self.modulus()
        return self.df.agg(F.coalesce(F.max(m), F.lit(0.0)).alias("n_max"), F.count("*").alias("n_num"), F.coalesce(F.sum(m), F.lit(0.0)).alias("n_sum"), F.coalesce(F.sqrt(F.sum(m * m)), F.lit(0.0)).alias("n_2"))

    def p_norm(self, p: float) -> DataFrame:
        return self.df.agg(F.pow(F.sum(F.pow(self.modulus(), p)), 1 / p).alias("n_p"))

    def item(self) -> complex | float:
        """The number of a tensor with at most one element; 0 if it has none."""
        rows = self.df.limit(2).collect()
        if len(rows) > 1:
            raise ValueError("more than one element")
        if not rows:
            return 0.0
        return complex(rows[0]["re"], rows[0]["im"]) if self.schema.is_complex else float(rows[0]["re"])


def safe_contract(a: Tensor, b: Tensor, pairs: Iterable[tuple[str, str]], physics: bool = False) -> Tensor:
    """Contracts those of the pairs of which both edges exist; with `physics` also all edges of one name beginning with P."""
    wanted = {(x, y) for x, y in pairs if x in a.names and y in b.names}
    if physics:
        wanted |= {(n, n) for n in a.names if n.startswith("P") and n in b.names}
    return a.contract(b, sorted(wanted))


def safe_rename(t: Tensor, names: dict[str, str]) -> Tensor:
    """Renames those of the edges that exist."""
    return t.edge_rename({a: b for a, b in names.items() if a in t.names})


def chain(tensors: list[Tensor], pairs: list[tuple[int, str, int, str]], size: Callable[[Tensor], float] | None = None) -> Tensor:
    """Contracts a network pair by pair, the pair with the smallest estimated result first, aggregating after each.

    `pairs` are (tensor, edge, tensor, edge); the edge names of all tensors must differ.
    """
    def estimate(t: Tensor) -> float:
        out = 1.0
        for e in t.schema.edges:
            out *= e.dimension if e is not None else 1000.0
        return out

    size = size or estimate
    groups: dict[int, Tensor] = dict(enumerate(tensors))
    owner = list(range(len(tensors)))
    left = list(pairs)
    while left:
        options: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for a, x, b, y in left:
            i, j = owner[a], owner[b]
            options.setdefault((min(i, j), max(i, j)), []).append((x, y) if i <= j else (y, x))

        def cost(key: tuple[int, int]) -> float:
            i, j = key
            gone = 1.0
            for x, _ in options[key]:
                e = groups[i].schema.edge(x)
                gone *= e.dimension if e is not None else 1000.0
            return size(groups[i]) * (size(groups[j]) if i != j else 1.0) / gone**2

        i, j = min(options, key=lambda k: (cost(k), k))
        groups[i] = groups[i].trace(options[i, j]) if i == j else groups[i].contract(groups[j], options[i, j])
        if i != j:
            del groups[j]
            owner = [i if o == j else o for o in owner]
        left = [p for p in left if not (owner[p[0]] == owner[p[2]] == i and any(p[1] in q and p[3] in q for q in options[i, j]))]
    out, *rest = groups.values()
    for t in rest:
        out = out.contract(t, [])
    return out
