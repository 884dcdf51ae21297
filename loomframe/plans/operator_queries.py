"""More queries over the driver's tables, each of which goes through the operator that it is named after: symmetric and
fermionic tensors, complex numbers, factorisations, dense matrices, sources, fermion lattices and exact states."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranking
from ..functions.lazy import Node, Root
from ..functions.symmetry import BOSE_U1, FERMI_U1, FERMI_Z2, NO, Edge, Schema, Symmetry
from ..operators import conversion, estimators, fermions, linear_algebra, toolkit
from ..operators.dense import Dense
from ..operators.exact import inner
from ..operators.lattice import SZ, State, amplitudes, product
from ..operators.neural import Autoregressive, NeuralState, read_weights, write_weights
from ..operators.sampling import SamplingLattice
from ..operators.simple_update import SimpleUpdate
from ..operators.tensor import Tensor, safe_contract, safe_rename
from ..sources import storage, terms, text
from . import models
from .catalogue import query, read, rounded, value

#: Edges of one state a charge: -1, 0, 1, and the parities 0, 1.
UNITS = Edge.of({-1: 1, 0: 1, 1: 1})
PARITY = Edge.of({0: 1, 1: 1})


def symmetric(df: DataFrame, keys: dict[str, Column], edges: list[Edge], symmetry: Symmetry, value: Column, imaginary: Column | None = None) -> Tensor:
    """The allowed elements of a table as a symmetric tensor; keys are total indices."""
    plain = Tensor.from_table(df, {n: c.cast("long") for n, c in keys.items()}, value, imaginary)
    t = Tensor(plain.df, Schema(tuple(keys), tuple(edges), symmetry, imaginary is not None))
    total = [C.total([C.charge(e, k, F.col(f"e_{n}")) for n, e in zip(keys, edges)]) for k in range(len(symmetry.kinds))]
    ok = F.lit(True)
    for q, kind in zip(total, symmetry.kinds):
        ok &= (q % 2 if kind == "z2" else q) == 0
    return Tensor(t.df.filter(ok), t.schema)


def both(df: DataFrame, places: int, scale: float = 1.0) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) / scale, places) for c in ("re", "im")})


# --- complex numbers

_PAIR = "with a as (select c_nationkey k,sum(c_acctbal) x,cast(count(*) as double)*100 y from customer group by 1),b as (select s_nationkey k,sum(s_acctbal) u,cast(sum(s_suppkey) as double) w from supplier group by 1) "


def complex_pair(spark: SparkSession, sf_dir: str) -> tuple[Tensor, Tensor]:
    a = Tensor.from_table(read(spark, sf_dir, "customer"), {"k": "c_nationkey"}, "c_acctbal", F.lit(100.0))
    return a, Tensor.from_table(read(spark, sf_dir, "supplier"), {"k": "s_nationkey"}, "s_acctbal", F.col("s_suppkey"))


@query(_PAIR + "select a.k e_k,round((x*u-y*w)/1e6,4) re,round((x*w+y*u)/1e6,4) im from a join b on a.k=b.k")
def complex_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = complex_pair(spark, sf_dir)
    return both((a * b).df, 4, 1e6)


@query(_PAIR + "select a.k e_k,round((x*u+y*w)/(u*u+w*w),6) re,round((y*u-x*w)/(u*u+w*w),6) im from a join b on a.k=b.k")
def complex_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = complex_pair(spark, sf_dir)
    here = b.df.select("e_k").distinct()
    return both((a / b).df.join(F.broadcast(here), "e_k", "left_semi"), 6)  # at most a row a nation


@query(_PAIR + "select k e_k,round(x/(x*x+y*y)*1e6,6) re,round(-y/(x*x+y*y)*1e6,6) im from a")
def complex_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(complex_pair(spark, sf_dir)[0].reciprocal().df, 6, 1e-6)


@query(_PAIR + "select k e_k,round(sqrt(sqrt(x*x+y*y)),6) re,0.0::double im from a")
def complex_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(complex_pair(spark, sf_dir)[0].sqrt().df, 6)


@query(_PAIR + "select round(sum(x*u-y*w)/1e6,4) re,round(sum(x*w+y*u)/1e6,4) im from a join b on a.k=b.k")
def complex_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = complex_pair(spark, sf_dir)
    return both(a.contract(b, [("k", "k")]).df, 4, 1e6)


@query(_PAIR + "select a.k e_k,round(x*v/1e6,4) re,round(y*v/1e6,4) im from a join (select s_nationkey k,sum(s_acctbal) v from supplier group by 1) r on a.k=r.k")
def mixed_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A complex tensor times a real one.
    real = Tensor.from_table(read(spark, sf_dir, "supplier"), {"k": "s_nationkey"}, "s_acctbal")
    return both((complex_pair(spark, sf_dir)[0] * real).df, 4, 1e6)


@query(_PAIR + "select k e_k,round(3*x+2*y,2) re,round(3*y-2*x,2) im from a")
def complex_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both((complex_pair(spark, sf_dir)[0] * (3 - 2j)).df, 2)


# --- numbers with tensors

_BUILDING = "with a as (select c_nationkey k,sum(c_acctbal) v from customer where c_mktsegment='BUILDING' and c_nationkey<20 group by 1), g as (select n_nationkey k from nation) "


def building(spark: SparkSession, sf_dir: str) -> Tensor:
    rows = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' and c_nationkey < 20")
    t = Tensor.from_table(rows, {"k": F.col("c_nationkey").cast("long")}, "c_acctbal")
    return Tensor(t.df, Schema(("k",), (Edge.plain(25),), NO))


@query(_BUILDING + "select cast(g.k as bigint) e_k,round(coalesce(v,0)+2.5,2) v from g left join a on a.k=g.k")
def scalar_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(building(spark, sf_dir) + 2.5, 2)


@query(_BUILDING + "select cast(g.k as bigint) e_k,round(1-coalesce(v,0),2) v from g left join a on a.k=g.k")
def scalar_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(1 - building(spark, sf_dir), 2)


@query(_BUILDING + "select cast(k as bigint) e_k,round(1e6/v,6) v from a where v<>0")
def scalar_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = 1e6 / building(spark, sf_dir)
    return value(t, 6).filter(~F.isnan("v") & (F.abs("v") != float("inf")))


@query(_BUILDING + "select cast(g.k as bigint) e_k,coalesce(v,0)=0 zero from g left join a on a.k=g.k")
def dense_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building(spark, sf_dir).dense(spark).df.select("e_k", (F.col("re") == 0).alias("zero"))


@query("select c_custkey e_c,round(ln(1+abs(c_acctbal)),8) v from customer")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False)
    return value(t.map(lambda x: F.log1p(F.abs(x))), 8)


@query("select c_custkey e_c,cast(cast(c_acctbal as real) as double) v from customer")
def to_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False).to("float32")
    return t.df.select("e_c", F.col("re").alias("v"))


@query("select c_custkey e_c,round(case when c_acctbal<=0 then 0 else 1/(c_acctbal*(1+power(100/c_acctbal,6))) end,12) v from customer")
def soft_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False)
    return value(t.map(lambda x: C.soft_inverse(x, 0.01, 0.0, 10000.0)), 12)


@query("select round(power(sum(power(abs(c_acctbal),3)),1/3.0),4) n_p from customer")
def p_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False)
    return rounded(t.p_norm(3), n_p=4)


@query("select round(sum(c_acctbal),2) v from customer")
def scalar_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False)
    ones = Tensor.from_table(read(spark, sf_dir, "customer"), {"k": "c_custkey"}, F.lit(1.0), sum_repeats=False)
    return spark.range(1).select(F.round(F.lit(t.contract(ones, [("c", "k")]).item()), 2).alias("v"))


# --- shapes

@query("select cast(r_regionkey as bigint) e_r,cast(n_nationkey as bigint) e_n,cast(2+3*(r_regionkey*25+n_nationkey) as bigint) v from region cross join nation")
def range_(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.range_(spark, ["r", "n"], [read(spark, sf_dir, "region").count(), read(spark, sf_dir, "nation").count()], NO, 2, 3)
    return t.df.select(*t.keys, F.col("re").cast("long").alias("v"))


_UNITS = "with u as (select unnest([0,1,2]) i) "


@query(_UNITS + "select cast(a.i as bigint) e_a,cast(b.i as bigint) e_b,cast(c.i as bigint) e_c,cast(row_number() over (order by a.i,b.i,c.i)-1 as bigint) v from u a,u b,u c where a.i+b.i+c.i=3")
def range_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.range_(spark, "abc", [UNITS] * 3, BOSE_U1)
    return t.df.select(*t.keys, F.col("re").cast("long").alias("v"))


@query("select cast(count(*) as bigint) n,cast(0 as bigint) s from range(5) a(i),range(5) b(j),range(3) c(k) where ([-1,-1,0,1,1])[i+1]+([-2,-1,0,0,1])[j+1]+k-1=0")
def zero_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.zero(spark, "abc", [Edge.of({-1: 2, 0: 1, 1: 2}), Edge.of({-2: 1, -1: 1, 0: 2, 1: 1}), UNITS], BOSE_U1)
    return t.df.agg(F.count("*").alias("n"), F.sum("re").cast("long").alias("s"))


@query("select true mean,true deviation,true low,true high,cast(40000 as bigint) n")
def random_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tensor.random(spark, "ab", [200, 200], seed=5, mean=3, deviation=2).df.agg(F.avg("re").alias("m"), F.stddev("re").alias("d"), F.count("*").alias("n"))
    b = Tensor.random(spark, "ab", [200, 200], seed=6, normal=False, low=-1, high=4).df.agg(F.min("re").alias("low"), F.max("re").alias("high"))
    near = lambda c, x, e: F.abs(F.col(c) - x) < e
    return a.crossJoin(b).select(near("m", 3, 0.05).alias("mean"), near("d", 2, 0.05).alias("deviation"), near("low", -1, 0.01).alias("low"), near("high", 4, 0.01).alias("high"), "n")  # one row each


@query("select cast(3 as bigint) e_a,cast(1 as bigint) e_b,7.5::double v union all select 0,0,-2.0")
def one_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.one(spark, -2.0, "ab").expand({}, None)
    wide = Tensor(t.df, Schema(("a", "b"), (Edge.plain(4), Edge.plain(2)), NO)).with_element({"a": 3, "b": 1}, 7.5)
    return wide.df.select(*wide.keys, F.col("re").alias("v"))


@query("select l_linenumber e_line,l_returnflag e_f,round(sum(l_tax),4) v from lineitem group by 1,2")
def edge_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"l": "l_linenumber", "f": "l_returnflag"}, "l_tax")
    return value(safe_rename(t, {"l": "line", "nothing": "x"}), 4)


# --- symmetric and fermionic tensors

_Q = "with a as (select c_nationkey%3 x,c_custkey%3 y,sum(c_acctbal) v from customer where (c_nationkey%3)+(c_custkey%3)=2 group by 1,2),b as (select s_nationkey%3 y,s_suppkey%3 z,sum(s_acctbal) w from supplier where (s_nationkey%3)+(s_suppkey%3)=2 group by 1,2) "


def charged(spark: SparkSession, sf_dir: str) -> tuple[Tensor, Tensor]:
    """Charges -1, 0, 1 from remainders; the second tensor's first edge is the conjugate of the first's second."""
    a = symmetric(read(spark, sf_dir, "customer"), {"x": F.col("c_nationkey") % 3, "y": F.col("c_custkey") % 3}, [UNITS, UNITS], BOSE_U1, F.col("c_acctbal"))
    b = symmetric(read(spark, sf_dir, "supplier"), {"u": F.col("s_nationkey") % 3, "z": F.col("s_suppkey") % 3}, [UNITS.conjugate(BOSE_U1), UNITS.conjugate(BOSE_U1)], BOSE_U1, F.col("s_acctbal"))
    return a, b


@query(_Q + "select cast(x as bigint) e_x,cast(z as bigint) e_z,round(sum(v*w)/1e6,3) v from a join b on a.y=b.y group by 1,2")
def contract_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = charged(spark, sf_dir)
    return value(a.contract(b, [("y", "u")]), 3, 1e6)


@query(_Q + "select cast(x as bigint) e_x,cast(z as bigint) e_z,round(sum(v*w)/1e6,3) v from a join b on a.y=b.y group by 1,2")
def contract_safely(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (t.clear_symmetry() for t in charged(spark, sf_dir))
    return value(safe_contract(a, b, [("y", "u"), ("none", "x")]), 3, 1e6)


@query("select round(sum(case when (c_nationkey%3)+(c_custkey%3)=2 then c_acctbal else 0 end),2) v from customer where c_nationkey%3+c_custkey%3=2")
def trace_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Index i of the second edge has the charge of index i of the first, negated, so that the diagonal is what is allowed.
    t = symmetric(read(spark, sf_dir, "customer"), {"x": F.col("c_nationkey") % 3, "y": 2 - F.col("c_custkey") % 3}, [UNITS, UNITS.conjugate(BOSE_U1)], BOSE_U1, F.col("c_acctbal"))
    return value(t.trace([("x", "y")]), 2)


_ODD = "with s as (select cast(l_linenumber%2 as bigint) x,cast(l_quantity as bigint)%2 y,l_suppkey%2 z,l_tax v from lineitem), a as (select x,y,z,sum(v) v from s where (x+y+z)%2=0 group by 1,2,3) "


def odd(spark: SparkSession, sf_dir: str, arrows: tuple[bool, bool, bool] = (False, False, False)) -> Tensor:
    edges = [Edge(PARITY.segments, a) for a in arrows]
    return symmetric(read(spark, sf_dir, "lineitem"), {"x": F.col("l_linenumber") % 2, "y": F.col("l_quantity").cast("long") % 2, "z": F.col("l_suppkey") % 2}, edges, FERMI_Z2, F.col("l_tax"))


@query(_ODD + "select y e_y,cast(z as bigint) e_z,x e_x,round(case when (x*y+x*z)%2=1 then -v else v end,4) v from a")
def transpose_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(odd(spark, sf_dir).transpose("yzx"), 4)


@query(_ODD + "select x e_x,y e_y,cast(z as bigint) e_z,round(case when (x+y)%2=1 then -v else v end,4) v from a")
def reverse_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(odd(spark, sf_dir).reverse_edge(["x", "y"], True), 4)


@query(_ODD + "select x e_x,y e_y,cast(z as bigint) e_z,round(case when (x*y+x*z+y*z)%2=1 then -v else v end,4) re,round(case when (x*y+x*z+y*z)%2=1 then v else -v end,4) im from a")
def conjugate_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = odd(spark, sf_dir)
    z = Tensor(t.df.withColumn("im", F.col("re")), Schema(t.names, t.schema.edges, t.schema.symmetry, True)).conjugate()
    return both(z.df, 4)


@query(_ODD + "select a.x e_x,a.y e_y,b.y e_p,cast(b.z as bigint) e_q,round(sum(case when (a.z*1)%2=1 then -a.v*b.v else a.v*b.v end),4) v from a join a b on a.z=b.x group by 1,2,3,4")
def contract_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An edge without an arrow meets one with: the odd common states count negative.
    a, b = odd(spark, sf_dir), odd(spark, sf_dir, (True, False, False)).edge_rename({"x": "o", "y": "p", "z": "q"})
    return value(a.contract(b, [("z", "o")]), 4)


@query(_ODD + "select y e_y,round(sum(case when (x*y+x)%2=1 then -v else v end),4) v from a where x=z group by 1")
def trace_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The second edge passes y, and carries the arrow.
    return value(odd(spark, sf_dir, (False, False, True)).trace([("x", "z")]), 4)


@query(_ODD + "select case when x=y then x else 2+x end e_m,cast(z as bigint) e_z,round(case when (x*y)%2=1 then -v else v end,4) v from a")
def merge_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(odd(spark, sf_dir).merge_edge({"m": ["x", "y"]}, True), 4)


@query(_ODD + "select x e_x,y e_y,cast(z as bigint) e_z,round(v,4) v from a")
def split_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = odd(spark, sf_dir)
    packed = t.merge_edge({"m": ["x", "y"]}, True)
    return value(packed.split_edge({"m": [("x", t.schema.edge("x")), ("y", t.schema.edge("y"))]}, True), 4)


@query(_ODD + "select cast(z as bigint) e_z,case when x=y then y else 2+y end e_m,round(case when (x*y+x*z+y*z+z)%2=1 then -v else v end,4) v from a")
def edge_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    # z is reversed with its sign, then y and x are merged, in that order, and stand behind z.
    t = odd(spark, sf_dir)
    return value(t.edge_operator(reverse=["z"], merge={"m": ["y", "x"]}, order=["z", "m"], exclude_reverse=["z"]), 4)


@query("select case when (c_nationkey//5)%2=0 then (c_nationkey//10)*5+c_nationkey%5 else 15+(c_nationkey//10)*5+c_nationkey%5 end e_n,round(sum(c_acctbal),2) v from customer where c_nationkey=c_nationkey group by 1")
def clear_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Charges 0 to 4 of five states each become parities: 0, 2, 4 first, then 1 and 3.
    edges = [Edge.of({q: 5 for q in range(5)}), Edge.of({-q: 1 for q in range(5)})]
    t = symmetric(read(spark, sf_dir, "customer"), {"n": F.col("c_nationkey"), "q": F.floor(F.col("c_nationkey") / 5)}, edges, FERMI_U1, F.col("c_acctbal"))
    cleared = t.clear_symmetry()
    return value(Tensor.from_table(cleared.df, {"n": "e_n"}, "re"), 2)


@query(_Q + "select cast(x as bigint) e_x,cast(y as bigint) e_y,round(v,2) v from a")
def clear_bose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(charged(spark, sf_dir)[0].clear_symmetry(), 2)


@query(_Q + "select cast(0 as bigint) e_x,cast(0 as bigint) e_y,round(v,2) v from a where x=0")
def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(charged(spark, sf_dir)[0].block({"x": (-1,), "y": (1,)}), 2)


@query(_Q + "select cast(x as bigint) e_x,cast(y as bigint) e_y,round(case when x=0 then 10*v when x=2 then -1.5 else v end,2) v from a")
def with_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, at = charged(spark, sf_dir)[0], {"x": (-1,), "y": (1,)}
    return value(t.with_block(at, t.block(at) * 10).with_element({"x": 2, "y": 0}, -1.5), 2)


@query(_Q + "select cast(y as bigint) e_y,cast(0 as bigint) e_q,round(v,2) v from a where x=2")
def shrink_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(charged(spark, sf_dir)[0].shrink({"x": 2}, "q"), 2)


@query(_Q + "select cast(x as bigint) e_x,cast(y as bigint) e_y,round(v,2) v from a")
def identity_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = charged(spark, sf_dir)[0]
    unit = Tensor.identity(spark, [("i", "o", UNITS.conjugate(BOSE_U1))], BOSE_U1)
    return value(t.contract(unit, [("y", "i")]).edge_rename({"o": "y"}), 2)


# --- factorisations

_M = "select cast(c_nationkey as bigint) e_n,cast(c_custkey%4 as bigint) e_k,round(sum(c_acctbal),2) v from customer group by 1,2"


def matrix(spark: SparkSession, sf_dir: str) -> Tensor:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"n": F.col("c_nationkey").cast("long"), "k": (F.col("c_custkey") % 4).cast("long")}, "c_acctbal")
    return Tensor(t.df, Schema(("n", "k"), (Edge.plain(25), Edge.plain(4)), NO)).dense(spark)


def shown(t: Tensor) -> DataFrame:
    """Sums that are none but for rounding are left out, and no zero is negative."""
    return value(t, 2).filter("v <> 0")


@query(f"select * from ({_M}) where v<>0")
def svd_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, s, v = linear_algebra.svd(matrix(spark, sf_dir), ["n"], "a", "b", "c", "d")
    return shown(u.contract(s, [("a", "c")]).contract(v, [("d", "b")]))


@query("with m as (select c_nationkey n,c_custkey%4 k,sum(c_acctbal) v from customer group by 1,2) select cast(4 as bigint) n,round(sum(v*v)/1e8,4) s2 from m")
def svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = linear_algebra.svd(matrix(spark, sf_dir), ["n"], "a", "b", "c", "d")
    return s.df.agg(F.count("*").alias("n"), F.round(F.sum(F.col("re") * F.col("re")) / 1e8, 4).alias("s2"))


@query(f"select * from ({_M}) where v<>0")
def qr_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = linear_algebra.qr(matrix(spark, sf_dir), ["n"], "a", "b")
    return shown(q.contract(r, [("a", "b")]))


@query("select cast(4 as bigint) ones,cast(0 as bigint) others")
def qr_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The edges left to R are named; Q^T Q is the identity.
    q, _ = linear_algebra.qr(matrix(spark, sf_dir), ["k"], "a", "b", "r")
    g = q.contract(q.edge_rename({"a": "o"}), [("n", "n")]).df
    one = (F.col("e_a") == F.col("e_o")) & (F.abs(F.col("re") - 1) < 1e-9)
    return g.agg(F.count(F.when(one, 1)).alias("ones"), F.count(F.when((F.col("e_a") != F.col("e_o")) & (F.abs("re") > 1e-9), 1)).alias("others"))


@query(_Q + "select cast(x as bigint) e_x,cast(y as bigint) e_y,round(v,2) v from a")
def svd_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, s, v = linear_algebra.svd(charged(spark, sf_dir)[0], ["x"], "a", "b", "c", "d")
    return shown(u.contract(s, [("a", "c")]).contract(v, [("d", "b")]))


@query("select cast(i as bigint) e_i,cast(j as bigint) e_j,round(case when i=j then exp(a)*(exp(b)+exp(-b))/2 else exp(a)*(exp(b)-exp(-b))/2 end,8) v from (select 0.3 a,avg(l_tax)*10 b from lineitem), range(2) x(i), range(2) y(j)")
def exponential_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "lineitem").agg((F.avg("l_tax") * 10).alias("b"))
    rows = b.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("e_i"), F.lit(j).cast("long").alias("e_j"), (F.lit(0.3) if i == j else F.col("b")).alias("re")) for i in (0, 1) for j in (0, 1)))))
    t = Tensor(rows, Schema(("i", "j"), (Edge.plain(2), Edge.plain(2)), NO))
    return value(linear_algebra.exponential(t, [("i", "j")], 12), 8)


# --- dense matrices

def dense(spark: SparkSession, sf_dir: str) -> Dense:
    cells = read(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return Dense.from_elements(cells, "i", "j", "v", 7, 20, 4)


_D = "with d as (select cast(l_linenumber-1 as bigint) i,cast(l_suppkey%20 as bigint) j,sum(l_quantity) v from lineitem group by 1,2) "


@query(_D + "select a.i i,b.i j,round(sum(a.v*b.v)/1e6,4) v from d a join d b on a.j=b.j group by 1,2")
def dense_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Dense(storage.stored(dense(spark, sf_dir).df, "dense"), 7, 20, 4)
    return m.multiply(m.transpose()).elements().select("i", "j", F.round(F.col("v") / 1e6, 4).alias("v"))


@query(_D + "select j i,i j,round(v,2) v from d")
def dense_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).transpose().redistribute(3).elements().filter("v <> 0").select("i", "j", F.round("v", 2).alias("v"))


@query(_D + "select i,round(sum(v*(j+1)),2) v from d group by 1")
def dense_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dense(spark, sf_dir).multiply_vector(np.arange(1.0, 21.0))
    return spark.createDataFrame([(i, round(float(x), 2)) for i, x in enumerate(out)], "i long, v double")


# --- sources and sinks

def _small(spark: SparkSession, sf_dir: str) -> Tensor:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"n": (F.col("c_nationkey") % 5).cast("long"), "k": (F.col("c_custkey") % 3).cast("long")}, F.col("c_acctbal").cast("long"))
    return Tensor(t.df, Schema(("n", "k"), (Edge.plain(5), Edge.plain(3)), NO))


_S = "select cast(c_nationkey%5 as bigint) e_n,cast(c_custkey%3 as bigint) e_k,round(sum(cast(trunc(c_acctbal) as bigint)),2)::double v from customer group by 1,2"


@query(_S)
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(text.parse(spark, text.show(_small(spark, sf_dir))), 2)


@query(_S)
def bytes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(text.loads(spark, text.dumps(_small(spark, sf_dir))), 2)


@query(_S)
def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{storage.shared_dir(spark, 'tensor')}"
    text.write_tensor(_small(spark, sf_dir), path)
    return value(text.read_tensor(spark, path), 2)


@query("select [cast(l_linenumber as int),cast(l_suppkey%4 as int)] sites,[true,false] daggers,round(sum(l_tax),6) coefficient from lineitem where l_tax>0.03 group by 1,2")
def fermion_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    rows = items.select(F.array(F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 4).cast("int")).alias("sites"), F.array(F.lit(True), F.lit(False)).alias("daggers"), F.col("l_tax").alias("coefficient"))
    return rounded(terms.fermion_terms(rows, 0.03), coefficient=6)


# --- lattices

@query("select cast(least(a,b) as bigint) p,cast(greatest(a,b) as bigint) q,round(sum(v),2) v from (select n_nationkey%4 a,(n_nationkey//4)%4 b,sum(c_acctbal) v from nation join customer on c_nationkey=n_nationkey group by 1,2) where a<>b group by 1,2")
def state_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Points are sorted and equal terms added by the lattice; its first element is the sum. A row a pair of 16.
    a, b = F.col("c_nationkey") % 4, F.floor(F.col("c_nationkey") / 4) % 4
    rows = read(spark, sf_dir, "customer").filter(a != b).groupBy(a.cast("int").alias("a"), b.cast("int").alias("b")).agg(F.sum("c_acctbal").alias("v")).collect()
    state = State(1, 4)
    state.set_physics(2)
    for r in rows:
        state.add([(0, r["a"], 0), (0, r["b"], 0)], r["v"] * product(SZ, SZ) * 4)
    first = state.elements(spark).filter("x = array(0, 0)")
    at = lambda k: F.col("points")[k][1].cast("long")
    return first.select(at(0).alias("p"), at(1).alias("q"), F.round("re", 2).alias("v"))


@query("select round(-4*sqrt(2)/9,8) e0")
def free_fermion_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Four particles fill the lowest levels of the 3 x 3 lattice, sqrt(2) (a + b) for a, b in -1, 0, 1.
    energy, _ = fermions.free_fermion(3, 3, 4).ground_state(spark, 18)
    return spark.range(1).select(F.round(F.lit(energy), 8).alias("e0"))


@query("select round((5-sqrt(25+16))/2/2,8) e0")
def hubbard_dimer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two sites, two particles: (U - sqrt(U^2 + 16 t^2)) / 2.
    energy, _ = fermions.hubbard(1, 2, 2, 1.0, 5.0, up=1).ground_state(spark, 4)
    return spark.range(1).select(F.round(F.lit(energy), 8).alias("e0"))


@query("select cast(count(*) as bigint) n from range(512) r(i) where bit_count(cast(i as bigint))=4")
def conserved_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fermions.free_fermion(3, 3, 4).basis(spark).agg(F.count("*").alias("n"))


@query("with s as (select cast(o_orderkey%512 as bigint) s,sum(o_totalprice) v from orders group by 1) select xor(s,36) e_s,round(case when bit_count((s & 24))%2=1 then -v else v end,2) v from s where (s & 4)=0 and (s & 32)<>0")
def hop_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fermion hops from mode 5 to mode 2 over modes 3 and 4.
    t = Tensor.from_table(read(spark, sf_dir, "orders"), {"s": (F.col("o_orderkey") % 512).cast("long")}, "o_totalprice")
    return value(fermions.apply_strings(t, {(fermions.creates(2), fermions.destroys(5)): 1.0}), 2)


def pair_state(spark: SparkSession) -> tuple[State, Tensor]:
    state = models.find("heisenberg")(1, 2, -1.0)
    _, v = state.ground_state(spark, 4, 1)
    return state, v


@query("select round(-0.375,8) energy,round(-0.25,8) correlation")
def exact_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two spins in their singlet.
    state, v = pair_state(spark)
    found = exact_energy(spark, state, v), state.observe(spark, v, [(0, 0, 0), (0, 1, 0)], product(SZ, SZ))
    return spark.range(1).select(F.round(F.lit(found[0]), 8).alias("energy"), F.round(F.lit(found[1]), 8).alias("correlation"))


def exact_energy(spark: SparkSession, state: State, v: Tensor) -> float:
    return inner(v, state.apply(spark, v)) / inner(v, v) / state.site_number


@query("select round(-0.75,8) expect,round(0.0,6) dev")
def ergodic_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All configurations, weighted by their amplitudes, have the energy of the state, without deviation for a ground state.
    state, v = pair_state(spark)
    v = Tensor(storage.stored(v.df, "vector"), v.schema)
    table = amplitudes(Tensor(v.df.filter(F.abs("re") > 1e-9), v.schema))
    energies = state.local_energies(spark, state.ergodic(spark), table).withColumn("g", F.lit(0))
    return rounded(estimators.observe(energies, ["g"], F.col("r"), F.col("e")), expect=8, dev=6).select("expect", "dev")


@query("select c_nationkey g,round(sum(c_acctbal*m)/sum(m),6) expect from (select c_nationkey,c_acctbal,cast(c_custkey%3+1 as double) m from customer) group by 1")
def observe_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").withColumn("g", F.col("c_nationkey"))
    return rounded(estimators.observe(rows, ["g"], F.lit(1.0), F.col("c_acctbal"), F.col("c_custkey") % 3 + 1), expect=6).select("g", "expect")


@query("select cast(2*(sum(r_regionkey)+100) as bigint) v from region")
def lazy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A node is computed when asked, and anew after its root was reset.
    root = Root(1)
    total = Node(lambda x: read(spark, sf_dir, "region").agg(F.sum("r_regionkey").alias("s")).first()["s"] + x, root)
    twice = Node(lambda x: 2 * x, total)
    twice()
    root.reset(100)
    return spark.range(1).select(F.lit(twice()).cast("long").alias("v"))




# --- site tensors

@query("select * from (values (cast(0 as bigint),cast(1 as bigint),cast(1 as bigint),cast(0 as bigint),1.0::double),(1,0,0,1,1.0)) t(\"e_O0\",\"e_O1\",\"e_I0\",\"e_I1\",v)")
def fermi_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fermion changes sites, from the inner to the outer states.
    t = toolkit.hopping(spark).transpose(["O0", "O1", "I0", "I1"]).nonzero()
    return t.df.select(*t.keys, F.col("re").alias("v"))


def _aligned(spark: SparkSession) -> SamplingLattice:
    """Site tensors of ones: all spins along x, for which the local energy of 2 x 2 sites is 4 / 4 everywhere."""
    lattice = SamplingLattice.create(models.find("heisenberg")(2, 2, -1.0), 1)
    lattice.tensors = {s: np.ones_like(t) for s, t in lattice.tensors.items()}
    return lattice


def _sampled(spark: SparkSession, method: str, steps: int) -> DataFrame:
    rows = _aligned(spark).observe(spark, method, 2, steps, deltas=False).withColumn("g", F.lit(0))
    out = estimators.observe(rows, ["g"], F.col("r"), F.col("e"))
    return rounded(out.join(estimators.instability(rows, ["g"], F.col("r")), "g"), expect=8, dev=8, v=8).select("expect", "dev", "v")


_ALIGNED = "select 1.0::double expect,0.0::double dev,0.0::double v"


@query(_ALIGNED)
def sampling_ergodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, "ergodic", 0)


@query(_ALIGNED)
def sampling_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, "direct", 20)


@query(_ALIGNED)
def sampling_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, "sweep", 20)


@query("select cast(8 as bigint) parameters,0.0::double largest")
def sampling_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In an eigenstate no parameter lowers the energy.
    rows = _aligned(spark).observe(spark, "ergodic", 2, 0)
    cells = rows.select("r", "e", F.explode(F.arrays_zip("parameter", "delta")).alias("z")).select("r", "e", F.col("z.parameter").alias("p"), F.col("z.delta").alias("d"))
    g = estimators.gradient(cells, ["p"], F.col("r"), F.col("e"), F.col("d"))
    return g.agg(F.count("*").alias("parameters"), F.round(F.max(F.abs("g")), 8).alias("largest"))


@query("select -0.375::double energy")
def simple_update_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Imaginary time leads two spins to their singlet, whose bond weights are the whole environment.
    su = SimpleUpdate.create(spark, models.find("heisenberg")(1, 2, -1.0), 2, 3)
    su.update(8, 0.5, 2)
    return spark.range(1).select(F.round(F.lit(su.environment_energy()), 4).alias("energy"))


@query("select 1.0::double overlap")
def conversion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One state by way of its site tensors and contracted at once.
    su = SimpleUpdate.create(spark, models.find("heisenberg")(2, 2, -1.0), 2, 5)
    a, b = su.to_exact(spark), conversion.exact_from_sampling(spark, conversion.sampling_from_simple(su))
    a = Tensor(storage.stored(a.df, "vector"), a.schema)
    overlap = inner(a, b) ** 2 / inner(a, a) / inner(b, b)
    return spark.range(1).select(F.round(F.lit(overlap), 8).alias("overlap"))


@query("select c_nationkey%3 e_x,c_custkey%3 e_y,cast(count(*) as bigint) times from customer group by 1,2 having (c_nationkey%3)+(c_custkey%3)<>2 or count(*)>1")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows of a table that aren't elements of a tensor with charges.
    rows = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("e_x"), (F.col("c_custkey") % 3).alias("e_y"), F.lit(1.0).alias("re"))
    return Tensor(rows, Schema(("x", "y"), (UNITS, UNITS), BOSE_U1)).wrong_elements()


@query("with c as (select l_orderkey k,l_linenumber n,[l_linenumber%2,l_suppkey%2,l_partkey%2] a,[l_suppkey%2,l_partkey%2,l_linenumber%2] b,l_partkey p from lineitem) select k,n,p,cast(count(*) as bigint) rows,cast(sum((a[1]<>b[1])::int+(a[2]<>b[2])::int+(a[3]<>b[3])::int) as bigint) changes,true whole from c group by 1,2,3")
def configuration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What differs between two configurations, put into the first, gives the second.
    bits = [F.col(c).cast("long") % 2 for c in ("l_linenumber", "l_suppkey", "l_partkey")]
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.array(*bits).alias("a"), F.array(*bits[1:], bits[0]).alias("b"))
    rows = rows.withColumn("d", ranking.differences(F.col("a"), F.col("b")))
    same = ranking.replaced(F.col("a"), F.col("d")) == F.col("b")
    return rows.groupBy("k", "n", "p").agg(F.count("*").alias("rows"), F.sum(F.size("d")).cast("long").alias("changes"), F.min(same).alias("whole"))


@query("select true uniform,true normal")
def random_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = read(spark, sf_dir, "orders").select(ranking.uniform(3, -1, 3)(F.col("o_orderkey")).alias("u"), ranking.normal(4, 5, 2)(F.col("o_orderkey")).alias("z"))
    out = draws.agg(F.avg("u").alias("u"), F.avg("z").alias("z"), F.stddev("z").alias("d"), F.min("u").alias("low"), F.max("u").alias("high"))
    return out.select(((F.abs(F.col("u") - 1) < 0.1) & (F.col("low") >= -1) & (F.col("high") <= 3)).alias("uniform"), ((F.abs(F.col("z") - 5) < 0.1) & (F.abs(F.col("d") - 2) < 0.1)).alias("normal"))


# --- neural states

def _flat(network: str, **options) -> NeuralState:
    """Equal amplitudes, all spins along x, as for the site tensors of ones above."""
    lattice = NeuralState.create(models.find("heisenberg")(2, 2, -1.0), network, **options)
    flat = {"table": 1.0, "matrices": 1.0, "level": 1.0}
    lattice.tensors = {n: np.full_like(a, flat.get(n, 0.0)) for n, a in lattice.tensors.items()}
    return lattice


def _seen(spark: SparkSession, lattice: NeuralState, method: str, steps: int) -> DataFrame:
    rows = lattice.observe(spark, method, 2, steps, deltas=False).withColumn("g", F.lit(0))
    out = estimators.observe(rows, ["g"], F.col("r"), F.col("e"), F.col("m"))
    return rounded(out.join(rows.groupBy("g").agg(F.sum("m").cast("long").alias("n")), "g"), expect=8, dev=8).select("expect", "dev", "n")


@query("select 1.0::double expect,0.0::double dev,cast(16 as bigint) n")
def neural_ergodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, _flat("table"), "ergodic", 0)


@query("select 1.0::double expect,0.0::double dev,cast(2000 as bigint) n")
def neural_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 1000 draws by each of two chains, told apart by configuration and counted.
    return _seen(spark, _flat("autoregressive"), "direct", 1000)


@query("select 1.0::double expect,0.0::double dev,cast(40 as bigint) n")
def neural_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, _flat("convolution"), "sweep", 20)


@query("select cast(8 as bigint) parameters,0.0::double largest")
def neural_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In an eigenstate no parameter lowers the energy.
    lattice = _flat("chain", bond=1)
    change = lattice.gradient(lattice.observe(spark, "ergodic", 2, 0))
    return spark.createDataFrame([(len(change), abs(round(float(np.abs(change).max()), 8)))], "parameters long, largest double")


@query("select cast(6 as bigint) configurations,true whole,true balanced")
def neural_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    # With two spins up and two down there are six configurations, whose squared amplitudes add up to one.
    lattice = NeuralState.create(models.find("heisenberg")(2, 2), "autoregressive", counts=[2, 2], seed=1)
    rows = lattice.observe(spark, "ergodic", 2, 0, deltas=False)
    up = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    return rows.agg(F.count("*").alias("configurations"), (F.abs(F.sum("r") - 1) < 1e-9).alias("whole"), F.min(up == 2).alias("balanced"))


@query("select true same")
def neural_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = models.find("heisenberg")(2, 2)
    first, second = Autoregressive(state, seed=1), Autoregressive(state, seed=2)
    path = storage.shared_dir(spark, "weights")
    write_weights(spark, first, path)
    read_weights(spark, second, path)
    return spark.createDataFrame([(all(np.array_equal(a, second.parameters[n]) for n, a in first.parameters.items()),)], "same boolean")
