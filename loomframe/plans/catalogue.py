"""Queries of the tensor operators over the driver's tables, and the same results in DuckDB SQL.

Every query goes through the engine's operators; tables become tensors by picking key columns and a value column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import ranking
from ..functions.symmetry import FERMI_Z2, NO, Edge, Schema
from ..operators import estimators, linear_algebra
from ..operators.tensor import Tensor, chain
from ..sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def value(t: Tensor, places: int, scale: float = 1.0) -> DataFrame:
    return t.df.select(*t.keys, F.round(F.col("re") / scale, places).alias("v"))


@query("select o_orderpriority e_p, l_returnflag e_f, round(sum(o_totalprice*l_quantity)/1e6,4) v from orders join lineitem on o_orderkey=l_orderkey group by 1,2")
def contract_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both sides are dealt out by the order once; an order has few rows of one flag, so summing them first would add a
    # shuffle and reduce little. The sum by priority and flag combines in the map tasks.
    a = Tensor.from_table(read(spark, sf_dir, "orders"), {"o": "o_orderkey", "p": "o_orderpriority"}, "o_totalprice", sum_repeats=False)
    b = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"k": "l_orderkey", "f": "l_returnflag"}, "l_quantity", sum_repeats=False)
    return value(a.contract(b, [("o", "k")]), 4, 1e6)


@query("with a as (select l_returnflag f,l_linestatus s,sum(l_quantity) v from lineitem group by 1,2), b as (select l_returnflag f,l_linenumber k,sum(l_discount) w from lineitem group by 1,2) select a.f e_f,s e_s,k e_k,round(sum(v*w),4) v from a join b on a.f=b.f group by 1,2,3")
def contract_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    a = Tensor.from_table(items, {"f": "l_returnflag", "s": "l_linestatus"}, "l_quantity")
    b = Tensor.from_table(items, {"f": "l_returnflag", "k": "l_linenumber"}, "l_discount")
    return value(a.contract(b, [], fuse=["f"]), 4)


@query("select a.r_regionkey e_a,b.r_regionkey e_b,cast(a.r_regionkey*b.r_regionkey as bigint) v from region a cross join region b")
def contract_kron(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tensor.from_table(read(spark, sf_dir, "region"), {"a": "r_regionkey"}, "r_regionkey", sum_repeats=False)
    out = a.contract(a.edge_rename({"a": "b"}), [])
    return out.df.select("e_a", "e_b", F.col("re").cast("long").alias("v"))


def sold(spark: SparkSession, sf_dir: str, amount: str) -> Tensor:
    """Amounts by the nations of customer and supplier. Orders, and suppliers of an order, hardly repeat, so only the last
    contraction sums."""
    items = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"lo": "l_orderkey", "ls": "l_suppkey"}, amount, sum_repeats=False)
    orders = Tensor.from_table(read(spark, sf_dir, "orders"), {"oo": "o_orderkey", "oc": "o_custkey"}, F.lit(1.0), sum_repeats=False)
    customers = Tensor.from_table(read(spark, sf_dir, "customer"), {"cc": "c_custkey", "c": "c_nationkey"}, F.lit(1.0), sum_repeats=False)
    suppliers = Tensor.from_table(read(spark, sf_dir, "supplier"), {"ss": "s_suppkey", "s": "s_nationkey"}, F.lit(1.0), sum_repeats=False)
    by_supplier = items.contract(suppliers, [("ls", "ss")], summed=False)
    return by_supplier.contract(orders, [("lo", "oo")], summed=False).contract(customers, [("oc", "cc")])


@query("select round(sum(l_extendedprice),2) v from orders join lineitem on o_orderkey=l_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey where c_nationkey=s_nationkey")
def trace_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(sold(spark, sf_dir, "l_extendedprice").trace([("c", "s")]), 2)


@query("select c_nationkey e_n,round(sum(l_extendedprice),2) v from orders join lineitem on o_orderkey=l_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey where c_nationkey=s_nationkey group by 1")
def trace_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value(sold(spark, sf_dir, "l_extendedprice").trace([], {"n": ("c", "s")}), 2)


@query("select max(abs(c_acctbal)) n_max,count(*) n_num,round(sum(abs(c_acctbal)),2) n_sum,round(sqrt(sum(c_acctbal*c_acctbal)),4) n_2 from customer")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False).norms(), n_sum=2, n_2=4)


@query("select l_linestatus e_b,l_returnflag e_a,round(sum(case when l_linenumber%2=1 and cast(l_quantity as bigint)%2=1 then -l_tax else l_tax end),4) v from lineitem group by 1,2")
def transpose_fermi(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Edges x and y carry the parity of their index; transposing them gives the sign.
    parity = Edge((((0,), 1), ((1,), 1)))
    items = read(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 2).cast("long").alias("e_x"), (F.col("l_quantity").cast("long") % 2).alias("e_y"), F.col("l_returnflag").alias("e_a"), F.col("l_linestatus").alias("e_b"), F.col("l_tax").alias("re"),
    )
    even = Edge((((0,), 1),))
    t = Tensor(items, Schema(("x", "y", "a", "b"), (parity, parity, even, even), FERMI_Z2)).transpose(["y", "x", "b", "a"])
    out = Tensor(t.df, Schema(t.names, (None,) * 4, NO))
    return value(Tensor.from_table(out.df, {"b": "e_b", "a": "e_a"}, "re"), 4)


@query("select cast(n_regionkey*25+n_nationkey as bigint) e_m,count(*) v from nation join customer on c_nationkey=n_nationkey group by 1")
def merge_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    counts = Tensor.from_table(customers, {"c": "c_nationkey"}, "n", sum_repeats=False)
    nations = Tensor.from_table(read(spark, sf_dir, "nation"), {"r": "n_regionkey", "n": "n_nationkey", "k": "n_nationkey"}, F.lit(1.0), sum_repeats=False)
    t = nations.contract(counts, [("k", "c")])
    t = Tensor(t.df, Schema(t.names, (Edge.plain(5), Edge.plain(25)), NO)).merge_edge({"m": ["r", "n"]})
    return t.df.select("e_m", F.col("re").cast("long").alias("v"))


@query("select cast(floor(l_linenumber/2) as bigint) e_hi,cast(l_linenumber%2 as bigint) e_lo,round(sum(l_quantity),2) v from lineitem group by 1,2")
def split_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"l": F.col("l_linenumber").cast("long")}, "l_quantity")
    t = Tensor(t.df, Schema(("l",), (Edge.plain(10),), NO))
    return value(t.split_edge({"l": [("hi", 5), ("lo", 2)]}), 2)


@query("with s as (select cast(c_nationkey%3-1 as bigint) q1,cast(c_custkey%3-1 as bigint) q2,c_acctbal v from customer) select q1,q2,count(*) n,round(sum(v),2) v from s where q1+q2=0 group by 1,2")
def charge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = Edge((((-1,), 1), ((0,), 1), ((1,), 1)))
    t = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).cast("long").alias("e_a"), (F.col("c_custkey") % 3).alias("e_b"), F.col("c_acctbal").alias("re"))
    q1, q2 = C.charge(edge, 0, F.col("e_a")), C.charge(edge, 0, F.col("e_b"))
    return rounded(t.select(q1.alias("q1"), q2.alias("q2"), "re").filter("q1 + q2 = 0").groupBy("q1", "q2").agg(F.count("*").alias("n"), F.sum("re").alias("v")), v=2)


@query("with s as (select p_size ord,cast(p_size%4 as bigint) q,count(*) dim from part group by 1,2) select ord,q,dim,cast(coalesce(sum(dim) over (partition by q order by ord rows between unbounded preceding and 1 preceding),0) as bigint) off from s")
def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("ord"), (F.col("p_size") % 4).cast("long").alias("q")).agg(F.count("*").alias("dim"))
    return ranking.segment_offsets(segments, "q", "dim", ["ord"])


@query("with s as (select n_regionkey pos,count(*) dim from nation group by 1) select pos,dim,cast(sum(dim) over (order by pos)-dim as bigint) first_index from s")
def clear_symmetry_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_indices(read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("pos")).agg(F.count("*").alias("dim")), "dim", ["pos"])


@query("with w as (select p_size q,p_retailprice s,row_number() over (order by p_retailprice desc,p_size,p_partkey) rk,max(p_retailprice) over () mx from part) select q,count(*) keep from w where rk<=200 and s>0.5*mx group by 1")
def svd_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_size").alias("q"), F.col("p_retailprice").alias("s"), "p_partkey")
    return ranking.truncated(parts, "q", "s", ["q", "p_partkey"], 200, 0.5).groupBy("q").agg(F.count("*").alias("keep"))


@query("select l_returnflag e_f,round(sum(l_quantity),2) v from lineitem where l_linenumber=3 group by 1")
def shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"l": "l_linenumber", "f": "l_returnflag"}, "l_quantity", sum_repeats=False).shrink({"l": 3})
    return value(Tensor.from_table(t.df, {"f": "e_f"}, "re"), 2)


@query("select cast(7 as bigint) e_new,r_regionkey e_r,cast(1 as bigint) v from region")
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "region"), {"r": "r_regionkey"}, F.lit(1.0), sum_repeats=False).expand({"new": (7, 10)})
    return t.df.select("e_new", "e_r", F.col("re").cast("long").alias("v"))


def balances(spark: SparkSession, sf_dir: str, segment: str | None = None) -> tuple[Tensor, Tensor]:
    customers = read(spark, sf_dir, "customer")
    customers = customers.filter(F.col("c_mktsegment") == segment) if segment else customers
    return Tensor.from_table(customers, {"k": "c_nationkey"}, "c_acctbal"), Tensor.from_table(read(spark, sf_dir, "supplier"), {"k": "s_nationkey"}, "s_acctbal")


@query("with a as (select c_nationkey k,sum(c_acctbal) v from customer where c_mktsegment='BUILDING' group by 1), b as (select s_nationkey k,sum(s_acctbal) w from supplier group by 1) select coalesce(a.k,b.k) e_k,round(coalesce(v,0)+coalesce(w,0),2) v from a full outer join b on a.k=b.k")
def zip_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = balances(spark, sf_dir, "BUILDING")
    return value(a + b, 2)


@query("select c_custkey e_c,round(sqrt(abs(c_acctbal)),6) s,round(case when c_acctbal=0 then 0.0 else 1/c_acctbal end,9) r from customer")
def sqrt_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"c": "c_custkey"}, "c_acctbal", sum_repeats=False)
    root, inverse = t.sqrt().df.withColumnRenamed("re", "s"), t.reciprocal().df.withColumnRenamed("re", "r")
    return rounded(root.join(inverse, "e_c"), s=6, r=9)


@query("select l_returnflag e_f,round(sum(l_quantity*l_tax-l_discount*l_extendedprice),4) re,round(sum(l_quantity*l_extendedprice+l_discount*l_tax),4) im from lineitem group by 1")
def complex_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    product = C.cmul((F.col("l_quantity"), F.col("l_discount")), (F.col("l_tax"), F.col("l_extendedprice")))
    return rounded(Tensor.from_table(items, {"f": "l_returnflag"}, product[0], product[1]).df, re=4, im=4)


@query("with a as (select c_nationkey k,sum(c_acctbal) v from customer group by 1),b as (select s_nationkey k,sum(s_acctbal) w from supplier group by 1) select round(sum(v*w)/1e6,3) v from a join b on a.k=b.k")
def lattice_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = balances(spark, sf_dir)
    return value(a.contract(b, [("k", "k")]), 3, 1e6)


@query("with m as (select c_nationkey i,s_nationkey j,sum(l_quantity) v from orders join lineitem on o_orderkey=l_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey group by 1,2) select round(max(abs(coalesce(a.v,0)-coalesce(b.v,0))),2) err from m a full outer join m b on a.i=b.j and a.j=b.i")
def hermite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sold(spark, sf_dir, "l_quantity")
    t = Tensor(stored(t.df, "sold"), t.schema)  # read twice; a row for each pair of nations
    return rounded((t - t.edge_rename({"c": "s", "s": "c"})).norms().select(F.col("n_max").alias("err")), err=2)


@query("with t as (select l_suppkey%5 a,l_partkey%5 b,l_quantity v from lineitem) select cast(least(a,b) as bigint) e_0,cast(greatest(a,b) as bigint) e_1,round(sum(v),2) v from t group by 1,2")
def sort_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array_sort(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5))
    items = read(spark, sf_dir, "lineitem").select(points.alias("p"), "l_quantity")
    return value(Tensor.from_table(items, {"0": F.col("p")[0], "1": F.col("p")[1]}, "l_quantity"), 2)


@query("with o as (select l_shipdate is not null k,l_returnflag g,sum(l_discount+0.5) r,sum(power(l_discount+0.5,2)) rr,sum(l_quantity*(l_discount+0.5)) er,sum(l_quantity*power(l_discount+0.5,2)) err,sum(power(l_quantity*(l_discount+0.5),2)) eerr from lineitem group by 1,2) select g,round(er/r,8) expect,round(sqrt(greatest((eerr-2*err*(er/r)+rr*power(er/r,2))/(r*r),0)),8) dev from o")
def observe_mean_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag"))
    return rounded(estimators.observe(items, ["g"], F.col("l_discount") + 0.5, F.col("l_quantity")), expect=8, dev=8)


@query("select l_linestatus g,round(stddev_pop(l_discount+0.5)/avg(l_discount+0.5),8) v from lineitem group by 1")
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.instability(read(spark, sf_dir, "lineitem").withColumn("g", F.col("l_linestatus")), ["g"], F.col("l_discount") + 0.5), v=8)


@query("with s as (select l_linenumber p,l_discount+0.5 r,l_extendedprice e,l_quantity d from lineitem) select p,round(2*(sum(r*e*d)/sum(r)-sum(r*e)/sum(r)*sum(r*d)/sum(r)),4) g from s group by 1")
def gradient_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("p", F.col("l_linenumber"))
    return rounded(estimators.gradient(items, ["p"], F.col("l_discount") + 0.5, F.col("l_extendedprice"), F.col("l_quantity")), g=4)


@query("select user_id,event_type,count(*) m from events group by 1,2")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.multiplicity(read(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("with w as (select n_regionkey r,n_nationkey i,sum(n_nationkey+1) over (partition by n_regionkey order by n_nationkey) c,sum(n_nationkey+1) over (partition by n_regionkey) t from nation) select r,cast(coalesce(min(case when c>0.37*t then i end),max(i)) as bigint) pick from w group by 1")
def categorical_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").withColumn("r", F.col("n_regionkey"))
    return ranking.categorical(nations, ["r"], "n_nationkey", F.col("n_nationkey") + 1, F.lit(0.37))


@query("select a.r_regionkey s0,b.r_regionkey s1,c.r_regionkey s2 from region a cross join region b cross join region c")
def ergodic_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "region").count()
    return spark.range(n**3).select(*(d.alias(f"s{i}") for i, d in enumerate(ranking.odometer(F.col("id"), [n] * 3))))


@query("with e as (select event_id,value,lag(value) over (partition by user_id order by event_id) prev,(event_id*7919%10007)/10007.0 u from events) select event_id,case when prev is null or prev=0 then 0 when u<power(value/prev,2) then 1 else 0 end acc from e")
def metropolis_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    events = read(spark, sf_dir, "events").select("event_id", "value", before.alias("prev"))
    u = (F.col("event_id") * 7919 % 10007) / 10007.0
    return events.select("event_id", estimators.accepted(F.try_divide("value", "prev"), u).alias("acc"))


@query("select l_returnflag g,round(exp(avg(ln(l_extendedprice))/9),8) param from lineitem group by 1")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.normalisation(read(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag")), ["g"], F.col("l_extendedprice"), 9), param=8)


@query("with m as (select o_custkey i,l_partkey j,sum(l_quantity) v from orders join lineitem on o_orderkey=l_orderkey group by 1,2) select i e_i,round(sum(v*p_retailprice),2) w from m join part on p_partkey=j group by 1")
def h_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Tensor.from_table(read(spark, sf_dir, "lineitem"), {"lo": "l_orderkey", "j": "l_partkey"}, "l_quantity")
    prices = Tensor.from_table(read(spark, sf_dir, "part"), {"p": "p_partkey"}, "p_retailprice", sum_repeats=False)
    orders = Tensor.from_table(read(spark, sf_dir, "orders"), {"oo": "o_orderkey", "i": "o_custkey"}, F.lit(1.0), sum_repeats=False)
    # The vector is applied before the wide matrix is formed: (M v) needs no (customer, part) rows.
    out = orders.contract(items.contract(prices, [("j", "p")]), [("oo", "lo")])
    return out.df.select("e_i", F.round("re", 2).alias("w"))


@query("select label q,round(sum(power(cast(x as double),2)),4) s2 from (select label,unnest(embedding) x from embeddings) group by 1")
def svd_frobenius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("q"), F.col("embedding").cast("array<double>").alias("row"))
    squares = linear_algebra.tall_singular_values(rows, "q", "row")
    return rounded(squares.groupBy("q").agg(F.sum(F.col("s") * F.col("s")).alias("s2")), s2=4)


@query("with g as (select l_returnflag q,sum(l_quantity*l_quantity) a,sum(l_quantity*l_tax) b,sum(l_tax*l_tax) d from lineitem group by 1) select q,round(a,2) r2_0,round(d,6) r2_1 from g")
def qr_column_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("q"), F.array("l_quantity", "l_tax").alias("row"))
    r = linear_algebra.tall_qr(rows, "q", "row", 2)
    return r.select("q", F.round(F.col("r")[0] * F.col("r")[0], 2).alias("r2_0"), F.round(F.col("r")[1] * F.col("r")[1] + F.col("r")[3] * F.col("r")[3], 6).alias("r2_1"))


@query("select r_regionkey e_i,round(exp(-r_regionkey/4.0),10) v from region")
def exponential_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "region"), {"i": F.col("r_regionkey").cast("long"), "j": F.col("r_regionkey").cast("long")}, -F.col("r_regionkey") / 4.0, sum_repeats=False)
    edge = Edge.plain(5)
    out = linear_algebra.exponential(Tensor(t.df, Schema(("i", "j"), (edge, edge), NO)), [("i", "j")])
    return out.df.filter("e_i = e_j").select(F.col("e_i").cast("int").alias("e_i"), F.round("re", 10).alias("v"))


@query("with s as (select sum(l_discount) a,sum(l_tax) b,sum(l_quantity)/1e6 d from lineitem) select round((a+d)/2-sqrt(power((a-d)/2,2)+b*b),6) e0 from s")
def lanczos_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.exact import ground_state

    s = read(spark, sf_dir, "lineitem").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"), (F.sum("l_quantity") / 1e6).alias("d"))
    rows = s.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("e_O"), F.lit(j).cast("long").alias("e_I"), F.col(c).alias("re")) for i, j, c in ((0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "d"))))))
    edge = Edge.plain(2)
    h = Tensor(rows, Schema(("O", "I"), (edge, edge), NO))
    start = Tensor.generate(spark, ["I"], [edge], NO, lambda i: F.when(i == 0, 0.6).otherwise(0.8))
    energy, _ = ground_state(lambda v: h.contract(v, [("I", "I")]).edge_rename({"O": "I"}), start, 2)
    return spark.range(1).select(F.round(F.lit(energy), 6).alias("e0"))


@query("select round(sum(l_extendedprice*l_quantity)/sum(l_quantity*l_quantity),6) x from lineitem")
def cg_one_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    rows = items.select(F.xxhash64(*items.columns).alias("s"), F.lit(0).cast("long").alias("p"), F.col("l_quantity").alias("d"), F.col("l_extendedprice").alias("e"))
    x = estimators.conjugate_gradient(rows, "s", "p", "d", "e", 1)
    return spark.range(1).select(F.round(F.lit(x[0]), 6).alias("x"))


@query("select cast(5*3 as bigint) ones,cast(225 as bigint) stored")
def identity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.identity(spark, [("a", "b", 5), ("c", "d", 3)]).dense(spark)
    return t.df.agg(F.sum("re").cast("long").alias("ones"), F.count("*").alias("stored"))


@query("select n_regionkey e_r,round(sum(c_acctbal*o.s)/1e6,4) v from nation join customer on c_nationkey=n_nationkey join (select o_custkey,sum(o_totalprice) s from orders group by 1) o on o_custkey=c_custkey group by 1")
def chain_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tensor.from_table(read(spark, sf_dir, "orders"), {"oc": "o_custkey"}, "o_totalprice")
    customers = Tensor.from_table(read(spark, sf_dir, "customer"), {"cc": "c_custkey", "cn": "c_nationkey"}, "c_acctbal", sum_repeats=False)
    nations = Tensor.from_table(read(spark, sf_dir, "nation"), {"nn": "n_nationkey", "r": "n_regionkey"}, F.lit(1.0), sum_repeats=False)
    return value(chain([orders, customers, nations], [(0, "oc", 1, "cc"), (1, "cn", 2, "nn")]), 4, 1e6)


@query("select cast(l_linenumber as bigint) e_c,round(sum(l_tax),6) v from lineitem where l_tax>0.03 group by 1")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").filter(F.abs("l_tax") > 0.03)
    return value(Tensor.from_table(items, {"c": F.col("l_linenumber").cast("long")}, "l_tax"), 6)


@query("select c_nationkey e_n,round(sum(c_acctbal),2) re,round(-sum(c_acctbal)/2,2) im from customer group by 1")
def conjugate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tensor.from_table(read(spark, sf_dir, "customer"), {"n": "c_nationkey"}, "c_acctbal", F.col("c_acctbal") / 2).conjugate()
    return rounded(t.df, re=2, im=2)


@query("select event_type g,strftime(time_bucket(interval '1 day', ts),'%Y-%m-%d') w,round(sum(value*value)/sum(value),6) expect from events where value>0 group by 1,2")
def windowed_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.observer import windowed

    events = read(spark, sf_dir, "events").filter("value > 0").withColumn("g", F.col("event_type"))
    return windowed(events, "ts", "1 day", ["g"], F.col("value"), F.col("value")).select("g", F.date_format("window.start", "yyyy-MM-dd").alias("w"), F.round("expect", 6).alias("expect"))


