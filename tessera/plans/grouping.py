"""Joins, grouping, aggregation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import relational as R
from tessera.plans.common import LINE_ORDER, LINES, cents, lines, order_lists, table
from tessera.plans.positional import ORDERS, _orders

c = F.col


def equi_join(spark, sf):
    o, cu = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(cu, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_custkey", cents("c_acctbal").alias("bal"))


def intersect_dups(spark, sf):
    """Position pairs of equal keys: runs of duplicates give their cross product."""
    a = _orders(spark, sf).select("pos", c("o_custkey").alias("k"))
    b = _orders(spark, sf).select("pos", c("o_custkey").alias("k"))
    return R.equi_positions(a, b, "k")


def intersect_lists(spark, sf):
    """Positions of quantities that equal a discount in the same order's other list."""
    x = order_lists(spark, sf).select("ok", A.intersect_sorted(c("b"), F.transform("b", lambda v: v + 1)).alias("m"))
    return x.select("ok", F.explode("m").alias("m")).select("ok", c("m.i").alias("i"), c("m.j").alias("j"))


def xprod_per_order(spark, sf):
    x = order_lists(spark, sf).select("ok", F.explode(A.xprod(c("a"), c("b"))).alias("p"))
    return x.groupBy("ok").agg(F.count("*").alias("pairs"), F.sum(c("p._0") * c("p._1")).alias("dot"))


def group_join(spark, sf):
    """Each customer with the sum over its orders' list (empty lists stay)."""
    probes = table(spark, sf, "customer").select(c("c_custkey").alias("k"))
    build = table(spark, sf, "orders").select(c("o_custkey").alias("k"), "o_orderkey")
    x = R.group_join(probes, build, "k", c("o_orderkey"), [c("o_orderkey")])
    return x.select("k", F.size("matches").cast("bigint").alias("n"), F.array_join("matches", ",").alias("orders"))


def semi_anti(spark, sf):
    cu, o = table(spark, sf, "customer").select(c("c_custkey").alias("k")), table(spark, sf, "orders").select(c("o_custkey").alias("k"))
    return R.semi(cu, o, "k").withColumn("side", F.lit("semi")).union(R.anti(cu, o, "k").withColumn("side", F.lit("anti")))


def group_lists(spark, sf):
    x = R.group_lists(lines(spark, sf), ["sk"], c("qty"), [c(k) for k in LINE_ORDER])
    return x.select("sk", F.size("values").cast("bigint").alias("n"), F.array_join("values", ",").alias("l"))


def group_composite(spark, sf):
    x = R.group_lists(lines(spark, sf), ["flag", "status"], c("qty"), [c(k) for k in LINE_ORDER])
    return x.select("flag", "status", F.array_join("values", ",").alias("l"))


def group_per_row(spark, sf):
    pairs = F.transform("b", lambda v, i: F.struct((v % 3).alias("k"), i.cast("bigint").alias("v")))
    x = order_lists(spark, sf).select("ok", F.explode(A.group(pairs)).alias("g"))
    return x.select("ok", c("g.k").alias("k"), F.array_join("g.vs", ",").alias("vs"))


def reduce_family(spark, sf):
    """Flat and list forms of the reductions side by side."""
    b = c("b")
    return order_lists(spark, sf).select("ok", A.fold_add(b).alias("sum_"), A.fold_mul(F.transform(b, lambda x: x % 3 + 1)).alias("mul_"), A.fold_min(b).alias("min_"), A.fold_max(b).alias("max_"), A.all_of(b, lambda x: x > 3).alias("all_"), A.any_of(b, lambda x: x > 48).alias("any_"))


def unique(spark, sf):
    return lines(spark, sf).select("flag", "status", "disc").distinct()


def dedup_per_row(spark, sf):
    return order_lists(spark, sf).select("ok", F.array_join(F.array_sort(F.array_distinct(F.transform("b", lambda x: x % 5))), ",").alias("u"))


def uniq_counts(spark, sf):
    return R.counts(lines(spark, sf), "qty", "disc")


def multi_agg(spark, sf):
    return lines(spark, sf).groupBy("pk").agg(F.count("*").alias("n"), F.sum("qty").alias("s"), F.max("price").alias("m"))


QUERIES = {f.__name__: f for f in (equi_join, intersect_dups, intersect_lists, xprod_per_order, group_join, semi_anti, group_lists, group_composite, group_per_row, reduce_family, unique, dedup_per_row, uniq_counts, multi_agg)}
_o = "order by ok, ln, pk, sk, qty, price, disc"
ORACLE = {
    "equi_join": "select o_orderkey, c_custkey, round(c_acctbal * 100)::bigint bal from orders join customer on o_custkey = c_custkey",
    "intersect_dups": f"select a.o_custkey k, a.pos pos_a, b.pos pos_b from {ORDERS} a join {ORDERS} b on a.o_custkey = b.o_custkey",
    "intersect_lists": f"with n as (select ok, qty, row_number() over (partition by ok {_o}) - 1 p from {LINES}) select a.ok, a.p i, b.p j from n a join n b on a.ok = b.ok and a.qty = b.qty + 1",
    "xprod_per_order": f"select a.ok, count(*) pairs, sum(a.pk * b.qty)::bigint dot from {LINES} a join {LINES} b on a.ok = b.ok group by a.ok",
    "group_join": "select c_custkey k, count(o_orderkey) n, coalesce(string_agg(o_orderkey, ',' order by o_orderkey), '') orders from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "semi_anti": "select c_custkey k, case when c_custkey in (select o_custkey from orders) then 'semi' else 'anti' end side from customer",
    "group_lists": f"select sk, count(*) n, string_agg(qty, ',' {_o}) l from {LINES} group by sk",
    "group_composite": f"select flag, status, string_agg(qty, ',' {_o}) l from {LINES} group by flag, status",
    "group_per_row": f"select ok, qty % 3 k, string_agg(p, ',' order by p) vs from (select ok, qty, row_number() over (partition by ok {_o}) - 1 p from {LINES}) group by ok, qty % 3",
    "reduce_family": f"select ok, sum(qty)::bigint sum_, product(qty % 3 + 1)::bigint mul_, min(qty) min_, max(qty) max_, bool_and(qty > 3) all_, bool_or(qty > 48) any_ from {LINES} group by ok",
    "unique": f"select distinct flag, status, disc from {LINES}",
    "dedup_per_row": f"select ok, string_agg(q, ',' order by q) u from (select distinct ok, qty % 5 q from {LINES}) group by ok",
    "uniq_counts": f"select qty, disc, count(*) n from {LINES} group by qty, disc",
    "multi_agg": f"select pk, count(*) n, sum(qty)::bigint s, max(price) m from {LINES} group by pk",
}
