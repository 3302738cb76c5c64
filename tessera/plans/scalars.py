"""Arithmetic, comparison, conversion, encodings and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.plans.common import LINES, cents, lines, table

c = F.col


def arith_grid(spark, sf):
    x = lines(spark, sf)
    sums = {"add": c("price") + c("qty"), "sub": c("qty") - c("price"), "mul": c("qty") * c("disc"), "quo": S.truncating_div(c("qty") - c("price"), c("ln")), "rem": (c("qty") - c("price")) % c("ln"), "neg": -c("price"), "abs_": F.abs(c("qty") - c("price")), "sq": S.square(c("qty"))}
    return x.groupBy("flag").agg(*(F.sum(v).alias(k) for k, v in sums.items()))


def shift_mask(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", S.shift_right(k, 3).alias("shr3"), S.low_bits(k, 4).alias("and15"))


def lane_minmax(spark, sf):
    return lines(spark, sf).groupBy("status").agg(F.sum(F.least("qty", "disc")).alias("lo"), F.sum(F.greatest("qty", "disc")).alias("hi"))


def select_blend(spark, sf):
    return lines(spark, sf).groupBy("flag").agg(F.sum(S.blend(c("qty") % 2, c("price"), c("disc"))).alias("blended"))


def clamp(spark, sf):
    return lines(spark, sf).groupBy("flag").agg(F.sum(S.clamp(c("qty"), F.lit(10), F.lit(40))).alias("clamped"))


def compare_all(spark, sf):
    a, b = c("qty"), c("disc")
    n = lambda m: F.sum(m.cast("bigint"))
    tests = {"lt": a < b, "le": a <= b, "eq": a == b, "ne": a != b, "ge": a >= b, "gt": a > b, "not_lt": ~(a < b), "and_": (a > 10) & (b > 5), "or_": (a > 40) | (b > 9)}
    return lines(spark, sf).groupBy("status").agg(*(n(m).alias(k) for k, m in tests.items()))


def any_all(spark, sf):
    return lines(spark, sf).groupBy("ok").agg(F.bool_or(c("qty") > 45).alias("any_"), F.bool_and(c("qty") > 5).alias("all_"))


def cast_widths(spark, sf):
    k = c("o_orderkey") * 1103515245
    return table(spark, sf, "orders").select("o_orderkey", *(S.as_width(k, w).alias(f"w{w}") for w in (8, 16, 32)), k.cast("double").alias("d"), cents("o_totalprice").alias("cents"))


def order_encode_i64(spark, sf):
    v = cents("s_acctbal")
    code = S.enswizzle(v)
    return table(spark, sf, "supplier").select("s_suppkey", code.alias("code"), S.deswizzle(code).alias("back"), v.alias("v"))


def unsigned_order(spark, sf):
    """Rows in unsigned order of a signed column: negatives come after all others."""
    from tessera.operators.seq import with_position

    v = table(spark, sf, "supplier").select("s_suppkey", cents("s_acctbal").alias("v"))
    return with_position(v, S.unsigned_key(c("v")), c("s_suppkey"), name="place")


def wrap_arith(spark, sf):
    with S.wrapping(spark):
        k = c("o_orderkey") * F.lit(6364136223846793005) + F.lit(1442695040888963407)
        return table(spark, sf, "orders").select("o_orderkey", k.alias("mixed"))


def ieee_division(spark, sf):
    q = S.ieee_div(c("l_quantity") - 25, c("l_linenumber") - 3)
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("finite")
    return table(spark, sf, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def float_order(spark, sf):
    """Account balances by the total-order key of their bits."""
    from tessera.operators.seq import with_position

    v = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return with_position(v, S.float_bits(c("c_acctbal")), c("c_custkey"), name="place").select("c_custkey", "place")


def tuple_project(spark, sf):
    s = F.struct(c("p_partkey").alias("_0"), F.struct(c("p_size").cast("bigint").alias("_0"), cents("p_retailprice").alias("_1")).alias("_1"))
    return table(spark, sf, "part").select(s.alias("t")).select(c("t._0").alias("id"), c("t._1._0").alias("size"), c("t._1._1").alias("price"))


def cleave(spark, sf):
    x = c("p_size").cast("bigint")
    return table(spark, sf, "part").select("p_partkey", (x + 1).alias("inc"), (x * x).alias("sq"), (x % 7).alias("m7"))


QUERIES = {f.__name__: f for f in (arith_grid, shift_mask, lane_minmax, select_blend, clamp, compare_all, any_all, cast_widths, order_encode_i64, unsigned_order, wrap_arith, ieee_division, float_order, tuple_project, cleave)}
_rows = lambda *names: ", ".join(f"sum({e})::bigint {n}" for n, e in names)
ORACLE = {
    "arith_grid": f"select flag, {_rows(('add', 'price + qty'), ('sub', 'qty - price'), ('mul', 'qty * disc'), ('quo', '(qty - price) // ln'), ('rem', '(qty - price) % ln'), ('neg', '-price'), ('abs_', 'abs(qty - price)'), ('sq', 'qty * qty'))} from {LINES} group by flag",
    "shift_mask": "select o_orderkey, o_orderkey >> 3 shr3, o_orderkey & 15 and15 from orders",
    "lane_minmax": f"select status, sum(least(qty, disc))::bigint lo, sum(greatest(qty, disc))::bigint hi from {LINES} group by status",
    "select_blend": f"select flag, sum(case when qty % 2 <> 0 then price else disc end)::bigint blended from {LINES} group by flag",
    "clamp": f"select flag, sum(greatest(10, least(40, qty)))::bigint clamped from {LINES} group by flag",
    "compare_all": f"select status, {_rows(*((n, f'({e})::int') for n, e in (('lt', 'qty < disc'), ('le', 'qty <= disc'), ('eq', 'qty = disc'), ('ne', 'qty <> disc'), ('ge', 'qty >= disc'), ('gt', 'qty > disc'), ('not_lt', 'not qty < disc'), ('and_', 'qty > 10 and disc > 5'), ('or_', 'qty > 40 or disc > 9'))))} from {LINES} group by status",
    "any_all": f"select ok, bool_or(qty > 45) any_, bool_and(qty > 5) all_ from {LINES} group by ok",
    "cast_widths": "select o_orderkey, k & 255 w8, k & 65535 w16, k & 4294967295 w32, k::double d, round(o_totalprice * 100)::bigint cents from (select *, o_orderkey * 1103515245 k from orders)",
    "order_encode_i64": "select s_suppkey, xor(v, (-9223372036854775807 - 1)::bigint) code, v back, v from (select s_suppkey, round(s_acctbal * 100)::bigint v from supplier)",
    "unsigned_order": "select s_suppkey, v, row_number() over (order by v < 0, v, s_suppkey) - 1 place from (select s_suppkey, round(s_acctbal * 100)::bigint v from supplier)",
    "wrap_arith": "select o_orderkey, (case when m >= 9223372036854775808 then m - 18446744073709551616 else m end)::bigint mixed from (select o_orderkey, (o_orderkey::hugeint * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 m from orders)",
    "ieee_division": "select case when q = 0 then case when l_quantity = 25 then 'nan' when l_quantity > 25 then 'inf' else '-inf' end else 'finite' end kind, count(*) n from (select l_quantity, l_linenumber - 3 q from lineitem) group by 1",
    "float_order": "select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 place from customer",
    "tuple_project": "select p_partkey id, p_size::bigint size, round(p_retailprice * 100)::bigint price from part",
    "cleave": "select p_partkey, p_size::bigint + 1 inc, p_size::bigint * p_size sq, p_size::bigint % 7 m7 from part",
}
