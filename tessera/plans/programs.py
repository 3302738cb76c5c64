"""Programs in text form, applied to a column of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import seq
from tessera.plans import stack
from tessera.plans.common import cents, table
from tessera.plans.positional import ORDERS
from tessera.plans.program import Program

c = F.col

SQUARES = "let xs = input and 15 iota in xs map (x -> (x, x) mul) fold_add"
CLASSES = "enum Kind = Small | Large in input and 63 iota map (x -> (x, x gt 40) branch Kind match (Small (s -> s), Large (l -> l mul 100))) fold_add"
PICK = "let xs = input and 7 iota map (x -> x mul 3) in (input shr 3 and 7, xs) get"
PAIRS = "let n = input and 3 iota in (n, n map (x -> x add 1)) zip transpose .1 fold_mul"
REPEATS = "let xs = input and 31 iota map (x -> (x, x) mul and 7) sort in (xs len, xs dedup len) sub"
RUNNING = "let xs = input and 15 iota in ((xs lit 0, xs) foldscan ((a, x) -> ((a, x) add, (a, x) mul))) .1 fold_add"
WORDS = 'let ws = input "b aa b c aa b" split " " in (ws dedup len, ws len)'
RESCUE = "enum T = Ok | No in let xs = input and 7 iota in (input and 15, xs) get try match (Ok (v -> v add 1), No (n -> n lit 0))"


def _applied(source):
    def query(spark, sf):
        out = Program(source).apply(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
        return out.select("o_orderkey", "result", "err")

    return query


def program_words(spark, sf):
    out = Program(WORDS).apply(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", c("result._0").alias("different"), c("result._1").alias("all_"))


#: Over orders in (customer, order) order: their columns cust and cents.
STACK_CLASSES = "cents cust 5u64 mod.u64 group :[class held]  class  held count  held reduce.min.u64  held reduce.+.u64  entuple.4"
STACK_PREFIX = "cents 2u64 mod.u64 cumsum.u64 1u64 shift.u64"
STACK_LOWEST = "cents cust 11u64 mod.u64 group sort.segmented 2u64 take.segmented reduce.+.u64 swap drop"
STACK_SEARCH = "cust sort  cust 3u64 +.u64  search"
STACK_MATCH = "cents cust 3u64 mod.u64 branch.3 match { -> 2u64 *.u64 -> 1u64 +.u64 -> }"


def _stacked(source):
    def query(spark, sf):
        rows = table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("cust"), cents("o_totalprice").alias("cents"))
        df = stack.run(spark, source, seq.with_position(rows, c("cust"), c("o_orderkey")).select("pos", "cust", "cents"))[-1]
        fields = df.schema["v"].dataType
        return df.select("pos", "v.*") if hasattr(fields, "fields") else df.select("pos", c("v").cast("bigint").alias("v"))

    return query


QUERIES = {f"program_{n}": _applied(s) for n, s in (("squares", SQUARES), ("classes", CLASSES), ("pick", PICK), ("pairs", PAIRS), ("repeats", REPEATS), ("running", RUNNING), ("rescue", RESCUE))} | {"program_words": program_words} | {f"stack_{n}": _stacked(s) for n, s in (("classes", STACK_CLASSES), ("prefix", STACK_PREFIX), ("lowest", STACK_LOWEST), ("search", STACK_SEARCH), ("match", STACK_MATCH))}
_k = "from (select o_orderkey, o_orderkey & 15 k15, o_orderkey & 7 k7, o_orderkey & 63 k63, o_orderkey & 31 k31, o_orderkey & 3 k3, (o_orderkey >> 3) & 7 s from orders)"
ORACLE = {
    "program_squares": f"select o_orderkey, ((k15 - 1) * k15 * (2 * k15 - 1) // 6)::bigint result, false err {_k}",
    "program_classes": f"select o_orderkey, coalesce(list_sum(list_transform(range(k63), lambda x: case when x > 40 then x * 100 else x end)), 0)::bigint result, false err {_k}",
    "program_pick": f"select o_orderkey, case when s < k7 then s * 3 end result, s >= k7 err {_k}",
    "program_pairs": f"select o_orderkey, case k3 when 3 then 6 when 2 then 2 else 1 end::bigint result, false err {_k}",
    "program_repeats": f"select o_orderkey, k31 - least(k31, 3) result, false err {_k}",
    "program_running": f"select o_orderkey, coalesce(list_sum(list_transform(range(k15), lambda x: x * (x * (x - 1) // 2))), 0)::bigint result, false err {_k}",
    "program_rescue": f"select o_orderkey, case when k15 < k7 then k15 + 1 else 0 end result, false err {_k}",
    "stack_classes": f"select k pos, k _0, count(*) _1, min(v) _2, sum(v)::bigint _3 from (select dense_rank() over (order by o_custkey % 5) - 1 k, v from {ORDERS}) group by k",
    "stack_prefix": f"select pos, coalesce(sum(v % 2) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint v from {ORDERS}",
    "stack_lowest": f"select row_number() over (order by k) - 1 pos, sum(v)::bigint v from (select o_custkey % 11 k, v, row_number() over (partition by o_custkey % 11 order by v) r from {ORDERS}) where r <= 2 group by k",
    "stack_search": f"with n as (select o_custkey k, count(*) n from orders group by all), q as (select distinct o_custkey + 3 k from orders), f as (select q.k, sum(coalesce(n.n, 0)) v from q left join n on n.k < q.k group by all) select pos, f.v::bigint v from {ORDERS} join f on f.k = o_custkey + 3",
    "stack_match": f"select pos, case o_custkey % 3 when 0 then v * 2 when 1 then v + 1 else v end v from {ORDERS}",
    "program_words": "select o_orderkey, 3::bigint different, 6::bigint all_ from orders",
}
