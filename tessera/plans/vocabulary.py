"""Words, scans, readers and histograms that no other family's query uses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import puzzle
from tessera.operators.materialise import checkpoint_folder
from tessera.plans.common import GRAPH, ORDER_LISTS, order_lists, part_graph, table
from tessera.plans.positional import ORDERS
from tessera.plans.program import Builder, Program
from tessera.plans.programs import _stacked
from tessera.sources import readers

c = F.col

#: Over orders in (customer, order) order: their columns cust and cents.
STACKS = {
    "stack_signed": "cents neg.i64 abs.i64  cust square.i64  cents 10000000i64 20000000i64 clamp.i64  entuple3",
    "stack_logic": "cust 2u64 %.u64 1u64 =  cust 3u64 %.u64 0u64 =  and  cust 5u64 < not  or",
    "stack_shuffle": "def twice { dup +.i64 }  cents cust over +.i64 swap drop dup cust rot drop swap -.i64 twice  cust pick 1 roll 1 drop +.i64",
    "stack_keys": "cents cust 5u64 mod.u64 group swap drop bounds>keys",
    "stack_bounds": "cents cust 5u64 mod.u64 group swap drop list>bounds",
    "stack_merge": "cents cust 3u64 mod.u64 partition3 :[l0 l1 l2]  cust 3u64 mod.u64  l0 1u64 +.u64  l1 2u64 *.u64  l2  merge3",
    "stack_search_lists": "cents cust group sort.segmented swap drop :l  l  l 100u64 +.u64  search  reduce.+.u64",
    "stack_swizzle": "cents neg.i64 as.f64 enswizzle.f64 sort deswizzle.f64 as.i64 enswizzle.i64 deswizzle.i64",
    "stack_view": "cents  cust 7u64 %.u64 3u64 = where  view decompose-view swap drop",
}
RELATIONS = "let n = input and 7 in (n eq 3, n ne 3, n lt 3, n le 3)"
NEGATED = "let n = input and 7 in (n neg, (n unit, n) .1)"
TRIED = "enum G = Oob | Found in let xs = input and 7 iota map (x -> x mul 3) in (input and 15 iota, xs) gather_try map (s -> s match (Oob (o -> o lit 1000), Found (v -> v))) fold_add"


def _fields(source, names):
    def query(spark, sf):
        program = source() if callable(source) else Program(source)
        out = program.apply(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
        if not names:
            return out.select("o_orderkey", "result")
        return out.select("o_orderkey", *(c(f"result._{k}").cast("bigint").alias(n) for k, n in enumerate(names)))

    return query


def _built():
    b = Builder()
    low = b.add("and", b.input, number=15)
    square = b.add("mul", low, low)
    return b.program(b.tuple(square, b.add("add", square, low), b.add("gt", square, number=40)))


def list_prefixes(spark, sf):
    """Every inclusive prefix of the lists: products (of one to three), least, greatest, all and any."""
    b = c("b")
    few = F.transform(b, lambda x: x % 3 + 1)
    even = F.transform(b, lambda x: x % 2 == 0)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("bigint")), ",")
    return order_lists(spark, sf).select("ok", text(A.scan_mul(few)).alias("mul_"), text(A.scan_min(b)).alias("min_"), text(A.scan_max(b)).alias("max_"), text(A.scan_all(even)).alias("all_"), text(A.scan_any(even)).alias("any_"))


def _folder(spark):
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def edges_text(spark, sf):
    """The part graph written as lines of an edge list, and read from it."""
    path = _folder(spark)
    part_graph(spark, sf).select(F.concat_ws(" ", "src", "dst", F.lit("1"), c("src") + c("dst")).alias("value")).write.text(path)
    return readers.edge_list(spark, path)


def knows_dates(spark, sf):
    """Orders written as a barred table with dates, and read from it."""
    path = _folder(spark)
    day = F.concat(F.date_format(c("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    table(spark, sf, "orders").select(c("o_custkey").alias("from"), c("o_orderkey").alias("to"), day.alias("date")).write.option("header", True).option("sep", "|").csv(path)
    return readers.knows(spark, path)


def nested_round_trip(spark, sf):
    """Lists written and read as nested columns."""
    path = _folder(spark)
    readers.save(order_lists(spark, sf), path)
    return readers.load(spark, path).select("ok", F.size("a").cast("bigint").alias("n"), F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"))


def sudoku_histogram(spark, sf):
    """Candidates left by one clue: its row, column and box lose a value."""
    left = puzzle.propagate(puzzle.board(spark, "." * 40 + "5" + "." * 40))
    return puzzle.histogram(left)


QUERIES = {
    **{n: _stacked(s) for n, s in STACKS.items()},
    "program_relations": _fields(RELATIONS, ("eq_", "ne_", "lt_", "le_")), "program_negated": _fields(NEGATED, ("neg_", "same")), "program_tried": _fields(TRIED, ()), "program_built": _fields(_built, ("square", "more", "big")),
    **{f.__name__: f for f in (list_prefixes, edges_text, knows_dates, nested_round_trip, sudoku_histogram)},
}
_classes = f"(select dense_rank() over (order by o_custkey % 5) - 1 k, pos, v from {ORDERS})"
_prefix = lambda f: f"array_to_string(list_transform(range(1, len(b) + 1), lambda i: {f}), ',')"
ORACLE = {
    "stack_signed": f"select pos, v _0, o_custkey * o_custkey _1, greatest(10000000, least(20000000, v))::bigint _2 from {ORDERS}",
    "stack_logic": f"select pos, ((o_custkey % 2 = 1 and o_custkey % 3 = 0) or not o_custkey < 5)::bigint v from {ORDERS}",
    "stack_shuffle": f"select pos, -4 * v v from {ORDERS}",
    "stack_keys": f"select row_number() over (order by k, pos) - 1 pos, k v from {_classes}",
    "stack_bounds": f"select 0::bigint pos, 0::bigint v union all select k + 1 pos, sum(count(*)) over (order by k)::bigint v from {_classes} group by k",
    "stack_merge": f"select pos, case o_custkey % 3 when 0 then v + 1 when 1 then v * 2 else v end v from {ORDERS}",
    "stack_search_lists": f"select dense_rank() over (order by k) - 1 pos, n::bigint v from (select a.o_custkey k, count(*) filter (b.v < a.v + 100) n from {ORDERS} a join {ORDERS} b on a.o_custkey = b.o_custkey group by k)",
    "stack_swizzle": f"select row_number() over (order by -v) - 1 pos, -v v from {ORDERS}",
    "stack_view": f"select row_number() over (order by pos) - 1 pos, pos v from {ORDERS} where o_custkey % 7 = 3",
    "program_relations": "select o_orderkey, (n = 3)::bigint eq_, (n <> 3)::bigint ne_, (n < 3)::bigint lt_, (n <= 3)::bigint le_ from (select o_orderkey, o_orderkey & 7 n from orders)",
    "program_negated": "select o_orderkey, -(o_orderkey & 7) neg_, o_orderkey & 7 same from orders",
    "program_tried": "select o_orderkey, coalesce(list_sum(list_transform(range(o_orderkey & 15), lambda i: case when i < (o_orderkey & 7) then i * 3 else 1000 end)), 0)::bigint result from orders",
    "program_built": "select o_orderkey, n * n square, n * n + n more, (n * n > 40)::bigint big from (select o_orderkey, o_orderkey & 15 n from orders)",
    "list_prefixes": f"select ok, {_prefix('list_product(list_transform(b[1:i], lambda x: x % 3 + 1))::bigint')} mul_, {_prefix('list_min(b[1:i])')} min_, {_prefix('list_max(b[1:i])')} max_, {_prefix('list_bool_and(list_transform(b[1:i], lambda x: x % 2 = 0))::bigint')} all_, {_prefix('list_bool_or(list_transform(b[1:i], lambda x: x % 2 = 0))::bigint')} any_ from {ORDER_LISTS}",
    "edges_text": f"select src, dst, src + dst as time from {GRAPH}",
    "knows_dates": "select o_custkey src, o_orderkey dst, epoch_ms(o_orderdate::date::timestamp) ts_ms from orders",
    "nested_round_trip": f"select ok, len(a) n, array_to_string(a, ',') a, array_to_string(b, ',') b from {ORDER_LISTS}",
    "sudoku_histogram": "select candidates, count(*) cells from (select case when i = 40 then 1 when i // 9 = 4 or i % 9 = 4 or (i // 27 = 1 and i % 9 // 3 = 1) then 8 else 9 end::bigint candidates from range(81) t(i)) group by candidates",
}
