"""Order-bearing columns: positions, views, gathers, scans, sorts and searches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as A
from tessera.functions.keys import string_key, structural_key
from tessera.operators import seq
from tessera.operators.relational import segmented_running, segmented_shift
from tessera.plans.common import LINE_ORDER, LINES, ORDER_LISTS, cents, lines, order_lists, table

c = F.col


def _orders(spark, sf):
    """Orders with their place by (custkey, orderkey)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("v"))
    return seq.with_position(o, c("o_custkey"), c("o_orderkey"))


ORDERS = "(select o_orderkey, o_custkey, round(o_totalprice * 100)::bigint v, row_number() over (order by o_custkey, o_orderkey) - 1 pos from orders)"


def _n_orders(spark, sf):
    return table(spark, sf, "orders").count()


def iota_join(spark, sf):
    n = seq.iota(spark, _n_orders(spark, sf)).withColumnRenamed("pos", "n")
    return n.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c("n") == c("o_orderkey"), "left").select("n", "o_custkey")


def spread(spark, sf):
    return seq.spread(table(spark, sf, "part").select("p_partkey", c("p_size").alias("s")), c("s") % 4).groupBy("s").agg(F.count("*").alias("rows"), F.sum(c("copy").cast("bigint")).alias("copies"))


def cat_union(spark, sf):
    a = seq.with_position(table(spark, sf, "customer").select(c("c_custkey").alias("k")), c("k"))
    b = seq.with_position(table(spark, sf, "supplier").select(c("s_suppkey").alias("k")), c("k"))
    return seq.cat(a, b).select("pos", "k")


def where_positions(spark, sf):
    return seq.where_positions(_orders(spark, sf), c("v") % 7 == 0)


def filter_rows(spark, sf):
    return lines(spark, sf).where((c("qty") >= 30) & (c("disc") < 5)).groupBy("flag").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


def seg_filter(spark, sf):
    kept = A.filter_by(c("b"), F.transform("b", lambda x: x > 20))
    return order_lists(spark, sf).select("ok", F.size(kept).cast("bigint").alias("n"), A.fold_add(kept).alias("total"))


def list_positions(spark, sf):
    return order_lists(spark, sf).select("ok", F.explode(A.positions(F.transform("b", lambda x: x > 20))).alias("at"))


def gather(spark, sf):
    """Every tenth position, then the rows there."""
    at = seq.iota(spark, -(-_n_orders(spark, sf) // 10)).select((c("pos") * 10).alias("at"))
    return seq.gather(at, _orders(spark, sf)).select("at", "o_orderkey", "v")


def gather_chain(spark, sf):
    """A gather of a gather is one gather by composed positions."""
    n = _n_orders(spark, sf)
    first = seq.iota(spark, -(-n // 3)).select("pos", (c("pos") * 3).alias("at"))
    second = seq.iota(spark, -(-n // 6)).select((c("pos") * 2).alias("at"))
    composed = second.join(first.withColumnRenamed("at", "inner"), second["at"] == first["pos"]).select("pos", c("inner").alias("at"))
    return seq.gather(composed, _orders(spark, sf)).select("at", "o_orderkey")


def gather_oob(spark, sf):
    """Positions up to a tenth beyond the end: those are marked, not failed."""
    at = seq.iota(spark, -(-_n_orders(spark, sf) // 10)).select((c("pos") * 11).alias("at"))
    return seq.gather_try(at, _orders(spark, sf)).select("at", "found", "o_orderkey")


def take_skip_reverse(spark, sf):
    return seq.take(seq.skip(seq.reverse(_orders(spark, sf)), 5), 40).select("pos", "o_orderkey")


def seg_take_reverse(spark, sf):
    return order_lists(spark, sf).select("ok", F.posexplode(F.slice(F.reverse("a"), 1, 2)).alias("at", "pk")).select("ok", c("at").cast("bigint").alias("at"), "pk")


def view_range(spark, sf):
    return seq.view_range(_orders(spark, sf), 100, 250).select("pos", "o_orderkey")


def cumsum(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", cents("o_totalprice").alias("v"))
    return seq.running(o, c("v"), c("o_orderkey")).select("o_orderkey", "running")


def cumsum_per_row(spark, sf):
    x = segmented_running(lines(spark, sf), c("qty"), ["ok"], [c(k) for k in LINE_ORDER])
    return x.groupBy("ok").agg(F.sum("running").alias("s"), F.max("running").alias("last"))


def shift(spark, sf):
    return seq.shift(_orders(spark, sf), "v", 2).select("pos", "shifted")


def shift_per_row(spark, sf):
    x = segmented_shift(lines(spark, sf), c("qty"), 1, ["ok"], [c(k) for k in LINE_ORDER])
    return x.groupBy("ok").agg(F.sum("shifted").alias("s"))


def runmax(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", cents("o_totalprice").alias("v"))
    return seq.running(o, c("v"), c("o_orderkey"), how="max").select("o_orderkey", "running")


def sessionize(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return seq.sessions(e, c("us"), 6 * 3600 * 1_000_000, by=["user_id"], order=[c("us"), c("event_id")]).select("event_id", "user_id", "session")


def sort_perm(spark, sf):
    return seq.with_position(_orders(spark, sf), c("v"), c("pos"), name="rank").select("rank", "pos")


def sort_rank_structural(spark, sf):
    """Orders' part lists in structural order: shorter lists first."""
    lists = order_lists(spark, sf)
    key = structural_key(c("a"), T.ArrayType(T.LongType()))
    return seq.with_position(lists.select("ok", key.alias("k")), c("k"), c("ok"), name="place").select("ok", "place")


def sort_lists_length_first(spark, sf):
    """Distinct per-supplier discount lists of small orders, in structural order."""
    lists = order_lists(spark, sf).select(F.transform("b", lambda x: x % 3).alias("l")).distinct()
    key = structural_key(c("l"), T.ArrayType(T.LongType()))
    return seq.with_position(lists.select("l", key.alias("k")), c("k"), name="place").select("place", F.array_join("l", ",").alias("l"))


def sort_strings_length_first(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return seq.with_position(names.withColumn("k", string_key(c("p_name"))), c("k"), name="place").select("place", "p_name")


def sort_segments(spark, sf):
    return order_lists(spark, sf).select("ok", F.posexplode(F.array_sort("a")).alias("at", "pk")).select("ok", c("at").cast("bigint").alias("at"), "pk")


def topk_per_group(spark, sf):
    return seq.top_per_group(lines(spark, sf).select("sk", "price", "ok", "ln", "pk").distinct(), 3, ["sk"], [F.desc("price"), c("ok"), c("ln"), c("pk")]).select("sk", "rank", "price")


def top_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cents("o_totalprice").alias("v")).orderBy(F.desc("v"), "o_orderkey").limit(100)


def search_lower_bound(spark, sf):
    q = table(spark, sf, "part").select("p_partkey", (c("p_size").cast("bigint") * 37).alias("k"))
    return seq.lower_bound(q, lines(spark, sf).select(c("pk").alias("k")), "k").select("p_partkey", "at")


def find_equal_range(spark, sf):
    q = table(spark, sf, "part").select(c("p_partkey").alias("k"))
    return seq.equal_range(q, lines(spark, sf).select(c("pk").alias("k")), "k")


QUERIES = {f.__name__: f for f in (iota_join, spread, cat_union, where_positions, filter_rows, seg_filter, list_positions, gather, gather_chain, gather_oob, take_skip_reverse, seg_take_reverse, view_range, cumsum, cumsum_per_row, shift, shift_per_row, runmax, sessionize, sort_perm, sort_rank_structural, sort_lists_length_first, sort_strings_length_first, sort_segments, topk_per_group, top_n, search_lower_bound, find_equal_range)}
_over = "partition by ok order by ln, pk, sk, qty, price, disc"
ORACLE = {
    "iota_join": "select n, o_custkey from (select unnest(range((select count(*) from orders))) n) left join orders on o_orderkey = n",
    "spread": "select s, count(*) \"rows\", sum(copy)::bigint copies from (select p_size s, unnest(range(0, p_size % 4)) copy from part) group by s",
    "cat_union": "select row_number() over (order by src, k) - 1 pos, k from (select 0 src, c_custkey k from customer union all select 1, s_suppkey from supplier)",
    "where_positions": f"select pos from {ORDERS} where v % 7 = 0",
    "filter_rows": f"select flag, count(*) n, sum(price)::bigint price from {LINES} where qty >= 30 and disc < 5 group by flag",
    "seg_filter": f"select ok, count(*) filter (qty > 20) n, coalesce(sum(qty) filter (qty > 20), 0)::bigint total from {LINES} group by ok",
    "list_positions": f"select ok, rn \"at\" from (select ok, qty, row_number() over ({_over}) - 1 rn from {LINES}) where qty > 20",
    "gather": f"select pos \"at\", o_orderkey, v from {ORDERS} where pos % 10 = 0",
    "gather_chain": f"select pos \"at\", o_orderkey from {ORDERS} where pos % 6 = 0",
    "gather_oob": f"select n * 11 \"at\", o_orderkey is not null found, o_orderkey from (select unnest(range((select (count(*) + 9) // 10 from orders))) n) left join {ORDERS} on pos = n * 11",
    "take_skip_reverse": f"select rp - 5 pos, o_orderkey from (select *, (select count(*) from orders) - 1 - pos rp from {ORDERS}) where rp between 5 and 44",
    "seg_take_reverse": f"select ok, rn \"at\", pk from (select ok, pk, row_number() over (partition by ok order by ln desc, pk desc, sk desc, qty desc, price desc, disc desc) - 1 rn from {LINES}) where rn < 2",
    "view_range": f"select pos, o_orderkey from {ORDERS} where pos >= 100 and pos < 250",
    "cumsum": "select o_orderkey, sum(round(o_totalprice * 100)::bigint) over (order by o_orderkey rows unbounded preceding)::bigint running from orders",
    "cumsum_per_row": f"select ok, sum(r)::bigint s, max(r)::bigint \"last\" from (select ok, sum(qty) over ({_over} rows unbounded preceding) r from {LINES}) group by ok",
    "shift": f"select pos, lag(v, 2, 0) over (order by pos) shifted from {ORDERS}",
    "shift_per_row": f"select ok, sum(r)::bigint s from (select ok, lag(qty, 1, 0) over ({_over}) r from {LINES}) group by ok",
    "runmax": "select o_orderkey, max(round(o_totalprice * 100)::bigint) over (order by o_orderkey rows unbounded preceding) running from orders",
    "sessionize": "select event_id, user_id, sum((us - prev > 21600000000)::bigint) over (partition by user_id order by us, event_id rows unbounded preceding)::bigint session from (select *, lag(us, 1, 0) over (partition by user_id order by us, event_id) prev from (select event_id, user_id, epoch_us(ts) us from events))",
    "sort_perm": f"select row_number() over (order by v, pos) - 1 \"rank\", pos from {ORDERS}",
    "sort_rank_structural": f"select ok, row_number() over (order by len(a), a, ok) - 1 place from {ORDER_LISTS}",
    "sort_lists_length_first": f"select row_number() over (order by len(l), l) - 1 place, array_to_string(l, ',') l from (select distinct list_transform(b, lambda x: x % 3) l from {ORDER_LISTS})",
    "sort_strings_length_first": "select row_number() over (order by strlen(p_name), encode(p_name)) - 1 place, p_name from (select distinct p_name from part)",
    "sort_segments": f"select ok, row_number() over (partition by ok order by pk) - 1 \"at\", pk from {LINES}",
    "topk_per_group": f"select sk, r \"rank\", price from (select sk, price, row_number() over (partition by sk order by price desc, ok, ln, pk) r from (select distinct sk, price, ok, ln, pk from {LINES})) where r <= 3",
    "top_n": "select o_orderkey, round(o_totalprice * 100)::bigint v from orders order by v desc, o_orderkey limit 100",
    "search_lower_bound": f"with t as (select pk k, count(*) n from {LINES} group by pk), q as (select distinct p_size::bigint * 37 k from part), r as (select q.k, coalesce(sum(n), 0)::bigint \"at\" from q left join t on t.k < q.k group by q.k) select p_partkey, \"at\" from part join r on r.k = p_size::bigint * 37",
    "find_equal_range": f"with t as (select pk k, count(*) n from {LINES} group by pk), s as (select k, sum(n) over (order by k)::bigint hi, n from t) select p_partkey k, coalesce(hi - n, (select coalesce(sum(n), 0) from t where t.k < p_partkey))::bigint lo, coalesce(hi, (select coalesce(sum(n), 0) from t where t.k < p_partkey))::bigint hi from part left join s on s.k = p_partkey",
}
