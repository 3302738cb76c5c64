"""Ragged lists: nesting, bounds, per-row higher-order operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import seq
from tessera.plans.common import LINES, order_lists, table

c = F.col


def nest_flatten(spark, sf):
    """Flatten lists to a column with positions, then nest by stride and by bounds again."""
    flat = order_lists(spark, sf).select("ok", F.posexplode("b").alias("i", "q"))
    flat = seq.with_position(flat, c("ok"), c("i"))
    rows = flat.groupBy(F.floor(c("pos") / 4).alias("row")).agg(F.array_sort(F.collect_list(F.struct("pos", "q"))).alias("l"))
    return rows.select("row", F.array_join(F.transform("l", lambda x: x["q"]), ",").alias("l"))


def nest_bounds(spark, sf):
    """Flat elements put back into their rows by bounds alone."""
    rows = order_lists(spark, sf)
    flat = seq.flatten(rows, "ok", "b").select("pos", "value")
    back = seq.nest(flat, seq.list_ranges(rows, "ok", "b"), row="ok")
    return back.select("ok", F.array_join("list", ",").alias("l"))


def bounds_ranges_keys(spark, sf):
    """Per row the (lo, hi) of its elements in the flattened column."""
    sized = order_lists(spark, sf).select("ok", F.size("b").cast("bigint").alias("n"))
    return seq.running(sized, c("n"), c("ok"), name="hi").select("ok", (c("hi") - c("n")).alias("lo"), "hi")


def count_len(spark, sf):
    return order_lists(spark, sf).select("ok", F.size("a").cast("bigint").alias("n"))


def head(spark, sf):
    return order_lists(spark, sf).select("ok", A.head(c("a")).alias("first"))


def chunk(spark, sf):
    """Chunks of two of the lists of even length."""
    x = order_lists(spark, sf).where(F.size("b") % 2 == 0).select("ok", F.posexplode(A.chunk(c("b"), 2)).alias("i", "l"))
    return x.select("ok", c("i").cast("bigint").alias("i"), F.array_join("l", ",").alias("l"))


def append(spark, sf):
    return order_lists(spark, sf).select("ok", F.array_join(A.append(c("a"), c("b")), ",").alias("l"))


def slices(spark, sf):
    ranges = F.array(F.struct(F.lit(0).alias("lo"), F.least(F.lit(2), F.size("b")).alias("hi")), F.struct(F.floor(F.size("b") / 2).alias("lo"), F.size("b").alias("hi")))
    return order_lists(spark, sf).select("ok", F.array_join(F.transform(A.slices(ranges, c("b")), lambda x: F.array_join(x, ",")), "|").alias("l"))


def cap_list(spark, sf):
    pairs = A.cap_list(c("ok"), c("b"))
    return order_lists(spark, sf).select("ok", F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s + p["_0"] * p["_1"]).alias("s"))


def zip_lists(spark, sf):
    z = A.zip_lists(c("a"), c("b"))
    return order_lists(spark, sf).select("ok", F.aggregate(z, F.lit(0).cast("bigint"), lambda s, p: s + p["_0"] * p["_1"]).alias("dot"))


def transpose(spark, sf):
    """A list of products to a product of lists and back."""
    t = A.transpose(A.zip_lists(c("a"), c("b")), ["_0", "_1"])
    back = A.zip_lists(t["_0"], t["_1"])
    return order_lists(spark, sf).select("ok", F.array_join(F.transform(back, lambda p: p["_0"] - p["_1"]), ",").alias("l"))


def list_arith(spark, sf):
    """Element-wise arithmetic of equal-length lists, and with a scalar."""
    s = F.zip_with("a", "b", lambda x, y: x * 2 + y)
    return order_lists(spark, sf).select("ok", A.fold_add(s).alias("s"), A.fold_add(F.transform("b", lambda x: x + 10)).alias("t"))


def map_nested(spark, sf):
    """A map inside a map: triangles of iota."""
    return order_lists(spark, sf).select("ok", F.aggregate(F.flatten(F.transform("b", lambda x: F.transform(A.iota(x % 4), lambda y: y * x))), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("s"))


def flatten_ranges(spark, sf):
    nested = F.transform("b", lambda x: A.iota(x % 3))
    f = A.flatten_ranges(nested)
    return order_lists(spark, sf).select("ok", F.array_join(F.transform(f["ranges"], lambda r: F.concat_ws(":", r["lo"], r["hi"])), ",").alias("ranges"), F.array_join(f["flat"], ",").alias("flat"))


def list_scans(spark, sf):
    return order_lists(spark, sf).select("ok", F.array_join(A.scan_add(c("b")), ",").alias("add_"), F.array_join(A.scan_max(c("b")), ",").alias("max_"), F.array_join(A.shift(c("b"), 1, F.lit(0).cast("bigint")), ",").alias("shifted"))


def list_find(spark, sf):
    """Equal ranges of some needles in each sorted list."""
    needles = F.array(F.lit(10).cast("bigint"), F.lit(25).cast("bigint"))
    f = A.find(needles, F.array_sort("b"))
    return order_lists(spark, sf).select("ok", f[0]["lo"].alias("lo10"), f[0]["hi"].alias("hi10"), f[1]["lo"].alias("lo25"), f[1]["hi"].alias("hi25"))


def list_gather(spark, sf):
    idx = A.iota(F.size("b").cast("bigint"))
    return order_lists(spark, sf).select("ok", F.array_join(A.gather(F.transform(idx, lambda i: F.size("b") - 1 - i), c("b")), ",").alias("l"))


def enlist(spark, sf):
    return order_lists(spark, sf).select("ok", F.size(F.flatten(F.transform("b", A.enlist))).cast("bigint").alias("n"))


def fold_stats(spark, sf):
    """One fold with a product state: count, sum and maximum of each user's amounts."""
    amount = F.round(c("value") * 100).cast("bigint")
    x = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(amount).alias("v"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"), F.lit(-(1 << 62)).alias("m"))
    f = A.fold(c("v"), zero, lambda s, v: F.struct((s["n"] + 1).alias("n"), (s["s"] + v).alias("s"), F.greatest(s["m"], v).alias("m")))
    return x.select("user_id", f.alias("f")).select("user_id", "f.n", "f.s", "f.m")


def foldscan_records(spark, sf):
    """Walk each user's amounts with the best so far as state; mark the new records."""
    amount = F.round(c("value") * 100).cast("bigint")
    x = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", amount.alias("v")))).alias("e"))
    f = A.fold_scan(F.transform("e", lambda e: e["v"]), F.lit(-(1 << 62)), lambda best, v: (F.greatest(best, v), (v > best).cast("bigint")), "bigint")
    return x.select("user_id", A.fold_add(f["out"]).alias("records"), f["state"].alias("best"))


def big_fold(spark, sf):
    """The same counts by windows, for groups too long for one row's list."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.round(c("value") * 100).cast("bigint")
    best = F.max(v).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = table(spark, sf, "events").select("user_id", v.alias("v"), (best.isNull() | (v > best)).cast("bigint").alias("new"))
    return marked.groupBy("user_id").agg(F.sum("new").alias("records"), F.max("v").alias("best"))


QUERIES = {f.__name__: f for f in (nest_flatten, nest_bounds, bounds_ranges_keys, count_len, head, chunk, append, slices, cap_list, zip_lists, transpose, list_arith, map_nested, flatten_ranges, list_scans, list_find, list_gather, enlist, fold_stats, foldscan_records, big_fold)}
_n = f"(select *, row_number() over (partition by ok order by ln, pk, sk, qty, price, disc) - 1 i, count(*) over (partition by ok) n from {LINES})"
_records = "select user_id, sum(new)::bigint records, max(v) best from (select user_id, v, (b is null or v > b)::bigint new from (select user_id, v, max(v) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) b from (select *, round(value * 100)::bigint v from events))) group by user_id"
ORACLE = {
    "nest_flatten": f"select pos // 4 \"row\", string_agg(qty, ',' order by pos) l from (select qty, row_number() over (order by ok, i) - 1 pos from {_n}) group by 1",
    "nest_bounds": f"select ok, string_agg(qty, ',' order by i) l from {_n} group by ok",
    "bounds_ranges_keys": f"select ok, (hi - n)::bigint lo, hi from (select ok, n, sum(n) over (order by ok)::bigint hi from (select ok, count(*) n from {_n} group by ok))",
    "count_len": f"select ok, count(*) n from {_n} group by ok",
    "head": f"select ok, pk \"first\" from {_n} where i = 0",
    "chunk": f"select ok, i // 2 i, string_agg(qty, ',' order by i) l from {_n} where n % 2 = 0 group by ok, i // 2",
    "append": f"select ok, string_agg(pk, ',' order by i) || ',' || string_agg(qty, ',' order by i) l from {_n} group by ok",
    "slices": f"select ok, string_agg(qty, ',' order by i) filter (i < 2) || '|' || string_agg(qty, ',' order by i) filter (i >= n // 2) l from {_n} group by ok",
    "cap_list": f"select ok, sum(ok * qty)::bigint s from {_n} group by ok",
    "zip_lists": f"select ok, sum(pk * qty)::bigint dot from {_n} group by ok",
    "transpose": f"select ok, string_agg(pk - qty, ',' order by i) l from {_n} group by ok",
    "list_arith": f"select ok, sum(pk * 2 + qty)::bigint s, sum(qty + 10)::bigint t from {_n} group by ok",
    "map_nested": f"select ok, sum(qty * ((qty % 4) * (qty % 4 - 1) // 2))::bigint s from {_n} group by ok",
    "flatten_ranges": f"select ok, string_agg(lo || ':' || (lo + qty % 3), ',' order by i) ranges, coalesce(string_agg(case qty % 3 when 1 then '0' when 2 then '0,1' end, ',' order by i), '') flat from (select *, (sum(qty % 3) over (partition by ok order by i) - qty % 3)::bigint lo from {_n}) group by ok",
    "list_scans": f"select ok, string_agg(a, ',' order by i) add_, string_agg(m, ',' order by i) max_, string_agg(s, ',' order by i) shifted from (select *, sum(qty) over w a, max(qty) over w m, lag(qty, 1, 0) over w s from {_n} window w as (partition by ok order by i)) group by ok",
    "list_find": f"select ok, count(*) filter (qty < 10) lo10, count(*) filter (qty <= 10) hi10, count(*) filter (qty < 25) lo25, count(*) filter (qty <= 25) hi25 from {_n} group by ok",
    "list_gather": f"select ok, string_agg(qty, ',' order by i desc) l from {_n} group by ok",
    "enlist": f"select ok, count(*) n from {_n} group by ok",
    "fold_stats": "select user_id, count(*) n, sum(v)::bigint s, max(v) m from (select user_id, round(value * 100)::bigint v from events) group by user_id",
    "foldscan_records": _records,
    "big_fold": _records,
}
