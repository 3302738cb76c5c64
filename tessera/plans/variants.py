"""Tagged sums, options, per-row failure, and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import effect as E
from tessera.functions import sums as U
from tessera.functions import text as X
from tessera.operators import seq
from tessera.plans.common import ORDER_LISTS, cents, order_lists, table

c = F.col


def _orders(spark, sf):
    return table(spark, sf, "orders").select(c("o_orderkey").alias("k"), cents("o_totalprice").alias("v"))


def sum_branch_match(spark, sf):
    s = U.branch(c("v"), c("k") % 3, 3)
    return _orders(spark, sf).select("k", U.match(s, [lambda x: x + 1, lambda x: x * 2, lambda x: -x]).alias("r"))


def sum_map_variant(spark, sf):
    s = U.branch(c("v"), c("k") % 3, 3)
    return _orders(spark, sf).select("k", U.unwrap(U.map_variant(s, 1, lambda x: x * 10, 3), 3).alias("r"))


def sum_inject(spark, sf):
    s = F.when(c("k") % 2 == 0, U.inject(0, c("v"), ["bigint", "string"])).otherwise(U.inject(1, c("k").cast("string"), ["bigint", "string"]))
    return _orders(spark, sf).select("k", s.alias("s")).select("k", c("s.tag").cast("bigint").alias("tag"), "s.l0", "s.l1")


def sum_inject_split_merge(spark, sf):
    """Lanes apart, each worked on, and back in source order."""
    base = seq.with_position(_orders(spark, sf), c("k"))
    tagged = base.select("pos", U.branch(c("v"), c("k") % 2, 2).alias("s"))
    even, odd = U.split(tagged, "s", 2)
    lanes = [even.withColumn("value", c("value") + 1), odd.withColumn("value", c("value") * 3)]
    return U.merge(tagged.select("pos", c("s.tag").cast("int").alias("tag")), lanes).select("pos", "value")


def sum_capture(spark, sf):
    s = U.capture(c("k"), U.branch(c("v"), c("k") % 2, 2), 2)
    return _orders(spark, sf).select("k", U.match(s, [lambda p: p["_0"] + p["_1"], lambda p: p["_0"] - p["_1"]]).alias("r"))


def sum_unweave(spark, sf):
    """Lists of sums apart by lane, and woven together again."""
    sums = F.transform("b", lambda x: U.branch(x, x % 2, 2))
    u = U.unweave(sums, 2)
    woven = F.transform(U.weave(u, 2), lambda s: F.coalesce(s["l0"], s["l1"]))
    return order_lists(spark, sf).select("ok", F.array_join(u["l0"], ",").alias("even"), F.array_join(u["l1"], ",").alias("odd"), F.array_join(woven, ",").alias("woven"))


def option_default(spark, sf):
    x = U.some(F.when(c("v") % 2 == 0, c("v")))
    return _orders(spark, sf).select("k", U.default(x, F.lit(-1)).alias("r"))


def try_get(spark, sf):
    f = E.get(c("b"), F.lit(2)).attempt()
    return order_lists(spark, sf).select("ok", f["tag"].cast("bigint").alias("tag"), f["l0"].alias("v"))


def fail_tuple(spark, sf):
    """A product fails if either field does; the steps after it keep the failure."""
    f = E.sequence(x=E.get(c("a"), F.lit(1)), y=E.get(c("b"), F.lit(2))).then(lambda p: p["x"] + p["y"])
    return order_lists(spark, sf).select("ok", f.err.alias("err"), f.ok.alias("v"))


def fail_traverse(spark, sf):
    f = E.traverse(c("b"), lambda x: E.get(c("a"), x % 3))
    return order_lists(spark, sf).select("ok", f.err.alias("err"), A.fold_add(f.ok).alias("s"))


def fail_branch(spark, sf):
    f = E.branch(c("v"), c("k") % 4, 3).then(lambda s: U.match(s, [lambda x: x, lambda x: x + 1, lambda x: x + 2]))
    return _orders(spark, sf).select("k", f.err.alias("err"), f.ok.alias("r"))


def fail_chunk(spark, sf):
    f = E.chunk(c("b"), 2)
    return order_lists(spark, sf).select("ok", f.err.alias("err"), F.size(f.ok).cast("bigint").alias("n"))


def fail_zip(spark, sf):
    f = E.zip_lists(c("a"), F.filter("b", lambda x: x > 10)).then(lambda z: F.aggregate(z, F.lit(0).cast("bigint"), lambda s, p: s + p["_0"] * p["_1"]))
    return order_lists(spark, sf).select("ok", f.err.alias("err"), f.ok.alias("dot"))


def fail_gather(spark, sf):
    """All or nothing, beside the form that tags each element."""
    idx = F.transform("b", lambda x: x % 4)
    f, t = E.gather(idx, c("a")), E.gather_try(idx, c("a"))
    return order_lists(spark, sf).select("ok", f.err.alias("err"), A.fold_add(f.ok).alias("s"), F.size(F.filter(t, lambda x: x["tag"] == 1)).cast("bigint").alias("found"))


def fail_slices(spark, sf):
    f = E.slices(F.array(F.struct(F.lit(0).alias("lo"), F.lit(3).alias("hi"))), c("b"))
    return order_lists(spark, sf).select("ok", f.err.alias("err"), A.fold_add(F.flatten(f.ok)).alias("s"))


def fail_filter(spark, sf):
    f = E.filter_by(c("b"), F.transform(F.slice("a", 1, 3), lambda x: x % 2 == 0))
    return order_lists(spark, sf).select("ok", f.err.alias("err"), A.fold_add(f.ok).alias("s"))


def split_text(spark, sf):
    pieces = X.split(c("props"), ":")
    return table(spark, sf, "events").select("event_id", F.size(pieces).cast("bigint").alias("n"), F.element_at(pieces, -1).alias("last"))


def word_count(spark, sf):
    x = table(spark, sf, "documents").select(F.explode(X.words(F.lower("text"))).alias("w"))
    return x.groupBy("w").agg(F.count("*").alias("n"))


def parse_u64(spark, sf):
    raw = F.concat_ws("", F.when(c("event_id") % 5 == 0, "+").when(c("event_id") % 5 == 1, " ").otherwise(""), F.regexp_extract("props", "[0-9]+", 0), F.when(c("event_id") % 5 == 2, "18446744073709551615").otherwise(""))
    p = X.parse_u64(raw)
    return table(spark, sf, "events").select("event_id", p["tag"].cast("bigint").alias("tag"), p["l0"].alias("bad"), p["l1"].cast("string").alias("num"))


def csv_sum(spark, sf):
    line = F.concat_ws(",", F.regexp_extract("props", "[0-9]+", 0), c("user_id").cast("string"), c("event_type"), F.lit(""))
    return table(spark, sf, "events").select("event_id", X.sum_fields(line).cast("bigint").alias("s"))


QUERIES = {f.__name__: f for f in (sum_branch_match, sum_map_variant, sum_inject, sum_inject_split_merge, sum_capture, sum_unweave, option_default, try_get, fail_tuple, fail_traverse, fail_branch, fail_chunk, fail_zip, fail_gather, fail_slices, fail_filter, split_text, word_count, parse_u64, csv_sum)}
_k = "(select o_orderkey k, round(o_totalprice * 100)::bigint v from orders)"
ORACLE = {
    "sum_branch_match": f"select k, case k % 3 when 0 then v + 1 when 1 then v * 2 else -v end r from {_k}",
    "sum_map_variant": f"select k, case k % 3 when 1 then v * 10 else v end r from {_k}",
    "sum_inject": f"select k, k % 2 tag, case when k % 2 = 0 then v end l0, case when k % 2 = 1 then k::varchar end l1 from {_k}",
    "sum_inject_split_merge": f"select row_number() over (order by k) - 1 pos, case when k % 2 = 0 then v + 1 else v * 3 end \"value\" from {_k}",
    "sum_capture": f"select k, case when k % 2 = 0 then k + v else k - v end r from {_k}",
    "sum_unweave": f"select ok, array_to_string(list_filter(b, lambda x: x % 2 = 0), ',') even, array_to_string(list_filter(b, lambda x: x % 2 = 1), ',') odd, array_to_string(b, ',') woven from {ORDER_LISTS}",
    "option_default": f"select k, case when v % 2 = 0 then v else -1 end r from {_k}",
    "try_get": f"select ok, (len(b) <= 2)::bigint tag, b[3] v from {ORDER_LISTS}",
    "fail_tuple": f"select ok, len(b) < 3 err, case when len(b) >= 3 then a[2] + b[3] end v from {ORDER_LISTS}",
    "fail_traverse": f"select ok, list_max(list_transform(b, lambda x: x % 3)) >= len(a) err, case when list_max(list_transform(b, lambda x: x % 3)) < len(a) then list_sum(list_transform(b, lambda x: a[x % 3 + 1]))::bigint end s from {ORDER_LISTS}",
    "fail_branch": f"select k, k % 4 = 3 err, case when k % 4 < 3 then v + k % 4 end r from {_k}",
    "fail_chunk": f"select ok, len(b) % 2 <> 0 err, case when len(b) % 2 = 0 then len(b) // 2 end n from {ORDER_LISTS}",
    "fail_zip": f"select ok, list_min(b) <= 10 err, case when list_min(b) > 10 then list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2]))::bigint end dot from {ORDER_LISTS}",
    "fail_gather": f"select ok, list_max(list_transform(b, lambda x: x % 4)) >= len(a) err, case when list_max(list_transform(b, lambda x: x % 4)) < len(a) then list_sum(list_transform(b, lambda x: a[x % 4 + 1]))::bigint end s, len(list_filter(b, lambda x: x % 4 < len(a))) found from {ORDER_LISTS}",
    "fail_slices": f"select ok, len(b) < 3 err, case when len(b) >= 3 then b[1] + b[2] + b[3] end s from {ORDER_LISTS}",
    "fail_filter": f"select ok, len(b) > 3 err, case when len(b) <= 3 then coalesce(list_sum(list_transform(list_zip(a, b), lambda p: case when p[1] % 2 = 0 then p[2] else 0 end)), 0)::bigint end s from {ORDER_LISTS}",
    "split_text": "select event_id, len(string_split(props, ':')) n, string_split(props, ':')[-1] \"last\" from events",
    "word_count": r"select w, count(*) n from (select unnest(string_split_regex(lower(text), '[ \t\n\r]+')) w from documents) where w <> '' group by w",
    "parse_u64": "select event_id, (n is not null)::bigint tag, case when n is null then raw end bad, n::varchar num from (select *, case when regexp_full_match(raw, '[0-9]+') then try_cast(raw as ubigint) end n from (select event_id, case event_id % 5 when 0 then '+' when 1 then ' ' else '' end || regexp_extract(props, '[0-9]+') || case when event_id % 5 = 2 then '18446744073709551615' else '' end raw from events))",
    "csv_sum": "select event_id, (regexp_extract(props, '[0-9]+')::bigint + user_id)::bigint s from events",
}
