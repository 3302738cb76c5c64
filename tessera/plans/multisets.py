"""Signed multisets over the event stream: +1 per event, and -1 again for every error."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.zset import Collection
from tessera.plans.common import table

c = F.col


def changes(spark, sf):
    """user, kind, day, diff."""
    e = table(spark, sf, "events").select(c("user_id").alias("user"), c("event_type").alias("kind"), F.dayofmonth("ts").cast("bigint").alias("day"))
    plus = e.withColumn("diff", F.lit(1).cast("bigint"))
    return Collection(plus.union(e.where("kind = 'error'").withColumn("diff", F.lit(-1).cast("bigint"))))


def zset_consolidate(spark, sf):
    return changes(spark, sf).consolidate().df


def zset_distinct(spark, sf):
    return changes(spark, sf).map(user=c("user"), kind=c("kind")).distinct().df


def zset_threshold(spark, sf):
    return changes(spark, sf).map(user=c("user"), kind=c("kind")).threshold(lambda n: F.greatest(n - 10, F.lit(0))).df


def zset_difference(spark, sf):
    x = changes(spark, sf).map(user=c("user"), kind=c("kind"))
    return x.minus(x.filter(c("kind") == "click").weigh(F.lit(2))).df


def zset_count(spark, sf):
    return changes(spark, sf).count("kind").df.drop("diff")


def zset_join(spark, sf):
    """Counts multiply: pairs of views and purchases of a user on a day."""
    x = changes(spark, sf)
    views, buys = x.filter(c("kind") == "view").map(user=c("user"), day=c("day")), x.filter(c("kind") == "purchase").map(user=c("user"), day=c("day"))
    return views.join(buys, ["user", "day"]).consolidate().df


def zset_semijoin(spark, sf):
    x = changes(spark, sf)
    buyers = x.filter(c("kind") == "purchase").map(user=c("user")).distinct()
    return x.map(user=c("user"), kind=c("kind")).semijoin(buyers, "user").consolidate().df


def zset_antijoin(spark, sf):
    x = changes(spark, sf)
    busy = x.filter((c("kind") == "purchase") & (c("day") < 4)).map(user=c("user"))
    return x.map(user=c("user")).antijoin(busy, "user").consolidate().df


def zset_reduce(spark, sf):
    """Per user the kind with the smallest name and the last day, over what is present."""
    return changes(spark, sf).reduce(["user"], first_kind=F.min("kind"), last_day=F.max("day")).df.drop("diff")


def zset_flat_map(spark, sf):
    rows = F.array(F.struct(c("user").alias("k"), F.lit("u").alias("t")), F.struct(c("day").alias("k"), F.lit("d").alias("t")))
    return changes(spark, sf).flat_map(rows).consolidate().df


QUERIES = {f.__name__: f for f in (zset_consolidate, zset_distinct, zset_threshold, zset_difference, zset_count, zset_join, zset_semijoin, zset_antijoin, zset_reduce, zset_flat_map)}
CHANGES = "(select user_id \"user\", event_type kind, day(ts) \"day\", 1 d from events union all select user_id, event_type, day(ts), -1 from events where event_type = 'error')"
_sum = "sum(d)::bigint diff"
_pair = f'select "user", kind, {_sum} from {CHANGES} group by all having sum(d) <> 0'
ORACLE = {
    "zset_consolidate": f'select "user", kind, "day", {_sum} from {CHANGES} group by all having sum(d) <> 0',
    "zset_distinct": f'select "user", kind, 1::bigint diff from ({_pair}) where diff > 0',
    "zset_threshold": f'select "user", kind, diff - 10 diff from ({_pair}) where diff > 10',
    "zset_difference": f"select \"user\", kind, case kind when 'click' then -diff else diff end diff from ({_pair})",
    "zset_count": f"select kind, sum(d)::bigint n from {CHANGES} group by kind having sum(d) <> 0",
    "zset_join": f"with x as (select \"user\", \"day\", kind, sum(d)::bigint n from {CHANGES} group by all) select v.\"user\", v.\"day\", (v.n * b.n)::bigint diff from x v join x b on v.\"user\" = b.\"user\" and v.\"day\" = b.\"day\" where v.kind = 'view' and b.kind = 'purchase' and v.n * b.n <> 0",
    "zset_semijoin": f"select * from ({_pair}) where \"user\" in (select \"user\" from ({_pair}) where kind = 'purchase' and diff > 0)",
    "zset_antijoin": f"select \"user\", {_sum} from {CHANGES} where \"user\" not in (select \"user\" from {CHANGES} where kind = 'purchase' and \"day\" < 4 group by 1 having sum(d) > 0) group by all having sum(d) <> 0",
    "zset_reduce": f'select "user", min(kind) first_kind, max("day") last_day from (select "user", kind, "day" from {CHANGES} group by all having sum(d) > 0) group by "user"',
    "zset_flat_map": f"select k, t, {_sum} from (select \"user\" k, 'u' t, d from {CHANGES} union all select \"day\", 'd', d from {CHANGES}) group by all having sum(d) <> 0",
}
