"""Graph, social-path and puzzle queries over graphs derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import puzzle, seq, social
from tessera.plans.common import GRAPH, lines, part_graph, table

c = F.col
#: A puzzle that propagation alone solves, and its board.
BOARD = "530070000600195000098000060800060003400803001700020006060000280000419005000080079"


def pagerank_20(spark, sf):
    return G.pagerank(part_graph(spark, sf), 20)


def khop_2(spark, sf):
    roots = spark.range(5).select((c("id") + 1).alias("node"))
    return G.k_hop(part_graph(spark, sf), roots, 2)


def bfs_levels(spark, sf):
    d = G.bfs(part_graph(spark, sf), spark.range(1).select((c("id") + 1).alias("node")))
    return d.groupBy("dist").agg(F.count("*").alias("nodes"))


def reach_pairs(spark, sf):
    pairs = spark.range(12).select((c("id") * 7 + 1).alias("src"), (c("id") * 13 + 2).alias("dst"))
    return G.pair_distances(part_graph(spark, sf), pairs)


def components(spark, sf):
    return G.components(part_graph(spark, sf))


def components_seeded(spark, sf):
    """Labels start at sources only: a sink's own id never wins."""
    e = part_graph(spark, sf)
    return G.components(e, e.select(c("src").alias("node")).distinct())


def component_sizes(spark, sf):
    return G.component_sizes(components(spark, sf))


def triangles_undirected(spark, sf):
    return G.triangles(part_graph(spark, sf))


def triangles_directed(spark, sf):
    return G.directed_triads(part_graph(spark, sf))


def triangles_wco_synthetic(spark, sf):
    """Arcs (0,k), (k,0), (k,k+1) for k = 1..N, counted by rotation: a hub of degree N."""
    n = 1_000_000
    k = spark.range(1, n + 1)
    arcs = k.select(F.lit(0).cast("bigint").alias("src"), c("id").alias("dst")).union(k.select(c("id"), F.lit(0).cast("bigint"))).union(k.select(c("id"), c("id") + 1))
    t = G.directed_cycles(arcs)
    return t.agg(F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum("c").alias("sc"))


def ktruss(spark, sf):
    return G.k_truss(part_graph(spark, sf))


def ktruss_histogram(spark, sf):
    return G.k_truss(part_graph(spark, sf)).groupBy("label").agg(F.count("*").alias("edges"))


def pointer_jump(spark, sf):
    """Chains n -> n-1 broken at multiples of 100: three jumps go eight steps."""
    p = spark.range(5000).select(c("id").alias("node"), F.when(c("id") % 100 == 0, c("id")).otherwise(c("id") - 1).alias("parent"))
    return G.pointer_jump(p, 3)


def cse_round(spark, sf):
    """One round of value numbering over (supplier, discount) terms."""
    t = seq.with_position(lines(spark, sf).select("ok", "ln", "pk", "sk", "qty", "disc", "price"), *(c(k) for k in ("ok", "ln", "pk", "sk", "qty", "disc", "price")), name="id").select("id", "sk", "disc")
    return G.congruence_round(t, ["sk", "disc"])


def sudoku(spark, sf):
    """Cells of the board with what propagation leaves of them."""
    left = puzzle.propagate(puzzle.board(spark, BOARD))
    return left.groupBy("row", "col").agg(F.count("*").alias("n"), F.min("val").cast("bigint").alias("val")).select(c("row").cast("bigint").alias("row"), c("col").cast("bigint").alias("col"), "n", "val")


def random_churn(spark, sf):
    """Edges of a churning graph after its epochs, counted by parity."""
    e = G.churn(spark, 1000, 4000, 50, 20, seed=3).groupBy("src", "dst").agg(F.sum("diff").alias("n")).where("n <> 0")
    return e.agg(F.sum("n").alias("edges"))


def social_inputs(spark, sf):
    """Queries, friendships, comments, posts and forums derived from orders and events."""
    e = table(spark, sf, "events").select(c("event_id").alias("id"), c("user_id").alias("creator"), "event_type", F.unix_millis(c("ts").cast("timestamp")).alias("ts_ms"))
    is_post = c("event_type").isin("view", "signup")
    posts = e.where(is_post).select("id", "creator", (c("id") % 10).alias("forum"), "ts_ms")
    comments = e.where(~is_post).where("id >= 10").select("id", "creator", (c("id") - 1 - c("id") % 5).alias("link"), "ts_ms")
    forums = e.where("id < 10").select("id", "ts_ms")
    knows = part_graph(spark, sf).select("src", "dst")
    first = F.lit(1_704_067_200_000).cast("bigint")
    queries = spark.range(8).select((c("id") * 5 + 1).alias("src"), (c("id") * 11 + 3).alias("dst"), first.alias("start_ms"), (first + (c("id") + 1) * 1_500_000).alias("end_ms"))
    return queries, knows, comments, posts, forums


def social_paths(spark, sf):
    return social.path_scores(*social_inputs(spark, sf))


QUERIES = {f.__name__: f for f in (pagerank_20, khop_2, bfs_levels, reach_pairs, components, components_seeded, component_sizes, triangles_undirected, triangles_directed, triangles_wco_synthetic, ktruss, ktruss_histogram, pointer_jump, cse_round, sudoku, random_churn, social_paths)}
_both = lambda e: f"(select src, dst from {e} union select dst, src from {e})"
#: Smallest labels after thirty rounds, more than the longest way in these graphs has edges.
_spread = f"""with recursive g as (select * from {_both(GRAPH)} union select src, src from {_both(GRAPH)}),
r(i, node, label) as (select 0, src, {{first}} from (select distinct src from g)
 union all select i + 1, g.src, min(label) from r join g on g.dst = r.node where i < 30 group by i + 1, g.src),
reach as (select node, label from r where i = 30 and label is not null)"""
_labels = _spread.format(first="src")
_seeded = _spread.format(first=f"case when src in (select src from {GRAPH}) then src end")
_truss = f"""e as (select distinct least(src, dst) u, greatest(src, dst) v from {GRAPH}),
t as (select x.u a, x.v b, y.v c from e x join e y on x.v = y.u join e z on z.u = x.u and z.v = y.v),
rows_ as (select row(a, b) e, row(a, c) x, row(b, c) y from t union all select row(a, c), row(a, b), row(b, c) from t union all select row(b, c), row(a, b), row(a, c) from t),
r(i, e, l) as (select 0, e, 2147483648::bigint from (select distinct e from rows_)
 union all select i + 1, e, max(least(m, n)) from (select s.i, s.e, s.m, row_number() over (partition by s.i, s.e order by s.m desc) n from (select p.i, k.e, least(p.l, q.l) m from rows_ k join r p on p.e = k.x join r q on q.e = k.y) s) where i < 40 group by i, e)"""
ORACLE = {
    "pagerank_20": f"""with recursive e as (select * from {GRAPH}), deg as (select src, count(*) d from e group by src),
nx as (select e.src, e.dst, deg.d from e join deg using (src) union all select src, src, null from deg),
r(i, node, rnk) as (select 0, src, 6000000::bigint from deg union all
 select r.i + 1, nx.dst, sum(case when nx.d is null then 1000000 else (5 * r.rnk) // (6 * nx.d) end)::bigint from r join nx on nx.src = r.node where r.i < 20 group by r.i + 1, nx.dst)
select node, rnk "rank" from r where i = 20 and rnk > 0""",
    "khop_2": f"with recursive r(root, dest, n) as (select i, i, 0 from range(1, 6) t(i) union select root, dst, n + 1 from r join {GRAPH} on src = dest where n < 2) select distinct root, dest from r",
    "bfs_levels": f"with recursive g as (select * from {GRAPH}), r(node, dist) as (select 1::bigint, 0::bigint union select dst, dist + 1 from r join g on src = node where dist < 12) select dist, count(*) nodes from (select node, min(dist) dist from r group by node) group by dist",
    "reach_pairs": f"with recursive p as (select distinct i * 7 + 1 s, i * 13 + 2 t from range(12) x(i)), g as (select * from {GRAPH}), r(s, node, d) as (select s, s, 0::bigint from p union select r.s, dst, d + 1 from r join g on src = node where d < 30) select p.s src, p.t dst, min(d) dist from p join r on r.s = p.s and r.node = p.t group by all",
    "components": f"{_labels} select node, label from reach",
    "components_seeded": f"{_seeded} select node, label from reach",
    "component_sizes": f"{_labels} select size, count(*) components from (select count(*) size from reach group by label) group by size",
    "triangles_undirected": f"with e as (select distinct least(src, dst) u, greatest(src, dst) v from {GRAPH}) select x.u a, x.v b, y.v c from e x join e y on x.v = y.u join e z on z.u = x.u and z.v = y.v",
    "triangles_directed": f"with e as (select * from {GRAPH}) select x.src a, x.dst b, y.dst c from e x join e y on x.src = y.src join e z on z.src = x.dst and z.dst = y.dst",
    "triangles_wco_synthetic": "select 3 * 999999::bigint n, s sa, s sb, s sc from (select (sum(k) + sum(k + 1))::bigint s from range(1, 1000000) t(k))",
    "ktruss": f"with recursive {_truss} select e[1] src, e[2] dst, l label from r where i = 40",
    "ktruss_histogram": f"with recursive {_truss} select l label, count(*) edges from r where i = 40 group by l",
    "pointer_jump": "select i node, greatest(i - 8, i - i % 100) parent from range(5000) t(i)",
    "cse_round": "select id, sk, disc, min(id) over (partition by sk, disc) class from (select l_suppkey sk, round(l_discount * 100)::bigint disc, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_discount * 100)::bigint, round(l_extendedprice * 100)::bigint) - 1 id from lineitem)",
    "sudoku": "select i // 9 \"row\", i % 9 \"col\", 1::bigint n, '534678912672195348198342567859761423426853791713924856961537284287419635345286179'[i + 1]::bigint val from range(81) t(i)",
    "random_churn": "select 4000::bigint edges",
    "social_paths": f"""with recursive g as (select src, dst from {_both(GRAPH)} where src <> dst),
q as (select i * 5 + 1 s, i * 11 + 3 t, 1704067200000 st, 1704067200000 + (i + 1) * 1500000 en from range(8) x(i)),
f(s, node, d) as (select s, s, 0::bigint from q union select f.s, g.dst, d + 1 from f join g on g.src = node where d < 12),
b(t, node, d) as (select t, t, 0::bigint from q union select b.t, g.dst, d + 1 from b join g on g.src = node where d < 12),
df as (select s, node, min(d) d from f group by all), db as (select t, node, min(d) d from b group by all),
dist as (select distinct q.s, q.t, df.d from q join df on df.s = q.s and df.node = q.t),
path as (select distinct p.s, p.t, least(g.src, g.dst) a, greatest(g.src, g.dst) b from dist p join df on df.s = p.s join g on g.src = df.node join db on db.t = p.t and db.node = g.dst where df.d + 1 + db.d = p.d),
e as (select event_id id, user_id creator, event_type in ('view', 'signup') post, epoch_ms(ts) ms from events),
po as (select id, creator, id % 10 forum from e where post), co as (select id, creator, id - 1 - id % 5 link from e where not post and id >= 10),
r(id, up) as (select id, link from co union all select r.id, co.link from r join co on co.id = r.up),
i as (select least(co.creator, o.creator) a, greatest(co.creator, o.creator) b, po.forum, o.score from co join r on r.id = co.id join po on po.id = r.up
  join (select id, creator, 2 score from po union all select id, creator, 1 from co) o on o.id = co.link where co.creator <> o.creator),
v as (select path.s, path.t, i.a, i.b, sum(score)::bigint score from path join q on q.s = path.s and q.t = path.t join i on i.a = path.a and i.b = path.b join e fo on fo.id = i.forum and fo.id < 10 where fo.ms between q.st and q.en group by all)
select path.s src, path.t dst, path.a, path.b, coalesce(v.score, 0)::bigint score from path left join v using (s, t, a, b)""",
}
