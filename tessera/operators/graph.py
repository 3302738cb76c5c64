"""Graph computations over edge frames (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.fixpoint import grow, iterate, repeat
from tessera.operators.materialise import materialise

INFINITE = 1 << 31


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, src < dst; loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, rounds: int = 20, start: int = 6_000_000, reset: int = 1_000_000) -> DataFrame:
    """Integer surfers: each round a node pushes (5 * rank) div (6 * degree) along each edge and gets ``reset``.

    Sources only are reset; sinks hold what they receive. The edges are laid out by source once.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    # a self row without degree carries the reset, so each round is one join and one aggregation
    out = edges.join(degree, "src").select("src", "dst", "degree").union(degree.select("src", F.col("src").alias("dst"), F.lit(None).cast("bigint")))
    out = materialise(out.repartition("src"))
    ranks = degree.select(F.col("src").alias("node"), F.lit(start).cast("bigint").alias("rank"))
    pushed = F.when(F.col("degree").isNull(), F.lit(reset)).otherwise(F.expr("(5 * rank) div (6 * degree)")).cast("bigint")
    step = lambda r: r.join(out, r["node"] == out["src"]).groupBy("dst").agg(F.sum(pushed).alias("rank")).where("rank > 0").select(F.col("dst").alias("node"), "rank")
    return repeat(ranks, step, rounds)


def k_hop(edges: DataFrame, roots: DataFrame, steps: int) -> DataFrame:
    """(root, dest) within ``steps`` hops, the root itself included."""
    reached = roots.select(F.col("node").alias("root"), F.col("node").alias("dest"))
    frontier = reached
    for _ in range(steps):
        nxt = frontier.join(edges, frontier["dest"] == edges["src"]).select("root", F.col("dst").alias("dest")).distinct()
        frontier = nxt.join(reached, ["root", "dest"], "left_anti")
        reached = reached.union(frontier)
    return reached


def bfs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, dist): fewest hops from any root."""
    start = roots.select("node", F.lit(0).cast("bigint").alias("dist"))
    return grow(start, lambda f: f.join(edges, f["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("dist") + 1).alias("dist")), ["node"])


def pair_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, dist) of the pairs that are connected: two frontiers grow towards each other.

    Each round extends the forward, then the reverse frontier of the pairs that have not met, and both
    are dropped for a pair as soon as it has.
    """
    pairs = pairs.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("s"), F.col("dst").alias("t"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    fwd = materialise(ends.select("s", "t", F.col("s").alias("node"), F.lit(0).cast("bigint").alias("d")))
    rev = materialise(ends.select("s", "t", F.col("t").alias("node"), F.lit(0).cast("bigint").alias("d")))
    front, rear = fwd, rev

    def met(a, b):
        return a.withColumnRenamed("d", "da").join(b.withColumnRenamed("d", "db"), ["s", "t", "node"]).groupBy("s", "t").agg(F.min(F.col("da") + F.col("db")).alias("dist"))

    found = materialise(met(fwd, rev))
    while True:
        grown = []
        for frontier, seen, along in ((front, fwd, edges), (rear, rev, back)):
            open_ = frontier.join(found, ["s", "t"], "left_anti")
            nxt = open_.join(along, open_["node"] == along["src"]).select("s", "t", F.col("dst").alias("node"), (F.col("d") + 1).alias("d")).distinct()
            grown.append(materialise(nxt.join(seen, ["s", "t", "node"], "left_anti")))
        front, rear = grown
        # odd total first: new forward against old reverse, then new against new
        odd = met(front, rev).union(met(fwd, rear)).groupBy("s", "t").agg(F.min("dist").alias("dist"))
        fwd, rev = fwd.union(front), rev.union(rear)
        even = met(front, rear)
        fresh = odd.union(even).groupBy("s", "t").agg(F.min("dist").alias("dist")).join(found, ["s", "t"], "left_anti")
        found = materialise(found.union(fresh))
        if front.isEmpty() or rear.isEmpty():
            return found.select(F.col("s").alias("src"), F.col("t").alias("dst"), "dist")


def components(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest seed that reaches a node over edges taken both ways.

    Seeds default to all nodes; nodes that no seed reaches have no row.
    """
    both = materialise(symmetric(edges).repartition("src"))
    start = (nodes(edges) if seeds is None else seeds).select("node", F.col("node").alias("label"))

    def step(labels: DataFrame) -> DataFrame:
        sent = labels.join(both, labels["node"] == both["src"]).select(F.col("dst").alias("node"), "label")
        spread = labels.union(sent).groupBy("node").agg(F.min("label").alias("label"))
        # follow the label once: halves the rounds on long paths
        hop = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        return spread.join(hop, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))

    return iterate(start, step, lambda a, b: b.join(a, ["node", "label"], "left_anti"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """How many components there are of each size."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def by_degree(edges: DataFrame) -> DataFrame:
    """Undirected edges pointing from smaller to larger (degree, id): no node has many out-edges."""
    e = oriented(edges)
    degree = nodes_with_degree(e)
    a, b = degree.select(F.col("node").alias("src"), F.col("d").alias("da")), degree.select(F.col("node").alias("dst"), F.col("d").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("dst")))
    return e.join(a, "src").join(b, "dst").select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def nodes_with_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))


def triangles(edges: DataFrame) -> DataFrame:
    """Undirected triangles once each, a < b < c: wedges at the smallest-degree corner, closed by a semi-join."""
    e = materialise(by_degree(edges))
    closing = e.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    ab, ac = e.select("src", F.col("dst").alias("y")), e.select("src", F.col("dst").alias("z"))
    found = ab.join(ac, "src").where("y <> z").join(closing, ["y", "z"], "left_semi")
    corners = F.array_sort(F.array("src", "y", "z"))
    return found.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def directed_triads(edges: DataFrame) -> DataFrame:
    """a->b, a->c, b->c over the edges as given; each edge is extended at the end with fewer proposals."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    sized = e.join(out.withColumnRenamed("n", "na"), "src").join(out.select(F.col("src").alias("dst"), F.col("n").alias("nb")), "dst").select("src", "dst", "na", "nb")
    props = e.select(F.col("src").alias("via"), F.col("dst").alias("c"))
    from_a = sized.where("na <= nb").join(props, F.col("src") == F.col("via")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "c")
    from_b = sized.where("na > nb").join(props, F.col("dst") == F.col("via")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "c")
    check = lambda left, x: left.join(e.select(F.col("src").alias(x), F.col("dst").alias("c")), [x, "c"], "left_semi").select("a", "b", "c")
    return check(from_a, "b").union(check(from_b, "a"))


def directed_cycles(edges: DataFrame) -> DataFrame:
    """arc(a,b), arc(b,c), arc(c,a): all rotations."""
    e = edges.select("src", "dst").distinct()
    deg_out, deg_in = e.groupBy("src").agg(F.count("*").alias("no")), e.groupBy("dst").agg(F.count("*").alias("ni"))
    # per arc (a,b), c follows b or precedes a: extend where there is less
    sized = e.join(deg_out.select(F.col("src").alias("dst"), "no"), "dst").join(deg_in.select(F.col("dst").alias("src"), "ni"), "src")
    after, before = e.select(F.col("src").alias("dst"), F.col("dst").alias("c")), e.select(F.col("dst").alias("src"), F.col("src").alias("c"))
    x = sized.where("no <= ni").join(after, "dst").join(before, ["src", "c"], "left_semi")
    y = sized.where("no > ni").join(before, "src").join(after, ["dst", "c"], "left_semi")
    pick = lambda d: d.select(F.col("src").alias("a"), F.col("dst").alias("b"), "c")
    return pick(x).union(pick(y))


def k_truss(edges: DataFrame) -> DataFrame:
    """(src, dst, label) of the edges in triangles: the fixpoint of the h-index over each edge's triangles.

    A triangle offers an edge the smaller label of its other two edges. Triangles are listed once and
    laid out by edge; labels only fall, and change only near edges that changed.
    """
    t = triangles(edges).select("a", "b", "c")
    edge = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    sides = [("a", "b", "a", "c", "b", "c"), ("a", "c", "a", "b", "b", "c"), ("b", "c", "a", "b", "a", "c")]
    rows = None
    for p, q, r, s, u, v in sides:
        part = t.select(edge(p, q).alias("e"), edge(r, s).alias("x"), edge(u, v).alias("y"))
        rows = part if rows is None else rows.union(part)
    rows = materialise(rows)
    start = rows.select("e").distinct().select("e", F.lit(INFINITE).cast("bigint").alias("label"))

    def step(labels: DataFrame) -> DataFrame:
        x, y = labels.select(F.col("e").alias("x"), F.col("label").alias("lx")), labels.select(F.col("e").alias("y"), F.col("label").alias("ly"))
        offered = rows.join(x, "x").join(y, "y").select("e", F.least("lx", "ly").alias("m"))
        rank = F.row_number().over(W.partitionBy("e").orderBy(F.desc("m")))
        return offered.select("e", F.least("m", rank.cast("bigint")).alias("h")).groupBy("e").agg(F.max("h").alias("label"))

    done = iterate(start, step, lambda a, b: b.join(a, ["e", "label"], "left_anti"))
    return done.select("e.src", "e.dst", "label")


def pointer_jump(parents: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, parent) with parents replaced by grandparents: ``rounds`` times, or until all point at roots."""

    def step(p: DataFrame) -> DataFrame:
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        return p.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))

    if rounds is not None:
        return repeat(parents, step, rounds)
    return iterate(parents, step, lambda a, b: b.join(a, ["node", "parent"], "left_anti"))


def congruence_round(terms: DataFrame, key: list[str]) -> DataFrame:
    """One round of value numbering: terms with equal keys share the smallest of their ids as class."""
    return terms.withColumn("class", F.min("id").over(W.partitionBy(*key)))


def random_graph(spark, n_nodes: int, n_edges: int, seed: int = 0) -> DataFrame:
    """Deterministic random edges by hashing their number."""
    pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n_nodes))
    return spark.range(n_edges).select(pick(1).alias("src"), pick(2).alias("dst"))


def churn(spark, n_nodes: int, n_edges: int, batch: int, rounds: int, seed: int = 0) -> DataFrame:
    """Signed edge changes by epoch: ``n_edges`` at epoch 0, then each epoch inserts and removes ``batch``."""
    pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n_nodes))
    edge = [pick(1).alias("src"), pick(2).alias("dst")]
    first = spark.range(n_edges).select(*edge, F.lit(1).cast("bigint").alias("diff"), F.lit(0).cast("bigint").alias("epoch"))
    epoch = lambda base: (F.floor((F.col("id") - base) / batch) + 1).cast("bigint").alias("epoch")
    added = spark.range(n_edges, n_edges + batch * rounds).select(*edge, F.lit(1).cast("bigint").alias("diff"), epoch(n_edges))
    gone = spark.range(0, batch * rounds).select(*edge, F.lit(-1).cast("bigint").alias("diff"), epoch(0))
    return first.union(added).union(gone)


def k_truss_peeling(edges: DataFrame) -> DataFrame:
    """As ``k_truss``, level by level: edges with fewer than k triangles left go, and carry label k - 1.

    More rounds than the h-index loop; the two agree (tested).
    """
    t = materialise(triangles(edges).withColumn("id", F.monotonically_increasing_id()))
    corners = (("a", "b"), ("a", "c"), ("b", "c"))
    member = None
    for x, y in corners:
        part = t.select(F.struct(F.col(x).alias("src"), F.col(y).alias("dst")).alias("e"), "id")
        member = part if member is None else member.union(part)
    member, level, done = materialise(member), 1, None
    while True:
        support = member.groupBy("e").agg(F.count("*").alias("n"))
        weak = materialise(support.where(F.col("n") <= level).select("e"))
        if weak.isEmpty():
            if member.isEmpty():
                return done.select("e.src", "e.dst", F.col("label"))
            level += 1
            continue
        gone = weak.select("e", F.lit(level).cast("bigint").alias("label"))
        broken = member.join(weak, "e", "left_semi").select("id").distinct()
        left = materialise(member.join(broken, "id", "left_anti"))
        # edges whose last triangle just broke leave at this level too
        alive = left.select("e").distinct()
        lost = member.select("e").distinct().join(alive, "e", "left_anti").join(weak, "e", "left_anti").select("e", F.lit(level).cast("bigint").alias("label"))
        done = gone.union(lost) if done is None else done.union(gone).union(lost)
        done, member = materialise(done), left


class GraphSession:
    """A graph laid out once (forward, reverse, nodes, degrees) and asked many questions."""

    def __init__(self, edges: DataFrame):
        self.edges = materialise(edges.select("src", "dst").distinct().repartition("src"))
        self.reverse = materialise(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).repartition("src"))
        self.sources = materialise(self.edges.select(F.col("src").alias("node")).distinct())
        self.commands = {
            "pagerank": lambda rounds=20: pagerank(self.edges, int(rounds)),
            "neighborhood": lambda root, steps=2: k_hop(self.edges, self._nodes(root), int(steps)),
            "components": lambda: components(self.edges, self.sources),
            "sizes": lambda: component_sizes(components(self.edges, self.sources)),
            "distance": lambda src, dst: pair_distances(self.edges, self.edges.sparkSession.createDataFrame([(int(src), int(dst))], "src bigint, dst bigint")),
            "triangles": lambda: directed_triads(self.edges),
        }

    def _nodes(self, *ids) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(int(i),) for i in ids], "node bigint")

    def run(self, command: str, *args) -> DataFrame:
        return self.commands[command](*args)
