"""Weighted social paths: interaction scores of the edges on shortest friendship paths.

For each query (src, dst, start_ms, end_ms): all edges on any shortest path between src and dst, scored
by replies exchanged between their ends in threads of forums created within the window. A reply to a
post scores 2, a reply to a comment 1; path edges without interaction score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fixpoint import iterate
from tessera.operators.materialise import materialise


def shortest_path_edges(knows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, x, y): every edge x->y on a shortest path from src to dst.

    Distances are grown from both ends of all pairs at once; a pair stops as soon as its frontiers meet.
    An edge is on a shortest path if its ends' distances from the two sides add up.
    """
    both = materialise(knows.select("src", "dst").union(knows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    ends = pairs.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
    side = lambda c: materialise(ends.select("s", "t", F.col(c).alias("node"), F.lit(0).cast("bigint").alias("d")))
    sides = {"f": side("s"), "r": side("t")}
    frontier = dict(sides)
    met = lambda: sides["f"].withColumnRenamed("d", "df").join(sides["r"].withColumnRenamed("d", "dr"), ["s", "t", "node"]).groupBy("s", "t").agg(F.min(F.col("df") + F.col("dr")).alias("dist"))
    found = materialise(met())
    while True:
        for k in ("f", "r"):
            f = frontier[k].join(found, ["s", "t"], "left_anti")
            nxt = f.join(both, f["node"] == both["src"]).select("s", "t", F.col("dst").alias("node"), (F.col("d") + 1).alias("d")).distinct()
            frontier[k] = materialise(nxt.join(sides[k], ["s", "t", "node"], "left_anti"))
            sides[k] = sides[k].union(frontier[k])
            found = materialise(found.union(met().join(found, ["s", "t"], "left_anti")))
        if frontier["f"].isEmpty() or frontier["r"].isEmpty():
            break
    # unwind from the nodes where the frontiers met, towards both ends
    mid = sides["f"].withColumnRenamed("d", "df").join(sides["r"].withColumnRenamed("d", "dr"), ["s", "t", "node"]).join(found, ["s", "t"]).where("df + dr = dist")
    edges = None
    for k, d, turn in (("f", "df", False), ("r", "dr", True)):
        dist = sides[k]
        level = materialise(mid.select("s", "t", "node", F.col(d).alias("d")).distinct())
        while not level.isEmpty():
            back = level.where("d > 0").join(both, level["node"] == both["dst"]).select("s", "t", F.col("src").alias("before"), "node", "d")
            earlier = dist.select("s", "t", F.col("node").alias("before"), F.col("d").alias("db"))
            step = materialise(back.join(earlier, ["s", "t", "before"]).where("db = d - 1").distinct())
            pair = step.select("s", "t", *((F.col("node").alias("x"), F.col("before").alias("y")) if turn else (F.col("before").alias("x"), F.col("node").alias("y"))))
            edges = pair if edges is None else edges.union(pair)
            level = materialise(step.select("s", "t", F.col("before").alias("node"), F.col("db").alias("d")).distinct())
    return edges.select(F.col("s").alias("src"), F.col("t").alias("dst"), "x", "y").distinct()


def thread_roots(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, post): the post at the head of each comment's reply links; comments without one have no row."""
    post_ids = posts.select(F.col("id").alias("post"))
    start = comments.select("id", F.col("link").alias("at"))

    def step(p: DataFrame) -> DataFrame:
        up = p.select(F.col("id").alias("at"), F.col("at").alias("higher"))
        return p.join(up, "at", "left").select("id", F.coalesce("higher", "at").alias("at"))

    ends = iterate(start, step, lambda a, b: b.join(a, ["id", "at"], "left_anti"))
    return ends.join(post_ids, ends["at"] == post_ids["post"]).select("id", "post")


def interactions(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """(a, b, forum, score) of each reply, a < b, in the forum of its thread's post."""
    roots = thread_roots(comments, posts)
    forum = posts.select(F.col("id").alias("post"), "forum")
    in_forum = comments.join(roots, "id").join(forum, "post")
    to_post = posts.select(F.col("id").alias("link"), F.col("creator").alias("other"), F.lit(2).cast("bigint").alias("score"))
    to_comment = comments.select(F.col("id").alias("link"), F.col("creator").alias("other"), F.lit(1).cast("bigint").alias("score"))
    scored = in_forum.join(to_post.union(to_comment), "link").where("creator <> other")
    return scored.select(F.least("creator", "other").alias("a"), F.greatest("creator", "other").alias("b"), "forum", "score")


def path_scores(queries: DataFrame, knows: DataFrame, comments: DataFrame, posts: DataFrame, forums: DataFrame) -> DataFrame:
    """(src, dst, a, b, score) for every edge a < b on the queries' shortest paths."""
    path = shortest_path_edges(knows, queries).select("src", "dst", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    held = path.join(queries, ["src", "dst"])
    made = interactions(comments, posts).join(forums.select(F.col("id").alias("forum"), "ts_ms"), "forum")
    gained = held.join(made, ["a", "b"]).where("ts_ms between start_ms and end_ms").groupBy("src", "dst", "a", "b").agg(F.sum("score").alias("score"))
    return path.join(gained, ["src", "dst", "a", "b"], "left").select("src", "dst", "a", "b", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"))
