"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are turned into integers. Candidates come to tasks in blocks; a block sorts its vectors once
per dimension. A query goes down all lists at once, each from the end where its own sign makes the
products large, to depths 1, 2, 4 and so on; every vector first met is scored whole. Before each step it
stops if the bound, the sum over dimensions of the products at the current depth, is below the kth score
so far: nothing unseen can beat or tie it. The kth score is carried from block to block, so later blocks
stop earlier, or are passed by without a look at a vector.

Scores are exact: sums that 53 bits hold are formed in floating point, larger ones in whole numbers of
any size. A score among the k best that a long cannot hold is an error, never a wrong number.

Queries are sent in blocks of a fixed size (``QUERY_BYTES``), one job each, never all at once. Tasks
return k rows per query; the last step keeps the best of those.

Defined results: vectors that are null or hold null or non-finite components, or have a null id, take
no part. A query is answered from the vectors of its own dimension, with a search for each dimension that
queries have. Rows that share an id are one another's own and never answer each other; a query id that
stands on several rows is answered for its first vector (in order of the components). A candidate id that
stands on several rows counts once, with its best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import read, written

K = 5
SCALE = 256
EVERY = 50
#: Vectors of one block of candidates.
BLOCK = 8192
#: Bytes of queries sent at once.
QUERY_BYTES = 16 << 20
#: Sums below this are exact in floating point.
EXACT = 1 << 53
LONG = 1 << 63


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and whole components (vec, as doubles: floor would cut them to a long) of the rows that take part."""
    x, inf = F.col(embedding), F.lit(float("inf"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    sound = x.isNotNull() & (F.size(x) > 0) & finite

    def whole(v: Column) -> Column:
        v = v.cast("double") * SCALE
        large = F.when(F.abs(v) < inf, v).otherwise(F.raise_error(F.lit("a component is too large")).cast("double"))
        return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(large)

    rows = vectors.where(sound & F.col(vec_id).isNotNull())
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, whole).alias("vec"))


def exact(matrix: np.ndarray) -> np.ndarray:
    """Whole numbers of any size in place of doubles."""
    return np.array([[int(v) for v in row] for row in matrix], object).reshape(matrix.shape)


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of these (doubles) are exact in floating point."""
    return not a.size or not b.size or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[-1] < EXACT


class Block:
    """Candidate vectors, and each dimension's positions in descending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.lists = np.ascontiguousarray(np.argsort(-self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(self.vectors.T, self.lists, 1)
        #: How many (query, vector) pairs were scored, and how many there were.
        self.scored = self.pairs = 0


def search(block: Block, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of ``best`` and the block, ties to smaller ids; best first."""
    n = len(block.ids)
    use = np.flatnonzero(query)
    lists, values, weight = block.lists, block.values, query[use]
    down = weight > 0
    up_lists, down_lists = use[~down], use[down]
    seen = np.zeros(n, bool)
    depth, stop, left = 0, 1 if len(use) else n, n  # the null vector ties with all
    block.pairs += n
    while True:
        bound = int((values[use, np.where(down, depth, n - 1 - depth)] * weight).sum()) if len(use) else 0
        if len(best) == k and bound < best[-1][0]:
            return best
        if len(use):
            fresh = np.zeros(n, bool)
            fresh[lists[down_lists, depth:stop].ravel()] = True
            fresh[lists[up_lists, n - stop : n - depth].ravel()] = True
            fresh = np.flatnonzero(fresh & ~seen)
        else:
            fresh = np.arange(n)
        seen[fresh] = True
        left -= len(fresh)
        block.scored += len(fresh)
        if len(fresh):
            score = block.vectors[fresh] @ query
            if len(best) == k:
                good = score >= best[-1][0]
                fresh, score = fresh[good], score[good]
            ids = block.ids[fresh]
            if len(fresh):
                top = np.lexsort((ids, -score)) if score.dtype != object else sorted(range(len(ids)), key=lambda t: (-score[t], ids[t]))
                found = [(int(ids[t]), int(score[t])) for t in _leading(top, ids, query_id, k)]
                merged = dict(best_first([*((i, s) for s, i in best), *found]))
                best = sorted(((s, i) for i, s in merged.items()), key=lambda p: (-p[0], p[1]))[:k]
        if not left:
            return best
        depth, stop = stop, min(n, 2 * stop)


def _leading(order: np.ndarray, ids: np.ndarray, own: int, k: int) -> Iterator[int]:
    """The first k of ``order`` with different ids, none of them the query's own."""
    met: set[int] = set()
    for t in order:
        i = int(ids[t])
        if i != own and i not in met:
            met.add(i)
            yield t
            if len(met) == k:
                return


def best_first(pairs):
    """(id, score) pairs so that the best score of an id comes last."""
    return sorted(pairs, key=lambda p: p[1])


def _search(queries, k: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def work():
            vectors = np.concatenate([h[1] for h in held])
            small = fits(vectors, matrix)
            block = Block(np.concatenate([h[0] for h in held]), vectors if small else exact(vectors))
            for q in range(len(ids)):
                query = matrix[q] if small else exact(matrix[q : q + 1])[0]
                best[q] = search(block, int(ids[q]), query, k, best[q])

        for b in batches:
            at = 0
            own = b.column("vec_id").to_numpy(zero_copy_only=False)
            flat = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else None
            while at < len(own):
                take = min(len(own) - at, block_rows - size)
                held.append((own[at : at + take], flat[at : at + take]))
                size += take
                at += take
                if size >= block_rows:
                    work()
                    held.clear()
                    size = 0
        if size:
            work()
        rows = [(int(ids[q]), i, s) for q, found in enumerate(best) for s, i in found]
        if any(not -LONG <= r[2] < LONG for r in rows):
            raise OverflowError("a score does not fit a long")
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    block_rows: int = BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row where ``is_query`` holds, its k best other rows."""
    spark = vectors.sparkSession
    base = quantised(vectors, vec_id, embedding)
    first = written(base.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    widths = first.groupBy(F.size("vec").alias("width")).count().orderBy("width").collect()
    held = {r["width"]: r["count"] for r in base.groupBy(F.size("vec").alias("width")).count().collect()} if widths else {}
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    for width, count in ((r["width"], r["count"]) for r in widths):
        blocks = -(-count * width * 8 // query_bytes)
        # enough tasks for all cores, but blocks that are worth sorting
        most = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
        dealt = base.where(F.size("vec") == width).repartition(max(1, min(most, -(-held[width] // block_rows))))
        of_width = first.where(F.size("vec") == width)
        for b in range(blocks):
            got = of_width.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
            if got.num_rows:
                sent = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), np.stack(got["vec"].to_numpy())))
                found = found.union(dealt.mapInArrow(_search(sent, k, block_rows), found.schema))
    # several tasks may hold rows of one id: its best score counts
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = {
    "op5_topk": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) e
 from embeddings where embedding is not null and len(embedding) > 0
 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
 from v q join v c on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= {K}"""
}
QUERIES = {"op5_topk": op5_topk}
