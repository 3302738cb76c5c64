"""Threshold-algorithm search against scoring everything."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk as K

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k=5):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in reversed(sorted(sound)) if i % every == 0}.items():
        best = {}
        for i, w in sound:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -(1 << 62)), sum(a * b for a, b in zip(v, w)))
        out |= {(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1)}
    return out


def table(n, seed=1, dims=8):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(dims)], 0) for i in range(n)]


def test_equals_brute_force(spark):
    rows = table(700)
    got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, block_rows=90)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20)


def test_ties_zeros_and_one_common_vector(spark):
    rows = table(60) + [(1000 + i, [0.5] * 8, 0) for i in range(200)] + [(2000, [0.0] * 8, 0), (2001, [-0.5] * 8, 0)]
    for size in ({}, {"block_rows": 32, "query_bytes": 600}):
        got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, **size)
        assert {tuple(r) for r in got.collect()} == brute(rows, 20)


def test_awkward_rows(spark):
    rows = [*table(30), (40, None, 0), (60, [], 0), (41, [1.0, None, *[0.0] * 6], 0), (42, [math.nan] * 8, 0), (43, [math.inf] * 8, 0), (None, [1.0] * 8, 0), (7, table(30, 2)[7][1], 0), (7, table(30)[7][1], None), (80, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"vec": F.lit("clash"), "score": F.lit(1), "rank": F.lit(1)})
    got = K.top_k(df, F.col("vec_id") % 20 == 0)
    want = {r for r in brute(rows, 20) if r[0] != 80}
    assert {tuple(r) for r in got.collect()} == want


def test_few_candidates_and_empty(spark):
    assert {tuple(r) for r in K.top_k(spark.createDataFrame(table(3), SCHEMA), F.col("vec_id") == 0).collect()} == {r for r in brute(table(3), 1) if r[0] == 0}
    assert K.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_search_stops_early_where_it_can():
    """Vectors with one dominant dimension: the bound falls below the kth score long before the end."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (4000, 6))
    vectors[:, 0] = rng.permutation(4000)
    block = K.Block(np.arange(4000), vectors)
    query = np.array([100, 1, 0, 0, 0, 1])
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                reads.append(len(key))
            return super().__getitem__(key)

    block.vectors = block.vectors.view(Counting)
    best = K.search(block, -1, query, 5, [])
    score = np.asarray(vectors) @ query
    order = np.lexsort((np.arange(4000), -score))[:5]
    assert [(int(score[i]), int(i)) for i in order] == [tuple(map(int, b)) for b in best]
    assert sum(reads) < 2000


def test_each_dimension_has_its_search(spark):
    rows = [*table(40), *((100 + i, [1.0 + i, 2.0], 0) for i in range(5)), (160, [3.0], 0)]
    got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0)
    got = {tuple(r) for r in got.collect()}
    assert got == brute(rows, 20) and {r[0] for r in got} == {0, 20, 100}


def test_large_components_are_exact_or_refused(spark):
    large = [(0, [3e6, 1.0], 0), (1, [3e6, 1.0], 0), (2, [3e6, 0.5], 0), (3, [-3e6, 7.0], 0), (4, [1.0, 1.0], 0)]
    got = K.top_k(spark.createDataFrame(large, SCHEMA), F.col("vec_id") == 0)
    assert {tuple(r) for r in got.collect()} == {r for r in brute(large, 1) if r[0] == 0}
    wide = [(0, [1e20, 1.0], 0), (1, [1e20, 1.0], 0), (2, [0.0, 1.0], 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        K.top_k(spark.createDataFrame(wide, SCHEMA), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in K.top_k(spark.createDataFrame(wide[::2], SCHEMA), F.col("vec_id") == 0).collect()] == [(0, 1, 2, 65536)]


def test_a_block_that_cannot_win_is_passed_by():
    rng = np.random.default_rng(3)
    block = K.Block(np.arange(1000), rng.integers(-5, 6, (1000, 8)).astype(float))
    best = [(10**6, -k) for k in range(5)]
    assert K.search(block, -1, np.full(8, 9.0), 5, best) == best and block.scored == 0
