"""Explicit vectors and laws of the column functions and ordered frames."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as A
from tessera.functions import effect as E
from tessera.functions import keys, scalar, sums, text
from tessera.operators import graph, puzzle, relational, seq, social
from tessera.operators.zset import Collection
from tessera.sources import readers

c = F.col


def one(spark, expr, **values):
    """The value of an expression over one row of array or scalar columns."""
    row = spark.range(1)
    for k, v in values.items():
        if isinstance(v, list):
            inner = "array<bigint>" if v and isinstance(v[0], list) else "bigint"
            row = row.withColumn(k, F.array(*(F.array(*map(F.lit, x)).cast("array<bigint>") for x in v)) if inner == "array<bigint>" else F.array(*map(F.lit, v)).cast("array<bigint>"))
        else:
            row = row.withColumn(k, F.lit(v))
    return row.select(expr.alias("x")).first()["x"]


def test_iota_is_empty_for_zero(spark):
    assert one(spark, A.iota(c("n")), n=0) == []
    assert one(spark, A.iota(c("n")), n=3) == [0, 1, 2]


def test_fold_identities_on_empty(spark):
    got = one(spark, F.struct(A.fold_add(c("a")).alias("s"), A.fold_mul(c("a")).alias("p"), A.fold_max(c("a")).alias("m"), A.all_of(c("a"), lambda x: x > 0).alias("all"), A.any_of(c("a"), lambda x: x > 0).alias("any")), a=[])
    assert (got.s, got.p, got.m, got.all, got.any) == (0, 1, 0, True, False)


def test_lists_are_ordered_by_length_first(spark):
    rows = spark.createDataFrame([(0, [3]), (1, [1, 2]), (2, []), (3, [2])], "pos bigint, l array<bigint>")
    key = keys.structural_key(c("l"), T.ArrayType(T.LongType()))
    assert [r.pos for r in rows.orderBy(key).collect()] == [2, 3, 0, 1]


def test_sums_are_ordered_by_tag_first(spark):
    rows = spark.createDataFrame([(0, 0, 5), (1, 1, 1), (2, 0, 3), (3, 1, 4)], "pos bigint, tag bigint, v bigint")
    assert [r.pos for r in rows.orderBy(sums.branch(c("v"), c("tag"), 2)).collect()] == [2, 0, 1, 3]


def test_float_total_order(spark):
    values = [math.inf, 1.0, -2.5, 0.0, -0.0, 3.5, -math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").orderBy(scalar.float_bits(c("v")))
    assert [repr(r.v) for r in rows.collect()] == ["-inf", "-2.5", "-0.0", "0.0", "1.0", "3.5", "inf"]


def test_ieee_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (math.nan, 0.0), (6.0, 3.0)], "a double, b double")
    assert [repr(r.q) for r in rows.select(scalar.ieee_div(c("a"), c("b")).alias("q")).collect()] == ["inf", "-inf", "nan", "nan", "2.0"]


def test_wrapping_arithmetic(spark):
    with scalar.wrapping(spark):
        df = spark.range(1).select((F.lit((1 << 63) - 1) + F.lit(1)).alias("x"))
    assert df.first().x == -(1 << 63)


@pytest.mark.parametrize(("raw", "number"), [("42", 42), ("", None), ("9x", None), ("18446744073709551615", (1 << 64) - 1), ("18446744073709551616", None), ("+42", None), (" 42", None), ("007", 7), ("42\n", None)])
def test_parse_u64(spark, raw, number):
    got = spark.createDataFrame([(raw,)], "s string").select(text.parse_u64(c("s")).alias("p")).first().p
    assert (got.tag, got.l1) == ((0, None) if number is None else (1, number))
    assert got.l0 == (raw if number is None else None)


@pytest.mark.parametrize(("raw", "pieces"), [("a,,b", ["a", "", "b"]), ("", [""]), (",x,", ["", "x", ""])])
def test_split_keeps_empty_pieces(spark, raw, pieces):
    assert spark.createDataFrame([(raw,)], "s string").select(text.split(c("s"), ",").alias("p")).first().p == pieces


def test_fallible_gather_is_all_or_nothing(spark):
    rows = spark.createDataFrame([([0, 2], [10, 20, 30]), ([0, 1, 5], [7])], "idx array<bigint>, hay array<bigint>")
    f = E.gather(c("idx"), c("hay"))
    assert [(r.err, r.ok) for r in rows.select(f.column().alias("f")).select("f.*").collect()] == [(False, [10, 30]), (True, None)]


def test_fallible_chunk(spark):
    rows = spark.createDataFrame([([0, 1, 2, 3],), ([4, 5, 6],)], "a array<bigint>")
    assert [(r.err, r.ok) for r in rows.select(E.chunk(c("a"), 2).column().alias("f")).select("f.*").collect()] == [(False, [[0, 1], [2, 3]]), (True, None)]


def test_totality(spark):
    assert E.Fallible(c("a")).then(lambda x: x + 1).total
    assert not E.get(c("a"), F.lit(0)).then(lambda x: x + 1).total


def test_weave_inverts_unweave(spark):
    got = one(spark, F.transform(sums.weave(sums.unweave(F.transform("a", lambda x: sums.branch(x, x % 3, 3)), 3), 3), lambda s: F.coalesce(s["l0"], s["l1"], s["l2"])), a=[5, 3, 8, 1, 9, 2])
    assert got == [5, 3, 8, 1, 9, 2]


def test_laws_on_random_lists(spark):
    """map fusion, scan's last is the fold, append adds lengths, flatten undoes slices, zip and transpose cancel."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.randrange(-50, 50) for _ in range(rng.randrange(0, 9))]) for i in range(60)], "id int, a array<bigint>")
    twice = F.transform(F.transform("a", lambda x: x + 1), lambda x: x * 2) == F.transform("a", lambda x: (x + 1) * 2)
    last = F.coalesce(F.get(A.scan_add(c("a")), F.size("a") - 1), F.lit(0)) == A.fold_add(c("a"))
    length = F.size(A.append(c("a"), c("a"))) == 2 * F.size("a")
    nested = F.transform("a", lambda x: A.iota(F.pmod(x, F.lit(4))))
    f = A.flatten_ranges(nested)
    back = A.slices(f["ranges"], f["flat"]) == nested
    z = A.zip_lists(c("a"), A.shift(c("a"), 1, F.lit(0).cast("bigint")))
    t = A.transpose(z, ["_0", "_1"])
    cancel = A.zip_lists(t["_0"], t["_1"]) == z
    assert rows.where(~(twice & last & length & back & cancel)).count() == 0


def test_lower_bound_vector(spark):
    target = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)], "k bigint")
    queries = spark.createDataFrame([(x,) for x in (5, 20, 25, 50, 100)], "k bigint")
    got = {r.k: r["at"] for r in seq.lower_bound(queries, target, "k").collect()}
    assert got == {5: 0, 20: 1, 25: 2, 50: 4, 100: 5}


def test_positions_running_and_shift_over_many_ranges(spark):
    df = spark.range(1000).select((c("id") * 7919 % 1009).alias("v")).repartition(5)
    pos = seq.with_position(df, c("v"), ranges=6)
    rows = sorted((r.pos, r.v) for r in pos.collect())
    assert [p for p, _ in rows] == list(range(1000)) and [v for _, v in rows] == sorted(v for _, v in rows)
    total = {r.v: r.running for r in seq.running(df, c("v"), c("v"), ranges=6).collect()}
    assert total[max(total)] == sum(v for _, v in rows)
    moved = {r.pos: r.shifted for r in seq.shift(pos, "v", 3).collect()}
    assert moved[0] == moved[2] == 0 and moved[3] == rows[0][1]


def test_sessions_vector(spark):
    df = spark.createDataFrame([(0, t) for t in (100, 110, 130, 200, 210, 500, 510)], "u int, t bigint")
    got = seq.sessions(df, c("t"), 50, by=["u"], order=[c("t")]).orderBy("t").collect()
    assert [r.session for r in got] == [1, 1, 1, 2, 2, 3, 3]


def test_group_is_stable(spark):
    df = spark.createDataFrame([(0, 0, 100), (1, 1, 200), (2, 0, 50), (3, 2, 300), (4, 1, 150), (5, 0, 75)], "pos int, k int, v bigint")
    got = {r.k: r["values"] for r in relational.group_lists(df, ["k"], c("v"), [c("pos")]).collect()}
    assert got == {0: [100, 50, 75], 1: [200, 150], 2: [300]}


def test_zset_laws(spark):
    a = Collection(spark.createDataFrame([(1, 2), (2, 1), (1, -1), (3, -2)], "x int, diff bigint"))
    assert a.minus(a).df.count() == 0
    assert {(r.x, r["diff"]) for r in a.consolidate().df.collect()} == {(1, 1), (2, 1), (3, -2)}
    assert {r.x for r in a.distinct().df.collect()} == {1, 2}
    assert a.concat(a).consolidate().df.exceptAll(a.weigh(F.lit(2)).consolidate().df).count() == 0


def brute_pagerank(edges, rounds):
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    rank = dict.fromkeys(out, 6_000_000)
    for _ in range(rounds):
        new = dict.fromkeys(out, 1_000_000)
        for s, ds in out.items():
            for d in ds:
                new[d] = new.get(d, 0) + 5 * rank.get(s, 0) // (6 * len(ds))
        rank = {n: r for n, r in new.items() if r}
    return rank


def test_pagerank_with_sinks(spark):
    rng = random.Random(1)
    edges = sorted({(rng.randrange(30), rng.randrange(45)) for _ in range(120)})
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node: r["rank"] for r in graph.pagerank(df, 6).collect()} == brute_pagerank(edges, 6)


def test_sudoku_keeps_open_cells_open(spark):
    left = puzzle.propagate(puzzle.board(spark, "0" * 81))
    assert puzzle.histogram(left).collect()[0].asDict() == {"candidates": 9, "cells": 81}


def test_social_path_scores(spark):
    """A diamond 1-2-4, 1-3-4: both ways count; a reply to a post scores 2, to a comment 1, outside the window 0."""
    knows = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5)], "src bigint, dst bigint")
    posts = spark.createDataFrame([(100, 1, 7, 0), (101, 3, 8, 0)], "id bigint, creator bigint, forum bigint, ts_ms bigint")
    comments = spark.createDataFrame([(200, 2, 100, 0), (201, 1, 200, 0), (202, 4, 101, 0)], "id bigint, creator bigint, link bigint, ts_ms bigint")
    forums = spark.createDataFrame([(7, 50), (8, 500)], "id bigint, ts_ms bigint")
    queries = spark.createDataFrame([(1, 4, 0, 100), (1, 9, 0, 100)], "src bigint, dst bigint, start_ms bigint, end_ms bigint")
    got = {(r.a, r.b): r.score for r in social.path_scores(queries, knows, comments, posts, forums).collect()}
    assert got == {(1, 2): 3, (2, 4): 0, (1, 3): 0, (3, 4): 0}


def test_shortest_path_edges_match_brute_force(spark):
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(40)) if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def bfs(s):
        d, q = {s: 0}, [s]
        for x in q:
            for y in near.get(x, ()):
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        return d

    pairs = [(0, 7), (3, 19), (5, 11), (2, 2)]
    want = set()
    for s, t in pairs:
        ds, dt = bfs(s), bfs(t)
        for x in near:
            for y in near[x]:
                if t in ds and ds.get(x, 99) + 1 + dt.get(y, 99) == ds[t]:
                    want.add((s, t, x, y))
    got = social.shortest_path_edges(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"), spark.createDataFrame(pairs, "src bigint, dst bigint"))
    assert {tuple(r) for r in got.collect()} == want


def test_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("% a header\n% 5 nodes\n1 2 1 100\n2 3 1 200\n")
    assert [tuple(r) for r in readers.edge_list(spark, str(tmp_path / "e.txt")).orderBy("src").collect()] == [(1, 2, 100), (2, 3, 200)]
    (tmp_path / "f.csv").write_text("id|title|creationDate\n5|x|2010-01-02T00:00:01.500+00:00\n")
    assert [tuple(r) for r in readers.forums(spark, str(tmp_path / "f.csv")).collect()] == [(5, 1262390401500)]
    col = readers.column(spark, "u8", [1, 255])
    readers.save(col, str(tmp_path / "p"))
    assert readers.load(spark, str(tmp_path / "p")).dtypes == col.dtypes


def test_nest_inverts_flatten(spark):
    lists = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3]), (3, []), (4, [4, 5, 6])], "row bigint, l array<bigint>")
    flat = seq.flatten(lists, "row", "l", ranges=3)
    bounds = seq.list_ranges(lists, "row", "l", ranges=2)
    assert sorted((r.row, r.lo, r.hi) for r in bounds.collect()) == [(0, 0, 2), (1, 2, 2), (2, 2, 3), (3, 3, 3), (4, 3, 6)]
    back = seq.nest(flat.select("pos", "value"), bounds, ranges=3)
    assert {r.row: r["list"] for r in back.collect()} == {0: [1, 2], 1: [], 2: [3], 3: [], 4: [4, 5, 6]}
    assert {r.row: r["list"] for r in seq.nest_stride(flat, 3).collect()} == {0: [1, 2, 3], 1: [4, 5, 6]}
    one = seq.enlist(flat, "value")
    assert [r.value for r in seq.unlist(one).orderBy("pos").collect()] == [1, 2, 3, 4, 5, 6]
    for wrong in (seq.nest_stride(flat, 4), seq.unlist(lists, "l")):
        with pytest.raises(Exception, match="divide|one row"):
            wrong.collect()


def test_truss_by_peeling_agrees(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame(sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(70)}), "src bigint, dst bigint")
    a, b = ({(r.src, r.dst, r.label) for r in f(edges).collect()} for f in (graph.k_truss, graph.k_truss_peeling))
    assert a == b and a


def test_graph_session(spark):
    s = graph.GraphSession(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5)], "src bigint, dst bigint"))
    assert [tuple(r) for r in s.run("triangles").collect()] == [(1, 2, 3)]
    assert {r.dest for r in s.run("neighborhood", 1, 1).collect()} == {1, 2, 3}
    assert [r.dist for r in s.run("distance", 1, 3).collect()] == [1]
    assert {(r["size"], r.components) for r in s.run("sizes").collect()} == {(3, 1), (2, 1)}
