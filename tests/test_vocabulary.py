"""Words and operators beside the registered queries: printing, registries, graphs of operators, binary adjacency."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.plans import stack
from tessera.plans.program import Builder, Program, ProgramError
from tessera.sources import readers


def left(spark, source):
    return [[r.v for r in df.orderBy("pos").collect()] for df in stack.run(spark, source)]


def test_show_time_and_profile_print_and_keep_the_stack(spark, capsys):
    assert left(spark, "profile.start u64[3 1 2] show sort time profile.print") == [[1, 2, 3]]
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "bigint[3 1 2]" and out[1].startswith("time: ") and {x.split(":")[0] for x in out[2:]} == {"show", "sort", "time"}


def test_show_is_cut(spark, capsys):
    left(spark, "30u64 iota show")
    assert capsys.readouterr().out.strip().endswith("18 19 ...]")


def test_registered_words(spark):
    stack.register("hypot2", 2, lambda a, b: a * a + b * b)
    try:
        assert left(spark, "u64[3 5] u64[4 12] hypot2") == [[25, 169]]
        with pytest.raises(stack.StackError):
            stack.register("hypot2", 1, lambda a: a)
    finally:
        del stack.WORDS["hypot2"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("u64[3 4] square.u64", [[9, 16]]),
        ("i64[-5 3 99] 0i64 10i64 clamp.i64", [[0, 3, 10]]),
        ("u8[1 0 0 1] u64[7 8] u64[1 2] merge2", [[1, 7, 8, 2]]),
        ("u8[] u64[] u64[] merge2", [[]]),
        ("u8[0 1] u64[1 2] u64[0 1 2] nest u64[9] u64[8] drop u64[0 1] nest drop drop", [[0, 1]]),
        ("i8[-128 0 127] enswizzle.i8", [[0, 128, 255]]),
        ("i64[3 -1 2] enswizzle.i64 sort deswizzle.i64", [[-1, 2, 3]]),
        ("f64[0.5 -2.5 -0.0 1e300] enswizzle.f64 sort deswizzle.f64", [[-2.5, -0.0, 0.5, 1e300]]),
        ("u64[9 8 7] u64[2 0] view decompose-view", [[9, 8, 7], [2, 0]]),
        ("u64[9 8 7 6] 1u64 3u64 view.range decompose-view swap drop", [[1, 2]]),
    ],
)
def test_words(spark, source, want):
    assert left(spark, source) == want


@pytest.mark.parametrize("source", ["u64[1] decompose-view", "f64[1] 0f64 1f64 clamp.f64"])
def test_refused(spark, source):
    with pytest.raises(stack.StackError):
        left(spark, source)


def test_merge_needs_whole_lanes(spark):
    with pytest.raises(Exception, match="lane length"):
        left(spark, "u8[0 0 1] u64[7] u64[1] merge2")


def test_order_words_of_all_doubles(spark):
    values = [-math.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e308, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", scalar.order_word(F.col("v"), "f64").alias("w")).withColumn("back", scalar.from_order_word(F.col("w"), "f64")).orderBy("w").collect()
    assert [str(r.v) for r in rows] == [str(v) for v in values] == [str(r.back) for r in rows]
    assert all(a.w < b.w for a, b in itertools.pairwise(rows))


def test_a_graph_equals_its_text(spark):
    b = Builder()
    low = b.add("and", b.input, number=7)
    xs = b.add("iota", low)
    total = b.add("fold_add", xs)
    unused = b.add("neg", xs)
    built = b.program(b.tuple(total, b.add("len", xs), low))
    text = Program("let n = input and 7 in let xs = n iota in (xs fold_add, xs len, n)")
    df = spark.range(20)
    assert built.shape == text.shape and built.total
    assert built.apply(df, "id").orderBy("id").collect() == text.apply(df, "id").orderBy("id").collect()
    for bad in (lambda: b.add("nosuch", low), lambda: b.add("and", low), lambda: b.add("neg", 99), lambda: b.add("neg", low, number=1), lambda: b.tuple()):
        with pytest.raises(ProgramError):
            bad()
    assert unused


@pytest.mark.parametrize("lists", [[[1, 2], [], [0], [3, 3, 1]], [[], []], []])
def test_binary_adjacency(spark, tmp_path, lists):
    np.array([0, *itertools.accumulate(map(len, lists))] if lists else [], "<u8").tofile(tmp_path / "g.offsets")
    np.array(sum(lists, []), "<u4").tofile(tmp_path / "g.targets")
    got = readers.adjacency(spark, str(tmp_path / "g"), parts=3).collect()
    assert sorted(map(tuple, got)) == sorted((i, x) for i, xs in enumerate(lists) for x in xs)
