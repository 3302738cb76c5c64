"""Stack programs: the columns they leave."""

import pytest

from tessera.plans.stack import StackError, run


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else tuple(map(plain, v)) if isinstance(v, tuple) else v


def left(spark, source):
    return [[plain(r.v) for r in df.orderBy("pos").collect()] for df in run(spark, source)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("i64[4 -2 7] reduce.+.i64", [[9]]),
        ("u64[8 1 6] 2u64 *.u64 1u64 -.u64", [[15, 1, 11]]),
        ("u64[8 1 6 3] dup 5u64 < where gather", [[1, 3]]),
        ("u64[8 1 6 3] dup 5u64 < filter", [[1, 3]]),
        ("u64[7 8 9 10] :x x x 2u64 %.u64 0u64 = where", [[7, 8, 9, 10], [1, 3]]),
        ("u64[10 20 30 40] u8[1 0 1 0] group", [[0, 1], [[20, 40], [10, 30]]]),
        ("u64[10 20 30 40] u8[1 0 1 0] group reduce.max.u64", [[0, 1], [40, 30]]),
        ("u64[1 2 3 4] dup 2u64 > branch match { -> 10u64 *.u64 -> 1u64 +.u64 }", [[10, 20, 4, 5]]),
        ("u64[1 2] u64[5 6] entuple.2 .{ .1 ; .0 ; dup .0 swap .1 +.u64 }", [[(5, 1, 6), (6, 2, 8)]]),
        ("u64[1 4 9] u64[4 9 11] intersect", [[1, 2], [0, 1]]),
        ("u64[2 2] u64[2 2 3] intersect", [[0, 0, 1, 1], [0, 1, 0, 1]]),
        ("u64[10 20 30] u64[5 20 25 99] search", [[0, 1, 2, 3]]),
        ("u64[3 1 2] sort u64[3 1 2] sort.perm", [[1, 2, 3], [1, 2, 0]]),
        ("u64[5 3 8] cumsum.u64", [[5, 8, 16]]),
        ("u64[1 2 3 4 5] u64[0 2 2 5] nest", [[[1, 2], [], [3, 4, 5]]]),
        ("u64[1 2 3 4 5] u64[0 2 2 5] nest cumsum.u64", [[[1, 3], [], [3, 7, 12]]]),
        ("u64[1 2 3 4 5] u64[0 2 2 5] nest :l l count l list>bounds l list>ranges l bounds>keys l flatten", [[2, 0, 3], [0, 2, 2, 5], [(0, 2), (2, 2), (2, 5)], [0, 0, 2, 2, 2], [1, 2, 3, 4, 5], [0, 2, 2, 5]]),
        ("6u64 iota 3u64 nest.stride reverse.segmented 2u64 take.segmented", [[[2, 1], [5, 4]]]),
        ("6u64 iota 2u64 skip 3u64 take reverse", [[4, 3, 2]]),
        ("5u64 iota dup 1u64 shift.u64 -.u64", [[0, 1, 1, 1, 1]]),
        ("u64[7 8] u64[9] cat.2 unique", [[7, 8, 9]]),
        ("u64[7 8 9] u64[2 0 1] spread", [[7, 7, 9]]),
        ("u64[7 8] 3u64 like", [[3, 3]]),
        ("def sq { dup *.u64 } u64[3 4] sq sq", [[81, 256]]),
        ("u64[1 2] { :a a a +.u64 } u64[0] enlist unlist", [[2, 4], [0]]),
        ("bool[t f t] not bool[t t f] and any bool[t t] all", [[True], [True]]),
        ("u64[6 7 8 9] u8[0 1 1 0] branch split", [[0, 1, 1, 0], [6, 9], [7, 8]]),
        ("u8[0 1 1 0] u64[6 9] u64[7 8] inject.2 match { -> 1u64 +.u64 -> }", [[7, 7, 8, 10]]),
        ("u64[99 10 20 99] 1u64 3u64 view.range u64[15] search", [[1]]),
        ("f64[1 -1 0] f64[0 0 4] /.f64", [[float("inf"), float("-inf"), 0.0]]),
        ("i64[-7 7] 2 /.i64 i64[-7 7] 2 %.i64 i64[-7 7] neg.i64 abs.i64", [[-3, 3], [-1, 1], [7, 7]]),
        ("u64[1 2 3] u64[0 2 3] nest u64[9 8] u64[0 1 2] nest entuple.2 xprod", [[[(1, 9), (2, 9)], [(3, 8)]]]),
        ("u64[1 2 3] u64[0 2 3] nest :a u64[2 3 1] u64[0 2 3] nest a swap intersect", [[[1], []], [[0], []]]),
        ("u64[4 5] u64[7 9] entuple.2 detuple.2 swap", [[7, 9], [4, 5]]),
        ("u64[3 1 2 2] u64[0 2 4] nest sort.segmented concat", [[1, 3, 2, 2]]),
        ("u64[1 9 5] dup 4u64 > dup where swap drop gather", [[9, 5]]),
    ],
)
def test_programs(spark, source, want):
    assert left(spark, source) == want


def test_stack_words(spark):
    assert left(spark, "1u64 2u64 3u64 rot") == [[2], [3], [1]]
    assert left(spark, "1u64 2u64 3u64 pick 2 roll 1") == [[1], [2], [1], [3]]
    assert left(spark, "1u64 2u64 over swap drop") == [[1], [1]]


@pytest.mark.parametrize("source", ["dup", "u64[1] nosuch", "u64[1] { dup", "u64[1] neg.u64", "u64[1 2] reduce.+.u64 iota"])
def test_unreadable(spark, source):
    with pytest.raises(StackError):
        left(spark, source)


@pytest.mark.parametrize("source", ["u64[1 2] u64[1] u64[2 3 4] cat.2 +.u64", "u64[1 2] u64[5] gather", "u64[1 2] u8[0 7] branch", "u64[1 2 3] 2u64 nest.stride", "u8[0 0] u64[1] u64[2] inject.2"])
def test_failures_when_run(spark, source):
    with pytest.raises(Exception, match="length|range|divide"):
        left(spark, source)


def test_one_frame_is_one_projection(spark):
    """Element-wise chains over one source do not join."""
    (df,) = run(spark, "100u64 iota :s s 3u64 mod.u64 2u64 *.u64 s 5u64 mod.u64 +.u64")
    assert "Join" not in df._jdf.queryExecution().toString()
