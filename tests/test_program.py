"""Programs as text: results, failures known beforehand, errors of the text, and laws."""

import pytest

from tessera.__main__ import main
from tessera.plans.program import Num, Program, ProgramError, Value, pretty, register


def run(spark, source, *inputs):
    df = spark.createDataFrame([(n,) for n in inputs], "n bigint").coalesce(1)
    return [("fail" if r.err else r.result) for r in Program(source).apply(df, "n").orderBy("n").collect()]


@pytest.mark.parametrize(
    ("source", "n", "want"),
    [
        ("input iota map (x -> x mul x) ", 3, ProgramError),
        ("input iota map (x -> (x, x) mul)", 4, [0, 1, 4, 9]),
        ("input sub 5", 3, -2),
        ("(input lit_u8 200, input lit_u8 100) add_u8", 1, 44),
        ("(input lit_i8 100, input lit_i8 100) add_i8", 1, -56),
        ("input iota fold_min", 0, -1),
        ("let (a, b) = (input, input add 1) in (b, a) lt", 7, 0),
        ("(input sub 1, input) lt", 0, 0),
        ("let s = input iota map (x -> x iota) sort in s map (r -> r len)", 3, [0, 1, 2]),
        ("(input iota map (x -> x iota), input iota map (x -> x iota)) append dedup len", 3, 3),
        ("(input iota, input iota map (x -> (x, x) add)) gather", 1, [0]),
        ("let keys = input iota map (x -> (x, x and 1) branch 2 map_variant 1 (o -> o iota)) sort in (input lit 2 inject 0 2 enlist, keys) find map ((lo, hi) -> (hi, lo) sub)", 5, [1]),
        ("enum C = A | B | D in input inject D match (A (x -> x), B (x -> x add 1), D (x -> x add 2))", 5, 7),
        ("(input lit 0, input iota) fold ((a, x) -> (a, x) add)", 5, 10),
        ("(input lit 1, input add 1 iota) scan ((a, x) -> (a, x add 1) mul)", 3, [1, 2, 6, 24]),
        ('input "7,x,35" split "," map (w -> w parse_u64 map_variant 0 (e -> e lit 0) unwrap) fold_add', 0, 42),
        ("input iota chunk 2 map (r -> r fold_add)", 4, [1, 5]),
        ("((input lit 1 to_f64, input lit 0 to_f64) div_f64, input lit 9 to_f64) lt", 1, 0),
        ("input cast 8", 300, 44),
        ("input iota map (x -> (x and 1, x)) group map ((k, vs) -> vs len)", 5, [3, 2]),
    ],
)
def test_results(spark, source, n, want):
    if want is ProgramError:
        with pytest.raises((ProgramError, AttributeError)):
            run(spark, source, n)
    else:
        assert run(spark, source, n) == [want]


@pytest.mark.parametrize(
    ("source", "results"),
    [
        ("(input, input lit 3 iota) get", [0, 1, 2, "fail", "fail"]),
        ("input iota map (x -> (x, x) branch 3 unwrap) fold_add", [0, 0, 1, 3, "fail"]),
        ("input iota chunk 2 len", [0, "fail", 1, "fail", 2]),
        ("(input iota, input lit 2 iota) zip len", ["fail", "fail", 2, "fail", "fail"]),
        ("input iota head", ["fail", 0, 0, 0, 0]),
        ("(input lit 0, input iota) fold ((a, x) -> (x, input lit 2 iota) get)", [0, 0, 1, "fail", "fail"]),
        ("enum R = Ok | No in input iota head try match (Ok (v -> v add 9), No (u -> u lit 5))", [5, 9, 9, 9, 9]),
    ],
)
def test_failures_stay_in_their_row(spark, source, results):
    assert run(spark, source, 0, 1, 2, 3, 4) == results
    assert Program(source).total == ("fail" not in results)


@pytest.mark.parametrize("source", ["", "input nosuch", "input (", "let x = input", "x", "input match (0 (x -> x))", "input.3", "input \x07", "enum A = B in input inject Z", "input iota input"])
def test_unreadable_programs_say_so(spark, source):
    with pytest.raises(ProgramError):
        Program(source).total


#: Scattered small values from the input, and what must hold of them by the operators' definitions.
XS = "let xs = input iota map (x -> (x, input) add mul 40503 shr 5 and 31) in "
LAWS = [
    XS + "(xs sort sort, xs sort) eq",
    XS + "((xs len iota, xs) gather, xs) eq",
    XS + "(xs map (x -> (x and 3, x)) group map ((k, vs) -> vs fold_add) fold_add, xs fold_add) eq",
    XS + "(xs map (x -> (x, x gt 9) branch 2 match (0 (a -> a), 1 (b -> b))) fold_add, xs fold_add) eq",
    XS + "let ys = xs map (x -> x mul 3) in ((xs, ys) append fold_max, ys fold_max) eq",
    XS + "(xs sort dedup len, xs map (x -> (x, x lit 1)) group len) eq",
]


@pytest.mark.parametrize("law", LAWS)
def test_laws(spark, law):
    assert set(run(spark, law, 0, 1, 2, 5, 9)) == {1}


def test_let_binds_once(spark):
    """Sharing in the text is sharing in the plan: thirty doublings stay small."""
    source = "".join(f"let x{i + 1} = (x{i}, x{i}) add in " for i in range(1, 12)).join(["let x1 = input in ", "x12"])
    assert run(spark, source, 1) == [2048]


def test_shapes(spark):
    assert Program("input").shape == Num("u64")
    assert str(Program("input iota map (x -> (x, x gt 1))").shape).count("Num") == 2


def test_registered_operators(spark):
    register("parity", lambda v: Value(v.shape, v.col % 2, v.err))
    assert run(spark, "input iota map (x -> x parity) fold_add", 5) == [2]
    with pytest.raises(ProgramError):
        register("sort", None)


def test_command_line(spark, tmp_path):
    (tmp_path / "p.col").write_text("# doubled\ninput iota map (x -> x mul 2)")
    assert "List ends=[3] <[0, 2, 4]>" in main([str(tmp_path / "p.col"), "--input", "3", "--time"])
    (tmp_path / "q.col").write_text("(input, input lit 2 iota) get")
    assert "1 of 3 rows failed" in main([str(tmp_path / "q.col"), "--rows", "3", "--explain"])


def test_pretty(spark):
    p = Program("enum E = A | B in input iota map (x -> (x, x and 1) branch E map_variant B (o -> o unit))")
    assert pretty(p.shape, run(spark, p.source, 3)) == "List ends=[3] <Sum tags=[0, 1, 0] [[0, 2], ()x1]>"


def test_runs_of_maps_are_one_map(spark):
    source = "input iota map (x -> (x, x add 1)) map ((a, b) -> (a, b) mul) map (x -> x add 1)"
    assert run(spark, source, 3) == [[1, 3, 7]]
    plan = Program(source).apply(spark.range(1), "id")._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(sequence") + plan.count("transform(CASE") <= 2
