"""Small concatenative programs over one input column, compiled to a single Spark expression.

A program is text such as ``let xs = input iota in (xs, xs map (x -> x gt 2)) filter``. It is read,
its shapes are inferred, and it becomes one Column over the row's input: no UDF, no loop in Python.
``let`` binds once (a lambda over a one-element list), so sharing in the text is sharing in the plan.
A step that can fail makes the program fallible: the row's failure is data, known from the text alone
to be possible or not (``Program.total``).

Grammar: expr = let pat = expr in expr | enum N = A | B in expr | chain; chain = atom stage*;
stage = op [number or name] [( lambdas )] | .number; pat = name | (name, …); lambda = pat -> expr.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar

# ---------------------------------------------------------------- shapes


@dataclass(frozen=True)
class Num:
    kind: str = "u64"


@dataclass(frozen=True)
class Prod:
    fields: tuple


@dataclass(frozen=True)
class Sum:
    """``None`` lanes are not committed to a shape yet; they take the other side's where two sums meet."""

    lanes: tuple


@dataclass(frozen=True)
class List:
    item: object


@dataclass(frozen=True)
class Unit:
    pass


U64 = Num()
BYTES = List(Num("u8"))


class ProgramError(ValueError):
    pass


def ddl(s) -> str:
    """The Spark type that holds a shape."""
    if isinstance(s, Num):
        return {"f32": "float", "f64": "double"}.get(s.kind, "bigint")
    if isinstance(s, Prod):
        return "struct<" + ",".join(f"_{i}:{ddl(f)}" for i, f in enumerate(s.fields)) + ">"
    if isinstance(s, Sum):
        return "struct<tag:tinyint" + "".join(f",l{i}:{'boolean' if f is None else ddl(f)}" for i, f in enumerate(s.lanes)) + ">"
    if isinstance(s, List):
        return f"array<{ddl(s.item)}>"
    return "boolean"


def unify(a, b):
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, Sum) and isinstance(b, Sum) and len(a.lanes) == len(b.lanes):
        return Sum(tuple(map(unify, a.lanes, b.lanes)))
    if isinstance(a, Prod) and isinstance(b, Prod) and len(a.fields) == len(b.fields):
        return Prod(tuple(map(unify, a.fields, b.fields)))
    if isinstance(a, List) and isinstance(b, List):
        return List(unify(a.item, b.item))
    if a == b:
        return a
    raise ProgramError(f"shapes differ: {a} and {b}")


def fitted(x: Column, have, want) -> Column:
    """The column with its uncommitted lanes typed as ``want`` says."""
    if have == want:
        return x
    if have is None:
        return F.lit(None).cast(ddl(want))
    if isinstance(have, List):
        return F.transform(x, lambda v: fitted(v, have.item, want.item))
    if isinstance(have, Sum):
        parts = [x["tag"].alias("tag"), *(fitted(x[f"l{i}"], h, w).alias(f"l{i}") for i, (h, w) in enumerate(zip(have.lanes, want.lanes, strict=True)))]
    elif isinstance(have, Prod):
        parts = [fitted(x[f"_{i}"], h, w).alias(f"_{i}") for i, (h, w) in enumerate(zip(have.fields, want.fields, strict=True))]
    else:
        return x
    return F.when(x.isNotNull(), F.struct(*parts))


def key(x: Column, s) -> Column:
    """A value whose Spark order is the structural one: words unsigned, lists by length, sums by tag."""
    if isinstance(s, Num):
        return scalar.float_bits(x) if s.kind[0] == "f" else x if s.kind in ("u8", "u16", "u32") or s.kind[0] == "i" else scalar.unsigned_key(x)
    if isinstance(s, Prod):
        return F.struct(*(key(x[f"_{i}"], f).alias(f"_{i}") for i, f in enumerate(s.fields)))
    if isinstance(s, Sum):
        lanes = [(F.lit(0) if f is None else F.when(x["tag"] == i, key(x[f"l{i}"], f))).alias(f"l{i}") for i, f in enumerate(s.lanes)]
        return F.struct(x["tag"].alias("tag"), *lanes)
    if isinstance(s, List):
        return F.struct(F.size(x).alias("n"), F.transform(x, lambda v: key(v, s.item)).alias("v"))
    return F.lit(True)


@dataclass
class Value:
    shape: object
    col: Column
    err: Column | None = None

    def field(self, i: int) -> Value:
        if not isinstance(self.shape, Prod) or i >= len(self.shape.fields):
            raise ProgramError(f"no field {i} in {self.shape}")
        return Value(self.shape.fields[i], self.col[f"_{i}"], self.err)


def either(*errs: Column | None) -> Column | None:
    out = None
    for e in errs:
        if e is not None:
            out = e if out is None else out | e
    return out


def bound(v: Value, body) -> Value:
    """``body`` applied to a value that is evaluated once."""
    found: list[Value] = []
    held = F.struct(v.col.alias("v"), (F.lit(False) if v.err is None else v.err).alias("e"))

    def inner(b: Column) -> Column:
        r = body(Value(v.shape, b["v"], None if v.err is None else b["e"]))
        found.append(r)
        return F.struct(r.col.alias("v"), (F.lit(False) if r.err is None else r.err).alias("e"))

    out = F.element_at(F.transform(F.array(held), inner), 1)
    return Value(found[-1].shape, out["v"], None if found[-1].err is None else out["e"])


def over_list(v: Value, body) -> Value:
    """``body`` on each element; one failure among them fails the row."""
    item, found = need(v, List).item, []
    safe = v.col if v.err is None else F.when(~v.err, v.col)

    def inner(x: Column) -> Column:
        r = body(Value(item, x))
        found.append(r)
        return r.col if r.err is None else F.struct(r.col.alias("v"), r.err.alias("e"))

    out = F.transform(safe, inner)
    r = found[-1]
    if r.err is None:
        return Value(List(r.shape), out, v.err)
    once = Value(List(Unit()), out, v.err)
    return bound(once, lambda b: Value(List(r.shape), F.transform(b.col, lambda x: x["v"]), either(b.err, F.coalesce(F.exists(b.col, lambda x: x["e"]), F.lit(False)))))


def need(v: Value, kind):
    if not isinstance(v.shape, kind):
        raise ProgramError(f"expected {kind.__name__}, have {v.shape}")
    return v.shape


def pair(v: Value, n: int = 2) -> list[Value]:
    if len(need(v, Prod).fields) != n:
        raise ProgramError(f"expected {n} fields, have {v.shape}")
    return [v.field(i) for i in range(n)]


def made(fields: list[Value]) -> Value:
    """A product; it fails if any field does."""
    return Value(Prod(tuple(f.shape for f in fields)), F.struct(*(f.col.alias(f"_{i}") for i, f in enumerate(fields))), either(*(f.err for f in fields)))


def chosen(ok: Column, err: Column | None) -> Column:
    return ok if err is None else F.when(~err, ok)


# ---------------------------------------------------------------- operators


def wrap(x: Column, kind: str) -> Column:
    """Back into the kind's range."""
    bits = int(kind[1:])
    if kind[0] == "f" or bits == 64:
        return x
    low = scalar.low_bits(x if kind[0] == "u" else x + (1 << (bits - 1)), bits)
    return low if kind[0] == "u" else low - (1 << (bits - 1))


def arith(name: str, kind: str | None):
    def run(v: Value) -> Value:
        a, b = pair(v)
        k = kind or need(a, Num).kind
        out = {"add": lambda: a.col + b.col, "sub": lambda: a.col - b.col, "mul": lambda: a.col * b.col, "div": lambda: scalar.ieee_div(a.col, b.col)}[name]()
        return Value(Num(k), wrap(out, k), v.err)

    return run


def compare(test):
    def run(v: Value) -> Value:
        a, b = pair(v)
        s = unify(a.shape, b.shape)
        return Value(U64, test(key(fitted(a.col, a.shape, s), s), key(fitted(b.col, b.shape, s), s)).cast("bigint"), v.err)

    return run


def extreme(take):
    def run(v: Value) -> Value:
        a, b = pair(v)
        s = unify(a.shape, b.shape)
        return Value(s, F.when(take(key(a.col, s), key(b.col, s)), a.col).otherwise(b.col), v.err)

    return run


MAX64 = -1  # all bits of an unsigned word
FOLDS = {
    "add": (0, lambda a, x: a + x), "mul": (1, lambda a, x: a * x), "all": (1, lambda a, x: ((a != 0) & (x != 0)).cast("bigint")), "any": (0, lambda a, x: ((a != 0) | (x != 0)).cast("bigint")),
    "min": (MAX64, lambda a, x: F.when(scalar.unsigned_key(x) < scalar.unsigned_key(a), x).otherwise(a)), "max": (0, lambda a, x: F.when(scalar.unsigned_key(x) > scalar.unsigned_key(a), x).otherwise(a)),
}


def fold(name: str):
    seed, step = FOLDS[name]
    return lambda v: Value(need(v, List).item, F.aggregate(v.col, F.lit(seed).cast("bigint"), step), v.err)


def scan(name: str):
    seed, step = FOLDS[name]

    def run(v: Value) -> Value:
        start = F.struct(F.lit(seed).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("o"))
        go = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["o"], F.array(step(acc["s"], x))).alias("o"))
        return Value(v.shape, F.aggregate(v.col, start, go, lambda acc: acc["o"]), v.err)

    return run


def iota(v: Value) -> Value:
    return Value(List(U64), F.when(v.col > 0, F.sequence(F.lit(0).cast("bigint"), v.col - 1)).otherwise(F.array().cast("array<bigint>")), v.err)


def sort(v: Value) -> Value:
    item = need(v, List).item
    keyed = F.transform(v.col, lambda x, i: F.struct(key(x, item).alias("k"), i.alias("i"), x.alias("v")))
    return Value(v.shape, F.transform(F.array_sort(keyed), lambda s: s["v"]), v.err)


def dedup(v: Value) -> Value:
    return sort(Value(v.shape, F.array_distinct(v.col), v.err))


def group(v: Value) -> Value:
    k, x = need(v, List).item.fields
    keys = dedup(Value(List(k), F.transform(v.col, lambda p: p["_0"])))
    out = F.transform(keys.col, lambda u: F.struct(u.alias("_0"), F.transform(F.filter(v.col, lambda p: p["_0"].eqNullSafe(u)), lambda p: p["_1"]).alias("_1")))
    return Value(List(Prod((k, List(x)))), out, v.err)


def find(v: Value) -> Value:
    needles, hay = pair(v)
    s = unify(needles.shape, hay.shape).item
    n, h = fitted(needles.col, needles.shape, List(s)), fitted(hay.col, hay.shape, List(s))
    count = lambda u, test: F.size(F.filter(h, lambda x: test(key(x, s), key(u, s)))).cast("bigint")
    return Value(List(Prod((U64, U64))), F.transform(n, lambda u: F.struct(count(u, lambda a, b: a < b).alias("_0"), count(u, lambda a, b: a <= b).alias("_1"))), v.err)


def slices(v: Value) -> Value:
    ranges, hay = pair(v)
    bad = F.exists(ranges.col, lambda r: (r["_0"] < 0) | (r["_1"] < r["_0"]) | (r["_1"] > F.size(hay.col)))
    out = F.transform(ranges.col, lambda r: F.slice(hay.col, r["_0"].cast("int") + 1, (r["_1"] - r["_0"]).cast("int")))
    return Value(List(hay.shape), F.when(~bad, out), either(v.err, bad))


def zipped(v: Value) -> Value:
    a, b = pair(v)
    bad = F.size(a.col) != F.size(b.col)
    out = F.zip_with(a.col, b.col, lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))
    return Value(List(Prod((need(a, List).item, need(b, List).item))), F.when(~bad, out), either(v.err, bad))


def transpose(v: Value) -> Value:
    fields = need(v, List).item.fields
    lane = lambda i: F.transform(v.col, lambda x: x[f"_{i}"]).alias(f"_{i}")
    return Value(Prod(tuple(List(f) for f in fields)), F.struct(*map(lane, range(len(fields)))), v.err)


def filtered(v: Value) -> Value:
    a, mask = pair(v)
    bad = F.size(a.col) != F.size(mask.col)
    kept = F.transform(F.filter(F.zip_with(a.col, mask.col, lambda x, m: F.struct(x.alias("v"), m.alias("m"))), lambda p: p["m"] != 0), lambda p: p["v"])
    return Value(a.shape, F.when(~bad, kept), either(v.err, bad))


def gather(v: Value) -> Value:
    idx, hay = pair(v)
    bad = F.exists(idx.col, lambda i: (i < 0) | (i >= F.size(hay.col)))
    return Value(hay.shape, F.when(~bad, F.transform(idx.col, lambda i: F.get(hay.col, i.cast("int")))), either(v.err, bad))


def gather_try(v: Value) -> Value:
    idx, hay = pair(v)
    item = need(hay, List).item
    inside = lambda i: (i >= 0) & (i < F.size(hay.col))
    out = F.transform(idx.col, lambda i: F.struct(inside(i).cast("tinyint").alias("tag"), F.when(~inside(i), i).alias("l0"), F.when(inside(i), F.get(hay.col, i.cast("int"))).alias("l1")))
    return Value(List(Sum((U64, item))), out, v.err)


def get(v: Value) -> Value:
    i, hay = pair(v)
    bad = (i.col < 0) | (i.col >= F.size(hay.col))
    return Value(need(hay, List).item, F.when(~bad, F.get(hay.col, i.col.cast("int"))), either(v.err, bad))


def head(v: Value) -> Value:
    bad = F.size(v.col) == 0
    return Value(need(v, List).item, F.get(v.col, F.lit(0)), either(v.err, bad))


def flatten(v: Value) -> Value:
    inner = need(v, List).item
    ends = scan("add")(Value(List(U64), F.transform(v.col, lambda x: F.size(x).cast("bigint"))))
    ranges = F.zip_with(ends.col, v.col, lambda e, x: F.struct((e - F.size(x)).alias("_0"), e.alias("_1")))
    return Value(Prod((List(Prod((U64, U64))), inner)), F.struct(ranges.alias("_0"), F.flatten(v.col).alias("_1")), v.err)


def cap_list(v: Value) -> Value:
    x, ys = pair(v)
    return Value(List(Prod((x.shape, need(ys, List).item))), F.transform(ys.col, lambda y: F.struct(x.col.alias("_0"), y.alias("_1"))), v.err)


def cap_sum(v: Value) -> Value:
    x, s = pair(v)
    lanes = need(s, Sum).lanes
    out = [F.lit(None).cast("boolean").alias(f"l{i}") if f is None else F.when(s.col["tag"] == i, F.struct(x.col.alias("_0"), s.col[f"l{i}"].alias("_1"))).alias(f"l{i}") for i, f in enumerate(lanes)]
    return Value(Sum(tuple(None if f is None else Prod((x.shape, f)) for f in lanes)), F.struct(s.col["tag"].alias("tag"), *out), v.err)


def unwrap(v: Value) -> Value:
    lanes, s = need(v, Sum).lanes, None
    for f in lanes:
        s = unify(s, f)
    live = [F.when(v.col["tag"] == i, fitted(v.col[f"l{i}"], f, s)) for i, f in enumerate(lanes) if f is not None]
    return Value(s, F.coalesce(*live), v.err)


def unweave(v: Value) -> Value:
    lanes = need(v, List).item.lanes
    lane = lambda i: F.transform(F.filter(v.col, lambda x: x["tag"] == i), lambda x: x[f"l{i}"]).alias(f"_{i + 1}")
    live = [i for i, f in enumerate(lanes) if f is not None]
    return Value(Prod((List(U64), *(List(lanes[i]) for i in live))), F.struct(F.transform(v.col, lambda x: x["tag"].cast("bigint")).alias("_0"), *map(lane, live)), v.err)


def select(v: Value) -> Value:
    m, a, b = pair(v, 3)
    s = unify(a.shape, b.shape)
    return Value(s, F.when(m.col != 0, fitted(a.col, a.shape, s)).otherwise(fitted(b.col, b.shape, s)), v.err)


def append(v: Value) -> Value:
    a, b = pair(v)
    s = unify(a.shape, b.shape)
    return Value(s, F.concat(fitted(a.col, a.shape, s), fitted(b.col, b.shape, s)), v.err)


def branch(v: Value, n: int) -> Value:
    x, tag = pair(v)
    bad = (tag.col < 0) | (tag.col >= n)
    lanes = [F.when(tag.col == i, x.col).alias(f"l{i}") for i in range(n)]
    return Value(Sum((x.shape,) * n), F.when(~bad, F.struct(tag.col.cast("tinyint").alias("tag"), *lanes)), either(v.err, bad))


def inject(v: Value, tag: int, n: int) -> Value:
    lanes = tuple(v.shape if i == tag else None for i in range(n))
    cols = [(v.col if i == tag else F.lit(None).cast("boolean")).alias(f"l{i}") for i in range(n)]
    return Value(Sum(lanes), F.struct(F.lit(tag).cast("tinyint").alias("tag"), *cols), v.err)


def chunk(v: Value, k: int) -> Value:
    n = F.size(v.col)
    bad = n % k != 0
    rows = F.transform(F.sequence(F.lit(0), F.floor(n / k).cast("int") - 1), lambda i: F.slice(v.col, i * k + 1, k))
    return Value(List(v.shape), F.when(~bad & (n > 0), rows).when(n == 0, F.array().cast(ddl(List(v.shape)))), either(v.err, bad))


def attempt(v: Value) -> Value:
    """Failure becomes an ordinary variant: Sum of value and unit."""
    err = F.lit(False) if v.err is None else v.err
    return Value(Sum((v.shape, Unit())), F.struct(F.when(err, 1).otherwise(0).cast("tinyint").alias("tag"), chosen(v.col, v.err).alias("l0"), F.when(err, True).alias("l1")))


def split(v: Value, delimiter: str) -> Value:
    d = delimiter.encode()[0]
    start = F.array(F.array().cast("array<bigint>"))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.when(x == d, F.concat(acc, start)).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last(acc), F.array(x)))))
    return Value(List(v.shape), F.aggregate(v.col, start, step), v.err)


def parse_u64(v: Value) -> Value:
    text = F.array_join(F.transform(v.col, lambda b: F.char(b)), "")
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    fits = F.forall(v.col, lambda b: (b >= 48) & (b <= 57)) & (F.size(v.col) > 0) & ((F.length(digits) < 20) | ((F.length(digits) == 20) & (digits <= "18446744073709551615")))
    wide = F.when(fits, digits).cast("decimal(20,0)")
    word = F.when(wide > F.lit("9223372036854775807").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide).cast("bigint")
    return Value(Sum((v.shape, U64)), F.struct(fits.cast("tinyint").alias("tag"), F.when(~fits, v.col).alias("l0"), F.when(fits, word).alias("l1")), v.err)


def literal(v: Value, n, kind: str = "u64") -> Value:
    n = n - (1 << 64) if kind == "u64" and n >= 1 << 63 else n
    return Value(Num(kind), F.lit(n).cast(ddl(Num(kind))), v.err)


def text(v: Value, s: str) -> Value:
    return Value(BYTES, F.array(*(F.lit(b).cast("bigint") for b in s.encode())).cast("array<bigint>"), v.err)


def unary(f, kind=None):
    return lambda v: Value(Num(kind) if kind else v.shape, wrap(f(v.col), kind or need(v, Num).kind), v.err)


KINDS = [f"{k}{w}" for k in "ui" for w in (8, 16, 32, 64)] + ["f32", "f64"]
PLAIN = {
    "iota": iota, "sort": sort, "dedup": dedup, "group": group, "find": find, "slices": slices, "zip": zipped, "transpose": transpose, "filter": filtered, "gather": gather, "gather_try": gather_try, "get": get, "head": head,
    "flatten": flatten, "cap_list": cap_list, "cap_sum": cap_sum, "unwrap": unwrap, "unweave": unweave, "select": select, "append": append, "try": attempt, "parse_u64": parse_u64,
    "len": lambda v: Value(U64, F.size(v.col).cast("bigint"), v.err), "enlist": lambda v: Value(List(v.shape), F.array(v.col), v.err), "unit": lambda v: Value(Unit(), F.lit(True), v.err),
    "eq": compare(lambda a, b: a.eqNullSafe(b)), "ne": compare(lambda a, b: ~a.eqNullSafe(b)), "lt": compare(lambda a, b: a < b), "le": compare(lambda a, b: a <= b),
    "min": extreme(lambda a, b: a <= b), "max": extreme(lambda a, b: a >= b), "neg": unary(lambda x: -x), "signed": unary(scalar.unsigned_key), "enc_i64": unary(scalar.unsigned_key), "dec_i64": unary(scalar.unsigned_key, "i64"),
    "to_f32": lambda v: Value(Num("f32"), v.col.cast("float"), v.err), "to_f64": lambda v: Value(Num("f64"), v.col.cast("double"), v.err),
    **{n: arith(n, None) for n in ("add", "sub", "mul")}, **{f"{n}_{k}": arith(n, k) for n in ("add", "sub", "mul") for k in KINDS}, **{f"div_{k}": arith("div", k) for k in ("f32", "f64")},
    **{f"neg_{k}": unary(lambda x: -x, k) for k in KINDS}, **{f"fold_{n}": fold(n) for n in FOLDS}, **{f"scan_{n}": scan(n) for n in FOLDS},
}
#: Operators that take a number after their name.
NUMBERED = {
    "gt": lambda v, n: Value(U64, (scalar.unsigned_key(v.col) > n - (1 << 63)).cast("bigint"), v.err), "and": lambda v, n: Value(U64, v.col.bitwiseAND(F.lit(n)), v.err), "shr": lambda v, n: Value(U64, F.shiftrightunsigned(v.col, n), v.err),
    "lit": literal, "chunk": chunk, "field": lambda v, i: v.field(i), "cast": lambda v, n: Value(Num(f"u{n}"), scalar.as_width(v.col, n), v.err), **{f"lit_{k}": (lambda v, n, k=k: literal(v, n, k)) for k in KINDS},
}
IMMEDIATE = {"add", "sub", "mul", "eq", "ne", "lt", "le", "min", "max", *(f"{n}_{k}" for n in ("add", "sub", "mul") for k in KINDS)}

# ---------------------------------------------------------------- reading

TOKEN = re.compile(r'\s+|#[^\n]*|(?P<arrow>->)|(?P<mark>[().,=|])|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|"(?P<text>[^"]*)"')


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise ProgramError(f"cannot read {source[at : at + 12]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Reader:
    """Reads a program and builds its value on the way: names stand for values already at hand."""

    def __init__(self, source: str, root: Value):
        self.toks, self.at, self.root = tokens(source), 0, root
        self.enums: dict[str, list[str]] = {}

    def peek(self, *want: str) -> bool:
        return self.toks[self.at][1] in want and self.toks[self.at][0] != "text"

    def take(self, want: str | None = None) -> tuple[str, str]:
        tok = self.toks[self.at]
        if want is not None and (tok[1] != want or tok[0] == "text"):
            raise ProgramError(f"expected {want!r}, have {tok[1]!r}")
        self.at += 1
        return tok

    def number(self) -> int:
        kind, value = self.take()
        if kind != "num":
            raise ProgramError(f"expected a number, have {value!r}")
        return int(value)

    def pattern(self) -> list[str] | str:
        if not self.peek("("):
            return self.take()[1]
        self.take("(")
        names = [self.take()[1]]
        while self.peek(","):
            self.take(",")
            names.append(self.take()[1])
        self.take(")")
        return names

    @staticmethod
    def bind(env: dict, pattern, v: Value) -> dict:
        return {**env, pattern: v} if isinstance(pattern, str) else {**env, **dict(zip(pattern, pair(v, len(pattern)), strict=True))}

    def again(self, env: dict):
        """The lambda at this place as a Python function; its text is read once per use."""
        begin = self.at

        def call(v: Value) -> Value:
            self.at = begin
            pattern = self.pattern()
            self.take("->")
            return self.expr(self.bind(env, pattern, v))

        return call

    def lambdas(self, env: dict, use):
        """``( lambda )``: ``use`` gets it as a function and is called at once."""
        self.take("(")
        out = use(self.again(env))
        self.take(")")
        return out

    def skip_lambda(self) -> int:
        """Move past a parenthesised lambda; returns where it began."""
        begin, depth = self.at, 0
        while True:
            kind, value = self.take()
            depth += (kind == "mark") * ((value == "(") - (value == ")"))
            if depth == 0:
                return begin

    def expr(self, env: dict) -> Value:
        if self.peek("enum"):
            self.take()
            name = self.take()[1]
            self.take("=")
            variants = [self.take()[1]]
            while self.peek("|"):
                self.take("|")
                variants.append(self.take()[1])
            self.take("in")
            self.enums[name] = variants
            return self.expr(env)
        if self.peek("let"):
            self.take()
            pattern = self.pattern()
            self.take("=")
            value = self.expr(env)
            self.take("in")
            begin = self.at

            def body(v: Value) -> Value:
                self.at = begin
                return self.expr(self.bind(env, pattern, v))

            return bound(value, body)
        v = self.atom(env)
        while self.toks[self.at][0] in ("name", "text") and not self.peek("in") or self.peek("."):
            v = self.stage(v, env)
        return v

    def atom(self, env: dict) -> Value:
        if self.peek("("):
            self.take("(")
            fields = [self.expr(env)]
            while self.peek(","):
                self.take(",")
                fields.append(self.expr(env))
            self.take(")")
            return fields[0] if len(fields) == 1 else made(fields)
        name = self.take()[1]
        if name not in env:
            raise ProgramError(f"unknown name {name!r}")
        return env[name]

    def tag(self) -> int:
        kind, value = self.take()
        if kind == "num":
            return int(value)
        return self.variant(value)[0]

    def variant(self, name: str) -> tuple[int, int]:
        for variants in self.enums.values():
            if name in variants:
                return variants.index(name), len(variants)
        raise ProgramError(f"unknown variant {name!r}")

    def arm(self, v: Value, k: int, f) -> Value:
        """The arm's result on lane k; its failure counts only for rows of that tag."""
        lanes = need(v, Sum).lanes
        r = f(Value(lanes[k], v.col[f"l{k}"]))
        here = v.col["tag"] == k
        return Value(r.shape, F.when(here, r.col), None if r.err is None else F.coalesce(here & r.err, F.lit(False)))

    def with_arms(self, v: Value, arms: dict[int, Value]) -> Value:
        shapes, cols = list(v.shape.lanes), []
        for i, f in enumerate(v.shape.lanes):
            if i in arms and f is not None:
                shapes[i] = arms[i].shape
                cols.append(arms[i].col.alias(f"l{i}"))
            else:
                cols.append(v.col[f"l{i}"].alias(f"l{i}"))
        return Value(Sum(tuple(shapes)), F.struct(v.col["tag"].alias("tag"), *cols), either(v.err, *(a.err for a in arms.values())))

    def stage(self, v: Value, env: dict) -> Value:
        kind, name = self.take()
        if kind == "text":
            return text(v, name)
        if name == ".":
            return v.field(self.number())
        if name == "map":
            return self.mapped(v, env)
        if name == "transpose" and self.peek("zip") and len(need(v, List).item.fields) == 2:
            self.take()  # taken apart and put together again: nothing to do
            return v
        if name == "map_variant":
            k = self.tag()
            if need(v, Sum).lanes[k] is None:  # nothing is ever on this lane
                self.skip_lambda()
                return v
            return self.lambdas(env, lambda f: bound(v, lambda b: self.with_arms(b, {k: self.arm(b, k, f)})))
        if name == "match":
            return self.match(v, env)
        if name in ("fold", "scan", "foldscan"):
            return self.lambdas(env, lambda f: self.walk(name, v, f))
        if name == "inject":
            kind, value = self.take()
            return inject(v, int(value), self.number()) if kind == "num" else inject(v, *self.variant(value))
        if name == "branch":
            kind, value = self.take()
            return bound(v, lambda b: branch(b, int(value) if kind == "num" else len(self.enums[value])))
        if name == "split":
            return split(v, self.take()[1])
        if name in NUMBERED:
            return NUMBERED[name](v, self.number())
        if name not in PLAIN:
            raise ProgramError(f"unknown operator {name!r}")
        if self.toks[self.at][0] == "num" and name in IMMEDIATE:
            return PLAIN[name](made([v, literal(v, self.number(), v.shape.kind)]))
        return bound(v, PLAIN[name]) if name not in ("unit", "len") else PLAIN[name](v)

    def mapped(self, v: Value, env: dict) -> Value:
        """A run of maps is one map of the composed body: each list is walked once."""
        begins = [self.skip_lambda()]
        while self.peek("map"):
            self.take()
            begins.append(self.skip_lambda())
        end = self.at

        def body(x: Value) -> Value:
            for begin in begins:
                self.at = begin
                x = self.lambdas(env, lambda f, x=x: f(x) if x.err is None and isinstance(x.shape, (Num, Unit)) else bound(x, f))
            return x

        out = over_list(v, body)
        self.at = end
        return out

    def match(self, v: Value, env: dict) -> Value:
        self.take("(")
        places: list[tuple[int, int]] = []
        while True:
            k = self.tag()
            if k in dict(places):
                raise ProgramError(f"two arms for tag {k}")
            places.append((k, self.skip_lambda()))
            if not self.peek(","):
                break
            self.take(",")
        self.take(")")
        end = self.at

        def body(b: Value) -> Value:
            arms = {}
            for k, begin in places:
                if need(b, Sum).lanes[k] is None:
                    continue
                self.at = begin
                arms[k] = self.lambdas(env, lambda f, k=k: self.arm(b, k, f))
            self.at = end
            return unwrap(self.with_arms(b, arms))

        out = bound(v, body)
        self.at = end
        return out

    def walk(self, how: str, v: Value, f) -> Value:
        """Seeded fold; scan keeps every state, foldscan a state and an output for each element."""
        seed, xs = pair(v)
        item, found = need(xs, List).item, []
        probe = f(made([seed, Value(item, F.lit(None).cast(ddl(item)))]))
        out_shape = None if how == "fold" else probe.shape if how == "scan" else pair(probe)[1].shape
        start = [seed.col.cast(ddl(seed.shape)).alias("s"), F.lit(False).alias("e")]
        if out_shape is not None:
            start.append(F.array().cast(ddl(List(out_shape))).alias("o"))

        def step(acc: Column, x: Column) -> Column:
            r = f(made([Value(seed.shape, acc["s"]), Value(item, x)]))
            found.append(r)
            state, out = (r, r) if how != "foldscan" else pair(r)
            now = [state.col.cast(ddl(seed.shape)).alias("s"), (acc["e"] if r.err is None else acc["e"] | r.err).alias("e")]
            if out_shape is not None:
                now.append(F.concat(acc["o"], F.array(out.col.cast(ddl(out_shape)))).alias("o"))
            return F.struct(*now)

        done = F.aggregate(xs.col, F.struct(*start), step)
        once = bound(Value(Unit(), done, v.err), lambda b: Value(Unit(), b.col, b.err))
        err = v.err if found[-1].err is None else either(v.err, once.col["e"])
        if how == "fold":
            return Value(seed.shape, done["s"], err)
        if how == "scan":
            return Value(List(out_shape), done["o"], err)
        return Value(Prod((seed.shape, List(out_shape))), F.struct(done["s"].alias("_0"), done["o"].alias("_1")), err)


def register(name: str, f) -> None:
    """Add an operator (Value -> Value) to the vocabulary; built-in names cannot be replaced."""
    if name in PLAIN or name in NUMBERED:
        raise ProgramError(f"{name!r} is taken")
    PLAIN[name] = f


def pretty(s, rows: list) -> str:
    """Rows of a shape written column by column."""
    join = lambda xs: ", ".join(map(str, xs))
    if isinstance(s, Num):
        return f"[{join(x + (1 << 64) if s.kind == 'u64' and x < 0 else x for x in rows)}]"
    if isinstance(s, Unit):
        return f"()x{len(rows)}"
    if isinstance(s, Prod):
        return f"({join(pretty(f, [r[i] for r in rows]) for i, f in enumerate(s.fields))})"
    if isinstance(s, List):
        ends = [sum(map(len, rows[: i + 1])) for i in range(len(rows))]
        return f"List ends=[{join(ends)}] <{pretty(s.item, [x for r in rows for x in r])}>"
    lanes = ["⊥" if f is None else pretty(f, [r[i + 1] for r in rows if r[0] == i]) for i, f in enumerate(s.lanes)]
    return f"Sum tags=[{join(r[0] for r in rows)}] [{join(lanes)}]"


class Program:
    """A program's text, ready to be applied to a column of whole numbers."""

    def __init__(self, source: str):
        self.source = source

    def value(self, root: Column) -> Value:
        reader = Reader(self.source, Value(U64, root))
        out = reader.expr({"input": Value(U64, root)})
        if reader.toks[reader.at][0] != "end":
            raise ProgramError(f"cannot go on at {reader.toks[reader.at][1]!r}")
        return out

    @property
    def total(self) -> bool:
        """Whether no row can fail, known from the text."""
        return self.value(F.lit(0).cast("bigint")).err is None

    @property
    def shape(self):
        return self.value(F.lit(0).cast("bigint")).shape

    def apply(self, df: DataFrame, column: str, result: str = "result", err: str = "err") -> DataFrame:
        """``df`` with the result (null where the row fails) and whether it failed."""
        with scalar.wrapping(df.sparkSession):
            v = self.value(F.col(column).cast("bigint"))
            return df.withColumns({result: chosen(v.col, v.err), err: F.lit(False) if v.err is None else v.err})


class Builder:
    """A program as a graph of operators, added one by one; a node that several others use is computed once.

    >>> b = Builder()
    >>> squares = b.add("mul", b.tuple(b.input, b.input))
    >>> b.program(b.tuple(squares, b.add("gt", squares, number=40)))
    """

    input = 0

    def __init__(self):
        self.nodes: list[tuple[str, tuple[int, ...], int | None]] = [("input", (), None)]

    def add(self, name: str, *of: int, number: int | None = None) -> int:
        """A node for an operator of the vocabulary; several arguments are its product."""
        if name not in PLAIN and name not in NUMBERED or (name in NUMBERED) != (number is not None):
            raise ProgramError(f"no operator {name!r} {'with' if number is not None else 'without'} a number")
        return self._node(name, of, number)

    def tuple(self, *of: int) -> int:
        return self._node("", of, None)

    def _node(self, name: str, of: tuple[int, ...], number: int | None) -> int:
        if not of or any(not 0 <= k < len(self.nodes) for k in of):
            raise ProgramError("a node takes nodes that are there already")
        self.nodes.append((name, of, number))
        return len(self.nodes) - 1

    def program(self, result: int) -> Program:
        return Built(list(self.nodes), result)


class Built(Program):
    """The program of a graph's node."""

    def __init__(self, nodes: list, result: int):
        self.nodes, self.result, self.source = nodes, result, ""

    def value(self, root: Column) -> Value:
        needed, todo = {0}, [self.result]
        while todo:
            k = todo.pop()
            needed.add(k)
            todo += [x for x in self.nodes[k][1] if x not in needed]
        uses = [of for k in needed for of in self.nodes[k][1]]

        def made_of(k: int, held: dict[int, Value]) -> Value:
            name, of, number = self.nodes[k]
            args = held[of[0]] if name and len(of) == 1 else made([held[x] for x in of])
            return args if not name else PLAIN[name](args) if number is None else NUMBERED[name](args, number)

        def go(rest: list[int], held: dict[int, Value]) -> Value:
            if not rest:
                return held[self.result]
            k, *rest = rest
            v = made_of(k, held)
            return bound(v, lambda b: go(rest, {**held, k: b})) if uses.count(k) > 1 else go(rest, {**held, k: v})

        return go(sorted(needed - {0}), {0: Value(U64, root)})
